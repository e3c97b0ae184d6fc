"""LEF as relational steps: statements in file order, sections carried forward, one table a section; conversions to cells and rules, and the way back.

A statement ends at a semicolon; what opens or closes a section (MACRO, PIN, PORT, OBS, LAYER, SITE, VIA, UNITS, END) has none and is cut off its front.
Comments run from # to the end of the line. Sizes are microns; in database units they are cut toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import statements as statements_
from tessella.functions.codes import number_text, stable_mean
from tessella.functions.curves import point, units
from tessella.operators.sequences import must, running
from tessella.plans.session import materialise

PIECE = r"(END(?:\s+(?!(?:END|MACRO|PIN|PORT|OBS|LAYER|SITE|VIA|UNITS|VERSION)\s)\S+)?(?=\s|$)|(?:MACRO|PIN)\s+\S+|(?:PORT|OBS|UNITS)(?=\s|$)|VIA\s+\S+(?:\s+DEFAULT)?(?=\s+\S)|(?:LAYER|SITE)\s+\S+(?=\s+\S)|\S[\s\S]*)"
TOPS = ("LAYER", "SITE", "VIA", "MACRO", "UNITS")


PLACE = "struct<block:bigint,seq:bigint,part:int>"  # of a statement in its file


def word(i: int) -> Column:
    return F.get("words", F.lit(i))


def rest(words: str) -> Column:
    """All but the first."""
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))


def pieces(statements: DataFrame, pattern: str = PIECE) -> DataFrame:
    """file, block, seq (a place: block, statement, part), words, whole: openings, closings and statements (whole) in order."""
    # a comment may hold a semicolon: then the next statement starts within it
    tail = F.when(F.contains("text", F.lit("\n")), F.contains(F.substring_index("text", "\n", -1), F.lit("#"))).when(F.contains("text", F.lit("#")), True)
    open_ = running(statements, carried={"noted": tail}, before=True)
    text = F.when(F.col("noted"), F.regexp_replace("text", r"^[^\n]*", " ")).otherwise(F.col("text"))
    bare = open_.select("file", "block", "seq", statements_.cut(F.regexp_replace(text, r"#[^\n]*", " "), pattern).alias("p"))
    sized = bare.select("file", "block", "seq", F.size("p").alias("n"), "p")
    cut = sized.select("file", "block", "seq", "n", F.posexplode("p").alias("part", "words"))
    placed = cut.select("file", "block", F.struct("block", "seq", "part").alias("seq"), "words", (F.col("part") == F.col("n") - 1).alias("whole"))
    return materialise(placed, "pieces")  # what runs along them reads them twice


def scan(statements: DataFrame) -> DataFrame:
    """Every statement with its section: file, block, seq, words, top, name, section (number), pin and area ('' outside), port (number), layer."""
    p = pieces(statements)
    opens = ~F.col("whole")
    top = opens & word(0).isin(*TOPS)
    shape_layer = F.col("whole") & (word(0) == "LAYER") & (F.size("words") == 2)
    pin = F.when(opens & (word(0) == "PIN"), word(1)).when(top | (word(0) == "END") & (F.size("words") == 2), "")
    area = F.when(opens & word(0).isin("PORT", "OBS"), word(0)).when(top | (word(0) == "END"), "")
    state = running(p, {"section": top.cast("int"), "port": (opens & word(0).isin("PORT", "OBS") | shape_layer).cast("int")}, {"top": F.when(top, word(0)), "name": F.when(top, F.coalesce(word(1), F.lit(""))), "pin": pin, "area": area, "layer": F.when(shape_layer, word(1))})
    return materialise(state.where("whole and words[0] <> 'END'").drop("whole"), "lef-statements")


def _first(key: str, i: int = 1) -> Column:
    """Word i of a section's first statement that starts with key. WIDTH with more than one number is a row of a spacing table."""
    hit = (word(0) == key) & ((F.size("words") == 2) if key == "WIDTH" else F.lit(True))
    return F.min_by(F.when(hit, word(i)), F.when(hit, F.col("seq")))


def _number(c: Column) -> Column:
    return c.cast("double")


def dbu(scanned: DataFrame) -> DataFrame:
    """file, dbu: database units a micron, 1000 where not given."""
    return scanned.groupBy("file").agg(F.coalesce(F.max(F.when((F.col("top") == "UNITS") & (word(0) == "DATABASE"), word(2))).cast("double"), F.lit(1000.0)).alias("dbu"))


def layers(scanned: DataFrame) -> DataFrame:
    """file, layer (number by order from 1), name, type, direction and the layer's sizes. A file has few layers."""
    numbers = {"pitch": "PITCH", "width": "WIDTH", "min_width": "MINWIDTH", "spacing": "SPACING", "thickness": "THICKNESS", "area": "AREA"}
    one = scanned.where("top = 'LAYER'").groupBy("file", "section").agg(F.first("name").alias("name"), F.lower(_first("TYPE")).alias("type"), F.lower(_first("DIRECTION")).alias("direction"), *(_number(_first(k)).alias(c) for c, k in numbers.items()), *(_number(_first("ENCLOSURE", i)).alias(f"overhang{j}") for j, i in ((1, 1), (2, 2))))
    order = F.row_number().over(Window.partitionBy("file").orderBy("section"))
    return one.select("file", order.alias("layer"), *(c for c in one.columns if c not in ("file", "section")))


def macros(scanned: DataFrame) -> DataFrame:
    one = scanned.where("top = 'MACRO'").groupBy("file", F.col("section").alias("macro_idx")).agg(F.first("name").alias("macro"), _first("CLASS").alias("class"), _number(_first("ORIGIN")).alias("origin_x"), _number(_first("ORIGIN", 2)).alias("origin_y"), _number(_first("SIZE")).alias("width"), _number(_first("SIZE", 3)).alias("height"), _first("SITE").alias("site"))
    return one


def sites(scanned: DataFrame) -> DataFrame:
    return scanned.where("top = 'SITE'").groupBy("file", "section").agg(F.first("name").alias("site"), _first("CLASS").alias("class"), _number(_first("SIZE")).alias("width"), _number(_first("SIZE", 3)).alias("height")).drop("section")


def pins(scanned: DataFrame) -> DataFrame:
    inside = scanned.where("top = 'MACRO' and pin <> ''")
    return inside.groupBy("file", F.col("section").alias("macro_idx"), "pin").agg(F.first("name").alias("macro"), _first("DIRECTION").alias("direction"), _first("USE").alias("use"), F.min("seq").alias("pin_seq"))


def shapes(scanned: DataFrame) -> DataFrame:
    """RECT and POLYGON of macros and vias: file, top, owner_idx, owner, pin ('' outside), area, port, seq, layer_name, kind, coordinates (microns)."""
    drawn = scanned.where("top in ('MACRO', 'VIA') and words[0] in ('RECT', 'POLYGON')")
    values = F.transform(F.filter(rest("words"), lambda w: ~w.isin("(", ")", "MASK", "ITERATE")), lambda w: w.cast("double"))
    return drawn.select("file", "top", F.col("section").alias("owner_idx"), F.col("name").alias("owner"), "pin", "area", "port", "seq", F.col("layer").alias("layer_name"), F.lower(word(0)).alias("kind"), values.alias("coordinates"))


def elements(scanned: DataFrame) -> DataFrame:
    """Cells of the macros: file, cell_idx, cell, elem_idx, kind (boundary or text), layer, points, origin, text. A shape on a layer that isn't defined raises.

    Each port (or layer of one) gives its rectangles, its polygons, and for pins a text at the middle of its first rectangle, else the mean of its first polygon.
    """
    drawn = shapes(scanned).where("top = 'MACRO'").alias("s").join(layers(scanned).select("file", "layer", F.col("name").alias("layer_name")).alias("l"), F.expr("s.file = l.file and s.layer_name = l.layer_name"), "left")
    drawn = drawn.select("s.*", must(F.col("l.layer").isNotNull(), F.concat(F.lit("LEF: unresolved layer "), F.col("s.layer_name")), F.col("l.layer")).alias("layer")).join(dbu(scanned), "file")
    c = lambda i: F.get("coordinates", F.lit(i))
    scale = F.col("dbu")
    spot = lambda x, y: point(units(x, scale), units(y, scale))
    box = F.array(spot(c(0), c(1)), spot(c(2), c(1)), spot(c(2), c(3)), spot(c(0), c(3)), spot(c(0), c(1)))
    ring = F.transform(F.sequence(F.lit(0), F.floor(F.size("coordinates") / 2).cast("int") - 1), lambda i: spot(F.get("coordinates", 2 * i), F.get("coordinates", 2 * i + 1)))
    closed = F.when(F.get(ring, F.lit(0)) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    place = F.struct((F.col("area") == "OBS").cast("int").alias("a"), F.col("port").alias("b"), (F.col("kind") == "polygon").cast("int").alias("c"), F.col("seq").alias("d"))
    base = ["file", "owner_idx", "owner", "layer"]
    drawn_out = drawn.select(*base, place.alias("place"), F.lit("boundary").alias("kind"), F.when(F.col("kind") == "rect", box).otherwise(closed).alias("points"), F.lit(None).cast("struct<x:int,y:int>").alias("origin"), F.lit(None).cast("string").alias("text"))
    firsts = drawn.where("area = 'PORT' and pin <> ''").groupBy(*base, "pin", "port", "dbu").agg(F.min_by(F.struct("kind", "coordinates"), F.struct((F.col("kind") == "polygon").cast("int"), F.col("seq"))).alias("f"))
    def axis(o: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size("f.coordinates") / 2).cast("int") - 1), lambda i: F.get("f.coordinates", 2 * i + o))

    xs, ys = axis(0), axis(1)
    middle = lambda i, j: F.get("f.coordinates", F.lit(i)) / 2.0 + F.get("f.coordinates", F.lit(j)) / 2.0
    centre = F.when(F.col("f.kind") == "rect", spot(middle(0, 2), middle(1, 3))).otherwise(spot(stable_mean(xs), stable_mean(ys)))
    label_place = F.struct(F.lit(0).alias("a"), F.col("port").alias("b"), F.lit(2).alias("c"), F.lit(None).cast(PLACE).alias("d"))
    labels = firsts.select(*base, label_place.alias("place"), F.lit("text").alias("kind"), F.lit(None).cast("array<struct<x:int,y:int>>").alias("points"), centre.alias("origin"), F.col("pin").alias("text"))
    order = F.row_number().over(Window.partitionBy("file", "owner_idx").orderBy("place")) - 1
    return drawn_out.unionByName(labels).select("file", F.col("owner_idx").alias("cell_idx"), F.col("owner").alias("cell"), order.alias("elem_idx"), "kind", "layer", "points", "origin", "text")


def technology(scanned: DataFrame) -> DataFrame:
    """Rules by layer: name, type, direction, pitch, width, spacing, thickness, min_width (else the width), min_spacing, min_area, and of cut layers min_enclosure."""
    cut = F.when((F.col("type") == "cut") & F.col("overhang1").isNotNull(), F.least("overhang1", "overhang2"))
    return layers(scanned).select("file", "layer", "name", "type", "direction", "pitch", "width", "spacing", "thickness", F.coalesce("min_width", "width").alias("min_width"), F.col("spacing").alias("min_spacing"), F.col("area").alias("min_area"), cut.alias("min_enclosure"))


# ---- the way back ---------------------------------------------------------------------------------------------


def obstructions(element: DataFrame, scale: float) -> DataFrame:
    """Boundaries of cells (file, cell_idx, cell, elem_idx, kind, layer, points) as macros' bounding boxes in microns: one row a cell and layer, layers rising."""

    def axis(c: str) -> Column:
        return F.transform("points", lambda p: p[c].cast("double") / F.lit(float(scale)))

    xs, ys = axis("x"), axis("y")
    box = F.struct("elem_idx", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    return element.where("kind = 'boundary'").groupBy("file", "cell_idx", "cell", "layer").agg(F.sort_array(F.collect_list(box)).alias("rects"))


def write_texts(cells: DataFrame, element: DataFrame, scale: float) -> DataFrame:
    """file, text: a layer for each number in use, a macro for each cell (file, cell_idx, cell), its boundaries as OBS rectangles."""
    rows = obstructions(element, scale)
    n = number_text
    rect = lambda r: F.concat_ws(" ", F.lit("      RECT"), n(r["x1"]), n(r["y1"]), n(r["x2"]), n(r["y2"]), F.lit(";\n"))
    part = F.concat(F.lit("    LAYER LAYER_"), F.col("layer").cast("string"), F.lit(" ;\n"), F.array_join(F.transform("rects", rect), ""))
    bodies = rows.groupBy("file", "cell_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", part.alias("part")))), lambda x: x["part"]), "").alias("body"))
    macro = F.concat(F.lit("MACRO "), F.col("cell"), F.lit("\n  ORIGIN 0 0 ;\n"), F.when(F.col("body").isNull(), "").otherwise(F.concat(F.lit("  OBS\n"), F.col("body"), F.lit("  END\n"))), F.lit("END "), F.col("cell"), F.lit("\n\n"))
    macros_of = cells.join(bodies, ["file", "cell_idx"], "left").select("file", "cell_idx", macro.alias("part")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_idx", "part"))), lambda x: x["part"]), "").alias("macros"))
    layer = lambda x: F.concat(F.lit("LAYER LAYER_"), x.cast("string"), F.lit("\n  TYPE ROUTING ;\nEND LAYER_"), x.cast("string"), F.lit("\n\n"))
    layers_of = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_set("layer")), layer), "").alias("layers"))
    head = f"VERSION 5.8 ;\nUNITS\n  DATABASE MICRONS {scale:g} ;\nEND UNITS\n\n"
    return macros_of.join(layers_of, "file", "left").select("file", F.concat(F.lit(head), F.coalesce("layers", F.lit("")), F.col("macros"), F.lit("END LIBRARY\n")).alias("text"))
