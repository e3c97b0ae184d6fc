"""DEF as relational steps: statements in file order, sections carried forward, one table a section; conversion to cells, and the way back.

Statements end at semicolons; `END name` stands before the next. An entry of a section starts with a dash and has clauses after plus signs. A star in a
route's point is the coordinate before it; a star with nothing before it raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import statements as statements_
from tessella.functions.codes import orientation_of, transform_of
from tessella.functions.curves import point
from tessella.functions.points import bounding_box, is_rectangle
from tessella.operators.sequences import must, running
from tessella.plans.session import materialise
from tessella.sources.lef import PLACE, pieces, rest, word

PIECE = r"(END\s+\S+(?=\s|$)|\S[\s\S]*)"
#: Sections that hold entries.
SECTIONS = ("COMPONENTS", "PINS", "NETS", "SPECIALNETS", "VIAS", "BLOCKAGES", "REGIONS", "FILLS", "GROUPS")
PLACED = ("PLACED", "FIXED", "COVER", "UNPLACED")
WIRED = ("ROUTED", "FIXED", "COVER", "NEW")


def scan(statements: DataFrame) -> DataFrame:
    """file, block, seq, words, section ('' outside), clauses (arrays of words between plus signs, the first with the entry's name)."""
    p = pieces(statements, PIECE)
    section = F.when(F.col("whole") & word(0).isin(*SECTIONS) & (F.size("words") == 2), word(0)).when(word(0) == "END", "")
    state = running(p, carried={"section": section}).withColumn("section", F.coalesce("section", F.lit("")))
    kept = state.where("whole and words[0] <> 'END'").where(~word(0).isin(*SECTIONS) | (F.size("words") != 2))
    return materialise(kept.select("file", "block", "seq", "words", "section", statements_.clauses(F.col("words")).alias("clauses")), "def-statements")


def _clause(*keys: str) -> Column:
    """The words of the entry's first clause that starts with one of the keys."""
    return F.get(F.filter(rest("clauses"), lambda c: F.get(c, F.lit(0)).isin(*keys)), F.lit(0))


def _at(clause: Column, i: int) -> Column:
    return F.get(clause, F.lit(i))


def _spots(words: Column) -> Column:
    """Pairs of numbers within brackets, as points."""
    text = F.array_join(words, " ")
    found = F.regexp_extract_all(text, F.lit(r"\( (-?\d+ -?\d+) \)"), F.lit(1))
    return F.transform(found, lambda s: point(F.split(s, " ")[0].cast("int"), F.split(s, " ")[1].cast("int")))


def design(scanned: DataFrame) -> DataFrame:
    """file, design, dbu, die: the die area's points as given (two are corners of a box)."""
    top = scanned.where("section = ''")
    first = lambda key, value: F.min_by(F.when(word(0) == key, value), F.when(word(0) == key, F.col("seq")))
    return top.groupBy("file").agg(F.coalesce(first("DESIGN", word(1)), F.lit("")).alias("design"), F.coalesce(first("UNITS", word(3)).cast("double"), F.lit(1000.0)).alias("dbu"), first("DIEAREA", _spots(F.col("words"))).alias("die"))


def die_ring(die: Column) -> Column:
    """The die as a closed ring: a box from two corners, else the polygon."""
    a, b = F.get(die, F.lit(0)), F.get(die, F.lit(1))
    x1, x2, y1, y2 = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    box = F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))
    return F.when(F.size(die) == 2, box).when(a != F.element_at(die, -1), F.concat(die, F.slice(die, 1, 1))).otherwise(die)


def die_area(ring: Column) -> Column:
    """The way back: two corners of a ring that is a box, else its points without the closing one."""
    b = bounding_box(ring)
    return F.when(is_rectangle(ring), F.array(point(b["x1"], b["y1"]), point(b["x2"], b["y2"]))).otherwise(F.slice(ring, F.lit(1), F.size(ring) - 1))


def _named(scanned: DataFrame, section: str) -> DataFrame:
    return scanned.where(F.col("section") == section).where("words[0] = '-'")


def _placement() -> list[Column]:
    put = _clause(*PLACED)
    return [F.lower(_at(put, 0)).alias("status"), _at(put, 2).cast("int").alias("x"), _at(put, 3).cast("int").alias("y"), _at(put, 5).alias("orientation")]


def components(scanned: DataFrame) -> DataFrame:
    return _named(scanned, "COMPONENTS").select("file", "block", "seq", word(1).alias("component"), word(2).alias("macro"), *_placement())


def pins(scanned: DataFrame) -> DataFrame:
    layer = _clause("LAYER")
    return _named(scanned, "PINS").select("file", "block", "seq", word(1).alias("pin"), _at(_clause("NET"), 1).alias("net"), F.lower(_at(_clause("DIRECTION"), 1)).alias("direction"), _at(_clause("USE"), 1).alias("use"), _at(layer, 1).alias("layer_name"), _spots(layer).alias("corners"), *_placement())


def rows(scanned: DataFrame) -> DataFrame:
    return scanned.where("section = '' and words[0] = 'ROW'").select("file", "seq", word(1).alias("row"), word(2).alias("site"), word(3).cast("int").alias("x"), word(4).cast("int").alias("y"), word(5).alias("orientation"), word(7).cast("int").alias("columns"), word(9).cast("int").alias("rows"), word(11).cast("int").alias("step_x"), word(12).cast("int").alias("step_y"))


def tracks(scanned: DataFrame) -> DataFrame:
    names = F.slice("words", F.array_position("words", "LAYER").cast("int") + 1, F.size("words"))
    return scanned.where("section = '' and words[0] = 'TRACKS'").select("file", "seq", word(1).alias("axis"), word(2).cast("int").alias("start"), word(4).cast("int").alias("count"), word(6).cast("int").alias("step"), F.when(F.array_contains("words", "LAYER"), names).alias("layers"))


def connections(scanned: DataFrame, section: str = "NETS") -> DataFrame:
    """file, net, component, pin: a row a connection, in order."""
    text = F.array_join(F.get("clauses", F.lit(0)), " ")
    named = _named(scanned, section).select("file", "block", "seq", word(1).alias("net"), F.regexp_extract_all(text, F.lit(r"\( (\S+ \S+) \)"), F.lit(1)).alias("found"))
    named = named.select("file", "block", "seq", "net", F.posexplode("found").alias("nth", "c"))
    return named.select("file", "block", "seq", "net", "nth", F.split("c", " ")[0].alias("component"), F.split("c", " ")[1].alias("pin"))


def _clauses(scanned: DataFrame, section: str) -> DataFrame:
    """file, block, seq, net, wire (number) and the words c of the clauses that draw. The name is taken first: an entry's words would go along with each of its clauses."""
    named = _named(scanned, section).select("file", "block", "seq", word(1).alias("net"), "clauses")
    return named.select("file", "block", "seq", "net", F.posexplode("clauses").alias("wire", "c")).where(F.col("wire") > 0).where(F.get("c", F.lit(0)).isin(*WIRED))


def wires(scanned: DataFrame, section: str = "NETS") -> DataFrame:
    """A row a wire: file, net, wire (number), status, layer_name, width (of special nets, else 1), points, via. Stars are resolved; a star without a coordinate before it raises."""
    cut = _clauses(scanned, section)
    special = section == "SPECIALNETS"
    bare = cut.select("file", "block", "seq", "net", "wire", F.lower(F.col("c")[0]).alias("status"), F.col("c")[1].alias("layer_name"), (F.col("c")[2].cast("int") if special else F.lit(1)).alias("width"), statements_.traced(F.col("c")).alias("t"), F.when(F.element_at("c", -1) != ")", F.element_at("c", -1)).alias("via"))
    return bare.select("file", "block", "seq", "net", "wire", "status", "layer_name", "width", must(F.col("t.known"), F.concat(F.lit("DEF: a route starts with a star: "), F.col("net")), F.col("t.points")).alias("points"), "via")


def route_points(scanned: DataFrame, section: str = "SPECIALNETS") -> DataFrame:
    """file, seq, net, wire, shape and the points of its clause as written: x, y (null for a star), ext, via (of a point that is only one)."""
    cut = _clauses(scanned, section)
    lead = F.lit(4 if section == "SPECIALNETS" else 3)
    tokens = F.regexp_extract_all(F.array_join(F.slice("c", lead, F.greatest(F.size("c") - lead + 1, F.lit(0))), " "), F.lit(r"(\( [^)]* \)|[^\s()]+)"), F.lit(1))

    def spot(t: Column) -> Column:
        w = F.split(F.trim(F.translate(t, "()", "  ")), " ")
        whole = lambda i: F.when(F.get(w, F.lit(i)) != "*", F.get(w, F.lit(i)).cast("int"))
        inside = t.startswith("(")
        return F.struct(F.when(inside, whole(0)).alias("x"), F.when(inside, whole(1)).alias("y"), F.when(inside, whole(2)).alias("ext"), F.when(~inside, t).alias("via"))

    return cut.select("file", "seq", "net", "wire", F.transform(tokens, spot).alias("spots"))


def vias(scanned: DataFrame) -> DataFrame:
    """file, block, seq, via, rects (layer, x1, y1, x2, y2)."""
    rects = F.filter(F.slice("clauses", F.lit(2), F.greatest(F.size("clauses") - 1, F.lit(0))), lambda c: F.get(c, F.lit(0)) == "RECT")

    def rect(c: Column) -> Column:
        p = _spots(c)
        return F.struct(_at(c, 1).alias("layer"), *(F.get(p, F.lit(i))[k].alias(f"{k}{i + 1}") for i in (0, 1) for k in "xy"))

    return _named(scanned, "VIAS").select("file", "block", "seq", word(1).alias("via"), F.transform(rects, rect).alias("rects"))


def numbered_layers(wire: DataFrame, mapping: DataFrame) -> DataFrame:
    """Wires with the number that mapping (layer_name, layer) gives their layer, whatever the case of its letters. A missing layer, a number below 1 and one that two names share raise."""
    used = F.lower("layer_name")
    known = mapping.select(used.alias("key"), must(F.col("layer") > 0, F.concat(F.lit("DEF: no layer number: "), F.col("layer").cast("string")), F.col("layer")).alias("layer")).distinct()
    asked = wire.select(used.alias("key")).distinct().join(known, "key")
    double = asked.groupBy("layer").agg(F.count("*").alias("n")).where("n > 1").agg(F.max("layer").alias("bad"))
    joined = wire.withColumn("key", used).join(F.broadcast(known), "key", "left").crossJoin(F.broadcast(double))  # double is one row
    found = must(F.col("bad").isNull(), F.concat(F.lit("DEF: two layers share the number "), F.col("bad").cast("string")), F.col("layer"))
    return joined.withColumn("layer", must(F.col("layer").isNotNull(), F.concat(F.lit("DEF: no number for layer "), F.col("layer_name")), found)).drop("key", "bad")


def elements(scanned: DataFrame, mapping: DataFrame) -> DataFrame:
    """Elements of each design's cell: die boundary (layer 0), components, net wires, special-net wires, pin texts, with elem_order (a struct in that order)."""
    blank = {"layer": "int", "points": "array<struct<x:int,y:int>>", "width": "int", "ref_cell": "string", "origin": "struct<x:int,y:int>", "mirror": "boolean", "angle": "double", "text": "string", "name": "string"}

    def part(df: DataFrame, rank: int, kind: str, **have: Column) -> DataFrame:
        at = {"seq": PLACE, "wire": "int"}
        order = F.struct(F.lit(rank).alias("rank"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in at.items()))
        return df.select("file", order.alias("elem_order"), F.lit(kind).alias("kind"), *(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in blank.items()))

    spot = F.struct(F.col("x"), F.col("y"))
    turn = transform_of(F.coalesce("orientation", F.lit("N")))
    out = part(design(scanned).where("die is not null"), 0, "boundary", layer=F.lit(0), points=die_ring(F.col("die")))
    out = out.unionByName(part(components(scanned), 1, "cellRef", ref_cell=F.col("macro"), origin=spot, mirror=turn["mirror"], angle=turn["angle"], name=F.col("component")))
    for rank, section in ((2, "NETS"), (3, "SPECIALNETS")):
        out = out.unionByName(part(numbered_layers(wires(scanned, section), mapping), rank, "path", layer=F.col("layer"), points=F.col("points"), width=F.col("width"), name=F.col("net")))
    return out.unionByName(part(pins(scanned), 4, "text", layer=F.lit(0), origin=spot, text=F.col("pin"), name=F.col("net")))


def cells(scanned: DataFrame) -> DataFrame:
    """file, cell_idx, cell: the design, then an empty cell for each macro in order of first use."""
    tops = design(scanned).select("file", F.when(F.col("design") == "", "TOP").otherwise(F.col("design")).alias("top"))
    used = components(scanned).where("macro <> ''").groupBy("file", "macro").agg(F.min("seq").alias("first")).join(tops, "file").where("macro <> top")
    order = F.row_number().over(Window.partitionBy("file").orderBy("first"))
    return tops.select("file", F.lit(0).alias("cell_idx"), F.col("top").alias("cell")).unionByName(used.select("file", order.alias("cell_idx"), F.col("macro").alias("cell")))


def document(element: DataFrame) -> dict[str, DataFrame]:
    """The way back: die, components, wires and pins of cell elements (columns of `elements`)."""
    return {
        "die": element.where("kind = 'boundary' and layer = 0").groupBy("file").agg(F.min_by("points", "elem_order").alias("points")),
        "components": element.where("kind = 'cellRef'").select("file", "elem_order", F.coalesce("name", "ref_cell").alias("component"), F.col("ref_cell").alias("macro"), F.col("origin.x").alias("x"), F.col("origin.y").alias("y"), orientation_of(F.col("mirror"), F.col("angle")).alias("orientation")),
        "wires": element.where("kind = 'path'").select("file", "elem_order", F.col("name").alias("net"), "layer", "width", "points"),
        "pins": element.where("kind = 'text'").select("file", "elem_order", F.col("text").alias("pin"), F.col("name").alias("net"), F.col("origin.x").alias("x"), F.col("origin.y").alias("y")),
    }


def write_texts(designs: DataFrame, element: DataFrame, scale: float, layer_name: str = "LAYER_") -> DataFrame:
    """file, text of designs (file, design) and their elements; counts are written, empty sections are not. Wires are written net by net."""
    doc = document(element)
    listed = lambda df, line, order="elem_order": df.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "").alias("body"), F.count("*").cast("string").alias("n"))
    s = lambda c: F.col(c).cast("string")
    spots = lambda p: F.array_join(F.transform(p, lambda q: F.concat(F.lit("( "), q["x"].cast("string"), F.lit(" "), q["y"].cast("string"), F.lit(" )"))), " ")
    comp = F.concat_ws(" ", F.lit("-"), F.col("component"), F.col("macro"), F.lit("+ PLACED ("), s("x"), s("y"), F.lit(")"), F.col("orientation"), F.lit(";\n"))
    pin = F.concat_ws(" ", F.lit("-"), F.col("pin"), F.when(F.col("net").isNotNull(), F.concat(F.lit("+ NET "), F.col("net"))), F.lit("+ PLACED ("), s("x"), s("y"), F.lit(") N ;\n"))
    wire = F.concat(F.lit(" "), F.lit(layer_name), s("layer"), F.lit(" "), spots(F.col("points")))
    nets = doc["wires"].groupBy("file", "net").agg(F.min("elem_order").alias("elem_order"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("elem_order", wire.alias("w")))), lambda x, i: F.concat(F.when(i == 0, "+ ROUTED").otherwise("+ NEW"), x["w"])), " ").alias("route"))
    parts = {"COMPONENTS": listed(doc["components"], comp), "PINS": listed(doc["pins"], pin), "NETS": listed(nets, F.concat_ws(" ", F.lit("-"), F.col("net"), F.col("route"), F.lit(";\n")))}
    out = designs.join(doc["die"], "file", "left").withColumn("text", F.concat(F.lit("VERSION 5.8 ;\nDESIGN "), F.col("design"), F.lit(f" ;\nUNITS DISTANCE MICRONS {scale:g} ;\n"), F.coalesce(F.concat(F.lit("DIEAREA "), spots(F.slice("points", F.lit(1), F.size("points") - 1)), F.lit(" ;\n")), F.lit(""))))
    for name, rows_of in parts.items():
        out = out.join(rows_of, "file", "left").withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit(f"{name} "), F.col("n"), F.lit(" ;\n"), F.col("body"), F.lit(f"END {name}\n")), F.lit("")))).drop("body", "n")
    return out.select("file", F.concat("text", F.lit("END DESIGN\n")).alias("text"))
