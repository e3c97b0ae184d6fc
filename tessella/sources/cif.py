"""CIF as relational steps: commands in file order, cell, scale and layer carried forward, geometry in expressions; and the way back.

Commands: DS, DF, L, B, W, P, C, 9, E; any other raises. Coordinates are scaled and truncated toward zero. `DS id n` scales by 1/n, `DS id a b` by a/b.
Transforms of a call don't compose: T overwrites, angles add, M X is a mirror with half a turn, M Y a mirror. Named layers get the numbers
that no numeric layer of the file uses, in order of first use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sequences import must, running
from tessella.plans.session import materialise
from tessella.sources.lef import rest

KNOWN = ("DS", "DF", "L", "B", "W", "P", "C", "9", "E")
ELEMENT = "file string, cell string, block bigint, seq bigint, kind string, layer int, points array<struct<x:int,y:int>>, width int, ref_cell string, origin struct<x:int,y:int>, mirror boolean, angle double, text string"


def commands(statements: DataFrame) -> DataFrame:
    """file, block, seq, command, args (tokens after it). Comments, in brackets, are space, also where they hold a semicolon; empty commands are left out."""
    count = lambda mark: F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))
    opened = running(statements, {"depth": F.coalesce(count("(") - count(")"), F.lit(0))})
    began = F.when(F.col("depth") - (count("(") - count(")")) > 0, F.regexp_replace("text", r"^[^)]*(\)|$)", " ")).otherwise(F.col("text"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(began, r"\([^)]*(\)|$)", " "), r"\s+", " "))
    parts = opened.select("file", "block", "seq", F.split(bare, " ").alias("p")).where("p[0] <> ''")
    name = must(F.col("p")[0].isin(*KNOWN), F.concat(F.lit("CIF: unsupported command "), F.col("p")[0]), F.col("p")[0])
    return parts.select("file", "block", "seq", name.alias("command"), rest("p").alias("args"))


def _scaled(value: Column) -> Column:
    """A token in database units: scaled, cut toward zero; out of 32 bits raises."""
    return (value.cast("double") * F.col("scale")).cast("int")


def _points(tokens: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(tokens) / 2).cast("int") - 1), lambda i: F.struct(_scaled(F.get(tokens, 2 * i)).alias("x"), _scaled(F.get(tokens, 2 * i + 1)).alias("y")))


def _box(args: Column) -> Column:
    """Corners of a box around its centre, turned to its direction vector, rounded half away from zero."""
    half = [_scaled(args[i]).cast("double") / 2 for i in (0, 1)]
    centre = [_scaled(args[i]).cast("double") for i in (2, 3)]
    turned = F.size(args) == 6
    dx, dy = (F.when(turned, F.get(args, F.lit(i)).cast("double")).otherwise(F.lit(float(5 - i))) for i in (4, 5))
    size = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / size, dy / size

    def corner(a: int, b: int) -> Column:
        x = centre[0] + a * half[0] * ux - b * half[1] * uy
        y = centre[1] + a * half[0] * uy + b * half[1] * ux
        return F.struct(F.round(x).cast("int").alias("x"), F.round(y).cast("int").alias("y"))

    return F.array(*(corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))


def _call(args: Column) -> Column:
    """Struct x, y, mirror, angle of a call's transforms, read from left to right."""
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("mirror"), F.lit(0.0).alias("angle"), F.lit(1).alias("next"))

    def step(s: Column, i: Column) -> Column:
        word, one, two = (F.get(args, s["next"] + k) for k in range(3))
        moved = F.struct(_scaled(one).alias("x"), _scaled(two).alias("y"), s["mirror"].alias("mirror"), s["angle"].alias("angle"), (s["next"] + 3).alias("next"))
        turned = F.struct(s["x"].alias("x"), s["y"].alias("y"), s["mirror"].alias("mirror"), (s["angle"] + F.degrees(F.atan2(two.cast("double"), one.cast("double")))).alias("angle"), (s["next"] + 3).alias("next"))
        mirrored = F.struct(s["x"].alias("x"), s["y"].alias("y"), F.lit(True).alias("mirror"), (s["angle"] + F.when(one == "X", 180.0).otherwise(0.0)).alias("angle"), (s["next"] + 2).alias("next"))
        return F.when(word == "T", moved).when(word == "R", turned).when((word == "M") & one.isin("X", "Y"), mirrored).when(word.isNull(), s).otherwise(F.raise_error(F.concat(F.lit("CIF: unsupported transform "), word)))

    return F.aggregate(F.sequence(F.lit(0), F.size(args)), start, step)


def elements(statements: DataFrame) -> DataFrame:
    """Elements of all cells: file, cell, block, seq, kind (boundary, path, text, cellRef), layer and what the kind has. Cell references are resolved to names."""
    c = commands(statements)
    name = lambda code: F.col("command") == code
    one = F.get("args", F.lit(0))
    number, under = F.get("args", F.lit(1)).cast("double"), F.get("args", F.lit(2)).cast("double")
    scale = F.when(name("DS"), F.when(F.size("args") == 3, number / under).otherwise(1 / number))
    counts = {"opened": name("DS").cast("int"), "closed": name("DF").cast("int"), "ended": F.when(name("E"), 1).otherwise(0)}
    modal = {"cell_id": F.when(name("DS"), one.cast("long")), "scale": scale, "label": F.when(name("L"), one)}
    state = running(c, counts, modal, reset=name("DS")).withColumn("label", F.coalesce("label", F.lit("0")))  # a cell starts on layer 0
    inside = F.col("opened") - F.col("closed") == F.when(name("DF") | name("E"), 0).otherwise(1)
    proper = materialise(state.withColumn("command", must(inside & ((F.col("ended") == 0) | name("E")), F.concat(F.lit("CIF: command out of place: "), F.col("command")), F.col("command"))), "cif-commands")
    names = cell_names(proper)
    body = proper.where("command in ('B', 'W', 'P', 'C') or command = '9' and size(args) = 3").join(names, ["file", "cell_id"], "left").join(layers(proper), ["file", "label"], "left")
    is_box, is_wire, is_ring, is_call = (F.col("command") == x for x in "BWPC")
    ring = _points(F.col("args"))
    closed = F.when(F.get(ring, F.lit(0)) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    call = _call(F.col("args"))
    out = body.select(
        "file", "cell", "block", "seq",
        F.when(is_box | is_ring, "boundary").when(is_wire, "path").when(is_call, "cellRef").otherwise("text").alias("kind"),
        F.when(~is_call, F.col("layer")).alias("layer"),
        F.when(is_box, _box(F.col("args"))).when(is_ring, closed).when(is_wire, _points(rest("args"))).alias("points"),
        F.when(is_wire, _scaled(one)).alias("width"),
        F.when(is_call, one.cast("long")).alias("ref_id"),
        F.when(is_call, call).alias("call"),
        F.when(F.col("command") == "9", F.struct(_scaled(F.get("args", F.lit(1))).alias("x"), _scaled(F.get("args", F.lit(2))).alias("y"))).alias("position"),
        F.when(F.col("command") == "9", one).alias("text"),
    )
    target = names.select("file", F.col("cell_id").alias("ref_id"), F.col("cell").alias("ref_cell"))
    resolved = resolve(out, target, ["file", "ref_id"], "ref_cell", "CIF: unresolved cell reference ")
    origin = F.when(F.col("kind") == "cellRef", F.struct(F.col("call.x").alias("x"), F.col("call.y").alias("y"))).otherwise(F.col("position"))
    return resolved.select("file", "cell", "block", "seq", "kind", "layer", "points", "width", "ref_cell", origin.alias("origin"), F.col("call.mirror").alias("mirror"), F.col("call.angle").alias("angle"), "text")


def resolve(rows: DataFrame, names: DataFrame, keys: list[str], column: str, message: str) -> DataFrame:
    """rows with the column that names has for their keys; a key that isn't null and has no row there raises."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"r.{k}") == F.col(f"n.{k}"))
    found = rows.alias("r").join(names.alias("n"), cond, "left")
    key = F.col(f"r.{keys[-1]}")
    checked = must(key.isNull() | F.col(f"n.{column}").isNotNull(), F.concat(F.lit(message), key.cast("string")), F.col(f"n.{column}"))
    return found.select("r.*", checked.alias(column))


def cell_names(state: DataFrame) -> DataFrame:
    """file, cell_id, cell: the name that a cell's 9 command gives, else CELL_id. A cell_id defined twice raises."""
    defined = state.where("command = 'DS'").groupBy("file", "cell_id").agg(F.count("*").alias("n"))
    named = state.where("command = '9' and size(args) = 1").groupBy("file", "cell_id").agg(F.max(F.col("args")[0]).alias("name"), F.count("*").alias("names"))
    joined = defined.join(named, ["file", "cell_id"], "left")
    name = F.coalesce("name", F.concat(F.lit("CELL_"), F.col("cell_id").cast("string")))
    once = (F.col("n") == 1) & (F.coalesce("names", F.lit(1)) == 1)
    return joined.select("file", "cell_id", must(once, F.concat(F.lit("CIF: cell defined or named twice: "), F.col("cell_id").cast("string")), name).alias("cell"))


def layers(state: DataFrame) -> DataFrame:
    """file, label, layer: numeric labels are their own number; others get the free numbers from 1 in order of first use. A file has few layers."""
    used = state.where("label is not null").groupBy("file", "label").agg(F.min(F.struct("block", "seq")).alias("first")).withColumn("number", F.expr("try_cast(label as smallint)").cast("int"))
    line = Window.partitionBy("file").orderBy("first")
    named = used.where("number is null").withColumn("nth", F.row_number().over(line))
    taken = used.where("number > 0").groupBy("file").agg(F.sort_array(F.collect_set("number")).alias("taken"))
    # the nth free number: each number taken at or below it moves it up by one
    free = F.expr("aggregate(coalesce(taken, cast(array() as array<int>)), nth, (n, t) -> if(t <= n, n + 1, n))")
    return used.where("number is not null").select("file", "label", F.col("number").alias("layer")).unionByName(named.join(taken, "file", "left").select("file", "label", free.cast("int").alias("layer")))


# ---- the way back ---------------------------------------------------------------------------------------------


def _ring_text(ring: Column, scale: int) -> Column:
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", (p["x"].cast("long") * scale).cast("string"), (p["y"].cast("long") * scale).cast("string"))), " ")


def element_lines(element: DataFrame, scale: int = 1) -> DataFrame:
    """The command line of every element. A rectangle with even sides is a box; layers other than datatype 0, arrays, magnification, angles between octants
    and names with space or punctuation can't be written and raise."""
    ring = F.when(F.get("points", F.lit(0)) == F.element_at("points", -1), F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points"))
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    lo_x, hi_x, lo_y, hi_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    w, h = hi_x.cast("long") - lo_x, hi_y.cast("long") - lo_y
    corners = F.size(F.array_distinct(ring)) == 4
    box = (F.size(ring) == 4) & corners & F.forall(ring, lambda p: p["x"].isin(lo_x, hi_x) & p["y"].isin(lo_y, hi_y)) & (w > 0) & (h > 0) & (w % 2 == 0) & (h % 2 == 0)
    number = lambda c: (c * scale).cast("string")
    as_box = F.concat_ws(" ", F.lit("B"), number(w), number(h), number((lo_x.cast("long") + hi_x) / 2).cast("double").cast("long").cast("string"), number((lo_y.cast("long") + hi_y) / 2).cast("double").cast("long").cast("string"))
    as_ring = must(F.size(ring) >= 3, "CIF: a boundary has fewer than three vertices", F.concat(F.lit("P "), _ring_text(ring, scale)))
    wire = F.concat_ws(" ", F.lit("W"), number(F.col("width").cast("long")), _ring_text(F.col("points"), scale))
    plain = ~F.col("text").rlike(r"[\s;()]") & (F.col("text") != "")
    text = must(plain, "CIF: a text can't be written", F.concat_ws(" ", F.lit("9"), F.col("text"), number(F.col("origin.x").cast("long")), number(F.col("origin.y").cast("long"))))
    octant = F.round(F.col("angle") / 45)
    vectors = F.array(*(F.lit(x) for x in ("1 0", "1 1", "0 1", "-1 1", "-1 0", "-1 -1", "0 -1", "1 -1")))
    turn = F.when(F.col("angle") == 0, "").otherwise(must(F.abs(F.col("angle") - octant * 45) < 1e-12, "CIF: an angle is between octants", F.concat(F.lit(" R "), F.get(vectors, F.pmod(octant, F.lit(8)).cast("int")))))
    move = F.when((F.col("origin.x") == 0) & (F.col("origin.y") == 0), "").otherwise(F.concat(F.lit(" T "), number(F.col("origin.x").cast("long")), F.lit(" "), number(F.col("origin.y").cast("long"))))
    call = F.concat(F.lit("C "), F.col("ref_id").cast("string"), F.when(F.col("mirror"), " M Y").otherwise(""), turn, move)
    line = F.when(F.col("kind") == "boundary", F.when(box, as_box).otherwise(as_ring)).when(F.col("kind") == "path", wire).when(F.col("kind") == "text", text).when(F.col("kind") == "cellRef", call).otherwise(F.raise_error(F.concat(F.lit("CIF: can't write "), F.col("kind"))))
    return element.select("*", line.alias("line"))


def write_texts(cells: DataFrame, element: DataFrame, scale: int = 1) -> DataFrame:
    """file, text of each library from cells (file, cell_idx, cell) and elements (file, cell_idx, elem_idx and the columns of `elements`).

    A cell's number is its place. The lines of one cell are put together first, then the cells of a file.
    """
    called = cells.select("file", F.col("cell").alias("ref_cell"), (F.col("cell_idx") + 1).alias("ref_id"))
    lines = element_lines(resolve(element, called, ["file", "ref_cell"], "ref_id", "CIF: unresolved cell reference "), scale)
    order = Window.partitionBy("file", "cell_idx").orderBy("elem_idx")
    layer = F.last(F.when(F.col("kind") != "cellRef", F.col("layer")), ignorenulls=True)
    switched = (F.col("kind") != "cellRef") & ~F.col("layer").eqNullSafe(layer.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    put = lines.withColumn("line", F.concat(F.when(switched, F.concat(F.lit("L "), F.col("layer").cast("string"), F.lit(";\n"))).otherwise(""), F.col("line"), F.lit(";")))
    body = put.groupBy("file", "cell_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("elem_idx", "line"))), lambda x: x["line"]), "\n").alias("body"))
    fine = ~F.col("cell").rlike(r"[\s;()]") & (F.col("cell") != "")
    head = must(fine, "CIF: a cell name can't be written", F.concat(F.lit("DS "), (F.col("cell_idx") + 1).cast("string"), F.lit(f" {scale};\n9 "), F.col("cell"), F.lit(";\n")))
    whole = cells.join(body, ["file", "cell_idx"], "left").select("file", "cell_idx", F.concat(head, F.when(F.col("body").isNull(), "").otherwise(F.concat("body", F.lit("\n"))), F.lit("DF;\n")).alias("part"))
    return whole.groupBy("file").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_idx", "part"))), lambda x: x["part"]), ""), F.lit("E\n")).alias("text"))
