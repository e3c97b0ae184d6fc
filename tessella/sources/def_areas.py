"""Areas of a DEF design as tables, and their lines: blockages, fills, regions, groups and the grid of global routing cells.

Each reader takes statements from `def_.scan` and gives a row an entry, in file order by (file, seq). Key words count in any case; of a repeated clause the last
counts, words that aren't known are passed over. A bracket of a blockage, fill or region that doesn't hold two whole numbers raises, as does a rectangle without
its second corner. White space within a property's quotes is one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.curves import point
from tessella.operators.sequences import must
from tessella.sources.lef import rest, word

#: Sections in the order in which they are written, and kinds of region.
AREAS = ("BLOCKAGES", "REGIONS", "FILLS", "GROUPS")
KINDS = ("FENCE", "GUIDE")
_SPOT = r"\( -?\d+ -?\d+ \)"


def _entries(scanned: DataFrame, section: str) -> DataFrame:
    """file, block, seq, words, clauses, and said: all after the dash, with a space before."""
    own = scanned.where((F.col("section") == section) & (word(0) == "-"))
    return own.select("file", "block", "seq", "words", "clauses", F.concat(F.lit(" "), F.array_join(rest("words"), " ")).alias("said"))


def _last(key: str) -> Column:
    """The words of the last clause that starts with key."""
    return F.try_element_at(F.filter(rest("clauses"), lambda c: F.upper(F.get(c, F.lit(0))) == key), F.lit(-1))


def _spots(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\( (-?\d+ -?\d+) \)"), F.lit(1))
    return F.transform(found, lambda s: point(F.split(s, " ")[0].cast("int"), F.split(s, " ")[1].cast("int")))


def _rects(spots: Column) -> Column:
    """Boxes from points that are corners by turns. The points are a variable, else they would be read from the text anew for each box."""
    corner = lambda p, i: F.get(p, i)
    boxes = lambda p: F.transform(F.filter(p, lambda _, i: i % 2 == 0), lambda a, i: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), corner(p, 2 * i + 1)["x"].alias("x2"), corner(p, 2 * i + 1)["y"].alias("y2")))
    return F.get(F.transform(F.array(spots), boxes), F.lit(0))


def _drawn() -> list[Column]:
    """rects and polygons of an entry."""
    said = F.col("said")
    complete = ~said.rlike(rf"\((?! -?\d+ -?\d+ \))|(?i) RECT (?!{_SPOT} {_SPOT})")
    boxes = F.regexp_extract_all(said, F.lit(rf"(?i) RECT ({_SPOT} {_SPOT})"), F.lit(1))
    rings = F.regexp_extract_all(said, F.lit(rf"(?i) POLYGON((?: {_SPOT})+)"), F.lit(1))
    return [must(complete, F.concat(F.lit("DEF: not a shape:"), said), _rects(_spots(F.array_join(boxes, " ")))).alias("rects"), F.transform(rings, _spots).alias("polygons")]


def blockages(scanned: DataFrame) -> DataFrame:
    """file, block, seq, type (ROUTING, else PLACEMENT), layer_name, component, pushdown, rects, polygons."""
    kind = F.when(F.upper(word(1)) == "ROUTING", "ROUTING").otherwise("PLACEMENT")
    said = [F.get(_last(k), F.lit(1)).alias(n) for k, n in (("LAYER", "layer_name"), ("COMPONENT", "component"))]
    return _entries(scanned, "BLOCKAGES").select("file", "block", "seq", kind.alias("type"), *said, _last("PUSHDOWN").isNotNull().alias("pushdown"), *_drawn())


def fills(scanned: DataFrame) -> DataFrame:
    """file, block, seq, layer_name ('' where none stands first), opc, rects, polygons."""
    layer = F.when(F.upper(word(1)) == "LAYER", word(2)).otherwise("")
    return _entries(scanned, "FILLS").select("file", "block", "seq", layer.alias("layer_name"), _last("OPC").isNotNull().alias("opc"), *_drawn())


def regions(scanned: DataFrame) -> DataFrame:
    """file, block, seq, region, type (FENCE, GUIDE or null), rects."""
    spots = _spots(F.col("said"))
    complete = ~F.col("said").rlike(r"\((?! -?\d+ -?\d+ \))") & (F.size(spots) % 2 == 0)
    kind = F.upper(F.get(_last("TYPE"), F.lit(1)))
    rects = must(complete, F.concat(F.lit("DEF: not a region:"), F.col("said")), _rects(spots))
    return _entries(scanned, "REGIONS").select("file", "block", "seq", word(1).alias("region"), F.when(kind.isin(*KINDS), kind).alias("type"), rects.alias("rects"))


def groups(scanned: DataFrame) -> DataFrame:
    """file, block, seq, group, components, region, properties (key, value)."""
    named = F.get("clauses", F.lit(0))
    members = F.slice(named, F.lit(3), F.greatest(F.size(named) - 2, F.lit(0)))
    said = F.try_element_at(F.regexp_extract_all("said", F.lit(r'(?i) \+ PROPERTY((?: [^\s"+]\S* (?:"[^"]*"|[^\s"]+))+)'), F.lit(1)), F.lit(-1))
    pairs = F.regexp_extract_all(said, F.lit(r'(\S+ (?:"[^"]*"|\S+))'), F.lit(1))
    properties = F.transform(pairs, lambda p: F.struct(F.substring_index(p, " ", 1).alias("key"), F.replace(F.regexp_replace(p, r"^\S+ ", ""), F.lit('"'), F.lit("")).alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return _entries(scanned, "GROUPS").select("file", "block", "seq", word(1).alias("group"), members.alias("components"), F.get(_last("REGION"), F.lit(1)).alias("region"), F.coalesce(properties, empty).alias("properties"))


def gcell_grids(scanned: DataFrame) -> DataFrame:
    """file, block, seq, axis, start, count, step; one whose axis isn't X or Y is passed over, a missing number raises."""
    axis = F.upper(word(1))
    numbers = F.filter(F.slice("words", F.lit(3), F.greatest(F.size("words") - 2, F.lit(0))), lambda w: ~F.upper(w).isin("DO", "STEP"))
    number = lambda i: must(F.size(numbers) >= 3, "DEF: a cell grid needs its start, count and step", F.get(numbers, F.lit(i)).cast("int"))
    own = scanned.where((F.col("section") == "") & (F.upper(word(0)) == "GCELLGRID") & axis.isin("X", "Y"))
    return own.select("file", "block", "seq", axis.alias("axis"), *(number(i).alias(n) for i, n in enumerate(("start", "count", "step"))))


# ---- the way back ---------------------------------------------------------------------------------------------


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _clause(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), _text(f" + {key} ", value))


def _corners(rect: Column) -> Column:
    return _text("( ", rect["x1"], " ", rect["y1"], " ) ( ", rect["x2"], " ", rect["y2"], " )")


def _shapes() -> Column:
    ring = lambda p: F.array_join(F.transform(p, lambda q: _text(" ( ", q["x"], " ", q["y"], " )")), "")
    return _text(F.array_join(F.transform("rects", lambda r: _text(" RECT ", _corners(r))), ""), F.array_join(F.transform("polygons", lambda p: _text(" POLYGON", ring(p))), ""))


def lines(gcells: DataFrame, blocked: DataFrame, region: DataFrame, fill: DataFrame, group: DataFrame) -> DataFrame:
    """file, place, line of the tables that the readers give: ordered lines, so that a file of any size is written by many tasks. Sections without entries aren't written."""
    c = F.col
    body = {
        "BLOCKAGES": (blocked, _text(c("type"), _clause("LAYER", c("layer_name")), _clause("COMPONENT", c("component")), F.when(c("pushdown"), " + PUSHDOWN"), _shapes())),
        "REGIONS": (region, _text(c("region"), F.array_join(F.transform("rects", lambda r: _text(" ", _corners(r))), ""), _clause("TYPE", c("type")))),
        "FILLS": (fill, _text(F.when(c("layer_name") != "", _text("LAYER ", c("layer_name"))), F.when(c("opc"), " + OPC"), _shapes())),
        "GROUPS": (group, _text(c("group"), F.array_join(F.transform("components", lambda n: _text(" ", n)), ""), _clause("REGION", c("region")), F.when(F.size("properties") > 0, _text(" + PROPERTY", F.array_join(F.transform("properties", lambda p: _text(" ", p["key"], ' "', p["value"], '"')), ""))))),
    }
    place = lambda rank, seq=None: F.struct(F.lit(rank).alias("rank"), (F.lit(None) if seq is None else c(seq)).cast("struct<block:bigint,seq:bigint,part:int>").alias("seq")).alias("place")
    out = gcells.select("file", place(0, "seq"), _text("GCELLGRID ", c("axis"), " ", c("start"), " DO ", c("count"), " STEP ", c("step"), " ;").alias("line"))
    for k, name in enumerate(AREAS):
        rows, line = body[name]
        out = out.unionByName(rows.select("file", place(3 * k + 2, "seq"), _text("- ", line, " ;").alias("line")))
        counted = rows.groupBy("file").agg(F.count("*").alias("n"))
        out = out.unionByName(counted.select("file", place(3 * k + 1), _text(f"{name} ", c("n"), " ;").alias("line"))).unionByName(counted.select("file", place(3 * k + 3), F.lit(f"END {name}").alias("line")))
    return out
