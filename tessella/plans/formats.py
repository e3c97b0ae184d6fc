"""Queries over formats, curves, rule dispatch and the wire grids: shapes written as text and read back, each with independent SQL on the shapes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import codes, compact, curves, rings
from tessella.functions import points as P
from tessella.operators import hierarchy, rules, sequences, sizing
from tessella.plans import grids
from tessella.plans.queries import BOX_AREA, GROW, WIDTH, K, bands_sql, edge_distance_sql, query, ring_sql, sweep_sql
from tessella.plans.session import materialise
from tessella.plans.shapes import KEYS, SHAPES_SQL, numbered, polygons, shapes
from tessella.sources import cif, def_, def_areas, def_back, dxf, dxf_check, lef, sniff, technology

SCALE = 1024.0  # units a micron: a power of two, so that no truncation differs


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(shapes(spark, sf_dir))


def _cells(s: DataFrame) -> DataFrame:
    """Every cell_id is a file of one cell."""
    return s.select(F.col("cell_id").cast("string").alias("file"), F.lit(0).alias("cell_idx"), F.concat(F.lit("C"), F.col("cell_id").cast("string")).alias("cell")).distinct()


def _boundaries(s: DataFrame, kind: str = "box") -> DataFrame:
    p = polygons(s, kind)
    return p.select(F.col("cell_id").cast("string").alias("file"), F.lit(0).alias("cell_idx"), F.concat(F.lit("C"), F.col("cell_id").cast("string")).alias("cell"), (F.col("layer") * (1 << 40) + F.col("poly_idx")).alias("elem_idx"), F.lit("boundary").alias("kind"), F.col("layer").cast("int").alias("layer"), "points")


def _extra(df: DataFrame) -> DataFrame:
    """Columns of elements that boundaries don't use."""
    kinds = {"width": "int", "ref_cell": "string", "origin": "struct<x:int,y:int>", "mirror": "boolean", "magnification": "double", "angle": "double", "columns": "int", "rows": "int", "text": "string"}
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))


def _boxes(df: DataFrame) -> DataFrame:
    b = df.select(F.col("file").cast("long").alias("cell_id"), F.col("layer").cast("long").alias("layer"), rings.measured(F.col("points").cast(rings.POINTS)).alias("b"))
    return b.select("cell_id", "layer", *(f"b.{c}" for c in ("x1", "y1", "x2", "y2", "area")))


_BOX_SQL = f"WITH {SHAPES_SQL} SELECT {K}, x1, y1, x2, y2, {BOX_AREA} AS area FROM shapes"


@query(_BOX_SQL)
def cif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes and, where a side is odd, polygons."""
    s = _numbered(spark, sf_dir)
    text = materialise(cif.write_texts(_cells(s), _extra(_boundaries(s))), "cif")
    return _boxes(cif.elements(sequences.statements_of(text, ";")))


_ELL_AREA = f"({BOX_AREA} - (x2 - (x1 + x2) // 2) * (y2 - (y1 + y2) // 2))"


@query(f"WITH {SHAPES_SQL} SELECT {K}, x1, y1, x2, y2, {_ELL_AREA} AS area FROM shapes")
def dxf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _numbered(spark, sf_dir)
    text = materialise(dxf.write_texts(_cells(s), _extra(_boundaries(s, "ell")), 1), "dxf")  # six decimals are written: one unit a micron
    return _boxes(dxf.elements(dxf.entities(dxf.groups(text)), 1))


@query(f"WITH {SHAPES_SQL} SELECT cell_id, dense_rank() OVER (PARTITION BY cell_id ORDER BY layer) AS layer, x1, y1, x2, y2, {BOX_AREA} AS area FROM shapes")
def lef_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes as obstructions; layers are numbered by their order in the file."""
    s = _numbered(spark, sf_dir)
    text = materialise(lef.write_texts(_cells(s), _boundaries(s, "ell"), SCALE), "lef")
    return _boxes(lef.elements(lef.scan(sequences.statements_of(text, ";"))))


@query(f"WITH {SHAPES_SQL} SELECT cell_id, 'M' || layer AS macro, x1 AS x, y1 AS y, x1 % 2 = 1 AS mirror, CAST(y1 % 4 * 90 AS DOUBLE) AS angle, count(*) AS placed FROM shapes GROUP BY ALL")
def def_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components written with their orientation and read back as transforms."""
    s = _numbered(spark, sf_dir)
    part = s.select(F.col("cell_id").cast("string").alias("file"), F.struct((F.col("layer") * (1 << 40) + F.col("poly_idx")).alias("seq")).alias("elem_order"), F.lit("cellRef").alias("kind"), F.lit(None).cast("int").alias("layer"), F.lit(None).cast("array<struct<x:int,y:int>>").alias("points"), F.lit(None).cast("int").alias("width"), F.concat(F.lit("M"), F.col("layer").cast("string")).alias("ref_cell"), F.struct(F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y")).alias("origin"), (F.col("x1") % 2 == 1).alias("mirror"), (F.col("y1") % 4 * 90).cast("double").alias("angle"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("u"), F.col("poly_idx").cast("string")).alias("name"))
    designs = s.select(F.col("cell_id").cast("string").alias("file"), F.lit("chip").alias("design")).distinct()
    text = materialise(def_.write_texts(designs, part, SCALE), "def")
    read = def_.components(def_.scan(sequences.statements_of(text, ";")))
    turn = codes.transform_of(F.col("orientation"))
    return read.groupBy(F.col("file").cast("long").alias("cell_id"), "macro", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), turn["mirror"].alias("mirror"), turn["angle"].alias("angle")).agg(F.count("*").alias("placed"))


@query(f"WITH {SHAPES_SQL} SELECT cell_id, 'n' || layer AS net, x1, y1, x2, y2, count(*) AS wires FROM shapes GROUP BY ALL")
def def_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of bent wires, each written with a star for the coordinate that stays, resolved on reading."""
    s = shapes(spark, sf_dir)
    wire = F.concat(F.lit("M ( "), F.col("x1").cast("string"), F.lit(" "), F.col("y1").cast("string"), F.lit(" ) ( "), F.col("x2").cast("string"), F.lit(" * ) ( * "), F.col("y2").cast("string"), F.lit(" )"))
    nets = s.groupBy("cell_id", "layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list(wire)), lambda w, i: F.concat(F.when(i == 0, "+ ROUTED ").otherwise("+ NEW "), w)), " ").alias("route"))
    body = F.concat(F.lit("- n"), F.col("layer").cast("string"), F.lit(" "), F.col("route"), F.lit(" ;"))
    text = nets.groupBy(F.col("cell_id").cast("string").alias("file")).agg(F.concat(F.lit("NETS 1 ;\n"), F.array_join(F.collect_list(body), "\n"), F.lit("\nEND NETS\n")).alias("text"))
    read = def_.wires(def_.scan(sequences.statements_of(text, ";")))
    at = lambda i, c: F.get("points", F.lit(i))[c].cast("long")
    return read.groupBy(F.col("file").cast("long").alias("cell_id"), "net", at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(2, "x").alias("x2"), at(2, "y").alias("y2")).agg(F.count("*").alias("wires"))


_ROUND = 0.7317  # microns to units, so that no point but a circle's start lies on a whole number


@query(f"WITH {SHAPES_SQL}, c AS (SELECT DISTINCT cell_id, x1, y1, x2 - x1 AS r FROM shapes), p AS (SELECT c.*, unnest(range(0, 65)) AS i FROM c) SELECT cell_id, x1, y1, r, count(*) AS points, sum(trunc((x1 + r * cos(i / 64.0::DOUBLE * {2 * math.pi!r}::DOUBLE)) * {_ROUND}::DOUBLE))::BIGINT AS sx, sum(trunc((y1 + r * sin(i / 64.0::DOUBLE * {2 * math.pi!r}::DOUBLE)) * {_ROUND}::DOUBLE))::BIGINT AS sy FROM p GROUP BY ALL")
def circle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shapes(spark, sf_dir).select("cell_id", "x1", "y1", F.expr("x2 - x1").alias("r")).distinct()
    circle = rings.circle(F.col("x1").cast("double"), F.col("y1").cast("double"), F.col("r").cast("double"), 64, _ROUND)
    p = s.withColumn("p", rings.totals(circle))
    return p.select("cell_id", "x1", "y1", "r", F.col("p.n").alias("points"), F.col("p.x").alias("sx"), F.col("p.y").alias("sy"))


@query(f"WITH {SHAPES_SQL}, g AS (SELECT *, unnest(range(0, (x1 % 4 + 1) * (y1 % 3 + 1))) AS i FROM shapes) SELECT {K}, count(*) AS copies, sum(x1 + i % (x1 % 4 + 1) * (x2 - x1) + i // (x1 % 4 + 1))::BIGINT AS sx, sum(y1 + i // (x1 % 4 + 1) * (y2 - y1))::BIGINT AS sy FROM g GROUP BY {K}")
def repetition_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape repeated in a slanted grid and moved."""
    columns, rows = F.col("x1") % 4 + 1, F.col("y1") % 3 + 1
    grid = curves.grid_offsets(columns, rows, (F.col("x2") - F.col("x1"), F.lit(0)), (F.lit(1), F.col("y2") - F.col("y1")))
    s = shapes(spark, sf_dir).withColumn("at", F.explode(grid))
    corner = F.get(curves.moved(curves.rectangle(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.col("at")), F.lit(0))
    return s.select(*KEYS, corner.alias("p")).groupBy(*KEYS).agg(F.count("*").alias("copies"), F.sum("p.x").alias("sx"), F.sum("p.y").alias("sy"))


_CUT = round(GROW * (1 - 0.5**0.5))


@query(f"WITH {SHAPES_SQL} SELECT {K}, x1 - {GROW} AS x1, y1 - {GROW} AS y1, x2 + {GROW} AS x2, y2 + {GROW} AS y2, (x2 - x1 + {2 * GROW}) * (y2 - y1 + {2 * GROW}) - {2 * _CUT * _CUT} AS area FROM shapes")
def octagonal_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown with cut corners."""
    grown = sizing.offset(polygons(shapes(spark, sf_dir)), GROW, "octagonal")
    return _boxes(grown.withColumn("file", F.col("cell_id")))


@query(f"WITH {SHAPES_SQL} SELECT {K}, x1 - {GROW} AS x1, y1 - {GROW} AS y1, x2 + {GROW} AS x2, y2 + {GROW} AS y2, {4 * 5 + 1}::BIGINT AS points FROM shapes")
def round_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grown with corners of four pieces a quarter turn."""
    grown = sizing.offset(polygons(shapes(spark, sf_dir)), GROW, "round", 4).withColumn("file", F.col("cell_id"))
    box = grown.select(*KEYS, rings.measured(F.col("points")).alias("b"))
    return box.select(*KEYS, *(f"b.{c}" for c in ("x1", "y1", "x2", "y2")), (F.col("b.edges") + 1).alias("points"))


_ODD = "(SELECT *, 0 AS side FROM shapes WHERE layer % 2 = 1)"
_ODD_TURNED = "(SELECT cell_id, layer, y1 AS x1, x1 AS y1, y2 AS x2, x2 AS y2, 0 AS side FROM shapes WHERE layer % 2 = 1)"
_KITES = "pairs AS (SELECT row_number() OVER () AS no, e.cell_id, e.layer, e.x1 AS a_x, e.y1 AS a_y, e.x2 AS b_x, e.y2 AS b_y, f.x1 AS c_x, f.y1 AS c_y, f.x2 AS d_x, f.y2 AS d_y FROM ring e JOIN ring f ON e.cell_id = f.cell_id AND e.layer = f.layer AND e.id = f.id AND f.edge - e.edge BETWEEN 2 AND e.n - 1 - CASE WHEN e.edge = 0 THEN 1 ELSE 0 END WHERE e.layer % 2 = 0)"


@query(f"WITH {SHAPES_SQL}, {sweep_sql(_ODD)}, {bands_sql('cells', 'a > 0', 'u')}, {sweep_sql(_ODD_TURNED, '2')}, {bands_sql('cells2', 'a > 0', 'v')}, {ring_sql('kite')}, {_KITES}, {edge_distance_sql('euclidean', 'pairs', K)} SELECT {K}, count(*) AS violations FROM (SELECT DISTINCT {K}, x1, y1, x2, y2, 0 AS turned FROM u WHERE x2 - x1 < {WIDTH} UNION ALL SELECT DISTINCT {K}, y1, x1, y2, x2, 1 FROM v WHERE x2 - x1 < {WIDTH} UNION ALL SELECT {K}, e1x1, e1y1, e2x1, e2y1, 2 FROM far WHERE d > 1e-9 AND d < {WIDTH}) GROUP BY {K}")
def width_by_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of boxes are checked by coverage, regions of kites by edges, in one call."""
    s = shapes(spark, sf_dir)
    mixed = polygons(s.where("layer % 2 = 1")).unionByName(polygons(s.where("layer % 2 = 0"), "kite"))
    return rules.width(mixed, KEYS, WIDTH).groupBy(*KEYS).agg(F.count("*").alias("violations"))


@query(f"WITH {SHAPES_SQL} SELECT DISTINCT cell_id, ['cif', 'dxf', 'lef', 'def', 'unknown'][cell_id % 5 + 1] AS format FROM shapes")
def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written for each cell, found from its first bytes; for some only the coordinates, which are no format."""
    s = _numbered(spark, sf_dir)
    of = lambda k: s.where(F.col("cell_id") % 5 == k)
    cif_, dxf_, lef_ = ((w, of(k)) for k, w in enumerate((lambda c, b: cif.write_texts(c, _extra(b)), lambda c, b: dxf.write_texts(c, _extra(b), 1), lambda c, b: lef.write_texts(c, b, SCALE))))
    texts = [w(_cells(x), _boundaries(x)) for w, x in (cif_, dxf_, lef_)]
    d = of(3)
    part = d.select(F.col("cell_id").cast("string").alias("file"), F.struct(F.col("poly_idx").alias("seq")).alias("elem_order"), F.lit("cellRef").alias("kind"), F.lit("m").alias("ref_cell"), F.struct(F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y")).alias("origin"), F.lit(False).alias("mirror"), F.lit(0.0).alias("angle"), *(F.lit(None).cast(t).alias(c) for c, t in (("layer", "int"), ("points", "array<struct<x:int,y:int>>"), ("width", "int"), ("text", "string"), ("name", "string"))))
    texts.append(def_.write_texts(d.select(F.col("cell_id").cast("string").alias("file"), F.lit("chip").alias("design")).distinct(), part, SCALE))
    texts.append(of(4).groupBy(F.col("cell_id").cast("string").alias("file")).agg(F.array_join(F.collect_list(F.concat_ws(" ", F.lit("shape"), "x1", "y1", "x2", "y2")), "\n").alias("text")))
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    return every.select(F.col("file").cast("long").alias("cell_id"), sniff.format_of(F.encode(F.substring("text", 1, 4096), "UTF-8")).alias("format"))


# what is done to the text of a cell by cell_id % 6, and the faults that this makes: record, kind, fault; l layers and n polygons stand in a file
_FAULTS = {1: ("-1", "EOF", "no end"), 2: ("8 + l", "LWPOLYGON", "unknown"), 3: ("9 + l + n", "ENDSEC", "out of place"), 4: ("8 + l + unnest(range(0, n))", "LWPOLYLINE", "number 70 x"), 5: ("7 + l", "SECTION", "out of place")}
_FAULT_ROWS = " UNION ALL ".join(f"SELECT cell_id, ({r})::BIGINT AS record, '{k}' AS kind, '{f}' AS fault FROM s WHERE cell_id % 6 = {m}" for m, (r, k, f) in _FAULTS.items())


@query(f"WITH {SHAPES_SQL}, s AS (SELECT cell_id, count(DISTINCT layer) AS l, count(*) AS n FROM shapes GROUP BY cell_id) {_FAULT_ROWS}")
def dxf_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which the end mark, names, numbers or the order of sections are spoilt, validated strictly."""
    s = _numbered(spark, sf_dir)
    text = materialise(dxf.write_texts(_cells(s), _extra(_boundaries(s, "ell")), 1), "dxf")
    which, body = F.col("file").cast("long") % 6, F.col("text")
    once = lambda old, new: F.regexp_replace(body, f"(?s)^(.*?){old}", f"$1{new}")
    spoilt = F.when(which == 1, F.regexp_replace(body, "0\nEOF\n$", "")).when(which == 2, once("LWPOLYLINE", "LWPOLYGON")).when(which == 3, once("0\nEOF\n$", "0\nENDSEC\n0\nEOF\n"))
    spoilt = spoilt.when(which == 4, F.regexp_replace(body, "\n70\n1\n10\n", "\n70\nx\n10\n")).when(which == 5, once("\n2\nENTITIES\n", "\n3\nENTITIES\n")).otherwise(body)
    found = dxf_check.faults(dxf.groups(text.select("file", spoilt.alias("text"))), 1)
    return found.select(F.col("file").cast("long").alias("cell_id"), "record", "kind", "fault")


@query(_BOX_SQL)
def dxf_hatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hatch for each shape, by turns with a polyline loop and with one of four lines."""
    s = _numbered(spark, sf_dir)
    corners = (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))
    group = lambda code, v: F.concat(F.lit(f"{code}\n"), v.cast("string") if isinstance(v, Column) else F.lit(v), F.lit("\n"))
    chain = [group(92, "3"), group(72, "0"), group(73, "1"), group(93, "4"), *(group(c, F.col(v)) for x, y in corners for c, v in ((10, x), (20, y)))]
    edges = [group(92, "1"), group(93, "4"), *(group(c, v) for i in range(4) for c, v in ((72, "1"), (10, F.col(corners[i][0])), (20, F.col(corners[i][1])), (11, F.col(corners[(i + 1) % 4][0])), (21, F.col(corners[(i + 1) % 4][1]))))]
    head = [group(0, "HATCH"), group(8, F.col("layer")), group(10, "0"), group(20, "0"), group(91, "1")]
    hatch = F.concat(*head, F.when(F.col("poly_idx") % 2 == 0, F.concat(*chain)).otherwise(F.concat(*edges)), group(75, "0"), group(98, "1"), group(10, "1"), group(20, "1"))
    body = s.groupBy(F.col("cell_id").cast("string").alias("file")).agg(F.array_join(F.collect_list(hatch), "").alias("body"))
    text = materialise(body.select("file", F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), "body", F.lit("0\nENDSEC\n0\nEOF\n")).alias("text")), "hatches")
    return _boxes(dxf.elements(dxf.entities(dxf.groups(text)), 1))


# per cell: net nK has the shapes of layer K as bent wires, a connection to each and a use by layer; special nets pK have half of them as widths
_NETS = f"""WITH {SHAPES_SQL} SELECT cell_id, 'n' || layer AS net, 'wire' AS what, x1, y1, x2, y2, count(*) AS n FROM shapes GROUP BY ALL
UNION ALL SELECT cell_id, 'p' || layer, 'wide', x1, y1, x2, x2 - x1, count(*) FROM shapes WHERE layer % 2 = 1 GROUP BY ALL
UNION ALL SELECT cell_id, 'n' || layer, 'connection', x1, y1, 0, 0, count(*) FROM shapes WHERE layer % 3 <> 0 GROUP BY ALL
UNION ALL SELECT cell_id, 'n' || layer, 'pin', min(x1), min(y1), 0, 0, 1 FROM shapes GROUP BY cell_id, layer
UNION ALL SELECT cell_id, 'v' || layer, 'via', min(x1), min(y1), max(x2), max(y2), 1 FROM shapes GROUP BY cell_id, layer"""


@query(_NETS)
def def_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets, special nets, pins and vias of designs: read, turned into elements with properties, upserted back, written and read again. Nets of every third layer have no record but their routes."""
    s = shapes(spark, sf_dir)
    t = lambda c: F.col(c).cast("string")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    file = t("cell_id").alias("file")
    place = F.struct("layer", "x1", "y1", "x2", "y2")
    bent = say("M", t("layer"), " ( ", t("x1"), " ", t("y1"), " ) ( ", t("x2"), " * ) ( * ", t("y2"), " )")
    routed = lambda w: F.array_join(F.transform(w, lambda x, i: F.concat(F.when(i == 0, " + ROUTED ").otherwise(" + NEW "), x["w"])), "")
    listed = lambda c: F.sort_array(F.collect_list(F.struct(place.alias("p"), c.alias("w"))))
    nets = s.groupBy(file, "layer").agg(say("- n", t("layer"), F.when(F.col("layer") % 3 == 0, "").otherwise(F.array_join(F.collect_list(say(" ( c", t("x1"), " a", t("y1"), " )")), "")), F.when(F.col("layer") % 2 == 0, " + USE SIGNAL").otherwise(""), routed(listed(bent)), " ;").alias("line"))
    wide = s.where("layer % 2 = 1").groupBy(file, "layer").agg(say("- p", t("layer"), " + USE POWER", routed(listed(say("M", t("layer"), " ", F.expr("cast(x2 - x1 as string)"), " ( ", t("x1"), " ", t("y1"), " ) ( ", t("x2"), " * )"))), " ;").alias("line"))
    pin = s.groupBy(file, "layer").agg(say("- i", t("layer"), " + NET n", t("layer"), " + FIXED ( ", F.min("x1").cast("string"), " ", F.min("y1").cast("string"), " ) FS ;").alias("line"))
    via = s.groupBy(file, "layer").agg(say("- v", t("layer"), " + RECT M ( ", F.min("x1").cast("string"), " ", F.min("y1").cast("string"), " ) ( ", F.max("x2").cast("string"), " ", F.max("y2").cast("string"), " ) ;").alias("line"))
    body = None
    for rank, (name, rows) in enumerate((("VIAS", via), ("PINS", pin), ("SPECIALNETS", wide), ("NETS", nets))):
        one = rows.groupBy("file").agg(F.struct(F.lit(rank).alias("rank"), say(f"{name} 1 ;\n", F.array_join(F.sort_array(F.collect_list("line")), "\n"), f"\nEND {name}\n").alias("text")).alias("b"))
        body = one if body is None else body.unionByName(one)
    text = body.groupBy("file").agg(say("DESIGN chip ;\n", F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["text"]), ""), "END DESIGN\n").alias("text"))
    read = def_.scan(sequences.statements_of(materialise(text, "def-nets"), ";"))
    mapping = spark.createDataFrame([(f"M{i}", i) for i in range(1, 8)], "layer_name string, layer int")
    props = def_back.properties(read)
    third = F.regexp_extract("value", r"^n(\d+)$", 1).try_cast("int") % 3 == 0
    lost = props.where(F.col("key").rlike(r"^def\.net\.\d+\.name$") & third).select("file", F.regexp_extract("key", r"^(def\.net\.\d+\.)", 1).alias("lost"))
    props = props.withColumn("lost", F.regexp_extract("key", r"^(def\.net\.\d+\.)", 1)).join(lost, ["file", "lost"], "left_anti").drop("lost")
    doc = def_back.document(def_.design(read).select("file", "design", "dbu"), props, def_back.elements(read, mapping))
    again = def_.scan(sequences.statements_of(materialise(def_back.texts(def_back.lines(doc)), "def-nets-again"), ";"))
    zero, one = F.lit(0).cast("long"), F.lit(1)
    at = lambda i, c: F.get("points", F.lit(i))[c].cast("long")
    rows = [
        def_.wires(again).select("file", "net", F.lit("wire").alias("what"), at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y")),
        def_.wires(again, "SPECIALNETS").select("file", "net", F.lit("wide").alias("what"), at(0, "x"), at(0, "y"), at(1, "x"), F.col("width").cast("long")),
        def_.connections(again).select("file", "net", F.lit("connection").alias("what"), F.substring("component", 2, 9).cast("long"), F.substring("pin", 2, 9).cast("long"), zero, zero),
        def_.pins(again).select("file", "net", F.lit("pin").alias("what"), F.col("x").cast("long"), F.col("y").cast("long"), zero, zero),
        def_.vias(again).select("file", F.col("via").alias("net"), F.lit("via").alias("what"), *(F.get("rects", F.lit(0))[c].cast("long") for c in ("x1", "y1", "x2", "y2"))),
    ]
    found = None
    for r in rows:
        r = r.toDF("file", "net", "what", "x1", "y1", "x2", "y2")
        found = r if found is None else found.unionByName(r)
    return found.groupBy(F.col("file").cast("long").alias("cell_id"), "net", "what", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))


_SPOTS = "sum(2 * (x1 + x2) + 6 * (y1 + y2))::BIGINT AS spots"


@query(f"""WITH {SHAPES_SQL} SELECT {K}, CASE WHEN layer % 2 = 0 THEN 'routing' ELSE 'placement' END AS what, count(*) AS n, {_SPOTS}, CASE WHEN layer % 2 = 0 THEN 0::BIGINT ELSE count(*) END AS flagged FROM shapes GROUP BY {K}
UNION ALL SELECT {K}, 'fill', count(*), {_SPOTS}, count(*) FILTER (layer % 3 = 0) FROM shapes GROUP BY {K}
UNION ALL SELECT {K}, 'region', count(*), {_SPOTS}, CASE WHEN layer % 2 = 1 THEN count(*) ELSE 0::BIGINT END FROM shapes GROUP BY {K}
UNION ALL SELECT {K}, 'group', count(*), count(*), 1 FROM shapes GROUP BY {K}
UNION ALL SELECT {K}, 'grid', count(*), (min(x1) + max(y2))::BIGINT, 1 FROM shapes GROUP BY {K}""")
def def_area_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockages, fills, regions, groups and cell grids of designs: written as lines, read from text, written and read once more."""
    s = shapes(spark, sf_dir)
    file = F.col("cell_id").cast("string").alias("file")
    seq = F.struct(F.lit(0).cast("bigint").alias("block"), F.hash("layer", *(f"{a}{i}" for i in (1, 2) for a in "xy")).cast("bigint").alias("seq"), F.lit(0).alias("part")).alias("seq")
    of_layer = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("layer").alias("seq"), F.lit(0).alias("part")).alias("seq")
    name = lambda p: F.concat(F.lit(p), F.col("layer").cast("string"))
    box = F.struct(*(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))
    ring = F.array(*(F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))))
    even, none = F.col("layer") % 2 == 0, F.lit(None).cast("string")
    rects, rings = F.array(box), F.array(ring)
    blocked = s.select(file, seq, F.when(even, "ROUTING").otherwise("PLACEMENT").alias("type"), name("M").alias("layer_name"), none.alias("component"), (~even).alias("pushdown"), F.when(even, rects).otherwise(F.slice(rects, 1, 0)).alias("rects"), F.when(even, F.slice(rings, 1, 0)).otherwise(rings).alias("polygons"))
    fill = s.select(file, seq, name("M").alias("layer_name"), (F.col("layer") % 3 == 0).alias("opc"), rects.alias("rects"), F.slice(rings, 1, 0).alias("polygons"))
    layered = s.groupBy(file, "layer").agg(F.collect_list(box).alias("rects"), F.count("*").alias("n"), (F.min("x1") + F.max("y2")).alias("start"))
    region = layered.select("file", of_layer, name("r").alias("region"), F.when(even, none).otherwise("FENCE").alias("type"), "rects")
    group = layered.select("file", of_layer, name("g").alias("group"), F.transform("rects", lambda r: F.concat(F.lit("c"), r["x1"].cast("string"))).alias("components"), name("r").alias("region"), F.array(F.struct(F.lit("shapes").alias("key"), F.concat(F.lit("of "), F.col("n").cast("string")).alias("value"))).alias("properties"))
    gcells = layered.select("file", of_layer, F.lit("X").alias("axis"), "start", F.col("n").alias("count"), F.col("layer").alias("step"))
    written = def_areas.lines(gcells, blocked, region, fill, group)
    read = def_.scan(sequences.statements_of(materialise(def_back.texts(written), "def-areas"), ";"))
    again = def_areas.lines(def_areas.gcell_grids(read), def_areas.blockages(read), def_areas.regions(read), def_areas.fills(read), def_areas.groups(read))
    last = def_.scan(sequences.statements_of(materialise(def_back.texts(again), "def-areas-again"), ";"))
    layer = lambda c: F.expr(f"cast(substring({c}, 2, 9) as bigint) as layer")
    total = lambda e, zero: F.aggregate(e, F.lit(0).cast("bigint"), zero)
    of_rects = total(F.col("rects"), lambda t, r: t + (r["x1"] + r["x2"]) * 2 + (r["y1"] + r["y2"]) * 6)
    of_rings = total(F.flatten("polygons"), lambda t, q: t + q["x"] + q["y"] * 3)
    shown = F.size("rects").cast("bigint").alias("n")
    flag = lambda c: F.when(c, shown).otherwise(0).cast("bigint").alias("flagged")
    own = def_areas.blockages(last).select("file", layer("layer_name"), F.lower("type").alias("what"), (F.size("rects") + F.size("polygons")).cast("bigint").alias("n"), (of_rects + of_rings).alias("spots"), F.col("pushdown").cast("bigint").alias("flagged"))
    own = own.unionByName(def_areas.fills(last).select("file", layer("layer_name"), F.lit("fill").alias("what"), shown, of_rects.alias("spots"), flag(F.col("opc"))))
    own = own.unionByName(def_areas.regions(last).select("file", layer("region"), F.lit("region").alias("what"), shown, of_rects.alias("spots"), flag(F.col("type").isNotNull())))
    value = F.expr("cast(substring(properties[0].value, 4, 9) as bigint) as spots")
    own = own.unionByName(def_areas.groups(last).select("file", layer("group"), F.lit("group").alias("what"), F.size("components").cast("bigint").alias("n"), value, (F.substring("region", 2, 9) == F.substring("group", 2, 9)).cast("bigint").alias("flagged")))
    own = own.unionByName(def_areas.gcell_grids(last).select("file", F.col("step").cast("bigint").alias("layer"), F.lit("grid").alias("what"), F.col("count").cast("bigint").alias("n"), F.col("start").cast("bigint").alias("spots"), F.lit(1).cast("bigint").alias("flagged")))
    return own.groupBy(F.col("file").cast("bigint").alias("cell_id"), "layer", "what").agg(*(F.sum(c).alias(c) for c in ("n", "spots", "flagged")))


def _corner_sql(token: str) -> str:
    return "+".join(f"({c}) * ({u})" for c, u in zip(compact.coefficients(token), ("w", "h", "w // 2", "h // 2", "w // 3", "h // 3")) if c) or "0"


_RINGS = ", ".join("[" + ", ".join(f"[{_corner_sql(a)}, {_corner_sql(b)}]" for a, b in (c.split(",") for c in (*row.split(), row.split()[0]))) + "]" for row in compact.CORNERS)


@query(f"WITH {SHAPES_SQL}, t AS (SELECT *, (x1 + y1) % 25 AS kind, x2 - x1 AS w, y2 - y1 AS h FROM shapes), r AS (SELECT *, [{_RINGS}][kind + 1] AS ring FROM t) SELECT {K}, kind, count(*) AS shapes, sum(len(ring))::BIGINT AS points, sum(abs(list_sum(list_transform(range(1, len(ring)), lambda i: ring[i][1] * ring[i + 1][2] - ring[i + 1][1] * ring[i][2]))))::BIGINT AS twice_area, sum(list_sum(list_transform(ring, lambda p: x1 + p[1] + 3 * (y1 + p[2]))))::BIGINT AS spots FROM r GROUP BY ALL")
def compact_trapezoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trapezoid of every type in the shapes' boxes, drawn from differences again."""
    s = shapes(spark, sf_dir).withColumn("kind", F.expr("(x1 + y1) % 25"))
    drawn = s.withColumn("p", compact.compact_trapezoid(F.col("kind"), F.col("x1"), F.col("y1"), F.expr("x2 - x1"), F.expr("y2 - y1")))
    p = drawn.select(*KEYS, "kind", compact.from_deltas(F.get("p", F.lit(0)), compact.deltas(F.col("p")), F.lit(True)).alias("p"))
    t = p.select(*KEYS, "kind", rings.totals(F.col("p")).alias("t"))
    return t.groupBy(*KEYS, "kind").agg(F.count("*").alias("shapes"), F.sum("t.n").alias("points"), F.sum(F.abs("t.doubled")).alias("twice_area"), F.sum(F.expr("t.x + 3 * t.y")).alias("spots"))


_ISLANDS = "SELECT *, sum(new) OVER (PARTITION BY {g} ORDER BY {a}) AS run FROM (SELECT *, CASE WHEN lag(gap) OVER (PARTITION BY {g} ORDER BY {a}) IS NOT DISTINCT FROM gap THEN 0 ELSE 1 END AS new FROM (SELECT *, coalesce(d, lead(d) OVER (PARTITION BY {g} ORDER BY {a})) AS gap FROM (SELECT *, {a} - lag({a}) OVER (PARTITION BY {g} ORDER BY {a}) AS d FROM {t})))"
_ACROSS = f"SELECT {K}, y, min(x) AS x, count(*) AS columns, CASE WHEN count(*) > 1 THEN (max(x) - min(x)) // (count(*) - 1) ELSE 0 END AS dx FROM ({_ISLANDS.format(g=f'{K}, y', a='x', t='placed')}) GROUP BY {K}, y, run"
_GRIDS = f"SELECT {K}, min(y) AS y, count(*) AS rows FROM ({_ISLANDS.format(g=f'{K}, x, columns, dx', a='y', t='across_')}) GROUP BY {K}, x, columns, dx, run"


@query(f"WITH {SHAPES_SQL}, g AS (SELECT *, unnest(range(0, (x1 % 4 + 1) * (y1 % 3 + 1))) AS i FROM shapes), placed AS (SELECT DISTINCT {K}, x1 + i % (x1 % 4 + 1) * (x2 - x1) AS x, y1 + i // (x1 % 4 + 1) * (y2 - y1) AS y FROM g), across_ AS ({_ACROSS}), grids AS ({_GRIDS}), n AS (SELECT {K}, count(*) AS arrays FROM grids GROUP BY {K}) SELECT {K}, arrays, count(*) AS placements, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * y)::BIGINT AS sxy FROM placed JOIN n USING (cell_id, layer) GROUP BY ALL")
def array_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated shapes' corners, the arrays found among them, and what these give when they are expanded."""
    columns, rows = F.col("x1") % 4 + 1, F.col("y1") % 3 + 1
    grid = curves.grid_offsets(columns, rows, (F.col("x2") - F.col("x1"), F.lit(0)), (F.lit(0), F.col("y2") - F.col("y1")))
    placed = shapes(spark, sf_dir).withColumn("at", F.explode(grid)).select(*KEYS, (F.col("x1") + F.col("at.x")).alias("x"), (F.col("y1") + F.col("at.y")).alias("y")).distinct()
    found = materialise(compact.arrays(placed, KEYS), "arrays")
    spots = compact.expanded(found, KEYS).groupBy(*KEYS).agg(F.count("*").alias("placements"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    return spots.join(found.groupBy(*KEYS).agg(F.count("*").alias("arrays")), KEYS)


_REFS = "refs AS (SELECT c AS cell, 2 * c + 1 + k // 2 AS ref, (c + k) % 2 = 1 AS mirror, (c + 2 * k) % 4 AS turn, 1000 * (c % 7) + 300 * k AS x, 500 * (c % 5) - 200 * k AS y FROM cells, range(0, 3) r(k) WHERE 2 * c + 1 + k // 2 IN (SELECT c FROM cells))"
_TURNED_X = "CASE {t} WHEN 0 THEN {x} WHEN 1 THEN -({v}) WHEN 2 THEN -({x}) ELSE ({v}) END"
_TURNED_Y = "CASE {t} WHEN 0 THEN ({v}) WHEN 1 THEN {x} WHEN 2 THEN -({v}) ELSE -({x}) END"
_at = lambda f, x, y: f.format(t="p.turn", x=x, v=f"CASE WHEN p.mirror THEN -({y}) ELSE {y} END")
_PLACED = f"p AS (SELECT 0::BIGINT AS cell, false AS mirror, 0::BIGINT AS turn, 0::BIGINT AS x, 0::BIGINT AS y UNION ALL SELECT r.ref, p.mirror <> r.mirror, (p.turn + CASE WHEN p.mirror THEN 4 - r.turn ELSE r.turn END) % 4, p.x + {_at(_TURNED_X, 'r.x', 'r.y')}, p.y + {_at(_TURNED_Y, 'r.x', 'r.y')} FROM p JOIN refs r ON r.cell = p.cell)"
_FLAT = ", ".join(f"p.{c} + {_at(f, f'{c2}x1', f'{c2}y1')} AS {n}1, p.{c} + {_at(f, f'{c2}x2', f'{c2}y2')} AS {n}2" for c, f, n, c2 in (("x", _TURNED_X, "a", "s."), ("y", _TURNED_Y, "b", "s.")))


@query(f"WITH RECURSIVE {SHAPES_SQL}, cells AS (SELECT DISTINCT cell_id AS c FROM shapes), {_REFS}, {_PLACED}, f AS (SELECT s.cell_id, s.layer, {_FLAT} FROM p JOIN shapes s ON s.cell_id = p.cell) SELECT {K}, count(*) AS shapes, sum(least(a1, a2))::BIGINT AS x1, sum(least(b1, b2))::BIGINT AS y1, sum(greatest(a1, a2))::BIGINT AS x2, sum(greatest(b1, b2))::BIGINT AS y2, sum(abs(a1 - a2) * abs(b1 - b2))::BIGINT AS area FROM f GROUP BY {K}")
def flattened_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells under the first one, where a cell refers to the next level's cells, to the first of two twice, mirrored and turned."""
    s = shapes(spark, sf_dir)
    cells = s.select(F.col("cell_id").alias("c")).distinct()
    ref = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(F.lit("f").alias("file"), F.col("c").alias("cell"), F.expr("2 * c + 1 + k div 2").alias("ref_cell"), F.expr("(c + k) % 2 = 1").alias("mirror"), F.expr("cast((c + 2 * k) % 4 as int)").alias("turn"), F.expr("1000 * (c % 7) + 300 * k").alias("x"), F.expr("500 * (c % 5) - 200 * k").alias("y"))
    known = ref.join(cells.select(F.col("c").alias("ref_cell")), "ref_cell", "left_semi")
    found = hierarchy.placements(cells.where("c = 0").select(F.lit("f").alias("file"), F.col("c").alias("top")), known)
    flat = hierarchy.flattened(found, s.select(F.lit("f").alias("file"), F.col("cell_id").alias("cell"), "layer", "x1", "y1", "x2", "y2"))
    total = lambda e: F.sum(F.expr(f"n * {e}"))
    return flat.groupBy(F.col("cell").alias("cell_id"), "layer").agg(F.sum("n").alias("shapes"), *(total(c).alias(c) for c in ("x1", "y1", "x2", "y2")), total("((x2 - x1) * (y2 - y1))").alias("area"))


# ---- technology ------------------------------------------------------------------------------------------------

_LAYERS = f"l AS (SELECT cell_id, layer, min(x2 - x1) AS w, max(x2 - x1) AS p, count(*) AS n FROM shapes GROUP BY cell_id, layer)"


def _technology(s: DataFrame) -> DataFrame:
    """LEF of each cell: for every layer its sizes and a ragged spacing table, a via between neighbours, one site."""
    t = lambda e: F.expr(f"cast({e} as string)")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    of_layer = s.groupBy("cell_id", "layer").agg(F.expr("min(x2 - x1)").alias("w"), F.expr("max(x2 - x1)").alias("p"), F.count("*").alias("n"))
    table = say("  SPACINGTABLE PARALLELRUNLENGTH 0 15 ", t("30 + layer"), " WIDTH 0 ", t("layer"), " WIDTH ", t("12 + layer"), " ", t("layer + 1"), " ", t("layer + 2"), " WIDTH 30 ", t("layer + 3"), " ", t("layer + 4"), " ", t("layer + 5"), " ;\n")
    layer = say("LAYER M", t("layer"), "\n  TYPE ROUTING ;\n  PITCH ", t("p"), " ;\n  MINWIDTH ", t("w"), " ;\n  AREA ", t("n"), " ;\n", table, "END M", t("layer"), "\n")
    via = say("VIA v", t("layer"), " DEFAULT\n  LAYER M", t("layer"), " ;\n    RECT 0 0 ", t("w"), " ", t("p"), " ;\nEND v", t("layer"), "\n")
    parts = of_layer.groupBy(F.col("cell_id").cast("string").alias("file")).agg(F.sort_array(F.collect_list(F.struct("layer", layer.alias("a"), via.alias("b")))).alias("x"))
    whole = say("VERSION 5.8 ;\n", F.array_join(F.transform("x", lambda q: q["a"]), ""), F.array_join(F.transform("x", lambda q: q["b"]), ""), "SITE core\n  CLASS CORE ;\n  SIZE 1 BY 2 ;\nEND core\nEND LIBRARY\n")
    return lef.scan(sequences.statements_of(materialise(parts.select("file", whole.alias("text")), "technology"), ";"))


@query(f"WITH {SHAPES_SQL}, {_LAYERS} SELECT cell_id, 'M' || layer AS name, p::DOUBLE AS pitch, w::DOUBLE AS min_width, n::DOUBLE AS min_area, 3::BIGINT AS widths, w::DOUBLE AS via_x, p::DOUBLE AS via_y FROM l")
def technology_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEF to JSON documents, decoded strictly, written as LEF, and read once more."""
    text = materialise(technology.documents(technology.libraries(_technology(shapes(spark, sf_dir)))), "technology-documents")
    again = lef.scan(sequences.statements_of(materialise(technology.lef_texts(technology.decoded(text)), "technology-lef"), ";"))
    library = materialise(technology.libraries(again), "technology-again")
    one = library.select("file", F.posexplode("layers").alias("i", "l"), "designRules", "vias")
    rule = F.get(F.filter("designRules", lambda r: r["layerName"] == F.col("l.name")), F.lit(0))
    rect = F.get(F.get(F.filter("vias", lambda v: F.get(v["layers"], F.lit(0))["layerName"] == F.col("l.name")), F.lit(0))["layers"][0]["rects"], F.lit(0))
    return one.select(F.col("file").cast("long").alias("cell_id"), F.col("l.name").alias("name"), F.col("l.pitch").alias("pitch"), rule["minWidth"].alias("min_width"), rule["minArea"].alias("min_area"), F.size("l.spacingTable.entries").cast("long").alias("widths"), rect["x2"].alias("via_x"), rect["y2"].alias("via_y"))


_ROW = "CASE WHEN wide >= 30 THEN layer + 3 + CASE WHEN long >= 30 + layer THEN 2 WHEN long >= 15 THEN 1 ELSE 0 END WHEN wide >= 12 + layer THEN layer + 1 + CASE WHEN long >= 15 THEN 1 ELSE 0 END ELSE layer END"


@query(f"WITH {SHAPES_SQL}, p AS (SELECT {K}, least(x2 - x1, y2 - y1) AS wide, greatest(x2 - x1, y2 - y1) AS long FROM shapes) SELECT {K}, ({_ROW})::DOUBLE AS spacing, count(*) AS shapes FROM p GROUP BY ALL")
def spacing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spacing that each shape's width and length ask for in the table of its layer."""
    s = shapes(spark, sf_dir)
    probes = s.select(F.col("cell_id").cast("string").alias("file"), F.concat(F.lit("M"), F.col("layer").cast("string")).alias("layer_name"), F.expr("cast(least(x2 - x1, y2 - y1) as double)").alias("width"), F.expr("cast(greatest(x2 - x1, y2 - y1) as double)").alias("length"), "layer")
    found = technology.spacing_of(probes, technology.spacing_tables(_technology(s)))
    return found.groupBy(F.col("file").cast("long").alias("cell_id"), "layer", F.col("table_spacing").alias("spacing")).agg(F.count("*").alias("shapes"))


# ---- wire grids ------------------------------------------------------------------------------------------------


def _grid_query(n: int) -> None:
    def union(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grids.merged(grids.of_orders(spark, sf_dir, n))

    def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grids.violations(grids.of_orders(spark, sf_dir, n))

    for f, name, sql in ((union, f"wire_grid_{n}_union", grids.merged_sql(n)), (checked, f"wire_grid_{n}_rules", grids.violations_sql(n))):
        f.__name__ = name
        query(sql)(f)


for _n in (60, 140):
    _grid_query(_n)
