"""Text formats, curves and sized polygons: known files, round trips and plain arithmetic."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import curves, rings
from tessella.operators import rules, sequences, sizing
from tessella.sources import cif, dxf

POINTS = "array<struct<x:int,y:int>>"


def text(spark, body, file="f"):
    return spark.createDataFrame([(file, body)], "file string, text string")


def spots(points):
    return [tuple(p) for p in points]


# ---- ordered rows -----------------------------------------------------------------------------------------------


def test_running_values_cross_blocks(spark):
    rows = [("f", i // 3, i, None if i % 4 else i, i) for i in range(20)] + [("g", 0, 0, None, 5)]
    df = spark.createDataFrame(rows, "file string, block long, seq long, mark int, n int")
    got = {(r.file, r.seq): (r.total, r.seen) for r in sequences.running(df, {"total": F.col("n")}, {"seen": F.col("mark")}).collect()}
    assert got == {("f", i): (i * (i + 1) // 2, i // 4 * 4) for i in range(20)} | {("g", 0): (5, None)}


def test_statements_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"row {i};" for i in range(1000)))
    got = sequences.statements(spark, f"file://{tmp_path}", ";").orderBy("block", "seq").collect()
    assert [r.text for r in got] == [f"row {i}" for i in range(1000)]


# ---- CIF --------------------------------------------------------------------------------------------------------

CIF = """(a note; with a mark) DS 1 100 1000; 9 INV; L 7; B 1000 500 500 250; L M1; W 20 0 0 100 0 100 -55;
P 0 0 100 0 100 100; 9 out 10 20; DF; DS 2 1; L M2; B 10 20 0 0 0 1; C 1 T 5 6 M X R 0 1; C 1; DF; E
"""


def cif_rows(spark, body):
    return cif.elements(sequences.statements_of(text(spark, body), ";", 3)).orderBy("seq").collect()


def test_cif_elements(spark):
    rows = cif_rows(spark, CIF)
    assert [(r.cell, r.kind, r.layer) for r in rows] == [("INV", "boundary", 7), ("INV", "path", 1), ("INV", "boundary", 1), ("INV", "text", 1), ("CELL_2", "boundary", 2), ("CELL_2", "cellRef", None), ("CELL_2", "cellRef", None)]
    assert spots(rows[0].points) == [(0, 0), (100, 0), (100, 50), (0, 50), (0, 0)]
    assert rows[1].width == 2 and spots(rows[1].points) == [(0, 0), (10, 0), (10, -5)]
    assert spots(rows[2].points) == [(0, 0), (10, 0), (10, 10), (0, 0)]
    assert (rows[3].text, tuple(rows[3].origin)) == ("out", (1, 2))
    assert spots(rows[4].points) == [(10, -5), (10, 5), (-10, 5), (-10, -5), (10, -5)]
    assert (rows[5].ref_cell, tuple(rows[5].origin), rows[5].mirror, rows[5].angle) == ("INV", (5, 6), True, 270.0)
    assert (rows[6].ref_cell, tuple(rows[6].origin), rows[6].mirror, rows[6].angle) == ("INV", (0, 0), False, 0.0)


@pytest.mark.parametrize(("body", "match"), [("DS 1 1; X 5; DF; E", "unsupported"), ("B 1 1 0 0; E", "out of place"), ("DS 1 1; C 9; DF; E", "unresolved"), ("DS 1 1; DF; DS 1 1; B 2 2 0 0; DF; E", "twice"), ("DS 1 1; L a; L 1; B 99999999999 2 0 0; DF; E", "")])
def test_cif_rejects(spark, body, match):
    with pytest.raises(Exception, match=match):
        cif_rows(spark, body)


def test_cif_named_layers_avoid_numbers(spark):
    rows = cif_rows(spark, "DS 1 1; L a; B 2 2 0 0; L 1; B 2 2 0 0; L b; B 2 2 0 0; L 3; B 2 2 0 0; L c; B 2 2 0 0; DF; E")
    assert [r.layer for r in rows] == [2, 1, 4, 3, 5]


def test_cif_round_trip(spark):
    rows = cif.elements(sequences.statements_of(text(spark, CIF), ";"))
    order = {"INV": 0, "CELL_2": 1}
    cells = spark.createDataFrame([("f", i, c) for c, i in order.items()], "file string, cell_idx int, cell string")
    numbered = rows.join(cells, ["file", "cell"]).withColumn("elem_idx", F.col("seq"))
    written = cif.write_texts(cells, numbered)
    again = cif.elements(sequences.statements_of(written, ";"))
    view = lambda df: [(r.cell, r.kind, r.layer, spots(r.points or []), r.width, r.ref_cell, r.origin, r.mirror, r.angle and r.angle % 360, r.text) for r in df.orderBy("seq").collect()]
    want = [(c, k, la, sorted(set(p)), w, *rest) for c, k, la, p, w, *rest in view(rows)]
    got = [(c, k, la, sorted(set(p)), w, *rest) for c, k, la, p, w, *rest in view(again)]
    fixed = [x if x[1] != "cellRef" or not x[7] else (*x[:8], 270.0, x[9]) for x in want]
    assert got == fixed


# ---- DXF --------------------------------------------------------------------------------------------------------


def doc(*pairs):
    return "".join(f"{c}\n{v}\n" for c, v in ((0, "SECTION"), (2, "ENTITIES"), *pairs, (0, "ENDSEC"), (0, "EOF")))


def dxf_rows(spark, *pairs, scale=1000.0, segments=64):
    return dxf.elements(dxf.entities(dxf.groups(text(spark, doc(*pairs)))), scale, segments).orderBy("entity").collect()


def test_dxf_curves(spark):
    circle, arc, oval, part = dxf_rows(spark, (0, "CIRCLE"), (8, "1"), (10, 1), (20, 2), (40, 3), (0, "ARC"), (8, "1"), (10, 0), (20, 0), (40, 10), (50, 350), (51, 10), (0, "ELLIPSE"), (8, "1"), (10, 0), (20, 0), (11, 10), (21, 0), (40, 0.5), (0, "ELLIPSE"), (8, "x"), (10, 0), (20, 0), (11, 10), (21, 0), (40, 0.5), (41, 0), (42, math.pi))
    cut = lambda x: int(x)
    assert spots(circle.points) == [(cut((1 + 3 * math.cos(i / 64 * 2 * math.pi)) * 1000), cut((2 + 3 * math.sin(i / 64 * 2 * math.pi)) * 1000)) for i in range(65)]
    a = [350 / 180 * math.pi + i / 64 * (20 / 180 * math.pi) for i in range(65)]
    assert arc.kind == "path" and all(abs(p.x - 10000 * math.cos(t)) <= 1 and abs(p.y - 10000 * math.sin(t)) <= 1 for p, t in zip(arc.points, a))
    assert oval.kind == "boundary" and len(oval.points) == 65 and max(p.y for p in oval.points) in (4999, 5000)
    assert part.kind == "path" and part.points[0].x == 10000 and part.points[-1].x == -10000 and min(p.y for p in part.points) >= 0 and part.layer == 1


def test_dxf_bulges_and_old_polylines(spark):
    half = [(10, 0), (20, 0), (42, 1), (10, 2), (20, 0)]
    light, old = dxf_rows(spark, (0, "LWPOLYLINE"), (8, "3"), (70, 0), *half, (0, "POLYLINE"), (8, "3"), (70, 1), *((c, v) for x, y, b in ((0, 0, 1), (2, 0, 0), (1, -3, 0)) for c, v in ((0, "VERTEX"), (8, "3"), (10, x), (20, y), (42, b))), (0, "SEQEND"))
    assert len(light.points) == 17 and light.kind == "path"
    assert all(abs(math.hypot(p.x - 1000, p.y) - 1000) < 2 for p in light.points) and min(p.y for p in light.points) in (-1000, -999)
    assert old.kind == "boundary" and len(old.points) == 3 + 15 + 1 and old.points[0] == old.points[-1]


def test_dxf_polylines_measured_in_batches(spark):
    """A batch function of the points was drawn into the branch of each kind, where it couldn't be run."""
    square = [(c, v) for x, y in ((0, 0), (5, 0), (5, 4), (0, 4)) for c, v in ((10, x), (20, y))]
    rows = dxf.elements(dxf.entities(dxf.groups(text(spark, doc((0, "LWPOLYLINE"), (8, "1"), (90, 4), (70, 1), *square)))), 1)
    assert [tuple(r.m)[:6] for r in rows.select(rings.measured(F.col("points")).alias("m")).collect()] == [(0, 0, 5, 4, 20, 4)]


def test_dxf_hatches_measured_in_batches(spark):
    spots = ((0, 0), (5, 0), (5, 4), (0, 4))
    chain = [(92, 3), (72, 0), (73, 1), (93, 4), *((c, v) for x, y in spots for c, v in ((10, x), (20, y)))]
    edges = [(92, 1), (93, 4), *((c, v) for (x, y), (u, w) in zip(spots, (*spots[1:], spots[0])) for c, v in ((72, 1), (10, x), (20, y), (11, u), (21, w)))]
    hatch = lambda loop: [(0, "HATCH"), (8, "1"), (91, 1), *loop, (75, 0), (98, 1), (10, 1), (20, 1)]
    rows = dxf.elements(dxf.entities(dxf.groups(text(spark, doc(*hatch(chain), *hatch(edges))))), 1)
    assert [tuple(r.m)[:6] for r in rows.select(rings.measured(F.col("points")).alias("m")).collect()] == [(0, 0, 5, 4, 20, 4)] * 2


def test_dxf_other_entities(spark):
    rows = dxf_rows(spark, (0, "SOLID"), (8, "M"), *((c + i, v) for i, p in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))) for c, v in ((10, p[0]), (20, p[1]))), (0, "SOLID"), (8, "M"), *((c + i, v) for i, p in enumerate(((0, 0), (1, 0), (0, 1))) for c, v in ((10, p[0]), (20, p[1]))), (0, "TEXT"), (8, "N"), (10, 1), (20, 2), (1, "hello"), (0, "TEXT"), (8, "N"), (1, ""), (0, "ATTDEF"), (8, "N"), (2, "TAG"), (1, "x"), (0, "INSERT"), (2, "B"), (10, 1), (20, 1), (41, -2), (42, 2), (50, 90), (0, "INSERT"), (2, "B"), (70, 3), (71, 2), (44, 0.5), (45, 2), (0, "SPLINE"), (8, "M"), (70, 0), (10, 0), (20, 0), (10, 1), (20, 1), (11, 5), (21, 5), (11, 6), (21, 6), scale=10)
    assert [r.kind for r in rows] == ["boundary", "boundary", "text", "text", "cellRef", "arrayRef", "path"]
    assert spots(rows[0].points) == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)] and len(rows[1].points) == 4
    assert [(r.text, tuple(r.origin)) for r in rows[2:4]] == [("hello", (10, 20)), ("TAG", (0, 0))]
    assert (rows[4].mirror, rows[4].magnification, rows[4].angle) == (True, 2.0, 90.0)
    assert (rows[5].columns, rows[5].rows, spots(rows[5].points)) == (3, 2, [(0, 0), (15, 0), (0, 40)])
    assert spots(rows[6].points) == [(50, 50), (60, 60)]


@pytest.mark.parametrize(("pairs", "match"), [([(0, "HATCHES"), (8, "1")], "unsupported"), ([(0, "CIRCLE"), (8, "1"), (40, 0)], "radius"), ([(0, "INSERT"), (2, "B"), (41, 1), (42, 2)], "scales"), ([(0, "LWPOLYLINE"), (10, 1), (20, 1)], "vertices")])
def test_dxf_rejects(spark, pairs, match):
    with pytest.raises(Exception, match=match):
        dxf_rows(spark, *pairs)


def test_dxf_round_trip(spark):
    schema = f"file string, cell_idx int, elem_idx int, cell string, kind string, layer int, points {POINTS}, ref_cell string, origin struct<x:int,y:int>, mirror boolean, magnification double, angle double, columns int, rows int, text string"
    box = [(0, 0), (2000, 0), (2000, 1500), (0, 1500), (0, 0)]  # 1001 would come back as 1000: sizes are cut toward zero
    rows = [("f", 0, 0, "TOP", "boundary", 4, box, *[None] * 8), ("f", 0, 1, "TOP", "path", 5, [(1, 2), (3, -4)], *[None] * 8), ("f", 0, 2, "TOP", "cellRef", None, None, "SUB", (7, 8), True, 2.0, 90.0, None, None, None), ("f", 0, 3, "TOP", "arrayRef", None, [(0, 0), (300, 0), (0, 40)], "SUB", (0, 0), False, 1.0, 0.0, 3, 2, None), ("f", 1, 0, "SUB", "text", 9, None, None, (5, 6), None, None, None, None, None, "hi there")]
    cells = spark.createDataFrame([("f", 0, "TOP"), ("f", 1, "SUB")], "file string, cell_idx int, cell string")
    body = dxf.write_texts(cells, spark.createDataFrame(rows, schema), 1000)
    names = [c for c in dxf.ELEMENT if c not in ("entity",)]
    got = dxf.elements(dxf.entities(dxf.groups(body)), 1000).select(*names).collect()
    want = spark.createDataFrame(rows, schema).select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


# ---- generators -------------------------------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_repetitions(spark):
    lit = F.lit
    assert spots(one(spark, curves.grid_offsets(lit(3), lit(2), (lit(10), lit(1)), (lit(0), lit(5))))) == [(0, 0), (10, 1), (20, 2), (0, 5), (10, 6), (20, 7)]
    steps = F.array(*map(lit, (5, 7)))
    assert spots(one(spark, curves.line_offsets(steps, lit(False)))) == [(0, 0), (5, 0), (12, 0)]
    assert spots(one(spark, curves.line_offsets(steps, lit(True)))) == [(0, 0), (0, 5), (0, 12)]
    vectors = F.array(*(F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in ((1, 2), (-3, 4))))
    assert spots(one(spark, curves.path_offsets(vectors))) == [(0, 0), (1, 2), (-2, 6)]
    box = curves.rectangle(*map(lit, (1, 2, 3, 4)))
    assert spots(one(spark, curves.moved(box, F.struct(lit(10).alias("x"), lit(-1).alias("y"))))) == [(11, 1), (14, 1), (14, 5), (11, 5), (11, 1)]
    with pytest.raises(Exception, match="copies"):
        one(spark, curves.grid_offsets(lit(0), lit(2), (lit(1), lit(0)), (lit(0), lit(1))))


def test_trapezoids_and_circles(spark):
    lit = F.lit
    assert spots(one(spark, curves.trapezoid(*map(lit, (0, 0, 100, 50, 10, -20)), lit(False)))) == [(0, 0), (100, 0), (80, 50), (10, 50), (0, 0)]
    assert spots(one(spark, curves.trapezoid(*map(lit, (0, 0, 50, 100, -10, 20)), lit(True)))) == [(0, 10), (50, 0), (50, 100), (0, 80), (0, 10)]
    ring = spots(one(spark, curves.round_polygon(lit(5), lit(-5), lit(100))))
    assert len(ring) == 65 and ring[0] == ring[-1] == (105, -5) and all(abs(math.hypot(x - 5, y + 5) - 100) < 1.5 for x, y in ring)


# ---- sizing and dispatch ----------------------------------------------------------------------------------------


def polygons(spark, *rings, r=0):
    return spark.createDataFrame([(r, i, [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate(rings)], f"r int, poly_idx int, points {POINTS}")


DIAMOND = [(0, -100), (100, 0), (0, 100), (-100, 0), (0, -100)]
SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]


def test_polygon_offsets(spark):
    ring = spots(sizing.offset(polygons(spark, SQUARE), 10).first().points)
    assert sorted(set(ring)) == [(-10, -10), (-10, 110), (110, -10), (110, 110)]
    ring = spots(sizing.offset(polygons(spark, SQUARE[::-1]), -10).first().points)
    assert sorted(set(ring)) == [(10, 10), (10, 90), (90, 10), (90, 90)]
    reach = 100 + 10 * math.sqrt(2)
    ring = spots(sizing.offset(polygons(spark, DIAMOND), 10).first().points)
    assert {(round(reach), 0), (0, -round(reach))} <= set(ring) and len(ring) == 5
    cut = sizing.offset(polygons(spark, SQUARE), 100, "octagonal").first().points
    assert len(cut) == 9 and {(p.x, p.y) for p in cut} >= {(200 - 29, -100), (200, -100 + 29)}
    arc = sizing.offset(polygons(spark, SQUARE), 50, "round", 4).first().points
    assert len(arc) == 4 * 5 + 1 and all(min(math.hypot(p.x - x, p.y - y) for x, y in SQUARE) - 50 < 1 for p in arc)
    assert sizing.offset(polygons(spark, [(0, 0), (5, 5)]), 3).count() == 0
    # a repeated vertex and one on a straight side change nothing; where a ring turns back its vertex stays
    doubled = [SQUARE[0], *SQUARE]
    assert set(spots(sizing.offset(polygons(spark, doubled), 10).first().points)) == set(spots(sizing.offset(polygons(spark, SQUARE), 10).first().points))
    spike = [(0, 0), (100, 0), (200, 0), (100, 0), (100, 100), (0, 100)]
    found = spots(sizing.offset(polygons(spark, spike), 10).first().points)
    assert (200, 0) in found and (100, -10) in found and (-10, -10) in found


def test_sized_polygons_chooses(spark):
    both = polygons(spark, SQUARE).union(polygons(spark, DIAMOND, r=1))
    got = {r.r: len(r.points) for r in sizing.sized_polygons(both, ["r"], 10).collect()}
    assert got == {0: 5, 1: 5}
    assert sizing.sized_polygons(both, ["r"], 0).count() == 2
    ell = polygons(spark, [(0, 0), (200, 0), (200, 100), (100, 100), (100, 200), (0, 200), (0, 0)])
    from tessella.functions.points import polygon_area

    total = lambda df: df.select(F.sum(polygon_area(F.col("points")))).first()[0]
    assert total(sizing.sized_polygons(ell, ["r"], 10)) == 38400
    assert total(sizing.sized_polygons(ell, ["r"], 10, "octagonal")) != 38400


def test_rules_choose_by_input_and_metric(spark):
    keys = ["r"]
    thin = [(0, 0), (30, 0), (30, 100), (0, 100), (0, 0)]
    assert rules.width(polygons(spark, thin), keys, 50).count() == 1  # a band
    assert rules.width(polygons(spark, thin), keys, 50, "square").count() == 1  # a pair of edges
    flat = [(0, 0), (100, 0), (100, 20), (50, 30), (0, 20), (0, 0)]
    assert rules.width(polygons(spark, flat), keys, 25).count() > 0
    a, b = polygons(spark, SQUARE), polygons(spark, [(110, 0), (210, 0), (210, 100), (110, 100), (110, 0)])
    assert rules.space(a, b, keys, 20).count() == 1
    assert rules.self_space(a.union(b), keys, 20).count() == 1
    assert rules.self_space(a.union(b), keys, 20, "projection").count() > 0
    with pytest.raises(Exception, match="rectilinear"):
        rules.self_space(polygons(spark, DIAMOND), keys, 5, "square")
    outer, inner = polygons(spark, [(0, 0), (200, 0), (200, 200), (0, 200), (0, 0)]), polygons(spark, [(30, 50), (150, 50), (150, 150), (30, 150), (30, 50)])
    assert rules.enclosure(outer, inner, keys, 50).count() == 1
    assert rules.enclosure(outer, inner, keys, 31, "square").count() >= 0
