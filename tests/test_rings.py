"""Functions over rings a batch at a time, against those over one array of points."""

from __future__ import annotations

import contextlib
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import curves, rings
from tessella.functions import points as P
from tessella.operators import bands, connectivity, sizing
from tessella.plans import formats, queries

POINTS = "array<struct<x:int,y:int>>"
DIAMOND = [(0, -100), (100, 0), (0, 100), (-100, 0), (0, -100)]
SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
SPIKE = [(0, 0), (100, 0), (200, 0), (100, 0), (100, 100), (0, 100)]
ODD = [None, [], [(3, 4)], [(0, 0), (5, 5)], [(1, 1), (1, 1), (1, 1), (1, 1)], [(0, 0), (1, 0), (0, 1)], [SQUARE[0], *SQUARE], SQUARE[::-1], DIAMOND, SPIKE, SQUARE[:4], [(0, 0), (9, 0), (0, 0), (9, 0), (0, 0)], [(0, 0), None, (4, 4), (0, 4)]]


def polygons(spark):
    random.seed(5)
    several = [[(random.randint(-50, 50), random.randint(-50, 50)) for _ in range(random.randint(0, 9))] for _ in range(200)]
    several += [r + r[:1] for r in several]
    ring = lambda r: None if r is None else [None if p is None else {"x": p[0], "y": p[1]} for p in r]
    return spark.createDataFrame([(i, ring(r)) for i, r in enumerate(ODD + several)], f"i int, points {POINTS}")


def expected(p, by, corner):
    """As an expression over one ring, a step at a time."""
    q = F.col("points")
    turned = p.where("size(points) >= 3").withColumn("points", P.counter_clockwise(q)).localCheckpoint()
    ring = turned.withColumn("points", F.when(F.element_at(q, 1) == F.element_at(q, -1), F.slice(q, F.lit(1), F.size(q) - 1)).otherwise(q)).where("size(points) >= 3").localCheckpoint()
    made = {"square": lambda: curves.square_offset(q, by), "octagonal": lambda: curves.octagonal_offset(q, by), "round": lambda: curves.round_offset(q, by, 4)}[corner]()
    done = ring.withColumn("points", made).localCheckpoint().withColumn("points", P.closed(q)).localCheckpoint()
    return done.where((F.size("points") >= 3) & (P.polygon_area(q) != 0))


@pytest.mark.parametrize("corner", ["square", "octagonal", "round"])
def test_offsets_are_those_of_single_rings(spark, corner):
    p = polygons(spark)
    whole = p.where("points is not null and forall(points, q -> q is not null)")
    for by in (7, -3):
        rows = lambda d: {r.i: [tuple(q) for q in r.points] for r in d.collect()}
        assert rows(sizing.offset(p, by, corner, 4)) == rows(expected(whole, by, corner))


def test_measures_are_those_of_single_rings(spark):
    p = polygons(spark)
    got = {r.i: r.m for r in p.select("i", rings.measured(F.col("points")).alias("m")).collect()}
    assert got[0] is None and got[len(ODD) - 1] is None  # a null ring, one with a null point
    whole = p.where("points is not null and forall(points, q -> q is not null)")
    box, area, edges = P.bounding_box(F.col("points")), P.polygon_area(F.col("points")), P.edge_count(F.col("points"))
    for r in whole.select("i", box.alias("b"), area.alias("a"), edges.alias("e"), F.coalesce(P.is_rectangle(F.col("points")), F.lit(False)).alias("r")).collect():
        assert tuple(got[r.i]) == (*(r.b or (None,) * 4), r.a, r.e, r.r), r


def test_coordinates_at_the_border_of_their_range(spark):
    m = 2**31 - 1
    wide = [(-m - 1, -m - 1), (m, -m - 1), (m, m), (-m - 1, m)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in wide],)], f"points {POINTS}")
    with pytest.raises(Exception, match="64 bits"):
        df.select(rings.measured(F.col("points"))).collect()
    with pytest.raises(Exception, match="32 bits"):
        sizing.offset(df, 5).collect()
    half = spark.createDataFrame([([{"x": x // 2, "y": y // 2} for x, y in wide],)], f"points {POINTS}")
    assert half.select(rings.measured(F.col("points")).alias("m")).first().m.area == (m // 2 + 2**30) ** 2


def test_circles_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(float(x), float(y), float(r)) for x in (-7, 0, 12) for y in (5, 300) for r in (0, 1, 10, 49)] + [(None, 1.0, 2.0)], "x double, y double, r double")
    args = F.col("x"), F.col("y"), F.col("r"), 64, 0.7317
    for r in df.where("x is not null").select(rings.circle(*args).alias("a"), curves.circle(*args).alias("b"), rings.totals(rings.circle(*args)).alias("t")).collect():
        assert r.a == r.b and tuple(r.t)[:3] == (65, sum(p.x for p in r.a), sum(p.y for p in r.a))
    assert df.where("x is null").select(rings.circle(*args).alias("a")).first().a is None
    assert math.isclose(rings.TURN, 2 * math.pi)


@pytest.mark.parametrize("name", ["polygon_metrics", "round_growth", "octagonal_growth", "circle_points", "compact_trapezoids"])
def test_rings_are_worked_out_in_batches(spark, name):
    df = {**queries.QUERIES}[name](spark, "/root/testdata/sf0.001")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    assert "ArrowEvalPython" in out.getvalue() and "lambda" not in out.getvalue() and formats


def test_bands_are_those_of_the_shuffled_way(spark):
    """Both ways of cutting a rectilinear ring; any other has none in a batch."""
    random.seed(8)

    def stairs():
        out, x, y = [], random.randint(-9, 9), random.randint(-9, 9)
        for _ in range(random.randint(0, 8)):
            out.append((x, y))
            x, y = (random.randint(-9, 9), y) if len(out) % 2 else (x, random.randint(-9, 9))
        return out

    rows = [(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate([[], DIAMOND, SQUARE, SQUARE[:4], [(-(2**31), -(2**31)), (2**31 - 1, -(2**31)), (2**31 - 1, 2**31 - 1), (-(2**31), 2**31 - 1)], *(stairs() for _ in range(300))])]
    df = spark.createDataFrame([*rows, (999, None)], f"poly_idx int, points {POINTS}")
    found = df.select("poly_idx", F.expr("0 AS r"), F.inline(rings.bands(F.col("points")))).collect()
    straight = df.where(P.is_manhattan(F.col("points")))
    assert sorted(map(tuple, found)) == sorted((b.poly_idx, b.r, b.x1, b.y1, b.x2, b.y2) for b in bands.polygon_bands(straight.select(F.lit(0).alias("r"), "poly_idx", "points"), ["r"]).collect()) and len(found) > 100


def test_points_meet_polygons_in_buckets_of_their_size(spark):
    """Neighbours that are buckets apart never meet, and points and bands are dealt once, polygons' sides not at all."""
    small = [(i, [{"x": x + 100 * i, "y": y} for x, y in ((0, 0), (30, 0), (30, 40), (0, 40), (0, 0))]) for i in range(50)]
    p = spark.createDataFrame([(None, *r) for r in small], f"r int, poly_idx int, points {POINTS}")
    spots = spark.createDataFrame([(None, x, y) for x in range(0, 5000, 15) for y in (0, 40, 41)], "r int, x long, y long")
    found = connectivity.contained(spots, p, ["r"])
    assert {(r.x, r.y) for r in found.collect()} == {(x, y) for x in range(0, 5000, 15) for y in (0, 40) if x % 100 <= 30}
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain()
    assert out.getvalue().count("Window") == 0 and "ArrowEvalPython" in out.getvalue()
