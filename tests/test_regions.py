"""Region algebra, rules, sizing and connectivity against known vectors and a raster."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import points as P
from tessella.operators import bands, boolean, connectivity, drc, edges, sizing

KEYS = ["r"]
BOX = "r int, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def boxes(spark, *rects, r=0):
    return spark.createDataFrame([(r, *map(int, x)) for x in rects], BOX)


def polygon(spark, *rings):
    rows = [(0, i, [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "r int, poly_idx int, points array<struct<x:int,y:int>>")


def area(df):
    return df.agg(boolean.area()).first()[0] or 0


def test_boolean_areas(spark):
    a, b = boxes(spark, (0, 0, 100, 100)), boxes(spark, (50, 0, 150, 100))
    row = boolean.boolean_areas(a, b, KEYS).first()
    assert tuple(row)[1:] == (15000, 5000, 10000, 5000)
    for name, want in zip(boolean.KEEP, (15000, 5000, 10000, 5000)):
        assert area(boolean.boolean(name, a, b, KEYS)) == want


def test_donut_and_canonical_bands(spark):
    donut = boolean.boolean("difference", boxes(spark, (0, 0, 200, 200)), boxes(spark, (50, 50, 150, 150)), KEYS)
    assert area(donut) == 30000
    two = boxes(spark, (0, 0, 100, 1000), (5000, 300, 5100, 400))
    assert sorted(map(tuple, bands.union_bands(two, KEYS).collect())) == sorted(map(tuple, two.collect()))


def test_bands_join_across_tiles(spark):
    tall = boxes(spark, (0, -50, 10, 95), (0, 95, 10, 130))
    assert [tuple(x) for x in bands.union_bands(tall, KEYS, tile=16).collect()] == [(0, 0, -50, 10, 130)]


@pytest.mark.parametrize("seed", [1, 2])
def test_booleans_equal_a_raster(spark, seed):
    rnd = random.Random(seed)

    def some(n):
        return [(x, y, x + rnd.randint(0, 9), y + rnd.randint(0, 9)) for x, y in ((rnd.randint(-9, 20), rnd.randint(-9, 20)) for _ in range(n))]

    a, b = some(12), some(12)
    cells = [{(x, y) for r in s for x in range(r[0], r[2]) for y in range(r[1], r[3])} for s in (a, b)]
    want = {"union": cells[0] | cells[1], "intersection": cells[0] & cells[1], "symmetric_difference": cells[0] ^ cells[1], "difference": cells[0] - cells[1]}
    one = [sorted(map(tuple, bands.union_bands(boxes(spark, *a, *b), KEYS, tile=5, wide=w).collect())) for w in (True, False)]
    assert one[0] == one[1]
    for name, cover in want.items():
        got = boolean.boolean(name, boxes(spark, *a), boxes(spark, *b), KEYS, tile=7).collect()
        flat = [(x, y) for r in got for x in range(r.x1, r.x2) for y in range(r.y1, r.y2)]
        assert len(flat) == len(set(flat)) and set(flat) == cover


def test_a_turned_rectangle_raises(spark):
    with pytest.raises(Exception, match="ends before it starts"):
        bands.union_bands(boxes(spark, (5, 0, 3, 9)), KEYS).collect()


def test_polygons_and_the_guard(spark):
    ell = polygon(spark, [(0, 0), (100, 0), (100, 40), (40, 40), (40, 100), (0, 100), (0, 0)])
    assert area(boolean.boolean_polygons("union", ell, ell, KEYS)) == 6400
    triangle = polygon(spark, [(0, 0), (10, 0), (0, 10), (0, 0)])
    with pytest.raises(boolean.NonManhattanError) as e:
        boolean.boolean_polygons("union", triangle, ell, KEYS)
    assert (e.value.operand, e.value.index) == ("left", 0)


def test_point_functions(spark):
    df = polygon(spark, [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(0, 0), (4, 0), (0, 3)])
    rows = df.select(P.signed_area(F.col("points")), P.polygon_area(F.col("points")), P.edge_count(F.col("points")), P.is_rectangle(F.col("points")), P.contains(F.col("points"), F.lit(1), F.lit(1))).collect()
    assert [tuple(r) for r in rows] == [(-100, 100, 4, True, True), (6, 6, 2, False, True)]
    assert len(df.select(P.closed(F.col("points"))).collect()[1][0]) == 4
    turned = df.select(P.counter_clockwise(F.col("points")).alias("p")).select(P.signed_area(F.col("p"))).collect()
    assert [r[0] for r in turned] == [100, 6]


@pytest.mark.parametrize(("size", "limit", "want"), [((50, 50), 50, 0), ((49, 60), 50, 1), ((30, 40), 50, 2)])
def test_width(spark, size, limit, want):
    assert drc.width(boxes(spark, (0, 0, *size)), KEYS, limit).count() == want


@pytest.mark.parametrize(
    ("rects", "limit", "want"),
    [
        ([(0, 0, 100, 100), (50, 0, 150, 100)], 20, 0),
        ([(0, 0, 100, 100), (100, 0, 200, 100)], 20, 0),
        ([(0, 0, 100, 100), (110, 0, 210, 100)], 20, 1),
        ([(0, 0, 100, 100), (110, 0, 210, 100), (90, 0, 120, 100)], 20, 0),
        ([(0, 0, 100, 100), (103, 104, 200, 200)], 5, 0),
        ([(0, 0, 100, 100), (103, 104, 200, 200)], 6, 1),
        ([(1080, 0, 1420, 2000), (1305, 1885, 24765, 2115), (24535, 1885, 24765, 2465), (24535, 2235, 25655, 2465)], 230, 0),
    ],
)
def test_self_space(spark, rects, limit, want):
    assert drc.self_space(boxes(spark, *rects), KEYS, limit).count() == want


@pytest.mark.parametrize(("inner", "want"), [((50, 50, 150, 150), 0), ((30, 50, 150, 150), 1), ((10, 20, 195, 185), 4)])
def test_enclosure(spark, inner, want):
    assert drc.enclosure(boxes(spark, (0, 0, 200, 200)), boxes(spark, inner), KEYS, 50).count() == want


@pytest.mark.parametrize("turned", [False, True])
def test_enclosure_does_not_depend_on_the_tile(spark, turned):
    """One margin over many tile borders is one row; an edge that lies on a border still parts it."""
    turn = bands.transpose if turned else (lambda x: x)
    for outer, inner, rows in (((0, 0, 100, 20000), [(5, 100, 60, 19000)], 1), ((0, 0, 100, 20000), [(5, 100, 60, 8192), (5, 8192, 50, 16384)], 2), ((0, 0, 100, 20000), [(5, 100, 60, 12288), (40, 12288, 60, 19000), (90, 300, 96, 400)], 4)):
        sets = []
        for tile in (4096, 8192, 1 << 20):
            found = drc.enclosure(turn(boxes(spark, outer)), turn(boxes(spark, *inner)), KEYS, 10, tile)
            sets.append({tuple(r) for r in found.select(*drc.PAIR).collect()})
        assert sets[0] == sets[1] == sets[2] and len(sets[0]) == rows, sets


def test_sizing(spark):
    ell = boxes(spark, (0, 0, 200, 100), (0, 100, 100, 200))
    assert area(sizing.sized(ell, KEYS, 10)) == 38400
    assert area(sizing.sized(ell, KEYS, -20)) == 15600
    assert area(sizing.sized(ell, KEYS, 0)) == 30000


def test_components_and_holes(spark):
    chain = boxes(spark, (0, 0, 10, 10), (10, 0, 20, 10), (20, 10, 30, 20), (500, 0, 510, 10)).withColumn("n", F.col("x1"))
    got = {r.n: r.component for r in connectivity.components(chain, KEYS, "n").collect()}
    assert got == {0: 0, 10: 0, 20: 20, 500: 500}
    ring = boolean.boolean("difference", boxes(spark, (0, 0, 300, 300)), boxes(spark, (100, 100, 200, 200)), KEYS)
    assert [tuple(r) for r in connectivity.holes(ring, KEYS).collect()] == [(0, 100, 100, 200, 200, 10000)]


def test_contains(spark):
    box = polygon(spark, [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)])
    points = spark.createDataFrame([(0, 50, 50), (0, 0, 50), (0, 100, 100), (0, 101, 50)], "r int, x int, y int")
    assert {(p.x, p.y) for p in connectivity.contained(points, box, KEYS).collect()} == {(50, 50), (0, 50), (100, 100)}


def test_edge_checks(spark):
    u = polygon(spark, [(0, 0), (300, 0), (300, 200), (200, 200), (200, 100), (100, 100), (100, 200), (0, 200), (0, 0)])
    assert edges.notch(u, KEYS, 101).count() > 0
    assert edges.grid(polygon(spark, [(-100, -50), (-103, 0), (0, 0)]), KEYS, 10, 10).collect()[0].e2x1 == -90
    slanted = polygon(spark, [(0, 0), (10, 0), (3, 7), (0, 0)])
    assert edges.angle(slanted, KEYS, [0, 90]).count() == 2
    a, b = polygon(spark, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), polygon(spark, [(13, 14), (20, 14), (20, 20), (13, 20), (13, 14)])
    assert edges.separation(a, b, KEYS, 6).count() == 4 and edges.separation(a, b, KEYS, 5).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], BOX)
    assert bands.union_bands(none, KEYS).count() == 0
    assert drc.self_space(none, KEYS, 5).count() == 0
    assert boolean.boolean("union", none, boxes(spark, (0, 0, 1, 1)), KEYS).count() == 1


def test_large_bands_stand_in_few_buckets(spark):
    """A plane of 100,000 units and small boxes around it: a handful of rows each, and the gaps that a comparison of all pairs finds."""
    rnd = random.Random(2)
    small = [(x, y, x + 10, y + 10) for x, y in ((rnd.choice([-13, -12, 100_003, 100_002, rnd.randint(0, 99_000)]), rnd.choice([-14, -13, 100_001, 100_003])) for _ in range(60))]
    rects = [(0, 0, 100_000, 100_000), *small, (-3000, 0, -2990, 90_000), (-2987, 10, -2960, 80_000)]
    df = boxes(spark, *rects)
    on = drc.leveled(df, 256, 4)
    assert drc.placed(on.withColumn("level", F.col("own")), 256, 4).count() <= 4 * len(rects)
    got = {tuple(r) for r in drc.self_space(df, KEYS, 4).select(*drc.PAIR).collect()}
    union = [(r.x1, r.y1, r.x2, r.y2) for r in bands.union_bands(df, KEYS).collect()]
    near = 0
    for i, p in enumerate(union):
        for q in union[i + 1 :]:
            gx, gy = max(p[0], q[0]) - min(p[2], q[2]), max(p[1], q[1]) - min(p[3], q[3])
            if (gx, gy) != (0, 0) and gx != 0 and gy != 0 and max(gx, gy) > 0 and max(gx, 0) ** 2 + max(gy, 0) ** 2 < 16:
                near += 1
    assert 5 < len(got) <= near


@pytest.mark.parametrize("most", [7, 1 << 19])
def test_links_are_joined_where_they_are_found(spark, most):
    """Chains and a ring of rectangles over many buckets, in two keys (one null), with nodes of several rectangles: labels took rounds over all nodes and links."""
    rows = [(None, 40 - i, 3000 * i, 0, 3000 * i + 3000, 10) for i in range(40)]
    rows += [(1, i, 10 * i, 10 * i, 10 * i + 10, 10 * i + 10) for i in range(20)]  # corners alone don't connect
    rows += [(1, n, x, 9000, x + 5, 9005) for n, x in ((50, 0), (51, 5), (50, 70000), (52, 70005), (53, 90000))]
    df = spark.createDataFrame(rows, "k int, n int, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    found = connectivity.labelled(df, ["k"], "n", most)
    assert found.count() == len(rows)
    want = {(None, i): 1 for i in range(1, 41)} | {(1, i): i for i in range(20)} | {(1, 50): 50, (1, 51): 50, (1, 52): 50, (1, 53): 53}
    assert {(r.k, r.n): r.component for r in found.collect()} == want
    assert sorted(map(tuple, connectivity.components(df, ["k"], "n").collect()), key=str) == sorted(((*k, c) for k, c in want.items()), key=str)


def test_components_within_one_chunk_need_no_rounds(spark, monkeypatch):
    """One bucket, whose links one task finds."""
    chain = spark.createDataFrame([(0, i, 9 * i, 0, 9 * i + 9, 5) for i in range(400)], "k int, n int, x1 bigint, y1 bigint, x2 bigint, y2 bigint").coalesce(1)
    monkeypatch.setattr(connectivity, "label_components", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.component for r in connectivity.components(chain, ["k"], "n").collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("margin", [0, 3])
def test_near_meets_each_close_pair_once(spark, margin):
    """Long thin rectangles stand in long thin buckets: what only probes those isn't tried against all else that does, which made wire grids quadratic."""
    rnd = random.Random(margin)
    sides = (2, 9, 70, 900)
    rects = [(x, y, x + rnd.choice(sides), y + rnd.choice(sides)) for x, y in ((rnd.randint(-500, 900), rnd.randint(-500, 900)) for _ in range(80))]
    df = boxes(spark, *rects).distinct()
    close = lambda a, b: all(max(a[i], b[i]) - min(a[i + 2], b[i + 2]) <= margin for i in (0, 1))
    found = [(tuple(r[:4]), tuple(r[4:])) for r in drc.near(df, df, KEYS, 16, margin).select(*(f"{s}.{c}" for s in "xy" for c in bands.BOX)).collect()]
    assert len(found) == len(set(found))
    assert {p for p in found if close(*p)} == {(a, b) for a in set(rects) for b in set(rects) if close(a, b)}
    rows = boxes(spark, *((0, 700 * r, 140_000, 700 * r + 230) for r in range(40)), *((9_000 * c, 700 * r + 300, 9_000 * c + 200, 700 * r + 350) for r in range(40) for c in range(15)))
    met = drc.near(rows, rows, KEYS, 1840, 230).count()
    assert met < 40 * rows.count(), met  # 640 rectangles, most of them in one bucket as wide as the rows
