"""Compact trapezoids, differences of points, and arrays among placements."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import compact
from tessella.operators import hierarchy

# twice the area of every type in a box of width 60 and height 20 (0-7, 16, 18, 20-23), or of width 12 and height 60, worked out by hand
WIDE = {0: 2000, 1: 2000, 2: 2000, 3: 2000, 4: 1600, 5: 1600, 6: 1600, 7: 1600, 16: 2400, 17: 7200, 18: 2256, 20: 1200, 21: 1200, 22: 1200, 23: 1200, 24: 3600}
TALL = {8: 864, 9: 1296, 10: 1296, 11: 1296, 12: 1296, 13: 1296, 14: 1152, 15: 1152, 19: 224}  # 144 less four corners of 8, twice


def rings(spark, rows):
    df = spark.createDataFrame(rows, "kind int, x int, y int, w int, h int")
    made = df.select("kind", compact.compact_trapezoid(F.col("kind"), F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p"))
    return {r.kind: [(p.x, p.y) for p in r.p] for r in made.collect()}


def twice_area(ring):
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(ring, ring[1:])))


def test_every_type_of_trapezoid(spark):
    got = rings(spark, [(k, 100, -50, 60, 20) for k in WIDE] + [(k, 7, 9, 12, 60) for k in TALL])
    assert set(got) == set(range(25)) and all(r[0] == r[-1] for r in got.values())
    assert {k: twice_area(r) for k, r in got.items()} == WIDE | TALL
    assert got[0] == [(120, -50), (160, -50), (160, -30), (100, -30), (120, -50)]
    assert got[13] == [(7, 9), (19, 9), (19, 57), (13, 69), (7, 57), (7, 9)]
    assert rings(spark, [(22, 0, 0, 5, 3), (18, 0, 0, 9, 7)])[22][2] == (2, 3)
    for bad in ((25, 0, 0, 1, 1), (-1, 0, 0, 1, 1), (16, 2147483647, 0, 1, 1)):
        with pytest.raises(Exception):  # noqa: B017
            rings(spark, [bad])


def test_differences_and_back(spark):
    rings_ = [[(0, 0), (5, 0), (5, 7), (0, 0)], [(3, 4), (1, 1)], [(9, 9)], [(2147483647, 0), (2147483646, 5), (2147483647, 0)]]
    df = spark.createDataFrame([(i, [tuple(p) for p in r]) for i, r in enumerate(rings_)], "i int, p array<struct<x:int,y:int>>")
    d = compact.deltas(F.col("p"))
    closed = (F.size("p") >= 3) & (F.get("p", F.lit(0)) == F.element_at("p", -1))
    got = df.select("i", d.alias("d"), compact.from_deltas(F.get("p", F.lit(0)), d, closed).alias("q")).orderBy("i").collect()
    assert [[(p.x, p.y) for p in r.q] for r in got] == rings_ and [len(r.d) for r in got] == [2, 1, 0, 1]
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([([(-2147483648, 0), (2147483647, 0)],)], "p array<struct<x:int,y:int>>").select(compact.deltas(F.col("p"))).collect()


def test_steps_must_be_whole(spark):
    df = lambda x: spark.createDataFrame([((1, 1), (1 + x, 10), 3)], "a struct<x:int,y:int>, b struct<x:int,y:int>, n int").select(compact.array_step(F.col("a"), F.col("b"), F.col("n")).alias("s")).first().s
    assert tuple(df(6)) == (2, 3) and tuple(df(-6)) == (-2, 3)
    with pytest.raises(Exception, match="whole number"):
        df(7)


def test_arrays_give_their_placements_back(spark):
    rnd = random.Random(3)
    placed = [("a", 10 + 7 * i, -5 + 11 * j) for i in range(6) for j in range(4)] + [("b", 3, 3)] + [("b", 5, 5)] * 3
    placed += [("c", rnd.randint(0, 12), rnd.randint(0, 12)) for _ in range(120)] + [("d", 4 * i, 0) for i in range(5)] + [("d", 100 + 9 * i, 0) for i in range(4)]
    df = spark.createDataFrame(placed, "k string, x long, y long").repartition(3)
    found = compact.arrays(df, ["k"])
    assert sorted(map(tuple, compact.expanded(found, ["k"]).collect())) == sorted(placed)
    rows = {tuple(r) for r in found.where("k in ('a', 'b', 'd')").collect()}
    assert ("a", 10, -5, 6, 4, 7, 11) in rows and ("b", 5, 5, 3, 1, 0, 0) in rows and ("d", 0, 0, 5, 1, 4, 0) in rows
    assert sum(r[0] == "a" for r in rows) == 1 and sum(r[0] == "d" for r in rows) <= 3


def test_cells_under_their_tops(spark):
    refs = [("f", "a", "b", False, 1, 10, 0), ("f", "a", "b", False, 1, 10, 0), ("f", "b", "c", True, 0, 0, 5), ("f", "a", "c", False, 0, 7, 7), ("g", "a", "z", False, 0, 1, 1)]
    kinds = "file string, cell string, ref_cell string, mirror boolean, turn int, x long, y long"
    tops = spark.createDataFrame([("f", "a"), ("g", "a")], "file string, top string")
    got = {tuple(r) for r in hierarchy.placements(tops, spark.createDataFrame(refs, kinds)).collect()}
    assert got == {("f", "a", "a", False, 0, 0, 0, 1), ("f", "a", "b", False, 1, 10, 0, 2), ("f", "a", "c", True, 1, 5, 0, 2), ("f", "a", "c", False, 0, 7, 7, 1), ("g", "a", "a", False, 0, 0, 0, 1), ("g", "a", "z", False, 0, 1, 1, 1)}
    flat = hierarchy.flattened(spark.createDataFrame([("f", "a", "c", True, 1, 5, 0, 2)], "file string, top string, cell string, mirror boolean, turn int, x long, y long, n long"), spark.createDataFrame([("f", "c", 1, 0, 0, 2, 1)], "file string, cell string, layer int, x1 long, y1 long, x2 long, y2 long"))
    assert [tuple(r) for r in flat.collect()] == [("f", "a", "c", 1, 5, 0, 6, 2, 2)]
    with pytest.raises(ValueError, match="contains itself"):
        hierarchy.placements(tops, spark.createDataFrame([("f", "a", "b", False, 0, 1, 0), ("f", "b", "a", False, 0, 1, 0)], kinds))
