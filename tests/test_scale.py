"""What is shuffled: rows before they multiply, and no more often than needed."""

from __future__ import annotations

import contextlib
import io

import pytest

from tessella.operators import bands, boolean, connectivity, edges
from tessella.sources import dxf

BOX = "r int, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def exchanges(df) -> list[str]:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return [line.strip(" +-:|") for line in out.getvalue().splitlines() if "Exchange hashpartitioning" in line]


def grid(spark):
    return spark.createDataFrame([(r, x, y, x + 7, y + 6) for r in (None, 0, 1) for x in range(0, 40, 5) for y in range(0, 40, 4)], BOX)


@pytest.mark.parametrize("operation", ["intersection", "difference", "symmetric_difference", "union"])
def test_slabs_stay_in_the_task_of_their_tile(spark, operation):
    a = grid(spark)
    found = boolean.boolean(operation, a, a.selectExpr("r", "x1 + 2 AS x1", "y1 + 3 AS y1", "x2 + 2 AS x2", "y2 + 3 AS y2"), ["r"], tile=16)
    moved = exchanges(found)
    # rectangles and their edges by tile, bands by their x range: slabs and their events aren't shuffled
    assert len(moved) == 3 and sum("(g#" in x for x in moved) == 2, moved
    assert {row.r for row in found.collect()} == {None, 0, 1}


def test_rectangles_of_polygons_stay_in_the_task_of_their_polygon(spark):
    rows = [(r, i, [{"x": 0, "y": 0}, {"x": 9, "y": 0}, {"x": 9, "y": 4}, {"x": 5, "y": 4}, {"x": 5, "y": 8}, {"x": 0, "y": 8}]) for r in (None, 3) for i in range(3)]
    found = bands.polygon_bands(spark.createDataFrame(rows, "r int, poly_idx int, points array<struct<x:int,y:int>>"), ["r"])
    assert len(exchanges(found)) == 2
    assert sorted(found.collect(), key=str) == sorted([(r, i, *box) for r in (None, 3) for i in range(3) for box in ((0, 0, 9, 4), (0, 4, 5, 8))], key=str)


def test_edges_as_long_as_the_plane_cross_exactly(spark):
    """Products of coordinate differences beyond 63 bits, which failed as expressions; distances are worked out a batch at a time."""
    m = 2**31 - 1
    ring = [(-m, -m), (m, m), (m, -m), (-m, m), (-m, -m)]  # the diagonals cross
    p = spark.createDataFrame([(0, 0, [{"x": x, "y": y} for x, y in ring])], "r int, poly_idx int, points array<struct<x:int,y:int>>")
    found = edges.width(p, ["r"], 2.0**33)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain()
    assert "ArrowEvalPython" in out.getvalue()
    assert [tuple(row)[1:] for row in found.collect()] == [(m, m, m, -m, -m, m, -m, -m)]


def test_whole_dxf_texts_are_dealt_once_before_they_are_cut(spark):
    body = "0\nSECTION\n2\nENTITIES\n" + "0\nLINE\n8\n1\n10\n0\n20\n0\n11\n5\n21\n5\n" * 3 + "0\nENDSEC\n0\nEOF\n"
    found = dxf.entities(dxf.groups(spark.createDataFrame([("a", body), ("b", body)], "file string, text string")))
    assert len(exchanges(found)) == 1
    assert sorted((r.file, r.entity, r.kind, len(r.groups)) for r in found.collect()) == [(f, n, "LINE", 6) for f in "ab" for n in (2, 3, 4)]


def test_polygons_in_their_buckets_are_not_sent_to_the_driver(spark):
    """A table counts as small by the size of its file, however many points and buckets its polygons have."""
    corner = lambda x, y: f"named_struct('x', cast({x} as int), 'y', cast({y} as int))"
    ring = ", ".join(corner(*p) for p in (("id * 10 + 5", "0"), ("id * 10 + 10", "5"), ("id * 10 + 5", "10"), ("id * 10", "5"), ("id * 10 + 5", "0")))
    kites = spark.range(30).selectExpr("id % 3 as r", f"array({ring}) as points")
    found = connectivity.contained(spark.range(30).selectExpr("id % 3 as r", "id * 10 + 5 as x", "5L as y"), kites, ["r"])
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain()
    assert "HashedRelationBroadcastMode" not in out.getvalue()
    assert len([x for x in exchanges(found) if "hashpartitioning(g#" in x]) == 4  # each side of both joins once
    assert found.count() == 30
