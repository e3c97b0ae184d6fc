"""Batched sweeps against rasters: several groups, pieces of few rows, coordinates too wide for one number."""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pyarrow as pa
import pytest

from tessella.functions import sweeps
from tessella.operators import boolean, drc


def rects(groups: int, n: int, far: int = 1):
    r = np.random.default_rng(7)
    group = np.sort(r.integers(0, groups, n))
    group = np.unique(group, return_inverse=True)[1]
    x1, y1 = r.integers(-9, 20, n), r.integers(-9, 20, n)
    return group, x1 * far, y1, (x1 + r.integers(1, 9, n)) * far, y1 + r.integers(1, 9, n), r.integers(0, 2, n)


def raster(group, x1, y1, x2, y2, side=None, far=1):
    out = np.zeros((2, group.max() + 1, 50, 50), bool)
    for i, g in enumerate(group):
        out[0 if side is None else side[i], g, x1[i] // far + 10 : x2[i] // far + 10, y1[i] + 10 : y2[i] + 10] = True
    return out


@pytest.mark.parametrize("far", [1, 1 << 56])
@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_bands_cover_what_the_raster_has(most, far):
    r = rects(5, 80, far)
    a, b = raster(*r, far=far)
    for name, keep in sweeps.KEEP.items():
        found = [np.concatenate(c) for c in zip(*(sweeps.towers(c, keep(c.a, c.b)) for c in sweeps.cells(*r, most=most)))]
        assert (raster(*found, far=far)[0] == keep(a, b)[: found[0].max() + 1]).all()
        area = ((found[3] // far - found[1] // far) * (found[4] - found[2])).sum()
        assert area == keep(a, b).sum()  # disjoint


def test_margins_lie_within_runs_of_the_outer_side():
    one = lambda *rows: [np.array(c) for c in zip(*rows)]
    r = one((0, 0, 0, 30, 10, 0), (0, 2, 4, 9, 10, 1), (0, 20, 4, 28, 10, 1), (1, 0, 0, 9, 9, 1))
    (cells,) = sweeps.cells(*r)
    assert sorted(zip(*(c.tolist() for c in sweeps.margins(cells, 3)))) == [(0, 0, 4, 2, 10), (0, 28, 4, 30, 10)]
    assert sorted(zip(*(c.tolist() for c in sweeps.margins(cells, 12)))) == [(0, 0, 4, 2, 10), (0, 28, 4, 30, 10)]


def test_groups_that_span_batches_are_swept_once():
    group, *box, side = rects(6, 300)
    n = np.append(1, np.where(group[1:] == group[:-1], 2, 1))
    g = pa.StructArray.from_arrays([pa.array([f"k{i}" for i in group])], names=["k"])
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (n, side, *box)] + [g], names=["n", "side", *sweeps.BOX, "g"])
    result = lambda c: sweeps.towers(c, c.a)
    rows = lambda cut, **kw: sorted(tuple(r.items()) for b in sweeps.sweeper(result, **kw)(whole.slice(i, cut) for i in range(0, 300, cut)) for r in ({**x, "g": x["g"]["k"]} for x in b.to_pylist()))
    assert rows(300) == rows(7, rows=20) == rows(50, rows=1)


def test_rows_of_slabs_stay_in_batches(spark):
    a = spark.createDataFrame([(0, 0, 0, 9, 9)], "r int, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    for found in (boolean.boolean("difference", a, a, ["r"]), drc.enclosure(a, a.selectExpr("r", "x1 + 1 as x1", "y1", "x2", "y2"), ["r"], 3)):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            found.explain()
        assert "MapInArrow" in out.getvalue() and "Generate inline" not in out.getvalue() and "SortMergeJoin [g#" not in out.getvalue()
