"""Sweeps over the rectangles of many groups, whole batches at a time in NumPy: where one or both sides cover the slabs between neighbouring heights of a group.

As window functions a rectangle was a row in each slab that it crosses, sorted several times; here those rows live in flat arrays, `most` or so at a time. A task holds the
rectangles of one group, forty bytes each, however many slabs they cross.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

MOST = 1 << 20  # rows of rectangles in slabs at a time
BOX = ("x1", "y1", "x2", "y2")
KEEP = {"union": np.logical_or, "intersection": np.logical_and, "symmetric_difference": np.logical_xor, "difference": lambda a, b: a & ~b}


class Cells(NamedTuple):
    """Where coverage may change: slab, x and the sides a and b that cover from there to the next x. Slab i lies between heights i and i + 1, in the group of its height."""

    slab: np.ndarray
    x: np.ndarray
    a: np.ndarray
    b: np.ndarray
    heights: np.ndarray
    of: np.ndarray


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i all numbers from lo to hi, without hi: i and the number."""
    many = hi - lo
    return np.repeat(np.arange(len(lo)), many), np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)


def _changes(slab: np.ndarray, x1: np.ndarray, x2: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """slab, x, a, b in that order, one for each x where something starts or ends."""
    low, first = int(x1.min()), int(slab.min())
    wide = int(x2.max()) - low + 1
    if (int(slab.max()) - first + 1) * wide < 1 << 60:  # slab, x and what happens there fit in one number
        at = ((slab - first) * wide - low) * 4 + side * 2
        events = np.sort(np.concatenate((at + x1 * 4, at + x2 * 4 + 1)))
        what, spot = events & 3, events >> 2
        last = np.append(spot[1:] != spot[:-1], True)
        slab, x = spot[last] // wide + first, spot[last] % wide + low
    else:
        slab, x, what = np.concatenate((slab, slab)), np.concatenate((x1, x2)), np.concatenate((side * 2, side * 2 + 1))
        order = np.lexsort((x, slab))
        slab, x, what = slab[order], x[order], what[order]
        last = np.append((slab[1:] != slab[:-1]) | (x[1:] != x[:-1]), True)
        slab, x = slab[last], x[last]
    step = 1 - 2 * (what & 1)
    a, b = (np.cumsum(np.where(what >> 1 == n, step, 0))[last] > 0 for n in (0, 1))  # 0 again at the end of each slab
    return slab, x, a, b


def cells(group: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, side: np.ndarray, most: int = MOST) -> Iterator[Cells]:
    """The cells of groups, numbered without a gap, in pieces of whole slabs."""
    y, of = np.concatenate((y1, y2)), np.concatenate((group, group))
    order = np.lexsort((y, of))
    y, of = y[order], of[order]
    new = np.append(True, (y[1:] != y[:-1]) | (of[1:] != of[:-1]))
    at = np.empty(len(y), np.int64)
    at[order] = np.cumsum(new) - 1
    heights, of = y[new], of[new]
    lo, hi = at[: len(y1)], at[len(y1) :]
    crossed = np.cumsum(np.cumsum(np.bincount(lo, minlength=len(heights)) - np.bincount(hi, minlength=len(heights))))
    cuts = np.unique(np.append(np.searchsorted(crossed, np.arange(0, crossed[-1], most)), len(heights)))
    cuts[0] = 0
    for begin, end in zip(cuts[:-1], cuts[1:]):
        own = np.flatnonzero((lo < end) & (hi > begin)) if len(cuts) > 2 else np.arange(len(lo))
        i, slab = _spread(np.maximum(lo[own], begin), np.minimum(hi[own], end))
        if len(i):
            i = own[i]
            yield Cells(*_changes(slab, x1[i], x2[i], side[i]), heights, of)


def spans(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of cells begin and end; the last cell of a slab is never kept."""
    before = np.append(False, keep[:-1])
    return np.flatnonzero(keep & ~before), np.flatnonzero(~keep & before)


def towers(found: Cells, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, x1, y1, x2, y2 of the runs of kept cells, joined with those of the same x range in the next slab."""
    begin, end = spans(keep)
    slab, x1, x2 = found.slab[begin], found.x[begin], found.x[end]
    order = np.lexsort((slab, x2, x1))
    slab, x1, x2 = slab[order], x1[order], x2[order]
    first = np.flatnonzero(np.append(True, (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1]) | (slab[1:] != slab[:-1] + 1))[: len(slab)])
    last = np.append(first[1:], len(slab))[: len(first)] - 1
    # the next slab is of the same group: between groups one height begins no slab
    return found.of[slab[first]], x1[first], found.heights[slab[first]], x2[first], found.heights[slab[last] + 1]


def margins(found: Cells, limit: int) -> tuple[np.ndarray, ...]:
    """group, xa, y1, xb, y2: in every slab the distances under limit from the ends of a run of a to those of each run of a and b in it."""
    outer, inner = spans(found.a), spans(found.a & found.b)
    run = np.searchsorted(outer[0], inner[0], "right") - 1  # in the run of a that began last
    ends = (found.x[outer[0][run]], found.x[inner[0]]), (found.x[inner[1]], found.x[outer[1][run]])
    slab, xa, xb = np.tile(found.slab[inner[0]], 2), *(np.concatenate(c) for c in zip(*ends))
    near = xb - xa < limit
    slab = slab[near]
    return found.of[slab], xa[near], found.heights[slab], xb[near], found.heights[slab + 1]


def sweeper(result: Callable[[Cells], tuple[np.ndarray, ...]], rows: int = 1 << 15, most: int = MOST) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over n (1 at the first row of a group), side, x1, y1, x2, y2, g, the rows of a group one after the other: what a result gives of its cells, as g and four numbers."""

    def of_groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n, side, *box = (table.column(c).to_numpy().astype(np.int64, copy=False) for c in ("n", "side", *BOX))
        start = np.flatnonzero(n == 1)
        heads = table.column("g").take(pa.array(start)).combine_chunks()
        for found in cells(np.cumsum(n == 1) - 1, *box, side, most):
            group, *numbers = result(found)
            if len(group):
                yield pa.RecordBatch.from_arrays([heads.take(pa.array(group)), *(pa.array(c) for c in numbers)], names=["g", *BOX])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, rows
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                table = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(table.column("n").to_numpy() == 1)[-1])
                if cut:
                    yield from of_groups(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), table.num_rows - cut
                enough = max(rows, 2 * size)
        if size:
            yield from of_groups(pa.Table.from_batches(held))

    return run
