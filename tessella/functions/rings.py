"""Functions over arrays of points (x, y), whole batches at a time in NumPy: measures, circles and polygons with offset edges.

As expressions over arrays these cost tens of microseconds a polygon, since functions over elements aren't compiled. Points of a batch lie one after the other in flat
arrays; a ring is a stretch of them. Results are those of the expressions in `points` and `curves`: sums are exact, and what is out of 32 or 64 bits raises.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.curves import TURN

POINTS = "array<struct<x:int,y:int>>"
MEASURES = "x1 long, y1 long, x2 long, y2 long, area long, edges long, rectangle boolean"


class Rings(NamedTuple):
    """Points of rings one after the other, and where each ring starts (one more at the end)."""

    x: np.ndarray
    y: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self) -> np.ndarray:
        """The ring of each point."""
        return np.repeat(np.arange(len(self.first) - 1), self.sizes())

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rings that have points, and their first and last points."""
        some = np.flatnonzero(self.sizes())
        return some, self.first[some], self.first[some + 1] - 1

    def after(self) -> np.ndarray:
        """The point after each, after the last the first."""
        some, head, tail = self.ends()
        out = np.arange(1, len(self.x) + 1)
        out[tail] = head
        return out

    def kept(self, keep: np.ndarray) -> Rings:
        """Without some points."""
        return Rings(self.x[keep], self.y[keep], np.append(0, np.cumsum(keep))[self.first])

    def sums(self, values: np.ndarray) -> np.ndarray:
        upto = np.append(np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype))
        return upto[self.first[1:]] - upto[self.first[:-1]]


def _read(lists: pa.Array) -> tuple[Rings, np.ndarray]:
    """Rings of an Arrow array, and which of them are known: none that is null or has a null in it."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    x, y = (flat.flatten()[i] for i in (0, 1)) if len(flat) else (pa.array([], pa.int32()),) * 2
    known = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    rings = Rings(*(pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y)), np.append(0, np.cumsum(n)))
    if x.null_count or y.null_count:
        known[rings.of()[(x.is_null().to_numpy(zero_copy_only=False)) | (y.is_null().to_numpy(zero_copy_only=False))]] = False
    return rings, known


def _written(rings: Rings, known: np.ndarray) -> pa.Array:
    for c in (rings.x, rings.y):
        if len(c) and (c.max() >= 1 << 31 or c.min() < -(1 << 31)):
            raise OverflowError("a coordinate is out of 32 bits")
    flat = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in (rings.x, rings.y)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(rings.first.astype(np.int32)), flat, mask=pa.array(~known)) if len(known) else pa.array([], pa.list_(flat.type))


def _doubled(rings: Rings) -> np.ndarray:
    """Twice the signed area of the closed rings; Python's integers where 63 bits may not hold it."""
    to = rings.after()
    x, y = rings.x, rings.y
    if len(x) and (float(abs(x).max()) * float(abs(y).max()) * 2 * float(rings.sizes().max())) >= 2.0**62:
        x, y = x.astype(object), y.astype(object)
    return rings.sums(x * y[to] - x[to] * y)


def _opened(rings: Rings) -> Rings:
    """Without a last point that is the first again."""
    some, head, tail = rings.ends()
    keep = np.ones(len(rings.x), bool)
    keep[tail] = ~((rings.x[head] == rings.x[tail]) & (rings.y[head] == rings.y[tail]))
    return rings.kept(keep)


def _closed(rings: Rings) -> Rings:
    """Rings of three points and more with the first one at the end."""
    some, head, tail = rings.ends()
    open_ = (rings.sizes()[some] >= 3) & ((rings.x[head] != rings.x[tail]) | (rings.y[head] != rings.y[tail]))
    at, head = tail[open_] + 1, head[open_]
    more = np.zeros(len(rings.first), np.int64)
    more[some[open_] + 1] = 1
    return Rings(np.insert(rings.x, at, rings.x[head]), np.insert(rings.y, at, rings.y[head]), rings.first + np.cumsum(more))


def _measure(lists: pa.Array) -> pa.Array:
    rings, known = _read(lists)
    n = rings.sizes()
    some, head, tail = rings.ends()
    box = []
    for c, f in ((rings.x, np.minimum), (rings.y, np.minimum), (rings.x, np.maximum), (rings.y, np.maximum)):
        to = np.zeros(len(n), np.int64)
        to[some] = f.reduceat(c, head) if len(head) else 0
        box.append(to)
    doubled = abs(_doubled(rings)) // 2
    area = np.where(n < 3, 0, doubled)
    x1, y1, x2, y2 = (np.repeat(b, n) for b in box)
    corner = ((rings.x == x1) | (rings.x == x2)) & ((rings.y == y1) | (rings.y == y2))
    to, step = rings.after(), np.ones(len(rings.x), bool)
    step[tail] = False  # a closing step isn't an edge, as in is_manhattan
    straight = ~step | (rings.x == rings.x[to]) | (rings.y == rings.y[to])
    shut = np.zeros(len(n), bool)
    shut[some] = (rings.x[head] == rings.x[tail]) & (rings.y[head] == rings.y[tail])
    whole = (box[2] - box[0]) * (box[3] - box[1]) == area
    rectangle = (n == 5) & shut & whole.astype(bool) & (rings.sums((~(corner & straight)).astype(np.int64)) == 0)
    boxed = pa.array(~(known & (n > 0)))
    columns = [*(pc.if_else(boxed, None, pa.array(b)) for b in box), _whole(area), pa.array(np.maximum(n - 1, 0).astype(np.int64)), pa.array(rectangle)]
    return pa.StructArray.from_arrays(columns, names=["x1", "y1", "x2", "y2", "area", "edges", "rectangle"], mask=pa.array(~known))


def measured(points: Column) -> Column:
    """Struct of the bounding box x1, y1, x2, y2 (null without points), area, edges and rectangle, as `points` has them one by one; null where a point is."""
    return F.arrow_udf(_measure, MEASURES)(points)


def _whole(values: np.ndarray) -> pa.Array:
    if values.dtype == object and any(abs(v) >= 1 << 63 for v in values):
        raise OverflowError("an area is out of 64 bits")
    return pa.array(values.astype(np.int64))


def _totals(lists: pa.Array) -> pa.Array:
    rings, known = _read(lists)
    return pa.StructArray.from_arrays([_whole(c) for c in (rings.sizes(), rings.sums(rings.x), rings.sums(rings.y), _doubled(rings))], names=["n", "x", "y", "doubled"], mask=pa.array(~known))


def totals(points: Column) -> Column:
    """Struct of the number n of points, the sums x and y of their coordinates, and twice the signed area of the closed ring (doubled)."""
    return F.arrow_udf(_totals, "n long, x long, y long, doubled long")(points)


def _bands(lists: pa.Array) -> pa.Array:
    rings, known = _read(lists)
    n, of, to = rings.sizes(), rings.of(), rings.after()
    _, _, tail = rings.ends()
    bent = (rings.x != rings.x[to]) & (rings.y != rings.y[to])
    bent[tail] = False  # the closing step, as in is_manhattan
    known &= (n < 3) | (rings.sums(bent.astype(np.int64)) == 0)
    lo, hi = np.minimum(rings.y, rings.y[to]), np.maximum(rings.y, rings.y[to])
    side = np.flatnonzero(known[of] & (n[of] >= 3) & (rings.x == rings.x[to]) & (lo < hi))
    x, of, lo, hi = rings.x[side], of[side], lo[side], hi[side]
    # heights of all rings in one order: those of a ring follow each other, and a side crosses the slabs between its two
    at = lambda y: (of << 32) + (y + (1 << 31))
    heights = np.unique(np.concatenate((at(lo), at(hi))))
    first, last = np.searchsorted(heights, at(lo)), np.searchsorted(heights, at(hi))
    many = last - first
    slab = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    cut = np.repeat(x, many)
    order = np.lexsort((cut, slab))
    slab, cut = slab[order], cut[order]
    fresh = np.append(True, slab[1:] != slab[:-1])[: len(slab)]
    start = np.flatnonzero(fresh)
    nth = np.arange(len(slab)) - np.repeat(start, np.diff(start, append=len(slab)))
    left = np.flatnonzero(nth[:-1] % 2 == 0)
    left = left[(slab[left] == slab[left + 1]) & (cut[left] < cut[left + 1])]
    y = lambda h: (h & ((1 << 32) - 1)) - (1 << 31)
    boxes = [cut[left], y(heights[slab[left]]), cut[left + 1], y(heights[slab[left] + 1])]
    found = np.bincount(heights[slab[left]] >> 32, minlength=len(n)) if len(left) else np.zeros(len(n), np.int64)
    flat = pa.StructArray.from_arrays([pa.array(b) for b in boxes], names=["x1", "y1", "x2", "y2"])
    offsets = pa.array(np.append(0, np.cumsum(found)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat, mask=pa.array(~known)) if len(n) else pa.array([], pa.list_(flat.type))


def bands(points: Column) -> Column:
    """The rectangles x1, y1, x2, y2 of a rectilinear ring by the even-odd rule, as `bands.polygon_bands` has them; null of any other."""
    return F.arrow_udf(_bands, "array<struct<x1:long,y1:long,x2:long,y2:long>>")(points)


def _deltas(lists: pa.Array) -> pa.Array:
    rings, known = _read(lists)
    some = rings.sizes() >= 3
    open_ = _opened(rings)
    # a ring of fewer than three points keeps its last one
    keep = np.where(some, open_.sizes(), rings.sizes())
    place = np.arange(len(rings.x)) - rings.first[:-1][rings.of()]
    own = rings.kept(place < keep[rings.of()])
    step = np.arange(len(own.x)) != own.first[:-1][own.of()] if len(own.x) else np.zeros(0, bool)
    moved = Rings(own.x - np.append(0, own.x)[: len(own.x)], own.y - np.append(0, own.y)[: len(own.y)], own.first).kept(step)
    return _written(moved, known)


def deltas(points: Column) -> Column:
    """What leads from each point to the next, without the closing point of a ring; beyond 32 bits raises."""
    return F.arrow_udf(_deltas, POINTS)(points)


def _walked(start: pa.Array, lists: pa.Array, closed: pa.Array) -> pa.Array:
    steps, known = _read(lists)
    begin = [start.field(c).cast(pa.int64()) for c in ("x", "y")]
    known &= start.is_valid().to_numpy(zero_copy_only=False) & begin[0].is_valid().to_numpy(zero_copy_only=False) & begin[1].is_valid().to_numpy(zero_copy_only=False)
    shut = pc.fill_null(closed, False).to_numpy(zero_copy_only=False).astype(np.int64)
    many = steps.sizes() + 1 + shut
    first = np.append(0, np.cumsum(many))
    of = steps.of()
    to = first[of] + 1 + np.arange(len(of)) - steps.first[of]
    out = []
    for c, s in zip((pc.fill_null(b, 0).to_numpy(zero_copy_only=False) for b in begin), (steps.x, steps.y)):
        upto = np.append(0, np.cumsum(s))
        x = np.repeat(c, many)
        x[to] += upto[1:] - upto[steps.first[of]]
        out.append(x)
    return _written(Rings(*out, first), known)


def from_deltas(start: Column, steps: Column, closed: Column) -> Column:
    """The points that deltas lead to from the first one, closed if that is asked for."""
    return F.arrow_udf(_walked, POINTS)(start, steps, closed)


def from_table(kind: Column, x: Column, y: Column, width: Column, height: Column, table: list[list[tuple[list[int], list[int]]]]) -> Column:
    """The closed ring of a kind: at each corner of its row of the table, how often width, height, their halves and their thirds (cut toward zero) are added to x and to y. A kind that isn't known raises."""
    most = max(map(len, table))
    sums = np.zeros((2, len(table), most + 1, 6), np.int64)
    for k, row in enumerate(table):
        for i, corner in enumerate([*row, row[0]]):
            sums[0, k, i], sums[1, k, i] = corner
    many = np.array([len(row) + 1 for row in table])

    def made(kind: pa.Array, *sizes: pa.Array) -> pa.Array:
        k = pc.fill_null(kind, -1).to_numpy(zero_copy_only=False)
        if len(k) and (k.min() < 0 or k.max() >= len(table)):
            raise ValueError(f"no such trapezoid: {k[(k < 0) | (k >= len(table))][0]}")
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in sizes])
        x, y, w, h = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in sizes)
        part = lambda v, n: np.sign(v) * (abs(v) // n)
        units = np.stack([w, h, part(w, 2), part(h, 2), part(w, 3), part(h, 3)], 1)[:, None, :]
        used = np.arange(most + 1) < many[k][:, None]
        spots = [(c[:, None] + (s[k] * units).sum(2))[used] for c, s in ((x, sums[0]), (y, sums[1]))]
        return _written(Rings(*spots, np.append(0, np.cumsum(many[k]))), known)

    return F.arrow_udf(made, POINTS)(*(c.cast("long") for c in (kind, x, y, width, height)))


def _units(values: np.ndarray) -> np.ndarray:
    """Whole numbers, cut toward zero."""
    if not np.isfinite(values).all():
        raise OverflowError("a coordinate is no number")
    return np.clip(np.trunc(values), -(2.0**40), 2.0**40).astype(np.int64)


def circle(cx: Column, cy: Column, radius: Column, segments: int, scale: float) -> Column:
    """The points of `curves.circle`: columns of doubles, cut to units."""
    angles = [i / float(segments) * TURN for i in range(segments + 1)]
    cos, sin = (np.array([f(a) for a in angles]) for f in (math.cos, math.sin))

    @F.arrow_udf(POINTS)
    def made(cx: pa.Array, cy: pa.Array, radius: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (cx, cy, radius)])
        x, y, r = (pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False)[:, None] for c in (cx, cy, radius))
        return _written(Rings(_units((x + r * cos) * scale).ravel(), _units((y + r * sin) * scale).ravel(), np.arange(len(x) + 1) * (segments + 1)), known)

    return made(cx, cy, radius)


# ---- sized polygons -------------------------------------------------------------------------------------------


def _rounded(values: np.ndarray) -> np.ndarray:
    """Halves go away from zero."""
    cut = np.trunc(values)
    return cut + np.where(abs(values - cut) >= 0.5, np.sign(values), 0.0)


class Corners(NamedTuple):
    """At every vertex its place, the edges that come (a) and go (b), and their lengths."""

    x: np.ndarray
    y: np.ndarray
    ax: np.ndarray
    ay: np.ndarray
    al: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    bl: np.ndarray


def _corners(rings: Rings) -> Corners:
    x, y = rings.x.astype(float), rings.y.astype(float)
    to = rings.after()
    bx, by = x[to] - x, y[to] - y
    bl = np.sqrt(bx * bx + by * by)
    come = np.empty(len(x), np.int64)
    come[to] = np.arange(len(x))
    return Corners(x, y, bx[come], by[come], bl[come], bx, by, bl)


def _crossing(c: Corners, by: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of both edges, moved outward, cross; the reasons are given at `curves._crossing`."""
    turn = c.ax * c.by - c.ay * c.bx
    onward = c.ax * c.bx + c.ay * c.by > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = c.x + by * (c.ax * c.bl - c.bx * c.al) / turn, c.y + by * (c.ay * c.bl - c.by * c.al) / turn
        straight = c.x + by * c.ay / c.al, c.y - by * c.ax / c.al
    return tuple(_rounded(np.where(turn != 0, u, np.where(onward, v, w))) for u, v, w in zip(crossed, straight, (c.x, c.y)))


def _square(c: Corners, by: float, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (*_crossing(c, by), np.ones(len(c.x), np.int64))


def _octagonal(c: Corners, by: float, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = abs(by) * (1.0 - 0.5**0.5)
    mx, my = _crossing(c, by)
    back = (c.ax * c.by == c.ay * c.bx) & (c.ax * c.bx + c.ay * c.by < 0)
    ends = [(_rounded(mx + way * cut / el * ex), _rounded(my + way * cut / el * ey)) for way, ex, ey, el in ((-1, c.ax, c.ay, c.al), (1, c.bx, c.by, c.bl))]
    both = [np.stack([np.where(back, m, e[i]) for e in ends], 1).ravel() for i, m in ((0, mx), (1, my))]
    keep = np.stack([np.ones(len(back), bool), ~back], 1).ravel()
    return both[0][keep], both[1][keep], np.where(back, 1, 2)


def _round(c: Corners, by: float, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.arctan2(-c.ax + 0.0, c.ay + 0.0)
    raw = np.arctan2(-c.bx + 0.0, c.by + 0.0) - start
    turn = np.where(raw < 0, raw + TURN, raw) if by > 0 else np.where(raw > 0, raw - TURN, raw)
    n = np.maximum(1, (float(max(segments, 1)) * abs(turn) / (TURN / 4)).astype(np.int64))
    many = n + 1
    at = np.repeat(np.arange(len(n)), many)
    step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    angle = start[at] + step / n[at] * turn[at]
    return _rounded(c.x[at] + abs(by) * np.cos(angle)), _rounded(c.y[at] + abs(by) * np.sin(angle)), many


CORNERS = {"square": _square, "octagonal": _octagonal, "round": _round}


def offset(points: Column, by: int, corner: str, segments: int) -> Column:
    """The closed ring with its edges moved outward (by > 0) or inward; null where nothing with an area is left."""
    made = CORNERS[corner]

    @F.arrow_udf(POINTS)
    def moved(lists: pa.Array) -> pa.Array:
        rings, known = _read(lists)
        n = rings.sizes()
        turned = (n >= 3) & (_doubled(rings) <= -2)
        open_ = _opened(rings)
        known &= open_.sizes() >= 3
        # clockwise rings are read backwards
        of, place = open_.of(), np.arange(len(open_.x))
        place = np.where(turned[of], open_.first[of] + open_.first[of + 1] - 1 - place, place)
        ring = Rings(open_.x[place], open_.y[place], open_.first).kept(known[of])
        fresh = np.ones(len(ring.x), bool)
        to = ring.after()
        fresh[to] = (ring.x[to] != ring.x) | (ring.y[to] != ring.y)
        bare = ring.kept(fresh)
        x, y, many = made(_corners(bare), by, segments)
        out = _closed(Rings(_units(x), _units(y), np.append(0, np.cumsum(many))[bare.first]))
        known &= (out.sizes() >= 3) & (abs(_doubled(out)) >= 2)
        return _written(out.kept(known[out.of()]), known)

    return moved(points)
