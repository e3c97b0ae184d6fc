"""Checks on the edges of polygons of any angle: width, space, notch, separation, enclosure, grid and angle.

Metrics: euclidean (segment to segment), square (largest coordinate difference over end points and midpoints), projection (end points onto the
other edge's normal). Limits are strict; distance 0 (up to rounding) is no violation but for enclosure. Results aren't made distinct.

Pairs within a polygon come from its own array of points, without a shuffle. Distances are worked out in NumPy, batches of pairs at a time: as expressions
they make methods too long for the JVM to compile. Pairs whose boxes are too far apart are left out before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.points import edges as point_edges
from tessella.operators.bands import same
from tessella.operators.drc import PAIR, bucket_size

ENDS = ["x1", "y1", "x2", "y2"]
CONTACT = 1e-9  # what rounding may leave of a distance of 0


def polygon_edges(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, poly_idx, edge, n (edges of the polygon), x1, y1, x2, y2."""
    e = polygons.select(*keys, "poly_idx", F.greatest(F.size("points") - 1, F.lit(0)).alias("n"), F.posexplode(point_edges(F.col("points"))).alias("edge", "e"))
    return e.select(*keys, "poly_idx", "n", "edge", "e.*")


# ---- distances: of the edges e and f, arrays x1, y1, x2, y2 of each, a batch of pairs at a time --------------------


def _quotient(a: np.ndarray, b: np.ndarray, none: float) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), none), where=b != 0)


def _vectors(e: list[np.ndarray], f: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Direction (x, y) of both edges, and from the start of e to the start of f, as doubles."""
    return tuple(v.astype(float) for v in (e[2] - e[0], e[3] - e[1], f[2] - f[0], f[3] - f[1], f[0] - e[0], f[1] - e[1]))


def _normals(ex: np.ndarray, ey: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit normals of both edges; that of a point is (0, 1)."""
    el, fl = np.sqrt(ex * ex + ey * ey), np.sqrt(fx * fx + fy * fy)
    return _quotient(-ey, el, 0.0), _quotient(ex, el, 1.0), _quotient(-fy, fl, 0.0), _quotient(fx, fl, 1.0)


def _euclidean(e: list[np.ndarray], f: list[np.ndarray]) -> np.ndarray:
    """0 where the segments cross (in exact integers; parallel ones don't), else the least of four distances from an end point to the other segment."""
    whole = e[2] - e[0], e[3] - e[1], f[2] - f[0], f[3] - f[1], f[0] - e[0], f[1] - e[1]
    if any(len(v) and max(abs(v.max()), abs(v.min())) >= 1 << 31 for v in whole):
        whole = tuple(v.astype(object) for v in whole)  # products beyond 63 bits
    ix, iy, jx, jy, kx, ky = whole
    det, t, u = ix * jy - iy * jx, kx * jy - ky * jx, kx * iy - ky * ix
    side, most = np.where(det < 0, -1, 1), abs(det)
    crossing = ((det != 0) & (side * t >= 0) & (side * t <= most) & (side * u >= 0) & (side * u <= most)).astype(bool)
    ex, ey, fx, fy, ox, oy = _vectors(e, f)
    nearest = None
    # the ends of f seen from the start of e, those of e seen from the start of f
    for x, y, onx, ony in ((ox, oy, ex, ey), (ox + fx, oy + fy, ex, ey), (-ox, -oy, fx, fy), (ex - ox, ey - oy, fx, fy)):
        along = np.clip(_quotient(x * onx + y * ony, onx * onx + ony * ony, 0.0), 0.0, 1.0)
        px, py = x - along * onx, y - along * ony
        far = px * px + py * py
        nearest = far if nearest is None else np.minimum(nearest, far)
    return np.where(crossing, 0.0, np.sqrt(nearest))


def _square(e: list[np.ndarray], f: list[np.ndarray]) -> np.ndarray:
    half = lambda v: np.where(v < 0, -(-v // 2), v // 2)
    spots = [[(s[0], s[1]), (s[2], s[3]), (half(s[0] + s[2]), half(s[1] + s[3]))] for s in (e, f)]
    return np.minimum.reduce([np.maximum(abs(p[0] - q[0]), abs(p[1] - q[1])) for p in spots[0] for q in spots[1]]).astype(float)


def _projection(e: list[np.ndarray], f: list[np.ndarray]) -> np.ndarray:
    ex, ey, fx, fy, ox, oy = _vectors(e, f)
    enx, eny, fnx, fny = _normals(ex, ey, fx, fy)
    return np.minimum.reduce([abs(x * nx + y * ny) for x, y, nx, ny in ((ox, oy, enx, eny), (ox + fx, oy + fy, enx, eny), (-ox, -oy, fnx, fny), (ex - ox, ey - oy, fnx, fny))])


METRICS = {"euclidean": _euclidean, "square": _square, "projection": _projection}


def _measured(pairs: DataFrame, metric: str, facing: bool = False) -> DataFrame:
    """Pairs (with structs e and f: x1, y1, x2, y2) with their distance d; with `facing`, infinite where the normals don't point against each other."""

    @F.pandas_udf("double")
    def distance(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, cx: pd.Series, cy: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        e, f = ([c.to_numpy() for c in s] for s in ((ax, ay, bx, by), (cx, cy, dx, dy)))
        d = METRICS[metric](e, f)
        if facing:
            enx, eny, fnx, fny = _normals(*_vectors(e, f)[:4])
            d = np.where(enx * fnx + eny * fny < -0.5, d, np.inf)
        return pd.Series(d)

    return pairs.withColumn("d", distance(*(F.col(f"{s}.{c}") for s in "ef" for c in ENDS)))


# ---- checks ---------------------------------------------------------------------------------------------------


def _literal(limit: float) -> str:
    return str(int(limit)) if limit == int(limit) else f"{limit!r}D"  # a bare fraction would be a decimal, which is slow


def _near(limit: float, e: str = "e", f: str = "f") -> Column:
    """The boxes of two edges are less than limit apart on both axes."""
    return F.expr(" and ".join(f"least({a}.{c}1, {a}.{c}2) < greatest({b}.{c}1, {b}.{c}2) + {_literal(limit)}" for c in "xy" for a, b in ((e, f), (f, e))))


def _violations(pairs: DataFrame, keys: Sequence[str], metric: str, limit: float, facing: bool = False) -> DataFrame:
    found = _measured(pairs, metric, facing).where(f"d > {CONTACT}D and d < {_literal(limit)}")
    return found.select(*keys, *(F.col(f"{s}.{c}").alias(name) for s, names in (("e", PAIR[:4]), ("f", PAIR[4:])) for c, name in zip(ENDS, names)))


def _within(polygons: DataFrame, keys: Sequence[str], least_edges: int, limit: float, metric: str) -> DataFrame:
    """keys, e, f: edges of one polygon that share no vertex. A short projection can join edges at any distance, so there none is left out."""
    # behind a generator: else the edges are made anew wherever they are used below, for each of them
    own = polygons.select(*keys, F.explode(F.array(point_edges(F.col("points")))).alias("edges")).where(f"size(edges) >= {least_edges}")
    first = own.select(*keys, "edges", F.posexplode("edges").alias("i", "e"))
    later = first.select(*keys, "e", "i", F.size("edges").alias("n"), F.posexplode(F.expr("slice(edges, i + 3, greatest(size(edges) - i - 2, 0))")).alias("k", "f"))
    apart = later.where("not (i = 0 and k + 3 = n)").select(*keys, "e", "f")
    return apart if metric == "projection" else apart.where(_near(limit))


def width(polygons: DataFrame, keys: Sequence[str], limit: float, metric: str = "euclidean") -> DataFrame:
    return _violations(_within(polygons, keys, 3, limit, metric), keys, metric, limit)


def notch(polygons: DataFrame, keys: Sequence[str], limit: float, metric: str = "euclidean") -> DataFrame:
    """Pairs whose normals point against each other."""
    return _violations(_within(polygons, keys, 4, limit, metric), keys, metric, limit, facing=True)


def _structs(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    return met.select(*(F.col(f"e.{k}").alias(k) for k in keys), *(F.struct(*(F.col(f"{s}.{c}") for c in ENDS)).alias(s) for s in "ef"))


def space(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: float, metric: str = "euclidean", once: bool = False) -> DataFrame:
    """Pairs of edges of a and b; with `once`, of polygons of which the first has the smaller poly_idx. For the euclidean and square metrics edges meet through grid buckets; a projection can be short at any distance, so
    there all edges of a group's two regions are compared."""
    e, f = polygon_edges(a, keys), polygon_edges(b, keys)
    cond = same(keys, "e", "f") & (F.col("e.poly_idx") < F.col("f.poly_idx") if once else F.lit(True))
    if metric != "projection":
        size = bucket_size(limit)
        for name, lo, hi in (("bx", "x1", "x2"), ("by", "y1", "y2")):
            span = F.expr(f"explode(sequence(cast(floor((least({lo}, {hi}) - {_literal(limit)}) / {size}) as bigint), cast(floor((greatest({lo}, {hi}) + {_literal(limit)}) / {size}) as bigint)))")
            e, f = e.select("*", span.alias(name)), f.select("*", span.alias(name))
            cond = cond & F.expr(f"e.{name} = f.{name} and e.{name} = floor((greatest(least(e.{lo}, e.{hi}), least(f.{lo}, f.{hi})) - {_literal(limit)}) / {size})")
        cond = cond & _near(limit)
    return _violations(_structs(e.alias("e").join(f.alias("f"), cond), keys), keys, metric, limit)


def separation(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: float, metric: str = "euclidean") -> DataFrame:
    return space(a, b, keys, limit, metric)


def enclosure(outer: DataFrame, inner: DataFrame, keys: Sequence[str], limit: float, metric: str = "euclidean") -> DataFrame:
    """Each inner edge with the nearest edge (the first of equals) of each outer polygon, where nearer than limit. Distance 0 counts.

    For the euclidean and square metrics only edges that meet in a grid bucket can be that near; the nearest of those is the nearest of all.
    """
    e, f = polygon_edges(inner, keys), polygon_edges(outer, keys)
    cond = same(keys, "e", "f")
    if metric != "projection":
        size = bucket_size(limit)
        for name, lo, hi in (("bx", "x1", "x2"), ("by", "y1", "y2")):
            span = F.expr(f"explode(sequence(cast(floor((least({lo}, {hi}) - {_literal(limit)}) / {size}) as bigint), cast(floor((greatest({lo}, {hi}) + {_literal(limit)}) / {size}) as bigint)))")
            e, f = e.select("*", span.alias(name)), f.select("*", span.alias(name))
            cond = cond & F.expr(f"e.{name} = f.{name} and e.{name} = floor((greatest(least(e.{lo}, e.{hi}), least(f.{lo}, f.{hi})) - {_literal(limit)}) / {size})")
        cond = cond & _near(limit)
    met = e.alias("e").join(f.alias("f"), cond).select(*(F.col(f"e.{k}").alias(k) for k in keys), F.col("e.poly_idx").alias("ip"), F.col("e.edge").alias("ie"), F.col("f.poly_idx").alias("op"), F.col("f.edge").alias("oe"), *(F.struct(*(F.col(f"{s}.{c}") for c in ENDS)).alias(s) for s in "ef"))
    near = _measured(met, metric).where(f"d < {_literal(limit)}")
    best = near.groupBy(*keys, "ip", "ie", "op").agg(F.min_by(F.struct("e", "f"), F.struct("d", "oe")).alias("p"))
    return best.select(*keys, *(F.col(f"p.{s}.{c}").alias(name) for s, names in (("e", PAIR[:4]), ("f", PAIR[4:])) for c, name in zip(ENDS, names)))


def grid(polygons: DataFrame, keys: Sequence[str], gx: int, gy: int) -> DataFrame:
    """Vertices off the grid with the grid point they snap to (division truncates toward zero). A grid of 0 or less isn't checked."""
    ring = F.when((F.size("points") > 1) & (F.element_at("points", 1) == F.element_at("points", -1)), F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))
    v = polygons.select(*keys, F.explode(ring).alias("p")).select(*keys, F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))
    off = " or ".join([f"{c} % {g} <> 0" for c, g in (("x", gx), ("y", gy)) if g > 0]) or "false"
    snap = {c: F.expr(f"(({c} + {g // 2}) div {g}) * {g}" if g > 0 else c) for c, g in (("x", gx), ("y", gy))}
    return v.where(off).select(*keys, *(col.alias(name) for col, name in zip((F.col("x"), F.col("y")) * 2 + (snap["x"], snap["y"]) * 2, PAIR)))


def angle(polygons: DataFrame, keys: Sequence[str], allowed: Sequence[int]) -> DataFrame:
    """Edges whose angle in whole degrees modulo 180 isn't allowed, each paired with itself."""
    e = polygon_edges(polygons, keys).where("x1 <> x2 or y1 <> y2")
    degrees = "degrees(atan2(cast(y2 - y1 as double), cast(x2 - x1 as double)))"
    turned = f"cast(round(case when {degrees} < 0 then {degrees} + 360 else {degrees} end) as bigint) % 180"
    bad = e.where(f"({turned}) not in ({', '.join(map(str, allowed))})") if allowed else e
    return bad.select(*keys, *(F.col(c).alias(name) for c, name in zip(("x1", "y1", "x2", "y2") * 2, PAIR)))
