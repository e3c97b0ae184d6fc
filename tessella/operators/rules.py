"""Design-rule checks that choose their way by input and metric, as a region's public checks do.

A region is all polygons of one value of the keys. Where every polygon of the regions compared is rectilinear and the metric euclidean, coverage is
checked; else edges are. Self-space and enclosure start from booleans, so there a slanted polygon raises for every metric.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.points import is_manhattan
from tessella.operators import drc, edges
from tessella.operators.bands import BOX, TILE, polygon_bands, same, union_bands
from tessella.operators.boolean import boolean, require_manhattan


def rings(bands: DataFrame) -> DataFrame:
    """Bands as closed polygons; the box itself is the poly_idx."""
    corner = F.array(*(F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1"))))
    return bands.select(*(c for c in bands.columns if c not in BOX), F.struct(*BOX).alias("poly_idx"), corner.alias("points"))


def _split(regions: list[DataFrame], keys: Sequence[str]) -> list[tuple[DataFrame, DataFrame]]:
    """Each region's polygons in groups that are rectilinear throughout, and the others."""
    straight = None
    for r in regions:
        one = r.select(*keys, is_manhattan(F.col("points")).alias("m"))
        straight = one if straight is None else straight.unionByName(one)
    straight = straight.groupBy(*keys).agg(F.bool_and("m").alias("m"))
    out = []
    for r in regions:
        marked = r.alias("r").join(straight.alias("s"), same(keys, "r", "s")).select("r.*", F.col("s.m").alias("_m"))
        out.append((marked.where("_m").drop("_m"), marked.where("not _m").drop("_m")))
    return out


def _checked(regions: list[DataFrame], keys: Sequence[str], metric: str, covered: Callable, edged: Callable) -> DataFrame:
    if metric != "euclidean":
        return edged(*regions)
    parts = _split(regions, keys)
    return covered(*(polygon_bands(p, keys) for p, _ in parts)).unionByName(edged(*(q for _, q in parts)))


def width(polygons: DataFrame, keys: Sequence[str], limit: int, metric: str = "euclidean", tile: int = TILE, wide: bool = True) -> DataFrame:
    return _checked([polygons], keys, metric, lambda r: drc.width(r, keys, limit, tile, wide), lambda p: edges.width(p, keys, limit, metric))


def space(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: int, metric: str = "euclidean", tile: int = TILE, wide: bool = True) -> DataFrame:
    return _checked([a, b], keys, metric, lambda r, s: drc.space(r, s, keys, limit, tile, wide), lambda p, q: edges.space(p, q, keys, limit, metric))


def self_space(polygons: DataFrame, keys: Sequence[str], limit: int, metric: str = "euclidean", tile: int = TILE, wide: bool = True) -> DataFrame:
    """Space within the union. For other metrics the edges of the union's bands are compared, each pair of bands once."""
    require_manhattan(polygons, "left")
    rects = polygon_bands(polygons, keys)
    if metric == "euclidean":
        return drc.self_space(rects, keys, limit, tile, wide)
    across = rings(union_bands(rects, keys, tile, wide))
    return drc.ordered(edges.space(across, across, keys, limit, metric, once=True)).distinct()


def enclosure(outer: DataFrame, inner: DataFrame, keys: Sequence[str], limit: int, metric: str = "euclidean", tile: int = TILE, wide: bool = True) -> DataFrame:
    """Uncovered inner coverage, and margins under limit: slab by slab, or by edges for other metrics."""
    require_manhattan(inner, "left")
    require_manhattan(outer, "right")
    o, i = polygon_bands(outer, keys), polygon_bands(inner, keys)
    if metric == "euclidean":
        return drc.enclosure(o, i, keys, limit, tile, wide)
    bare = boolean("difference", i, o, keys, tile, wide).select(*drc.upright(keys, "x1", "x2", "y1", "y2"))
    covered = rings(boolean("intersection", i, o, keys, tile, wide))
    return bare.unionByName(edges.enclosure(outer, covered, keys, limit, metric)).distinct()
