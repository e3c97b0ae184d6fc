"""Coverage of rectilinear geometry: polygons to rectangles, rectangles to disjoint canonical bands.

A rectangle table has key columns (cell, layer, ...) and x1, y1, x2, y2. Work is partitioned by the keys and a y tile, and for planes that are
large along x too (`wide=False`) by an x tile, so a huge plane is many groups; each tile is cut into slabs between neighbouring y edges, which are swept along x, for
bands in NumPy (`sweeps`), for cells by window functions. Bands that touch the border of an x tile are swept once more, those alone, to join them. Bands of equal x range
are then joined along y, which shuffles them by that range. Rectangles without area cover nothing. Null keys are keys like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.functions import sweeps
from tessella.plans.session import materialise

TILE = 8192  # height of a tile in database units
BOX = ["x1", "y1", "x2", "y2"]


def same(keys: Sequence[str], left: DataFrame | str, right: DataFrame | str) -> Column:
    """Null-safe equality of the keys of two aliases."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def transpose(rects: DataFrame) -> DataFrame:
    """Swap the axes."""
    other = {"x1": "y1", "y1": "x1", "x2": "y2", "y2": "x2"}
    return rects.select(*(F.col(other.get(c, c)).alias(c) for c in rects.columns))


def tiled(rects: DataFrame, tile: int = TILE, wide: bool = True) -> DataFrame:
    """Rectangles cut at tile borders, with the numbers of the tile (tx is 0 for tiles as wide as the plane). One that ends before it starts raises."""
    turned = F.expr("x1 > x2 or y1 > y2")
    sound = rects.withColumn("x1", F.when(turned, F.raise_error(F.lit("a rectangle ends before it starts")).cast("bigint")).otherwise(F.col("x1")))
    cut = sound.where("x1 < x2 and y1 < y2")
    for name, lo, hi in (("tile", "y1", "y2"),) if wide else (("tile", "y1", "y2"), ("tx", "x1", "x2")):
        cut = cut.withColumn(name, F.explode(F.expr(f"sequence(cast(floor({lo} / {tile}) as bigint), cast(floor(({hi} - 1) / {tile}) as bigint))")))
        cut = cut.withColumns({lo: F.greatest(lo, F.col(name) * tile), hi: F.least(hi, (F.col(name) + 1) * tile)})
    return cut.withColumn("tx", F.lit(0).cast("bigint")) if wide else cut


def packed(rows: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """rows with the keys as one struct g, dealt by it. Structs are never null and equal where their fields are, nulls included, so joins, windows and groups that begin with g stay in their task.

    The number of tasks is fixed, several for each shuffle partition: rows multiply after this, so tasks joined by what they read would sort more than they can hold.
    """
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.struct(*keys).alias("g"), *columns).repartition(tasks, "g")


def _slab_runs(rects: DataFrame, group: Sequence[str]) -> DataFrame:
    """Maximal runs s, g, y1, y2, side, x1, x2 of each side in the slabs between neighbouring y edges of either; s is a hash of the slab, by which rows sort fast."""
    dealt = packed(rects, group, *BOX, "side")
    edges = dealt.select("g", F.explode(F.array("y1", "y2")).alias("lo")).distinct()
    slabs = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy("g").orderBy("lo"))).where("hi is not null")
    within = dealt.alias("r").join(slabs.alias("s"), F.expr("r.g = s.g and r.y1 <= s.lo and r.y2 >= s.hi"))
    parts = within.select(F.xxhash64("r.g", "s.lo").alias("s"), "r.g", F.col("s.lo").alias("y1"), F.col("s.hi").alias("y2"), "r.side", "r.x1", "r.x2")
    line = Window.partitionBy("s", "g", "y1", "side").orderBy("x1")
    reached = parts.withColumns({"reach": F.max("x2").over(line.rowsBetween(Window.unboundedPreceding, -1)), "last": F.lead("x1").over(line).isNull()}).withColumn("first", F.expr("reach is null or x1 > reach"))
    ends = reached.where("first or last").withColumn("end", F.greatest("reach", "x2"))
    closed = ends.withColumn("x2", F.when(F.col("last"), F.col("end")).otherwise(F.lead(F.expr("if(first, reach, end)")).over(line))).where("first")
    return closed.select("s", "g", "y1", "y2", "side", "x1", "x2")


def batched(sides: Sequence[DataFrame], keys: Sequence[str], tile: int, wide: bool, result: Callable[[sweeps.Cells], tuple]) -> DataFrame:
    """g (struct of the keys, tx, tile) and BOX: what a result gives of the cells of each tile, a batch at a time. Each side is dealt by tile once, before its rectangles multiply."""
    group = [*keys, "tx", "tile"]
    rects = None
    for n, rows in enumerate(sides):
        one = packed(tiled(rows.select(*keys, *(F.col(c).cast("long") for c in BOX)), tile, wide), group, F.lit(n).alias("side"), *BOX)
        rects = one if rects is None else rects.unionByName(one)
    # sorted by a hash first, which is fast
    line = Window.partitionBy("s", "g").orderBy("s")
    numbered = rects.withColumn("s", F.xxhash64("g")).withColumn("n", F.row_number().over(line)).select("n", "side", *BOX, "g")
    schema = StructType([numbered.schema["g"], *(StructField(c, LongType()) for c in BOX)])
    return numbered.mapInArrow(sweeps.sweeper(result), schema)


def bands_where(operation: str, a: DataFrame, b: DataFrame | None, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Maximal bands where an operation on the coverage of a and b holds; without b, where a covers."""
    return _across(batched([a] if b is None else [a, b], keys, tile, wide, _kept(operation)).select("g.*", *BOX), keys, tile, wide)


def _kept(operation: str) -> Callable[[sweeps.Cells], tuple]:
    return lambda cells: sweeps.towers(cells, sweeps.KEEP[operation](cells.a, cells.b))


def swept(a: DataFrame, b: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Elementary cells s, g (struct of the keys, tx, tile), y1, y2, x1, x2 with a and b, 1 where that side covers them; dealt by g, in x1 order within s, g and y1."""
    both = a.select(*keys, *BOX, F.lit(0).alias("side")).unionByName(b.select(*keys, *BOX, F.lit(1).alias("side")))
    steps = F.array(F.struct(F.col("x1").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x2").alias("x"), F.lit(-1).alias("d")))
    events = _slab_runs(tiled(both, tile, wide), [*keys, "tx", "tile"]).select("s", "g", "y1", "y2", "side", F.inline(steps))
    line = Window.partitionBy("s", "g", "y1").orderBy("x")
    upto = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.select("s", "g", "y1", "y2", "x", F.lead("x").over(line).alias("next"), *(F.sum(F.when(F.col("side") == n, F.col("d")).otherwise(0)).over(upto).alias(name) for n, name in ((0, "a"), (1, "b"))))
    return counted.where("next > x").select("s", "g", "y1", "y2", F.col("x").alias("x1"), F.col("next").alias("x2"), "a", "b")


def covered(rects: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """The maximal runs of the union in each slab, as swept cells."""
    return _slab_runs(tiled(rects.select(*keys, *BOX, F.lit(0).alias("side")), tile, wide), [*keys, "tx", "tile"]).drop("side")


def slab_cells(a: DataFrame, b: DataFrame | None, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Disjoint cells keys, tx, tile, y1, y2, x1, x2 with a and b, 1 where that side covers them; without b, the runs that a covers."""
    cells = covered(a, keys, tile, wide).withColumns({"a": F.lit(1), "b": F.lit(0)}) if b is None else swept(a, b, keys, tile, wide)
    return cells.select("g.*", "y1", "y2", "x1", "x2", "a", "b")


def runs(rows: DataFrame, within: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Rows that touch along lo to hi, joined: only the first and the last of a run are kept on the way."""
    line = Window.partitionBy(*within).orderBy(lo)
    marked = rows.withColumns({"first": F.coalesce(F.lag(hi).over(line) != F.col(lo), F.lit(True)), "last": F.coalesce(F.lead(lo).over(line) != F.col(hi), F.lit(True))})
    ends = marked.where("first or last")
    return ends.withColumn(hi, F.when(F.col("last"), F.col(hi)).otherwise(F.lead(hi).over(line))).where("first").drop("first", "last")


def joined_up(cells: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Swept cells that touch become maximal bands: first along x in each slab, then along y where x1 and x2 agree."""
    return _risen(runs(cells.select("s", "g", *BOX), ["s", "g", "y1"], "x1", "x2"), keys, tile, wide)


def _risen(flat: DataFrame, keys: Sequence[str], tile: int, wide: bool) -> DataFrame:
    """Maximal runs of slabs joined along y: within tiles first, so that only bands are shuffled by their x range to join across tiles."""
    return _across(_towers(flat), keys, tile, wide)


def _across(pieces: DataFrame, keys: Sequence[str], tile: int, wide: bool) -> DataFrame:
    """Bands of tiles (keys, tx, tile, BOX) joined across them."""
    if not wide:
        border = f"x1 % {tile} = 0 or x2 % {tile} = 0"
        pieces = materialise(pieces, "tile-bands")
        pieces = pieces.where(f"not ({border})").unionByName(batched([pieces.where(border)], keys, tile, True, _kept("union")).select("g.*", *BOX))
    return runs(pieces.select(*keys, *BOX), [*keys, "x1", "x2"], "y1", "y2")


def _towers(flat: DataFrame) -> DataFrame:
    """keys, tx, tile and the bands within each g."""
    hashed = flat.select(F.xxhash64("g", "x1", "x2").alias("t"), "g", *BOX)
    return runs(hashed, ["t", "g", "x1", "x2"], "y1", "y2").select("g.*", *BOX)


def union_bands(rects: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Disjoint canonical bands of the union of rectangles."""
    return bands_where("union", rects, None, keys, tile, wide)


def polygon_bands(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rectangles of each rectilinear polygon (keys, poly_idx, points) by the even-odd rule, with its poly_idx.

    Polygons of fewer than three points give nothing. A closing point may be there or not.
    """
    side = F.expr("explode(zip_with(points, concat(slice(points, 2, greatest(size(points) - 1, 0)), slice(points, 1, 1)), (p, q) -> named_struct('x', p.x, 'x2', q.x, 'lo', least(p.y, q.y), 'hi', greatest(p.y, q.y))))")
    group = [*keys, "poly_idx"]
    edges = packed(polygons.where("size(points) >= 3").select(*group, side.alias("e")).select(*group, "e.*").where("x = x2 and lo < hi"), group, "x", "lo", "hi")
    ys = edges.select("g", F.explode(F.array("lo", "hi")).alias("y1")).distinct()
    slabs = ys.withColumn("y2", F.lead("y1").over(Window.partitionBy("g").orderBy("y1"))).where("y2 is not null")
    crossed = edges.alias("e").join(slabs.alias("s"), F.expr("e.g = s.g and e.lo <= s.y1 and e.hi >= s.y2")).select("e.g", "s.y1", "s.y2", "e.x")
    line = Window.partitionBy("g", "y1").orderBy("x")
    paired = crossed.withColumns({"x2": F.lead("x").over(line), "n": F.row_number().over(line)}).where("n % 2 = 1 and x < x2")
    return paired.select("g.*", *(F.col(x).cast("long").alias(y) for x, y in (("x", "x1"), ("y1", "y1"), ("x2", "x2"), ("y2", "y2"))))
