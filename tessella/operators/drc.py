"""Design-rule checks on rectilinear coverage: width, space, self-space and enclosure.

A violation is a pair of edges: keys, e1x1 e1y1 e1x2 e1y2, e2x1 e2y1 e2x2 e2y2, each pair once. Limits are strict and contact is no gap. Bands meet
through grid buckets as wide as a few limits, so a plane without keys is joined by equality too; each pair counts in the one bucket that
holds its lower overlap corner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import sweeps
from tessella.operators.bands import BOX, TILE, bands_where, batched, same, transpose, union_bands
from tessella.plans.session import materialise

PAIR = ["e1x1", "e1y1", "e1x2", "e1y2", "e2x1", "e2y1", "e2x2", "e2y2"]


def swap_axes(pairs: DataFrame) -> DataFrame:
    other = {f"e{e}{a}{p}": f"e{e}{b}{p}" for e in "12" for p in "12" for a, b in (("x", "y"), ("y", "x"))}
    return pairs.select(*(F.col(other.get(c, c)).alias(c) for c in pairs.columns))


def upright(keys: Sequence[str], xa: str, xb: str, lo: str, hi: str) -> list[Column]:
    """Pair of vertical edges at xa and xb from lo to hi."""
    return [*(F.col(k) for k in keys), *(F.expr(x).cast("long").alias(y) for x, y in zip((xa, lo, xa, hi, xb, lo, xb, hi), PAIR))]


def ordered(pairs: DataFrame) -> DataFrame:
    """The lesser edge of each pair first."""
    one, two = (F.struct(*(F.col(c) for c in PAIR[i : i + 4])) for i in (0, 4))
    swap = two < one
    return pairs.withColumns({c: F.when(swap, F.col(PAIR[(i + 4) % 8])).otherwise(F.col(c)) for i, c in enumerate(PAIR)})


def bucketed(rects: DataFrame, size: int, margin: int = 0) -> DataFrame:
    """A row for each grid bucket that a rectangle, widened by margin, meets."""
    axes = {b: F.explode(F.expr(f"sequence(cast(floor(({lo} - {margin}) / {size}) as bigint), cast(floor(({hi} + {margin}) / {size}) as bigint))")) for b, lo, hi in (("bx", "x1", "x2"), ("by", "y1", "y2"))}
    for name, col in axes.items():
        rects = rects.withColumn(name, col)
    return rects


def bucket_size(limit: float) -> int:
    return max(8 * int(limit), 256)


FACTOR, DEEPEST = 4, 12  # a level's buckets are FACTOR times as wide as those of the level below


def leveled(rects: DataFrame, size: int, margin: int = 0) -> DataFrame:
    """With own, the least level whose buckets (size * FACTOR ** own wide) are as wide as the rectangle with its margins: it meets two of them an axis at most."""
    long = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 2 * margin
    own = F.lit(DEEPEST)
    for level in range(DEEPEST - 1, -1, -1):
        own = F.when(long <= size * FACTOR**level, F.lit(level)).otherwise(own)
    return rects.withColumn("own", own)


def levels_of(*rects: DataFrame) -> DataFrame:
    """The levels that any of the leveled rectangles has: a row each, so a dozen at most."""
    out = None
    for r in rects:
        one = r.select(F.col("own").alias("level"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def placed(rects: DataFrame, size: int, margin: int) -> DataFrame:
    """A row for each bucket of the column level that a rectangle, widened by margin, meets, with the buckets' width."""
    wide = rects.withColumn("wide", F.lit(size).cast("bigint") * F.pow(F.lit(FACTOR), F.col("level")).cast("bigint"))
    for b, lo, hi in (("bx", "x1", "x2"), ("by", "y1", "y2")):
        wide = wide.withColumn(b, F.explode(F.expr(f"sequence(cast(floor(({lo} - {margin}) / wide) as bigint), cast(floor(({hi} + {margin}) / wide) as bigint))")))
    return wide


def _axis_level(length: Column, size: int) -> Column:
    level = F.lit(DEEPEST)
    for n in range(DEEPEST - 1, -1, -1):
        level = F.when(length <= size * FACTOR**n, F.lit(n)).otherwise(level)
    return level


def spanned(rects: DataFrame, size: int, margin: int = 0) -> DataFrame:
    """With ox and oy, the level of each axis: a long thin rectangle stands in long thin buckets, of which it meets two an axis at most."""
    return rects.withColumns({f"o{c}": _axis_level(F.col(f"{c}2") - F.col(f"{c}1") + 2 * margin, size) for c in "xy"})


def laid(rects: DataFrame, size: int, margin: int) -> DataFrame:
    """A row for each bucket (bx, by) of the levels lx and ly that a rectangle, widened by margin, meets, with the buckets' sides wx and wy."""
    for c in "xy":
        side = F.lit(size).cast("bigint") * F.pow(F.lit(FACTOR), F.col(f"l{c}")).cast("bigint")
        rects = rects.withColumn(f"w{c}", side).withColumn(f"b{c}", F.explode(F.expr(f"sequence(cast(floor(({c}1 - {margin}) / w{c}) as bigint), cast(floor(({c}2 + {margin}) / w{c}) as bigint))")))
    return rects


BUCKET = ["lx", "ly", "bx", "by"]


def near(a: DataFrame, b: DataFrame, keys: Sequence[str], size: int, margin: int = 0) -> DataFrame:
    """Rows x of a and y of b whose rectangles may be within margin of each other: every pair that is, once, in the bucket of its greatest lower corner.

    Each axis has its level, so that a pair meets on the greater of its two levels along x and the greater along y, in buckets that hold few rectangles
    of that size. Rectangles that are smaller on an axis probe the levels above that there are; two that both probe can't make a pair there, so they don't meet:
    mx and my deal a row of a that is at home to all rows of b, one that probes to those of b at home.
    """
    left, right = spanned(a, size, margin), spanned(b, size, margin)
    own = left.select("ox", "oy").unionByName(right.select("ox", "oy")).distinct()
    sets = own.agg(*(F.array_sort(F.collect_set(f"o{c}")).alias(c) for c in "xy"))  # a dozen levels an axis at most
    levels = F.broadcast(sets.select("y", F.posexplode("x").alias("nx", "lx")).select("nx", "lx", F.posexplode("y").alias("ny", "ly")))
    above = F.expr("lx >= ox and ly >= oy")
    x, y = left.join(levels, above), right.join(levels, above)
    for c in "xy":
        x = x.withColumn(f"m{c}", F.expr(f"if(o{c} = l{c}, 0, 1)"))
        y = y.withColumn(f"m{c}", F.explode(F.expr(f"if(o{c} = l{c} and n{c} > 0, array(0, 1), array(0))")))
    x, y = laid(x, size, margin).alias("x"), laid(y, size, margin).alias("y")
    mine = " and ".join(f"x.b{c} = floor((greatest(x.{c}1, y.{c}1) - {margin}) / x.w{c})" for c in "xy")
    return x.join(y, same(keys, "x", "y") & F.expr(" and ".join(f"x.{c} = y.{c}" for c in (*BUCKET, "mx", "my"))) & F.expr(mine))


def width(rects: DataFrame, keys: Sequence[str], limit: int, tile: int = TILE, wide: bool = True) -> DataFrame:
    """Bands of the union thinner than limit, along x and along y."""
    found = [union_bands(r, keys, tile, wide).where(f"x2 - x1 < {limit}").select(*upright(keys, "x1", "x2", "y1", "y2")) for r in (rects, transpose(rects))]
    return found[0].unionByName(swap_axes(found[1])).distinct()


def _gaps(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: int, once: bool = False) -> DataFrame:
    """Gaps of 0 < d < limit between bands of a and b (each pair in one direction with `once`): keys, PAIR, and the box x1..y2 between.

    Bands that overlap along one axis face each other along the other; those apart on both leave a diagonal gap from corner to corner.
    """
    gap = {c: f"greatest(y.{c}1 - x.{c}2, x.{c}1 - y.{c}2)" for c in "xy"}
    close = f"{gap['x']} < {limit} and {gap['y']} < {limit} and greatest({gap['x']}, {gap['y']}) > 0 and {gap['x']} <> 0 and {gap['y']} <> 0"
    first = "struct(x.x1, x.y1, x.x2, x.y2) < struct(y.x1, y.y1, y.x2, y.y2)" if once else "true"
    met = near(a, b, keys, bucket_size(limit), limit).where(f"{close} and {first}")
    ends = {f"{c}{s}": f"if(y.{c}1 > x.{c}2, {one}, {two})" for c in "xy" for s, one, two in (("a", f"x.{c}2", f"x.{c}1"), ("b", f"y.{c}1", f"y.{c}2"))}
    spans = {f"{c}lo": f"greatest(x.{c}1, y.{c}1)" for c in "xy"} | {f"{c}hi": f"least(x.{c}2, y.{c}2)" for c in "xy"}
    seen = met.select(*(F.col(f"x.{k}").alias(k) for k in keys), *(F.expr(v).alias(f"_{k}") for k, v in (ends | spans | {"gx": gap["x"], "gy": gap["y"]}).items()))
    seen = seen.where(f"_gx < 0 or _gy < 0 or _gx * _gx + _gy * _gy < {limit * limit}")
    beside, above = "_gy < 0", "_gx < 0"
    place = {"e1x1": ("_xa", "_xlo", "_xa"), "e1y1": ("_ylo", "_ya", "_ya"), "e1x2": ("_xa", "_xhi", "_xa"), "e1y2": ("_yhi", "_ya", "_ya"), "e2x1": ("_xb", "_xlo", "_xb"), "e2y1": ("_ylo", "_yb", "_yb"), "e2x2": ("_xb", "_xhi", "_xb"), "e2y2": ("_yhi", "_yb", "_yb")}
    pairs = seen.select(*keys, *(F.expr(f"cast(case when {beside} then {u} when {above} then {v} else {w} end as bigint)").alias(k) for k, (u, v, w) in place.items()))
    box = {"x1": "least(e1x1, e2x1)", "y1": "least(e1y1, e2y1)", "x2": "greatest(e1x2, e2x2)", "y2": "greatest(e1y2, e2y2)"}
    return pairs.select("*", *(F.expr(v).alias(k) for k, v in box.items()))


def _open_gaps(gaps: DataFrame, cover: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Gaps (keys, PAIR, gap box x1..y2) that the disjoint bands of cover don't fill. A band stands on the levels of its sides alone; a gap is cut by the buckets of every pair of levels that there is, and what bands fill is summed over all."""
    size = bucket_size(limit)
    bands = spanned(cover, size).withColumns({"lx": F.col("ox"), "ly": F.col("oy")})
    c = laid(bands, size, 0)
    clip = "(least(g.x2, c.x2) - greatest(g.x1, c.x1)) * (least(g.y2, c.y2) - greatest(g.y1, c.y1))"
    met = F.expr("g.x1 < c.x2 and c.x1 < g.x2 and g.y1 < c.y2 and c.y1 < g.y2")
    # each box is cut at bucket borders, so that a piece meets only the bands of its bucket
    boxes = gaps.distinct().withColumn("area", F.expr("(x2 - x1) * (y2 - y1)"))
    cut = boxes.join(F.broadcast(bands.select("lx", "ly").distinct()), F.lit(True))
    for a in "xy":
        side = F.lit(size).cast("bigint") * F.pow(F.lit(FACTOR), F.col(f"l{a}")).cast("bigint")
        cut = cut.withColumn("wide", side).withColumn(f"b{a}", F.explode(F.expr(f"sequence(cast(floor({a}1 / wide) as bigint), cast(floor(({a}2 - 1) / wide) as bigint))")))
        cut = cut.withColumns({f"{a}1": F.greatest(f"{a}1", F.col(f"b{a}") * F.col("wide")), f"{a}2": F.least(f"{a}2", (F.col(f"b{a}") + 1) * F.col("wide"))})
    cut = cut.select(*keys, *PAIR, "area", *BUCKET, *BOX)
    filled = cut.alias("g").join(c.alias("c"), same(keys, "g", "c") & F.expr(" and ".join(f"g.{k} = c.{k}" for k in BUCKET)) & met, "left")
    summed = filled.select(*(F.col(f"g.{k}").alias(k) for k in [*keys, *PAIR, "area"]), F.expr(f"case when c.x1 is null then 0 else {clip} end").alias("part"))
    return summed.groupBy(*keys, *PAIR).agg(F.max("area").alias("area"), F.sum("part").alias("part")).where("part < area").select(*keys, *PAIR)


def space(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: int, tile: int = TILE, wide: bool = True) -> DataFrame:
    """Gaps of 0 < d < limit between rectangles of a and b that the union of both doesn't fill."""
    both = a.select(*keys, *BOX).unionByName(b.select(*keys, *BOX))
    return ordered(_open_gaps(_gaps(a, b, keys, limit), union_bands(both, keys, tile, wide), keys, limit)).distinct()


def self_space(rects: DataFrame, keys: Sequence[str], limit: int, tile: int = TILE, wide: bool = True) -> DataFrame:
    """Space within the union of one layer."""
    across = materialise(union_bands(rects, keys, tile, wide), "union")
    return ordered(_open_gaps(_gaps(across, across, keys, limit, once=True), across, keys, limit)).distinct()


def _real_edges(sides: Sequence[DataFrame], keys: Sequence[str], tile: int) -> DataFrame:
    """Edges that lie on tile borders: keys, y1."""
    edges = None
    for side in sides:
        own = side.where("x1 < x2 and y1 < y2").select(*keys, F.explode(F.array("y1", "y2")).alias("y1")).where(f"y1 % {tile} = 0")
        edges = own if edges is None else edges.unionByName(own)
    return edges.distinct()


def _over_borders(rows: DataFrame, edges: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Margins (keys, xa, xb, y1, y2) with those joined that only a tile border parts: none of the edges of the plane lies there."""
    border = f"y1 % {tile} = 0 or y2 % {tile} = 0"
    cut = rows.where(border).alias("m").join(edges.withColumn("real", F.lit(True)).alias("e"), same([*keys, "y1"], "m", "e"), "left").select("m.*", "e.real")
    tower = Window.partitionBy(*keys, "xa", "xb").orderBy("y1")
    new = F.when((F.lag("y2").over(tower) == F.col("y1")) & (F.col("y1") % tile == 0) & F.col("real").isNull(), 0).otherwise(1)
    runs = cut.withColumn("new", new).withColumn("run", F.sum("new").over(tower))
    joined = runs.groupBy(*keys, "xa", "xb", "run").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return rows.where(f"not ({border})").unionByName(joined.select(*rows.columns))


def _margins(outer: DataFrame, inner: DataFrame, keys: Sequence[str], limit: int, tile: int) -> DataFrame:
    """Margins along x under limit in every slab between neighbouring edges of the plane where an inner run lies in an outer run, whatever the tiles."""
    found = batched([outer, inner], keys, tile, True, lambda cells: sweeps.margins(cells, limit))
    rows = found.select("g.*", "y1", "y2", F.col("x1").alias("xa"), F.col("x2").alias("xb")).select(*keys, "y1", "y2", "xa", "xb")
    # those at tile borders go their own way, and the sweep isn't gone through for both
    joined = _over_borders(materialise(rows, "margins"), _real_edges([outer, inner], keys, tile), keys, tile)
    return joined.select(*upright(keys, "xa", "xb", "y1", "y2"))


def enclosure(outer: DataFrame, inner: DataFrame, keys: Sequence[str], limit: int, tile: int = TILE, wide: bool = True) -> DataFrame:
    """Inner coverage outside outer, as the sides of its bands, and margins under limit, slab by slab; the rows don't depend on the tile. Slabs run along the whole plane, so margins are swept by y tiles alone."""
    bare = bands_where("difference", inner, outer, keys, tile, wide).select(*upright(keys, "x1", "x2", "y1", "y2"))
    covered = materialise(bands_where("intersection", inner, outer, keys, tile, wide), "covered")
    along = _margins(outer, covered, keys, limit, tile)
    across = swap_axes(_margins(transpose(outer), transpose(covered), keys, limit, tile))
    return bare.unionByName(along).unionByName(across).distinct()
