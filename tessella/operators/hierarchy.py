"""Cell hierarchies (an extension: references are resolved to names elsewhere, here they are followed): where cells stand under their tops, level by level.

A reference places a cell by a mirror about the x axis, then quarter turns, then an origin. Equal placements of a cell are one row with a count, so a cell that is used
often costs a row for each different placement, whatever the number of paths to it. Each level is one join of the cells reached with their references; a level
beyond the number of cells means that a cell contains itself, which raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.session import materialise

PLACED = ["file", "top", "cell", "mirror", "turn", "x", "y"]


def moved(mirror: Column, turn: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point mirrored about the x axis and turned by quarters."""
    v = F.when(mirror, -y).otherwise(y)
    return F.when(turn == 0, x).when(turn == 1, -v).when(turn == 2, -x).otherwise(v), F.when(turn == 0, v).when(turn == 1, x).when(turn == 2, -v).otherwise(-x)


def placements(tops: DataFrame, references: DataFrame) -> DataFrame:
    """PLACED and n, how often, of every cell under tops (file, top), themselves included. References: file, cell, ref_cell, mirror, turn (quarters), x, y."""
    refs = references.select("file", "cell", "ref_cell", F.col("mirror").alias("r_mirror"), F.pmod(F.col("turn"), F.lit(4)).alias("r_turn"), F.col("x").cast("long").alias("r_x"), F.col("y").cast("long").alias("r_y"))
    refs = materialise(refs.groupBy(*refs.columns).agg(F.count("*").alias("r_n")), "references")
    most = refs.groupBy("file").agg(F.count_distinct("cell").alias("n")).agg(F.max("n")).first()[0] or 0
    zero = F.lit(0).cast("long")
    level = materialise(tops.select("file", "top", F.col("top").alias("cell"), F.lit(False).alias("mirror"), F.lit(0).alias("turn"), zero.alias("x"), zero.alias("y"), F.lit(1).cast("long").alias("n")).distinct(), "placements")
    found, depth = level, 0
    while True:
        mx, my = moved(F.col("mirror"), F.col("turn"), F.col("r_x"), F.col("r_y"))
        turn = F.pmod(F.col("turn") + F.when(F.col("mirror"), -F.col("r_turn")).otherwise(F.col("r_turn")), F.lit(4))
        below = level.join(refs, ["file", "cell"]).select("file", "top", F.col("ref_cell").alias("cell"), (F.col("mirror") != F.col("r_mirror")).alias("mirror"), turn.cast("int").alias("turn"), (F.col("x") + mx).alias("x"), (F.col("y") + my).alias("y"), (F.col("n") * F.col("r_n")).alias("n"))
        level = materialise(below.groupBy(*PLACED).agg(F.sum("n").alias("n")), "placements")
        if not level.limit(1).count():
            return found.groupBy(*PLACED).agg(F.sum("n").alias("n"))
        depth += 1
        if depth > most:
            raise ValueError("a cell contains itself")
        found = found.unionByName(level)


def flattened(placed: DataFrame, rects: DataFrame) -> DataFrame:
    """The rectangles (file, cell, other columns, x1, y1, x2, y2) of all cells under their tops: top, those columns, the box, n."""
    other = [c for c in rects.columns if c not in ("file", "cell", "x1", "y1", "x2", "y2")]
    spots = placed.withColumnsRenamed({"x": "_x", "y": "_y"}).join(rects, ["file", "cell"])
    ax, ay = moved(F.col("mirror"), F.col("turn"), F.col("x1"), F.col("y1"))
    bx, by = moved(F.col("mirror"), F.col("turn"), F.col("x2"), F.col("y2"))
    return spots.select("file", "top", "cell", *other, (F.least(ax, bx) + F.col("_x")).alias("x1"), (F.least(ay, by) + F.col("_y")).alias("y1"), (F.greatest(ax, bx) + F.col("_x")).alias("x2"), (F.greatest(ay, by) + F.col("_y")).alias("y2"), "n")
