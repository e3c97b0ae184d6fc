"""Compact shapes and repetitions: trapezoids by type number, polygons as differences, and grids found again among placements.

A type of trapezoid is a row of a coefficient table: each corner is a sum of width and height in sixths, cut to whole units where they are divided, so one
product makes all types of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rings
from tessella.functions.curves import MAX_COPIES, grid_offsets
from tessella.operators.sequences import must

# Fixed values of the format: the corners of types 0 to 24 in a box of width w and height h, from its lower left corner. w2 is half the width, h3 a third of the height.
CORNERS = (
    "h,0 w,0 w,h 0,h",
    "0,0 w-h,0 w,h 0,h",
    "0,0 w,0 w,h h,h",
    "0,0 w,0 w-h,h 0,h",
    "h,0 w,0 w,h 0,h2",
    "0,0 w-h,0 w,h2 0,h",
    "h,0 w,0 w-h,h 0,h",
    "0,0 w-h,0 w,h h,h",
    "0,w 0,0 w,0 w,h",
    "0,0 w,0 w,h 0,h-w",
    "0,0 w,w w,h 0,h",
    "0,0 w,0 w,h-w 0,h",
    "0,w w2,0 w,w w,h 0,h",
    "0,0 w,0 w,h-w w2,h 0,h-w",
    "0,w w,0 w,h-w 0,h",
    "0,0 w,w w,h 0,h-w",
    "0,0 w,0 w,h 0,h",
    "0,0 w,0 w,w 0,w",
    "h3,0 w-h3,0 w,h3 w,h-h3 w-h3,h h3,h 0,h-h3 0,h3",
    "w3,0 w-w3,0 w,w3 w,w-w3 w-w3,w w3,w 0,w-w3 0,w3",
    "0,0 w,h2 0,h",
    "w,0 w,h 0,h2",
    "0,0 w,0 w2,h",
    "w2,0 w,h 0,h",
    "0,0 w,w2 0,w",
)
UNITS = ("w", "h", "w2", "h2", "w3", "h3")


def coefficients(token: str) -> list[int]:
    """How often each of UNITS is in a sum such as w-h3."""
    found = [0] * len(UNITS)
    for sign, unit in re.findall(r"([+-]?)([wh][23]?)", token):
        found[UNITS.index(unit)] += -1 if sign == "-" else 1
    return found


def compact_trapezoid(kind: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The closed ring of a trapezoid of a type; a type that isn't known, and a corner beyond 32 bits, raise."""
    table = [[tuple(coefficients(t) for t in c.split(",")) for c in row.split()] for row in CORNERS]
    return rings.from_table(kind, x, y, width, height, table)


deltas, from_deltas = rings.deltas, rings.from_deltas


def array_step(origin: Column, end: Column, count: Column) -> Column:
    """The step of `count` copies whose reference vector ends at `end`; one that isn't whole units raises."""
    dx, dy = (end[c].cast("long") - origin[c].cast("long") for c in "xy")
    whole = must((dx % count == 0) & (dy % count == 0), "the step of an array is no whole number of units", F.lit(True))
    return F.when(whole, F.struct((dx / count).cast("long").alias("x"), (dy / count).cast("long").alias("y"))).cast("struct<x:bigint,y:bigint>")


# ---- arrays among placements ------------------------------------------------------------------------------------


def _runs(rows: DataFrame, group: list[str], along: str, to: tuple[str, str]) -> DataFrame:
    """Rows of a group that follow each other in equal steps along a column, as one row: the first place, how many (to[0]) and the step (to[1], 0 of one)."""
    line = Window.partitionBy(*group).orderBy(along)
    gap = F.col(along) - F.lag(along).over(line)
    stepped = rows.withColumn("_gap", gap).withColumn("_gap", F.coalesce("_gap", F.lead("_gap").over(line)))  # the first goes with the second
    fresh = F.when(F.lag("_gap").over(line).eqNullSafe(F.col("_gap")), 0).otherwise(1)
    marked = stepped.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(line))
    return marked.groupBy(*group, "_run").agg(F.min(along).alias(along), F.count("*").alias(to[0]), F.max(along).alias("_last")).withColumn(to[1], F.when(F.col(to[0]) > 1, F.expr(f"(_last - {along}) div ({to[0]} - 1)")).otherwise(F.lit(0))).drop("_run", "_last")


def arrays(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Placements (keys, x, y) as arrays: keys, x, y, columns, rows, dx, dy. Gaps and islands twice: equal steps along x in each row, then equal rows along y.

    Every placement is in one array, single ones in arrays of one; equal placements make steps of 0. A row of one y is sorted by one task.
    """
    keys = list(keys)
    across = _runs(placed.select(*keys, "x", "y"), [*keys, "y"], "x", ("columns", "dx"))
    grids = _runs(across, [*keys, "x", "columns", "dx"], "y", ("rows", "dy"))
    return grids.select(*keys, "x", "y", "columns", "rows", "dx", "dy")


def expanded(array: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The placements of arrays; of more than MAX_COPIES copies an array is dealt out by its rows first."""
    by_row = array.withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    zero = F.lit(0).cast("long")
    stretch = by_row.withColumn("_from", F.explode(F.sequence(zero, F.col("columns") - 1, F.lit(MAX_COPIES).cast("long"))))
    copies = F.least(F.col("columns") - F.col("_from"), F.lit(MAX_COPIES).cast("long"))
    spot = stretch.withColumn("_at", F.explode(grid_offsets(copies, F.lit(1), (F.col("dx"), zero), (zero, zero))))
    return spot.select(*keys, (F.col("x") + F.col("_from") * F.col("dx") + F.col("_at.x")).alias("x"), (F.col("y") + F.col("_row") * F.col("dy")).alias("y"))
