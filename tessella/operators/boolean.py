"""Region algebra: union, intersection, symmetric difference and difference of rectangle or polygon tables.

Results are canonical disjoint bands: coverage always equals that of the operands, also where an operand overlaps itself. Polygon operands
must be rectilinear; the first that isn't raises with its operand and index, left before right, even if the other side is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.points import is_manhattan
from tessella.operators.bands import TILE, bands_where, polygon_bands, slab_cells

KEEP = {"union": "a > 0 or b > 0", "intersection": "a > 0 and b > 0", "symmetric_difference": "(a > 0) <> (b > 0)", "difference": "a > 0 and b = 0"}


class NonManhattanError(ValueError):
    """An operand has a polygon with an edge that isn't parallel to an axis."""

    def __init__(self, operand: str, index: int):
        super().__init__(f"polygon {index} of the {operand} operand isn't rectilinear")
        self.operand, self.index = operand, index


def require_manhattan(polygons: DataFrame, operand: str) -> None:
    first = polygons.where(~is_manhattan(F.col("points"))).agg(F.min("poly_idx")).first()[0]
    if first is not None:
        raise NonManhattanError(operand, first)


def boolean(operation: str, a: DataFrame, b: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Bands of the operation on two rectangle tables."""
    return bands_where(operation, a, b, keys, tile, wide)


def boolean_polygons(operation: str, a: DataFrame, b: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Bands of the operation on two polygon tables (keys, poly_idx, points)."""
    require_manhattan(a, "left")
    require_manhattan(b, "right")
    return boolean(operation, polygon_bands(a, keys), polygon_bands(b, keys), keys, tile, wide)


def area(column: str | Column = "area") -> Column:
    """Sum of the areas of bands."""
    return F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias(column)


def boolean_areas(a: DataFrame, b: DataFrame, keys: Sequence[str], tile: int = TILE, wide: bool = True) -> DataFrame:
    """Areas of all four operations in one sweep: no bands are joined up."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return slab_cells(a, b, keys, tile, wide).groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.expr(cond), size)), F.lit(0)).alias(f"{name}_area") for name, cond in KEEP.items()))
