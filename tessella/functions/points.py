"""Expressions over arrays of points (x, y). Integer arithmetic is 64-bit and fails on overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(points: Column) -> Column:
    return F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))


def edges(points: Column) -> Column:
    """Consecutive pairs as structs x1, y1, x2, y2 (long): one less than there are points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), _next(points), lambda p, q: F.struct(p["x"].cast("long").alias("x1"), p["y"].cast("long").alias("y1"), q["x"].cast("long").alias("x2"), q["y"].cast("long").alias("y2")))


def is_manhattan(points: Column) -> Column:
    """Every edge is parallel to an axis; true for fewer than three points."""
    return (F.size(points) < 3) | F.forall(edges(points), lambda e: (e["x1"] == e["x2"]) | (e["y1"] == e["y2"]))


def doubled_area(points: Column) -> Column:
    """Twice the shoelace sum over the ring, closed if it isn't."""
    ring = F.concat(points, F.slice(points, 1, 1))
    return F.aggregate(edges(ring), F.lit(0).cast("long"), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])


def signed_area(points: Column) -> Column:
    """Positive when counter-clockwise, truncated toward zero; 0 for fewer than three points."""
    doubled = doubled_area(points)
    half = F.signum(doubled).cast("long") * F.floor(F.abs(doubled) / 2).cast("long")
    return F.when(F.size(points) < 3, F.lit(0).cast("long")).otherwise(half)


def polygon_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def edge_count(points: Column) -> Column:
    return F.greatest(F.size(points) - 1, F.lit(0))


def bounding_box(points: Column) -> Column:
    """Struct x1, y1, x2, y2, or null without points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def closed(points: Column) -> Column:
    """The ring with its first point at the end; fewer than three points stay."""
    return F.when((F.size(points) >= 3) & (F.element_at(points, 1) != F.element_at(points, -1)), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def counter_clockwise(points: Column) -> Column:
    """The ring turned if it is clockwise; a closing point stays the closing point."""
    n = F.size(points)
    open_ = F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0)))
    turned = F.when(F.element_at(points, 1) == F.element_at(points, -1), F.concat(F.reverse(open_), F.slice(open_, F.lit(-1), F.lit(1)))).otherwise(F.reverse(points))
    return F.when(signed_area(points) < 0, turned).otherwise(points)


def is_rectangle(points: Column) -> Column:
    """A closed ring of four corners of an axis-aligned box."""
    box = bounding_box(points)
    corner = F.forall(points, lambda p: ((p["x"] == box["x1"]) | (p["x"] == box["x2"])) & ((p["y"] == box["y1"]) | (p["y"] == box["y2"])))
    return (F.size(points) == 5) & (F.element_at(points, 1) == F.element_at(points, -1)) & corner & is_manhattan(points) & (polygon_area(points) == (box["x2"] - box["x1"]).cast("long") * (box["y2"] - box["y1"]).cast("long"))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Ray casting to the right, crossings computed with truncated integer division."""

    def crossing(e: Column) -> Column:  # the later point of an edge is the base of the division
        spans = (e["y1"] > y) != (e["y2"] > y)
        run = (e["x1"] - e["x2"]) * (y - e["y2"])
        rise = F.when(e["y2"] == e["y1"], F.lit(1)).otherwise(e["y1"] - e["y2"])
        cut = F.signum(run).cast("long") * F.signum(rise).cast("long") * F.floor(F.abs(run) / F.abs(rise)).cast("long")
        return spans & (x < cut + e["x2"])

    ring = F.concat(points, F.slice(points, 1, 1))
    return (F.size(points) >= 3) & (F.size(F.filter(edges(ring), crossing)) % 2 == 1)
