"""Points of arcs, circles, ellipses and bulges, of repetitions, and of polygons with offset edges, as expressions over sequences.

Coordinates are given in microns (doubles) and become database units by truncation toward zero; out of 32 bits raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 6.283185307179586
MAX_COPIES = 1_000_000  # fixed: what one repetition may have


def units(number: Column, scale: float | Column) -> Column:
    return (number * (scale if isinstance(scale, Column) else F.lit(float(scale)))).cast("int")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def let(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _steps(segments: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: i.cast("double") / float(segments))


def _remainder(angle: Column) -> Column:
    """What is left of whole turns, with the sign of the angle."""
    return angle - F.lit(TURN) * F.when(angle < 0, F.ceil(angle / TURN)).otherwise(F.floor(angle / TURN)).cast("double")


def sweep(start: Column, end: Column) -> Column:
    """Counter-clockwise turn from start to end; at least a little, at most a whole one where end isn't beyond start."""
    return let(end - start, lambda d: F.when(d > 0, d).otherwise(let(_remainder(d), lambda left: F.when(left > 0, left).otherwise(left + TURN))))


def _along(start: Column, turn: Column, steps: Column) -> Column:
    """Angles at the steps of a turn."""
    return let(F.struct(start.alias("start"), turn.alias("turn")), lambda a: F.transform(steps, lambda t: a["start"] + t * a["turn"]))


def _ring(cx: Column, cy: Column, radius: Column, angles: Column, scale: float) -> Column:
    return let(F.struct(cx.alias("x"), cy.alias("y"), radius.alias("r")), lambda c: F.transform(angles, lambda a: point(units(c["x"] + c["r"] * F.cos(a), scale), units(c["y"] + c["r"] * F.sin(a), scale))))


def circle(cx: Column, cy: Column, radius: Column, segments: int, scale: float) -> Column:
    return _ring(cx, cy, radius, F.transform(_steps(segments), lambda t: t * TURN), scale)


def arc(cx: Column, cy: Column, radius: Column, start_degrees: Column, end_degrees: Column, segments: int, scale: float) -> Column:
    a, b = (x / 180.0 * (TURN / 2) for x in (start_degrees, end_degrees))
    return _ring(cx, cy, radius, _along(_remainder(a), sweep(a, b), _steps(segments)), scale)


def ellipse(cx: Column, cy: Column, major_x: Column, major_y: Column, ratio: Column, start: Column, end: Column, segments: int, scale: float) -> Column:
    """The major axis is a vector from the centre; start and end are parameters in radians."""
    length = F.sqrt(major_x * major_x + major_y * major_y)
    shape = F.struct(cx.alias("x"), cy.alias("y"), length.alias("a"), (length * ratio).alias("b"), F.atan2(major_y, major_x).alias("tilt"))

    def at(s: Column, e: Column) -> Column:
        return point(units(s["x"] + e["x"] * F.cos(s["tilt"]) - e["y"] * F.sin(s["tilt"]), scale), units(s["y"] + e["x"] * F.sin(s["tilt"]) + e["y"] * F.cos(s["tilt"]), scale))

    angles = _along(_remainder(start), sweep(start, end), _steps(segments))
    return let(shape, lambda s: F.transform(F.transform(angles, lambda a: F.struct((s["a"] * F.cos(a)).alias("x"), (s["b"] * F.sin(a)).alias("y"))), lambda e: at(s, e)))


def bulge(p: Column, q: Column, value: Column, segments: int, scale: float) -> Column:
    """Points strictly between p and q (structs x, y) on the arc whose included angle is four times the arc tangent of value; none for 0 or p = q."""
    inner = F.transform(F.sequence(F.lit(1), F.lit(segments - 1)), lambda i: i.cast("double") / float(segments))

    def chord(v: Column) -> Column:
        length = F.sqrt(v["dx"] * v["dx"] + v["dy"] * v["dy"])
        return F.struct(v["x"].alias("x"), v["y"].alias("y"), v["dx"].alias("dx"), v["dy"].alias("dy"), v["b"].alias("b"), length.alias("length"), (F.abs(v["b"]) * length / 2.0).alias("depth"))

    def centre(c: Column) -> Column:
        radius = (c["length"] * c["length"] / 4.0 + c["depth"] * c["depth"]) / (2.0 * c["depth"])
        return let(radius, lambda r: let(F.when(c["b"] > 0, 1.0).otherwise(-1.0) * (r - c["depth"]), lambda away: F.struct(r.alias("r"), (c["x"] + c["dx"] / 2.0 - away * c["dy"] / c["length"]).alias("cx"), (c["y"] + c["dy"] / 2.0 + away * c["dx"] / c["length"]).alias("cy"))))

    def angles(c: Column, m: Column) -> Column:
        a, b = F.atan2(c["y"] - m["cy"], c["x"] - m["cx"]), F.atan2(c["y"] + c["dy"] - m["cy"], c["x"] + c["dx"] - m["cx"])
        # one turn is added where an arc runs past half a turn's border: to its end if it runs forward, else to its start
        both = F.struct(a.alias("a"), b.alias("b"))
        return let(both, lambda t: let(F.when((c["b"] < 0) & (t["a"] <= t["b"]), t["a"] + TURN).otherwise(t["a"]), lambda start: _along(start, F.when((c["b"] > 0) & (t["b"] <= t["a"]), t["b"] + TURN).otherwise(t["b"]) - start, inner)))

    given = F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"), value.alias("b"))
    made = let(let(given, chord), lambda c: F.when((c["b"] == 0) | (c["length"] == 0), F.array().cast("array<struct<x:int,y:int>>")).otherwise(let(centre(c), lambda m: _ring(m["cx"], m["cy"], m["r"], angles(c, m), scale))))
    return made


# ---- repetitions and trapezoids in database units -----------------------------------------------------------------


def _spot(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def grid_offsets(columns: Column, rows: Column, column_step: tuple[Column, Column], row_step: tuple[Column, Column]) -> Column:
    """Offsets of a grid, column by column within each row; each step is a vector. More copies than MAX_COPIES raise."""
    (ax, ay), (bx, by) = column_step, row_step
    n = columns.cast("long") * rows.cast("long")
    spots = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: _spot((i % columns) * ax + F.floor(i / columns) * bx, (i % columns) * ay + F.floor(i / columns) * by))
    return F.when((columns >= 1) & (rows >= 1) & (n <= MAX_COPIES), spots).otherwise(F.raise_error(F.lit("a repetition has no copies or too many")))


def line_offsets(steps: Column, vertical: Column) -> Column:
    """Offsets along an axis from the gaps between copies: the first copy is at 0."""
    upto = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.transform(upto, lambda d: F.when(vertical, _spot(F.lit(0), d)).otherwise(_spot(d, F.lit(0))))


def path_offsets(steps: Column) -> Column:
    """Offsets from displacement vectors (structs x, y) between copies: the first copy is at the origin."""
    total = lambda i, c: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0).cast("long"), lambda s, p: s + p[c])
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: _spot(total(i, "x"), total(i, "y")))


def moved(points: Column, offset: Column) -> Column:
    """Points translated by an offset; out of 32 bits raises."""
    return F.transform(points, lambda p: point(p["x"].cast("long") + offset["x"], p["y"].cast("long") + offset["y"]))


def rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.array(point(x, y), point(x + width, y), point(x + width, y + height), point(x, y + height), point(x, y))


def trapezoid(x: Column, y: Column, width: Column, height: Column, delta_a: Column, delta_b: Column, upright: Column) -> Column:
    """A box whose two parallel sides are shortened: lying ones move the ends of bottom and top, upright ones those of left and right.

    A delta greater than 0 moves the corner of the upper (right) side inward, one less than 0 that of the lower (left) side.
    """
    up, down = (lambda d: F.greatest(d, F.lit(0))), (lambda d: F.greatest(-d, F.lit(0)))
    flat = F.array(point(x + down(delta_a), y), point(x + width - up(delta_b), y), point(x + width - down(delta_b), y + height), point(x + up(delta_a), y + height), point(x + down(delta_a), y))
    tall = F.array(point(x, y + down(delta_a)), point(x + width, y + up(delta_a)), point(x + width, y + height - down(delta_b)), point(x, y + height - up(delta_b)), point(x, y + down(delta_a)))
    return F.when(upright, tall).otherwise(flat)


def round_polygon(x: Column, y: Column, radius: Column, sides: int = 64) -> Column:
    """A circle as a closed polygon in database units, cut toward zero."""
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda i: point((x + radius * F.cos((i % sides).cast("double") * TURN / sides)).cast("long"), (y + radius * F.sin((i % sides).cast("double") * TURN / sides)).cast("long")))


# ---- sized polygons -------------------------------------------------------------------------------------------


def _rounded(x: Column, y: Column) -> Column:
    return F.struct(F.round(x).cast("int").alias("x"), F.round(y).cast("int").alias("y"))


def corners(ring: Column) -> Column:
    """Of an open counter-clockwise ring: at every vertex its place, the edges that come (a) and go (b), and their lengths. A vertex that repeats the one before is left out."""
    bare = F.filter(ring, lambda p, i: p != F.when(i > 0, F.get(ring, i - 1)).otherwise(F.element_at(ring, -1)))

    def edge(p: Column, q: Column, name: str) -> list[Column]:
        dx, dy = (q[c].cast("double") - p[c] for c in "xy")
        return [dx.alias(f"{name}x"), dy.alias(f"{name}y"), F.sqrt(dx * dx + dy * dy).alias(f"{name}l")]

    def around(kept: Column) -> Column:
        n = F.size(kept)
        place = lambda c: [c[k].cast("double").alias(k) for k in "xy"]
        return F.transform(kept, lambda c, i: F.struct(*place(c), *edge(F.get(kept, (i + n - 1) % n), c, "a"), *edge(c, F.get(kept, (i + 1) % n), "b")))

    return let(bare, around)


def _crossing(c: Column, by: float) -> Column:
    """Where the lines of both edges, moved outward, cross. u from the vertex lies on the moved line of an edge if the cross product of u and the edge is `by` times its length,
    so u is a quotient by the cross product of the edges. An edge that goes straight on is moved as one; at one that turns back the vertex stays."""
    turn = c["ax"] * c["by"] - c["ay"] * c["bx"]
    onward = c["ax"] * c["bx"] + c["ay"] * c["by"] > 0
    crossed = _rounded(c["x"] + by * (c["ax"] * c["bl"] - c["bx"] * c["al"]) / turn, c["y"] + by * (c["ay"] * c["bl"] - c["by"] * c["al"]) / turn)
    straight = _rounded(c["x"] + by * c["ay"] / c["al"], c["y"] - by * c["ax"] / c["al"])
    return F.when(turn != 0, crossed).when(onward, straight).otherwise(_rounded(c["x"], c["y"]))


def square_offset(ring: Column, by: float) -> Column:
    return F.transform(corners(ring), lambda c: _crossing(c, by))


def octagonal_offset(ring: Column, by: float) -> Column:
    """Each moved corner is cut by 45 degrees, along both edges, but where the ring turns back."""
    cut = abs(by) * (1.0 - 0.5**0.5)

    def at(c: Column) -> Column:
        along = lambda m, e, way: _rounded(m["x"] + way * cut / c[f"{e}l"] * c[f"{e}x"], m["y"] + way * cut / c[f"{e}l"] * c[f"{e}y"])
        back = (c["ax"] * c["by"] == c["ay"] * c["bx"]) & (c["ax"] * c["bx"] + c["ay"] * c["by"] < 0)
        return let(_crossing(c, by), lambda m: F.when(back, F.array(m)).otherwise(F.array(along(m, "a", -1), along(m, "b", 1))))

    return F.flatten(F.transform(corners(ring), at))


def round_offset(ring: Column, by: float, segments: int) -> Column:
    """Each corner becomes an arc around its vertex, of `segments` pieces a quarter turn."""

    def at(c: Column) -> Column:
        first = F.atan2(-c["ax"], c["ay"])
        way = lambda raw: F.when(raw < 0, raw + TURN).otherwise(raw) if by > 0 else F.when(raw > 0, raw - TURN).otherwise(raw)
        turn = let(F.atan2(-c["bx"], c["by"]) - first, way)
        pieces = lambda t: F.greatest(F.lit(1), (F.lit(float(max(segments, 1))) * F.abs(t) / (TURN / 4)).cast("int"))
        steps = let(turn, lambda t: let(pieces(t), lambda n: F.transform(F.sequence(F.lit(0), n), lambda s: first + s / n * t)))
        return F.transform(steps, lambda a: _rounded(c["x"] + abs(by) * F.cos(a), c["y"] + abs(by) * F.sin(a)))

    return F.flatten(F.transform(corners(ring), at))
