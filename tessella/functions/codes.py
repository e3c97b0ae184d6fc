"""Small encodings of layout formats as expressions: escaped lists, orientations, properties, numbers and quoted strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that lists use, in the order in which they are escaped (and unescaped backwards).
ESCAPES = (("%", "%25"), ("|", "%7C"), ("/", "%2F"), (",", "%2C"))
#: Mirror and angle of each orientation.
ORIENTATIONS = {"N": (False, 0.0), "S": (False, 180.0), "E": (False, 90.0), "W": (False, 270.0), "FN": (True, 0.0), "FS": (True, 180.0), "FE": (True, 90.0), "FW": (True, 270.0)}


def escape(text: Column) -> Column:
    for mark, code in ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for mark, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _parts(item: Column, mark: str) -> Column:
    return F.split(item, f"\\Q{mark}\\E", -1)


def encode_connections(connections: Column) -> Column:
    """Structs component, pin as one string."""
    return F.array_join(F.transform(connections, lambda c: F.concat(escape(c["component"]), F.lit("/"), escape(c["pin"]))), "|")


def decode_connections(text: Column) -> Column:
    """The way back; items without a slash are left out."""
    items = F.filter(F.transform(_parts(text, "|"), lambda i: F.split(i, "/", 2)), lambda p: F.size(p) == 2)
    return F.when(text == "", F.array().cast("array<struct<component:string,pin:string>>")).otherwise(F.transform(items, lambda p: F.struct(unescape(p[0]).alias("component"), unescape(p[1]).alias("pin"))))


def encode_route_points(points: Column) -> Column:
    """Structs x, y, ext, via, null as a star, as one string."""
    star = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", star(p["x"]), star(p["y"]), star(p["ext"]), F.coalesce(escape(p["via"]), F.lit("*")))), "|")


def decode_route_points(text: Column) -> Column:
    whole = lambda p, i: F.when(F.get(p, F.lit(i)) != "*", F.get(p, F.lit(i)).cast("int"))
    point = lambda p: F.struct(whole(p, 0).alias("x"), whole(p, 1).alias("y"), whole(p, 2).alias("ext"), F.when(F.get(p, F.lit(3)) != "*", unescape(F.get(p, F.lit(3)))).alias("via"))
    found = F.transform(_parts(text, "|"), lambda i: point(_parts(i, ",")))
    return F.when(text == "", F.array().cast("array<struct<x:int,y:int,ext:int,via:string>>")).otherwise(found)


def resolved(points: Column) -> Column:
    """Points (structs x, y, via) without vias, a missing coordinate taken from the point before, 0 before the first."""
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.array().cast("array<struct<x:int,y:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        x, y = F.coalesce(p["x"], s["x"]), F.coalesce(p["y"], s["y"])
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(F.struct(x.alias("x"), y.alias("y")))).alias("out"))

    return F.aggregate(F.filter(points, lambda p: p["via"].isNull()), start, step, lambda s: s["out"])


def transform_of(orientation: Column) -> Column:
    """Struct mirror, angle of an orientation; null for an unknown one."""
    table = F.create_map(*(x for k, (m, a) in ORIENTATIONS.items() for x in (F.lit(k), F.struct(F.lit(m).alias("mirror"), F.lit(a).alias("angle")))))
    return F.try_element_at(table, orientation)


def orientation_of(mirror: Column, angle: Column) -> Column:
    """The orientation of whole quarter turns; other angles count as none."""
    turn = F.pmod(angle.cast("bigint"), F.lit(360))
    name = F.lit("N")
    for k, (m, a) in ORIENTATIONS.items():
        if not m and a:
            name = F.when(turn == int(a), k).otherwise(name)
    return F.when(mirror, F.concat(F.lit("F"), name)).otherwise(name)


def property_map(properties: Column) -> Column:
    """Strings key=value as a map; the first value of a key counts, strings without = are left out."""
    pairs = F.filter(F.transform(properties, lambda p: F.split(p, "=", 2)), lambda p: F.size(p) == 2)
    fresh = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q[0] == p[0]))
    return F.map_from_entries(F.transform(fresh, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


def packed(record: Column) -> Column:
    """A struct as base64 of its JSON."""
    return F.base64(F.to_json(record).cast("binary"))


def unpacked(text: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(text).cast("string"), schema)


def unquoted(text: Column) -> Column:
    return F.when(F.length(text) >= 2, F.regexp_replace(text, '^"(.*)"$', "$1")).otherwise(text)


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others as written."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def stable_mean(values: Column) -> Column:
    """The mean of an array of doubles, scaled first so that no sum overflows; null of an empty one."""
    top = F.array_max(F.transform(values, F.abs))
    n = F.size(values).cast("double")
    return F.when(top == 0, F.lit(0.0)).otherwise(F.aggregate(values, F.lit(0.0), lambda s, v: s + v / top / n) * top)
