"""Designs as cells with properties, and back: what DEF says of nets, special nets, pins and vias travels as keys with values beside the drawn elements.

Properties are rows (file, seq, key, value), so that a design of any number of nets is a table; the first value of a key counts. On the way back a record needs
its name and an index below the count that is given. Routes are path elements with properties of their own: they are appended in their order to the
first net of their name, and a name that no record has makes a net behind the others, where its first route stands. So the way back is an upsert with
an order: a key for every record, the least place of each name, and routes joined to that.

The writer makes ordered lines (file, place, line); `texts` strings a file's lines together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import codes
from tessella.operators.sequences import running
from tessella.plans.session import materialise
from tessella.sources import def_
from tessella.sources.def_ import PLACE, _at, _clause, _named

# The keys.
NET, SPECIAL, PIN, VIA, ROUTE = "def.net", "def.specialNet", "def.pin", "def.viaDef", "def.route"
RECTS = "array<struct<layer:string,x1:int,y1:int,x2:int,y2:int>>"
SPOTS = "array<struct<x:int,y:int,ext:int,via:string>>"
FIELDS = {NET: ("name", "use", "connections"), SPECIAL: ("name", "use", "source", "weight", "connections"), PIN: ("name", "netName", "x", "y", "orientation", "placementStatus"), VIA: ("json",)}


# ---- to properties --------------------------------------------------------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    return running(rows, {"nth": F.lit(1)}).withColumn("nth", F.col("nth") - 1)


def _keyed(rows: DataFrame, rank: int, prefix: str, fields: dict[str, Column]) -> DataFrame:
    """Properties of numbered records (file, nth): the count, then each record's fields that aren't null."""
    at = lambda i: (F.lit(rank << 56) + F.col("nth") * 8 + (i + 1)).alias("seq")
    pairs = [F.struct(at(i), F.concat(F.lit(f"{prefix}."), F.col("nth").cast("string"), F.lit(f".{name}")).alias("key"), c.cast("string").alias("value")) for i, (name, c) in enumerate(fields.items())]
    own = rows.select("file", F.inline(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())))
    count = rows.groupBy("file").agg(F.count("*").cast("string").alias("value")).select("file", F.lit(rank << 56).alias("seq"), F.lit(f"{prefix}.count").alias("key"), "value")
    return count.unionByName(own)


def _nets(scanned: DataFrame, section: str) -> DataFrame:
    """Entries of a section of nets: file, nth, name, use, source, weight, connections (encoded, null without any)."""
    pairs = F.regexp_extract_all(F.array_join(F.get("clauses", F.lit(0)), " "), F.lit(r"\( (\S+ \S+) \)"), F.lit(1))
    joined = codes.encode_connections(F.transform(pairs, lambda c: F.struct(F.split(c, " ")[0].alias("component"), F.split(c, " ")[1].alias("pin"))))
    clause = lambda k: _at(_clause(k), 1)
    return _numbered(_named(scanned, section).select("file", "block", "seq", def_.word(1).alias("name"), clause("USE").alias("use"), clause("SOURCE").alias("source"), clause("WEIGHT").alias("weight"), F.when(F.size(pairs) > 0, joined).alias("connections")))


def properties(scanned: DataFrame) -> DataFrame:
    """file, seq, key, value of all nets, special nets, pins and vias of a design."""
    c = F.col
    out = _keyed(_nets(scanned, "NETS"), 0, NET, {k: c(k) for k in FIELDS[NET]})
    out = out.unionByName(_keyed(_nets(scanned, "SPECIALNETS"), 1, SPECIAL, {k: c(k) for k in FIELDS[SPECIAL]}))
    out = out.unionByName(_keyed(_numbered(def_.pins(scanned)), 2, PIN, {"name": c("pin"), "netName": c("net"), "x": F.coalesce("x", F.lit(0)), "y": F.coalesce("y", F.lit(0)), "orientation": F.coalesce("orientation", F.lit("N")), "placementStatus": F.upper("status")}))
    return out.unionByName(_keyed(_numbered(def_.vias(scanned)), 3, VIA, {"json": codes.packed(F.struct(c("via").alias("name"), "rects"))}))


def _paired(fields: dict[str, Column]) -> Column:
    return F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items())), lambda p: p["value"].isNotNull()))


def route_properties(scanned: DataFrame) -> DataFrame:
    """file, elem_order, properties (a map) of the path elements of a design."""
    out = None
    for rank, section, kind in ((2, "NETS", "net"), (3, "SPECIALNETS", "specialNet")):
        own = {f"{ROUTE}.kind": F.lit(kind), f"{ROUTE}.netName": F.col("net"), f"{ROUTE}.status": F.upper("status"), f"{ROUTE}.layerName": F.col("layer_name")}
        wires = def_.wires(scanned, section)
        if kind == "net":
            own[f"{ROUTE}.viaName"] = F.col("via")
        else:
            wires = wires.join(def_.route_points(scanned).drop("net"), ["file", "seq", "wire"])
            own |= {f"{ROUTE}.width": F.col("width"), f"{ROUTE}.specialPoints": codes.encode_route_points(F.col("spots"))}
        order = F.struct(F.lit(rank).alias("rank"), F.col("seq").cast(PLACE).alias("seq"), F.col("wire").cast("int").alias("wire"))
        one = wires.select("file", order.alias("elem_order"), _paired(own).alias("properties"))
        out = one if out is None else out.unionByName(one)
    return out


def elements(scanned: DataFrame, mapping: DataFrame) -> DataFrame:
    """The elements of each design's cell, paths with their properties."""
    return def_.elements(scanned, mapping).join(route_properties(scanned), ["file", "elem_order"], "left")


# ---- back to tables -------------------------------------------------------------------------------------------


def records(props: DataFrame, prefix: str) -> DataFrame:
    """file, nth and the fields of the records of a prefix that the properties hold, the first value of each key."""
    pattern = "^" + prefix.replace(".", r"\.") + r"\.(\d+)\.(.*)$"
    named = props.where(F.col("key").rlike(pattern)).select("file", F.regexp_extract("key", pattern, 1).try_cast("bigint").alias("nth"), F.regexp_extract("key", pattern, 2).alias("field"), "seq", "value")
    one = named.groupBy("file", "nth").agg(*(F.min_by("value", F.when(F.col("field") == f, F.col("seq"))).alias(f) for f in FIELDS[prefix]))
    # min_by of nulls alone gives a value of any row, so a field that has no row is null
    has = named.groupBy("file", "nth").agg(F.collect_set("field").alias("has"))
    counts = props.where(F.col("key") == f"{prefix}.count").groupBy("file").agg(F.min_by("value", "seq").try_cast("bigint").alias("n"))
    found = one.join(has, ["file", "nth"]).join(counts, "file").where("nth < n")
    return found.select("file", "nth", *(F.when(F.array_contains("has", f), F.col(f)).alias(f) for f in FIELDS[prefix])).where(F.col(FIELDS[prefix][0]).isNotNull())


def routes(element: DataFrame) -> DataFrame:
    """file, elem_order, kind, net, status, layer_name, via, width, points, spots of the path elements that name their net; what isn't given comes from the element."""
    p = lambda k: F.try_element_at("properties", F.lit(f"{ROUTE}.{k}"))
    own = F.transform("points", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.lit(None).cast("int").alias("ext"), F.lit(None).cast("string").alias("via")))
    spots = F.coalesce(codes.decode_route_points(p("specialPoints")), own)
    known = element.where("kind = 'path'").where(p("kind").isin("net", "specialNet") & p("netName").isNotNull())
    return known.select("file", "elem_order", p("kind").alias("kind"), p("netName").alias("net"), F.coalesce(F.when(p("status").isin("ROUTED", "FIXED", "COVER", "NEW"), p("status")), F.lit("ROUTED")).alias("status"), F.coalesce(p("layerName"), F.col("layer").cast("string")).alias("layer_name"), p("viaName").alias("via"), F.coalesce(p("width").try_cast("int"), F.col("width")).alias("width"), "points", spots.alias("spots"))


def nets(props: DataFrame, route: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nets (file, place, name and fields) in order, and their routes (file, place, elem_order, ...): records first, then names that only routes have, by their first route."""
    prefix = NET if kind == "net" else SPECIAL
    own = route.where(F.col("kind") == kind)
    least = F.struct(F.lit(None).cast("int").alias("rank"), F.lit(None).cast(PLACE).alias("seq"), F.lit(None).cast("int").alias("wire"))
    known = materialise(records(props, prefix), "def-records").withColumn("place", F.struct(F.lit(0).alias("late"), F.col("nth"), least.alias("first")))
    named = own.groupBy("file", F.col("net").alias("name")).agg(F.min("elem_order").alias("first"))
    fresh = named.join(known.select("file", "name").distinct(), ["file", "name"], "left_anti")
    late = F.struct(F.lit(1).alias("late"), F.lit(0).cast("bigint").alias("nth"), F.col("first"))
    every = materialise(known.drop("nth").unionByName(fresh.select("file", "name", late.alias("place")), allowMissingColumns=True), "def-nets")
    heads = every.groupBy("file", "name").agg(F.min("place").alias("place"))
    return every, own.join(heads.withColumnRenamed("name", "net"), ["file", "net"])


def document(scanned_tops: DataFrame, props: DataFrame, element: DataFrame) -> dict[str, DataFrame]:
    """All tables of the designs (file, design, dbu): die, components, pins, vias, nets with routes. Texts are pins where no pin records are given."""
    props, element = materialise(props, "def-properties"), materialise(element, "def-elements")
    base = def_.document(element)
    route = materialise(routes(element), "def-routes")
    counted = props.where(F.col("key") == f"{PIN}.count").select("file").distinct()
    of_text = base["pins"].join(counted, "file", "left_anti").select("file", F.struct(F.lit(1).alias("late"), F.lit(0).cast("bigint").alias("nth"), F.col("elem_order").alias("first")).alias("place"), "pin", "net", "x", "y", F.lit("N").alias("orientation"), F.lit("PLACED").alias("status"))
    none = F.lit(None).cast(of_text.schema["place"].dataType["first"].dataType)
    pin = records(props, PIN).select("file", F.struct(F.lit(0).alias("late"), "nth", none.alias("first")).alias("place"), F.col("name").alias("pin"), F.col("netName").alias("net"), F.col("x").try_cast("int").alias("x"), F.col("y").try_cast("int").alias("y"), "orientation", F.col("placementStatus").alias("status"))
    via = records(props, VIA).select("file", "nth", codes.unpacked(F.col("json"), f"name string, rects {RECTS}").alias("v")).select("file", "nth", "v.*")
    (net, net_routes), (special, special_routes) = (nets(props, route, kind) for kind in ("net", "specialNet"))
    return {"designs": scanned_tops, "die": base["die"], "components": base["components"], "pins": pin.unionByName(of_text), "vias": via, "nets": net, "net_routes": net_routes, "special": special, "special_routes": special_routes}


# ---- lines ----------------------------------------------------------------------------------------------------


def _spot(x: Column, y: Column, *more: Column) -> Column:
    star = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    return F.concat_ws(" ", F.lit("("), star(x), star(y), *more, F.lit(")"))


def lines(doc: dict[str, DataFrame]) -> DataFrame:
    """file, place (rank, order), line: the text of each design, a line an entry; sections that are empty aren't written."""
    s = lambda c: F.col(c).cast("string")
    clause = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f" + {key} "), c))
    say = lambda *parts: F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    tops = doc["designs"]
    head = tops.join(doc["die"], "file", "left").select("file", F.lit("").alias("key"), say(F.lit("VERSION 5.8 ;\nDESIGN "), F.col("design"), F.lit(" ;\nUNITS DISTANCE MICRONS "), codes.number_text(F.col("dbu")), F.lit(" ;"), F.when(F.col("points").isNotNull(), F.concat(F.lit("\nDIEAREA "), F.array_join(F.transform(def_.die_area(F.col("points")), lambda p: _spot(p["x"], p["y"])), " "), F.lit(" ;")))).alias("line"))
    out = [head.select("file", F.struct(F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("nth")).alias("place"), "line")]

    def section(rank: int, name: str, rows: DataFrame, order: str, line: Column) -> None:
        keyed = materialise(rows.select("file", F.col(order).alias("order"), F.concat(F.lit("- "), line, F.lit(" ;")).alias("line")), "def-lines")
        numbered = running(keyed.select("file", F.lit(0).cast("bigint").alias("block"), F.col("order").alias("seq"), "line"), {"nth": F.lit(1)})
        out.append(numbered.select("file", F.struct(F.lit(rank).alias("rank"), "nth").alias("place"), "line"))
        ends = keyed.groupBy("file").agg(F.count("*").alias("n"))
        for nth, text in ((F.lit(0).cast("bigint"), F.concat(F.lit(f"{name} "), s("n"), F.lit(" ;"))), (F.lit(1 << 62), F.lit(f"END {name}"))):
            out.append(ends.select("file", F.struct(F.lit(rank).alias("rank"), nth.alias("nth")).alias("place"), text.alias("line")))

    section(1, "VIAS", doc["vias"], "nth", say(F.col("name"), F.array_join(F.transform("rects", lambda r: F.concat_ws(" ", F.lit(" + RECT"), r["layer"], _spot(r["x1"], r["y1"]), _spot(r["x2"], r["y2"]))), "")))
    section(2, "COMPONENTS", doc["components"], "elem_order", say(F.col("component"), F.lit(" "), F.col("macro"), F.lit(" + PLACED "), _spot(F.col("x"), F.col("y")), F.lit(" "), F.col("orientation")))
    section(3, "PINS", doc["pins"], "place", say(F.col("pin"), clause("NET", F.col("net")), F.lit(" + "), F.coalesce("status", F.lit("PLACED")), F.lit(" "), _spot(F.col("x"), F.col("y")), F.lit(" "), F.coalesce("orientation", F.lit("N"))))
    for rank, name, net, route in ((4, "SPECIALNETS", "special", "special_routes"), (5, "NETS", "nets", "net_routes")):
        pairs = F.array_join(F.transform(codes.decode_connections(F.col("connections")), lambda c: F.concat_ws(" ", F.lit(" ("), c["component"], c["pin"], F.lit(")"))), "")
        wide = [F.lit(" "), s("width")] if net == "special" else []
        drawn = F.transform("spots", lambda p: F.coalesce(p["via"], F.when(p["ext"].isNull(), _spot(p["x"], p["y"])).otherwise(_spot(p["x"], p["y"], p["ext"].cast("string"))))) if net == "special" else F.transform("points", lambda p: _spot(p["x"], p["y"]))
        wire = say(F.col("layer_name"), *wide, F.lit(" "), F.array_join(drawn, " "), F.when(F.col("via").isNotNull(), F.concat(F.lit(" "), "via")))
        traced = doc[route].groupBy("file", "place").agg(F.sort_array(F.collect_list(F.struct("elem_order", F.col("status").alias("status"), wire.alias("wire")))).alias("w"))
        text = F.array_join(F.transform("w", lambda w, i: F.concat(F.when((i > 0) & (w["status"] == "ROUTED"), " + NEW ").otherwise(F.concat(F.lit(" + "), w["status"], F.lit(" "))), w["wire"])), "")
        extra = [clause(k.upper(), F.col(k)) for k in ("source", "weight") if net == "special"]
        section(rank, name, doc[net].join(traced, ["file", "place"], "left"), "place", say(F.col("name"), pairs, clause("USE", F.col("use")), *extra, text))
    out.append(tops.select("file", F.struct(F.lit(9).alias("rank"), F.lit(0).cast("bigint").alias("nth")).alias("place"), F.lit("END DESIGN").alias("line")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def texts(ordered: DataFrame) -> DataFrame:
    """file, text of ordered lines."""
    return ordered.groupBy("file").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
