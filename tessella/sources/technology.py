"""Technology libraries: layers, vias, sites and rules of LEF as one JSON document a file, decoded strictly, and back to LEF; spacing tables and their lookup.

A document is decoded twice: as maps from keys to raw JSON, which tell a missing key from a null, and by its schema. `faults` names every key that is missing, null, or
of another type; `decoded` raises the first. A spacing table is ragged: one row for each of its widths and run lengths. A lookup goes by
equality to the layer's table, an array a layer, and finds both places within it, so probes of one layer are never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.codes import number_text
from tessella.sources import lef
from tessella.sources.lef import word

# The document's keys, those that must be there and not null, and the words that some take.
TABLE = "struct<entries:array<struct<width:double,spacing:double>>>"
LAYER = f"struct<name:string,type:string,direction:string,pitch:double,width:double,spacing:double,resistance:double,capacitance:double,thickness:double,spacingTable:{TABLE},minArea:double>"
RECTS = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
VIA = f"struct<name:string,cutLayerName:string,topLayerName:string,bottomLayerName:string,layers:array<struct<layerName:string,rects:{RECTS}>>>"
SITE = "struct<name:string,siteClass:string,width:double,height:double,symmetry:array<string>>"
RULE = "struct<layerName:string,minWidth:double,minSpacing:double,minArea:double>"
ENCLOSURE = "struct<outerLayerName:string,innerLayerName:string,minEnclosure:double>"
LIBRARY = {"name": "string", "dbuPerMicron": "double", "layers": f"array<{LAYER}>", "vias": f"array<{VIA}>", "sites": f"array<{SITE}>", "designRules": f"array<{RULE}>", "enclosureRules": f"array<{ENCLOSURE}>", "extensionRules": "array<map<string,string>>", "minimumCutRules": "array<map<string,string>>", "antennaRules": "array<map<string,string>>", "metadata": "map<string,string>"}
REQUIRED = {"layers": ("name", "type"), "vias": ("name", "cutLayerName", "topLayerName", "bottomLayerName", "layers"), "sites": ("name", "symmetry"), "designRules": ("layerName",), "enclosureRules": ("outerLayerName", "innerLayerName", "minEnclosure"), "extensionRules": ("outerLayerName", "innerLayerName", "minExtension"), "minimumCutRules": ("name", "cutLayerName", "bottomLayerName", "topLayerName", "minimumCount"), "antennaRules": ("layerName", "maxRatio")}
WORDS = {"layers": {"type": ("routing", "cut", "masterslice", "overlap", "implant"), "direction": ("horizontal", "vertical")}, "sites": {"siteClass": ("core", "pad")}}
NUMBERS = {"layers": ("pitch", "width", "spacing", "resistance", "capacitance", "thickness", "minArea"), "sites": ("width", "height"), "designRules": ("minWidth", "minSpacing", "minArea"), "enclosureRules": ("minEnclosure",), "extensionRules": ("minExtension",), "antennaRules": ("maxRatio",)}
SCHEMA = ", ".join(f"{k} {t}" for k, t in LIBRARY.items())


# ---- spacing tables -------------------------------------------------------------------------------------------


def spacing_tables(scanned: DataFrame) -> DataFrame:
    """file, layer_name, width, nth, length, spacing: a row for each cell of the tables by parallel run length. Rows of widths may end in semicolons of their own."""
    inside = scanned.where("top = 'LAYER'")
    numbers = lambda text: F.filter(F.transform(F.split(F.trim(text), " "), lambda w: w.try_cast("double")), lambda x: x.isNotNull())
    parts = F.split(F.array_join("words", " "), r"(?i)\s+WIDTH\s+")
    head = inside.where((F.upper(word(0)) == "SPACINGTABLE") & (F.upper(word(1)) == "PARALLELRUNLENGTH"))
    lengths = head.groupBy("file", "section").agg(F.min_by(numbers(F.get(parts, F.lit(0))), "seq").alias("lengths"))
    own = head.select("file", "section", "name", F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("row"))
    later = inside.where((F.upper(word(0)) == "WIDTH") & (F.size("words") > 2)).select("file", "section", "name", F.array_join(lef.rest("words"), " ").alias("row"))
    rows = own.unionByName(later).select("file", "section", "name", numbers(F.col("row")).alias("n")).where("size(n) > 0").join(lengths, ["file", "section"])
    cells = rows.select("file", F.col("name").alias("layer_name"), F.get("n", F.lit(0)).alias("width"), F.posexplode(F.slice("n", F.lit(2), F.size("n") - 1)).alias("nth", "spacing"), "lengths")
    return cells.select("file", "layer_name", "width", "nth", F.coalesce(F.get("lengths", F.col("nth")), F.lit(0.0)).alias("length"), "spacing")


def spacing_of(probes: DataFrame, tables: DataFrame) -> DataFrame:
    """Probes (file, layer_name, width, length, ...) with the spacing of the last row whose width, and in it of the last column whose length, isn't over theirs; null before the first."""
    cell = F.struct("length", "spacing")
    rows = tables.groupBy("file", "layer_name", "width").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    table = rows.groupBy("file", "layer_name").agg(F.sort_array(F.collect_list(F.struct("width", "cells"))).alias("_table"))
    joined = probes.join(table, ["file", "layer_name"], "left")
    row = F.try_element_at(F.filter("_table", lambda r: r["width"] <= F.col("width")), F.lit(-1))
    found = F.try_element_at(F.filter(row["cells"], lambda c: c["length"] <= F.col("length")), F.lit(-1))
    return joined.select(*probes.columns, found["spacing"].alias("table_spacing"))


# ---- LEF to documents -----------------------------------------------------------------------------------------


def _in_order(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    return rows.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name))


def libraries(scanned: DataFrame) -> DataFrame:
    """file and the columns of a library: the layers with the first spacing of each width of their table, vias, sites, and the rules that layers imply."""
    c = F.col
    first = spacing_tables(scanned).where("nth = 0").groupBy("file", c("layer_name").alias("name")).agg(F.sort_array(F.collect_list(F.struct("width", "spacing"))).alias("entries"))
    more = scanned.where("top = 'LAYER'").groupBy("file", "name").agg(*(lef._first(k, 2).try_cast("double").alias(n) for n, k in (("resistance", "RESISTANCE"), ("capacitance", "CAPACITANCE"))))
    layer = lef.layers(scanned).join(more, ["file", "name"], "left").join(first, ["file", "name"], "left")
    table = F.when(c("entries").isNotNull(), F.struct("entries"))
    built = F.struct("name", "type", "direction", "pitch", "width", "spacing", "resistance", "capacitance", "thickness", table.alias("spacingTable"), c("area").alias("minArea")).cast(LAYER)
    wide = F.coalesce("min_width", "width")
    rule = F.struct(c("name").alias("layerName"), wide.alias("minWidth"), c("spacing").alias("minSpacing"), c("area").alias("minArea")).cast(RULE)
    ruled = layer.where(wide.isNotNull() | c("spacing").isNotNull() | c("area").isNotNull())
    enclosed = layer.where((c("type") == "cut") & c("overhang1").isNotNull())
    enclosure = F.struct(c("name").alias("outerLayerName"), c("name").alias("innerLayerName"), F.least("overhang1", "overhang2").alias("minEnclosure")).cast(ENCLOSURE)
    x = lambda i: F.get("coordinates", F.lit(i))
    drawn = lef.shapes(scanned).where("top = 'VIA' and kind = 'rect'").select("file", "owner_idx", "owner", "port", "seq", "layer_name", F.struct(x(0).alias("x1"), x(1).alias("y1"), x(2).alias("x2"), x(3).alias("y2")).alias("r"))
    of_layer = drawn.groupBy("file", "owner_idx", "owner", "port", "layer_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "r"))), lambda s: s["r"]).alias("rects"))
    via = of_layer.groupBy("file", "owner_idx", "owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("port", c("layer_name").alias("layerName"), "rects"))), lambda s: F.struct(s["layerName"].alias("layerName"), s["rects"].alias("rects"))).alias("layers"))
    named = lambda i: F.coalesce(F.get("layers", F.lit(i))["layerName"], F.lit(""))
    n = F.size("layers")
    of_via = F.struct(c("owner").alias("name"), F.when(n >= 3, named(1)).when(n == 1, named(0)).otherwise("").alias("cutLayerName"), F.when(n >= 3, named(2)).when(n == 2, named(1)).otherwise("").alias("topLayerName"), F.when(n >= 2, named(0)).otherwise("").alias("bottomLayerName"), "layers").cast(VIA)
    site = scanned.where("top = 'SITE'").groupBy("file", "section").agg(F.first("name").alias("name"), F.lower(lef._first("CLASS")).alias("siteClass"), lef._first("SIZE").try_cast("double").alias("width"), lef._first("SIZE", 3).try_cast("double").alias("height"), F.flatten(F.collect_list(F.when(word(0) == "SYMMETRY", F.transform(lef.rest("words"), F.lower)))).alias("symmetry"))
    version = scanned.groupBy("file").agg(F.max(F.when((c("top").isNull()) & (word(0) == "VERSION"), word(1))).alias("version"))
    out = lef.dbu(scanned).join(version, "file")
    for part in (_in_order(layer, "layer", built, "layers"), _in_order(via, "owner_idx", of_via, "vias"), _in_order(site, "section", F.struct("name", "siteClass", "width", "height", "symmetry").cast(SITE), "sites"), _in_order(ruled, "layer", rule, "designRules"), _in_order(enclosed, "layer", enclosure, "enclosureRules")):
        out = out.join(part, "file", "left")
    listed = {k: F.coalesce(c(k) if k in out.columns else F.lit(None), F.array()).cast(t) for k, t in LIBRARY.items() if t.startswith("array")}
    meta = F.create_map(F.lit("lef.version"), F.coalesce("version", F.lit("5.8")))
    return out.select("file", F.lit("").alias("name"), c("dbu").alias("dbuPerMicron"), *(v.alias(k) for k, v in listed.items()), meta.alias("metadata"))


def documents(library: DataFrame) -> DataFrame:
    """file, text: each library as JSON; optional keys that are null are left out, required ones never are."""
    return library.select("file", F.to_json(F.struct(*LIBRARY)).alias("text"))


# ---- strict decoding ------------------------------------------------------------------------------------------


def faults(texts: DataFrame) -> DataFrame:
    """file, path, fault (missing, null, type or word) of every key of a document (file, text) that can't be decoded; a text that is no object has the path ''."""
    keys = F.from_json("text", "map<string,string>")
    top = texts.select("file", keys.alias("m"))
    lit, c = F.lit, F.col
    shape = lambda t: "[" if t.startswith("array") else "{" if t.startswith("map") else None

    def judged(m: Column, path: Column, key: str, required: bool, bad: Column, word_: Column | None = None) -> Column:
        value = F.try_element_at(m, lit(key))
        fault = F.when(~F.map_contains_key(m, key), lit("missing") if required else lit(None)).when(value.isNull(), lit("null") if required else lit(None)).when(bad, "type")
        if word_ is not None:
            fault = fault.when(word_, "word")
        return F.struct(F.concat(path, lit(key)).alias("path"), fault.cast("string").alias("fault"))

    v = lambda m, key: F.try_element_at(m, lit(key))
    tops = [judged(c("m"), lit(""), k, True, ~F.coalesce(F.trim(v(c("m"), k)).startswith(shape(t)), lit(False)) if shape(t) else v(c("m"), k).try_cast("double").isNull() if t == "double" else lit(False)) for k, t in LIBRARY.items()]
    out = top.where("m is not null").select("file", F.inline(F.array(*tops))).where("fault is not null")
    out = out.unionByName(top.where("m is null").select("file", lit("").alias("path"), lit("type").alias("fault")))
    for name, required in REQUIRED.items():
        items = top.select("file", F.posexplode(F.from_json(v(c("m"), name), "array<map<string,string>>")).alias("i", "item"))
        path = F.concat(lit(f"{name}["), c("i").cast("string"), lit("]."))
        each = []
        for key in dict.fromkeys([*required, *NUMBERS.get(name, ()), *WORDS.get(name, {})]):
            own = v(c("item"), key)
            number = own.try_cast("double").isNull() if key in NUMBERS.get(name, ()) else lit(False)
            listed = ~F.trim(own).startswith("[") if key in ("symmetry", "layers") else number
            known = ~own.isin(*WORDS[name][key]) if key in WORDS.get(name, {}) else None
            each.append(judged(c("item"), path, key, key in required, listed, known))
        out = out.unionByName(items.where("item is not null").select("file", F.inline(F.array(*each))).where("fault is not null"))
        out = out.unionByName(items.where("item is null").select("file", F.concat(lit(f"{name}["), c("i").cast("string"), lit("]")).alias("path"), lit("null").alias("fault")))
    return out


def decoded(texts: DataFrame) -> DataFrame:
    """file and the columns of a library from documents (file, text); the first key that can't be decoded raises."""
    first = faults(texts).agg(F.min(F.struct("file", "path", "fault")).alias("f")).first()["f"]
    if first is not None:
        raise ValueError(f"technology: {first['fault']} key {first['path']!r} in {first['file']}")
    return texts.select("file", F.from_json("text", SCHEMA).alias("l")).select("file", "l.*")


# ---- documents to LEF -----------------------------------------------------------------------------------------


def lef_texts(library: DataFrame) -> DataFrame:
    """file, text: LEF of libraries. A layer's spacing, least width and area come from its rule where it has none of its own."""
    n = number_text
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in p))
    line = lambda key, v: F.when(v.isNotNull(), F.concat(F.lit(f"  {key} "), v, F.lit(" ;\n")))
    rules, enclosures = F.col("designRules"), F.col("enclosureRules")

    def layer(x: Column) -> Column:
        rule = F.get(F.filter(rules, lambda r: r["layerName"] == x["name"]), F.lit(0))
        enclosed = F.get(F.filter(enclosures, lambda r: r["innerLayerName"] == x["name"]), F.lit(0))["minEnclosure"]
        table = x["spacingTable"]["entries"]
        cells = F.concat(F.lit("PARALLELRUNLENGTH 0"), F.array_join(F.transform(table, lambda e: F.concat(F.lit(" WIDTH "), n(e["width"]), F.lit(" "), n(e["spacing"]))), ""))
        sizes = [line(k, n(v)) for k, v in (("PITCH", x["pitch"]), ("WIDTH", x["width"]), ("SPACING", F.coalesce(x["spacing"], rule["minSpacing"])), ("THICKNESS", x["thickness"]), ("MINWIDTH", rule["minWidth"]), ("AREA", F.coalesce(x["minArea"], rule["minArea"])))]
        return say("LAYER ", x["name"], "\n", line("TYPE", F.upper(x["type"])), line("DIRECTION", F.upper(x["direction"])), *sizes, line("RESISTANCE RPERSQ", n(x["resistance"])), line("CAPACITANCE CPERSQDIST", n(x["capacitance"])), line("SPACINGTABLE", F.when(table.isNotNull(), cells)), line("ENCLOSURE", F.when(enclosed.isNotNull(), F.concat(n(enclosed), F.lit(" "), n(enclosed)))), "END ", x["name"], "\n\n")

    rect = lambda r: F.concat_ws(" ", F.lit("    RECT"), n(r["x1"]), n(r["y1"]), n(r["x2"]), n(r["y2"]), F.lit(";\n"))
    via = lambda x: say("VIA ", x["name"], " DEFAULT\n", F.array_join(F.transform(x["layers"], lambda y: F.concat(F.lit("  LAYER "), y["layerName"], F.lit(" ;\n"), F.array_join(F.transform(y["rects"], rect), ""))), ""), "END ", x["name"], "\n\n")
    site = lambda x: say("SITE ", x["name"], "\n", line("CLASS", F.upper(x["siteClass"])), line("SYMMETRY", F.when(F.size(x["symmetry"]) > 0, F.upper(F.array_join(x["symmetry"], " ")))), line("SIZE", F.when(x["width"].isNotNull() & x["height"].isNotNull(), F.concat(n(x["width"]), F.lit(" BY "), n(x["height"])))), "END ", x["name"], "\n\n")
    head = say("VERSION ", F.coalesce(F.try_element_at("metadata", F.lit("lef.version")), F.lit("5.8")), " ;\nUNITS\n  DATABASE MICRONS ", n(F.col("dbuPerMicron")), " ;\nEND UNITS\n\n")
    return library.select("file", F.concat(head, *(F.array_join(F.transform(c, f), "") for c, f in (("layers", layer), ("sites", site), ("vias", via))), F.lit("END LIBRARY\n")).alias("text"))
