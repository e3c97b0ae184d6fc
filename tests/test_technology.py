"""Technology libraries: LEF to documents and back, strict decoding, spacing tables."""

from __future__ import annotations

import json

import pytest

from tessella.operators import sequences
from tessella.sources import lef, technology

LEF = """VERSION 5.7 ;
UNITS
  DATABASE MICRONS 2000 ;
END UNITS
LAYER M1
  TYPE ROUTING ; DIRECTION HORIZONTAL ; PITCH 0.2 ; WIDTH 0.1 ; SPACING 0.12 ; AREA 0.02 ; RESISTANCE RPERSQ 0.4 ;
  SPACINGTABLE PARALLELRUNLENGTH 0 0.5 2 WIDTH 0 0.1 0.1 0.15 WIDTH 0.3 0.2 0.25 WIDTH 1 0.4 0.5 0.6 ;
END M1
LAYER V1
  TYPE CUT ; ENCLOSURE 0.05 0.01 ; MINWIDTH 0.07 ;
END V1
LAYER M2
  TYPE ROUTING ; SPACINGTABLE PARALLELRUNLENGTH 0 1 ; WIDTH 0 0.3 0.4 ; WIDTH 2 0.5 0.6 ; WIDTH 0.2 ;
END M2
SITE core SIZE 0.2 BY 2 ; CLASS CORE ; SYMMETRY X Y ; END core
VIA VIA12 DEFAULT LAYER M1 ; RECT -0.1 -0.1 0.1 0.1 ; LAYER V1 ; RECT 0 0 0.1 0.1 ; RECT 0.2 0 0.3 0.1 ; LAYER M2 ; RECT -0.2 -0.2 0.2 0.2 ; END VIA12
END LIBRARY
"""


def scanned(spark, body, stretch=3):
    return lef.scan(sequences.statements_of(spark.createDataFrame([("f", body)], "file string, text string"), ";", stretch))


def test_documents_and_back(spark):
    library = technology.libraries(scanned(spark, LEF))
    text = technology.documents(library).first().text
    doc = json.loads(text)
    assert set(doc) == set(technology.LIBRARY) and doc["dbuPerMicron"] == 2000 and doc["metadata"] == {"lef.version": "5.7"}
    m1, v1, m2 = doc["layers"]
    assert m1["spacingTable"]["entries"] == [{"width": 0.0, "spacing": 0.1}, {"width": 0.3, "spacing": 0.2}, {"width": 1.0, "spacing": 0.4}]
    assert (m1["direction"], m1["minArea"], m1["resistance"]) == ("horizontal", 0.02, 0.4) and "direction" not in v1 and m2["width"] == 0.2
    assert doc["designRules"][1] == {"layerName": "V1", "minWidth": 0.07} and doc["enclosureRules"] == [{"outerLayerName": "V1", "innerLayerName": "V1", "minEnclosure": 0.01}]
    via = doc["vias"][0]
    assert (via["bottomLayerName"], via["cutLayerName"], via["topLayerName"]) == ("M1", "V1", "M2") and [len(x["rects"]) for x in via["layers"]] == [1, 2, 1]
    assert doc["sites"] == [{"name": "core", "siteClass": "core", "width": 0.2, "height": 2.0, "symmetry": ["x", "y"]}]
    back = technology.lef_texts(technology.decoded(spark.createDataFrame([("f", text)], "file string, text string"))).first().text
    again = json.loads(technology.documents(technology.libraries(scanned(spark, back))).first().text)
    assert again == doc


def spoilt(**change):
    doc = {k: [] if t.startswith("array") else {} for k, t in technology.LIBRARY.items()} | {"name": "n", "dbuPerMicron": 1000}
    return doc | change


CASES = {
    "sound": (spoilt(layers=[{"name": "a", "type": "cut", "pitch": None}]), []),
    "unknown keys": (spoilt(more=1), []),
    "null": (spoilt(name=None), [("name", "null")]),
    "type": (spoilt(layers={}, dbuPerMicron="x"), [("dbuPerMicron", "type"), ("layers", "type")]),
    "layer": (spoilt(layers=[{"name": "a", "type": "cut"}, {"type": "tin", "pitch": "wide"}]), [("layers[1].name", "missing"), ("layers[1].pitch", "type"), ("layers[1].type", "word")]),
    "site": (spoilt(sites=[{"name": "s", "symmetry": None, "siteClass": "yard"}]), [("sites[0].siteClass", "word"), ("sites[0].symmetry", "null")]),
    "rule": (spoilt(enclosureRules=[{"outerLayerName": "a"}]), [("enclosureRules[0].innerLayerName", "missing"), ("enclosureRules[0].minEnclosure", "missing")]),
    "hole": (spoilt(vias=[None]), [("vias[0]", "null")]),
}


def test_missing_keys_are_told_from_nulls(spark):
    lacking = spoilt()
    del lacking["antennaRules"]
    cases = CASES | {"missing": (lacking, [("antennaRules", "missing")])}
    rows = [(name, json.dumps(doc)) for name, (doc, _) in cases.items()] + [("no object", "[1]")]
    got = {}
    for r in technology.faults(spark.createDataFrame(rows, "file string, text string")).collect():
        got.setdefault(r.file, []).append((r.path, r.fault))
    want = {name: sorted(x) for name, (_, x) in cases.items() if x} | {"no object": [("", "type")]}
    assert {k: sorted(v) for k, v in got.items()} == want
    with pytest.raises(ValueError, match="missing key 'antennaRules' in missing"):
        technology.decoded(spark.createDataFrame([("missing", json.dumps(lacking))], "file string, text string"))


def test_spacing_tables_and_their_lookup(spark):
    tables = technology.spacing_tables(scanned(spark, LEF))
    cells = {(r.layer_name, r.width, r.length): r.spacing for r in tables.collect()}
    assert len(cells) == 12 and cells["M1", 0.3, 0.5] == 0.25 and cells["M2", 2.0, 1.0] == 0.6 and ("M1", 0.3, 2.0) not in cells
    probes = [("f", layer, w, n) for layer in ("M1", "M2", "V1") for w in (-1.0, 0.0, 0.29, 0.3, 0.9, 1.0, 5.0) for n in (-0.5, 0.0, 0.5, 1.0, 9.0)]
    got = technology.spacing_of(spark.createDataFrame(probes, "file string, layer_name string, width double, length double"), tables).collect()

    def want(layer, w, n):
        rows = [x for a, x, _ in cells if a == layer and x <= w]
        own = [(y, s) for (a, x, y), s in cells.items() if rows and a == layer and x == max(rows) and y <= n]
        return max(own)[1] if own else None

    assert {(r.layer_name, r.width, r.length): r.table_spacing for r in got} == {(a, w, n): want(a, w, n) for _, a, w, n in probes}
