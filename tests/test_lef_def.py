"""LEF and DEF: small whole files, conversions and round trips."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tessella.functions import codes
from tessella.operators import sequences
from tessella.sources import def_, def_back, lef

LEF = """VERSION 5.8 ; # a comment ; here
UNITS
  DATABASE MICRONS 2000 ;
END UNITS
LAYER M1
  TYPE ROUTING ; DIRECTION HORIZONTAL ; PITCH 0.2 ; WIDTH 0.1 ; SPACING 0.12 ;
END M1
LAYER V1
  TYPE CUT ; ENCLOSURE 0.05 0.01 ; WIDTH 0.1 ; MINWIDTH 0.07 ;
END V1
SITE core SIZE 0.2 BY 2 ; CLASS CORE ; END core
VIA VIA12 DEFAULT LAYER M1 ; RECT -0.1 -0.1 0.1 0.1 ; END VIA12
MACRO INV
  CLASS CORE ; ORIGIN 0 0 ; SIZE 1 BY 2 ; SITE core ;
  PIN A DIRECTION INPUT ; USE SIGNAL ;
    PORT LAYER M1 ; RECT 0 0 1 0.5 ; RECT 2 2 3 3 ; END
  END A
  PIN Z DIRECTION OUTPUT ;
    PORT LAYER V1 ; POLYGON 0 0 1 0 1 1 ; END
  END Z
  OBS LAYER M1 ; RECT 0 1.5 1 2 ; END
END INV
MACRO EMPTY CLASS BLOCK ; END EMPTY
END LIBRARY
"""

DEF = """VERSION 5.8 ;
DESIGN chip ;
UNITS DISTANCE MICRONS 1000 ;
DIEAREA ( 0 0 ) ( 1000 2000 ) ;
ROW r0 core 10 20 N DO 4 BY 1 STEP 200 0 ;
TRACKS X 100 DO 5 STEP 200 LAYER M1 M2 ;
COMPONENTS 3 ;
- u1 INV + PLACED ( 10 20 ) N ;
- u2 NAND + FIXED ( -30 40 ) FS ;
- u3 INV + UNPLACED ;
END COMPONENTS
PINS 1 ;
- in + NET n1 + DIRECTION INPUT + USE SIGNAL + LAYER M1 ( 0 0 ) ( 5 6 ) + PLACED ( 7 8 ) E ;
END PINS
SPECIALNETS 1 ;
- VDD ( * VDD ) + ROUTED metal2 300 ( 0 0 ) ( * 500 ) ;
END SPECIALNETS
NETS 2 ;
- clk ( u1 A ) ( PIN in ) + ROUTED metal1 ( 0 0 ) ( 10 * ) ( * 5 ) VIA1 + NEW metal2 ( 1 2 ) ( 3 * ) ;
- quiet ( u2 Z ) ;
END NETS
END DESIGN
"""


def scanned(spark, module, body, stretch=4):
    return module.scan(sequences.statements_of(spark.createDataFrame([("f", body)], "file string, text string"), ";", stretch))


@pytest.fixture(scope="module")
def lib(spark):
    return scanned(spark, lef, LEF)


@pytest.fixture(scope="module")
def chip(spark):
    return scanned(spark, def_, DEF)


def spots(points):
    return [tuple(p) for p in points]


def test_lef_sections(lib):
    got = lef.layers(lib).orderBy("layer").collect()
    assert [(r.layer, r.name, r.type, r.direction, r.width, r.spacing) for r in got] == [(1, "M1", "routing", "horizontal", 0.1, 0.12), (2, "V1", "cut", None, 0.1, None)]
    assert lef.dbu(lib).first().dbu == 2000
    assert sorted((r.macro, r["class"], r.width, r.height, r.site) for r in lef.macros(lib).collect()) == [("EMPTY", "BLOCK", None, None, None), ("INV", "CORE", 1.0, 2.0, "core")]
    assert sorted((r.pin, r.direction, r.use) for r in lef.pins(lib).collect()) == [("A", "INPUT", "SIGNAL"), ("Z", "OUTPUT", None)]
    assert [(r.site, r.width, r.height) for r in lef.sites(lib).collect()] == [("core", 0.2, 2.0)]
    assert [r.coordinates for r in lef.shapes(lib).where("top = 'VIA'").collect()] == [[-0.1, -0.1, 0.1, 0.1]]


def test_lef_cells_and_rules(lib):
    got = lef.elements(lib).orderBy("elem_idx").collect()
    assert [(r.kind, r.layer, r.text) for r in got] == [("boundary", 1, None), ("boundary", 1, None), ("text", 1, "A"), ("boundary", 2, None), ("text", 2, "Z"), ("boundary", 1, None)]
    assert spots(got[0].points) == [(0, 0), (2000, 0), (2000, 1000), (0, 1000), (0, 0)] and tuple(got[2].origin) == (1000, 500)
    assert spots(got[3].points) == [(0, 0), (2000, 0), (2000, 2000), (0, 0)] and tuple(got[4].origin) == (1333, 666)
    rules = {r.name: r for r in lef.technology(lib).collect()}
    assert (rules["M1"].min_width, rules["M1"].min_spacing, rules["M1"].min_enclosure) == (0.1, 0.12, None)
    assert (rules["V1"].min_width, rules["V1"].min_enclosure) == (0.07, 0.01)


def test_lef_unresolved_layer(spark):
    with pytest.raises(Exception, match="unresolved layer M9"):
        lef.elements(scanned(spark, lef, LEF.replace("OBS LAYER M1", "OBS LAYER M9"))).collect()


def test_lef_way_back(spark, lib):
    cells = spark.createDataFrame([("f", 0, "INV"), ("f", 1, "NONE")], "file string, cell_idx int, cell string")
    element = lef.elements(lib).withColumn("cell_idx", F.lit(0))
    body = lef.write_texts(cells, element, 2000)
    again = lef.scan(sequences.statements_of(body, ";"))
    assert sorted(r.macro for r in lef.macros(again).collect()) == ["INV", "NONE"]
    assert sorted(tuple(r.coordinates) for r in lef.shapes(again).where("layer_name = 'LAYER_1'").collect()) == [(0.0, 0.0, 1.0, 0.5), (0.0, 1.5, 1.0, 2.0), (2.0, 2.0, 3.0, 3.0)]


def test_def_sections(chip):
    d = def_.design(chip).first()
    assert (d.design, d.dbu, spots(d.die)) == ("chip", 1000.0, [(0, 0), (1000, 2000)])
    assert [tuple(r)[3:] for r in def_.components(chip).orderBy("seq").collect()] == [("u1", "INV", "placed", 10, 20, "N"), ("u2", "NAND", "fixed", -30, 40, "FS"), ("u3", "INV", "unplaced", None, None, None)]
    pin = def_.pins(chip).first()
    assert (pin.pin, pin.net, pin.direction, pin.layer_name, spots(pin.corners), pin.x, pin.orientation) == ("in", "n1", "input", "M1", [(0, 0), (5, 6)], 7, "E")
    assert [(r.net, r.component, r.pin) for r in def_.connections(chip).orderBy("seq", "nth").collect()] == [("clk", "u1", "A"), ("clk", "PIN", "in"), ("quiet", "u2", "Z")]
    wires = def_.wires(chip).orderBy("wire").collect()
    assert [(r.layer_name, spots(r.points), r.via) for r in wires] == [("metal1", [(0, 0), (10, 0), (10, 5)], "VIA1"), ("metal2", [(1, 2), (3, 2)], None)]
    power = def_.wires(chip, "SPECIALNETS").first()
    assert (power.net, power.width, spots(power.points)) == ("VDD", 300, [(0, 0), (0, 500)])
    row, track = def_.rows(chip).first(), def_.tracks(chip).first()
    assert (row.row, row.columns, row.step_x, track.axis, track.count if isinstance(track.count, int) else track["count"], track.layers) == ("r0", 4, 200, "X", 5, ["M1", "M2"])


def test_def_cells_and_way_back(spark, chip):
    mapping = spark.createDataFrame([("Metal1", 1), ("metal2", 2)], "layer_name string, layer int")
    element = def_.elements(chip, mapping)
    got = element.orderBy("elem_order").collect()
    assert [(r.kind, r.layer, r.ref_cell) for r in got] == [("boundary", 0, None), ("cellRef", None, "INV"), ("cellRef", None, "NAND"), ("cellRef", None, "INV"), ("path", 1, None), ("path", 2, None), ("path", 2, None), ("text", 0, None)]
    assert spots(got[0].points) == [(0, 0), (1000, 0), (1000, 2000), (0, 2000), (0, 0)] and (got[2].mirror, got[2].angle, got[6].width) == (True, 180.0, 300)
    assert [(r.cell_idx, r.cell) for r in def_.cells(chip).orderBy("cell_idx").collect()] == [(0, "chip"), (1, "INV"), (2, "NAND")]
    placed = element.where("kind <> 'cellRef' or origin.x is not null")
    body = def_.write_texts(def_.design(chip).select("file", "design"), placed, 1000)
    again = def_.scan(sequences.statements_of(body, ";"))
    assert [tuple(r)[3:] for r in def_.components(again).orderBy("seq").collect()] == [("u1", "INV", "placed", 10, 20, "N"), ("u2", "NAND", "placed", -30, 40, "FS")]
    assert sorted((r.net, r.layer_name, spots(r.points)) for r in def_.wires(again).collect()) == [("VDD", "LAYER_2", [(0, 0), (0, 500)]), ("clk", "LAYER_1", [(0, 0), (10, 0), (10, 5)]), ("clk", "LAYER_2", [(1, 2), (3, 2)])]


@pytest.mark.parametrize(("rows", "match"), [([("metal1", 1)], "no number for layer metal2"), ([("metal1", 1), ("metal2", 1)], "share the number"), ([("metal1", 0), ("metal2", 1)], "no layer number")])
def test_def_layer_numbers(spark, chip, rows, match):
    with pytest.raises(Exception, match=match):
        def_.numbered_layers(def_.wires(chip), spark.createDataFrame(rows, "layer_name string, layer int")).collect()


def test_def_route_needs_a_start(spark):
    with pytest.raises(Exception, match="starts with a star"):
        def_.wires(scanned(spark, def_, DEF.replace("metal1 ( 0 0 )", "metal1 ( * 0 )"))).collect()


def test_codes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    pair = lambda a, b: F.struct(F.lit(a).alias("component"), F.lit(b).alias("pin"))
    text = codes.encode_connections(F.array(pair("a/b|c", "p,%"), pair("u", "Z")))
    assert one(text) == "a%2Fb%7Cc/p%2C%25|u/Z" and [tuple(r) for r in one(codes.decode_connections(text))] == [("a/b|c", "p,%"), ("u", "Z")]
    assert one(codes.decode_connections(F.lit(""))) == []
    spot = lambda x, y, e, v: F.struct(F.lit(x).cast("int").alias("x"), F.lit(y).cast("int").alias("y"), F.lit(e).cast("int").alias("ext"), F.lit(v).cast("string").alias("via"))
    route = F.array(spot(1, 2, None, None), spot(None, 5, 3, None), spot(None, None, None, "V|1"), spot(9, None, None, None))
    assert one(codes.encode_route_points(route)) == "1,2,*,*|*,5,3,*|*,*,*,V%7C1|9,*,*,*"
    assert [tuple(r) for r in one(codes.decode_route_points(codes.encode_route_points(route)))] == [(1, 2, None, None), (None, 5, 3, None), (None, None, None, "V|1"), (9, None, None, None)]
    assert spots(one(codes.resolved(route))) == [(1, 2), (1, 5), (9, 5)]
    for name, (mirror, angle) in codes.ORIENTATIONS.items():
        assert tuple(one(codes.transform_of(F.lit(name)))) == (mirror, angle)
        assert one(codes.orientation_of(F.lit(mirror), F.lit(angle - 360))) == name
    assert one(codes.orientation_of(F.lit(True), F.lit(45.0))) == "FN"
    assert one(codes.property_map(F.array(*map(F.lit, ("a=1", "b", "a=2", "c=x=y"))))) == {"a": "1", "c": "x=y"}
    record = F.struct(F.lit(1).alias("a"), F.lit("é").alias("b"))
    assert tuple(one(codes.unpacked(codes.packed(record), "a int, b string"))) == (1, "é")
    assert one(codes.unquoted(F.lit('"x y"'))) == "x y" and one(codes.number_text(F.lit(2.0))) == "2" and one(codes.number_text(F.lit(0.25))) == "0.25"
    assert one(codes.stable_mean(F.array(F.lit(1.7e308), F.lit(1.7e308)))) == 1.7e308


@pytest.mark.parametrize("stretch", [10_000, 1])
def test_statements_of_many_pieces_keep_their_order(spark, stretch):
    """Ninety empty macros, which have no semicolon, stand before the first statement of the next one."""
    body = "LAYER M1 TYPE ROUTING ; END M1 LAYER M2 TYPE ROUTING ; END M2 " + " ".join(f"MACRO e{i} END e{i}" for i in range(90)) + " MACRO b PIN p PORT LAYER M2 ; RECT 0 0 1 2 ; END END p END b END LIBRARY"
    got = lef.elements(scanned(spark, lef, body, stretch)).orderBy("elem_idx").collect()
    assert [(r.cell, r.kind, r.layer, r.text) for r in got] == [("b", "boundary", 2, None), ("b", "text", 2, "p")]


def test_long_lists_are_not_cut(spark):
    points = " ".join(f"{i % 1000}.5 {i}.5" for i in range(600_000))
    body = f"LAYER M1 TYPE ROUTING ; END M1 MACRO m OBS LAYER M1 ; POLYGON {points} ; END END m"
    assert len(lef.elements(scanned(spark, lef, body)).first().points) == 600_001


WIRED = """VERSION 5.8 ;
DESIGN chip ;
UNITS DISTANCE MICRONS 1000 ;
DIEAREA ( 0 0 ) ( 1000 2000 ) ;
VIAS 1 ;
- V1 + RECT M1 ( -5 -6 ) ( 7 8 ) + RECT M2 ( -1 -1 ) ( 1 1 ) ;
END VIAS
COMPONENTS 1 ;
- u1 INV + PLACED ( 10 20 ) FS ;
END COMPONENTS
PINS 2 ;
- in + NET a|b/c + FIXED ( 7 8 ) E ;
- out + PLACED ( 1 2 ) N ;
END PINS
SPECIALNETS 1 ;
- VDD ( * VDD ) + USE POWER + WEIGHT 3 + ROUTED M2 300 ( 0 0 15 ) ( * 500 ) V1 + NEW M1 20 ( 5 5 ) ( 9 * ) ;
END SPECIALNETS
NETS 2 ;
- a|b/c ( u1 A ) ( PIN in ) + USE CLOCK + ROUTED M1 ( 0 0 ) ( 10 * ) V1 + NEW M2 ( 1 2 ) ( 3 * ) ;
- quiet ( u1 Z ) ;
END NETS
END DESIGN
"""


def test_design_to_properties_and_back(spark):
    chip = scanned(spark, def_, WIRED)
    mapping = spark.createDataFrame([("m1", 1), ("m2", 2)], "layer_name string, layer int")
    props, element = def_back.properties(chip), def_back.elements(chip, mapping)
    known = {r.key: r.value for r in props.collect()}
    assert known["def.net.count"] == "2" and known["def.net.0.name"] == "a|b/c" and known["def.specialNet.0.weight"] == "3" and known["def.pin.1.placementStatus"] == "PLACED" and "def.net.1.use" not in known
    tops = def_.design(chip).select("file", "design", "dbu")
    again = scanned(spark, def_, def_back.texts(def_back.lines(def_back.document(tops, props, element))).first().text)
    view = lambda df, *c: sorted(map(str, (tuple(r) for r in df.select(*c).collect())))
    for table, columns in ((lambda d: def_.wires(d), ("net", "wire", "status", "layer_name", "points", "via")), (lambda d: def_.route_points(d), ("net", "wire", "spots")), (lambda d: def_.wires(d, "SPECIALNETS"), ("net", "layer_name", "width", "points")), (lambda d: def_.connections(d), ("net", "nth", "component", "pin")), (lambda d: def_.connections(d, "SPECIALNETS"), ("net", "component", "pin")), (def_.pins, ("pin", "net", "status", "x", "y", "orientation")), (def_.components, ("component", "macro", "x", "y", "orientation")), (def_.vias, ("via", "rects")), (def_.design, ("design", "dbu", "die")), (lambda d: def_back._nets(d, "SPECIALNETS"), ("name", "use", "weight", "connections"))):
        assert view(table(chip), *columns) == view(table(again), *columns)


def test_nets_are_upserted_in_order(spark):
    """First values count, records over the count and without a name are left out, routes go to the first net of their name, new names come last by their first route."""
    rows = [("f", 1, "def.net.count", "3"), ("f", 2, "def.net.0.name", "b"), ("f", 3, "def.net.0.name", "ignored"), ("f", 4, "def.net.2.name", "b"), ("f", 5, "def.net.1.use", "CLOCK"), ("f", 6, "def.net.3.name", "over"), ("f", 7, "def.net.count", "9")]
    props = spark.createDataFrame(rows, "file string, seq long, key string, value string")
    kinds = "file string, elem_order struct<rank:int,seq:struct<block:bigint,seq:bigint,part:int>,wire:int>, kind string, layer int, width int, points array<struct<x:int,y:int>>, properties map<string,string>"
    route = lambda i, net, **more: ("f", (2, (0, i, 0), 1), "path", 4, 1, [(i, 0), (i, 9)], {"def.route.kind": "net", "def.route.netName": net, **{f"def.route.{k}": v for k, v in more.items()}})
    element = spark.createDataFrame([route(1, "z"), route(2, "b", status="FIXED", layerName="M"), route(3, "c"), route(4, "z", viaName="V"), ("f", (2, (0, 5, 0), 1), "path", 1, 1, [(0, 0)], None)], kinds)
    net, wire = def_back.nets(props, def_back.routes(element), "net")
    assert [(r.name, r.use) for r in net.orderBy("place").collect()] == [("b", None), ("b", None), ("z", None), ("c", None)]
    assert [(r.net, r.status, r.layer_name, r.via, r.place.nth, r.place.late) for r in wire.orderBy("elem_order").collect()] == [("z", "ROUTED", "4", None, 0, 1), ("b", "FIXED", "M", None, 0, 0), ("c", "ROUTED", "4", None, 0, 1), ("z", "ROUTED", "4", "V", 0, 1)]


def test_statements_are_cut_in_batches(spark):
    """As expressions the words of an entry went along with each of its wires, so an entry cost the square of its length."""
    def_text = "NETS 1 ;\n- n\v1 ( u1 a )  + ROUTED m1 ( 5 +7 ) ( * -9 ) via1\n + NEW m2 ( 1 2 3 ) ( 4 * ) + USE SIGNAL ;\nEND NETS\n"
    found = def_.wires(scanned(spark, def_, def_text))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain()
    cut = [line for line in out.getvalue().splitlines() if "Generate posexplode(clauses" in line]
    assert len(cut) == 1 and "words#" not in cut[0], cut
    rows = sorted((r.wire, r.net, r.layer_name, [(p.x, p.y) for p in r.points], r.via) for r in found.collect())
    assert rows == [(1, "n", "m1", [(5, 7), (5, -9)], "via1"), (2, "n", "m2", [(1, 2), (4, 2)], None)]
    for bad in ("1_0", "2147483648", "1.5"):
        with pytest.raises(Exception, match="(?s)whole number|too large|not in range|overflow|out of"):
            def_.wires(scanned(spark, def_, def_text.replace("5 +7", f"{bad} 7"))).collect()


def test_pieces_are_cut_once(spark):
    """Running sums read their rows twice: statements were cut anew for each."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        lef.pieces(sequences.statements_of(spark.createDataFrame([("f", LEF)], "file string, text string"), ";")).explain()
    assert "parquet" in out.getvalue() and "Generate" not in out.getvalue(), out.getvalue()
