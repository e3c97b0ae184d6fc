"""Blockages, fills, regions, groups and cell grids: read, odd entries, written and read again; containment in slanted polygons."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import connectivity, sequences
from tessella.sources import def_, def_areas, def_back

TEXT = """DESIGN chip ;
GCELLGRID X 0 DO 11 STEP 100 ;
gcellgrid Y -5 do 3 step 7 ;
GCELLGRID Z 0 DO 11 STEP 100 ;
BLOCKAGES 3 ;
- ROUTING + LAYER M1 + LAYER M2 + PUSHDOWN RECT ( 0 0 ) ( 10 20 ) RECT ( -3 -4 ) ( 5 6 ) ;
- PLACEMENT + COMPONENT u1 POLYGON ( 0 0 ) ( 5 0 ) ( 5 5 ) rect ( 1 1 ) ( 2 2 ) POLYGON ( 9 9 ) ;
- OTHER + UNKNOWN word ;
END BLOCKAGES
REGIONS 2 ;
- r1 ( 0 0 ) ( 1 1 ) ( 2 2 ) ( 3 3 ) + TYPE fence ;
- r2 + TYPE ODD ;
END REGIONS
FILLS 2 ;
- LAYER M3 + OPC RECT ( 1 2 ) ( 3 4 ) ;
- RECT ( 1 2 ) ( 3 4 ) ;
END FILLS
GROUPS 2 ;
- g1 u1 u2 + PROPERTY a "x  + y" b 2 + REGION r1 ;
- g2 ;
END GROUPS
END DESIGN
"""


def read(spark, text: str):
    return def_.scan(sequences.statements_of(spark.createDataFrame([("f", text)], "file string, text string"), ";", stretch=2))


def tables(scanned) -> dict:
    found = {f.__name__: f(scanned) for f in (def_areas.gcell_grids, def_areas.blockages, def_areas.regions, def_areas.fills, def_areas.groups)}
    return found


def values(found: dict) -> dict:
    return {k: [tuple(r) for r in df.orderBy("seq").drop("file", "block", "seq").collect()] for k, df in found.items()}


def test_area_sections_and_way_back(spark):
    found = tables(read(spark, TEXT))
    got = values(found)
    assert got["gcell_grids"] == [("X", 0, 11, 100), ("Y", -5, 3, 7)]
    assert got["blockages"] == [
        ("ROUTING", "M2", None, True, [(0, 0, 10, 20), (-3, -4, 5, 6)], []),
        ("PLACEMENT", None, "u1", False, [(1, 1, 2, 2)], [[(0, 0), (5, 0), (5, 5)], [(9, 9)]]),
        ("PLACEMENT", None, None, False, [], []),
    ]
    assert got["regions"] == [("r1", "FENCE", [(0, 0, 1, 1), (2, 2, 3, 3)]), ("r2", None, [])]
    assert got["fills"] == [("M3", True, [(1, 2, 3, 4)], []), ("", False, [(1, 2, 3, 4)], [])]
    assert got["groups"] == [("g1", ["u1", "u2"], "r1", [("a", "x + y"), ("b", "2")]), ("g2", [], None, [])]
    text = def_back.texts(def_areas.lines(*found.values())).first().text
    assert text.count("END ") == 4 and "REGIONS 2 ;" in text
    again = values(tables(read(spark, text)))
    assert again == got


@pytest.mark.parametrize("entry, section", [("- LAYER M1 RECT ( 0 0 ) ( 1 ) ;", "FILLS"), ("- LAYER M1 RECT ( 0 0 ) ;", "FILLS"), ("- r ( 0 0 ) ( 1 1 ) ( 2 2 ) ;", "REGIONS"), ("- ROUTING POLYGON ( 0 a ) ;", "BLOCKAGES")])
def test_broken_shapes_raise(spark, entry, section):
    scanned = read(spark, f"DESIGN d ;\n{section} 1 ;\n{entry}\nEND {section}\nEND DESIGN\n")
    with pytest.raises(Exception, match="DEF: not a"):
        {"FILLS": def_areas.fills, "REGIONS": def_areas.regions, "BLOCKAGES": def_areas.blockages}[section](scanned).collect()


def test_no_sections(spark):
    found = tables(read(spark, "DESIGN d ;\nEND DESIGN\n"))
    assert all(not rows for rows in values(found).values()) and def_areas.lines(*found.values()).count() == 0


def test_points_in_slanted_polygons_of_all_sizes(spark):
    rnd = random.Random(5)
    polygons, points = [], []
    for i in range(60):
        r, x, y = rnd.choice([3, 50, 6000, 70_000]), rnd.randint(-9000, 9000), rnd.randint(-9000, 9000)
        polygons.append((i % 2, i, [(x + rnd.randint(-r, r), y + rnd.randint(-r, r)) for _ in range(rnd.randint(2, 6))]))
    for _ in range(400):
        k, _, ring = rnd.choice(polygons)
        x, y = rnd.choice(ring)
        points.append((k, x + rnd.randint(-5, 5), y + rnd.randint(-5, 5)))

    def inside(x, y, ring):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y):
                run, rise = (ax - bx) * (y - by), ay - by
                n += x < (abs(run) // abs(rise)) * (1 if run * rise > 0 else -1) + bx
        return len(ring) >= 3 and n % 2 == 1

    straight = lambda ring: all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, ring[1:]))
    slanted = [p for p in polygons if not straight(p[2])]
    want = sorted({(k, x, y) for k, x, y in points if any(k == q and inside(x, y, ring) for q, _, ring in slanted)})
    p = spark.createDataFrame(slanted, "key int, poly_idx int, points array<struct<x:int,y:int>>")
    got = connectivity.contained(spark.createDataFrame(points, "key int, x long, y long"), p, ["key"])
    assert sorted(tuple(r) for r in got.collect()) == want and 0 < len(want) < len(set(points))
    assert connectivity.contained(got.where(F.lit(False)), p, ["key"]).count() == 0


def test_points_of_an_entry_are_read_once(spark):
    """They were read from the text twice for each box, so a region of many boxes took the square of their number."""
    assert str(def_areas._rects(F.col("spots_of_entry"))).count("spots_of_entry") == 1
    read = spark.createDataFrame([([(i, i, i + 1, i + 2) for i in range(n)],) for n in (0, 1, 3)] + [(None,)], "b array<struct<x1:int,y1:int,x2:int,y2:int>>")
    spots = F.flatten(F.transform("b", lambda r: F.array(F.struct(r["x1"].alias("x"), r["y1"].alias("y")), F.struct(r["x2"].alias("x"), r["y2"].alias("y")))))
    assert all(r.b == r.found for r in read.select("b", def_areas._rects(spots).alias("found")).collect())
