"""Format detection and the DXF scan."""

from __future__ import annotations

import pytest

from tessella.sources import dxf, sniff

FILES = {
    "a.oas": (b"%SEMI-OASIS\r\nrest", "oasis"),
    "b.gds": (bytes([0, 6, 0, 2, 0, 6]), "gds"),
    "c.dxf": (b"  0\nSECTION\n2\nENTITIES\n0\nENDSEC\n0\nEOF\n", "dxf"),
    "d.def": (b"VERSION 5.8 ;\nDESIGN top ;\n", "def"),
    "e.lef": (b"VERSION 5.8 ;\nLAYER M1\n", "lef"),
    "f.cif": (b"(a note) DS 1 1 1;", "cif"),
    "g.txt": (b"hello there", "unknown"),
    "h.bin": (b"\xff\xfe\xfd\xfc\xfb", "unknown"),
    "i.x": (b"DS", "unknown"),
    "j.txt": (b"VERSIONS and DESIGNER, a note", "unknown"),
}


def test_sniff(spark, tmp_path):
    for name, (body, _) in FILES.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.format for r in sniff.sniff(spark, f"file://{tmp_path}").collect()}
    assert got == {name: want for name, (_, want) in FILES.items()}


def doc(*pairs):
    return "".join(f"{c}\n{v}\n" for c, v in pairs)


def test_dxf_lines_and_blocks(spark, tmp_path):
    body = doc((0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "INV"), (0, "LWPOLYLINE"), (8, "M2"), (90, 3), (70, 1), (10, 0), (20, 0), (10, 2), (20, 0), (10, 2), (20, 1.0019), (0, "ENDBLK"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (8, "M1"), (10, 0), (20, 0), (11, 1), (21, 2), (0, "ENDSEC"), (0, "EOF"))
    (tmp_path / "a.dxf").write_text(body.replace("\n", "\r\n"))
    rows = dxf.paths(dxf.read(spark, f"file://{tmp_path}"), 1000).orderBy("entity").collect()
    assert [(r.cell, r.layer, r.kind, [tuple(p) for p in r.points]) for r in rows] == [("INV", "M2", "boundary", [(0, 0), (2000, 0), (2000, 1001), (0, 0)]), ("TOP", "M1", "path", [(0, 0), (1000, 2000)])]


@pytest.mark.parametrize("body", ["0\nSECTION\n2\n", "x\nSECTION\n", "2000\nA\n"])
def test_dxf_rejects(spark, body):
    with pytest.raises(Exception, match="DXF"):
        dxf.groups(spark.createDataFrame([("f", body)], "file string, text string")).collect()
