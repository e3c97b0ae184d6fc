"""The registry: every oracle has its query, and the layout queries don't need the rest."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_have_queries():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert "region_union_area" in found


def test_layout_queries_stand_alone(tmp_path):
    (tmp_path / "tessella").mkdir()
    for p in ROOT.joinpath("tessella").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tessella" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert e.queries() and not [x for x in e.queries() if x.startswith('op')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
