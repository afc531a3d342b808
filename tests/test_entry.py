"""The driver's contract, with and without the subpackage that may be taken out."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 80


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 40 and {"region_id", "sel_channel", "num_pixels", "sum_sq_dev"} <= set(rows[0].asDict())


def test_without_the_subpackage(tmp_path):
    """All but the subpackage, copied: the entry imports and keeps its other queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 70 and 'pipeline' not in q, q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0
    (tmp_path / "cubespark" / "llm" / "__pycache__").mkdir(parents=True)  # what a removal may leave
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0
    if (ROOT / "corpus_pipeline.py").exists():
        (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text())
        assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0


def test_a_fault_inside_the_subpackage_shows(tmp_path):
    """Only a missing subpackage is passed over, not an import that fails in it."""
    if not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("the subpackage was taken out")
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if ".git" not in rel.parts and "tests" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    broken = next(iter(sorted((tmp_path / "cubespark").rglob("stages.py"))))
    broken.write_text("import no_such_module\n" + broken.read_text().replace("from __future__ import annotations", ""))
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode != 0 and "no_such_module" in found.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "cubespark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
