"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["id", "degree"] and 0 < rows.count() <= 40


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_imports_without_the_training_data_part(tmp_path, left):
    """With both folders gone, with or without the pipeline's file."""
    for p in ROOT.iterdir():
        if p.name in left or p.name not in (".git", "skein", "corpus_pipeline.py", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "skein").mkdir()
    for p in (ROOT / "skein").iterdir():
        if p.name != "llm":
            (tmp_path / "skein" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 50"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
