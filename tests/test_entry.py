"""The driver's contract, and the library without its llm part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


def test_flagship(spark):
    import __spark_entry__ as e

    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert e.entry(spark).count() == vectors.filter("vec_id % 20 = 0").count()


def test_nothing_else_imports_llm():
    for p in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quarry.llm" not in p.read_text()


def test_imports_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'topk_cosine' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
