import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_query(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "allocation_index" and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    assert not (tmp_path / "repo/heaplens/llm").exists() and not (tmp_path / "repo/tests/llm").exists() and not (tmp_path / "repo/corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'native_types' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
    tests = [sys.executable, "-m", "pytest", "-x", "-q", "-k", "not without_the_corpus", "tests/test_entry.py", "tests/test_operators.py"]
    subprocess.run(tests, cwd=tmp_path / "repo", check=True, timeout=600)


def test_nothing_else_imports_the_corpus_operators():
    for p in ROOT.glob("heaplens/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "heaplens.llm" not in p.read_text(), p
