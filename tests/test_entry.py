import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "term_id", "start", "page_no", "line_no", "x0", "y0", "x1", "y1"]


def test_imports_without_the_llm_files(tmp_path):
    """A copy of the repository without the llm folders keeps its other queries."""
    import shutil

    shutil.copytree(ROOT / "inkveil", tmp_path / "inkveil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'match_phrase' in q and not any(n.startswith('op') for n in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
