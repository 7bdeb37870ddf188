import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "rank", "doc_id", "score"] and out.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "corpusloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "corpusloom.llm" not in path.read_text()
