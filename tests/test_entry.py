import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "graph_pairs" in entry.queries()


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_rest_of_the_library_works_without_llm():
    """With the subpackage hidden, the entry module still imports and keeps the graph queries."""
    code = "import sys; sys.modules['strandex.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'graph_pairs' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
