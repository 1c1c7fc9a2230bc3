"""Every query of the article operators against its SQL, over the smallest tables."""

import pytest

from tests.compare import assert_same, connect
from threatloom.plans import q_entities, q_feeds, q_reports, q_vectors

SF = "/root/testdata/sf0.001"
PLANS = [q_feeds, q_entities, q_reports, q_vectors]
QUERIES = {n: f for p in PLANS for n, f in p.queries().items()}
SQL = {n: s for p in PLANS for n, s in p.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().shape[1] > 0


def test_entry_without_llm(tmp_path):
    """A copy without the training-data operators imports, and has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "threatloom", tmp_path / "threatloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries(), '|', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names, sql = (set(x.split()) for x in out.stdout.split("|"))
    assert names == set(QUERIES) and sql == set(SQL)
