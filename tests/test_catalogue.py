import pytest
from oracle import connect, same

from tidelog.plans import catalogue, stored  # noqa: F401  (adds its queries)


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, data, con, name):
    same(catalogue.queries()[name](spark, data), con, catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_key_bound_reaches_the_scan(spark, tmp_path):
    from tidelog.operators import merge

    spark.createDataFrame([("t", "a", 1, "put", "x")], "table_name string, key string, seq_no long, op string, value string").write.parquet(str(tmp_path / "ops"))
    plan = merge.scan(spark.read.parquet(str(tmp_path / "ops")), "k", 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(key,k)" in plan


def test_requested_keys_reach_the_scan(spark, tmp_path):
    from tidelog.operators import merge

    spark.createDataFrame([("t", "a", 1, "put", "x")], "table_name string, key string, seq_no long, op string, value string").write.parquet(str(tmp_path / "ops"))
    wanted = spark.createDataFrame([("t", "a"), ("t", "b")], "table_name string, key string")
    for f in (merge.get_batch, merge.get_states):
        plan = f(spark.read.parquet(str(tmp_path / "ops")), wanted)._jdf.queryExecution().executedPlan().toString()
        assert "In(key, [a,b])" in plan or "In(key, [b,a])" in plan


def test_the_rest_works_without_the_corpus_operators():
    """With the optional part absent, or a library that it needs, the other queries are there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    from conftest import ROOT

    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) - len(catalogue.queries()) in (0, 1) and out[1:] == [str(len(catalogue.oracle_sql())), "False"]
