import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelog.operators import merge

OPS = "table_name string, key string, seq_no long, op string, value string"


def ops(spark, items):
    return spark.createDataFrame([("t", k, s, "put" if v is not None else "delete", v) for k, s, v in items], OPS)


def test_newest_wins(spark):
    df = ops(spark, [("a", 1, "1"), ("c", 1, "3"), ("a", 2, "10"), ("b", 2, "20")])
    assert rows(merge.latest_wins(df), "key", "value") == [("a", "10"), ("b", "20"), ("c", "3")]


def test_a_delete_hides_older_puts(spark):
    df = ops(spark, [("a", 1, "x"), ("a", 2, None), ("b", 3, None), ("b", 4, "y")])
    assert rows(merge.visible(merge.latest_wins(df)), "key", "value") == [("b", "y")]


def test_a_short_page_does_not_bring_back_a_deleted_key(spark):
    df = ops(spark, [("a", 3, None), ("a", 2, "a"), ("b", 2, None), ("b", 1, "b")])
    assert rows(merge.scan(df, None, 1)) == []


def test_pages_follow_one_another(spark):
    df = ops(spark, [(f"k{i:03d}", i, str(i) if i % 3 else None) for i in range(100)])
    whole = [r["key"] for r in merge.scan(df).collect()]
    pages, start = [], None
    while True:
        page = [r["key"] for r in merge.scan(df, start, 7).collect()]
        if not page:
            break
        pages += page
        start = page[-1]
    assert pages == whole and len(whole) == 66


def test_limits_of_a_page(spark):
    for n in (0, 10_001):
        with pytest.raises(merge.InvalidArgument):
            merge.scan(ops(spark, []), None, n)


def test_run_page_counts_puts_only(spark):
    run = ops(spark, [("a_key1", 1, "v1"), ("b_key2", 1, None), ("c_key3", 1, "v3"), ("d_key4", 1, "v4")])
    assert [r[0] for r in rows(merge.run_page(run, 10), "key")] == ["a_key1", "b_key2", "c_key3", "d_key4"]
    assert [r[0] for r in rows(merge.run_page(run, 2), "key")] == ["a_key1", "b_key2", "c_key3"]
    assert [r[0] for r in rows(merge.run_page(run.where("key > 'b_key2'"), 10), "key")] == ["c_key3", "d_key4"]


def test_listed_runs_in_their_order(spark):
    df = spark.createDataFrame([("run1", "apple", "put", "red1"), ("run1", "banana", "put", "yellow1"), ("run2", "banana", "put", "green2"), ("run2", "cherry", "delete", None)], "run_id string, key string, op string, value string")
    out = merge.first_wins(merge.listed_runs(df, ["run2", "run1"]).drop("run_id"), ("key",))
    assert rows(out, "key", "op", "value") == [("apple", "put", "red1"), ("banana", "put", "green2"), ("cherry", "delete", None)]


def test_three_states(spark):
    df = ops(spark, [("apple", 1, "red"), ("banana", 1, None)])
    asked = spark.createDataFrame([("t", k) for k in ("apple", "banana", "date", "date")], "table_name string, key string")
    assert rows(merge.get_states(df, asked), "key", "state") == [("apple", "found"), ("banana", "tombstone"), ("date", "not_found")]


def test_keys_compare_by_bytes(spark):
    keys = ["", "B", "a", "z", "é", "￿", "😀"]
    df = ops(spark, [(k, 1, "v") for k in reversed(keys)])
    assert [r["key"] for r in merge.scan(df).collect()] == keys
    assert [r["key"] for r in merge.scan(df, "").collect()] == keys[1:]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.one_of(st.none(), st.text("xyz", max_size=3))), max_size=40))
def test_against_a_dictionary(spark, items):
    state = {}
    for k, v in items:
        state[k] = v
    df = ops(spark, [(k, i, v) for i, (k, v) in enumerate(items)])
    assert rows(merge.visible(merge.latest_wins(df)), "key", "value") == sorted((k, v) for k, v in state.items() if v is not None)
