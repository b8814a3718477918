"""Ordered operators on one hot group that several ranges hold."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidelog.operators import layout, manifest, merge, ordering


@pytest.fixture
def ranges(spark):
    """Keeps small ranges apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def ops(spark, ranges):
    rng = random.Random(2)
    data = [("hot" if i % 50 else "cold", f"k{rng.randint(0, 10**6):07d}", i, rng.choice(["put", "put", "delete"]), "v" * rng.randint(0, 60)) for i in range(800)]
    df = spark.createDataFrame(data, "table_name string, key string, seq_no long, op string, value string").dropDuplicates(["table_name", "key"]).cache()
    return df, sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_a_hot_group_is_in_several_ranges(ops):
    assert ordering.spread(ops[0], ["table_name"], ["key"]).where("table_name = 'hot'").select(ordering.BUCKET).distinct().count() > 1


def test_pages(ops):
    df, held = ops
    want, at = [], {}
    for t, k, _, op, _ in held:
        if op == "put":
            want.append((t, k, at.get(t, 0) // 7))
            at[t] = at.get(t, 0) + 1
    assert rows(merge.pages(df, 7), "table_name", "key", "page") == sorted(want, key=repr)


def test_run_page(ops):
    df, held = ops
    want, seen = [], {}
    for t, k, _, op, _ in held:
        if seen.get(t, 0) < 300:
            want.append((t, k))
        seen[t] = seen.get(t, 0) + (op == "put")
    assert rows(merge.run_page(df, 300, ["table_name"]), "table_name", "key") == sorted(want, key=repr)


def test_order_violations(ops):
    df, held = ops
    found, before = {}, {}
    for t, k, s, _, _ in sorted(held, key=lambda r: r[2]):
        if t in before and k <= before[t]:
            found[t] = found.get(t, 0) + 1
        before[t] = k
    assert rows(merge.order_violations(df, ["table_name"], "seq_no")) == sorted(found.items(), key=repr)


def test_floor_route(ops, spark):
    df, held = ops
    starts = {t: [k for x, k, *_ in held if x == t][3::40] for t in ("hot", "cold")}
    runs = spark.createDataFrame([(t, k, f"r{i}") for t, ks in starts.items() for i, k in enumerate(ks)], "table_name string, min_key string, run_id string")
    want = [(t, k, max(s for s in starts[t] if s <= k)) for t, k, *_ in held if any(s <= k for s in starts[t])]
    assert rows(layout.floor_route(df.select("table_name", "key"), runs, ["table_name"]), "table_name", "key", "min_key") == sorted(want, key=repr)


def test_numbers(ops):
    df, held = ops
    got = rows(manifest.numbered(df, 1000, "seq_no"), "seq_no")
    assert got == sorted([(1000 + i,) for i in range(len(held))], key=repr)


@pytest.mark.parametrize("most", [40, 300, 2500, 10**9])
def test_splits(ops, most):
    df, held = ops
    want = []
    for t in ("cold", "hot"):
        own = [r for r in held if r[0] == t]
        sizes = [9 + len(r[1]) + len(r[4]) if r[3] == "put" else 5 + len(r[1]) for r in own]
        want += [(t, r[1], n) for r, n in zip(own, layout.split_points(sizes, most)[0])]
    assert rows(layout.split_runs(df, most, ["table_name"]), "table_name", "key", "run") == sorted(want, key=repr)


def test_null_groups_and_nothing(spark, ranges):
    df = spark.createDataFrame([(None, f"k{i}", i) for i in range(40)] + [("a", "k", 1)], "g string, key string, x long")
    got = rows(ordering.ranked(df, ["g"], ["key"], "at"), "g", "key", "at")
    assert got == sorted([(None, k, i) for i, k in enumerate(sorted(f"k{i}" for i in range(40)))] + [("a", "k", 0)], key=repr)
    assert ordering.ranked(df.where(F.lit(False)), ["g"], ["key"], "at").count() == 0


def test_run_files(ops):
    from tidelog.sources import runfile

    df, held = ops
    found = runfile.to_run_files(df, 1000, "table_name").orderBy("table_name", "run").collect()
    for t in ("cold", "hot"):
        own = [(r[1], r[4].encode() if r[3] == "put" else None) for r in held if r[0] == t]
        want = [data for data, _ in runfile.encode_runs(own, 1000)]
        assert [bytes(r["data"]) for r in found if r["table_name"] == t] == want and len(want) > (t == "hot") * 20
