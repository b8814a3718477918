import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.functions import scalars
from tidelog.operators import layout, manifest
from tidelog.sources import runfile


def encode(items, most=1024):
    return list(runfile.encode_runs(items, most))


def test_a_simple_run():
    [(data, stats)] = encode([("apple", b"red"), ("banana", b"yellow")])
    assert (stats["min_key"], stats["max_key"], stats["size_bytes"], len(data)) == ("apple", "banana", 39, 39)


def test_broken_runs():
    with pytest.raises(runfile.BadRun):
        encode([("apple", b"green"), ("apple", b"red")])
    assert encode([]) == []
    for bad in (b"", b"\x02", b"\x01\x09", b"\x01\x01\0\0\0\x05ab", b"\x01\x02\0\0\0\x01\xff"):
        with pytest.raises(runfile.BadRun):
            list(runfile.decode_run(bad))


def test_searching_a_run():
    [(data, _)] = encode([("apple", b"red"), ("banana", None), ("cherry", b"red")])
    assert runfile.search_run(data, "apple") == ("found", b"red")
    assert runfile.search_run(data, "banana")[0] == "tombstone"
    assert [runfile.search_run(data, k)[0] for k in ("aaa", "bb", "zz")] == ["not_found"] * 3


def test_runs_split_at_the_limit():
    most, mib = 2 << 20, 1 << 20
    out = encode([(f"key_{i:010d}", bytes(mib - 9 - 14)) for i in range(52)], most)
    assert len(out) > 1 and all(s["size_bytes"] <= most for _, s in out)
    assert all(a[1]["max_key"] < b[1]["min_key"] for a, b in zip(out, out[1:]))


def test_an_operation_over_the_limit_gets_its_run():
    assert layout.split_points([10, 500, 10, 10], 100) == ([0, 1, 2, 2], 2, 21)


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("abcXYZ019", min_size=1, max_size=8), st.one_of(st.none(), st.binary(max_size=100)), min_size=1, max_size=50))
def test_runs_round_trip(items):
    order = sorted(items.items(), key=lambda x: x[0].encode())
    files = encode(order, 200)
    assert [x for data, _ in files for x in runfile.decode_run(data)] == order
    sizes = [9 + len(k.encode()) + len(v) if v is not None else 5 + len(k.encode()) for k, v in order]
    numbers, _, _ = layout.split_points(sizes, 200)
    assert numbers[-1] + 1 == len(files)


def test_run_files_through_spark(spark, tmp_path):
    (tmp_path / "a.run").write_bytes(encode([("k1", b"v"), ("k2", None), ("k3", b"")])[0][0])
    df = runfile.read_run_files(spark, str(tmp_path))
    assert rows(df, "key", "op", "value") == [("k1", "put", bytearray(b"v")), ("k2", "delete", None), ("k3", "put", bytearray(b""))]


def test_split_runs_carries_on_over_batches(spark):
    n = 3000
    df = spark.range(n).selectExpr("id % 3 as table_id", "lpad(cast(id as string), 8, '0') as key", "'put' as op", "repeat('x', cast(id % 50 as int)) as value")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = rows(layout.split_runs(df, 400, ["table_id"]), "table_id", "key", "run")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for t in range(3):
        ids = [i for i in range(n) if i % 3 == t]
        numbers, _, _ = layout.split_points([9 + 8 + i % 50 for i in ids], 400)
        want += [(t, f"{i:08d}", r) for i, r in zip(ids, numbers)]
    assert got == sorted(want, key=repr)


def test_floor_ignores_runs_of_other_tables(spark):
    runs = spark.createDataFrame([("a", "r1", "c"), ("a", "r2", "m"), ("b", "r3", "d")], "table_name string, run_id string, min_key string")
    keys = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z"), ("b", "z")], "table_name string, key string")
    assert rows(layout.floor_route(keys, runs, ["table_name"]), "table_name", "key", "run_id") == [("a", "c", "r1"), ("a", "z", "r2"), ("b", "z", "r3")]


def test_folding_the_changelog(spark):
    log = lambda items: spark.createDataFrame(items, "id long, kind string, runs_added array<string>, runs_removed array<string>, table_id long")
    assert rows(manifest.live_runs(log([(1, "runs", ["r1", "r2"], [], None), (2, "runs", [], ["r1", "r2"], None)]))) == []
    assert rows(manifest.live_runs(log([(1, "runs", ["r1", "r2"], [], None), (2, "runs", [], ["r1"], None)])), "run_id") == [("r2",)]
    assert rows(manifest.live_tables(log([(1, "table_created", [], [], 1), (2, "table_dropped", [], [], 1), (3, "table_created", [], [], 2)]))) == [(2,)]


def test_names_and_codes(spark):
    df = spark.createDataFrame([("wal-compaction-123", "10", "/kv.Reader/GetBatch", 0), ("job-x", "not_a_number", "/a", 3), ("5", None, "", 13)], "name string, setting string, path string, code int")
    out = df.select(scalars.job_id_of(df.name).alias("j"), scalars.parsed_or(df.setting, 4).alias("s"), scalars.method_of(df.path).alias("m"), scalars.status_category(df.code).alias("c")).collect()
    assert [tuple(r) for r in out] == [(123, 10, "GetBatch", "ok"), (None, 4, "", "client_error"), (5, 4, "", "server_error")]
