import json

import pytest
from helpers import rows

from tidelog.operators.merge import InvalidArgument
from tidelog.plans import oplog
from tidelog.sources.store import AlreadyExists, FailedPrecondition, NotFound, Store
from tidelog.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def visible(store):
    return {n: [(r["key"], bytes(r["value"])) for r in store.scan(n).collect()] for _, n in store.list_tables()}


def test_first_write_after_a_create(store):
    assert store.create_table("t") == 1
    assert store.write_batch({"t": [("k", b"v")]}) == 2
    assert rows(store.get_batch({"t": ["k", "absent"]}, min_seq=2), "key", "value") == [("k", bytearray(b"v"))]


def test_errors(store):
    store.create_table("t")
    for call, error in (
        (lambda: store.create_table("t"), AlreadyExists), (lambda: store.create_table(""), InvalidArgument), (lambda: store.drop_table("x"), NotFound),
        (lambda: store.write_batch({}), InvalidArgument), (lambda: store.write_batch({"x": [("k", b"v")]}), NotFound), (lambda: store.scan("t", None, 0), InvalidArgument),
        (lambda: store.get_batch({"x": ["k"]}), NotFound), (lambda: store.scan("t", min_seq=9), FailedPrecondition), (lambda: store.job_status(7), NotFound),
    ):
        with pytest.raises(error):
            call()


def test_a_dropped_table_can_come_back_empty(store):
    store.create_table("t")
    store.write_batch({"t": [("k", b"old")]})
    store.drop_table("t")
    assert store.list_tables() == []
    store.create_table("t")
    assert store.get_table("t") == 2 and visible(store) == {"t": []}


def test_the_last_write_of_a_batch_wins(store):
    store.create_table("t")
    store.write_batch({"t": [("a", b"1"), ("b", b"1"), ("a", None), ("b", b"2")]})
    assert visible(store) == {"t": [("b", b"2")]}


def test_scans_stay_in_their_table(store):
    for n in ("one", "two"):
        store.create_table(n)
    store.write_batch({"one": [("k1", b"1")], "two": [("k2", b"2"), ("k.3", b"3")]})
    assert visible(store) == {"one": [("k1", b"1")], "two": [("k.3", b"3"), ("k2", b"2")]}


def test_compactions_change_nothing_visible(store):
    model = {"a": {}, "b": {}}
    for n in model:
        store.create_table(n)
    for i in range(20):  # more runs than one compaction reads
        n = "ab"[i % 2]
        items = [(f"k{i}", b"%d" % i), (f"k{i // 2}", None if i % 3 == 0 else b"x%d" % i)]
        store.write_batch({n: items})
        for k, v in items:
            model[n][k] = v
    want = {n: sorted((k, v) for k, v in m.items() if v is not None) for n, m in model.items()}
    assert visible(store) == want
    store.compact_wal()
    assert sum(r["tier"] == "wal" for r in store.state().runs.values()) == 4
    assert visible(store) == want
    for n in model:
        store.compact_buffer(n)
    store.compact_wal()
    assert visible(store) == want
    for n in model:
        store.compact_buffer(n)
        for level in range(6):
            store.compact_level(n, level)
    assert visible(store) == want
    assert {(r["tier"], r["level"]) for r in store.state().runs.values()} == {("level", 6)}
    assert sum(r["delete_count"] for r in store.state().runs.values()) == 0


def test_many_runs_of_a_level_do_not_overlap(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), max_run_bytes=2000)
    store.create_table("t")
    store.write_batch({"t": [(f"k{i:04d}", b"v" * 20) for i in range(400)]})
    store.compact_wal()
    store.compact_buffer("t")
    runs = sorted((r for r in store.state().runs.values() if r["level"] == 0), key=lambda r: r["min_key"])
    assert len(runs) > 1 and all(a["max_key"] < b["min_key"] for a, b in zip(runs, runs[1:]))
    assert store.scan("t", "k0199", 3).count() == 3


def test_a_snapshot_keeps_buffers_and_levels(store):
    store.create_table("t")
    store.write_batch({"t": [("a", b"1")]})
    store.compact_wal()
    store.compact_buffer("t")
    store.compact_level("t", 0)
    store.compact_level("t", 1)
    store.write_batch({"t": [("b", b"2")]})
    store.compact_wal()
    before = store.state()
    store.persist_snapshot()
    assert store.state() == before and {(r["tier"], r["level"]) for r in before.runs.values()} == {("buffer", None), ("level", 2)}
    store.write_batch({"t": [("c", b"3")]})
    assert visible(store) == {"t": [("a", b"1"), ("b", b"2"), ("c", b"3")]}


def test_only_one_writer_gets_a_number(store):
    store.create_table("t")
    assert not store.files.create(f"changelog/{1:020d}.json", "{}")
    assert json.loads(store.files.read(f"changelog/{1:020d}.json"))["table_name"] == "t"


def test_inputs_that_are_gone_stop_a_compaction(store):
    store.create_table("t")
    store.write_batch({"t": [("a", b"1")]})
    run = list(store.state().runs.values())
    store.compact_wal()
    with pytest.raises(FailedPrecondition):
        store._replace(run, [])


def test_jobs(store):
    store.create_table("t")
    for i in range(3):
        store.write_batch({"t": [(f"k{i}", b"v")]})
    first = store.kick_off("wal_compaction")
    assert store.kick_off("wal_compaction") == first
    seq = store.run_job(first)
    assert tuple(store.job_status(first)[c] for c in ("status", "output_seq")) == ("completed", seq)
    with pytest.raises(FailedPrecondition):
        store.run_job(first)
    assert store.maintain(buffer_runs=0) and {r["tier"] for r in store.state().runs.values()} == {"level"}
    assert [r["job_id"] for r in store.list_jobs(0)] == [2]
    assert rows(store.summary(), "table_name", "tier", "run_count") == [("t", "level", 1)]
    assert store.changelog_frame(1).count() == store.state().seq_no - 1


def test_compacting_nothing(store):
    store.create_table("t")
    assert store.compact_wal() == store.compact_buffer("t") == store.compact_level("t", 3) == 1


def test_reset(store):
    store.create_table("t")
    assert store.reset() == ["changelog"] and store.list_tables()
    store.reset(dry_run=False)
    assert store.list_tables() == []


def test_streaming_ingest_is_written_once(spark, data, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    log = oplog.oplog(spark, data)
    for r in log.select("table_name").distinct().collect():
        store.create_table(r["table_name"])
    for i in range(4):
        log.where(f"(seq_no - 1) div 250 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.selectExpr("table_name", "key", "op", "cast(value as binary) as value", "seq_no as pos")
    q = ingest.ingest(stream, store, str(tmp_path / "c"), trigger={"availableNow": True})
    q.awaitTermination()
    from tidelog.operators import merge

    want = rows(merge.visible(merge.latest_wins(log)), "table_name", "key", "value")
    got = sorted(((n, k, v.decode()) for n, items in visible(store).items() for k, v in items), key=repr)
    assert got == want
    seq = store.state().seq_no
    assert store.write_batch({"view": [("zzz", b"v")]}, tag=("ingest", 0)) == seq  # a repeated micro-batch
    tail = ingest.changelog_stream(spark, store.root).writeStream.format("memory").queryName("tail").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    tail.awaitTermination()
    assert spark.table("tail").count() == seq


def test_streaming_state_equals_the_batch(spark, data, tmp_path):
    log = oplog.oplog(spark, data)
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.latest_state(stream).writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    from tidelog.operators import merge

    assert rows(spark.table("state"), "table_name", "key", "seq_no", "op", "value") == rows(merge.latest_wins(log), "table_name", "key", "seq_no", "op", "value")


def test_a_writer_that_dies_within_a_commit_leaves_the_store_as_it_was(store):
    store.create_table("t")
    store.write_batch({"t": [("k", b"v")]})
    # what a writer leaves that dies before it publishes: part of an entry under another name
    draft = store.files._path(f"changelog/.{3:020d}.json-draft")
    out = store.files.fs.create(draft, False)
    out.write(bytearray(b'{"id": 3, "ki'))
    out.close()
    other = Store(store.spark, store.root)
    assert other.state() == store.state() and other.write_batch({"t": [("k2", b"v")]}) == 3
    assert visible(store) == {"t": [("k", b"v"), ("k2", b"v")]}


def test_an_entry_appears_whole_and_once(store):
    store.files.make("changelog")
    drafts = [store.files._path(f"changelog/.draft{i}") for i in range(2)]
    for i, d in enumerate(drafts):
        store.files._write(d, f'{{"writer": {i}}}')
    target = store.files._path("changelog/x.json")
    assert [store.files._publish(d, target) for d in drafts] == [True, False]
    assert json.loads(store.files.read("changelog/x.json")) == {"writer": 0}
    assert store.files.names("changelog") == ["x.json"]


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    first = Store(spark, str(tmp_path / "s"))
    first.create_table("t")
    with ThreadPoolExecutor(4) as pool:
        seqs = list(pool.map(lambda i: Store(spark, first.root).write_batch({"t": [(f"k{i}", b"%d" % i)]}), range(8)))
    assert sorted(seqs) == list(range(2, 10))
    assert visible(first) == {"t": [(f"k{i}", b"%d" % i) for i in range(8)]}


def test_a_key_twice_needs_an_order(store, spark):
    store.create_table("t")
    schema = "table_name string, key string, op string, value binary, pos long"
    rows_ = [("t", "a", "put", b"1", 0), ("t", "a", "delete", None, 1), ("t", "a", "put", b"3", 2)]
    with pytest.raises(InvalidArgument):
        store.write_batch(spark.createDataFrame(rows_, schema).drop("pos"))
    assert visible(store) == {"t": []}
    store.write_batch(spark.createDataFrame(rows_[::-1], schema).repartition(3))
    assert visible(store) == {"t": [("a", b"3")]}


def test_runs_of_the_log_are_sorted_and_bounded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), max_run_bytes=3000)
    for t in ("a", "b"):
        store.create_table(t)
    batch = spark.range(300).selectExpr("if(id % 3 = 0, 'a', 'b') as table_name", "concat('k', lpad(cast(id * 7 % 300 as string), 4, '0')) as key", "'put' as op", "cast('v' as binary) as value").repartition(5)
    store.write_batch(batch)
    runs = list(store.state().runs.values())
    assert len(runs) > 1 and sum(r["put_count"] for r in runs) == 300 and {r["tier"] for r in runs} == {"wal"}
    for r in runs:
        held = [(x["table_id"], x["key"]) for x in store.get_run(r["run_id"]).collect()]
        assert held == sorted(set(held)) and len(held) == r["put_count"]
    store.compact_wal()
    assert {(r["tier"], r["table_id"]) for r in store.state().runs.values()} == {("buffer", 1), ("buffer", 2)}
    gone = store.runs_by_id([runs[0]["run_id"], "unknown"])
    assert list(gone) == [runs[0]["run_id"]] and store.get_run(runs[0]["run_id"]).count() == runs[0]["put_count"]
    with pytest.raises(NotFound):
        store.get_run("unknown/owner=0/part=0")


def test_requested_keys_reach_the_files(store):
    store.create_table("t")
    store.create_table("u")
    store.write_batch({"t": [("a", b"1"), ("m", b"2"), ("z", b"3")]})
    store.write_batch({"t": [("b", b"4"), ("c", b"5")]})
    store.compact_wal()
    plan = store.get_batch({"t": ["m", "n"]})._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [m,n])" in plan and "EqualTo(table_id,1)" in plan
    assert rows(store.get_batch({"t": ["m", "n"]}), "key") == [("m",)]


def test_jobs_are_tried_again_and_taken_once(store, monkeypatch):
    from tidelog.sources import store as module

    store.create_table("t")
    job = store.kick_off("table_tree_compaction", 99, 0)  # no such table
    for k in range(module.ATTEMPTS):
        assert store.job_status(job)["status"] == "pending" and store.job_status(job)["attempts"] == k
        with pytest.raises(KeyError):
            store.run_job(job, now=1e9 * (k + 1))
        if k + 1 < module.ATTEMPTS:
            with pytest.raises(FailedPrecondition, match="waits"):
                store.run_job(job, now=1e9 * (k + 1) + 1)
    assert store.job_status(job)["status"] == "failed"
    with pytest.raises(FailedPrecondition):
        store.run_job(job, now=1e12)
    job = store.kick_off("wal_compaction")
    assert store.files.create(f"jobs/{job:020d}/try-0000.json", json.dumps({"at": __import__("time").time()}))  # another worker has it
    with pytest.raises(FailedPrecondition, match="running"):
        store.run_job(job)
    monkeypatch.setattr(module, "LEASE", -1.0)  # and is lost
    assert store.run_job(job) == store.state().seq_no


def test_the_log_is_compacted_when_due(store):
    store.create_table("t")
    for i in range(5):
        store.write_batch({"t": [(f"k{i}", b"v")]})
    last = store.compact_wal_when_due(lambda s: True, every=0, wal_runs=3)
    assert last == store.state().seq_no == 7 and store.compact_wal_when_due(lambda s: True, every=0, wal_runs=3) == 0
    with pytest.raises(FailedPrecondition):
        store.compact_wal(min_seq=99)


def test_following_the_changelog(store):
    store.create_table("t")
    seen = store.follow(poll=0, until=3)
    assert next(seen).seq_no == 1
    other = Store(store.spark, store.root)
    other.create_table("u")
    other.drop_table("t")
    assert [(s.seq_no, sorted(s.tables)) for s in seen] == [(2, ["t", "u"]), (3, ["u"])]
    history = {r["table_name"]: r for r in store.table_history().collect()}
    assert history["t"]["deleted_at"] >= history["t"]["created_at"] and history["u"]["deleted_at"] is None


def test_settings(store):
    assert store.settings().flush_ops == 50_000
    store.set_settings(flush_ops=7, max_run_bytes="12", concurrent_uploads="many")
    assert (store.settings().flush_ops, store.settings().max_run_bytes, store.settings().concurrent_uploads) == (7, 12, 4)
    store.set_settings(flush_ops=-1)
    assert store.settings().flush_ops == 50_000


def test_large_micro_batches_are_several_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create_table("t")
    store.set_settings(flush_ops=40)
    spark.range(100).selectExpr("'t' as table_name", "concat('k', cast(id % 60 as string)) as key", "'put' as op", "cast(cast(id as string) as binary) as value", "id as pos").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table_name string, key string, op string, value binary, pos long").parquet(str(tmp_path / "in"))
    ingest.ingest(stream, store, str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
    assert store.state().seq_no == 4 and len(store.state().batches) == 3
    assert dict(visible(store)["t"]) == {f"k{i}": b"%d" % (i + 60 if i < 40 else i) for i in range(60)}
