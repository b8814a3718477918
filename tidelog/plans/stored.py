"""Queries that write the operation log into a store and read it back, each with equivalent DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import manifest, merge
from tidelog.plans import oplog as base
from tidelog.plans.catalogue import query
from tidelog.sources.schema import PUT
from tidelog.sources.scratch import scratch_dir
from tidelog.sources.store import Store
from tidelog.streaming import ingest

#: Commits that the log is written in, by equal ranges of its numbers.
COMMITS = 4
_KEPT: dict[tuple[str, str], Store] = {}

base.CTES |= {
    "commits": """SELECT *, CAST(least(4 * (seq_no - 1) // n, 3) AS BIGINT) AS commit_no FROM oplog, (SELECT max(event_id) + 1 AS n FROM events)""",
    "in_commit": "SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY commit_no, table_name, key ORDER BY seq_no DESC) = 1",
    "visible": "SELECT table_name, key, value FROM merged WHERE op = 'put'",
    "tables": "SELECT DISTINCT table_name FROM oplog",
}


def new_store(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    for r in base.oplog(spark, sf_dir).select("table_name").distinct().orderBy("table_name").collect():
        store.create_table(r["table_name"])
    return store


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as write_batch takes it, with the commit of each operation."""
    n = base.events(spark, sf_dir).agg(F.max("event_id") + 1).first()[0] or 1
    log = base.oplog(spark, sf_dir).withColumn("commit_no", F.least(F.floor(COMMITS * (F.col("seq_no") - 1) / n), F.lit(COMMITS - 1)))
    return log.select("table_name", "key", "op", F.col("value").cast("binary").alias("value"), F.col("seq_no").alias("pos"), "commit_no")


def filled(spark: SparkSession, sf_dir: str) -> Store:
    store, log = new_store(spark, sf_dir), commits(spark, sf_dir)
    for i in range(COMMITS):
        store.write_batch(log.where(F.col("commit_no") == i).drop("commit_no"))
    return store


def kept(spark: SparkSession, sf_dir: str) -> Store:
    """A filled store that queries only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = filled(spark, sf_dir)
    return _KEPT[key]


def visible(store: Store) -> DataFrame:
    """table_name, key and value of every live table."""
    rows = merge.visible(store.merged()).join(store.tables_frame(), "table_id")
    return rows.select("table_name", "key", F.col("value").cast("string").alias("value"))


def compacted(store: Store, tables: list[str], levels: int = manifest.LAST_LEVEL) -> Store:
    store.compact_wal()
    for t in tables:
        store.compact_buffer(t)
        for level in range(levels):
            store.compact_level(t, level)
    return store


@query("oplog", "merged", "visible", body="SELECT * FROM visible")
def store_visible(spark, sf_dir):
    return visible(kept(spark, sf_dir))


@query("oplog", "merged", "visible", "requests", body="SELECT v.* FROM visible v SEMI JOIN requests r USING (table_name, key)")
def store_get_batch(spark, sf_dir):
    wanted: dict[str, list[str]] = {}
    for r in base.requests(spark).collect():
        wanted.setdefault(r["table_name"], []).append(r["key"])
    store = kept(spark, sf_dir)
    held = {n for _, n in store.list_tables()}
    found = store.get_batch({t: ks for t, ks in wanted.items() if t in held}, min_seq=store.state().seq_no)
    return found.withColumn("value", F.col("value").cast("string"))


@query("oplog", "merged", "visible", body="SELECT key, value FROM visible WHERE table_name = 'view' AND key > 'u000040' ORDER BY key LIMIT 25")
def store_scan_page(spark, sf_dir):
    return kept(spark, sf_dir).scan("view", "u000040", 25).withColumn("value", F.col("value").cast("string"))


@query("oplog", "commits", "in_commit", body="""SELECT commit_no, CAST(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) AS BIGINT) AS puts, CAST(sum(CASE WHEN op = 'put' THEN 0 ELSE 1 END) AS BIGINT) AS deletes,
CAST(sum(CASE WHEN op = 'put' THEN 9 + strlen(key) + strlen(value) ELSE 5 + strlen(key) END) AS BIGINT) AS bytes FROM in_commit GROUP BY commit_no""")
def store_run_metadata(spark, sf_dir):
    """Manifest rows of the runs that each commit added."""
    added = kept(spark, sf_dir).hydrated()
    first = added.agg(F.min("id")).first()[0]
    out = added.groupBy((F.col("id") - first).alias("commit_no"))
    return out.agg(F.sum("put_count").alias("puts"), F.sum("delete_count").alias("deletes"), (F.sum("size_bytes") - F.count("*")).alias("bytes"))


@query("oplog", "tables", body="SELECT 'table_created' AS kind, CAST(count(*) AS BIGINT) AS entries FROM tables UNION ALL SELECT 'runs', CAST(4 AS BIGINT)")
def store_changelog(spark, sf_dir):
    return kept(spark, sf_dir).changelog_frame().groupBy("kind").agg(F.count("*").alias("entries"))


@query("oplog", "merged", "visible", body="SELECT table_name, key, value, 6 AS level FROM visible")
def store_compacted(spark, sf_dir):
    """The log moved through buffers and all levels, which leaves what is visible and no deletes."""
    store = filled(spark, sf_dir)
    compacted(store, [n for _, n in store.list_tables()])
    places = {(r["tier"], r["level"], r["delete_count"] > 0) for r in store.state().runs.values()}
    if len(places) > 1:
        raise RuntimeError(f"runs are left at {places}")
    return visible(store).withColumn("level", F.lit(next(iter(places))[1] if places else None).cast("int"))


@query("oplog", "commits", body="SELECT table_name, key, value FROM (SELECT * FROM commits WHERE table_name <> 'signup' QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1) WHERE op = 'put'")
def store_after_drop(spark, sf_dir):
    """A table dropped between the writes and the compactions of the others, read from a snapshot by another object."""
    store = filled(spark, sf_dir)
    if "signup" in dict(map(reversed, store.list_tables())):
        store.drop_table("signup")
    compacted(store, [n for _, n in store.list_tables()], 1)
    store.persist_snapshot()
    return visible(Store(spark, store.root))


@query("oplog", "merged", "visible", body="SELECT * FROM visible")
def store_snapshot(spark, sf_dir):
    """A snapshot amid the commits; what follows it is folded upon it."""
    store, log = new_store(spark, sf_dir), commits(spark, sf_dir)
    for i in range(COMMITS):
        store.write_batch(log.where(F.col("commit_no") == i).drop("commit_no"), tag=("log", i))
        if i == 1:
            store.compact_wal()
            store.persist_snapshot()
    store.write_batch(log.where("commit_no = 0").drop("commit_no"), tag=("log", 0))  # a repeated batch is not written
    return visible(Store(spark, store.root))


@query("oplog", "merged", "visible", body="SELECT * FROM visible")
def store_ingest(spark, sf_dir):
    """The log as a stream of files, a commit for each micro-batch."""
    store = new_store(spark, sf_dir)
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = commits(spark, sf_dir)
    log.repartitionByRange(COMMITS, "pos").drop("commit_no").write.parquet(f"{folder}/in")
    # pos tells the order within a micro-batch, so all files, which come in any order, are one
    stream = spark.readStream.schema(log.drop("commit_no").schema).parquet(f"{folder}/in")
    ingest.ingest(stream, store, f"{folder}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    return visible(store)


@query("oplog", "tables", body="SELECT 'wal_compaction' AS job_type, 'completed' AS status, CAST(1 AS BIGINT) AS jobs UNION ALL SELECT 'table_buffer_compaction', 'completed', CAST(count(*) AS BIGINT) FROM tables")
def store_jobs(spark, sf_dir):
    """Compactions that are due, scheduled and run: the log first, then the buffers that this made."""
    store = filled(spark, sf_dir)
    store.maintain(wal_runs=COMMITS, buffer_runs=0)
    store.maintain(wal_runs=COMMITS, buffer_runs=0)
    return store.jobs().groupBy("job_type", "status").agg(F.count("*").alias("jobs"))


@query("oplog", "commits", "in_commit", body="""SELECT table_name, CAST(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) AS BIGINT) AS puts FROM (
SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1) GROUP BY table_name""")
def store_live_runs(spark, sf_dir):
    """Live runs by a stream over the changelog, joined with what the changelog says of them."""
    store = filled(spark, sf_dir)
    store.compact_wal()
    name = f"live_{uuid.uuid4().hex}"
    live = ingest.live_runs_stream(ingest.changelog_stream(spark, store.root))
    q = live.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{store.root}-stream").trigger(availableNow=True).start()
    q.awaitTermination()
    found = store.hydrated().join(spark.table(name).select("run_id"), "run_id", "left_semi").join(store.tables_frame(), "table_id")
    return found.groupBy("table_name").agg(F.sum("put_count").alias("puts"))


@query("oplog", "merged", "requests", body="SELECT r.table_name, r.key, m.op FROM requests r JOIN merged m ON r.table_name = m.table_name AND r.key = m.key")
def store_runs(spark, sf_dir):
    """Every run by its id, merged from the newest to the oldest: the newest operation of the requested keys."""
    store = kept(spark, sf_dir)
    state = store.state()
    layers = [store.get_run(r["run_id"]).withColumn("rank", F.lit(i)) for i, r in enumerate(state.in_order())]
    ops = layers[0]
    for x in layers[1:]:
        ops = ops.unionByName(x)
    newest = merge.first_wins(ops, ("table_id", "key")).join(store.tables_frame(), "table_id")
    return newest.join(base.requests(spark), ["table_name", "key"], "left_semi").select("table_name", "key", F.when(F.col("op") == PUT, PUT).otherwise("delete").alias("op"))
