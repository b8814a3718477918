"""Queries over the operation log, each with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import scalars
from tidelog.operators import layout, manifest, merge
from tidelog.plans import oplog as base
from tidelog.sources import runfile
from tidelog.sources.schema import PUT, PUT_OVERHEAD

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(*ctes: str, body: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with SQL over the named common table expressions."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if body:
            _SQL[f.__name__] = base.with_ctes(*ctes, body=body) if ctes else body
        return f

    return add


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_wins(base.oplog(spark, sf_dir))


def _in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_wins(base.batches(spark, sf_dir), ("batch_no", "table_name", "key"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.batch_runs(_in_batch(spark, sf_dir))


# merging and reading


@query("oplog", "merged", body="SELECT * FROM merged")
def latest_wins(spark, sf_dir):
    return _merged(spark, sf_dir)


@query("oplog", "merged", body="SELECT table_name, key, seq_no, value FROM merged WHERE op = 'put'")
def visible_state(spark, sf_dir):
    return merge.visible(_merged(spark, sf_dir)).drop("op")


@query("oplog", "merged", body="SELECT key, value FROM merged WHERE op = 'put' AND table_name = 'view' AND key IN (SELECT 'u' || lpad(CAST(i * 10 AS VARCHAR), 6, '0') FROM (SELECT unnest(range(20)) AS i))")
def get_batch_single(spark, sf_dir):
    keys = spark.range(20).select(F.lit("view").alias("table_name"), F.concat(F.lit("u"), F.lpad((F.col("id") * 10).cast("string"), 6, "0")).alias("key"))
    return merge.get_batch(base.oplog(spark, sf_dir), keys).select("key", "value")


@query("oplog", "merged", "requests", body="SELECT table_name, key, seq_no, value FROM merged SEMI JOIN requests USING (table_name, key) WHERE op = 'put'")
def get_batch_multi(spark, sf_dir):
    return merge.get_batch(base.oplog(spark, sf_dir), base.requests(spark)).drop("op")


@query("oplog", "merged", "requests", body="SELECT r.table_name, r.key, CASE WHEN m.op IS NULL THEN 'not_found' WHEN m.op = 'put' THEN 'found' ELSE 'tombstone' END AS state, m.value FROM requests r LEFT JOIN merged m ON r.table_name = m.table_name AND r.key = m.key")
def get_tristate(spark, sf_dir):
    return merge.get_states(base.oplog(spark, sf_dir), base.requests(spark))


@query("oplog", "merged", body="SELECT key, seq_no, value FROM merged WHERE table_name = 'view' AND op = 'put' AND key > 'u000040' ORDER BY key LIMIT 25")
def scan_page(spark, sf_dir):
    return merge.scan(base.oplog(spark, sf_dir).where("table_name = 'view'"), "u000040", 25).select("key", "seq_no", "value")


@query("oplog", "merged", body="SELECT table_name, key, CAST((row_number() OVER (PARTITION BY table_name ORDER BY key) - 1) // 25 AS BIGINT) AS page FROM merged WHERE op = 'put'")
def scan_pages_concat(spark, sf_dir):
    return merge.pages(base.oplog(spark, sf_dir), 25).select("table_name", "key", "page")


@query("oplog", "batches", "in_batch", body="SELECT batch_no, table_name, key, op FROM (SELECT *, coalesce(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) OVER (PARTITION BY batch_no, table_name ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM in_batch) WHERE b < 5")
def scan_run_page(spark, sf_dir):
    return merge.run_page(_in_batch(spark, sf_dir), 5, ("batch_no", "table_name")).select("batch_no", "table_name", "key", "op")


@query("oplog", "merged", body="SELECT table_name, key, op, value FROM merged")
def layered_read(spark, sf_dir):
    tiers = merge.latest_wins(base.tiered(spark, sf_dir), ("rank", "table_name", "key"))
    return merge.first_wins(tiers).select("table_name", "key", "op", "value")


@query("oplog", "batches", "in_batch", body="SELECT batch_no, table_name, key, op, value FROM in_batch")
def batch_dedup(spark, sf_dir):
    ops = base.batches(spark, sf_dir).withColumns({"batch_pos": F.floor((F.col("seq_no") - 1) / 10), "item_pos": (F.col("seq_no") - 1) % 10})
    return merge.batch_dedup(ops, ("batch_no", "table_name", "key")).select("batch_no", "table_name", "key", "op", "value")


@query("oplog", "batches", "in_batch", body="SELECT table_name, key, op, value, CAST(list_position([3, 1, 2], batch_no) AS BIGINT) AS rank FROM in_batch WHERE batch_no IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY list_position([3, 1, 2], batch_no)) = 1")
def get_from_runs(spark, sf_dir):
    ops = merge.listed_runs(_in_batch(spark, sf_dir), [3, 1, 2], "batch_no").select("table_name", "key", "op", "value", "rank")
    return merge.first_wins(ops)


@query("oplog", "batches", "in_batch", body="SELECT key, op, value FROM (SELECT * FROM in_batch WHERE batch_no IN (1, 2, 3) AND table_name = 'view' AND key > 'u000020' QUALIFY row_number() OVER (PARTITION BY key ORDER BY list_position([3, 1, 2], batch_no)) = 1) QUALIFY coalesce(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10")
def scan_from_runs(spark, sf_dir):
    ops = merge.listed_runs(_in_batch(spark, sf_dir).where("table_name = 'view' and key > 'u000020'"), [3, 1, 2], "batch_no").select("table_name", "key", "op", "value", "rank")
    return merge.run_page(merge.first_wins(ops), 10, ("table_name",)).select("key", "op", "value")


@query("oplog", body="SELECT * FROM oplog WHERE seq_no <= 5000 QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1")
def time_travel(spark, sf_dir):
    return merge.as_of(base.oplog(spark, sf_dir), 5000)


@query("oplog", body="SELECT table_name, CAST(count(*) AS BIGINT) AS violations FROM (SELECT table_name, key, lag(key) OVER (PARTITION BY table_name ORDER BY seq_no) AS b FROM oplog) WHERE key <= b GROUP BY table_name")
def sorted_check(spark, sf_dir):
    return merge.order_violations(base.oplog(spark, sf_dir), ["table_name"], "seq_no")


# runs and compactions


@query("oplog", "batches", "in_batch", "batch_runs", body="SELECT * FROM batch_runs")
def run_stats(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(body="""WITH RECURSIVE docs AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, 9 + 12 + strlen(text) AS sz, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
walk AS (SELECT rn, key, CAST(0 AS BIGINT) AS run, CAST(1 + sz AS BIGINT) AS held FROM docs WHERE rn = 1
UNION ALL SELECT d.rn, d.key, CAST(w.run + CASE WHEN w.held + d.sz > 16384 THEN 1 ELSE 0 END AS BIGINT), CAST(CASE WHEN w.held + d.sz > 16384 THEN 1 + d.sz ELSE w.held + d.sz END AS BIGINT) FROM walk w JOIN docs d ON d.rn = w.rn + 1)
SELECT run, min(key) AS min_key, max(key) AS max_key, CAST(count(*) AS BIGINT) AS put_count FROM walk GROUP BY run""")
def run_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    sized = docs.select(F.lit("documents").alias("table_name"), key.alias("key"), (F.octet_length("text") + F.octet_length(key) + PUT_OVERHEAD).cast("long").alias("size"))
    return layout.split_sized(sized, 16384, ["table_name"]).groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("put_count"))


@query("oplog", "batches", body="SELECT table_name, key, seq_no, op, value FROM batches WHERE batch_no < 16 QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1")
def wal_compaction(spark, sf_dir):
    return merge.latest_wins(base.batches(spark, sf_dir).where("batch_no < 16").drop("batch_no"))


@query("oplog", "tiered", body="""SELECT table_name, key, op, value FROM tiered WHERE rank = 2 OR rank = 1 AND (seq_no - 1) // 100 IN (SELECT DISTINCT (seq_no - 1) // 100 AS b FROM tiered WHERE rank = 1 ORDER BY b LIMIT 16)
QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1""")
def buffer_compaction(spark, sf_dir):
    """The sixteen oldest buffer runs, a run for each batch, with all of level 0."""
    tiers = base.tiered(spark, sf_dir).withColumn("run_id", F.floor((F.col("seq_no") - 1) / base.BATCH))
    oldest = layout.oldest(tiers.where("rank = 1").select(F.col("run_id").alias("seq_no"), "run_id").distinct(), manifest.FAN_IN)
    buffer = tiers.where("rank = 1").join(F.broadcast(oldest.select("run_id")), "run_id", "left_semi")  # FAN_IN rows
    ops = merge.latest_wins(buffer.unionByName(tiers.where("rank = 2"), allowMissingColumns=True).drop("run_id"), ("rank", "table_name", "key"))
    return merge.first_wins(ops).select("table_name", "key", "op", "value")


@query("oplog", "tiered", body="SELECT table_name, key, value FROM (SELECT * FROM tiered WHERE rank >= 2 QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1) WHERE op = 'put'")
def level_compaction_max(spark, sf_dir):
    """A level merged into the last one, which keeps no deletes."""
    ops = merge.latest_wins(base.tiered(spark, sf_dir).where("rank >= 2"), ("rank", "table_name", "key"))
    return merge.visible(merge.first_wins(ops)).select("table_name", "key", "value")


@query("oplog", "merged", "lower_runs", "requests", body="SELECT r.table_name, r.key, l.run_id, l.min_key FROM requests r ASOF JOIN lower_runs l ON r.table_name = l.table_name AND r.key >= l.min_key")
def floor_route(spark, sf_dir):
    return layout.floor_route(base.requests(spark), base.level_runs(_merged(spark, sf_dir), "L", 0, 20), ["table_name"])


@query("oplog", "merged", "lower_runs", "upper_runs", body="SELECT u.table_name, u.run_id AS upper_run, l.run_id AS lower_run FROM upper_runs u JOIN lower_runs l ON u.table_name = l.table_name AND l.min_key <= u.max_key AND l.max_key >= u.min_key")
def run_overlap(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return layout.overlapping(base.level_runs(merged, "U", 13, 50), base.level_runs(merged, "L", 0, 20), ["table_name"])


@query("oplog", "merged", "lower_runs", body="SELECT table_name, run_id, min_key, max_key FROM lower_runs WHERE max_key > 'u000077'")
def run_prune(spark, sf_dir):
    return layout.prune_runs(base.level_runs(_merged(spark, sf_dir), "L", 0, 20), "u000077").drop("put_count")


@query("oplog", "merged", "lower_runs", body="SELECT table_name, run_id, put_count FROM (SELECT *, coalesce(sum(put_count) OVER (PARTITION BY table_name ORDER BY min_key, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lower_runs) WHERE b <= 40")
def put_budget(spark, sf_dir):
    return layout.put_budget(base.level_runs(_merged(spark, sf_dir), "L", 0, 20), 40, ["table_name"]).select("table_name", "run_id", "put_count")


@query("oplog", "batches", "in_batch", "batch_runs", body="SELECT batch_no AS seq_no, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM batch_runs GROUP BY batch_no ORDER BY batch_no LIMIT 16")
def oldest_k(spark, sf_dir):
    runs = _runs(spark, sf_dir).groupBy(F.col("batch_no").alias("seq_no")).agg(F.sum("size_bytes").alias("size_bytes"))
    return layout.oldest(runs.withColumn("run_id", F.col("seq_no").cast("string")), 16).drop("run_id")


@query("oplog", body="""SELECT table_name, key, op, value FROM oplog QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1""")
def run_file_round_trip(spark, sf_dir):
    files = runfile.to_run_files(_merged(spark, sf_dir), 4096, "table_name")

    def read(frames):
        import pandas as pd

        for f in frames:
            for table, data in zip(f["table_name"], f["data"]):
                ops = list(runfile.decode_run(bytes(data)))
                yield pd.DataFrame({"table_name": table, "key": [k for k, _ in ops], "op": ["delete" if v is None else "put" for _, v in ops], "value": [None if v is None else v.decode() for _, v in ops]})

    return files.select("table_name", "data").mapInPandas(read, "table_name string, key string, op string, value string")


@query(body="""WITH ring AS (SELECT 'pod-' || CAST(p AS VARCHAR) AS node, md5('pod-' || CAST(p AS VARCHAR) || '#' || CAST(i AS VARCHAR)) AS point FROM (SELECT unnest(range(5)) AS p), (SELECT unnest(range(4)) AS i)),
runs AS (SELECT DISTINCT 'run-' || CAST(event_id // 100 AS VARCHAR) AS key FROM events)
SELECT key, coalesce((SELECT arg_min(node, point) FROM ring WHERE point >= md5(key)), (SELECT arg_min(node, point) FROM ring)) AS node FROM runs""")
def hash_ring(spark, sf_dir):
    runs = base.events(spark, sf_dir).select(F.concat(F.lit("run-"), F.floor(F.col("event_id") / 100).cast("string")).alias("key")).distinct()
    return layout.hash_ring(runs, [f"pod-{i}" for i in range(5)])


# manifest, jobs, tables


@query("changes", body="SELECT run_id, max(id) AS added_at FROM (SELECT id, unnest(added) AS run_id FROM changes) WHERE run_id NOT IN (SELECT unnest(removed) FROM changes) GROUP BY run_id")
def changelog_fold(spark, sf_dir):
    return manifest.live_runs(base.changes(spark, sf_dir))


@query("changes", body="SELECT id, CAST(len(removed) AS INTEGER) AS removed FROM changes WHERE id > 40 ORDER BY id")
def changelog_tail(spark, sf_dir):
    return manifest.tail(base.changes(spark, sf_dir), 40).select("id", F.size("runs_removed").alias("removed"))


_SUMMARY = """SELECT m.table_id, coalesce(n.table_name, 'unknown') AS table_name, m.tier, m.level, CAST(count(*) AS BIGINT) AS run_count, CAST(sum(m.size_bytes) AS BIGINT) AS size_bytes
FROM manifest m LEFT JOIN named_tables n ON m.table_id = n.table_id GROUP BY ALL"""


@query("oplog", "batches", "in_batch", "batch_runs", "manifest", "named_tables", body=_SUMMARY)
def snapshot_summary(spark, sf_dir):
    return manifest.summary(base.manifest_runs(_runs(spark, sf_dir)), base.table_names(spark))


@query("oplog", "batches", "in_batch", "batch_runs", "manifest", body="""SELECT 'wal_compaction' AS job_type, CAST(NULL AS BIGINT) AS table_id, CAST(NULL AS BIGINT) AS level FROM manifest WHERE tier = 'wal' HAVING sum(size_bytes) >= 10000 OR count(*) >= 25
UNION ALL SELECT 'table_buffer_compaction', table_id, NULL FROM manifest WHERE tier = 'buffer' GROUP BY table_id HAVING sum(size_bytes) > 8000 OR count(*) > 25
UNION ALL SELECT 'table_tree_compaction', table_id, level FROM manifest WHERE tier = 'level' AND level < 6 GROUP BY table_id, level HAVING sum(size_bytes) > 2000 * pow(10, level)""")
def plan_jobs(spark, sf_dir):
    runs = base.manifest_runs(_runs(spark, sf_dir)).withColumn("table_id", F.col("table_id").cast("long"))
    return manifest.plan_jobs(runs, wal_bytes=10_000, buffer_bytes=8_000, level_bytes=2_000)


@query("requested_jobs", body="SELECT job_id, job_type, status FROM requested_jobs ORDER BY job_id DESC LIMIT 100")
def jobs_recent(spark, sf_dir):
    return manifest.recent_jobs(base.requested_jobs(spark, sf_dir), 500).select("job_id", "job_type", "status")


@query("requested_jobs", body="SELECT job_id, job_type FROM requested_jobs WHERE status = 'pending' AND job_id % 4 <> 0")
def jobs_pending_anti(spark, sf_dir):
    jobs = base.requested_jobs(spark, sf_dir)
    return manifest.to_launch(jobs, jobs.where("job_id % 4 = 0")).select("job_id", "job_type")


@query("requested_jobs", body="SELECT job_type, table_id, level, min(job_id) AS job_id, CAST(count(*) AS BIGINT) AS requests FROM requested_jobs GROUP BY job_type, table_id, level")
def jobs_idempotent(spark, sf_dir):
    return manifest.first_pending(base.requested_jobs(spark, sf_dir))


@query("requested_jobs", body="SELECT DISTINCT job_type, table_id, level + 2 AS level FROM requested_jobs r WHERE status <> 'pending' AND NOT EXISTS (SELECT 1 FROM requested_jobs p WHERE p.status = 'pending' AND p.job_type = r.job_type AND p.table_id IS NOT DISTINCT FROM r.table_id AND p.level IS NOT DISTINCT FROM r.level + 2)")
def jobs_schedule(spark, sf_dir):
    jobs = base.requested_jobs(spark, sf_dir)
    return manifest.schedule(jobs.where("status <> 'pending'").select("job_type", "table_id", (F.col("level") + 2).alias("level")), jobs)


@query("ddl", body="SELECT table_name, max(id) AS table_id FROM ddl GROUP BY table_name HAVING arg_max(kind, id) = 'table_created'")
def table_catalog(spark, sf_dir):
    entries = base.ddl(spark, sf_dir).select("id", "kind", F.col("table_name").alias("table_id"))
    return manifest.created_tables(entries).select(F.col("table_id").alias("table_name"), F.col("last_id").alias("table_id"))


@query(body="SELECT event_id AS seq_no, 'snapshots/' || CAST(event_id AS VARCHAR) AS snapshot_id FROM events WHERE event_id % 500 = 0 ORDER BY seq_no DESC LIMIT 1")
def latest_snapshot(spark, sf_dir):
    e = base.events(spark, sf_dir).where("event_id % 500 = 0")
    return manifest.newest_snapshot(e.select(F.col("event_id").alias("seq_no"), F.concat(F.lit("snapshots/"), F.col("event_id").cast("string")).alias("snapshot_id")))


@query("changes", body="SELECT r AS run_id, CAST(1000 + row_number() OVER (ORDER BY r) - 1 AS BIGINT) AS seq_no FROM (SELECT unnest(added) AS r FROM changes)")
def sequence_block(spark, sf_dir):
    return manifest.numbered(base.changes(spark, sf_dir).select(F.explode("runs_added").alias("run_id")), 1000, "run_id")


# functions


@query(body="""WITH k AS (SELECT event_id, CAST(user_id AS VARCHAR) || '.' || event_type || '.' || CAST(event_id AS VARCHAR) AS p FROM events
UNION ALL SELECT event_id, event_type || '.x' FROM events WHERE event_id < 20 UNION ALL SELECT event_id, event_type FROM events WHERE event_id < 20)
SELECT p AS physical, CASE WHEN strpos(p, '.') > 0 THEN TRY_CAST(split_part(p, '.', 1) AS BIGINT) END AS table_id, CASE WHEN strpos(p, '.') > 0 THEN substr(p, strpos(p, '.') + 1) END AS key FROM k""")
def key_codec(spark, sf_dir):
    e = base.events(spark, sf_dir)
    good = e.select(scalars.namespaced(F.col("user_id"), F.concat_ws(".", "event_type", F.col("event_id").cast("string"))).alias("p"))
    few = e.where("event_id < 20")
    p = good.unionByName(few.select(F.concat("event_type", F.lit(".x")).alias("p"))).unionByName(few.select(F.col("event_type").alias("p")))
    return p.select(F.col("p").alias("physical"), scalars.table_of(F.col("p")).alias("table_id"), scalars.key_of(F.col("p")).alias("key"))


@query(body="""SELECT event_id, CAST(event_id % 20 AS INTEGER) AS code,
CASE WHEN event_id % 20 = 0 THEN 'ok' WHEN event_id % 20 IN (1, 3, 5, 6, 7, 9, 11, 16) THEN 'client_error' ELSE 'server_error' END AS category,
CASE WHEN event_id % 20 < 17 THEN ['Ok', 'Cancelled', 'Unknown', 'InvalidArgument', 'DeadlineExceeded', 'NotFound', 'AlreadyExists', 'PermissionDenied', 'ResourceExhausted', 'FailedPrecondition', 'Aborted', 'OutOfRange', 'Unimplemented', 'Internal', 'Unavailable', 'DataLoss', 'Unauthenticated'][event_id % 20 + 1] ELSE 'Unknown' END AS name FROM events""")
def status_category(spark, sf_dir):
    code = (F.col("event_id") % 20).cast("int")
    return base.events(spark, sf_dir).select("event_id", code.alias("code"), scalars.status_category(code).alias("category"), scalars.status_name(code).alias("name"))


@query("requested_jobs", body="SELECT job_type || '-' || CAST(job_id AS VARCHAR) AS name, job_id FROM requested_jobs UNION ALL SELECT job_type || '-' || CAST(job_id AS VARCHAR) || '-x', NULL FROM requested_jobs")
def job_names(spark, sf_dir):
    named = base.requested_jobs(spark, sf_dir).select(scalars.job_name(F.col("job_type"), F.col("job_id")).alias("name"))
    both = named.unionByName(named.select(F.concat("name", F.lit("-x")).alias("name")))
    return both.select("name", scalars.job_id_of(F.col("name")).alias("job_id"))


@query(body="""WITH p AS (SELECT event_id, '/kv.Store/' || event_type || CAST(event_id % 4 AS VARCHAR) AS plain FROM events)
SELECT event_id, plain AS path, split_part(plain, '/', 3) AS method FROM p""")
def request_paths(spark, sf_dir):
    """Paths as they come in, with slashes escaped, and the methods that they name."""
    path = scalars.url_decoded(F.concat(F.lit("%2Fkv.Store%2f"), "event_type", (F.col("event_id") % 4).cast("string")))
    return base.events(spark, sf_dir).select("event_id", path.alias("path"), scalars.method_of(path).alias("method"))


@query("requested_jobs", body="SELECT job_id FROM requested_jobs WHERE status = 'pending' AND job_id % 4 = 0")
def jobs_still_known(spark, sf_dir):
    jobs = base.requested_jobs(spark, sf_dir)
    return manifest.still_known(jobs.where("job_id % 4 = 0").select("job_id"), jobs)


# uses


@query(body="SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS entries, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
def secondary_index(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    primary = orders.select(F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("value"), F.lit(PUT).alias("op"), F.col("o_orderkey").alias("seq_no"))
    index = orders.select(F.lit("by_customer").alias("table_name"), F.concat_ws(".", "o_custkey", "o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.lit(PUT).alias("op"), F.col("o_orderkey").alias("seq_no"))
    entries = merge.visible(merge.latest_wins(primary.unionByName(index))).where("table_name = 'by_customer'")
    order = F.col("value").cast("long")
    return entries.groupBy(F.substring_index("key", ".", 1).alias("key")).agg(F.count("*").alias("entries"), F.min(order).alias("first_order"), F.max(order).alias("last_order"))


@query(body="SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(count(o_orderkey) AS BIGINT) AS n_orders, round(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) / 100.0, 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def feature_serving(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    features = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    puts = features.select(F.lit("features").alias("table_name"), F.col("o_custkey").cast("string").alias("key"), F.lit(PUT).alias("op"), F.lit(1).cast("long").alias("seq_no"), F.struct("n", "cents").alias("value"))
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("features").alias("table_name"), F.col("c_custkey").cast("string").alias("key"))
    found = merge.get_states(puts, wanted)
    return found.select("key", F.coalesce("value.n", F.lit(0).cast("long")).alias("n_orders"), F.round(F.coalesce("value.cents", F.lit(0).cast("long")) / 100.0, 2).alias("spent"))


@query(body="SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE lpad(CAST(doc_id AS VARCHAR), 12, '0') > '000000000100' ORDER BY key LIMIT 50")
def bulk_kv_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    puts = docs.select(F.lit("documents").alias("table_name"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), F.lit(1).cast("long").alias("seq_no"), F.lit(PUT).alias("op"), F.octet_length("text").cast("long").alias("value"))
    return merge.scan(puts, "000000000100", 50).select("key", F.col("value").alias("size"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
