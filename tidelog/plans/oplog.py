"""The operation log, batches and manifest that the registered queries work on, derived from `events`.

Every definition stands twice: as a DataFrame, and as a DuckDB common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import layout
from tidelog.sources.schema import DELETE, PUT

BATCH = 100

CTES = {
    "oplog": """SELECT event_type AS table_name, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS seq_no,
        CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS value FROM events""",
    "merged": "SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY table_name, key ORDER BY seq_no DESC) = 1",
    "batches": "SELECT *, (seq_no - 1) // 100 AS batch_no FROM oplog",
    "in_batch": "SELECT * FROM batches QUALIFY row_number() OVER (PARTITION BY batch_no, table_name, key ORDER BY seq_no DESC) = 1",
    "batch_runs": """SELECT batch_no, table_name, min(key) AS min_key, max(key) AS max_key,
        CAST(1 + sum(CASE WHEN op = 'put' THEN 9 + strlen(key) + strlen(value) ELSE 5 + strlen(key) END) AS BIGINT) AS size_bytes,
        CAST(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) AS BIGINT) AS put_count, CAST(sum(CASE WHEN op = 'put' THEN 0 ELSE 1 END) AS BIGINT) AS delete_count
        FROM in_batch GROUP BY batch_no, table_name""",
    "tiered": """SELECT *, CASE WHEN seq_no - 1 >= 0.9 * n THEN 0 WHEN seq_no - 1 >= 0.6 * n THEN 1 WHEN seq_no - 1 >= 0.3 * n THEN 2 ELSE 3 END AS rank
        FROM oplog, (SELECT max(event_id) + 1 AS n FROM events)""",
    "requests": """SELECT t.table_name, 'u' || lpad(CAST(k.i * 7 AS VARCHAR), 6, '0') AS key
        FROM (VALUES ('view'), ('click'), ('purchase')) t(table_name), (SELECT unnest(range(43)) AS i) k""",
    # runs 0..: ten levels of keys; the upper level starts elsewhere
    "lower_runs": """SELECT table_name, 'L' || CAST(CAST(substr(key, 2) AS BIGINT) // 20 AS VARCHAR) AS run_id, min(key) AS min_key, max(key) AS max_key,
        CAST(sum(CASE WHEN op = 'put' THEN 1 ELSE 0 END) AS BIGINT) AS put_count FROM merged GROUP BY ALL""",
    "upper_runs": "SELECT table_name, 'U' || CAST((CAST(substr(key, 2) AS BIGINT) + 13) // 50 AS VARCHAR) AS run_id, min(key) AS min_key, max(key) AS max_key FROM merged GROUP BY ALL",
    # each batch adds a run; every tenth entry removes the eight runs before it
    "changes": """SELECT b + 1 AS id, ['r' || CAST(b AS VARCHAR)] AS added,
        CASE WHEN b % 10 = 9 THEN list_transform(range(b - 8, b), lambda x: 'r' || CAST(x AS VARCHAR)) ELSE [] END AS removed FROM (SELECT DISTINCT (event_id // 100) AS b FROM events)""",
    "named_tables": "SELECT * FROM (VALUES (0, 'click'), (1, 'view'), (2, 'purchase'), (3, 'signup')) t(table_id, table_name)",
    "manifest": """SELECT CASE table_name WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS table_id,
        CASE WHEN batch_no % 4 = 0 THEN 'wal' WHEN batch_no % 4 = 1 THEN 'buffer' ELSE 'level' END AS tier,
        CASE WHEN batch_no % 4 >= 2 THEN batch_no % 4 - 2 END AS level, size_bytes, batch_no, table_name FROM batch_runs""",
    "requested_jobs": """SELECT event_id + 1 AS job_id, CASE event_id % 3 WHEN 0 THEN 'wal_compaction' WHEN 1 THEN 'table_buffer_compaction' ELSE 'table_tree_compaction' END AS job_type,
        CASE WHEN event_id % 3 > 0 THEN user_id % 5 END AS table_id, CASE WHEN event_id % 3 = 2 THEN user_id % 7 END AS level,
        CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM events""",
    "ddl": """SELECT event_id + 1 AS id, CASE WHEN event_id % 5 = 4 THEN 'table_dropped' ELSE 'table_created' END AS kind, 't' || CAST(user_id AS VARCHAR) AS table_name
        FROM events WHERE event_type = 'signup'""",
}


def with_ctes(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def from_events(e: DataFrame) -> DataFrame:
    gone = F.col("event_id") % 7 == 0
    return e.select(
        F.col("event_type").alias("table_name"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), (F.col("event_id") + 1).alias("seq_no"),
        F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("props")).alias("value"),
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(events(spark, sf_dir))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog(spark, sf_dir).withColumn("batch_no", F.floor((F.col("seq_no") - 1) / BATCH))


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the layer of each operation: 0 log, 1 buffer, 2 and 3 levels."""
    n = events(spark, sf_dir).agg((F.max("event_id") + 1).alias("n"))
    at = F.col("seq_no") - 1
    layer = F.when(at >= F.expr("0.9 * n"), 0).when(at >= F.expr("0.6 * n"), 1).when(at >= F.expr("0.3 * n"), 2).otherwise(3)
    return oplog(spark, sf_dir).join(F.broadcast(n)).withColumn("rank", layer).drop("n")  # one row


def requests(spark: SparkSession) -> DataFrame:
    tables = F.explode(F.array(*[F.lit(t) for t in ("view", "click", "purchase")]))
    return spark.range(43).select(tables.alias("table_name"), F.concat(F.lit("u"), F.lpad((F.col("id") * 7).cast("string"), 6, "0")).alias("key"))


def number_of(key: str = "key") -> F.Column:
    return F.substring(key, 2, 6).cast("long")


def level_runs(merged: DataFrame, letter: str, shift: int, width: int) -> DataFrame:
    run = F.concat(F.lit(letter), F.floor((number_of() + shift) / width).cast("string"))
    return merged.groupBy("table_name", run.alias("run_id")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum((F.col("op") == PUT).cast("long")).alias("put_count"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).select(F.floor(F.col("event_id") / BATCH).alias("b")).distinct()
    run = lambda x: F.concat(F.lit("r"), x.cast("string"))
    removed = F.when(F.col("b") % 10 == 9, F.transform(F.sequence(F.col("b") - 8, F.col("b") - 1), run)).otherwise(F.array().cast("array<string>"))
    return b.select((F.col("b") + 1).alias("id"), F.array(run(F.col("b"))).alias("runs_added"), removed.alias("runs_removed"))


def table_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "click"), (1, "view"), (2, "purchase"), (3, "signup")], "table_id int, table_name string")


def batch_runs(in_batch: DataFrame) -> DataFrame:
    return layout.run_stats(in_batch, ["batch_no", "table_name"])


def manifest_runs(runs: DataFrame) -> DataFrame:
    ids = F.when(F.col("table_name") == "click", 0).when(F.col("table_name") == "view", 1).when(F.col("table_name") == "purchase", 2).when(F.col("table_name") == "signup", 3).otherwise(4)
    four = F.col("batch_no") % 4
    tier = F.when(four == 0, "wal").when(four == 1, "buffer").otherwise("level")
    return runs.select(ids.alias("table_id"), tier.alias("tier"), F.when(four >= 2, four - 2).alias("level"), "size_bytes", "batch_no", "table_name")


def requested_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    three = F.col("event_id") % 3
    return e.select(
        (F.col("event_id") + 1).alias("job_id"), F.when(three == 0, "wal_compaction").when(three == 1, "table_buffer_compaction").otherwise("table_tree_compaction").alias("job_type"),
        F.when(three > 0, F.col("user_id") % 5).alias("table_id"), F.when(three == 2, F.col("user_id") % 7).alias("level"),
        F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 2 == 0, "completed").otherwise("pending").alias("status"),
    )


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'signup'")
    return e.select((F.col("event_id") + 1).alias("id"), F.when(F.col("event_id") % 5 == 4, "table_dropped").otherwise("table_created").alias("kind"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_name"))
