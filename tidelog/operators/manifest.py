"""The manifest: folding the changelog, summaries, the catalogue of tables, and compaction jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import ordering

#: When compactions and snapshots are due.
WAL_BYTES, WAL_RUNS = 100_000_000, 25
BUFFER_BYTES, BUFFER_RUNS = 100_000_000, 25
LEVEL_BYTES, LEVEL_GROWTH, LAST_LEVEL = 1_000_000_000, 10, 6
SNAPSHOT_LAG = 5000
FAN_IN = 16


def run_events(changelog: DataFrame) -> DataFrame:
    """run_id, id and live (added or removed) for each run that an entry names."""
    each = lambda c, live: changelog.select("id", F.explode(c).alias("run_id"), F.lit(live).alias("live"))
    return each("runs_added", True).unionByName(each("runs_removed", False))


def live_runs(changelog: DataFrame, upto: int | None = None) -> DataFrame:
    """Runs that the last entry naming them added; added_at is that entry. A run that one entry both adds and removes is gone."""
    events = run_events(changelog if upto is None else changelog.where(F.col("id") <= upto))
    last = events.groupBy("run_id").agg(F.max(F.struct("id", (~F.col("live")).alias("gone"))).alias("x"))
    return last.where("not x.gone").select("run_id", F.col("x.id").alias("added_at"))


def tail(changelog: DataFrame, after: int) -> DataFrame:
    """Entries after an id (exclusive), in order."""
    return changelog.where(F.col("id") > after).orderBy("id")


def created_tables(changelog: DataFrame) -> DataFrame:
    """table_id and last_id, the entry that created it, of the tables created and not dropped."""
    of = changelog.where(F.col("kind").isin("table_created", "table_dropped"))
    last = of.groupBy("table_id").agg(F.max_by("kind", "id").alias("kind"), F.max("id").alias("last_id"))
    return last.where("kind = 'table_created'").select("table_id", "last_id")


def live_tables(changelog: DataFrame) -> DataFrame:
    """table_id of the tables created and not dropped."""
    return created_tables(changelog).select("table_id")


def summary(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Runs and bytes by table, tier and level; tables without a name are 'unknown'."""
    by = runs.groupBy("table_id", "tier", "level").agg(F.count("*").alias("run_count"), F.sum("size_bytes").alias("size_bytes"))
    named = by.join(tables.select("table_id", "table_name"), "table_id", "left")
    return named.select("table_id", F.coalesce("table_name", F.lit("unknown")).alias("table_name"), "tier", "level", "run_count", "size_bytes")


def plan_jobs(
    runs: DataFrame, wal_bytes: int = WAL_BYTES, wal_runs: int = WAL_RUNS, buffer_bytes: int = BUFFER_BYTES, buffer_runs: int = BUFFER_RUNS, level_bytes: int = LEVEL_BYTES,
) -> DataFrame:
    """job_type, table_id and level of the compactions that are due."""
    size, n = F.sum("size_bytes").alias("size"), F.count("*").alias("n")
    none = F.lit(None).cast("long")
    wal = runs.where("tier = 'wal'").agg(size, n).where((F.col("size") >= wal_bytes) | (F.col("n") >= wal_runs)).select(F.lit("wal_compaction").alias("job_type"), none.alias("table_id"), none.alias("level"))
    buffer = runs.where("tier = 'buffer'").groupBy("table_id").agg(size, n).where((F.col("size") > buffer_bytes) | (F.col("n") > buffer_runs)).select(F.lit("table_buffer_compaction").alias("job_type"), "table_id", none.alias("level"))
    level = runs.where((F.col("tier") == "level") & (F.col("level") < LAST_LEVEL)).groupBy("table_id", "level").agg(size)
    level = level.where(F.col("size") > F.pow(F.lit(float(LEVEL_GROWTH)), F.col("level")) * level_bytes).select(F.lit("table_tree_compaction").alias("job_type"), "table_id", "level")
    return wal.unionByName(buffer).unionByName(level)


def schedule(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Of the wanted jobs those for which none with the same parameters is pending."""
    pending = jobs.where("status = 'pending'").select(F.col("job_type").alias("t"), F.col("table_id").alias("i"), F.col("level").alias("l"))
    on = (F.col("job_type") == F.col("t")) & F.col("table_id").eqNullSafe(F.col("i")) & F.col("level").eqNullSafe(F.col("l"))
    return wanted.distinct().join(pending, on, "left_anti")


def recent_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """The newest jobs; the limit is held within 1 and 100."""
    return jobs.orderBy(F.desc("job_id")).limit(max(1, min(100, limit)))


def to_launch(jobs: DataFrame, launched: DataFrame) -> DataFrame:
    """Pending jobs that are not launched yet."""
    return jobs.where("status = 'pending'").join(launched.select("job_id"), "job_id", "left_anti")


def still_known(launched: DataFrame, jobs: DataFrame) -> DataFrame:
    """Launched jobs that are still pending, others need not be remembered."""
    return launched.join(jobs.where("status = 'pending'").select("job_id"), "job_id", "left_semi")


def first_pending(requests: DataFrame) -> DataFrame:
    """The ledger that idempotent scheduling leaves: the first request of each kind, with how often it was asked."""
    return requests.groupBy("job_type", "table_id", "level").agg(F.min("job_id").alias("job_id"), F.count("*").alias("requests"))


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("seq_no")).limit(1)


def numbered(runs: DataFrame, first_seq: int, order: str) -> DataFrame:
    """Sequence numbers of the runs of a commit, from the first reserved one."""
    return ordering.ranked(runs, [], [order], "seq_no").withColumn("seq_no", F.col("seq_no") + F.lit(first_seq).cast("long"))
