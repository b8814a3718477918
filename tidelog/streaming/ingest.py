"""Streams into the store and over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.sources.schema import PUT
from tidelog.sources.store import Store

#: How long the writer gathers operations before a commit.
FLUSH = "250 milliseconds"


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Writes a stream of table_name, key, op, value and pos as commits, in order; a micro-batch that is run again bears
    the same tags and is written once.

    A micro-batch is one commit up to the setting flush_ops, else several of about so many operations, with all of a key
    in one. The source's own limits (maxFilesPerTrigger and the like) hold back what the writer can't take.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            n = -(-batch.count() // store.settings().flush_ops)
            if n == 1:
                store.write_batch(batch, tag=(name, batch_id))
            for i in range(n if n > 1 else 0):
                store.write_batch(batch.where(F.pmod(F.xxhash64("table_name", "key"), F.lit(n)) == i), tag=(f"{name}/{i}", batch_id))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"processingTime": FLUSH})).start()


def changelog_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Changelog entries as they are committed, as (id, kind, json)."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).option("wholetext", True).text(f"{root.rstrip('/')}/changelog")
    return lines.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.kind").alias("kind"), F.col("value").alias("json"))


def live_runs_stream(changelog: DataFrame) -> DataFrame:
    """run_id and added_at of the live runs, kept up to date with changelog_stream; state grows with the runs."""
    added = F.transform(F.from_json(F.get_json_object("json", "$.runs_added"), "array<struct<run_id:string>>"), lambda r: F.struct(r["run_id"].alias("run_id"), F.lit(False).alias("gone")))
    removed = F.transform(F.from_json(F.get_json_object("json", "$.runs_removed"), "array<string>"), lambda r: F.struct(r.alias("run_id"), F.lit(True).alias("gone")))
    each = changelog.select("id", F.explode(F.concat(added, removed)).alias("run"))
    last = each.groupBy("run.run_id").agg(F.max(F.struct("id", "run.gone")).alias("last"))
    return last.where("not last.gone").select("run_id", F.col("last.id").alias("added_at"))


def latest_state(stream: DataFrame) -> DataFrame:
    """The newest operation of each key of a stream of table_name, key, seq_no, op, value. State grows with the keys,
    deletes included, as a late older put must not come back."""
    newest = stream.groupBy("table_name", "key").agg(F.max(F.struct("seq_no", "op", "value")).alias("newest"))
    return newest.select("table_name", "key", "newest.*")


def visible_state(stream: DataFrame) -> DataFrame:
    return latest_state(stream).where(F.col("op") == PUT)
