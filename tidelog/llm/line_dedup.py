"""Line deduplication over overlapping windows of three lines, with DataFrame functions only.

Each line is hashed to 128 bits, each three consecutive lines to a 128-bit window. Windows are grouped over the
whole corpus; in a group of two or more all but the first, by (doc_id, line), are repeats, and the lines under them
are covered. Covered positions of a document are merged into spans and the text is rebuilt from the gaps. By
induction over the order a removed line has an equal line earlier that stays.

A window that a third of all rows share is combined before the shuffle; the join back to its occurrences is a
sort-merge join whose large partitions adaptive execution splits. Texts stay where they are while the spans are few
enough to broadcast; beyond that they are dealt once, by doc_id.

Defined cases: null text stays null with 0 lines; texts under three lines stay as they are; three empty lines are no
window; rows with equal doc_id and equal text are one document and come out alike; ties have no effect as positions
differ; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

LINES = 3
#: Documents with spans, and spans, of some 40 bytes each, that are broadcast.
BROADCAST = 300_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_ld_id", F.col("doc_id").cast("long")).withColumn("_ld_th", F.xxhash64("text"))


def windows(docs: DataFrame) -> DataFrame:
    """_ld_id, _ld_th, pos, h1, h2: a row for each window of three lines that are not all empty."""
    lines = F.split("text", "\n", -1)
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(LINES), x).alias("b"), F.length(x).alias("n")))
    each = docs.where(F.col("text").isNotNull()).select("_ld_id", "_ld_th", hashed.alias("h"))
    n = F.size("h")
    each = each.where(n >= LINES).select("_ld_id", "_ld_th", F.posexplode(F.arrays_zip(*[F.slice("h", i + 1, n - LINES + 1).alias(f"l{i}") for i in range(LINES)])).alias("pos", "w"))
    parts = [f"w.l{i}" for i in range(LINES)]
    each = each.where(sum((F.col(f"{p}.n") for p in parts), F.lit(0)) > 0)
    return each.select("_ld_id", "_ld_th", F.col("pos").cast("long").alias("pos"), F.xxhash64(*[f"{p}.a" for p in parts]).alias("h1"), F.xxhash64(*[f"{p}.b" for p in parts]).alias("h2"))


def covered_spans(found: DataFrame) -> DataFrame:
    """_ld_id, _ld_th, _ld_spans: ordered, disjoint and non-touching spans of covered lines of each document that has any."""
    # a group's first window, as three minima in turn would need three passes: the struct is compared field by field
    groups = found.groupBy("h1", "h2").agg(F.min(F.struct("_ld_id", "_ld_th", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = found.join(groups, ["h1", "h2"]).where(F.struct("_ld_id", "_ld_th", "pos") != F.col("first")).select("_ld_id", "_ld_th", "pos").distinct()
    order = Window.partitionBy("_ld_id", "_ld_th").orderBy("pos")
    later = later.withColumn("opens", F.when(F.col("pos") > F.coalesce(F.lag("pos").over(order), F.lit(-LINES - 1)) + LINES, 1).otherwise(0))
    later = later.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = later.groupBy("_ld_id", "_ld_th", "span").agg(F.min("pos").alias("first"), (F.max("pos") + LINES - 1).alias("last"))
    return spans.groupBy("_ld_id", "_ld_th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_ld_spans"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text rebuilt without its covered lines, and n_lines and n_removed (lines) as long."""
    spans = common.materialise(covered_spans(windows(_keyed(docs))).withColumnsRenamed({"_ld_id": "_ld_sid", "_ld_th": "_ld_sth"}), "spans")
    if (spans.agg(F.count("*") + F.coalesce(F.sum(F.size("_ld_spans")), F.lit(0))).first()[0]) <= BROADCAST:
        spans = F.broadcast(spans)
    lines = _keyed(docs).withColumn("_ld_lines", F.split("text", "\n", -1)).drop("text")
    out = lines.join(spans, F.col("_ld_id").eqNullSafe(F.col("_ld_sid")) & (F.col("_ld_th") == F.col("_ld_sth")), "left").drop("_ld_sid", "_ld_sth")
    n = F.coalesce(F.size("_ld_lines"), F.lit(0)).cast("long")
    lasts = F.concat(F.array(F.lit(-1).cast("long")), F.col("_ld_spans.last"))
    firsts = F.concat(F.col("_ld_spans.first"), F.array(F.size("_ld_lines").cast("long")))
    kept = F.flatten(F.transform(F.arrays_zip(lasts.alias("z"), firsts.alias("a")), lambda g: F.slice(F.col("_ld_lines"), (g["z"] + 2).cast("int"), (g["a"] - g["z"] - 1).cast("int"))))
    removed = F.aggregate(F.col("_ld_spans"), F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    out = out.withColumn("text", F.array_join(F.when(F.col("_ld_spans").isNull(), F.col("_ld_lines")).otherwise(kept), "\n"))
    out = out.withColumn("n_lines", F.when(F.col("_ld_lines").isNull(), F.lit(0).cast("long")).otherwise(n)).withColumn("n_removed", F.coalesce(removed, F.lit(0).cast("long")))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
