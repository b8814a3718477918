"""Mixing sources to target weights, with DataFrame functions only.

Sizes (words) are summed by source, targets follow from the weights, and each document is emitted floor(rate) times,
rate = target / source size, plus once more where a hash of its doc_id and the seed falls below the rate's fraction.

The hot source costs nothing extra: sums are combined before the shuffle, and the table of sources (a row for each)
is written out, so Spark knows its size and broadcasts it only below spark.sql.autoBroadcastJoinThreshold; beyond
that the join is dealt by source and adaptive execution splits the hot one. Sources, which may be many, are ranked and
summed along their order by ranges.

Defined cases: null text has size 0; null is a source of its own, last in order; a source of size 0 has target 0 and
its documents are taken 0 times; repeated rows draw alike, as they share doc_id; a null doc_id draws by the text
`null`; other columns pass through, those named like the results are replaced; no documents give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.operators import ordering

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. Targets share the total by weight, none above cap times its source's size.

    Resharing the excess until none is above ends where each target is min(cap * size, level * weight): with the
    sources by cap * size / weight, the level is that of the first source from which the rest can be met.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = ordering.ranked(by_source, [], ["last", "source"], "at")
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    rows = ordering.summed_before(rows, [], ["ratio", "last", "source"], {"capped": F.col("most"), "weight_before": F.col("weight")})
    whole = rows.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weight"))
    rows = common.materialise(rows.join(F.broadcast(whole)), "levels")  # one row
    level = (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("weight_before"))
    first = rows.agg(F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level"))))["level"].alias("level"))
    met = F.col("level").isNull() | (F.col("most") <= F.col("level") * F.col("weight"))
    rows = rows.join(F.broadcast(first))  # one row
    return rows.select("source", "source_size", F.when(met, F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def draw(doc_id: F.Column, seed: str) -> F.Column:
    """A number in [0, 1) from 52 bits of a hash."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document)."""
    return mix_sized(sizes(docs.drop("size")), weights, cap, seed)


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The same of documents whose sizes are there; texts are not needed."""
    sized = sized.drop("source_size", "target", "copies", "copy")
    targets = common.materialise(source_targets(sized.select("source", "size"), weights, cap), "targets").withColumnRenamed("source", "_mix_source")
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn("copies", whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as `copies` says."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
