"""Operations along an order that spread a large group over tasks.

Rows are dealt by ranges of (group, order) and written once, so that every later step sees the same ranges. Within a
range a window does the work; what it needs of the ranges before is a row for each group and range, far fewer rows than
there are, which are folded by a window and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelog.sources.scratch import written

BUCKET = "_bucket"


def spread(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _bucket, the number of the range of (by, order) that a row falls in."""
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return written(ranged.withColumn(BUCKET, F.spark_partition_id()), "ranges")


def within(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of a group in one range, in order."""
    return Window.partitionBy(*by, BUCKET).orderBy(*order)


def carried(rows: DataFrame, by: Sequence[str], summaries: dict[str, Column], fold: str) -> DataFrame:
    """rows with the summaries of each range before, folded over the ranges of the group ("sum" of numbers, or "last"
    that isn't null); null in the first range."""
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*by, BUCKET).agg(*[x.alias(n) for n, x in summaries.items()])
    folded = [(F.sum(n) if fold == "sum" else F.last(n, ignorenulls=True)).over(before).alias(n) for n in summaries]
    each = each.select(*[F.col(c).alias(f"_c_{c}") for c in (*by, BUCKET)], *folded)
    on = F.lit(True)
    for c in (*by, BUCKET):
        on = on & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return rows.join(each, on).drop(*[f"_c_{c}" for c in (*by, BUCKET)])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the place of each row in its group, from 0."""
    rows = carried(spread(df, by, order), by, {"_carried": F.count("*")}, "sum")
    at = F.row_number().over(within(by, order)) - 1 + F.coalesce("_carried", F.lit(0))
    return rows.withColumn(name, at.cast("long")).drop(BUCKET, "_carried")


def summed_before(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """df with the sums of values over the rows before in the group, 0 for the first."""
    held = spread(df.withColumns({f"_v_{n}": v for n, v in values.items()}), by, order)
    rows = carried(held, by, {f"_s_{n}": F.sum(f"_v_{n}") for n in values}, "sum")
    before = within(by, order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) + F.coalesce(f"_s_{n}", F.lit(0)) for n in values}
    return rows.withColumns(sums).drop(BUCKET, *[f"_{k}_{n}" for n in values for k in "vs"])


def last_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, own: bool) -> DataFrame:
    """df with the last value that isn't null among the rows before in the group, with own that of the row itself first."""
    rows = spread(df.withColumn("_value", value), by, order)
    summary = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    rows = carried(rows, by, {"_carried": summary}, "last")
    near = F.last("_value", ignorenulls=True).over(within(by, order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    return rows.withColumn(name, F.coalesce(near, "_carried")).drop(BUCKET, "_carried", "_value")
