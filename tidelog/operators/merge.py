"""Merging versions of keys, and reading what is visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import ordering
from tidelog.sources.schema import PUT

#: Bounds of a scan's page.
LEAST_PAGE, LARGEST_PAGE = 1, 10_000
#: Up to so many requested keys become a filter of the scan.
PUSHED_KEYS = 2000


class InvalidArgument(ValueError):
    """A request that can't be planned."""


def latest_wins(ops: DataFrame, by: Sequence[str] = ("table_name", "key"), version: str = "seq_no") -> DataFrame:
    """The row with the greatest version for each key, deletes included.

    One aggregation, combined before its shuffle, so a hot key costs one row a task. The other columns travel in a
    struct, which is never null, so a delete's null value can't uncover an older one.
    """
    rest = [c for c in ops.columns if c not in by and c != version]
    newest = ops.groupBy(*by).agg(F.max_by(F.struct(version, *rest), version).alias("newest"))
    return newest.select(*by, "newest.*").select(*ops.columns)


def first_wins(layers: DataFrame, by: Sequence[str] = ("table_name", "key"), rank: str = "rank") -> DataFrame:
    """The row of the least rank (the most recent layer) for each key."""
    rest = [c for c in layers.columns if c not in by and c != rank]
    return layers.groupBy(*by).agg(F.min_by(F.struct(rank, *rest), rank).alias("nearest")).select(*by, "nearest.*").select(*layers.columns)


def visible(merged: DataFrame) -> DataFrame:
    """Merged rows that are puts; only ever after the merge."""
    return merged.where(F.col("op") == PUT)


def batch_dedup(ops: DataFrame, by: Sequence[str] = ("table_name", "key"), position: Sequence[str] = ("batch_pos", "item_pos")) -> DataFrame:
    """The last write of each key of a batch: by place of the request, then of the item in it."""
    rest = [c for c in ops.columns if c not in by]
    last = ops.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*position)).alias("last"))
    return last.select(*by, "last.*").select(*ops.columns)


#: What only_once says.
TWICE = "a key is there twice, and nothing tells which is the last: "


def only_once(ops: DataFrame, by: Sequence[str] = ("table_name", "key")) -> DataFrame:
    """ops, or an error where a key is there more than once."""
    rest = [c for c in ops.columns if c not in by]
    one = ops.groupBy(*by).agg(F.count("*").alias("n"), F.first(F.struct(*rest)).alias("row"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit(TWICE), F.col("key")))).otherwise(F.col("row"))
    return one.select(*by, checked.alias("row")).select(*by, "row.*").select(*ops.columns)


def requested(ops: DataFrame, requests: DataFrame, by: Sequence[str]) -> DataFrame:
    """The operations on requested keys. Up to PUSHED_KEYS of them become a filter, which reaches the statistics of the
    files where the key is a column of theirs."""
    few = [r["key"] for r in requests.select("key").distinct().limit(PUSHED_KEYS + 1).collect()]
    if len(few) <= PUSHED_KEYS:
        ops = ops.where(F.col("key").isin(few))
    return ops.join(requests.select(*by).distinct(), list(by), "left_semi")


def get_batch(ops: DataFrame, requests: DataFrame, by: Sequence[str] = ("table_name", "key")) -> DataFrame:
    """Visible rows of the requested keys of any number of tables, each once; missing and deleted keys are absent.

    The requests filter the log before the merge. Spark broadcasts them when their size allows.
    """
    return visible(latest_wins(requested(ops, requests, by), by))


def get_states(ops: DataFrame, requests: DataFrame, by: Sequence[str] = ("table_name", "key")) -> DataFrame:
    """Every requested key with its state: found, tombstone or not_found."""
    wanted = requests.select(*by).distinct()
    merged = latest_wins(requested(ops, wanted, by), by)
    state = F.when(F.col("op").isNull(), "not_found").when(F.col("op") == PUT, "found").otherwise("tombstone")
    return wanted.join(merged, list(by), "left").select(*by, state.alias("state"), "value")


def check_page(limit: int) -> int:
    if not LEAST_PAGE <= limit <= LARGEST_PAGE:
        raise InvalidArgument(f"a page has {LEAST_PAGE} to {LARGEST_PAGE} rows, not {limit}")
    return limit


def scan(ops: DataFrame, start: str | None = None, limit: int | None = None, by: Sequence[str] = ("table_name", "key")) -> DataFrame:
    """Visible rows in key order after `start` (exclusive; None: from the first key), at most `limit`.

    The bound filters the log and so reaches the Parquet scan; the limit comes after the merge.
    """
    if start is not None:
        ops = ops.where(F.col("key") > start)
    rows = visible(latest_wins(ops, by)).orderBy("key")
    return rows if limit is None else rows.limit(check_page(limit))


def pages(ops: DataFrame, size: int, by: Sequence[str] = ("table_name", "key")) -> DataFrame:
    """All visible rows with the page of `size` rows that each falls on in its table."""
    check_page(size)
    rows = ordering.ranked(visible(latest_wins(ops, by)), [c for c in by if c != "key"], ["key"], "page")
    return rows.withColumn("page", F.floor(F.col("page") / size))


def run_page(run: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """One run's rows in key order until `limit` puts were seen; deletes don't count and are returned."""
    check_page(limit)
    rows = ordering.summed_before(run, by, ["key"], {"before": (F.col("op") == PUT).cast("long")})
    return rows.where(F.col("before") < limit).drop("before")


def listed_runs(ops: DataFrame, run_ids: Sequence, run: str = "run_id") -> DataFrame:
    """Rows of the named runs only, ranked by the place of their run in the list."""
    place = F.array_position(F.array(*[F.lit(x) for x in run_ids]), F.col(run))
    return ops.where(F.col(run).isin(list(run_ids))).withColumn("rank", place.cast("long"))


def as_of(ops: DataFrame, seq_no: int, version: str = "seq_no", by: Sequence[str] = ("table_name", "key")) -> DataFrame:
    """The merged state at an earlier sequence number."""
    return latest_wins(ops.where(F.col(version) <= seq_no), by, version)


def order_violations(ops: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Rows of each group whose key is not greater than the one before."""
    rows = ordering.last_before(ops.select(*by, position, "key"), by, [position], F.col("key"), "before", own=False)
    return rows.where(F.col("key") <= F.col("before")).groupBy(*by).agg(F.count("*").alias("violations"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
