"""How operations lie in runs: statistics, splits, and which runs a read or a compaction needs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.operators import ordering
from tidelog.sources.schema import DELETE_OVERHEAD, PUT, PUT_OVERHEAD, RUN_OVERHEAD


def op_size(key: str = "key", value: str = "value", op: str = "op") -> Column:
    """Bytes of an operation in the run format."""
    put = F.lit(PUT_OVERHEAD) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return F.when(F.col(op) == PUT, put).otherwise(F.lit(DELETE_OVERHEAD) + F.octet_length(key)).cast("long")


def run_stats(ops: DataFrame, by: Sequence[str]) -> DataFrame:
    """Zone map of each run: least and greatest key, bytes, puts, deletes."""
    put = F.col("op") == PUT
    return ops.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), (F.sum(op_size()) + RUN_OVERHEAD).alias("size_bytes"),
        F.sum(put.cast("long")).alias("put_count"), F.sum((~put).cast("long")).alias("delete_count"),
    )


def split_points(sizes: list[int], most: int, run: int = 0, held: int = 0) -> tuple[list[int], int, int]:
    """Run number of each operation under the greedy rule, with the run and bytes held at the end: a new run opens when
    the next operation would take a run that holds something over `most`; one larger than that still gets its run."""
    out = []
    for size in sizes:
        if held and held + size > most:
            run, held = run + 1, 0
        held = held + size if held else RUN_OVERHEAD + size
        out.append(run)
    return out, run, held


def split_sized(ops: DataFrame, most: int, by: Sequence[str], order: str = "key", size: str = "size") -> DataFrame:
    """ops, whose `size` column has the bytes of each operation, with `run`, the number of the run of at most `most`
    bytes that it falls in, group by group.

    The rule is sequential, but two splits that start apart soon meet in a common end of a run. So each range of a group
    is split as if a run began there, in parallel; then again with what the range before it left, until nothing changes,
    which takes two or three rounds (at most as many as a group has ranges). A range is streamed by one task with two
    numbers of state; the driver holds a few numbers for each range of groups that have several.
    """
    by = list(by)
    rows = ordering.spread(ops, by, [order])
    keys = [*by, ordering.BUCKET]
    narrow = rows.select(*keys, F.col(order).alias("_order"), F.col(size).alias("_size"))
    several = narrow.select(*keys).distinct().groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(ordering.BUCKET)).alias("buckets")).where("n > 1").collect()
    chains = [[(*[r[c] for c in by], x) for x in r["buckets"]] for r in several]
    left: dict[tuple, tuple[int, int]] = {}  # run and bytes at the start of each range but the first
    if chains:
        wanted = narrow.join(F.broadcast(rows.sparkSession.createDataFrame([k for c in chains for k in c], StructType([rows.schema[c] for c in keys]))), keys, "left_semi")
        wanted = wanted.repartition(*keys).sortWithinPartitions(*keys, "_order")
        fields = [f for f in rows.schema.fields if f.name in keys]
        while True:
            ends = wanted.mapInPandas(_ends(keys, {k: held for k, (_, held) in left.items()}, most), StructType([*sorted(fields, key=lambda f: keys.index(f.name)), StructField("runs", LongType()), StructField("held", LongType())]))
            found = {tuple(r[c] for c in keys): (r["runs"], r["held"]) for r in ends.collect()}
            now: dict[tuple, tuple[int, int]] = {}
            for chain in chains:
                run = 0
                for before, k in zip(chain, chain[1:]):
                    run += found[before][0]
                    now[k] = (run, found[before][1])
            same = {k: v[1] for k, v in now.items()} == {k: v[1] for k, v in left.items()}
            left = now
            if same:
                break
    schema = StructType([*rows.schema.fields, StructField("run", LongType())])
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInPandas(_numbered(keys, left, most, size), schema).drop(ordering.BUCKET)


def _chunks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, int, pd.DataFrame]]:
    """Parts of frames that belong to one range: its key, how many parts of it came before, and the part."""
    last, n = None, 0
    for f in frames:
        each = list(zip(*[f[c] for c in keys]))
        at = 0
        while at < len(f):
            end = at + 1
            while end < len(f) and each[end] == each[at]:
                end += 1
            n = n + 1 if each[at] == last else 0
            last = each[at]
            yield last, n, f.iloc[at:end]
            at = end


def _ends(keys: list[str], held_before: dict[tuple, int], most: int):
    """Of each range: how many runs it opens besides the one it starts in, and the bytes held at its end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (0, 0)
        for key, n, f in _chunks(frames, keys):
            if not n:
                if now is not None:
                    yield pd.DataFrame([(*now, *state)], columns=[*keys, "runs", "held"])
                now, state = key, (0, held_before.get(key, 0))
            _, *state = split_points(f["_size"].tolist(), most, *state)
        if now is not None:
            yield pd.DataFrame([(*now, *state)], columns=[*keys, "runs", "held"])

    return run


def _numbered(keys: list[str], left: dict[tuple, tuple[int, int]], most: int, size: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = (0, 0)
        for key, n, f in _chunks(frames, keys):
            if not n:
                state = left.get(key, (0, 0))
            runs, *state = split_points(f[size].tolist(), most, *state)
            yield f.assign(run=runs)

    return run


def split_runs(ops: DataFrame, most: int, by: Sequence[str], order: str = "key") -> DataFrame:
    """ops with `run`, by the bytes that each operation takes in the run format."""
    return split_sized(ops.withColumn("_size", op_size()), most, by, order, "_size").drop("_size")


def floor_route(keys: DataFrame, runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each key the run with the greatest min_key that is not above it; keys below all runs are absent.

    The floor is the last start along the union of keys and starts, so it needs one sort and no inequality join.
    """
    by = list(by)
    starts = runs.select(*by, F.col("min_key").alias("key"), F.struct("min_key", "run_id").alias("start"), F.lit(0).alias("side"))
    asked = keys.select(*by, "key", F.lit(None).cast(starts.schema["start"].dataType).alias("start"), F.lit(1).alias("side"))
    both = ordering.last_before(starts.unionByName(asked), by, ["key", "side"], F.col("start"), "floor", own=True)
    return both.where("side = 1 and floor is not null").select(*by, "key", "floor.run_id", "floor.min_key")


def overlapping(upper: DataFrame, lower: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of upper and lower runs whose key ranges meet, ends included. Both are manifests, a row for each run."""
    a = upper.select(*[F.col(c).alias(f"u_{c}") for c in by], F.col("run_id").alias("upper_run"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"))
    b = lower.select(*by, F.col("run_id").alias("lower_run"), "min_key", "max_key")
    on = [F.col(f"u_{c}") == F.col(c) for c in by] + [F.col("min_key") <= F.col("a_max"), F.col("max_key") >= F.col("a_min")]
    return a.join(b, on).select(*by, "upper_run", "lower_run")


def prune_runs(runs: DataFrame, start: str) -> DataFrame:
    """Runs that may hold a key after `start`."""
    return runs.where(F.col("max_key") > start)


def put_budget(runs: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """Runs in key order until their puts pass `most`; the one that crosses is included."""
    before = Window.partitionBy(*by).orderBy("min_key", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("before", F.coalesce(F.sum("put_count").over(before), F.lit(0))).where(F.col("before") <= most).drop("before")


def oldest(runs: DataFrame, most: int = 16) -> DataFrame:
    """The first runs by sequence number."""
    return runs.orderBy("seq_no", "run_id").limit(most)


def hash_ring(keys: DataFrame, nodes: Sequence[str], key: str = "key", points: int = 4) -> DataFrame:
    """The node of each key on a ring with several points a node: the next point at or after the key's hash, else the
    first one. The ring is a row for each point."""
    spark = keys.sparkSession
    ring = spark.createDataFrame([(n, i) for n in nodes for i in range(points)], "node string, i int")
    ring = ring.select("node", F.md5(F.concat_ws("#", "node", F.col("i").cast("string"))).alias("at"))
    table = F.broadcast(ring.agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("ring")))
    after = F.filter("ring", lambda p: p["at"] >= F.md5(F.col(key)))
    return keys.join(table).select(*keys.columns, F.coalesce(F.get(after, F.lit(0)), F.get("ring", F.lit(0)))["node"].alias("node"))
