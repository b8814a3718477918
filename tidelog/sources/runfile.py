"""The run file: a version byte, then operations in key order, each a marker, a key and, for puts, a value.

Lengths are four bytes, big-endian. Spark keeps runs as Parquet; this is for bringing run files in and giving them out.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import layout
from tidelog.sources.schema import DELETE, DELETE_OVERHEAD, PUT, PUT_OVERHEAD, RUN_OVERHEAD

# Fixed values of the format.
VERSION, PUT_MARK, DELETE_MARK = 1, 1, 2


class BadRun(ValueError):
    """A run that breaks the format."""


def encode_runs(ops: Iterable[tuple[str, bytes | None]], most: int) -> Iterator[tuple[bytes, dict]]:
    """Run files of at most `most` bytes from (key, value) in strictly increasing order of keys, None for a delete, with
    the statistics of each."""
    body, stats, before = bytearray([VERSION]), None, None
    for key, value in ops:
        k = key.encode()
        if before is not None and k <= before:
            raise BadRun(f"keys must increase strictly: {key!r}")
        before = k
        size = PUT_OVERHEAD + len(k) + len(value) if value is not None else DELETE_OVERHEAD + len(k)
        if stats and len(body) + size > most:
            yield bytes(body), stats | {"size_bytes": len(body)}
            body, stats = bytearray([VERSION]), None
        stats = stats or {"min_key": key, "put_count": 0, "delete_count": 0}
        stats["max_key"] = key
        if value is None:
            body += struct.pack(">BI", DELETE_MARK, len(k)) + k
            stats["delete_count"] += 1
        else:
            body += struct.pack(">BI", PUT_MARK, len(k)) + k + struct.pack(">I", len(value)) + value
            stats["put_count"] += 1
    if stats:
        yield bytes(body), stats | {"size_bytes": len(body)}


def decode_run(data: bytes) -> Iterator[tuple[str, bytes | None]]:
    """(key, value) of each operation, None for a delete."""
    if not data:
        raise BadRun("a run file is empty")
    if data[0] != VERSION:
        raise BadRun(f"version {data[0]} of run files is not known")
    at = RUN_OVERHEAD

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise BadRun("a run file ends within an operation")
        at += n
        return data[at - n : at]

    while at < len(data):
        mark = take(1)[0]
        if mark not in (PUT_MARK, DELETE_MARK):
            raise BadRun(f"marker {mark} is not known")
        try:
            key = take(struct.unpack(">I", take(4))[0]).decode()
        except UnicodeDecodeError as e:
            raise BadRun("a key is not UTF-8") from e
        yield key, take(struct.unpack(">I", take(4))[0]) if mark == PUT_MARK else None


def search_run(data: bytes, key: str) -> tuple[str, bytes | None]:
    """found with the value, tombstone or not_found; keys are in order, so the search ends at the first greater one."""
    k = key.encode()
    for other, value in decode_run(data):
        o = other.encode()
        if o == k:
            return ("tombstone" if value is None else "found"), value
        if o > k:
            break
    return "not_found", None


def read_run_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, key, op and value of every operation of run files; a row of a file is a task's unit, as runs are small."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"]):
                ops = list(decode_run(bytes(data)))
                yield pd.DataFrame({"path": path, "key": [k for k, _ in ops], "op": [DELETE if v is None else PUT for _, v in ops], "value": [v for _, v in ops]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, key string, op string, value binary")


def to_run_files(ops: DataFrame, most: int, by: str = "table_id") -> DataFrame:
    """Run files of merged operations (by, key, op, value): by, run, min_key, max_key, size_bytes, put_count,
    delete_count and data. Operations are numbered by run first, over ranges of a group, so each run is encoded by
    itself and a task holds one run at a time."""
    kind = ops.schema[by].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for f in frames:
                yield from zip(f[by], f["run"], f["key"], f["op"], f["value"])

        every = rows()
        row = next(every, None)
        while row is not None:
            group, number = row[:2]

            def same() -> Iterator[tuple[str, bytes | None]]:
                nonlocal row
                while row is not None and row[:2] == (group, number):
                    yield row[2], (bytes(row[4]) if row[4] is not None else b"") if row[3] == PUT else None
                    row = next(every, None)

            # the run's operations fit it already
            for data, stats in encode_runs(same(), sys.maxsize):
                yield pd.DataFrame([{by: group, "run": number, **stats, "data": data}])

    binary = ops.select(by, "key", "op", F.col("value").cast("binary").alias("value"))
    numbered = layout.split_runs(binary, most, [by]).repartition(by, "run").sortWithinPartitions(by, "run", "key")
    return numbered.mapInPandas(run, f"{by} {kind}, run long, min_key string, max_key string, size_bytes long, put_count long, delete_count long, data binary")
