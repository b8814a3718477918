"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.shipping import ship
from tidelog.sources.scratch import discard  # noqa: F401  (part of what operators use)
from tidelog.sources.scratch import written as materialise

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Free memory goes back to the system. A worker lives through many tasks, and its allocators keep what the largest
    of them took, beside an executor whose memory grows too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, TypeError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in workers that find this package, and that give their memory back at the end of a task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def blobs(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in one column, so that work buffers stay small."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], n]):
        yield batch.slice(int(a), int(b - a))


def lower_ascii(text: F.Column) -> F.Column:
    return F.translate(text, UPPER, LOWER)


def empty_for_null(text: F.Column) -> F.Column:
    return F.coalesce(text, F.lit(""))


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTE_VALUE = _byte_values()
#: White space of WORD.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the polynomial base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = self._grow(_BASE, size), self._grow(_BASE_INV, size)
        return self.up, self.down


POWERS = _Powers()


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text after lower-casing A-Z, with their byte starts and ends.

    Each word is a polynomial over random byte values modulo 2^64, taken from prefix sums, then finalised.
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~IS_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    up, down = POWERS.get(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[LOWERED[raw]] * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = POWERS.get(len(words) + 1)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[k:] - sums[:n]) * down[:n])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
        if cut or (held and held[-1].column(b.schema.get_field_index(key))[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)]) if cut else pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b), by alternating large and
    small stars until nothing changes. Each step is an aggregation and a join on it, so a hub's edges may be split over
    tasks."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mark, seen = None, ()
    while mark != seen:
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        before, now = now, materialise(small, "stars")
        if mark is not None:  # the first table is read again at the end
            discard(before)
        mark, seen = seen, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    return nodes.join(now.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
