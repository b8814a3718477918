"""Exact deduplication through content-defined chunk recipes.

Texts are lower-cased (A-Z only) and cut where a rolling hash of the last 16 bytes meets a mask, so equal texts
are cut alike wherever they stand. A chunk's identifier is a 64-bit hash; the identifiers are verified over the
whole corpus by grouping the chunks on it and comparing their SHA-256 digests and lengths. A document whose recipe
holds an identifier that failed (two contents, one hash) is compared by the digests instead. Two texts are equal
when their ordered lists are. No text is shuffled: a document moves as a list of 8 bytes for every 4 KB or so.

Defined cases: null text counts as empty; empty texts are equal to each other; repeated rows count as members of
their group, and if the largest doc_id is repeated, each of those rows is kept; a null doc_id counts in group_size
and is kept only in a group without any doc_id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

LEAST, MASK, MOST = 1024, np.uint32(0xFFF << 4), 16384


def _gear() -> np.ndarray:
    return (common.mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text; chunks hold 1 to 16 KB but for the last."""
    n = len(text)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h = g
    found = np.flatnonzero((h & MASK) == 0) + 1
    ends, at, i = [], 0, 0
    while n - at > LEAST:
        i = int(np.searchsorted(found, at + LEAST))
        end = min(int(found[i]) if i < len(found) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.small_batches(whole, 1):
            ids, shas, digests = [], [], []
            for text in common.blobs(batch.column(1)):
                text = text.lower()  # of bytes: A-Z only
                at, a, b = 0, [], []
                for end in cut_points(text):
                    chunk = text[at:end]
                    a.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                    b.append(hashlib.sha256(chunk).digest())
                    at = end
                ids.append(a)
                shas.append(b)
                digests.append(hashlib.sha256(text).hexdigest() if len(b) > 1 else b[0].hex())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(shas, pa.list_(pa.binary())), pa.array(digests, pa.string())], ["doc_id", "ids", "digests", "text_sha256"])


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, ids (identifier of each chunk in order), digests, text_sha256."""
    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _recipes, "doc_id long, ids array<long>, digests array<binary>, text_sha256 string")


def failed_identifiers(rec: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content."""
    chunks = rec.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select("c.ids", "c.digests")
    return chunks.groupBy("ids").agg(F.min("digests").alias("a"), F.max("digests").alias("b")).where("a != b").select("ids")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: a row per row of docs."""
    rec = common.materialise(recipes(docs), "recipes")
    failed = common.materialise(failed_identifiers(rec), "failed")
    if failed.isEmpty():
        rec = rec.select("doc_id", "text_sha256", "ids", F.lit(None).cast("array<binary>").alias("proof"))
    else:  # the recipes that hold such an identifier carry their digests as well
        bad = rec.select("text_sha256", F.explode("ids").alias("ids")).join(failed, "ids", "left_semi").select("text_sha256").distinct()
        rec = rec.join(bad.withColumn("bad", F.lit(True)), "text_sha256", "left").select("doc_id", "text_sha256", "ids", F.when(F.col("bad"), F.col("digests")).alias("proof"))
    groups = rec.groupBy("ids", "proof").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumnsRenamed({"ids": "g_ids", "proof": "g_proof"})
    out = rec.join(groups, (F.col("ids") == F.col("g_ids")) & F.col("proof").eqNullSafe(F.col("g_proof")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("ids").cast("long").alias("n_chunks"))
