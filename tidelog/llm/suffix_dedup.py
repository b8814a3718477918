"""Repeated passages by sparse suffix arrays over words.

Suffixes are kept only at minimisers: the positions whose eight-word hash is least in some SPAN consecutive ones. Any
LEAST-word passage determines the minimiser of its first SPAN positions, so two copies keep the same suffix, which
shares at least LEAST - SPAN + 1 words to the right with its copy. Suffixes are first met by a hash of that many words
(counted over the corpus, so those that no other document shares go at once), then sorted by their words; neighbours
give the lengths of common prefixes, runs of suffixes that share enough to the right are extended to the left word by
word, and each extension that reaches LEAST words in two documents marks that window. Windows of a document merge into
maximal spans.

A suffix moves as two numbers; only documents with a shared suffix are read again, for the words around it. A key that
more than HOT suffixes share is not sorted in one task: its windows are hashed and counted by Spark instead, which
finds the same windows; while such keys are few enough to broadcast, their suffixes are not dealt by key at all.

Defined cases: null text counts as empty; texts under LEAST words have no span; a passage that repeats only within one
document is no match; rows with equal doc_id and text are one document and give one result; in `removable` the copy in
the least (doc_id, hash of text) stays; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

LEAST, SPAN, GRAM = 50, 24, 8
RIGHT = LEAST - SPAN + 1
HOT = 20_000
#: Hot keys that are broadcast (eight bytes each).
BROADCAST = 200_000


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions that are least, the leftmost of equals, among SPAN positions that start a LEAST-word window."""
    starts = len(words) - LEAST + 1
    if starts <= 0:
        return np.empty(0, np.int64)
    v = common.run_hashes(words, GRAM)
    low = np.uint64((1 << 24) - 1)
    m = (v & ~low) | (np.arange(len(v), dtype=np.uint64) & low)
    at = 1
    while 2 * at <= SPAN:
        m = np.minimum(m[:-at], m[at:])
        at *= 2
    if at < SPAN:
        m = np.minimum(m[: len(m) - (SPAN - at)], m[SPAN - at :])
    m = m[:starts]
    s = np.arange(starts)
    return np.unique(s + (((m & low).astype(np.int64) - s) & int(low)))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.small_batches(whole, 1):
            ids, places, keys = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), common.blobs(b.column(1))):
                words, _, _ = common.word_hashes(text)
                p = minimisers(words)
                if len(p):
                    ids.append(np.full(len(p), doc))
                    places.append(p.astype(np.int32))
                    keys.append(common.run_hashes(words, RIGHT)[p].view(np.int64))
            cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(cat(ids, np.int64), pa.int64()), pa.array(cat(places, np.int32), pa.int32()), pa.array(cat(keys, np.int64), pa.int64())], ["doc", "pos", "key"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, doc_id, text, cold, hot): for each cold position its key and 32-bit hashes of SPAN - 1 words to the
    left (nearest first) and LEAST to the right, 0 beyond the text; for each hot one the windows that it stands for,
    as rows of their hash (key) and start (pos) without words."""
    for whole in batches:
        for b in common.small_batches(whole, 2, 2 << 20):
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, doc_id, text, cold, hot in zip(*[b.column(i).to_pylist() for i in (0, 1)], common.blobs(b.column(2)), *[b.column(i).to_pylist() for i in (3, 4)]):
                words, _, _ = common.word_hashes(text)
                n = len(words)
                short = np.concatenate([np.zeros(SPAN - 1, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(LEAST, np.uint32)])
                p = np.array(sorted(cold), np.int64)
                if len(p):
                    keys = common.run_hashes(words, RIGHT)[p].view(np.int64)
                    around = short[p[:, None] + np.r_[np.arange(SPAN - 2, -1, -1), np.arange(SPAN - 1, SPAN - 1 + LEAST)][None, :]]
                    for c, v in zip(cols, (keys.tolist(), p.tolist(), [row.tobytes() for row in around], (n - p).tolist(), [doc] * len(p), [doc_id] * len(p))):
                        c += v
                if hot:
                    q = np.array(sorted(hot), np.int64)
                    s = np.unique((q[:, None] - np.arange(SPAN)[None, :]).ravel())
                    s = s[(s >= 0) & (s <= n - LEAST)]
                    hashes = common.run_hashes(words, LEAST)[s].view(np.int64)
                    for c, v in zip(cols, (hashes.tolist(), s.tolist(), [None] * len(s), [0] * len(s), [doc] * len(s), [doc_id] * len(s))):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], ["key", "pos", "around", "rest", "doc", "doc_id"])


def _sort_and_extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole keys: spans of repeated windows (doc, doc_id, start, end, later)."""
    for t in common.whole_groups(batches, "key"):
        key, pos, rest, doc = (t.column(c).to_numpy() for c in ("key", "pos", "rest", "doc"))
        doc_id = t.column("doc_id").combine_chunks()
        order_id = np.where(doc_id.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, doc_id.fill_null(0).to_numpy(zero_copy_only=False))
        around = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint32).reshape(len(key), SPAN - 1 + LEAST)
        left, right = around[:, : SPAN - 1], around[:, SPAN - 1 :]
        # the suffix array of these suffixes: by key, then by the words after those that the key stands for
        tail = np.ascontiguousarray(right[:, RIGHT:].astype(">u4")).view(f"V{4 * (LEAST - RIGHT)}").ravel()
        _, tail = np.unique(tail, return_inverse=True)
        suffix = np.lexsort((tail, key))
        key, pos, rest, doc, order_id, left, right = key[suffix], pos[suffix], rest[suffix], doc[suffix], order_id[suffix], left[suffix], right[suffix]
        doc_id = doc_id.take(pa.array(suffix))
        same = right[1:] == right[:-1]
        common_right = np.where(same.all(axis=1), LEAST, np.argmin(same, axis=1)) * (key[1:] == key[:-1])
        ranked = np.lexsort((doc, order_id))
        rank = np.empty(len(doc), np.int64)
        rank[ranked] = np.cumsum(np.r_[0, (np.diff(order_id[ranked]) != 0) | (np.diff(doc[ranked]) != 0)])
        lefts = np.zeros(len(key), np.uint64)
        repeated, later = np.zeros((len(key), SPAN + 2), bool), np.zeros((len(key), SPAN + 2), bool)
        for j in range(SPAN):
            if j:
                lefts = common.mix64(lefts * np.uint64(0x9E3779B97F4A7C15) + left[:, j - 1] + np.uint64(1))
            ok = np.flatnonzero((pos >= j) & (rest >= LEAST - j))
            if len(ok) < 2:
                continue
            run = np.cumsum(np.r_[0, common_right < LEAST - j])[ok]
            by = np.lexsort((rank[ok], lefts[ok], run))
            r, h, k = run[by], lefts[ok][by], rank[ok][by]
            starts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
            ends = np.r_[starts[1:], len(r)]
            size = ends - starts
            first, last = np.repeat(k[starts], size), np.repeat(k[ends - 1], size)
            repeated[ok[by], j + 1] = first != last
            later[ok[by], j + 1] = k != first
        rows, lo, hi, kind = [], [], [], []
        for flag, marks in ((False, repeated), (True, later)):
            step = np.diff(marks.astype(np.int8), axis=1)
            a, b = np.nonzero(step == 1), np.nonzero(step == -1)
            rows.append(a[0])
            lo.append(pos[a[0]] - (b[1] - 1))
            hi.append(pos[a[0]] - a[1] + LEAST)
            kind.append(np.full(len(a[0]), flag))
        rows = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), doc_id.take(pa.array(rows)), pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32)), pa.array(np.concatenate(kind))], ["doc", "doc_id", "start", "end", "later"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole documents sorted by doc and start: their maximal spans, with the words of each that are later copies."""
    for t in common.whole_groups(batches, "doc"):
        doc, start, end, later = (t.column(c).to_numpy() for c in ("doc", "start", "end", "later"))
        bounds = common.group_bounds(doc)
        rows, lo, hi, gone, copies = [], [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            spans: tuple[list, list] = ([], [])
            for s, e, k in zip(start[a:b].tolist(), end[a:b].tolist(), later[a:b].tolist()):
                held = spans[k]
                if held and s <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], e)
                else:
                    held.append([s, e])
            i = 0
            for s, e in spans[0]:
                later_ones = []
                while i < len(spans[1]) and spans[1][i][0] < e:
                    later_ones.append({"start_word": spans[1][i][0], "end_word": spans[1][i][1]})
                    i += 1
                for c, v in zip((rows, lo, hi, gone, copies), (a, s, e, sum(x["end_word"] - x["start_word"] for x in later_ones), later_ones)):
                    c.append(v)
        held = [t.column(c).combine_chunks().take(pa.array(rows, pa.int64())) for c in ("doc", "doc_id")]
        yield pa.RecordBatch.from_arrays([*held, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(gone, pa.int64()), pa.array(copies, _SPANS)], ["doc", "doc_id", "start_word", "end_word", "removable", "later_copies"])


_SPANS = pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64())]))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, removable and later_copies: the maximal spans (in words, the end exclusive) whose
    every LEAST consecutive words stand in some other document too, how many words of each are copies of an earlier
    document, and where these are."""
    return _passages(docs).drop("doc")


def _passages(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    suffixes = common.materialise(common.map_arrow(rows.select("doc", "text"), _suffixes, "doc long, pos int, key long"), "suffixes")
    keys = suffixes.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("p"), F.max("doc").alias("q")).where("p != q").select("key", (F.col("n") > HOT).alias("hot"))
    keys = common.materialise(keys, "keys")
    hot_keys = keys.where("hot").select("key")
    if 0 < hot_keys.count() <= BROADCAST:
        hot_keys = F.broadcast(hot_keys)
        shared = suffixes.join(hot_keys, "key", "left_anti").join(keys.where("not hot"), "key").unionByName(suffixes.join(hot_keys, "key").withColumn("hot", F.lit(True)))
    else:
        shared = suffixes.join(keys, "key")
    places = shared.groupBy("doc").agg(F.collect_set(F.when(~F.col("hot"), F.col("pos"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("pos"))).alias("hot"))
    again = rows.join(places, "doc").select("doc", "doc_id", "text", "cold", "hot")
    around = common.materialise(common.map_arrow(again, _contexts, "key long, pos int, around binary, rest int, doc long, doc_id long"), "around")
    sorted_keys = around.where("around is not null").repartition("key").sortWithinPartitions("key")
    spans = common.map_arrow(sorted_keys, _sort_and_extend, "doc long, doc_id long, start int, end int, later boolean")
    windows = around.where("around is null").select("key", "doc", "doc_id", F.col("pos").alias("start"), (F.col("pos") + LEAST).alias("end"))
    order = F.struct("doc_id", "doc")
    groups = windows.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last").select("key", "first")
    hot = windows.join(groups, "key").select("doc", "doc_id", "start", "end", F.explode(F.when(order != F.col("first"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("later"))
    every = spans.unionByName(hot).repartition("doc").sortWithinPartitions("doc", "start")
    return common.map_arrow(every, _merge, "doc long, doc_id long, start_word long, end_word long, removable long, later_copies array<struct<start_word:long,end_word:long>>")


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ordered spans, and without the white space that follows each of these words."""
    _, starts, _ = common.word_hashes(text)
    starts = np.append(starts, len(text))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(starts[b])
    return b"".join([*out, text[at:]])


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs with texts rebuilt without the later copies of passages; null texts stay null, all other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, 1):
                texts = [without_words(t, [(s["start_word"], s["end_word"]) for s in spans]).decode() for t, spans in zip(common.blobs(b.column(1)), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_sd_doc", "_sd_text"])

    each = _passages(docs).groupBy("doc").agg(F.sort_array(F.flatten(F.collect_list("later_copies"))).alias("spans")).where(F.size("spans") > 0)
    keyed = docs.withColumn("_sd_doc", F.xxhash64("doc_id", "text"))
    cut = keyed.select("_sd_doc", "text").join(each.withColumnRenamed("doc", "_sd_doc"), "_sd_doc").dropDuplicates(["_sd_doc"])
    cut = common.materialise(common.map_arrow(cut.select("_sd_doc", "text", "spans"), run, "_sd_doc long, _sd_text string"), "cut")
    out = keyed.join(cut, "_sd_doc", "left")
    return out.withColumn("text", F.coalesce("_sd_text", "text")).select(*docs.columns)
