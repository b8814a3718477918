"""Language-model scoring with a hierarchical Pitman-Yor model.

The model: a restaurant for each word before (a text's start counts as one), whose parent is the restaurant of its
class (a hash of its last two bytes), whose parent is the restaurant of single words, whose parent is uniform over the
known words and one unknown. So the restaurants grow with the corpus. A customer of a context is an occurrence of a word
after it; one that opens a table is a customer of the parent.

Seating is sampled by Gibbs in the table-indicator form, whose state is the customers and tables of each word in each
restaurant: a customer is taken out (with probability tables / customers it is one that opened a table) and seated
again, by the ratios of generalised Stirling numbers, given all others. A sweep does so as often as a word has customers
in a restaurant, for each word in each restaurant, level by level: the first RESEATED times for all words side by side,
then word by word, which is the same. Parents follow at the end of a level, by as many customers as tables were opened or
closed; totals of the restaurants are those of the sweep before, plus a word's own changes. The first sweep starts from
the expected numbers of tables. Predictive probabilities are averaged over the sweeps after burn-in. Every random
number is a hash of the word, the context and the step, so results depend neither on how the corpus is filed nor on
the number of parts.

Layout: words are dealt by hash into parts, so that all counts, tables and probabilities of a word are in one part.
Each task counts the words of a few MB of text and sends each part one packed block. The contexts of a part's words are
other words, so their totals are exchanged: each part sends its contexts' sums to the parts that own these, which add
them up and reply to every part that sent them. A context's only customer of a word always has one table, so sweeps
carry and exchange the others. To answer, texts are read again: a block holds the documents too, and a part answers it
with sums by document; a word that a training text has after a context once in the corpus is known to be that text's, so
that the parts keep only those of them that held-out texts ask for. So one word or context that a third of all tokens
share is some rows of a block, what is gathered grows with the corpus, and the driver holds totals by class only.

Defined cases: null text counts as empty, and an empty text is its end token alone; rows with a null doc_id count as
training rows; repeated rows are counted and scored each; without training rows every known count is 0 and both
scores are 0; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

#: Classes of the words before, the parents of these; the last stands for the start of a text.
CLASSES = 256
#: Bits of the hashes of words.
BITS = 52
END, START = np.uint64(0xE0D0F7EC7), np.uint64(0x57A47F7EC7)
CONTEXT_STRENGTH, STRENGTH, ROOT_STRENGTH = 1.0, 20.0, 20.0
BURN_IN, SAMPLES = 2, 2
#: Customers of each word that are reseated for all words side by side, and numbers held for the others, word by word.
RESEATED, WALKED = 64, 1 << 17
#: Bytes of stored table for each part of the words, and of text for each block.
PART_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20
#: Customers up to which ratios of Stirling numbers are tabulated.
TABULATED = 1024


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token, and the class of what stands before each."""
    words, _, ends = common.word_hashes(text)
    raw = np.frombuffer(text, np.uint8)
    last = common.LOWERED[raw[ends - 1]].astype(np.uint64) if len(ends) else np.empty(0, np.uint64)
    before = common.LOWERED[raw[np.maximum(ends - 2, 0)]].astype(np.uint64) if len(ends) else last
    before[common.IS_SPACE[before.astype(np.int64)]] = 0
    classes = np.empty(len(words) + 1, np.uint8)
    classes[0] = CLASSES - 1
    classes[1:] = common.mix64(last << np.uint64(8) | before) % np.uint64(CLASSES - 1)
    return np.append(words >> np.uint64(64 - BITS), END), classes


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Parts in the order of the hashes, so that sorted words are sorted by part."""
    return ((words >> np.uint64(BITS - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


# packed arrays: bytes of equal weight stand together; sorted ones are stored as differences

SORTED = "sorted"


def _pack(types: tuple, *arrays: np.ndarray) -> bytes:
    out = [struct.pack(f"<{len(types)}Q", *[len(a) for a in arrays])]
    for t, a in zip(types, arrays, strict=True):
        a = np.diff(a.astype(np.uint64), prepend=np.uint64(0)) if t == SORTED else a.astype(t)
        out.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes, types: tuple) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(types)}Q", data)
    at, out = 8 * len(types), []
    for n, t in zip(sizes, types):
        kind = np.dtype(np.uint64 if t == SORTED else t)
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.empty(0, kind)
        out.append(np.cumsum(a) if t == SORTED else a)
        at += n * kind.itemsize
    return out


#: Words, entries of each, contexts, classes of these, context of each entry, counts; without documents twice the training
#: counts, and one more where held-out texts have the pair.
_COUNTED = (SORTED, np.uint32, SORTED, np.uint8, np.uint32, np.uint32)
#: The same, with the document of each entry and how many of the documents, the first ones, are training rows.
_ASKED = (*_COUNTED, np.uint32, np.uint32)
#: Of a part: training tokens of each word; contexts, classes of these, customers and entries of each; of pairs that one
#: training token and held-out texts have, their word and context.
_PART = (np.uint32, SORTED, np.uint8, np.uint32, np.uint32, SORTED, np.uint32)
#: Contexts of pairs with more customers than one, places of these among all contexts; context, counts and cell of each.
_MANY = (SORTED, SORTED, np.uint32, np.uint32, np.uint32)
#: Words, cells (words with a class) of each, classes, customers that always have a table of their own.
_CELLS = (SORTED, np.uint32, np.uint8, np.uint32)
#: Tables of each pair, of each cell, and of each word at the root; customers of each cell.
_TABLES = (np.uint32, np.uint32, np.uint32, np.uint32)


def _entries(found: list, parts: int, trained: int, docs: bool) -> Iterator[tuple[int, bytes]]:
    """Packed blocks by part, of the tokens of some rows, of which the first ones are training rows; with the documents
    or summed over them."""
    sizes = np.array([len(w) for w, _ in found])
    words, index = np.unique(np.concatenate([*[w for w, _ in found], [START]]), return_inverse=True)
    index = index.astype(np.int32)
    start, index = index[-1], index[:-1]
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[np.cumsum(sizes) - sizes] = start
    classes = np.zeros(len(words), np.uint8)
    classes[before] = np.concatenate([c for _, c in found])
    found.clear()
    pair = index * np.int64(len(words)) + before
    del index, before
    order = np.argsort(pair, kind="stable")  # keeps the documents of a pair in order
    pair, doc = pair[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    del order
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (docs & (doc[1:] != doc[:-1]))])
    if docs:
        counts = np.diff(np.r_[first, len(pair)])
    else:
        counts = 2 * np.add.reduceat((doc < trained).astype(np.int32), first) + np.logical_or.reduceat(doc >= trained, first)
    pair, doc = pair[first], doc[first]
    index, before = (pair // len(words)).astype(np.int32), (pair % len(words)).astype(np.int32)
    del pair, first
    per_word = np.bincount(index, minlength=len(words))
    starts = np.searchsorted(part_of(words, parts), np.arange(parts + 1))
    entry = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
    for p in range(parts):
        lo, hi = starts[p], starts[p + 1]
        e = slice(entry[lo], entry[hi])
        if e.start < e.stop:
            used, local = np.unique(before[e], return_inverse=True)
            own = np.flatnonzero(per_word[lo:hi]) + lo
            cell = (words[own], per_word[own], words[used], classes[used], local, counts[e])
            yield p, _pack(_ASKED, *cell, doc[e], np.array([trained])) if docs else _pack(_COUNTED, *cell)


_ROWS = (np.int64, np.uint8, np.uint8, np.int64)


def _blocks(parts: int, docs: bool):
    """With docs, a further row of each block goes to a negative part, with what is known of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in common.small_batches(whole, 1, BLOCK_BYTES):
                order = np.argsort(b.column(2).to_numpy(zero_copy_only=False).astype(bool), kind="stable")
                b = b.take(pa.array(order))  # training rows come first
                held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                found = [tokens(t) for t in common.blobs(b.column(1))]
                sizes = np.array([len(w) for w, _ in found], np.int64)
                out = list(_entries(found, parts, len(held) - int(held.sum()), docs))
                if docs:
                    missing = np.asarray(b.column(0).is_null().to_numpy(zero_copy_only=False), np.uint8)
                    ids = np.asarray(b.column(0).fill_null(0).to_numpy(), np.int64)
                    out.append((-1 - hash(number) % parts, _pack(_ROWS, ids, missing, held, sizes)))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["part", "block", "data"])
                number += 1

    return run


def _discount_facts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2)]


def _count(t: pa.Table) -> pa.Table:
    """The training counts of one part, and its first seating: a table for each pair, cell and word."""
    blobs = [_unpack(x, _COUNTED) for x in t.column("data").to_pylist()]
    words = np.unique(np.concatenate([b[0] for b in blobs]))
    contexts, first = np.unique(np.concatenate([b[2] for b in blobs]), return_index=True)
    classes = np.concatenate([b[3] for b in blobs])[first]
    n = len(contexts)
    key, counts = np.empty(sum(len(b[4]) for b in blobs), np.int64), np.concatenate([b[5] for b in blobs])
    end = 0
    while blobs:
        b = blobs.pop(0)
        key[end : end + len(b[4])] = np.repeat(np.searchsorted(words, b[0]) * n, b[1]) + np.searchsorted(contexts, b[2])[b[4]]
        end += len(b[4])
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    del order
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    asked = np.logical_or.reduceat(counts & 1, first)  # by held-out texts
    key, counts = key[first], np.add.reduceat(counts.astype(np.int64) >> 1, first)
    alone = key[(counts == 1) & asked]
    key, counts = key[counts > 0], counts[counts > 0]
    known, index = np.unique(key // n, return_inverse=True)  # words of training texts
    at = key % n
    cell_key, cell = np.unique(index * CLASSES + classes[at], return_inverse=True)
    cell_class, cells = (cell_key % CLASSES).astype(np.uint8), np.bincount(cell_key // CLASSES, minlength=len(known))
    customers = np.bincount(cell, minlength=len(cell_key))
    many = counts > 1
    places, many_at = np.unique(at[many], return_inverse=True)
    total = np.bincount(index, weights=counts, minlength=len(known))
    row = {
        "part": t.column("part")[0].as_py(),
        "counts": _pack(_PART, total, contexts, classes, np.bincount(at, weights=counts, minlength=n), np.bincount(at, minlength=n), np.searchsorted(known, alone // n), alone % n),
        "many": _pack(_MANY, contexts[places], places, many_at, counts[many], cell[many]),
        "cells": _pack(_CELLS, words[known], cells, cell_class, np.bincount(cell, weights=~many, minlength=len(cell_key))),
        "tables": _pack(_TABLES, np.ones(int(many.sum())), np.ones(len(cell_key)), np.ones(len(known)), customers),
        "customers": np.bincount(cell_class, weights=customers, minlength=CLASSES).astype(np.int64).tolist(), "open": np.bincount(cell_class, minlength=CLASSES).tolist(),
        "facts": [len(known), len(known), *_discount_facts(customers), *_discount_facts(cells), *_discount_facts(counts), int(counts.sum())],
    }
    return pa.table({k: pa.array([row[k]], _TYPES[k]) for k in ("part", "counts", *_STATE[1:])})


_LONGS = pa.list_(pa.int64())
_TYPES = {"part": pa.int64(), "counts": pa.binary(), "many": pa.binary(), "cells": pa.binary(), "tables": pa.binary(), "open_first": pa.binary(), "customers": _LONGS, "open": _LONGS, "facts": _LONGS}
_STATE = ("part", "many", "cells", "tables", "customers", "open", "facts")
_SQL = {"part": "long", "customers": "array<long>", "open": "array<long>", "facts": "array<long>"}


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {_SQL.get(n, 'binary')}" for n in names)


# totals of contexts


def _sent(values, n: int, parts: int):
    """Of rows of parts: their contexts with the n values(row), dealt by context to the owners of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                contexts, *sums = values(r)
                starts = np.searchsorted(part_of(contexts, parts), np.arange(parts + 1))
                rows = [(q, _pack((SORTED, *[np.uint32] * n), contexts[lo:hi], *[x[lo:hi] for x in sums])) for q, lo, hi in zip(range(parts), starts[:-1], starts[1:]) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([r["part"]] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["owner", "part", "data"])

    return run


def _summed(n: int):
    """Of one owner: to each part that sent contexts, their n sums over all parts."""

    def run(t: pa.Table) -> pa.Table:
        blobs = [_unpack(x, (SORTED, *[np.uint32] * n)) for x in t.column("data").to_pylist()]
        _, index = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        sums = [np.bincount(index, weights=np.concatenate([b[1 + i] for b in blobs]))[index] for i in range(n)]
        ends = np.cumsum([len(b[0]) for b in blobs])
        data = [_pack((np.int64,) * n, *[s[e - len(b[0]) : e] for s in sums]) for b, e in zip(blobs, ends.tolist())]
        return pa.table({"part": t.column("part"), "owner": t.column("owner"), "data": pa.array(data, pa.binary())})

    return run


def _exchange(rows: DataFrame, values, n: int, parts: int) -> DataFrame:
    """part, owner and data: the sums over all parts of the n values of each context that a part sends."""
    return common.map_arrow(rows, _sent(values, n, parts), "owner long, part long, data binary").groupBy("owner").applyInArrow(_summed(n), "part long, owner long, data binary")


def _replies(t: pa.Table, n: int) -> list[np.ndarray]:
    """The sums, in the order in which the part holds its contexts."""
    if not t.num_rows:
        return [np.empty(0, np.int64)] * n
    blobs = [_unpack(x, (np.int64,) * n) for x in t.sort_by("owner").column("data").to_pylist()]
    return [np.concatenate([b[i] for b in blobs]) for i in range(n)]


def _first_sums(r: dict) -> tuple[np.ndarray, ...]:
    """Customers and tables of each context at the first seating."""
    _, contexts, _, customers, entries, _, _ = _unpack(r["counts"], _PART)
    return contexts, customers, entries


def _added(many: bytes, tables: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with a word that has more customers than one, their places, and tables beyond those of the first seating."""
    contexts, places, at, _, _ = _unpack(many, _MANY)
    return contexts, places.astype(np.int64), np.bincount(at, weights=_unpack(tables, _TABLES)[0].astype(np.int64) - 1, minlength=len(contexts))


def _sweep_sums(r: dict) -> tuple[np.ndarray, ...]:
    contexts, _, added = _added(r["many"], r["tables"])
    return contexts, added


def _sample_sums(n: int):
    def run(r: dict) -> tuple[np.ndarray, ...]:
        contexts = _unpack(r["counts"], _PART)[1]
        sums = np.zeros((n, len(contexts)))
        for i in range(n):
            _, places, added = _added(r["many"], r[f"tables{i}"])
            sums[i, places] = added
        return contexts, *sums

    return run


class Totals:
    """What all parts share: customers and tables by class, of the root, known words, training tokens, discounts
    of classes, root and contexts."""

    def __init__(self, state: DataFrame, discounts: tuple[float, float, float] | None = None) -> None:
        rows = state.select(F.posexplode(F.arrays_zip("customers", "open")).alias("k", "x")).groupBy("k").agg(F.sum("x.customers").alias("c"), F.sum("x.open").alias("t")).collect()
        customers, opened = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in rows:
            customers[r["k"]], opened[r["k"]] = r["c"], r["t"]
        facts = [r["s"] for r in state.select(F.posexplode("facts").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("s")).orderBy("k").collect()] or [0] * 9
        # the usual estimate of a discount from how many are seen once and twice
        discounts = discounts or tuple(min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5 for a, b in ((facts[2], facts[3]), (facts[4], facts[5]), (facts[6], facts[7])))
        self.set(customers, opened, facts[0], facts[1], facts[8], discounts)

    def set(self, customers: np.ndarray, opened: np.ndarray, words: int, root_open: int, trained: int, discounts: tuple) -> Totals:
        self.customers, self.open, self.words, self.root_open = customers, opened, float(words), float(root_open)
        self.trained, self.root_customers, self.discounts = int(trained), float(opened.sum()), tuple(discounts)
        return self

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probabilities of the root for words with these customers and tables."""
        d = self.discounts[1]
        return (np.maximum(customers - d * tables, 0) + (ROOT_STRENGTH + d * self.root_open) / (self.words + 1)) / (ROOT_STRENGTH + self.root_customers)

    def backoff(self) -> np.ndarray:
        """Weight of the root in each class."""
        return (STRENGTH + self.discounts[0] * self.open) / (STRENGTH + self.customers)

    def cells(self, classes: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What words with these customers and tables have of their own in their class."""
        return np.maximum(customers - self.discounts[0] * tables, 0) / (STRENGTH + self.customers)[classes]


# seating


@functools.lru_cache(maxsize=8)
def _ratios(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """S(c, t - 1) / S(c, t) of generalised Stirling numbers for 1 <= t <= c <= TABULATED, by the recursion
    S(c + 1, t) = S(c, t - 1) + (c - t * discount) * S(c, t); and the last row over t - 1."""
    v = np.zeros((TABULATED + 1, TABULATED + 2))
    t = np.arange(TABULATED + 2, dtype=float)
    for c in range(1, TABULATED):
        # of t = 2 ... c; then t = c + 1, where S(c, t) is 0
        k = slice(2, c + 1)
        v[c + 1, k] = v[c, k] * (v[c, 1:c] + c - (t[k] - 1) * discount) / (v[c, k] + c - t[k] * discount)
        v[c + 1, c + 1] = v[c, c] + c - c * discount
    last = v[TABULATED, 2 : TABULATED + 1] / np.arange(1, TABULATED)
    return v, last


def stirling_ratio(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """S(c, t - 1) / S(c, t). Beyond the table, (t - 1) times a function of (t - 1) / c ** discount alone, as which the
    ratio behaves for many customers."""
    v, last = _ratios(discount)
    out = v[np.minimum(c, TABULATED), np.minimum(t, TABULATED + 1)]
    far = np.flatnonzero(c > TABULATED)
    if len(far):
        x = (t[far] - 1) * (TABULATED / c[far]) ** discount
        out[far] = (t[far] - 1) * np.interp(x, np.arange(1, TABULATED), last)
    return out


def weights(c: np.ndarray, t: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """How one more customer, besides c at t tables, weighs at these, and at a new table for each mass of one in its restaurant."""
    above = stirling_ratio(c, t + 1, discount)
    some = (t < c) & (above > 0)
    new = np.where(some, 1 + (c - (t + 1) * discount) / np.where(some, above, 1), 1.0) * (t + 1)
    return (c - t + 1) * (stirling_ratio(c, t, discount) + c - t * discount), new


def opening(c: np.ndarray, t: np.ndarray, mass: np.ndarray, discount: float) -> np.ndarray:
    """Probability that one more customer, besides c at t tables, opens one; mass: weight of a new table in its restaurant."""
    old, new = weights(c, t, discount)
    return mass * new / (mass * new + old)


def mixed(keys: np.ndarray, *step: int | np.ndarray) -> np.ndarray:
    """Further keys for each key and the step, which may be one for each key."""
    with np.errstate(over="ignore"):
        for s in step:
            keys = common.mix64(keys + np.uint64(s + 1) * np.uint64(0x9E3779B97F4A7C15))
    return keys


def uniform(keys: np.ndarray, *step: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key and the step."""
    return (mixed(keys, *step) >> np.uint64(11)).astype(float) / float(1 << 53)


def expected_tables(c: np.ndarray, mass: np.ndarray, discount: float) -> np.ndarray:
    """About how many tables c customers of a word open, seated one after the other."""
    tables = np.ones(len(c))
    at, seated = np.flatnonzero(c > 1), 1
    while len(at):
        run = max(1, seated // 16)
        tables[at] += np.minimum(run, c[at] - seated) * mass[at] / (seated - discount * tables[at] + mass[at])
        seated += run
        at = at[c[at] > seated]
    return np.clip(np.rint(tables), 1, np.maximum(c, 1)).astype(np.int64)


def reseat(c: np.ndarray, t: np.ndarray, opened: np.ndarray, strength: float, discount: float, p: np.ndarray, p_less: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after as many customers of each word as it has were taken out and seated again, one after the other. opened:
    tables of the restaurant; p: the parent's probability of the word, p_less: with one customer less there."""
    t, at = t.copy(), np.flatnonzero(c > 1)
    opened, keys = opened - t, mixed(keys, sweep)  # tables of the other words
    for step in range(RESEATED):
        at = at[c[at] > step]
        if not len(at):
            return t
        n, m = c[at], t[at]
        head = uniform(keys[at], 2 * step) < m / n
        stays = head & (m == 1)  # others sit at the only table
        m = m - (head & ~stays)
        mass = (strength + discount * (opened[at] + m)) * np.where(head, p_less[at], p[at])
        opens = uniform(keys[at], 2 * step + 1) < opening(n - 1, m, mass, discount)
        t[at] = np.where(stays, t[at], m + opens)
    # the same for the others of more frequent words, with the probabilities of each word tabulated by its tables
    at = at[c[at] > RESEATED]
    done = np.full(len(at), RESEATED)
    while len(at):
        reach = 8 + 2 * np.sqrt(np.minimum(t[at], c[at] - t[at])).astype(np.int64)
        runs = np.minimum(c[at] - done, WALKED)
        n = max(1, int(np.searchsorted(np.cumsum(2 * reach + runs), WALKED)))
        now, runs = at[:n], runs[:n]
        low = np.maximum(t[now] - reach[:n], 1)
        widths = np.minimum(t[now] + reach[:n], c[now]) - low + 1
        which, m = _spread(widths + 1, low - 1)  # one table less comes first
        who = now[which]
        old, new = weights(c[who] - 1, m, discount)
        mass = strength + discount * (opened[who] + m)
        grows, keeps = (mass * x * new / (mass * x * new + old) for x in (p[who], p_less[who]))
        first, keeps = m / c[who], np.where(m > 0, keeps, 1.0)  # others sit at the only table
        which, step = _spread(runs, done[:n])
        heads, draws = uniform(keys[now[which]], 2 * step), uniform(keys[now[which]], 2 * step + 1)
        # most customers neither close nor open a table, whatever the tables
        starts = np.cumsum(widths + 1) - widths - 1
        some = np.flatnonzero((heads < first[starts + widths][which]) | (draws < np.maximum.reduceat(grows, starts)[which]))
        heads, draws, some_step = heads[some], draws[some], step[some] + 1
        ends = np.cumsum(np.bincount(which[some], minlength=n))
        for i, (w, lo, start, width, begin, end) in enumerate(zip(*[x.tolist() for x in (now, low, starts, widths, np.r_[0, ends[:-1]], ends)])):
            own, less, numbers = slice(start + 1, start + width + 1), slice(start, start + width), slice(begin, end)
            x, seated = _walk(int(t[w]) - lo, first[own].tolist(), grows[own].tolist(), keeps[less].tolist(), heads[numbers].tolist(), draws[numbers].tolist())
            t[w] = x + lo
            done[i] = done[i] + runs[i] if 0 <= x < width else some_step[begin + seated - 1]
        left = done < c[at]
        at, done = at[left], done[left]
    return t


def _spread(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of these sizes from these starts on: the range of each number in them, and the number."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - (np.cumsum(sizes) - sizes - starts)[which]


def _walk(x: int, first: list, grows: list, keeps: list, heads: list, draws: list) -> tuple[int, int]:
    """Takes out and seats again a customer for each of heads and draws: place in the lists, which are by tables, and how
    many were seated, which ends where a place outside the lists is reached."""
    for seated, (head, draw) in enumerate(zip(heads, draws), 1):
        if head < first[x]:
            if draw >= keeps[x]:
                x -= 1
                if x < 0:
                    return x, seated
        elif draw < grows[x]:
            x += 1
            if x == len(grows):
                return x, seated
    return x, len(heads)


def follow(c: np.ndarray, t: np.ndarray, now: np.ndarray, opened: np.ndarray, strength: float, discount: float, p: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after the c customers of each word, at t tables, have become now: by one at a time."""
    c, t = c.copy(), t.copy()
    at, step = np.flatnonzero(c != now), 0
    while len(at):
        n, m = c[at], t[at]
        u = uniform(keys[at], sweep, step, 0)  # a step more than in reseat: other numbers
        grows = now[at] > n
        opens = grows & (u < opening(n, m, (strength + discount * opened[at]) * p[at], discount))
        closes = ~grows & (m > 1) & (u < m / n)
        t[at] = m + opens - closes
        c[at] = n + np.where(grows, 1, -1)
        at, step = at[c[at] != now[at]], step + 1
    return t


def sweep_part(totals: Totals, number: int, many: list, cells: list, tables: list, opened: np.ndarray) -> tuple[np.ndarray, ...]:
    """One sweep over the words of a part: tables of the pairs, cells and words, and customers of the cells. opened:
    tables of each context. Arguments are as _MANY, _CELLS and _TABLES say."""
    d, d0, d2 = totals.discounts
    contexts, _, at, counts, cell = many
    words, per_word, classes, single = cells
    pair_tables, cell_tables, root_tables, customers = [x.astype(np.int64) for x in tables]
    counts, cell = counts.astype(np.int64), cell.astype(np.int64)
    word = np.repeat(np.arange(len(words)), per_word)
    with np.errstate(over="ignore"):
        cell_keys = common.mix64(words[word] * np.uint64(CLASSES) + classes + np.uint64(1))
        keys = common.mix64(words[word[cell]] * np.uint64(0xD1342543DE82EF95) + contexts[at])
    at_root = np.bincount(word, weights=cell_tables, minlength=len(words)).astype(np.int64)
    base = np.full(len(words), 1 / (totals.words + 1))
    back = totals.backoff()[classes]

    def probabilities(n: np.ndarray) -> np.ndarray:
        """Of each word in its class, which it has n customers of."""
        return totals.cells(classes, n, np.minimum(cell_tables, n)) + back * totals.root(at_root, root_tables)[word]

    p, p_less = probabilities(customers), probabilities(customers - 1)
    if number == 0:
        mass = (CONTEXT_STRENGTH + d2 * opened)[at] * p[cell]
        pair_tables = expected_tables(counts, mass, d2)
    pair_tables = reseat(counts, pair_tables, opened[at].astype(float), CONTEXT_STRENGTH, d2, p[cell], p_less[cell], keys, number)
    now = single.astype(np.int64) + np.bincount(cell, weights=pair_tables, minlength=len(single)).astype(np.int64)
    root, root_less = totals.root(at_root, root_tables)[word], totals.root(at_root - 1, np.minimum(root_tables, at_root - 1))[word]
    open_of = totals.open[classes]
    if number == 0:
        cell_tables = expected_tables(now, (STRENGTH + d * open_of) * root, d)
    else:
        cell_tables = follow(customers, cell_tables, now, open_of, STRENGTH, d, root, cell_keys, number)
    cell_tables = reseat(now, cell_tables, open_of, STRENGTH, d, root, root_less, cell_keys, number)
    now_root = np.bincount(word, weights=cell_tables, minlength=len(words)).astype(np.int64)
    root_of = np.full(len(words), totals.root_open)
    if number == 0:
        root_tables = expected_tables(now_root, (ROOT_STRENGTH + d0 * root_of) * base, d0)
    else:
        root_tables = follow(at_root, root_tables, now_root, root_of, ROOT_STRENGTH, d0, base, words, number)
    root_tables = reseat(now_root, root_tables, root_of, ROOT_STRENGTH, d0, base, base, words, number)
    return pair_tables, cell_tables, root_tables, now


def _with_first(state: pa.Table, replies: pa.Table) -> pa.Table:
    """The rows that sweeps take: without counts, with the tables of the first seating of the contexts in many."""
    places = _unpack(state.column("many")[0].as_py(), _MANY)[1].astype(np.int64)
    first = _pack((np.uint32,), _replies(replies, 2)[1][places])
    return state.select(_STATE).append_column("open_first", pa.array([first], pa.binary()))


def _sweep(totals: Totals, number: int):
    def run(state: pa.Table, replies: pa.Table) -> pa.Table:
        r = state.to_pylist()[0]
        many, cells, tables = _unpack(r["many"], _MANY), _unpack(r["cells"], _CELLS), _unpack(r["tables"], _TABLES)
        opened = _unpack(r["open_first"], (np.uint32,))[0].astype(np.int64) + (_replies(replies, 1)[0] if replies.num_rows else 0)
        out = sweep_part(totals, number, many, cells, tables, opened)
        classes = cells[2]
        r["tables"] = _pack(_TABLES, *out)
        r["customers"] = np.bincount(classes, weights=out[3], minlength=CLASSES).astype(np.int64).tolist()
        r["open"] = np.bincount(classes, weights=out[1], minlength=CLASSES).astype(np.int64).tolist()
        r["facts"] = [len(cells[0]), int(out[2].sum()), *r["facts"][2:]]
        return pa.table({k: pa.array([r[k]], _TYPES[k]) for k in (*_STATE, "open_first")})

    return run


# answers


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted among sorted keys, the length of keys for what is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def _with_sums(n: int):
    """Model rows with the customers and, for each sample, the tables of each context."""

    def run(model: pa.Table, replies: pa.Table) -> pa.Table:
        first, last = (replies.filter(pc.equal(replies.column("last"), x)).drop(["last"]) for x in (False, True))
        customers, opened = _replies(first, 2)
        return model.append_column("sums", pa.array([_pack((np.uint32,) * (1 + n), customers, *[opened + x for x in _replies(last, n)])], pa.binary()))

    return run


_SUMS = (SORTED, np.uint32, np.float64, np.float64)


class Part:
    """The probabilities of one part, over all samples."""

    def __init__(self, model: pa.Table, samples: list[Totals]) -> None:
        row = model.to_pylist()[0]
        total, self.contexts, _, _, _, alone_word, alone_at = _unpack(row["counts"], _PART)
        _, places, at, counts, cell = _unpack(row["many"], _MANY)
        self.words, per_word, classes, _ = _unpack(row["cells"], _CELLS)
        customers, *opened = (x.astype(float) for x in _unpack(row["sums"], (np.uint32,) * (1 + len(samples))))
        self.samples, self.total, n = samples, np.append(total, 0).astype(float), len(self.contexts)
        word = np.repeat(np.arange(len(self.words)), per_word)
        at = places.astype(np.int64)[at]
        self.keys = word[cell.astype(np.int64)] * n + at
        self.alone = alone_word.astype(np.int64) * n + alone_at
        self.cell_keys = word * CLASSES + classes
        d2 = samples[0].discounts[2]
        self.once = (1 - d2) / (CONTEXT_STRENGTH + customers)
        self.owns, self.backs, self.cell_owns, self.roots = [], [], [], []
        for i, (s, t_u) in enumerate(zip(samples, opened)):
            many, cell_tables, root_tables, cell_customers = (x.astype(float) for x in _unpack(row[f"tables{i}"], _TABLES))
            self.owns.append(np.append(np.maximum(counts - d2 * many, 0) / (CONTEXT_STRENGTH + customers[at]), 0.0))
            self.backs.append((CONTEXT_STRENGTH + d2 * t_u) / (CONTEXT_STRENGTH + customers))
            self.cell_owns.append(np.append(s.cells(classes, cell_customers, cell_tables), 0.0))
            self.roots.append(np.append(s.root(np.bincount(word, weights=cell_tables, minlength=len(self.words)), root_tables), s.root(np.zeros(1), np.zeros(1))))

    def sums(self, block: bytes) -> bytes:
        """Of each document of a block: known tokens, base score, score."""
        w, per, us, c, e, n, doc, trained = _unpack(block, _ASKED)
        at_word = np.repeat(_find(self.words, w), per)
        u, c = _find(self.contexts, us)[e], c[e]
        key = at_word * len(self.contexts) + u
        k, cell = _find(self.keys, key), _find(self.cell_keys, at_word * CLASSES + c)
        # a pair of a training text that isn't among the others is there once
        once = (k == len(self.keys)) & ((doc < trained[0]) | (_find(self.alone, key) < len(self.alone)))
        once = np.where(once, self.once[u], 0.0)
        p = sum(o[k] + once + b[u] * (co[cell] + s.backoff()[c] * r[at_word]) for o, b, co, r, s in zip(self.owns, self.backs, self.cell_owns, self.roots, self.samples)) / len(self.samples)
        s = self.samples[0]
        base = np.log10((self.total[at_word] + 0.5) / (s.trained + 0.5 * (s.words + 1)))
        docs, place = np.unique(doc, return_inverse=True)
        return _pack(_SUMS, docs, *[np.bincount(place, weights=x, minlength=len(docs)) for x in (n * (self.total[at_word] > 0), n * base, n * np.log10(p))])


def _answer(samples: list[Totals]):
    """Sums by document of each block of one part."""

    def run(blocks: pa.Table, model: pa.Table) -> pa.Table:
        if blocks.num_rows and blocks.column("part")[0].as_py() < 0:
            return pa.table({"block": blocks.column("block"), "kind": pa.array([0] * blocks.num_rows, pa.int32()), "data": blocks.column("data")})
        part = Part(model, samples) if blocks.num_rows else None
        out = [part.sums(x.as_py()) for x in blocks.column("data")]
        return pa.table({"block": blocks.column("block"), "kind": pa.array([1] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})

    return run


def _gather(trained: int):
    def run(t: pa.Table) -> pa.Table:
        kinds, data = t.column("kind").to_pylist(), t.column("data").to_pylist()
        ids, missing, held, sizes = _unpack(data[kinds.index(0)], _ROWS)
        sums = np.zeros((3, len(ids)))
        for kind, blob in zip(kinds, data):
            if kind:
                docs, *values = _unpack(blob, _SUMS)
                for s, v in zip(sums, values):
                    s[docs.astype(np.int64)] += v
        return pa.table({"doc_id": pa.array(ids, mask=missing.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(sums[0].astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), trained, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return run


def _parts(docs: DataFrame) -> int:
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, math.ceil(size / PART_BYTES)) if size < 1 << 50 else max(1, math.ceil(docs.count() / 5000))


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score: a row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    parts = _parts(docs)
    counted = common.map_arrow(rows, _blocks(parts, False), "part long, block long, data binary").select("part", "data")
    counts = common.materialise(counted.groupBy("part").applyInArrow(_count, _schema(("part", "counts", *_STATE[1:]))), "counts")
    totals = Totals(counts)
    first = common.materialise(_exchange(counts.select("part", "counts"), _first_sums, 2, parts), "first")
    state = common.materialise(counts.select(*_STATE).groupBy("part").cogroup(first.groupBy("part")).applyInArrow(_with_first, _schema((*_STATE, "open_first"))), "state")
    kept, samples = [], []
    for number in range(BURN_IN + SAMPLES):
        replies = _exchange(state.select("part", "many", "tables"), _sweep_sums, 1, parts)
        swept = state.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_sweep(totals, number), _schema((*_STATE, "open_first")))
        before, state = state, common.materialise(swept, "seating")
        common.discard(before)
        totals = Totals(state, totals.discounts)
        if number >= BURN_IN:
            kept.append(common.materialise(state.select("part", F.col("tables").alias(f"tables{len(samples)}")), "sample"))
            samples.append(totals)
    common.discard(state)
    model = counts.select("part", "counts", "many", "cells")
    for s in kept:
        model = model.join(s, "part")
    last = _exchange(model, _sample_sums(SAMPLES), SAMPLES, parts)
    sums = first.withColumn("last", F.lit(False)).unionByName(last.withColumn("last", F.lit(True)))
    names = tuple(model.columns)
    model = common.materialise(model.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(_with_sums(SAMPLES), _schema((*names, "sums"))), "model")
    for used in (counts, first, *kept):
        common.discard(used)
    blocks = common.map_arrow(rows, _blocks(parts, True), "part long, block long, data binary")
    answers = blocks.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(_answer(samples), "block long, kind int, data binary")
    return answers.groupBy("block").applyInArrow(_gather(totals.trained), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
