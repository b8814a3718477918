"""Packing documents into training sequences: first-fit decreasing with a tournament tree of bin capacities.

Each document becomes token ids, an end id, and pieces: full ones of the sequence's length and a remainder. They are
dealt at random into groups of about GROUP pieces, and each group packs by itself: longest first, each into the first
bin with room, found by walking down a tree whose nodes hold the largest free capacity below them.

Groups hold a bounded number of pieces, so of bytes, whatever the corpus and however long a document; ids move once
(two bytes each), and no step needs more than one group at a time. Groups are dealt by the positions of rows and pieces,
so no repeated key gathers rows.

Defined cases: null text counts as empty, and an empty document is one piece holding the end id; repeated rows are
packed each; equal lengths go by the order of doc_id and start; other columns are ignored. A sequence is padded to
the full length unless its tokens are a power of two. Tokenizers with ids over 65535 are refused.
"""

from __future__ import annotations

import json
import math
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import common

LENGTH, END, GROUP = 2048, 1, 2000
#: Words whose ids a worker keeps in its newer table. When that is full it becomes the older one, from which words that
#: occur again are taken over. The words of one more slice may come on top.
KEEP = 100_000
#: Bytes of text that are split into words at once; these take some 20 times as much.
SLICE = 1 << 20
#: Texts that are encoded at once.
BATCH = 2000

_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BREAK = re.compile(r"(?<=\S)(\n)(?=\S)")
_UNSAFE = re.compile(r"\s (?!\S)")
_BLANKS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x1c ", "\x1d ", "\x1e ", "\x1f ")


def piece_encoder(path: str):
    """What encodes one run of letters, with a space before it or not, as the byte-level BPE tokenizer of the file does,
    but several times as fast; None where the file's merges don't allow it. Merges that make ids in their order are
    ranks, and merging by rank is the same."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, first = held["model"], held.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or held.get("normalizer") or first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space"):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocabulary, merges = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # bytes stand as printable signs: those that are, then the others from 256 on
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in signs]
    byte_of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    core = tiktoken.Encoding("pieces", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece


class WordTokenizer:
    """Ids of whole texts by a byte-level BPE tokenizer, by way of the ids of their words.

    The tokenizer first splits a text so that a space joins the word after it, and merges nothing across. So where
    every space either follows something else than white space or comes just before a word, the parts at the spaces
    can be encoded on their own; other texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        if max(self.tok.get_vocab().values(), default=0) > 65535:
            raise ValueError(f"{path} has ids of more than 16 bits")
        self.piece = piece_encoder(path)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), BATCH):  # encodings take far more memory than ids
            out += [array("H", x.ids).tobytes() for x in self.tok.encode_batch_fast(texts[i : i + BATCH], add_special_tokens=False)]
        return out

    @staticmethod
    def parts(word: str) -> list[str]:
        """Splits a part further where the tokenizer would: around a line break, and before the signs at its end."""
        out = []
        for x in _BREAK.split(word):
            core = x.rstrip(_SIGNS)
            out += [core, x[len(core) :]] if len(core) < len(x) and core.removeprefix(" ").isalpha() else [x]
        return out

    def learn(self, words: set[str]) -> None:
        ids, split = self.ids, {}
        need = set()
        for w in words:
            if w[1:].isalpha():
                need.add(w)
                continue
            core = w.rstrip(_SIGNS)
            if len(core) < len(w) and core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
                split[w] = ps = (core, w[len(core) :])
            elif "\n" in w and len(ps := self.parts(w)) > 1:
                split[w] = ps
            else:
                ps = (w,)
            need.update(ps)
        new = need.difference(ids)
        if self.piece:
            letters = [w for w in new if w.removeprefix(" ").isalpha()]
            ids.update((w, array("H", self.piece(w.encode())).tobytes()) for w in letters)
            new.difference_update(letters)
        new = list(new)
        ids.update(zip(new, self.encode(new)))
        for w, ps in split.items():
            ids[w] = b"".join([ids[p] for p in ps])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 16-bit numbers."""
        if len(self.ids) > KEEP:
            self.older, self.ids = self.ids, {}
        split, whole = {}, []
        for i, t in enumerate(texts):
            blank = any(x in t for x in _BLANKS) if t.isascii() else True
            if "\0" in t or blank and _UNSAFE.search(t):
                whole.append(i)
            else:
                split[i] = t.replace(" ", "\0 ").split("\0")
        unknown = set().union(*split.values()).difference(self.ids)
        again = unknown.intersection(self.older)
        self.ids.update((w, self.older[w]) for w in again)
        unknown -= again
        if unknown:
            self.learn(unknown)
        get = self.ids.__getitem__
        out = {i: b"".join(map(get, ps)) for i, ps in split.items()}
        out.update(zip(whole, self.encode([texts[i] for i in whole]) if whole else []))
        return [out[i] for i in range(len(texts))]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker and file."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


class TournamentTree:
    """Free capacities of bins in order; finds the first bin with enough."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The bin's number and its free capacity before."""
        best, i, leaves = self.best, 1, self.leaves
        while i < leaves:
            i *= 2
            if best[i] < size:
                i += 1
        free = best[i]
        best[i] = free - size
        at = i
        while i > 1:
            i >>= 1
            a, b = best[2 * i], best[2 * i + 1]
            best[i] = a if a >= b else b
        return at - leaves, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset for each size, in the order given; ties go by position."""
    tree = TournamentTree(len(sizes), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b, free = tree.place(sizes[i])
        out[i] = (b, capacity - free)
    return out


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, doc_tokens, start and ids16 (little-endian 16-bit): the pieces of every row, with its place as `row`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, last = tokenizer(path), np.array([end], np.uint16).tobytes()
        for whole in batches:
            for b in common.small_batches(whole, 1, SLICE):
                texts = [x or "" for x in b.column(1).to_pylist()]
                cols: tuple[list, ...] = ([], [], [], [], [])
                for row, doc, ids in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), tok(texts)):
                    ids += last
                    n = len(ids) // 2
                    for start in range(0, n, length):
                        for c, v in zip(cols, (doc, n, start, ids[2 * start : 2 * (start + length)], row)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64())], ["doc_id", "doc_tokens", "start", "ids16", "row"])
            common.give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return common.map_arrow(rows, run, "doc_id long, doc_tokens long, start long, ids16 binary, row long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, seed: int = 1) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, sequence_tokens, padded_to."""
    n = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # a remainder for each row, and full pieces as if each token had two bytes
    groups = max(1, math.ceil((n["rows"] + n["bytes"] / (2 * length)) / GROUP))
    dealt = pieces(docs, path, length, end).withColumn("grp", F.pmod(F.xxhash64("row", "start", F.lit(seed)), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        ids = [np.frombuffer(x, np.uint16) for x in t.column("ids16").to_pylist()]
        sizes = [len(x) for x in ids]
        placed = np.array(first_fit_decreasing(sizes, length), np.int64).reshape(-1, 2)
        used = np.bincount(placed[:, 0], weights=sizes).astype(np.int64)[placed[:, 0]] if len(sizes) else np.empty(0, np.int64)
        base = (t.column("grp")[0].as_py() << 32) if len(sizes) else 0
        return pa.table({
            "doc_id": t.column("doc_id"), "start": t.column("start"), "length": pa.array(sizes, pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            "doc_tokens": t.column("doc_tokens"), "sequence_id": pa.array(base + placed[:, 0]), "offset": pa.array(placed[:, 1]),
            "sequence_tokens": pa.array(used), "padded_to": pa.array(np.where(used & (used - 1) == 0, used, length)),
        })

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"
    return dealt.groupBy("grp").applyInArrow(run, schema)
