import random
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

import brute
import numpy as np
import public_tokenizers
import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import gif, mixing, packing
from tidelog.llm import queries as llm

TEXTS = [None, "", "a", "x" * 192, "x" * 193, "naïve 漢字 😀", "the cat\n" * 5000]


def test_gif_holds_the_payload(spark, docs):
    out = gif.decode(gif.store(docs(TEXTS))).orderBy("doc_id").collect()
    for r, t in zip(out, TEXTS):
        raw = (t or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert bytes(r["samples"]) == want and r["n_bytes"] == len(raw)
        assert [f["start_ms"] for f in r["frames"]] == [100 * i for i in range(-(-len(want) // (192 * 64)))]
        assert all(sum(f["histogram"]) == 192 * min(len(want) // 192, 64) for f in r["frames"])


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([2, 3, 5, 8]), st.integers(0, 9000), st.integers(1, 256), st.integers(0, 99))
def test_lzw_round_trip(bits, n, colours, seed):
    data = np.random.default_rng(seed).integers(0, min(colours, 1 << bits), n).astype(np.uint8).tobytes()
    assert gif.unlzw(gif.pack_codes(gif.lzw_codes(data, bits), bits), bits, n) == data


def test_a_table_that_stays_full():
    """Without clear codes the table stops at 4096 entries, and the code that is not in it yet is its last one."""
    data = np.random.default_rng(1).integers(0, 4, 60_000).astype(np.uint8).tobytes()
    table, free, codes, at = {}, 6, [4], data[0]
    for c in data[1:]:
        if (at, c) in table:
            at = table[at, c]
        else:
            codes.append(at)
            if free < 4096:
                table[at, c] = free
                free += 1
            at = c
    codes += [at, 5]
    value = used = 0
    size, entries = 3, 6
    for i, c in enumerate(codes):
        value |= c << used
        used += size
        if c == 4:
            size, entries = 3, 5
        elif entries < 4096:
            entries += 1
            if entries == 1 << size and size < 12:
                size += 1
    assert gif.unlzw(value.to_bytes((used + 7) // 8, "little"), 2, len(data)) == data


def frame(indices, left=0, top=0, disposal=1, clear=None, palette=None, interlaced=False, delay=5):
    h, w = indices.shape
    flags = (0x80 | 1 if palette else 0) | (0x40 if interlaced else 0)
    stored = indices[gif._interlaced(h)] if interlaced else indices
    return b"".join([
        b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0), b"\x2c", struct.pack("<HHHHB", left, top, w, h, flags), palette or b"",
        b"\x02", gif._blocks(gif.pack_codes(gif.lzw_codes(stored.tobytes(), 2), 2)),
    ])


def test_disposal_transparency_palettes_and_interlacing():
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    red, green, blue = 0xFF0000FF, 0x00FF00FF, 0x0000FFFF
    full = np.zeros((10, 4), np.uint8)
    full[3] = 1
    dot = np.array([[2, 3]], np.uint8)
    body = [
        frame(full, interlaced=True), frame(dot, 1, 1, disposal=3, clear=3), frame(dot, 0, 0, disposal=2),
        frame(dot, 2, 2, palette=bytes([1, 2, 3] * 4)), frame(np.full((1, 1), 3, np.uint8), clear=3),
    ]
    data = b"GIF89a" + struct.pack("<HHBBB", 4, 10, 0x81, 0, 0) + colours + b"\x21\xfe\x03abc\0" + b"".join(body) + b"\x3b"
    w, h, frames = gif.read_gif(data)
    a, b, c, d, e = (f["canvas"] for f in frames)
    assert (w, h, len(frames)) == (4, 10, 5) and [f["start_ms"] for f in frames] == [0, 50, 100, 150, 200]
    assert (a[3] == green).all() and (np.delete(a, 3, axis=0) == red).all()
    assert b[1, 1] == blue and b[1, 2] == red  # the second index is transparent
    assert c[1, 1] == red and c[0, 0] == blue and c[0, 1] == 0x090909FF  # the frame before is taken back
    assert d[0, 0] == d[0, 1] == 0 and d[2, 2] == 0x010203FF  # cleared; a palette of its own
    assert (e == d).all() and gif.histogram(d)[64] == 2


def test_damaged_files():
    good = gif.write_gif(b"x" * 192)
    for bad in (b"", b"PNG", good[:20], good[:-30], good[:13] + b"\x00" * 30):
        with pytest.raises(ValueError):
            gif.read_gif(bad)


def plain_gif_pixels(data):
    """Stored pixels of all frames of a GIF file, by a decoder that takes one code after the other."""
    at = 13 + 3 * (2 << (data[10] & 7)) * (data[10] >> 7)
    pixels = bytearray()
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            at += 10 + 1
            bits = data[at - 1]
        body = bytearray()
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if body[:1] and not (len(body) == 4 or body[:11] == b"NETSCAPE2.0") and bits:
            clear, width, table, before, held, n = 1 << bits, bits + 1, [], None, 0, 0
            for byte in body:
                held |= byte << n
                n += 8
                while n >= width:
                    code, held, n = held & (1 << width) - 1, held >> width, n - width
                    if code == clear:
                        table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
                        continue
                    if code == clear + 1:
                        break
                    entry = table[code] if code < len(table) else before + before[:1]
                    pixels += entry
                    if before is not None and len(table) < 4096:
                        table.append(before + entry[:1])
                    before = entry
                    if len(table) == 1 << width and width < 12:
                        width += 1
    return bytes(pixels)


def test_op1_columns(spark, data):
    from hashlib import sha256

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = llm.op1_gif(spark, data).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = texts[r["doc_id"]]
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = gif.write_gif(want)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), sha256(media).hexdigest())
        frames = gif.read_gif(media)[2]
        assert r["feature"].startswith(f"frames={len(frames)};ms={10 * gif.DELAY * len(frames)};hist=")
    for raw in sorted(texts.values(), key=len)[::20]:
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert plain_gif_pixels(gif.write_gif(want)) == want


def test_op1_edges(spark, docs):
    from pyspark.sql import functions as F

    d = docs([(1, None), (2, ""), (3, "same"), (3, "same"), (4, "x" * 3_000_000)]).withColumns({c: F.lit("mine") for c in ("media", "samples", "frames", "n_bytes")})
    out = rows(gif.decode(gif.store(d)), "doc_id", "n_bytes")
    assert out == [(1, 0), (2, 0), (3, 4), (3, 4), (4, 3_000_000)]
    assert gif.decode(gif.store(docs([]))).count() == 0


def test_gif_feature_is_of_all_frames(spark, docs, tmp_path):
    """Long texts of one length that differ before their last frame only."""
    end = "the same end " * 1000
    docs(["a" * 20_000 + end, "b" * 20_000 + end]).write.parquet(str(tmp_path / "documents.parquet"))
    a, b = llm.op1_gif(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert a["feature"] != b["feature"] and a["payload_bytes"] == b["payload_bytes"]
    frames = gif.decode(gif.store(docs(["a" * 20_000 + end]))).first()["frames"]
    sums = [sum(x) for x in zip(*[f["histogram"] for f in frames])]
    assert len(frames) > 1 and a["feature"].endswith("hist=" + ",".join(map(str, sums)))


def reference_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts(real):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "a", "B", "é", "½", "3", "'s", "!", "...", "\xa0", "　", "\x1c", "\0", "日本", "<|endoftext|>", "\r\n", "word,", "Word."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + [r["text"] for r in real.select("text").limit(60).collect()]
    tok = packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, np.uint16).tolist() for x in tok(texts)] == reference_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((n for n, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
        if b == len(bins):
            bins.append(0)
        want[i] = (b, bins[b])
        bins[b] += sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(len(sizes))]


def test_packing(spark, docs):
    rng = random.Random(4)
    texts = [None, "", "a", "word " * 3000, *(" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 900))) for _ in range(60))]
    pairs = [*enumerate(texts), (2, "a"), (None, "b")]
    out = packing.pack(docs(pairs), public_tokenizers.path("byte_bpe_50k.json"), 256).collect()
    ids = dict(zip(texts, reference_ids([t or "" for t in texts])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) // 4 <= 256
    for i, t in enumerate(texts):
        if i != 2:
            pieces = sorted(by_doc[i], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(bytes(p["ids"]) for p in pieces), "<u4").tolist() == [*ids[t], 1]
            assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    assert len(by_doc[2]) == 2 and len(by_doc[None]) == 1
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and {p["padded_to"] for p in pieces} == {at if at & (at - 1) == 0 else 256}
    assert sum(r["length"] for r in out) / (256 * len(by_sequence)) > 0.95
    assert packing.pack(docs([]), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_targets_by_resharing(spark):
    rng = random.Random(6)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(11)} | {None: 77}
    names = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = Fraction(sum(sizes.values())), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            free.discard(s)
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert got == pytest.approx({s: float(t) for s, t in target.items()})


def test_mixing(spark, docs):
    d = docs([(i, "w " * (i % 40)) for i in range(400)]).unionByName(docs([(i, "w " * 10) for i in range(1000, 1050)], source=None)).unionByName(docs([(2000, None)], source="t"))
    out = mixing.mix(d)
    held = out.collect()
    assert sorted(mixing.mix(d).select("doc_id", "copies").collect()) == sorted(out.select("doc_id", "copies").collect())
    for s in ("s", None, "t"):
        own = [r for r in held if r["source"] == s]
        target, size = own[0]["target"], own[0]["source_size"]
        assert all(r["copies"] <= 3 for r in own) and size == sum(len(brute.words(r["text"])) for r in own)
        assert abs(sum(r["size"] * r["copies"] for r in own) - target) <= 0.15 * target
    assert mixing.emit(out).count() == sum(r["copies"] for r in held)
    assert mixing.mix(docs([])).count() == 0 and rows(mixing.mix(docs([(1, "")])), "copies") == [(0,)]


def test_pieces_are_encoded_as_the_tokenizer_does():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, piece, rng = Tokenizer.from_file(path), packing.piece_encoder(path), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEéüßñçøłжшд中文字日本ا한글"
    words = [rng.choice(["", " "]) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    assert [piece(w.encode()) for w in words] == [x.ids for x in tok.encode_batch(words, add_special_tokens=False)]
    assert packing.piece_encoder(public_tokenizers.path("word_bpe_49k.json")) is None


_PACKS_MUCH = """
import pickle, random, re, sys
import pyarrow as pa
from tidelog.llm import packing

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) / 1024

with open(sys.argv[1], "rb") as f:
    fn = pickle.load(f)
packing.tokenizer(sys.argv[2])
rng, letters = random.Random(1), "abcdefghijklmnopqrstuvwxyz"
words = ["".join(rng.choices(letters, k=8)) for _ in range(400_000)]

def batches():
    for k in range(2):
        texts = [" ".join(rng.choices(words, k=300)) for _ in range(2500)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts), pa.array(range(2500))], ["doc_id", "text", "row"])

before, rows = held(), 0
for b in fn(batches()):
    rows += b.num_rows
del b
print(rows, held() - before)
"""


def test_a_worker_gives_back_what_packing_took(docs, monkeypatch, tmp_path):
    """Workers outlive a task; what they still hold afterwards stands beside the executor's heap in every later one."""
    import subprocess
    import sys
    from pathlib import Path

    import pytest
    from pyspark import cloudpickle

    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    frame, path, taken = docs([]), public_tokenizers.path("byte_bpe_50k.json"), []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, fn, schema: taken.append(fn) or self)
    packing.pieces(frame, path)
    (tmp_path / "fn").write_bytes(cloudpickle.dumps(taken[0]))
    out = subprocess.run([sys.executable, "-c", _PACKS_MUCH, tmp_path / "fn", path], cwd=Path(packing.__file__).parents[2], capture_output=True, text=True, check=True)
    rows, mb = out.stdout.split()
    assert int(rows) == 5000 and float(mb) < 60, mb
