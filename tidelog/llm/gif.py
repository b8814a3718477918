"""GIF columns: payloads stored as 8-bit GIF files, and GIF files read into timed frames with colour histograms.

The reader decodes LZW code streams (growing codes, clear codes, tables that stay full), global and local palettes,
interlacing, transparency and the disposal rules, on a canvas as viewers compose it. The writer cuts a payload into
frames of at most 192 x 64 indices under one palette, each shown for 100 ms.

Everything is row by row, so nothing moves between tasks. Long texts become long files, with frames decoded one at
a time.

Defined cases: null text counts as empty and becomes one row of 192 spaces; repeated rows give equal files; a damaged
file raises ValueError; other columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

WIDTH, ROWS, DELAY = 192, 64, 10
TOP = 4096


def _code_widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first n codes after a clear code: a code may be as long as the table that its reader has by then."""
    free = np.arange(n) + (1 << bits) + 1
    free[:1] += 1
    return np.minimum(np.ceil(np.log2(free + 1)).astype(np.int64), 12)


_WIDTHS = {bits: _code_widths(TOP + 2, bits) for bits in range(2, 9)}
_OFFSETS = {bits: np.concatenate([[0], np.cumsum(w)]) for bits, w in _WIDTHS.items()}


def lzw_codes(data: bytes, bits: int) -> list[int]:
    """The codes of a stream, clear and end codes included."""
    clear = 1 << bits
    first = clear + 2
    codes = [clear]
    add = codes.append
    table: dict[int, int] = {}
    get, free = table.get, first
    it = iter(data)
    at = next(it, None)
    if at is not None:
        for c in it:
            key = at << 8 | c
            found = get(key)
            if found is not None:
                at = found
            else:
                add(at)
                table[key] = free
                free += 1
                at = c
                if free == TOP - 1:
                    add(clear)
                    table.clear()
                    free = first
        add(at)
    add(clear + 1)
    return codes


def pack_codes(codes: list[int], bits: int) -> bytes:
    """Codes as a bit stream, least significant bits first."""
    c = np.array(codes, np.int64)
    since = np.arange(len(c)) - np.maximum.accumulate(np.where(np.r_[True, c[:-1] == 1 << bits], np.arange(len(c)), 0))
    width = _WIDTHS[bits][since]
    at = np.concatenate([[0], np.cumsum(width)])
    v, byte = c << (at[:-1] & 7), at[:-1] >> 3
    size = int(at[-1] + 7) >> 3
    out = sum(np.bincount(byte + k, weights=(v >> (8 * k)) & 255, minlength=size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def unlzw(stream: bytes, bits: int, most: int) -> bytes:
    """The indices of a code stream, at most `most`.

    Up to the next clear code the places of the codes are known beforehand, so they are cut out of the stream at once.
    """
    clear, first = 1 << bits, (1 << bits) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    widths, offsets = _WIDTHS[bits], _OFFSETS[bits]
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    at, done, full, prev, table = 0, False, False, None, roots.copy()
    while not done and at < total:
        n = min(TOP, (total - at) // (12 if full else bits + 1) + 1)
        where = at + (np.arange(n) * 12 if full else offsets[:n])
        w = np.full(n, 12) if full else widths[:n]
        n = int(np.searchsorted(where + w, total, "right"))
        where, w = where[:n], w[:n]
        if not n:
            break
        b = where >> 3
        codes = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (where & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        ended = len(stop) > 0
        held = codes[: int(stop[0]) if ended else n].tolist()
        try:
            if prev is None and held:
                prev = table[held.pop(0)]
                put(prev)
            room = TOP - len(table)
            add = table.append
            for c in held[:room]:
                try:
                    s = table[c]
                except IndexError:
                    if c != len(table):
                        raise
                    s = prev + prev[:1]
                add(prev + s[:1])
                put(s)
                prev = s
            out += [table[c] for c in held[room:]]
        except IndexError as e:
            raise ValueError("a GIF code stream holds a code that is not in its table") from e
        if ended:
            k = int(stop[0])
            done = bool(codes[k] == clear + 1)
            at = int(where[k] + w[k])
            full, prev, table = False, None, roots.copy()
        else:
            at = int(where[-1] + w[-1])
            if n < TOP:
                break
            full = True
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def _palette() -> bytes:
    """Three bits of red and green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8).tobytes()


PALETTE = _palette()


def write_gif(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of 192 as a GIF file."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), PALETTE, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(pack_codes(lzw_codes(part, 8), 8))]
    return b"".join([*out, b"\x3b"])


def _interlaced(h: int) -> np.ndarray:
    """Row of the image that each stored row fills."""
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def screen(data: bytes) -> tuple[int, int, int]:
    """Width, height and flags."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF file")
    return struct.unpack_from("<HHB", data, 6)


def read_gif(data: bytes) -> tuple[int, int, list[dict]]:
    """Width, height and all frames, each with a canvas of its own."""
    return *screen(data)[:2], [f | {"canvas": f["canvas"].copy()} for f in frames_of(data)]


def frames_of(data: bytes) -> Iterator[dict]:
    """The frames, one at a time: place, indices as stored, palette, delay_ms, start_ms, disposal, transparent, and canvas,
    the 32-bit RGBA picture shown (alpha in the lowest byte, 0 where nothing has been drawn), which the next frame is
    drawn over."""
    width, height, flags = screen(data)
    at, whole = 13, None

    def colours(n: int) -> np.ndarray:
        nonlocal at
        p = np.zeros((256, 3), np.uint32)
        p[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
        return p[:, 0] << 24 | p[:, 1] << 16 | p[:, 2] << 8 | 255

    def chunks() -> bytes:
        nonlocal at
        parts = []
        while True:
            n = data[at]
            if not n:
                at += 1
                return b"".join(parts)
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    if flags & 0x80:
        whole = colours(2 << (flags & 7))
    canvas, now = np.zeros((height, width), np.uint32), 0
    disposal, delay, clear_index = 0, 0, None
    try:
        while True:
            kind = data[at]
            at += 1
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[at]
                at += 1
                body = chunks()
                if label == 0xF9:
                    f, delay, _ = struct.unpack("<BHB", body[:4])
                    disposal, clear_index = f >> 2 & 7, body[3] if f & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("a GIF file holds an unknown block")
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(2 << (f & 7)) if f & 0x80 else whole
            if palette is None:
                raise ValueError("a GIF frame has no palette")
            bits = data[at]
            at += 1
            plain = unlzw(chunks(), bits, w * h)
            if len(plain) < w * h:
                raise ValueError("a GIF frame is short of pixels")
            indices = np.frombuffer(plain, np.uint8).reshape(h, w)
            if f & 0x40:
                put = np.empty_like(indices)
                put[_interlaced(h)] = indices
                indices = put
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            seen = indices[: part.shape[0], : part.shape[1]]
            if clear_index is None:
                part[...] = palette[seen]
            else:
                np.copyto(part, palette[seen], where=seen != clear_index)
            yield {"left": left, "top": top, "width": w, "height": h, "indices": indices, "palette": palette, "delay_ms": delay * 10, "start_ms": now, "disposal": disposal, "transparent": clear_index, "canvas": canvas}
            now += delay * 10
            if disposal == 2:
                part[...] = 0
            elif disposal == 3:
                canvas = before
            disposal, delay, clear_index = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF file ends early") from e


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by two bits each of red, green and blue; those that are not drawn go into a 65th bin."""
    c = canvas.ravel()
    key = (c >> 30) << 4 | (c >> 22 & 3) << 2 | (c >> 14 & 3)
    return np.bincount(np.where(c & 255, key, 64), minlength=65)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as UTF-8, padded with spaces to a positive multiple of 192, as a GIF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, 1, 4 << 20):
                texts = common.blobs(b.column(1))
                media = [write_gif(t + b" " * (max(1, -(-len(t) // WIDTH)) * WIDTH - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


FRAME = pa.struct([("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))])


def decode(df: DataFrame) -> DataFrame:
    """df (doc_id, n_bytes, media) with samples, the stored indices of all frames in order, and frames, the timed
    frames with the histogram of the picture that each shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, 2, 2 << 20):
                samples, frames = [], []
                for data in b.column(2).to_pylist():
                    pixels, timed = bytearray(), []
                    for f in frames_of(data):
                        pixels += f["indices"].tobytes()
                        timed.append({k: f[k] for k in ("left", "top", "width", "height", "start_ms", "delay_ms", "disposal")} | {"histogram": histogram(f["canvas"]).tolist()})
                    samples.append(bytes(pixels))
                    frames.append(timed)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(samples, pa.binary()), pa.array(frames, pa.list_(FRAME))], [*b.schema.names, "samples", "frames"])

    return common.map_arrow(df, run, "doc_id long, n_bytes long, media binary, samples binary, frames array<struct<left int, top int, width int, height int, start_ms long, delay_ms long, disposal int, histogram array<long>>>")
