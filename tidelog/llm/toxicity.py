"""Toxicity by compression distance: zstandard with a dictionary from toxic text against one from ordinary text.

Both dictionaries are trained by zstandard's cover algorithm, apart, on windows of toxic and of ordinary training texts.
What the toxic one has learnt from the ordinary words around drowns the signal (tried first: area under the curve 0.65
to 0.75 on held-out rows), so it is pruned by measured lengths: it is cut into overlapping pieces of PIECE bytes, and a
piece stays if the windows that it shortens, put before the ordinary dictionary, are TIMES as frequent among toxic
windows as among ordinary ones. The distance of a window is its length under the ordinary dictionary less that under
the pruned toxic one and the ordinary one together, in bytes; windows are whole words of up to WINDOW bytes. How many
windows of a text reach each of the thresholds GAINS, and which share, goes into a logistic regression, fitted on the
training rows, that calibrates the score.

Training uses at most TOXIC + ORDINARY labelled rows, those with the least hash of doc_id; of their windows, distinct
ones, the TRAINED of each class with the least hash train the dictionaries, and MEASURED of these measure the pieces.
This bounded sample is all that is broadcast or collected. Scoring reads every row and whole text once and moves
nothing between tasks.

Defined cases: null text counts as empty, and texts without words score by the regression with no window; null labels
and labels of no document are not used; without labels of both classes every score is the share of label 1, or 0.5
without any; repeated texts count once in the numbers of windows; repeated rows score alike; words longer than a window
are cut; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

#: Bounds of the training sample: labelled rows, windows of each class, and those of them that measure pieces.
TOXIC, ORDINARY, TRAINED, MEASURED = 4000, 8000, 60_000, 20_000
WINDOW, PIECE, STEP = 64, 12, 6
#: Bytes of the dictionaries, and the trainer's segments.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, DMER = 32 << 10, 32 << 10, 12, 6
#: A piece stays if so many times as many toxic windows as ordinary ones become SAVED bytes shorter by it, of equal
#: numbers, and at least LEAST or one in RARE of the toxic ones.
TIMES, SAVED, LEAST, RARE = 4.0, 2, 4, 2000
LEVEL, GRAM = 15, 5
GAINS = (1, 2, 3, 4, 6)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def windows(text: bytes) -> list[bytes]:
    """The words of a text in windows of at most WINDOW bytes, with a space before and after."""
    t, at, out = b" ".join(text.translate(_FOLD).split()), 0, []
    while at < len(t):
        end = len(t) if len(t) - at <= WINDOW else t.rfind(b" ", at, at + WINDOW + 1)
        if end <= at:
            end = at + WINDOW
        out.append(b" " + t[at:end] + b" ")
        at = end + (t[end : end + 1] == b" ")
    return out


def coder(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


def lengths(c: zstandard.ZstdCompressor, ws: list[bytes]) -> np.ndarray:
    return np.fromiter((len(c.compress(w)) for w in ws), np.int64, len(ws))


def trained(ws: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the windows."""
    try:
        return zstandard.train_dictionary(size, ws, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(ws)[-size:]


class Gains:
    """Bytes that the toxic dictionary saves in each window."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary = coder(ordinary)
        self.both = coder(toxic + ordinary)

    def of(self, ws: list[bytes]) -> np.ndarray:
        return lengths(self.ordinary, ws) - lengths(self.both, ws)

    def vector(self, text: bytes) -> list[float]:
        """What the regression sees of a text."""
        g = self.of(windows(text))
        counts = [int((g >= x).sum()) for x in GAINS]
        return [*[float(np.log1p(c)) for c in counts], *[c / (len(g) + 10) for c in counts], float(np.log1p(len(g)))]


class Measure:
    """Windows that a piece shortens, found among those that share GRAM bytes with it."""

    def __init__(self, ws: list[bytes], ordinary: bytes) -> None:
        self.ws, self.plain = ws, lengths(coder(ordinary), ws)
        grams = [self.grams(w) for w in ws]
        found = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(found, kind="stable")
        self.found, self.at = found[order], np.repeat(np.arange(len(ws)), [len(g) for g in grams])[order]

    @staticmethod
    def grams(w: bytes) -> np.ndarray:
        raw = np.frombuffer(w, np.uint8).astype(np.uint64)
        n = max(0, len(raw) - GRAM + 1)
        return np.sum([raw[k : k + n] << np.uint64(8 * k) for k in range(GRAM)], axis=0, dtype=np.uint64)

    def shortened(self, piece: bytes, both: zstandard.ZstdCompressor) -> int:
        g = self.grams(piece)
        ranges = zip(np.searchsorted(self.found, g), np.searchsorted(self.found, g, side="right"))
        near = np.unique(np.concatenate([self.at[lo:hi] for lo, hi in ranges]))
        return sum(self.plain[i] - len(both.compress(self.ws[i])) >= SAVED for i in near.tolist())


@dataclasses.dataclass
class Model:
    prior: float
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -500, 500)))


_OPEN: dict[tuple[bytes, bytes], Gains] = {}


def gains(model: Model) -> Gains:
    """One for each worker and model."""
    key = (model.ordinary, model.toxic)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Gains(*key)
    return _OPEN[key]


def _sample(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    labels = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = labels.where("label = 1").orderBy(*order).limit(TOXIC).unionByName(labels.where("label = 0").orderBy(*order).limit(ORDINARY))
    chosen = common.materialise(chosen, "toxicity-sample")
    # at most TOXIC + ORDINARY rows of two numbers
    both = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    return common.materialise(both, "toxicity-texts")


def _windows(sample: DataFrame, label: int) -> list[bytes]:
    """Distinct windows of the texts of a class: the TRAINED with the least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, 0):
                yield pa.RecordBatch.from_arrays([pa.array([w for t in common.blobs(b.column(0)) for w in windows(t)], pa.binary())], ["w"])

    found = common.map_arrow(sample.where(F.col("label") == label).select("text"), run, "w binary").distinct()
    return [bytes(r["w"]) for r in found.orderBy(F.xxhash64("w"), "w").limit(TRAINED).collect()]


def _pruned(spark: SparkSession, content: bytes, ordinary: bytes, toxic_windows: list[bytes], ordinary_windows: list[bytes]) -> bytes:
    """The pieces of a toxic dictionary that toxic windows use and ordinary ones don't, the most telling last."""
    ones, zeros = toxic_windows[:MEASURED], ordinary_windows[:MEASURED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = None
        for b in batches:
            measures = measures or (Measure(ones, ordinary), Measure(zeros, ordinary))
            pieces, a, c = b.column(0).to_pylist(), [], []
            for p in pieces:
                both = coder(p + ordinary)
                a.append(int(measures[0].shortened(p, both)))
                c.append(int(measures[1].shortened(p, both)) if a[-1] >= max(LEAST, len(ones) / RARE) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["piece", "toxic", "ordinary"])

    pieces = sorted({content[i : i + PIECE] for i in range(0, len(content) - PIECE + 1, STEP)})
    if not pieces:
        return b""
    dealt = spark.createDataFrame([(bytearray(p),) for p in pieces], "piece binary").repartition(max(1, len(pieces) // 300))
    rows = common.map_arrow(dealt, run, "piece binary, toxic long, ordinary long").collect()
    found = [((r["toxic"] / len(ones)) / ((r["ordinary"] + 0.5) / len(zeros)), bytes(r["piece"])) for r in rows if r["toxic"] >= max(LEAST, len(ones) / RARE)]
    return b"".join(p for ratio, p in sorted(found) if ratio >= TIMES)


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spread = x.std(0)
    centre, scale = x.mean(0), np.where(spread > 1e-6, spread, np.inf)  # what never varies says nothing
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w, hold = np.zeros(z.shape[1]), ridge * weight.sum() / 1000 * np.eye(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + hold, z.T @ (weight * (y - p)) - hold @ w)
        w += np.clip(step, -5, 5)
    return w, centre, scale


def _vectors(model: Model, texts: list[bytes]) -> np.ndarray:
    g = gains(model)
    return np.array([g.vector(t) for t in texts], float).reshape(len(texts), -1)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """labels: doc_id and the column, the training rows only."""
    total = {r["label"]: r["count"] for r in labels.select(F.col(column).cast("int").alias("label")).where("label in (0, 1)").groupBy("label").count().collect()}
    n = float(sum(total.values()))
    model = Model(total.get(1, 0) / n if n else 0.5)
    sample = _sample(docs, labels, column)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return model
    ones, zeros = _windows(sample, 1), _windows(sample, 0)
    if not ones or not zeros:
        return model
    model.ordinary = trained(zeros, ORDINARY_BYTES)
    model.toxic = _pruned(docs.sparkSession, trained(ones, TOXIC_BYTES), model.ordinary, ones, zeros)
    held = Model(model.prior, model.ordinary, model.toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_vectors(held, common.blobs(b.column(1))).tolist(), pa.list_(pa.float64()))], ["label", "x"])

    rows = common.map_arrow(sample.select("label", "text"), run, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    y = np.array([r["label"] for r in rows], float)
    weight = np.where(y == 1, total[1] / counts[1], total[0] / counts[0])
    model.weights, model.centre, model.scale = _regression(np.array([r["x"] for r in rows]), y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, 1):
                found = _vectors(model, common.blobs(b.column(1))) if model.weights is not None else np.empty((b.num_rows, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(found))], ["doc_id", "score"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
