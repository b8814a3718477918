"""Quality classifier: regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics (logs of counts, smoothed logits of shares). Class means and
covariances come from sums over all labelled training rows, added up by Spark; each covariance is shrunk towards the
pooled one and that towards its mean variance. The score is the logistic of the difference of the classes' log
densities and priors, with Mahalanobis distances from Cholesky factors that are computed once and sent with the model. The zero of the gap is set where it parts the training rows best.

The driver holds sums of a fixed size only. Texts are never shuffled: statistics are joined to the labels.

Defined cases: null text counts as empty, and the empty text has a vector like any other; labels that are null or for
no document are not used, repeated ones count each time; without labels of both classes every score is the share of
label 1, or 0.5 without any; repeated rows score alike; other columns pass through score().
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.llm import common

#: Weight of the pooled covariance in a class's, and of the mean variance in both.
TO_POOLED, TO_SPHERE = 0.15, 0.02
#: Standardised statistics are held within this many deviations.
REACH = 8.0
SIZE = 17

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 other ASCII signs, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 6
for _c in b".,;:'-":
    _KIND[_c] = 5
_KIND[[32, 9, 10, 11, 12, 13]] = 4


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The vector of one text."""
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=8)
    words, starts, ends = common.word_hashes(text)
    m = len(words)
    lengths = ends - starts
    letters = kinds[1] + kinds[2] + kinds[7]
    p = by_byte[by_byte > 0] / max(n, 1)
    lines = text.split(b"\n")
    odd_ends = int(np.count_nonzero(_KIND[raw[ends - 1]] == 6)) if m else 0
    long_ends = int(np.count_nonzero((lengths > 1) & (_KIND[raw[ends - 2]] == 6))) if m else 0
    triples = common.run_hashes(words, 3)
    return [
        np.log1p(n), np.log1p(m), float(lengths.mean()) if m else 0.0, float(np.log1p(lengths.std())) if m else 0.0,
        _logit(kinds[2], letters), _logit(kinds[3], n), _logit(kinds[5], n), _logit(kinds[6], n), _logit(kinds[4], n),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        _logit(len(np.unique(words)), m), _logit(len(np.unique(triples)), len(triples)),
        _logit(len(set(lines)), len(lines)), np.log1p(len(lines)), _logit(odd_ends, m), _logit(long_ends, m),
        _logit(int(by_byte.max()), n),
    ]


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([statistics(x) for x in common.blobs(batch.column(column))], np.float64).reshape(-1, SIZE)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.small_batches(whole, 1):
            x = _vectors(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(SIZE)]], ["doc_id", *[f"x{i}" for i in range(SIZE)]])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x0, x1, ... of every row."""
    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _measure, "doc_id long, " + ", ".join(f"x{i} double" for i in range(SIZE)))


@dataclasses.dataclass
class Model:
    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None  # inverses of the Cholesky factors
    logdets: list[float] | None = None
    shift: float = 0.0

    def gaps(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -REACH, REACH)
        d = [-0.5 * (np.square((z - m) @ f.T).sum(axis=1) + ld) for m, f, ld in zip(self.means, self.factors, self.logdets)]
        return d[1] - d[0] + np.log(self.prior / (1 - self.prior))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.gaps(x) - self.shift, -500, 500)))


#: Labelled ids that are broadcast (eight bytes each).
BROADCAST = 300_000


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of the labelled rows, as fit takes them; of all rows where the labels are too many to broadcast."""
    ids = common.materialise(labels.select(F.col("doc_id").cast("long").alias("_labelled")).distinct(), "labelled")
    if ids.count() <= BROADCAST:
        docs = docs.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("_labelled"), "left_semi")
    return common.materialise(features(docs), "quality")


def fit(feats: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """labels: doc_id and the column, the training rows only."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).where("label in (0, 1)")
    both = feats.join(labels, "doc_id")
    xs = [F.col(f"x{i}") for i in range(SIZE)]
    pairs = [(i, j) for i in range(SIZE) for j in range(i + 1)]
    found = {r["label"]: r for r in both.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in xs]).alias("s"), F.array(*[F.sum(xs[i] * xs[j]) for i, j in pairs]).alias("ss")).collect()}
    n = np.array([found[k]["n"] if k in found else 0 for k in (0, 1)], float)
    if not n.all():
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5)
    sums = [np.array(found[k]["s"]) for k in (0, 1)]
    squares = []
    for k in (0, 1):
        a = np.zeros((SIZE, SIZE))
        for (i, j), v in zip(pairs, found[k]["ss"]):
            a[i, j] = a[j, i] = v
        squares.append(a)
    centre = sum(sums) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(sum(squares)) / n.sum() - centre**2, 1e-6))
    means = [s / c for s, c in zip(sums, n)]
    covs = [(q / c - np.outer(m, m)) / np.outer(scale, scale) for q, c, m in zip(squares, n, means)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors, logdets = [], []
    for cov in covs:
        s = (1 - TO_POOLED) * cov + TO_POOLED * pooled
        s = (1 - TO_SPHERE) * s + TO_SPHERE * (np.trace(s) / SIZE) * np.eye(SIZE) + 1e-9 * np.eye(SIZE)
        chol = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(chol))
        logdets.append(float(2 * np.log(np.diag(chol)).sum()))
    model = Model(float(n[1] / n.sum()), centre, scale, [(m - centre) / scale for m in means], factors, logdets)
    model.shift = _best_shift(both, model)
    return model


def _columns(b: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([b.column(i + first).to_numpy(zero_copy_only=False) for i in range(SIZE)]) if b.num_rows else np.empty((0, SIZE))


def _best_shift(both: DataFrame, model: Model, step: float = 0.5, most: float = 200.0) -> float:
    """The gap between the classes' log densities that parts the training rows with the fewest errors; the middle of
    the best ones. Counted in steps, so the driver gets a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.round(np.clip(model.gaps(_columns(b, 1)), -most, most) / step).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at)], ["label", "at"])

    rows = common.map_arrow(both.select("label", *[f"x{i}" for i in range(SIZE)]), run, "label int, at long").groupBy("label", "at").count().collect()
    half = int(most / step)
    counts = np.zeros((2, 2 * half + 1))
    for r in rows:
        counts[r["label"], r["at"] + half] = r["count"]
    wrong = np.concatenate([[0], np.cumsum(counts[1])]) + np.concatenate([[0], np.cumsum(counts[0])])[-1] - np.concatenate([[0], np.cumsum(counts[0])])
    best = np.flatnonzero(wrong == wrong.min())
    return float((np.median(best) - half - 0.5) * step)


def score_features(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_columns(b, 1)))], ["doc_id", "score"])

    return common.map_arrow(feats, run, "doc_id long, score double")


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column of scores, in place of one of its name."""
    docs = docs.drop(column)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.small_batches(whole, at):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(_vectors(b, at)))], [*b.schema.names, column])

    return common.map_arrow(docs, run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
