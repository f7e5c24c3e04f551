"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each text gives a vector of statistics of its whole text (shares of character classes, word and line repetition, word
shapes), square-rooted or logged so that classes are nearer to normal. The class means and covariances come from sums over
all labelled training rows, made on the executors; covariances are shrunk towards the pooled one, and that towards the
identity, by shares estimated from the rows, and their Cholesky factors are inverted once. A score is the log density
difference of the two classes by Mahalanobis distance, made a probability by a logistic fit over the training rows' binned
evidence.

Defined cases: null text counts as empty and has a score; very long texts are read whole, one at a time; one labelled row of
each class is enough for a model, and only where a class has none is every score 1; labels that repeat or contradict each
other count once each; repeated documents get the same score each, null ids are scored too (a null id falls in the fold of the
empty text, and has no label); equal scores need no order; an empty table gives no rows; other columns are ignored by
quality_scores and kept by keep_good.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import claim, crc_mod, materialise, release, ship, slices

THRESHOLD = 0.3
#: The least shares of the pooled covariance and of the identity in a class's covariance.
POOL, RIDGE = 0.1, 0.02
#: Width of the bins of evidence for the logistic fit.
BIN = 0.05
#: Added to counts of bytes and words, so that a short text is not an outlier by its length alone.
PRIOR_BYTES, PRIOR_WORDS = 60, 10
NAMES = ["words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "commas", "non_ascii", "distinct", "repeats", "dup_lines", "line_words", "long_words", "short_words", "dup_windows"]
DIM = len(NAMES)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".?", b",;:"], 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
_UPPER = re.compile("[À-ÖØ-Þ]")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw) + PRIOR_BYTES
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    if share[7]:
        share[1] += len(_UPPER.findall(text)) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, words), np.int64, n)
    m = n + PRIOR_WORDS
    triples = len(set(zip(words, words[1:], words[2:])))
    return np.array(
        [
            math.log(m), math.log((lens.sum() + 5 * PRIOR_WORDS) / m), *np.sqrt(share[1:8]),
            math.log(len(set(words)) + PRIOR_WORDS) / math.log(m), math.sqrt(sum(map(bytes.__eq__, words, words[1:])) / m),
            math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 2)), math.log(m / (len(lines) + 2)),
            math.sqrt((lens > 12).sum() / m), math.sqrt((lens < 4).sum() / m), math.sqrt((max(0, n - 2) - triples) / m),
        ]
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("quality_classifier")
    for b in slices(batches):
        x = [statistics(t.as_py()) for t in b.column(1)]
        if x:
            off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * DIM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(np.concatenate(x)))], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), DIM)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class: the number of rows, and the sums of x and of its products."""
    sums = np.zeros((2, 1 + DIM + DIM * DIM))
    for b in batches:
        x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    n = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n).astype(np.int32)), pa.array(np.tile(np.arange(n), 2).astype(np.int32)), pa.array(sums.ravel())], names=["k", "i", "s"])


def shrinkage(cov: np.ndarray, n: float, target: np.ndarray) -> float:
    """The share of target in the covariance of n rows that has the least expected squared error if rows are normal:
    the error of cov by its own traces over its squared distance from target. A single row has no covariance of its own."""
    error = (np.trace(cov @ cov) + np.trace(cov) ** 2) / (n - 1) if n > 1 else math.inf
    distance = ((cov - target) ** 2).sum()
    return 1.0 if error >= distance else float(error / distance)


class Model:
    """Means, inverted Cholesky factors, log determinants and the logistic fit (slope, shift).

    Covariances are taken in units of the pooled deviations (one row of unit variance added). The pooled one is shrunk towards
    the identity and each class's towards the pooled one, by shares estimated from the rows: near 1 for a class of a few rows,
    so that any two classes give a model, and near POOL and 0 for large ones. RIDGE of the identity is always added.
    """

    def __init__(self, sums: np.ndarray):
        n = sums[:, 0]
        self.known = bool((n > 0).all())
        if not self.known:
            return
        self.mean = sums[:, 1 : 1 + DIM] / n[:, None]
        cov = [s[1 + DIM :].reshape(DIM, DIM) / c - np.outer(m, m) for s, c, m in zip(sums, n, self.mean)]
        eye = np.eye(DIM)
        pooled = (n[0] * cov[0] + n[1] * cov[1] + eye) / n.sum()
        unit = np.sqrt(np.outer(np.diag(pooled), np.diag(pooled)))
        pooled = pooled / unit
        share = shrinkage(pooled, n.sum(), eye)
        pooled = (1 - share) * pooled + share * eye
        self.factor, self.det = [], []
        for c, k in zip(cov, n):
            share = POOL + (1 - POOL) * shrinkage(c / unit, k, pooled)
            c = (1 - RIDGE) * ((1 - share) * c / unit + share * pooled) + RIDGE * eye
            chol = np.linalg.cholesky(c * unit)
            self.factor.append(np.linalg.inv(chol))
            self.det.append(2 * np.log(np.diag(chol)).sum())
        self.prior = math.log(n[1] / n[0])
        self.slope, self.shift = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The log density of class 1 less that of class 0, priors included."""
        d = [((x - m) @ f.T) for m, f in zip(self.mean, self.factor)]
        return 0.5 * ((d[0] ** 2).sum(1) + self.det[0] - (d[1] ** 2).sum(1) - self.det[1]) + self.prior

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The difference with its tails drawn in: densities far from both means differ by hundreds, which no odds bear out."""
        return np.arcsinh(self.difference(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.ones(len(x))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(x) + self.shift, -600, 600)))

    def calibrate(self, bins: list[tuple[float, float, float]]) -> None:
        """A logistic fit to rows (evidence, rows of class 1, rows) by Newton's steps, each halved until the penalised log
        likelihood does not fall. A class of k rows aims at probability (k + 1) / (k + 2), so that separable ones fit too."""
        d, pos, n = np.array(bins).T
        ones, zeros = pos.sum(), (n - pos).sum()
        pos = pos * (ones + 1) / (ones + 2) + (n - pos) / (zeros + 2)
        z = np.stack([d, np.ones_like(d)])

        def gain(a):
            u = a @ z
            return (pos * u - n * np.logaddexp(0, u)).sum() - 5e-4 * a @ a

        a = np.array([0.1, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ z, -500, 500)))
            step = np.linalg.solve((z * (n * p * (1 - p))) @ z.T + 1e-3 * np.eye(2), z @ (pos - n * p) - 1e-3 * a)
            size = 1.0
            while gain(a + size * step) < gain(a) and size > 1e-6:
                size /= 2
            a = a + size * step
            if np.abs(size * step).max() < 1e-9:
                break
        if a[0] > 0:
            self.slope, self.shift = float(a[0]), float(a[1])


def fit(train: DataFrame) -> Model:
    """A model of all rows of train (x, y); only sums of fixed size reach the driver."""
    sums = np.zeros((2, 1 + DIM + DIM * DIM))
    for r in train.select("x", "y").mapInArrow(_moments, "k int, i int, s double").groupBy("k", "i").agg(F.sum("s").alias("s")).collect():
        sums[r.k, r.i] = r.s
    model = Model(sums)
    if model.known:

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.round(model.evidence(_matrix(b.column(0))) / BIN).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1).cast(pa.int64())], names=["bin", "y"])

        bins = train.select("x", "y").mapInArrow(binned, "bin int, y long").groupBy("bin").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()
        model.calibrate([(r.bin * BIN, float(r.pos), float(r.n)) for r in bins])
    return model


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    return run


def train_rows(feats: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The labelled rows outside the held-out fold (remainder 0): x, y."""
    y = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    return feats.join(y, "doc_id").where(crc_mod(F.col("doc_id"), folds) != 0).select("x", "y")


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the transformed statistics."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, held_out, score and predicted."""
    feats = materialise(document_statistics(docs), "quality-statistics")
    model = fit(train_rows(feats, labels, folds))
    out = feats.mapInArrow(_score_batches(model), "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts; its training rows are docs' own."""
    feats = materialise(document_statistics(docs).join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), "quality-statistics")
    model = fit(train_rows(feats, labels, folds))
    release(feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality_classifier")
        for b in slices(batches):
            if b.num_rows:
                x = np.stack([statistics(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
