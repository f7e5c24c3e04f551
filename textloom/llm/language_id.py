"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

A text's features are hashed counts of its letters' byte n-grams (one to three bytes, word breaks included), square-rooted
and scaled to length 1. Machines are trained by dual coordinate descent on a sample of at most SAMPLE documents of each
language, whole texts, chosen by a hash of the id; every learned language takes part, however many those are.

* Families are told apart by one machine each, its own languages' sample against a sample of at most OTHERS documents of all
  other families. The number of machines grows with the languages, not with their square.
* Inside a family, which has a fixed list of codes, there is a machine for each pair of languages; most votes win. A code on no
  list is a family of its own.

Each machine is trained by one task on the executors, from at most SAMPLE rows a language and OTHERS more. The machines'
weights (16 KB each) are all that the driver collects and broadcasts. A score is the product of the two steps' logistic margins.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without training rows every text is ``und``; with
one language, that one has score 1; equal margins or votes go to the code that sorts first; very long texts are read whole;
repeated rows each get their row, and each can be in the sample; a null id falls in the fold of the empty text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._common import crc_mod, materialise, release, ship, slices

DIM = 4096
#: Training documents of each language, and of all other families against one.
SAMPLE, OTHERS = 400, 2000
#: Groups of scan partitions that a language's rows are cut in first, so that a language of any size never meets in one task.
GROUPS = 64
#: Language families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no is af", "romance": "fr es it pt ro ca gl", "slavic": "ru uk pl cs sk bg sr hr sl", "uralic": "fi et hu", "indic": "hi bn mr ur pa", "semitic": "ar he"}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: ASCII other than letters becomes a space.
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """The hashed n-gram vector of a whole text, of length 1 (0 without letters)."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    h = np.concatenate([b, two + np.uint32(1 << 25), three + np.uint32(1 << 26)]) * np.uint32(2654435761)
    x = np.sqrt(np.bincount(h >> np.uint32(20), minlength=DIM)).astype(np.float32)
    n = float(np.linalg.norm(x))
    return x / n if n else x


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last one for a constant 1) of an L2-loss linear machine for labels -1 and 1, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x * x).sum(1) + 0.5 / c
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + a[i] * 0.5 / c
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-3:
            break
    return w


def machine(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """The weights that tell the rows of yes (margin above 0) from those of no."""
    return svm(np.vstack([yes, no]), np.repeat([1.0, -1.0], [len(yes), len(no)])).astype(np.float32)


def logistic(margin: float) -> float:
    return 1 / (1 + math.exp(-2 * max(-30.0, min(30.0, margin))))


class Model:
    """Machines by name: (family, "", "") against all other families, and (family, a, b) for a before b within it."""

    def __init__(self, languages: dict[str, str], machines: dict[tuple[str, str, str], np.ndarray]):
        self.within: dict[str, list[str]] = {}
        for code, family in sorted(languages.items()):
            self.within.setdefault(family, []).append(code)
        self.families = sorted(self.within)
        stack = lambda names: np.stack([machines[n] for n in names]) if names else np.empty((0, DIM + 1), np.float32)
        self.first = stack([(f, "", "") for f in self.families] if len(self.families) > 1 else [])
        self.second = {f: stack([(f, a, b) for a, b in combinations(codes, 2)]) for f, codes in self.within.items()}

    def family(self, x: np.ndarray) -> tuple[str, float]:
        if not len(self.first):
            return self.families[0], 1.0
        m = self.first[:, :-1] @ x + self.first[:, -1]
        k = int(m.argmax())
        return self.families[k], logistic(float(m[k]))

    def language(self, family: str, x: np.ndarray) -> tuple[str, float]:
        """The language with most votes of the family's pairs; margins break ties."""
        codes, w = self.within[family], self.second[family]
        if not len(w):
            return codes[0], 1.0
        m = w[:, :-1] @ x + w[:, -1]
        pairs = list(combinations(range(len(codes)), 2))
        votes = np.zeros(len(codes))
        for (i, j), v in zip(pairs, m):
            votes[i if v >= 0 else j] += 1
            votes[i] += 1e-3 * math.tanh(v)
            votes[j] -= 1e-3 * math.tanh(v)
        k = int(votes.argmax())
        return codes[k], logistic(float(min(v if i == k else -v for (i, j), v in zip(pairs, m) if k in (i, j))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        x = features(text)
        f, p = self.family(x)
        lang, q = self.language(f, x)
        return lang, round(p * q, 9)


def sample(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """lang, u (the order within the language) and x (features) of at most SAMPLE training documents a language."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    d = d.withColumn("u", F.xxhash64("doc_id", F.lit("language-id")))
    # the last of each language's first SAMPLE hashes; the limit is taken before the shuffle, and texts stay out of it
    first = d.select("lang", "u", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):  # the second cut reads at most SAMPLE * GROUPS rows a language
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("u"))
        first = first.withColumn("place", place).where(F.col("place") <= SAMPLE).drop("place")
    last = first.groupBy("lang").agg(F.max("u").alias("last"))
    last = materialise(last, "language-limits")  # one row a language: Spark broadcasts it where its files are small
    some = d.join(last.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l")).where("u <= last")
    x = some.select("lang", "u", "text").mapInArrow(_sampled, "lang string, u long, x binary")
    # repeated ids tie in u: cut once more, by their features
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "x"))
    return x.withColumn("place", place).where(F.col("place") <= SAMPLE).select("lang", "u", "x")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = [features(t.as_py()).astype(np.float16).tobytes() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["lang", "u", "x"])


def _unpacked(x) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float16) for v in x]).astype(np.float32)


def _trainer(pool):
    """Trains one machine from its rows (family, a, b, lang, u, x): language a against b, or the family against the pool."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "u", "x"])
        family, a = rows["family"].iloc[0], rows["a"].iloc[0]
        if a:
            yes = (rows["lang"] == a).to_numpy()
            w = machine(_unpacked(rows["x"][yes]), _unpacked(rows["x"][~yes]))
        else:
            w = machine(_unpacked(rows["x"]), _unpacked([x for f, x in pool.value if f != family]))
        return rows.iloc[:1][["family", "a", "b"]].assign(w=[w.tobytes()])

    return train


def fit(docs: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Train on non-held-out documents."""
    spark = docs.sparkSession
    rows = materialise(sample(docs, folds, held), "language-sample")
    languages = {r.lang: FAMILY.get(r.lang, r.lang) for r in rows.select("lang").distinct().collect()}
    if len(languages) < 2:
        return Model(languages, {})
    rows_of = rows.join(spark.createDataFrame(list(languages.items()), "lang string, family string"), "lang")
    # the pool: of each family in turn one more row, up to OTHERS in all
    draw = F.xxhash64("lang", "u", F.lit("others"))
    turn = F.row_number().over(Window.partitionBy("family").orderBy(draw, "lang", "x"))
    pool = rows_of.withColumn("turn", turn).where(F.col("turn") <= OTHERS).orderBy("turn", draw, "lang", "x").limit(OTHERS)
    pool = spark.sparkContext.broadcast([(r.family, bytes(r.x)) for r in pool.select("family", "x").collect()])
    within: dict[str, list[str]] = {}
    for code in sorted(languages):
        within.setdefault(languages[code], []).append(code)
    parts = [(c, f, min(c, o), max(c, o)) for f, codes in within.items() for c in codes for o in codes if o != c]
    if len(within) > 1:
        parts += [(c, f, "", "") for c, f in languages.items()]
    jobs = rows.join(spark.createDataFrame(parts, "lang string, family string, a string, b string"), "lang")
    trained = jobs.select("family", "a", "b", "lang", "u", "x").groupBy("family", "a", "b").applyInPandas(_trainer(pool), "family string, a string, b string, w binary")
    machines = {(r.family, r.a, r.b): np.frombuffer(r.w, np.float32) for r in trained.toLocalIterator()}
    pool.destroy()
    release(rows)
    return Model(languages, machines)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred and score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, folds, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in slices(batches):
            out = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
