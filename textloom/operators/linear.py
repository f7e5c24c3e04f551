"""Representation analysis: CKA, effective rank, Procrustes, one-to-one assignment, noise and conditioning.

Products over rows are summed on the executors (d by d numbers a group); only those small matrices are decomposed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_products(df: DataFrame, x: str, y: str) -> dict[str, np.ndarray]:
    """n, sums and cross products of two vector columns, centred; partial sums are made in Arrow batches."""

    def run(parts):
        acc = None
        for p in parts:
            if len(p):
                a, b = np.stack(p["_x"].to_numpy()).astype(float), np.stack(p["_y"].to_numpy()).astype(float)
                one = [np.array([float(len(p))]), a.sum(0), b.sum(0), (a.T @ b).ravel(), (a.T @ a).ravel(), (b.T @ b).ravel()]
                acc = one if acc is None else [u + v for u, v in zip(acc, one)]
        if acc is not None:
            yield pd.DataFrame([(k, i, float(v)) for k, m in enumerate(acc) for i, v in enumerate(m)], columns=["k", "i", "v"])

    df = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = df.mapInPandas(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    got: dict[int, dict[int, float]] = {}
    for r in rows:
        got.setdefault(r["k"], {})[r["i"]] = r["v"]
    vec = lambda k: np.array([got[k][i] for i in range(len(got[k]))])
    n, sx, sy = vec(0)[0], vec(1), vec(2)
    dx, dy = len(sx), len(sy)
    return {
        "n": n, "mx": sx / n, "my": sy / n, "xy": vec(3).reshape(dx, dy) - np.outer(sx, sy) / n,
        "xx": vec(4).reshape(dx, dx) - np.outer(sx, sx) / n, "yy": vec(5).reshape(dy, dy) - np.outer(sy, sy) / n,
    }


def cka(df: DataFrame, x: str, y: str) -> float:
    """Linear centred kernel alignment."""
    m = cross_products(df, x, y)
    return float((m["xy"] ** 2).sum() / max(1e-12, np.linalg.norm(m["xx"]) * np.linalg.norm(m["yy"])))


def layerwise_cka(df: DataFrame, layer: str, x: str, y: str, order: str, most: int = 8192) -> DataFrame:
    """(layer, n, cka): the alignment of two vector columns in each layer, over at most so many of its rows, picked by hash."""
    w = Window.partitionBy(layer).orderBy(F.md5(F.col(order).cast("string")), order)
    few = df.select(F.col(layer).alias("layer"), F.col(x).alias("x"), F.col(y).alias("y"), F.row_number().over(w).alias("r")).where(F.col("r") <= most)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(rows[k].to_numpy()).astype(float) for k in ("x", "y"))
        a, b = a - a.mean(0), b - b.mean(0)
        bound = max(1e-12, np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
        return pd.DataFrame([(key[0], len(rows), float(np.linalg.norm(a.T @ b) ** 2 / bound))], columns=["layer", "n", "cka"])

    return few.groupBy("layer").applyInPandas(one, f"layer {df.schema[layer].dataType.simpleString()}, n long, cka double")


def effective_rank(df: DataFrame, x: str) -> float:
    """exp of the entropy of the covariance spectrum."""
    e = np.clip(np.linalg.eigvalsh(cross_products(df, x, x)["xx"]), 0, None)
    p = e / max(e.sum(), 1e-12)
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum()))


def spectrum_cosine(df: DataFrame, x: str, y: str) -> float:
    m = cross_products(df, x, y)
    a, b = (np.sqrt(np.clip(np.linalg.eigvalsh(m[k]), 0, None))[::-1] for k in ("xx", "yy"))
    k = min(len(a), len(b))
    return float(a[:k] @ b[:k] / max(1e-12, np.linalg.norm(a[:k]) * np.linalg.norm(b[:k])))


def procrustes(train: DataFrame, test: DataFrame, x: str, y: str) -> tuple[np.ndarray, float, float]:
    """(rotation, scale, held-out R2) of the scaled orthogonal map from x to y."""
    m = cross_products(train, x, y)
    u, s, vt = np.linalg.svd(m["xy"])
    r, scale = u @ vt, s.sum() / max(1e-12, np.trace(m["xx"]))

    t = cross_products(test, x, y)
    n = t["n"]
    shift = (t["mx"] - m["mx"]) @ (scale * r) + m["my"] - t["my"]
    error = scale**2 * np.trace(t["xx"]) - 2 * scale * np.trace(r.T @ t["xy"]) + np.trace(t["yy"]) + n * shift @ shift
    return r, float(scale), float(1 - error / max(1e-12, np.trace(t["yy"])))


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in a one-to-one assignment of least cost, by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[col]:
            used[col] = True
            r = match[col]
            free = ~used[1:]
            slack = cost[r - 1] - u[r] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], col
            nxt = 1 + int(np.where(free, least[1:], np.inf).argmin())
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[1:][free] -= step
            col = nxt
        while col:
            match[col], col = match[came[col]], came[col]
    out = [0] * n
    for c in range(1, m + 1):
        if match[c]:
            out[match[c] - 1] = c - 1
    return out


def match_heads(sims: DataFrame) -> DataFrame:
    """(layer, teacher_head, student_head, cosine): the assignment of most similarity in each layer."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        t = p.pivot(index="teacher_head", columns="student_head", values="cosine").sort_index().sort_index(axis=1)
        cols = assign(-t.to_numpy())
        return pd.DataFrame([(int(p.layer.iloc[0]), int(t.index[i]), int(t.columns[c]), float(t.iloc[i, c])) for i, c in enumerate(cols)], columns=["layer", "teacher_head", "student_head", "cosine"])

    return sims.groupBy("layer").applyInPandas(run, "layer int, teacher_head int, student_head int, cosine double")


def head_similarity(df: DataFrame) -> DataFrame:
    """(layer, teacher_head, student_head, cosine) accumulated over examples, from (example, layer, head, t, s) arrays."""
    a = df.select("example", "layer", F.col("head").alias("teacher_head"), "t")
    b = df.select("example", "layer", F.col("head").alias("student_head"), "s")
    from textloom.functions import vectors as vx

    j = a.join(b, ["example", "layer"])
    g = j.groupBy("layer", "teacher_head", "student_head").agg(F.sum(vx.dot("t", "s")).alias("d"), F.sum(vx.dot("t", "t")).alias("a"), F.sum(vx.dot("s", "s")).alias("b"))
    return g.select("layer", "teacher_head", "student_head", (F.col("d") / F.greatest(F.sqrt(F.col("a") * F.col("b")), F.lit(1e-12))).alias("cosine"))


def hash_normal(seed: int, *keys: str) -> Column:
    """A standard normal number by two hashes of the keys (Box-Muller)."""
    u = lambda s: (F.pmod(F.xxhash64(*keys, F.lit(s)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.ln(u(seed))) * F.cos(2 * np.pi * u(seed + 1))


def inject_noise(weights: DataFrame, alpha: float, seed: int) -> DataFrame:
    """(tensor, pos, w, noisy): each weight plus alpha times its tensor's sample deviation times a hashed normal."""
    sd = weights.groupBy("tensor").agg(F.coalesce(F.stddev_samp("w"), F.lit(0.0)).alias("sd"))
    return weights.join(sd, "tensor").withColumn("noisy", F.col("w") + alpha * F.col("sd") * hash_normal(seed, "tensor", "pos")).drop("sd")


def layer_conditioning(states: DataFrame) -> DataFrame:
    """(example, layer, relative, cumulative, incremental) from (example, layer, clean, noisy) vectors."""
    from textloom.functions import vectors as vx
    from textloom.operators.ordered import condition_ratios

    d = F.zip_with("noisy", "clean", lambda x, y: (x - y).cast("double"))
    r = states.select("example", "layer", (vx.norm(d) / F.greatest(vx.norm("clean"), F.lit(1e-12))).alias("relative"))
    return condition_ratios(r, "relative", "layer", ["example"])


def eligible(name: str, ndim: str, include: str | None = None, exclude: str | None = None) -> Column:
    """Which parameters to perturb: an exclusion beats an inclusion; norms, biases and one-dimensional ones are skipped."""
    n = F.col(name)
    out = ~n.rlike("(?i)norm|bias") & (F.col(ndim) >= 2)
    if include:
        out = out & n.rlike(include)
    return F.when(n.rlike(exclude), False).otherwise(out) if exclude else out
