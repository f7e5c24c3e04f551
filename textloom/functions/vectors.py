"""Probability vectors as array columns: softmax, entropies, divergences, ranks and selections, without any UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x * y).cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def l2_normalise(a) -> Column:
    v = _col(a)
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12))))


def softmax(v, temperature: float = 1.0) -> Column:
    v = _col(v)
    e = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp((x - m).cast("double") / temperature)))
    return let(e, lambda y: let(total(y), lambda s: F.transform(y, lambda x: x / s)))


def log_softmax(v, temperature: float = 1.0) -> Column:
    v = _col(v)
    z = let(F.array_max(v), lambda m: F.transform(v, lambda x: (x - m).cast("double") / temperature))
    return let(z, lambda y: let(F.ln(total(F.transform(y, F.exp))), lambda s: F.transform(y, lambda x: x - s)))


def clamped(p, eps: float = 1e-12) -> Column:
    """Clamped from below and scaled to sum 1."""
    c = F.transform(_col(p), lambda x: F.greatest(x.cast("double"), F.lit(eps)))
    return let(c, lambda y: let(total(y), lambda s: F.transform(y, lambda x: x / s)))


def entropy(p, base: float = math.e, mode: str = "exact", eps: float = 1e-12) -> Column:
    """Shannon entropy. mode: exact (0 log 0 = 0), eps_in_log, or clamp_renorm."""
    p = _col(p)
    if mode == "clamp_renorm":
        p, mode = clamped(p, eps), "exact"
    term = (lambda x: x * F.ln(x + eps)) if mode == "eps_in_log" else (lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return -total(F.transform(p, term)) / math.log(base)


def perplexity(p, base: float = math.e, **how) -> Column:
    return F.pow(F.lit(base), entropy(p, base, **how))


def kl(p, q, base: float = math.e, eps: float = 0.0) -> Column:
    """KL(p || q); with eps both are clamped and scaled."""
    p, q = (clamped(p, eps), clamped(q, eps)) if eps else (_col(p), _col(q))
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.ln(x) - F.ln(y))).otherwise(0.0))) / math.log(base)


def js(p, q, base: float = math.e, eps: float = 0.0, beta: float = 0.5) -> Column:
    """The Jensen-Shannon divergence, or its beta-weighted form."""
    p, q = (clamped(p, eps), clamped(q, eps)) if eps else (_col(p), _col(q))
    m = F.zip_with(p, q, lambda x, y: beta * x + (1 - beta) * y)
    return let(m, lambda mm: beta * kl(p, mm, base) + (1 - beta) * kl(q, mm, base))


def hellinger(p, q) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 1 - total(F.zip_with(_col(p), _col(q), lambda x, y: F.sqrt(x * y)))))


def total_variation(p, q) -> Column:
    return total(F.zip_with(_col(p), _col(q), lambda x, y: F.abs(x - y))) / 2


def pearson(a, b) -> Column:
    a, b = _col(a), _col(b)
    ma, mb = total(a) / F.size(a), total(b) / F.size(b)

    def body(m: Column) -> Column:
        x, y = F.transform(a, lambda v: v - m["a"]), F.transform(b, lambda v: v - m["b"])
        return let(F.struct(x.alias("x"), y.alias("y")), lambda s: dot(s["x"], s["y"]) / F.greatest(norm(s["x"]) * norm(s["y"]), F.lit(1e-12)))

    return let(F.struct(ma.alias("a"), mb.alias("b")), body)


def argmax(v) -> Column:
    """The 0-based position of the first maximum."""
    return (F.array_position(_col(v), F.array_max(_col(v))) - 1).cast("long")


def target_rank(p, target) -> Column:
    """1 is best; ties count against the target."""
    p = _col(p)
    return let(F.element_at(p, (target + 1).cast("int")), lambda t: F.size(F.filter(p, lambda x: x >= t))).cast("long")


def ranked(p) -> Column:
    """(probability, position) structs, best first, ties by position."""
    s = F.sort_array(F.transform(_col(p), lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    return F.transform(s, lambda r: F.struct((-r["n"]).alias("p"), r["i"].alias("i")))


def top_k(p, k: int) -> Column:
    """Positions of the k best."""
    return F.transform(F.slice(ranked(p), 1, k), lambda r: r["i"])


def nucleus_size(p, top_p: float) -> Column:
    """How many best entries the nucleus holds: those before which the mass is below top_p."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"))
    step = lambda a, r: F.struct((a["m"] + r["p"]).alias("m"), (a["n"] + F.when(a["m"] < top_p, 1).otherwise(0)).alias("n"))
    return F.aggregate(ranked(p), start, step, lambda a: a["n"]).cast("long")


def apply_top_p(p, top_p: float) -> Column:
    """The vector with all but the nucleus at 0, scaled to sum 1."""
    p = _col(p)
    kept = let(F.transform(F.slice(ranked(p), F.lit(1), nucleus_size(p, top_p).cast("int")), lambda r: r["i"]), lambda ids: F.transform(p, lambda x, i: F.when(F.array_contains(ids, i), x).otherwise(0.0)))
    return let(kept, lambda y: let(total(y), lambda s: F.transform(y, lambda x: x / s)))


def apply_top_k(p, k: int) -> Column:
    p = _col(p)
    kept = let(top_k(p, k), lambda ids: F.transform(p, lambda x, i: F.when(F.array_contains(ids, i), x).otherwise(0.0)))
    return let(kept, lambda y: let(total(y), lambda s: F.transform(y, lambda x: x / s)))


def sample(p, u) -> Column:
    """The position that a uniform number draws, by the inverse of the cumulative distribution."""
    p, u = _col(p), _col(u)
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["m"] + x).alias("m"), (a["n"] + F.when(a["m"] + x <= u, 1).otherwise(0)).alias("n"))
    return F.least(F.aggregate(p, start, step, lambda a: a["n"]), F.size(p) - 1).cast("long")


def el2n(p, label) -> Column:
    """The length of the error vector of a one-hot label."""
    return F.sqrt(total(F.transform(_col(p), lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), 2.0))))


def overlap(a, b, k: int) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b))) / F.lit(float(k))


def quantile(v, q: float) -> Column:
    """The linearly interpolated quantile of an array."""
    s = F.sort_array(_col(v))

    def body(x: Column) -> Column:
        at = (F.size(x) - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        return F.get(x, lo) + (F.get(x, F.least(lo + 1, F.size(x) - 1)) - F.get(x, lo)) * (at - lo)

    return let(s, body)


def unit_scale(v, eps: float = 1e-12) -> Column:
    v = _col(v)
    return let(F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b")), lambda m: F.transform(v, lambda x: (x - m["a"]) / (m["b"] - m["a"] + eps)))


def kd_loss(teacher, student, kind: str = "forward_kl", temperature: float = 1.0, beta: float = 0.5) -> Column:
    """A distillation divergence of logit arrays, times the squared temperature."""
    t, s = softmax(teacher, temperature), softmax(student, temperature)
    d = {"forward_kl": lambda: kl(t, s), "reverse_kl": lambda: kl(s, t), "jsd": lambda: js(t, s, beta=beta)}[kind]()
    return d * temperature**2


def mixed_loss(kd, ce, weight: float) -> Column:
    return weight * _col(kd) + (1 - weight) * _col(ce)


def cross_entropy(logits, label) -> Column:
    return -F.element_at(log_softmax(logits), (label + 1).cast("int"))
