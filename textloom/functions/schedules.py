"""Training schedules, scaling laws and cost formulas as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def learning_rate(step, total: int, peak: float, warmup: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to floor times the peak."""
    s = _col(step).cast("double")
    x = F.least(F.lit(1.0), (s - warmup) / max(1, total - warmup))
    return F.when(s < warmup, peak * (s + 1) / max(1, warmup)).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * x))))


def beta_schedule(step, total: int, start: float, end: float, kind: str = "linear") -> Column:
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _col(step) / float(max(1, total))))
    return start + (end - start) * (x if kind == "linear" else 0.5 * (1 - F.cos(math.pi * x)))


# The constants of the published compute-optimal scaling law.
SCALING = {"e": 1.69, "a": 406.4, "b": 410.7, "alpha": 0.34, "beta": 0.28}


def scaling_loss(params, tokens) -> Column:
    """The predicted loss of a model of so many parameters after so many tokens."""
    s = SCALING
    return s["e"] + s["a"] / F.pow(_col(params).cast("double"), F.lit(s["alpha"])) + s["b"] / F.pow(_col(tokens).cast("double"), F.lit(s["beta"]))


def effective_tokens(unique, epochs, decay: float = 15.4) -> Column:
    """Unique tokens with diminishing returns of repetition."""
    r = F.greatest(_col(epochs) - 1, F.lit(0))
    return _col(unique) + _col(unique) * decay * (1 - F.exp(-r / decay))


def training_flops(params, tokens) -> Column:
    return F.lit(6.0) * _col(params) * _col(tokens)


def gpu_hours(tokens, tokens_per_second) -> Column:
    return _col(tokens) / _col(tokens_per_second) / 3600.0


def cost(hours, per_hour) -> Column:
    return _col(hours) * _col(per_hour)


def capped_perplexity(loss, cap: float = 20.0) -> Column:
    return F.exp(F.least(F.lit(cap), _col(loss)))


def pass_at_k(n, c, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product."""
    n, c = _col(n), _col(c)
    prod = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (n - c - i) / (n - i)), F.lit(1.0), lambda a, x: a * x)
    return F.when(n - c < k, F.lit(1.0)).otherwise(1 - prod)


def tokens_per_update(sequence: int, micro_batch: int, accumulation: int) -> int:
    return sequence * micro_batch * accumulation


def total_updates(max_tokens: int, per_update: int) -> int:
    return -(-max_tokens // per_update)
