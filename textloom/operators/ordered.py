"""Ordered analytics over small curves and logs: rolling means, gradients, elbows, moving variance, condition ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(groups: list[str], order: str) -> Window:
    return Window.partitionBy(*groups).orderBy(order)


def rolling_mean(x: str, n: int, order: str, groups: list[str] | None = None) -> Column:
    """Mean of the last n values; null until n exist."""
    w = _w(groups or [], order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= n, F.avg(x).over(w))


def moving_mean(x: str, n: int, order: str, groups: list[str] | None = None) -> Column:
    return F.avg(x).over(_w(groups or [], order).rowsBetween(-(n - 1), 0))


def lag_difference(x: str, order: str, groups: list[str] | None = None) -> Column:
    """x less its predecessor, the first one's being 0."""
    return F.col(x) - F.coalesce(F.lag(x).over(_w(groups or [], order)), F.lit(0))


def moving_variance(df: DataFrame, x: str, order: str, span: int, m: int, groups: list[str] | None = None) -> DataFrame:
    """Adds moving (mean of the last span) and variance (population, of the last m means; 0 until m exist)."""
    g = groups or []
    y = df.withColumn("moving", moving_mean(x, span, order, g))
    w = _w(g, order).rowsBetween(-(m - 1), 0)
    return y.withColumn("variance", F.when(F.count("moving").over(w) >= m, F.var_pop("moving").over(w)).otherwise(0.0))


def first_breach(df: DataFrame, length: str, eps: float, groups: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(groups or [])).agg(F.min(F.when(F.col("variance") > eps, F.col(length))).alias("breach"), F.max("variance").alias("max_variance"))


def gradient(f: str, x: str, groups: list[str] | None = None) -> Column:
    """Second-order differences on uneven points; one-sided at the ends."""
    w = _w(groups or [], x)
    f0, x0 = F.col(f), F.col(x)
    fa, fb, xa, xb = F.lag(f).over(w), F.lead(f).over(w), F.lag(x).over(w), F.lead(x).over(w)
    hs, hd = x0 - xa, xb - x0
    inner = (hs * hs * fb + (hd * hd - hs * hs) * f0 - hd * hd * fa) / (hs * hd * (hd + hs))
    return F.when(xa.isNull() & xb.isNull(), F.lit(None).cast("double")).when(xa.isNull(), (fb - f0) / hd).when(xb.isNull(), (f0 - fa) / hs).otherwise(inner)


def curvature(df: DataFrame, f: str, x: str, groups: list[str] | None = None) -> DataFrame:
    g = groups or []
    y = df.withColumn("d1", gradient(f, x, g)).withColumn("d2", gradient("d1", x, g))
    return y.withColumn("curvature", F.abs("d2") / F.pow(1 + F.col("d1") * F.col("d1"), F.lit(1.5)))


def elbow(df: DataFrame, f: str, x: str, groups: list[str] | None = None) -> DataFrame:
    """The interior point of most curvature; the last point where fewer than three are finite."""
    g = groups or []
    ok = df.where(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")))
    c = curvature(ok, f, x, g)
    w = Window.partitionBy(*g).orderBy(x)
    c = c.withColumn("_inner", F.lag(x).over(w).isNotNull() & F.lead(x).over(w).isNotNull())
    best = F.max_by(x, F.when(F.col("_inner"), F.struct("curvature", (-F.col(x)).alias("o"))))
    return c.groupBy(*g).agg(F.when(F.count("*") >= 3, best).otherwise(F.max(x)).alias("elbow"))


def instability(df: DataFrame, f: str, x: str, elbows: DataFrame, groups: list[str]) -> DataFrame:
    """Mean absolute log change after the elbow; 1 where undefined."""
    y = df.withColumn("_d", F.abs(F.ln(f) - F.ln(F.lag(f).over(_w(groups, x)))))
    j = y.join(elbows, groups)
    return j.groupBy(*groups).agg(F.coalesce(F.avg(F.when(F.col(x) > F.col("elbow"), F.col("_d"))), F.lit(1.0)).alias("instability"))


def early_stop(df: DataFrame, f: str, x: str, groups: list[str], within: float = 0.02) -> DataFrame:
    """The points up to the first, from the fourth on, whose last three values lie within a share of their mean; else all."""
    w = _w(groups, x)
    last = w.rowsBetween(-2, 0)
    flat = (F.row_number().over(w) >= 4) & (F.max(f).over(last) - F.min(f).over(last) < F.avg(f).over(last) * within)
    y = df.withColumn("_flat", flat).withColumn("_stop", F.min(F.when(F.col("_flat"), F.col(x))).over(Window.partitionBy(*groups)))
    return y.where(F.col(x) <= F.coalesce("_stop", x)).drop("_flat", "_stop")


def difference_elbow(df: DataFrame, f: str, x: str, groups: list[str]) -> DataFrame:
    """The first point whose step from the one before is above both neighbouring steps; the last point where there is none."""
    w = _w(groups, x)
    step = F.col(f) - F.lag(f).over(w)
    y = df.withColumn("_step", step)
    y = y.withColumn("_peak", (F.col("_step") > F.lag("_step").over(w)) & (F.col("_step") > F.lead("_step").over(w)))
    return y.groupBy(*groups).agg(F.coalesce(F.min(F.when(F.col("_peak"), F.col(x))), F.max(x)).alias("elbow"))


def largest_log_ratio(df: DataFrame, ratio: str, layer: str, groups: list[str]) -> DataFrame:
    """layer and log_ratio: where a ratio is furthest from 1, up or down; the first layer of several."""
    score = F.abs(F.ln(F.greatest(F.col(ratio), F.lit(1e-12))))
    y = df.select(*groups, F.col(layer).alias("layer"), score.alias("log_ratio"))
    best = F.max_by("layer", F.struct("log_ratio", (-F.col("layer")).alias("o")))
    return y.groupBy(*groups).agg(best.alias("layer"), F.max("log_ratio").alias("log_ratio"))


def minmax(x: str, groups: list[str] | None = None, eps: float = 1e-12) -> Column:
    """0 to 1 over the group; NaN becomes 1, a constant 0."""
    w = Window.partitionBy(*(groups or []))
    clean = F.when(~F.isnan(x), F.col(x))
    lo, hi = F.min(clean).over(w), F.max(clean).over(w)
    return F.when(F.isnan(x) | F.col(x).isNull(), 1.0).when(hi == lo, 0.0).otherwise((F.col(x) - lo) / (hi - lo + eps))


def ngram_sweep(curves: DataFrame, domain: str, n: str, x: str, ppl: str, support: str, least: int = 6) -> DataFrame:
    """One row for each domain and size n of its perplexity curves (one row a point, with the size's distinct n-grams as support):
    the elbow, its cross-entropy ce, instability after it, the penalties, valid and score (the less the better)."""
    g = [domain, n]
    elbows = elbow(curves, ppl, x, g)
    finite = F.col(ppl).isNotNull() & ~F.isnan(ppl) & (F.abs(ppl) != float("inf"))
    y = curves.join(elbows, g).groupBy(*g).agg(
        F.first("elbow").alias("elbow"), F.max(F.when(finite & (F.col(x) == F.col("elbow")), F.ln(ppl))).alias("ce"), F.count_if(finite).alias("points"), F.max(support).alias("support"),
        F.greatest(F.lit(0.0), (least - F.max(support)) / least).alias("support_penalty"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
    )
    y = y.join(instability(curves, ppl, x, elbows, g), g)
    y = y.withColumn("edge_penalty", F.when((F.col("elbow") <= F.col("_lo")) | (F.col("elbow") >= F.col("_hi")), 1.0).otherwise(0.0))
    y = y.withColumn("valid", (F.col("points") >= 3) & (F.col("support") >= least) & F.col("ce").isNotNull())
    score = 0.60 * minmax("ce", [domain]) + 0.20 * minmax("instability", [domain]) + 0.15 * F.col("support_penalty") + 0.05 * F.col("edge_penalty")
    return y.withColumn("score", score).drop("_lo", "_hi")


def best_size(sweep: DataFrame, domain: str, n: str) -> DataFrame:
    """A domain's size of least score, then cross-entropy, then size; among the valid ones where there are any."""
    place = F.struct(~F.col("valid"), "score", F.coalesce("ce", F.lit(float("inf"))), n)
    return sweep.groupBy(domain).agg(F.min_by(F.struct(n, "score", "valid"), place).alias("b")).select(domain, "b.*")


def cumulative_mass(p: str, order_id: str, groups: list[str] | None = None) -> Column:
    return F.sum(p).over(Window.partitionBy(*(groups or [])).orderBy(F.col(p).desc(), order_id).rowsBetween(Window.unboundedPreceding, 0))


def condition_ratios(df: DataFrame, relative: str, layer: str, groups: list[str]) -> DataFrame:
    """Adds cumulative (to the first layer) and incremental (to the layer before) ratios."""
    w = _w(groups, layer)
    first = F.first(relative).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag(relative).over(w)
    return df.withColumn("cumulative", F.col(relative) / F.greatest(first, F.lit(1e-12))).withColumn("incremental", F.when(before.isNull(), F.lit(1.0)).otherwise(F.col(relative) / F.greatest(before, F.lit(1e-12))))


def running_best(x: str, order: str, groups: list[str] | None = None) -> Column:
    return F.min(x).over(_w(groups or [], order).rowsBetween(Window.unboundedPreceding, 0))


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """The last right value at or before each left row, by key: one union and one window, no range join."""
    a = left.select(key, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    b = right.select(key, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value))
    w = Window.partitionBy(key).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return u.where("_side = 1").select("_row.*", F.col(value).alias(f"asof_{value}"))
