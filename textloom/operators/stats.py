"""Aggregations: summaries, vector means, histograms, correlations, fits and classification counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector_mean(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """(by, pos, mean, var): element-wise mean and clamped population variance, in long form."""
    x = df.select(*(by or []), F.posexplode(vec).alias("pos", "p"))
    x = x.withColumn("p", F.col("p").cast("double"))
    return x.groupBy(*(by or []), "pos").agg(F.avg("p").alias("mean"), F.greatest(F.avg(F.col("p") * F.col("p")) - F.avg("p") * F.avg("p"), F.lit(0.0)).alias("var"))


def as_vector(long: DataFrame, pos: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Long form back to one array a group."""
    v = F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda s: s[value])
    return long.groupBy(*(by or [])).agg(v.alias("vec"))


def summary(x: str, prefix: str = "") -> list[Column]:
    """n, mean, median, p05, p95, min and max of a column; percentiles are interpolated."""
    p = prefix
    return [F.count(x).alias(f"{p}n"), F.avg(x).alias(f"{p}mean"), F.percentile(x, F.lit(0.5)).alias(f"{p}median"), F.percentile(x, F.lit(0.05)).alias(f"{p}p05"), F.percentile(x, F.lit(0.95)).alias(f"{p}p95"), F.min(x).alias(f"{p}min"), F.max(x).alias(f"{p}max")]


def shares(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares by key. The window is over one row a key."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """(bin, n) for bins [e0, e1), ..., the last one closed; empty bins have n = 0."""
    b = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        top = (F.col(x) <= hi) if i == len(edges) - 2 else (F.col(x) < hi)
        b = F.when((F.col(x) >= lo) & top, i).otherwise(b)
    n = df.select(b.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> Column:
    """corr over rows where both are known; null below three rows or without spread."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return F.when((F.count(F.when(ok, 1)) >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def average_rank(x: str, groups: list[str] | None = None) -> Column:
    """1-based rank, ties sharing their mean rank."""
    g = groups or []
    r = F.rank().over(Window.partitionBy(*g).orderBy(x))
    ties = F.count("*").over(Window.partitionBy(*g, x))
    return r + (ties - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    g = groups or []
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_a", average_rank(x, g)).withColumn("_b", average_rank(y, g))
    return ranked.groupBy(*g).agg(F.when(F.count("*") >= 3, F.corr("_a", "_b")).alias("rho"))


def linear_fit(y: str, x: str) -> list[Column]:
    """slope, intercept and r2 (1 where y has no spread), null below two points."""
    enough = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 2
    r2 = F.when(F.regr_syy(y, x) == 0, F.lit(1.0)).otherwise(F.regr_r2(y, x))
    return [F.when(enough, F.regr_slope(y, x)).alias("slope"), F.when(enough, F.regr_intercept(y, x)).alias("intercept"), F.when(enough, r2).alias("r2")]


def variation(x: str) -> Column:
    """Coefficient of variation in percent, by the sample standard deviation."""
    return F.stddev_samp(x) / F.avg(x) * 100


def spread(x: str) -> Column:
    return (F.max(x) / F.min(x) - 1) * 100


def ratio_of_sums(a: str, b: str) -> Column:
    return F.sum(a) / F.greatest(F.sum(b), F.lit(1))


def abs_log_ratio(r: str) -> Column:
    return F.abs(F.ln(F.greatest(F.col(r), F.lit(1e-12))))


def confusion(df: DataFrame, y: str, pred: str, labels: list[int]) -> DataFrame:
    """(y, pred, n) over the whole grid of labels."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "y int, pred int")
    n = df.select(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).groupBy("y", "pred").agg(F.count("*").alias("n"))
    return grid.join(n, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def macro_scores(conf: DataFrame) -> DataFrame:
    """accuracy and macro_f1 of a confusion table; a class without rows has F1 0."""
    true = conf.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = conf.groupBy(F.col("pred").alias("y")).agg(F.sum("n").alias("said"))
    per = true.join(said, "y").withColumn("f1", F.when(F.col("support") + F.col("said") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("said"))).otherwise(0.0))
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """An order-free digest of rows: their number and the exclusive or of their hashes."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("digest"))


def recovery(post: str, final: str, teacher: str) -> Column:
    return (F.col(post) - F.col(final)) / (F.col(post) - F.col(teacher)) * 100


def class_counters(df: DataFrame, label: str, skip: Column) -> DataFrame:
    """(kind, name, n): rows by class, and rows skipped by the reason, which is null for those kept."""
    x = df.select(F.when(skip.isNull(), "class").otherwise("skipped").alias("kind"), F.coalesce(skip, F.col(label).cast("string")).alias("name"))
    return x.groupBy("kind", "name").agg(F.count("*").alias("n"))
