"""Order, budgets, interleaving, splits, batches and samples: everything that depends on a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.prefix import exclusive_sum, row_index


def hash_order(key: str, seed: int) -> Column:
    """A seeded order that SQL engines agree on."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def source_budget(df: DataFrame, source: str, seq: str, est: str, goal: int, shares: dict[str, float]) -> DataFrame:
    """Rows accepted while the estimates before them stay below int(goal * share) of their source; the crossing row stays."""
    target = F.lit(None).cast("long")
    for name, share in shares.items():
        target = F.when(F.col(source) == name, F.lit(int(goal * share))).otherwise(target)
    before = exclusive_sum(df, est, [source], seq, "before")
    return before.withColumn("target", target).where(F.col("before") < F.col("target")).drop("target")


def global_budget(df: DataFrame, order: list[str], est: str, goal: int) -> DataFrame:
    """Of rows in a global order, those before which the estimates stay below the goal."""
    return exclusive_sum(df, est, [], order, "global_before").where(F.col("global_before") < goal)


def interleave(a: DataFrame, b: DataFrame, seq: str, ratio: float, seed: int) -> DataFrame:
    """Seeded Bernoulli interleave: position i takes from a with probability ratio, and from the other where one has ended.

    The k-th head takes a's k-th row, so that positions join rows on counts; no row is drawn on the driver.
    """
    na, nb = a.count(), b.count()
    spark = a.sparkSession
    pos = spark.range(na + nb).withColumn("coin", (F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)) < ratio)
    counted = exclusive_sum(pos.withColumn("h", F.col("coin").cast("long")), "h", [], ["id"], "heads").withColumn("tails", F.col("id") - F.col("heads"))
    take_a = F.when(F.col("heads") >= na, False).when(F.col("tails") >= nb, True).otherwise(F.col("coin"))
    # past the end of one side all that is left of the other follows
    k = F.when(F.col("take_a"), F.when(F.col("tails") >= nb, F.col("id") - nb).otherwise(F.col("heads"))).otherwise(F.when(F.col("heads") >= na, F.col("id") - na).otherwise(F.col("tails")))
    counted = counted.withColumn("take_a", take_a).withColumn("k", k).select(F.col("id").alias("position"), "take_a", "k")
    rows = row_index(a, [seq], "k").withColumn("take_a", F.lit(True)).unionByName(row_index(b, [seq], "k").withColumn("take_a", F.lit(False)))
    return counted.join(rows, ["take_a", "k"]).drop("k").withColumnRenamed("take_a", "from_first")


def tail_split(df: DataFrame, seq: str, held: int) -> DataFrame:
    """Adds split: the last rows by seq are validation."""
    n = df.count()
    return row_index(df, [seq], "_i").withColumn("split", F.when(F.col("_i") >= n - held, "validation").otherwise("train")).drop("_i")


def batches(df: DataFrame, order: list, size: int, cap: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds batch_id to rows in order; cap limits the rows, drop_last leaves out a short last batch."""
    x = row_index(df, order, "_i")
    if cap is not None:
        x = x.where(F.col("_i") < cap)
    x = x.withColumn("batch_id", F.floor(F.col("_i") / size))
    if drop_last:
        full = x.groupBy("batch_id").count().where(F.col("count") == size).select("batch_id")
        x = x.join(full, "batch_id", "left_semi")
    return x.drop("_i")


def epochs(df: DataFrame, key: str, size: int, n_epochs: int, seed: int) -> DataFrame:
    """(epoch, batch_id, rows): a seeded permutation for each epoch, its ragged tail dropped."""
    x = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1)))).withColumn("h", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("epoch").cast("string"), F.lit(str(seed)))))
    n = df.count()  # every epoch has all rows
    x = exclusive_sum(x.withColumn("_one", F.lit(1).cast("long")), "_one", ["epoch"], ["h", key], "_i")
    return x.where(F.col("_i") < n // size * size).withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_i", "_one", "h")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by hash order."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def even_stride(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at even distances, the first and the last included."""
    n = df.count()
    if n == 0 or k <= 0:
        return df.limit(0)
    at = df.sparkSession.range(k).select(F.floor(F.col("id") * F.lit(max(n - 1, 0)) / max(k - 1, 1)).alias("_i")).distinct()
    return row_index(df, order, "_i").join(at, "_i", "left_semi").drop("_i")


def strata(df: DataFrame, group: str, loss: str, key: str, cuts: tuple[float, float] = (0.1, 0.8)) -> DataFrame:
    """Adds percent (rank of the loss inside its group) and stratum: easy, core or hard."""
    # the order is total, so a rank is a row number, and no window holds a whole group
    x = exclusive_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", [group], [loss, key], "_i")
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    x = x.join(n, F.col(group).eqNullSafe(F.col("_g"))).withColumn("percent", F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(0.0)).drop("_one", "_i", "_n", "_g")
    return x.withColumn("stratum", F.when(F.col("percent") < cuts[0], "easy").when(F.col("percent") < cuts[1], "core").otherwise("hard"))


def quotas(df: DataFrame, group: str, key: str, per: dict[str, int], seed: int) -> DataFrame:
    """At most per[stratum] rows of each group and stratum, by hash order."""
    x = df.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "stratum").orderBy(hash_order(key, seed), key)))
    limit = F.lit(0)
    for s, n in per.items():
        limit = F.when(F.col("stratum") == s, n).otherwise(limit)
    return x.where(F.col("_rn") <= max(per.values(), default=0)).where(F.col("_rn") <= limit).drop("_rn")  # the constant bound limits each task's rows


def progressive_lengths(n: int, step: int = 2) -> list[int]:
    """step, 2 * step, ..., and n itself."""
    return [*range(step, n, step), n] if n > 0 else []
