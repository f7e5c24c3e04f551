"""Global running sums and row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame, order: list) -> DataFrame:
    """df dealt by ranges of the order and sorted inside, with its partition's number."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())


def exclusive_sum(df: DataFrame, value: str, groups: list[str], order, out: str) -> DataFrame:
    """Adds the sum of value over the rows before each row in order, by group.

    Rows are dealt by ranges of (groups, order); each range sums its own rows, and one row a range and group carries what
    came before it. No window holds more than a range, however large a group is.
    """
    order = [order] if isinstance(order, str) else list(order)
    from textloom.operators.storage import checkpointed

    # the ranges must be the same in both uses below
    x = checkpointed(_parts(df, [*groups, *order]))
    per = x.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = per.withColumn("_base", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = F.col("x._part") == F.col("b._part")
    for g in groups:
        on = on & F.col(f"x.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = x.alias("x").join(base.alias("b"), on)
    return joined.select(*[F.col(f"x.`{c}`") for c in df.columns], (F.col("x._own") + F.col("b._base")).alias(out))


def row_index(df: DataFrame, order, out: str) -> DataFrame:
    """Adds the 0-based row number in order."""
    return exclusive_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", [], order, out).drop("_one")
