"""Run logs and benchmark sweeps: bundles of derived figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ordered as od
from textloom.operators import stats as st


def training_metrics(log: DataFrame, clip: float = 1.0, warm: int = 20, edge: int = 100) -> DataFrame:
    """One row a run from (run, update_step, loss, grad_norm, tokens_processed, session_elapsed_seconds)."""
    w = Window.partitionBy("run").orderBy("update_step")
    x = log.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("run")))
    x = x.withColumn("seconds", od.lag_difference("session_elapsed_seconds", "update_step", ["run"])).withColumn("step_tokens", od.lag_difference("tokens_processed", "update_step", ["run"]))
    x = x.withColumn("speed", F.col("step_tokens") / F.col("seconds"))
    late = F.when(F.col("rn") > warm, F.col("speed"))
    first, last = F.avg(F.when(F.col("rn") <= edge, F.col("loss"))), F.avg(F.when(F.col("rn") > F.col("n") - edge, F.col("loss")))
    return x.groupBy("run").agg(
        F.count("*").alias("updates"), first.alias("first_loss"), last.alias("last_loss"), ((last / first - 1) * 100).alias("loss_change_pct"), F.percentile(late, F.lit(0.1)).alias("speed_p10"), F.percentile(late, F.lit(0.5)).alias("speed_median"), F.percentile(late, F.lit(0.9)).alias("speed_p90"),
        F.avg((F.col("grad_norm") > clip).cast("double")).alias("clipped"), F.min("loss").alias("min_loss"), F.min_by("update_step", F.struct("loss", "update_step")).alias("min_loss_step"), F.max("grad_norm").alias("max_grad"), F.max_by("update_step", F.struct("grad_norm", -F.col("update_step"))).alias("max_grad_step"),
        F.max("tokens_processed").alias("tokens"), F.max("session_elapsed_seconds").alias("elapsed"),
    )


def benchmark_metrics(bench: DataFrame) -> DataFrame:
    """One row a gpu from (gpu, batch_size, status, tokens_per_second, peak_mib, total_mib): fit, best, first failure, headroom."""
    ok = F.col("status") == "ok"
    v = lambda c: F.when(ok, F.col(c).cast("double"))
    x = bench.withColumn("b", v("batch_size")).withColumn("m", v("peak_mib"))
    slope, intercept, r2 = st.linear_fit("m", "b")
    best = F.max_by("batch_size", F.when(ok, F.struct("tokens_per_second", -F.col("batch_size"))))
    return x.groupBy("gpu").agg(slope, intercept, r2, best.alias("best_batch"), F.max(v("tokens_per_second")).alias("best_speed"), F.min(F.when(~ok, F.col("batch_size"))).alias("first_failure"), (F.max("total_mib") - F.max("m")).alias("headroom_mib"))


def speed_ups(metrics: DataFrame, base: str, key: str = "gpu", value: str = "best_speed") -> DataFrame:
    """(gpu, speed_up) against the base group."""
    b = metrics.where(F.col(key) == base).select(F.col(value).alias("_b"))
    return metrics.crossJoin(F.broadcast(b)).select(key, (F.col(value) / F.col("_b")).alias("speed_up"))


def recovery_table(log: DataFrame) -> DataFrame:
    """One row a run from (run, phase, step, ppl): teacher floor, post-noise anchor, last evaluation, recovered share."""
    at = lambda cond: F.max_by("ppl", F.when(cond, F.col("step")))
    g = log.groupBy("run").agg(at(F.col("phase") == "teacher_baseline").alias("teacher"), at(F.col("phase") == "post_noise").alias("post"), at(F.col("phase").startswith("eval") | (F.col("phase") == "post_noise")).alias("final"))
    return g.withColumn("recovery_pct", st.recovery("post", "final", "teacher"))


def resume_compatible(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(compatible, differing) of two one-row configurations."""
    j = a.select(F.struct(*keys).alias("a")).crossJoin(b.select(F.struct(*keys).alias("b")))
    diff = F.filter(F.array(*[F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    return j.select((F.size(diff) == 0).alias("compatible"), diff.alias("differing"))


def rotate(checkpoints: DataFrame, keep: int) -> DataFrame:
    """Adds victim: all but the newest keep complete checkpoints of a run."""
    w = Window.partitionBy("run").orderBy(F.col("step").desc())
    return checkpoints.where("complete").withColumn("victim", F.row_number().over(w) > keep)
