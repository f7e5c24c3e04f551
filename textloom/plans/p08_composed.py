"""Composed evaluations over tables: effective context sizes, conditioning extremes, robustness blocks, baseline summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import compare as cp
from textloom.operators import linear as ln
from textloom.operators import ordered as od
from textloom.operators import runs as rn
from textloom.operators import stats as st
from textloom.plans.p03_vectors import pairs
from textloom.plans.p04_tables import CURVE, curve
from textloom.plans.p05_models import MIXED, POS, SOFT, emb, positions
from textloom.registry import query, read


def r6(c):
    return F.round(c, 6)


BY = "over (partition by label order by x)"
STOPPED = f"""(select label, x, f from (select *, min(x) filter (rn >= 4 and spread < 0.02 * m) over (partition by label) stop from (select *, row_number() {BY} rn,
  max(f) over w - min(f) over w spread, avg(f) over w m from {CURVE} window w as (partition by label order by x rows between 2 preceding and current row))) where x <= coalesce(stop, x))"""


@query("w08_effective_size", f"""select label, max(x) last_size, coalesce(min(x) filter (d > a and d > b), max(x)) elbow from (select *, lag(d) {BY} a, lead(d) {BY} b from (select *, f - lag(f) {BY} d from {STOPPED})) group by label""")
def effective_size(spark: SparkSession, d: str) -> DataFrame:
    """Per curve: where the sweep ends early, and the elbow by first differences of what it saw."""
    x = od.early_stop(curve(spark, d), "f", "x", ["label"])
    return x.groupBy("label").agg(F.max("x").alias("last_size")).join(od.difference_elbow(x, "f", "x", ["label"]), "label")


RATIO = f"(select label, x, abs(ln(greatest(f / greatest(first_value(f) {BY}, 1e-12), 1e-12))) up, abs(ln(greatest(f / greatest(coalesce(lag(f) {BY}, f), 1e-12), 1e-12))) step from {CURVE})"


@query("h18_largest_log_ratio", f"select label, arg_max(x, up) cumulative_layer, round(max(up), 6) cumulative, arg_max(x, step) incremental_layer, round(max(step), 6) incremental from {RATIO} group by label")
def largest_log_ratio(spark: SparkSession, d: str) -> DataFrame:
    x = od.condition_ratios(curve(spark, d), "f", "x", ["label"])
    worst = lambda k: od.largest_log_ratio(x, k, "x", ["label"]).select("label", F.col("layer").alias(f"{k}_layer"), r6("log_ratio").alias(k))
    return worst("cumulative").join(worst("incremental"), "label")


@query("h29_class_counters", """select case when skip is null then 'class' else 'skipped' end kind, coalesce(skip, lang) as name, count(*)::bigint n from
  (select lang, case when text is null or length(text) = 0 then 'empty' when length(text) < 200 then 'short' when lang is null then 'no label' end skip from documents) group by all""")
def class_counters(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0))
    return st.class_counters(read(spark, d, "documents"), "lang", F.when(n == 0, "empty").when(n < 200, "short").when(F.col("lang").isNull(), "no label"))


KL = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * ln(z[1] / z[2])))"
TOP = "list_position({0}, list_max({0}))"
NOISY = f"(select vec_id, label, t, s, list_transform(t, lambda x, i: x + 0.3 * ((i * 7) % 5 - 2)) tt, list_transform(s, lambda x, i: x + 0.5 * ((i * 3) % 4 - 1.5)) ss from {MIXED})"
NOISED = f"(select *, {SOFT.format('t')} ct, {SOFT.format('s')} cs, {SOFT.format('tt')} pt, {SOFT.format('ss')} ps from {NOISY})"
ROBUST = {
    "teacher_top1_stability": f"({TOP.format('t')} = {TOP.format('tt')})::int", "student_top1_stability": f"({TOP.format('s')} = {TOP.format('ss')})::int", "perturbed_top1_match": f"({TOP.format('tt')} = {TOP.format('ss')})::int",
    "perturbed_kl_teacher_student": KL.format("pt", "ps"), "teacher_clean_to_perturbed_kl": KL.format("ct", "pt"), "student_clean_to_perturbed_kl": KL.format("cs", "ps"),
    "perturbed_teacher_nll": "-ln(pt[label + 1])", "perturbed_student_nll": "-ln(ps[label + 1])",
    "perturbed_teacher_correct": f"({TOP.format('tt')} = label + 1)::int", "perturbed_student_correct": f"({TOP.format('ss')} = label + 1)::int",
}


@query("p04_robustness_blocks", f"select floor(vec_id / 10)::bigint block_id, {', '.join(f'round(avg({v}), 6) {k}' for k, v in ROBUST.items())}, count(*)::bigint n_tokens from {NOISED} group by 1")
def robustness_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select(F.floor(F.col("vec_id") / 10).alias("block_id"), F.col("label").cast("int").alias("label"), "t", F.zip_with("t", "s", lambda a, b: 0.8 * a + 0.2 * b).alias("s"))
    x = x.withColumn("tt", F.transform("t", lambda v, i: v + 0.3 * ((i + 1) * 7 % 5 - 2))).withColumn("ss", F.transform("s", lambda v, i: v + 0.5 * ((i + 1) * 3 % 4 - 1.5)))
    b = cp.robustness_blocks(x, "t", "s", "tt", "ss")
    return b.select("block_id", *[r6(k).alias(k) for k in ROBUST], "n_tokens")


MEANS = ["top1_match", "kl", "tv", "t_nll", "s_nll"]
RATIOS = {"error_jaccard": ("error_intersection", "error_union"), "same_wrong_given_teacher_error": ("same_wrong", "teacher_error"), "teacher_error_rate": ("teacher_error", "n_tokens"), "student_error_rate": ("student_error", "n_tokens")}
STATS = ", ".join([f"avg({m}) {m}" for m in MEANS] + [f"sum({a})::double / greatest(sum({b}), 1) {k}" for k, (a, b) in RATIOS.items()])
SUMMARY = f"""with b as (select floor(vec_id / 10)::bigint i, avg((t_top = s_top)::int) top1_match, avg({KL.format('p', 'q')}) kl, avg(0.5 * list_sum(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2])))) tv, avg(-ln(p[label + 1])) t_nll, avg(-ln(q[label + 1])) s_nll,
  count(*) n_tokens, count(*) filter (t_top <> label) teacher_error, count(*) filter (s_top <> label) student_error, count(*) filter (t_top <> label and s_top <> label) error_intersection, count(*) filter (t_top <> label or s_top <> label) error_union,
  count(*) filter (t_top <> label and s_top = t_top) same_wrong from {POS} group by 1), d as (select r // n draw, ('0x' || left(md5(concat_ws('-', r // n, r % n, '5')), 8))::bigint % n i from (select unnest(range(200 * n)) r, n from (select count(*) n from b))),
  m as (select draw, {STATS} from d join b using (i) group by draw), e as (select {STATS}, sum(n_tokens)::double tokens, count(*)::double blocks from b)
  """ + " union all ".join(
    [f"select '{k}' metric, round((select {k} from e), 6) estimate, round((select quantile_cont({k}, 0.025) from m), 6) lo, round((select quantile_cont({k}, 0.975) from m), 6) hi" for k in (*MEANS, *RATIOS)]
    + [f"select '{k}', round((select {v} from e), 6), null, null" for k, v in {"teacher_ppl": "exp(t_nll)", "student_ppl": "exp(s_nll)", "tokens": "tokens", "blocks": "blocks"}.items()]
)


@query("p10_baseline_summary", SUMMARY)
def baseline_summary(spark: SparkSession, d: str) -> DataFrame:
    b = cp.block_metrics(positions(spark, d)).withColumnRenamed("block_id", "i")
    out = cp.baseline_summary(b, MEANS, RATIOS, {"teacher_ppl": "t_nll", "student_ppl": "s_nll"}, 200, 5)
    return out.select("metric", *[r6(c).alias(c) for c in ("estimate", "lo", "hi")])


@query("q02_layerwise_cka")
def layerwise_cka(spark: SparkSession, d: str) -> DataFrame:
    """Four layers: vectors against themselves with more and more of the next entries mixed in."""
    x = emb(spark, d).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer"))
    y = F.zip_with("v", F.concat(F.slice("v", 2, 1000), F.slice("v", 1, 1)), lambda a, b: a + b * F.col("layer") * 0.5)
    return ln.layerwise_cka(x.withColumn("y", y), "layer", "v", "y", "vec_id").withColumn("cka", r6("cka"))


def sweep_curves(spark: SparkSession, d: str) -> DataFrame:
    """(label, n, x, f, support): curves of four sizes a label, from every vector's first twelve entries."""
    e = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 4 + 1).alias("n"), F.posexplode(F.slice("embedding", 1, 12)).alias("p", "v"))
    x = (F.col("p") + 1).cast("double")
    return e.groupBy("label", "n", x.alias("x")).agg((F.avg(F.abs(F.col("v").cast("double"))) + 1 + 5.0 / F.first(x)).alias("f"), F.count("*").alias("support"))


@query("l43_best_ngram_size")
def best_ngram_size(spark: SparkSession, d: str) -> DataFrame:
    sweep = od.ngram_sweep(sweep_curves(spark, d), "label", "n", "x", "f", "support", 12)
    return od.best_size(sweep, "label", "n").select("label", "n", r6("score").alias("score"), "valid")


EVAL = "event_type in ('view', 'click')"


@query("w19_phase_log", f"""select user_id run, arg_max(value, event_id) filter (event_type = 'error') teacher, arg_max(value, event_id) filter (event_type = 'click') post, arg_max(value, event_id) filter ({EVAL}) latest from events group by user_id""")
def phase_log(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a run's log: errors are the teacher's floor, clicks the anchors after noise, views the evaluations."""
    phase = F.when(F.col("event_type") == "error", "teacher_baseline").when(F.col("event_type") == "click", "post_noise").when(F.col("event_type") == "view", "eval")
    x = read(spark, d, "events").select(F.col("user_id").alias("run"), phase.alias("phase"), F.col("event_id").alias("step"), F.col("value").alias("ppl"))
    return rn.recovery_table(x).select("run", "teacher", "post", F.col("final").alias("latest"))


@query("j09_j10_series", """select event_type objective, k::int as level, row_number() over (partition by event_type order by k::int)::int place, n from
  (select event_type, props ->> '$.k' k, count(*)::bigint n from events group by all) where k::int > 0""")
def ordered_levels(spark: SparkSession, d: str) -> DataFrame:
    """Per objective its levels above 0 in numeric order; they arrive as strings."""
    x = read(spark, d, "events").groupBy(F.col("event_type").alias("objective"), F.get_json_object("props", "$.k").cast("int").alias("level")).agg(F.count("*").alias("n"))
    return x.where("level > 0").select("objective", "level", F.row_number().over(Window.partitionBy("objective").orderBy("level")).alias("place"), "n")
