"""Joins, aggregations, windows and time over the tables (G, H, W, R-like curves, L63-L66, T04) and generic relational coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import ordered as od
from textloom.operators import stats as st
from textloom.registry import query, read

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


def r6(c):
    return F.round(c, 6)


@query("g01_left_join_fill", "select o_custkey, count(*)::bigint n, sum(coalesce(l_quantity, 0))::double qty, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) ratio from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 45 group by o_custkey")
def left_join_fill(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity", "l_extendedprice")
    j = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.coalesce("l_quantity", F.lit(0.0))).alias("qty"), F.round(F.sum("l_extendedprice") / F.nullif(F.sum("l_quantity"), F.lit(0.0)), 6).alias("ratio"))


@query("g02_positional_zip", "with a as (select vec_id, row_number() over (order by vec_id) i from embeddings where label < 5), b as (select vec_id, row_number() over (order by vec_id) i from embeddings where label >= 5) select a.vec_id as left_id, b.vec_id as right_id from a join b using (i)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.prefix import row_index

    e = read(spark, d, "embeddings").select("vec_id", "label")
    a = row_index(e.where("label < 5"), ["vec_id"], "i").select("i", F.col("vec_id").alias("left_id"))
    b = row_index(e.where("label >= 5"), ["vec_id"], "i").select("i", F.col("vec_id").alias("right_id"))
    return a.join(b, "i").select("left_id", "right_id")


@query("g03_paired_blocks", "select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 5) dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def paired_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    return e.join(b, "vec_id").select("vec_id", F.round(vx.dot(as_double("embedding"), as_double("other")), 5).alias("dot"))


@query("g04_anti_join", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("g05_lookup_join", "select n_name, r_name, count(c_custkey)::bigint customers from nation join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by all")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("g06_semi_join", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.09)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").where("l_discount > 0.09"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("g10_pivot_pairs", "select doc_id % 10 as bucket, round(avg(length(text)) filter (lang = 'en'), 4) en, round(avg(length(text)) filter (lang = 'fr'), 4) fr, round(avg(length(text)) filter (lang = 'en') - avg(length(text)) filter (lang = 'fr'), 4) delta from documents group by 1")
def pivot_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select((F.col("doc_id") % 10).alias("bucket"), "lang", F.length("text").alias("n"))
    p = x.groupBy("bucket").pivot("lang", ["en", "fr"]).agg(F.avg("n"))
    return p.select("bucket", F.round("en", 4).alias("en"), F.round("fr", 4).alias("fr"), F.round(F.col("en") - F.col("fr"), 4).alias("delta"))


@query("g11_multiway_join", "select c_mktsegment, r_name, count(*)::bigint n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all")
def multiway_join(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("c_mktsegment", "r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("g13_parameter_grid", "select a alpha, c condition, round(a * c, 6) level from (select unnest([0.05, 0.1, 0.2])::double a), (select unnest([1.0, 2.0])::double c)")
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([(0.05,), (0.1,), (0.2,)], "alpha double")
    c = spark.createDataFrame([(1.0,), (2.0,)], "condition double")
    return a.crossJoin(c).select("alpha", "condition", r6(F.col("alpha") * F.col("condition")).alias("level"))


@query("g15_step_lookup", "select user_id, max(case when event_type = 'click' then value end) click, max(case when event_type = 'view' then value end) seen from events group by user_id")
def step_lookup(spark: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    return read(spark, d, "events").groupBy("user_id").agg(at("click").alias("click"), at("view").alias("seen"))


@query("h01_source_statistics", f"select source, count(*)::bigint n, min(len(w))::bigint least, max(len(w))::bigint most, round(avg(len(w)), 6) mean, sum(octet_length(encode(text)))::bigint bytes from (select source, text, {WORDS} w from documents) group by source")
def source_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("source", F.octet_length("text").alias("b"), tx.word_count("text").alias("n"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"), F.sum("b").alias("bytes"))


@query("h02_line_statistics", "select round(avg(n), 6) mean, median(n)::double median, max(n)::bigint most, round(avg(chars), 6) mean_chars from (select len(string_split(text, chr(10))) n, length(text) chars from documents)")
def line_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select(F.size(F.split("text", "\n")).cast("long").alias("n"), F.length("text").alias("chars"))
    return x.agg(r6(F.avg("n")).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), r6(F.avg("chars")).alias("mean_chars"))


@query("h13_shares", "select event_type, count(*)::bigint n, round(count(*)::double / sum(count(*)) over (), 6) share from events group by event_type")
def shares(spark: SparkSession, d: str) -> DataFrame:
    return st.shares(read(spark, d, "events"), "event_type").select("event_type", "n", r6("share").alias("share"))


@query("h12_cluster_sizes", "select k::bigint as cluster, count(label)::bigint n from range(12) t(k) left join embeddings on label = k group by k")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.cluster import cluster_sizes as sizes

    return sizes(read(spark, d, "embeddings"), "label", 12)


@query("h15_h16_summary", "select event_type, count(value)::bigint n, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.05), 6) p05, round(quantile_cont(value, 0.95), 6) p95, round(min(value), 6) min, round(max(value), 6) max from events group by event_type")
def summary(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("event_type").agg(*st.summary("value"))
    return x.select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "median", "p05", "p95", "min", "max")])


@query("h17_h18_argmax", "select arg_max(event_type, s)::varchar highest, round(max(s), 4) p95 from (select event_type, quantile_cont(value, 0.95) s from events group by event_type)")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.95)).alias("s"))
    return x.agg(F.max_by("event_type", "s").alias("highest"), F.round(F.max("s"), 4).alias("p95"))


@query("h19_h20_gaps", "select round(avg(abs(ln(greatest(abs(value), 1e-12)))), 6) log_distance, round(avg(abs(value - m)), 6) mean_gap, round(max(abs(value - m)), 6) max_gap, count(*) filter (abs(value - m) <= 10)::bigint in_band from events, (select avg(value) m from events)")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    x = e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m")))).withColumn("v", F.abs("value")).withColumn("g", F.abs(F.col("value") - F.col("m")))
    return x.agg(r6(F.avg(st.abs_log_ratio("v"))).alias("log_distance"), r6(F.avg("g")).alias("mean_gap"), r6(F.max("g")).alias("max_gap"), F.count_if(F.col("g") <= 10).alias("in_band"))


@query("h21_pearson", "select event_type, round(corr(value, user_id), 6) r from events group by event_type")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events")
    return x.groupBy("event_type").agg(r6(st.pearson(x, "value", "user_id")).alias("r"))


@query("h22_spearman", "with a as (select event_type, value, user_id, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0::double x, rank() over (partition by event_type order by user_id) + (count(*) over (partition by event_type, user_id) - 1) / 2.0::double y from events) select event_type, round(corr(x, y), 6) rho from a group by event_type")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return st.spearman(read(spark, d, "events"), "value", "user_id", ["event_type"]).select("event_type", r6("rho").alias("rho"))


@query("h23_linear_fit", "select event_type, round(regr_slope(value, user_id), 8) slope, round(regr_intercept(value, user_id), 6) intercept, round(regr_r2(value, user_id), 8) r2 from events group by event_type")
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("event_type").agg(*st.linear_fit("value", "user_id"))
    return x.select("event_type", F.round("slope", 8).alias("slope"), r6("intercept").alias("intercept"), F.round("r2", 8).alias("r2"))


@query("h24_h33_variation", "select event_type, round(stddev_samp(value) / avg(value) * 100, 5) cv, round((max(event_id) / min(event_id + 1)::double - 1) * 100, 3) spread, round(quantile_cont(value, 0.9), 6) p90 from events group by event_type")
def variation(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("event_type")
    return x.agg(F.round(st.variation("value"), 5).alias("cv"), F.round((F.max("event_id") / F.min(F.col("event_id") + 1) - 1) * 100, 3).alias("spread"), r6(F.percentile("value", F.lit(0.9))).alias("p90"))


@query("h25_h27_weighted_ratios", "select round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) weighted, round(exp(least(20.0::double, sum(l_tax * l_quantity) / sum(l_quantity))), 6) ppl, round(sum(l_discount) / greatest(sum(l_tax), 1), 6) ratio from lineitem")
def weighted_ratios(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    mean = lambda c: F.sum(F.col(c) * q) / F.sum(q)
    return read(spark, d, "lineitem").agg(F.round(mean("l_extendedprice"), 4).alias("weighted"), r6(F.exp(F.least(F.lit(20.0), mean("l_tax")))).alias("ppl"), r6(st.ratio_of_sums("l_discount", "l_tax")).alias("ratio"))


@query("h26_corpus_perplexity", "select round(exp(sum(nll) / greatest(sum(n), 1)), 6) ppl from (select label, -sum(ln(abs(embedding[1]::double) + 0.1)) nll, count(*) n from embeddings group by label)")
def corpus_perplexity(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "embeddings").groupBy("label").agg((-F.sum(F.ln(F.abs(F.get("embedding", F.lit(0)).cast("double")) + 0.1))).alias("nll"), F.count("*").alias("n"))
    return x.agg(r6(F.exp(F.sum("nll") / F.greatest(F.sum("n"), F.lit(1)))).alias("ppl"))


@query("h28_confusion", "select y::int y, p::int pred, count(l.doc_id)::bigint n from (select unnest([0, 1]) y), (select unnest([0, 1]) p) left join (select doc_id, quality, (length(text) > 500)::int said from labels join documents using (doc_id)) l on quality = y and said = p group by all")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", (F.length("text") > 500).cast("int").alias("said")), "doc_id")
    return st.confusion(x, "quality", "said", [0, 1])


@query("h28_macro_f1", """with x as (select quality y, (length(text) > 500)::int p from labels join documents using (doc_id)), f as (select c, 2.0::double * count(*) filter (y = c and p = c) / greatest(count(*) filter (y = c) + count(*) filter (p = c), 1) f1 from x, (select unnest([0, 1]) c) group by c)
  select (select round(avg((y = p)::int), 6) from x) accuracy, round(avg(f1), 6) macro_f1 from f""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return st.macro_scores(confusion(spark, d)).select(r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query("h30_extremes", "select user_id, round(avg((value > 80)::int), 6) clipped, min(value) least, arg_min(event_id, value)::bigint least_at, max(value) most, arg_max(event_id, value)::bigint most_at from events group by user_id having count(*) = count(distinct value)")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy("user_id").agg(
        r6(F.avg((F.col("value") > 80).cast("double"))).alias("clipped"), F.min("value").alias("least"), F.min_by("event_id", "value").alias("least_at"), F.max("value").alias("most"), F.max_by("event_id", "value").alias("most_at"),
        F.count("*").alias("n"), F.countDistinct("value").alias("k"),
    )
    return x.where("n = k").drop("n", "k")


@query("h31_h32_edges", "with x as (select value, row_number() over (order by event_id) rn, count(*) over () n from events) select round(avg(value) filter (rn <= 100), 6) first_mean, round(avg(value) filter (rn > n - 100), 6) last_mean, round(quantile_cont(value, 0.1) filter (rn > 20), 6) p10, round(quantile_cont(value, 0.9) filter (rn > 20), 6) p90 from x")
def edges(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.prefix import row_index

    e = read(spark, d, "events").select("event_id", "value")
    n = e.count()
    x = row_index(e, ["event_id"], "i")
    late = F.when(F.col("i") >= 20, F.col("value"))
    return x.agg(r6(F.avg(F.when(F.col("i") < 100, F.col("value")))).alias("first_mean"), r6(F.avg(F.when(F.col("i") >= n - 100, F.col("value")))).alias("last_mean"), r6(F.percentile(late, F.lit(0.1))).alias("p10"), r6(F.percentile(late, F.lit(0.9))).alias("p90"))


@query("h35_counters", "select source, count(*) filter (length(text) >= 500)::bigint saved, count(*) filter (length(text) < 500)::bigint skipped_short from documents group by source")
def counters(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return read(spark, d, "documents").groupBy("source").agg(F.count_if(n >= 500).alias("saved"), F.count_if(n < 500).alias("skipped_short"))


@query("h36_digest")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return st.fingerprint(read(spark, d, "documents"), ["doc_id", "text"])


@query("h38_distinct", "select count(distinct text)::bigint texts, count(distinct source)::bigint sources, count(distinct lang)::bigint langs from documents")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").agg(F.countDistinct(F.md5("text")).alias("texts"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("h34_r04_speed_ups", "with m as (select event_type, avg(value) v from events group by event_type) select event_type gpu, round(v / (select v from m where event_type = 'click'), 6) speed_up from m")
def speed_ups(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.runs import speed_ups as ups

    m = read(spark, d, "events").groupBy(F.col("event_type").alias("gpu")).agg(F.avg("value").alias("best_speed"))
    return ups(m, "click").select("gpu", r6("speed_up").alias("speed_up"))


# windows, by user or event type so that no window holds the whole table


@query("w03_rolling_mean", "select event_id, case when count(value) over w >= 5 then round(avg(value) over w, 6) end rolled from events window w as (partition by user_id order by event_id rows between 4 preceding and current row)")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", r6(od.rolling_mean("value", 5, "event_id", ["user_id"])).alias("rolled"))


@query("w04_lag_difference", "select event_id, round(value - coalesce(lag(value) over (partition by user_id order by event_id), 0), 6) delta from events")
def lag_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", r6(od.lag_difference("value", "event_id", ["user_id"])).alias("delta"))


MOVING = "(select *, avg(value) over (partition by user_id order by event_id rows between 2 preceding and current row) mv from events)"
VARIANCE = f"(select *, case when count(mv) over w >= 4 then var_pop(mv) over w else 0 end v from {MOVING} window w as (partition by user_id order by event_id rows between 3 preceding and current row))"


@query("w05_w06_moving_variance", f"select event_id, round(mv, 6) moving, round(v + 1e-7, 3) variance from {VARIANCE}")
def moving_variance(spark: SparkSession, d: str) -> DataFrame:
    x = od.moving_variance(read(spark, d, "events"), "value", "event_id", 3, 4, ["user_id"])
    return x.select("event_id", r6("moving").alias("moving"), F.round(F.col("variance") + 1e-7, 3).alias("variance"))


@query("w06_first_breach", f"select user_id, min(event_id) filter (v > 300)::bigint breach, round(max(v), 4) max_variance from {VARIANCE} group by user_id")
def first_breach(spark: SparkSession, d: str) -> DataFrame:
    x = od.moving_variance(read(spark, d, "events"), "value", "event_id", 3, 4, ["user_id"])
    return od.first_breach(x, "event_id", 300.0, ["user_id"]).select("user_id", "breach", F.round("max_variance", 4).alias("max_variance"))


CURVE = "(select label, i::double x, avg(abs(embedding[i]::double)) + 5.0::double / i f from embeddings, range(1, 13) t(i) group by label, i)"


def curve(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 12)).alias("p", "v"))
    x = (F.col("p") + 1).cast("double")
    return e.groupBy("label", x.alias("x")).agg((F.avg(F.abs(F.col("v").cast("double"))) + 5.0 / F.first(x)).alias("f"))


def grad(f: str, src: str) -> str:
    w = "over (partition by label order by x)"
    return f"(select *, case when lag(x) {w} is null then (lead({f}) {w} - {f}) / (lead(x) {w} - x) when lead(x) {w} is null then ({f} - lag({f}) {w}) / (x - lag(x) {w}) else (lead({f}) {w} - lag({f}) {w}) / 2 end g_{f} from {src})"


@query("w07_elbow", f"select label, arg_max(x, abs(g_g_f) / pow(1 + g_f * g_f, 1.5)) filter (x > 1 and x < 12)::double elbow from {grad('g_f', grad('f', CURVE))} group by label")
def elbow(spark: SparkSession, d: str) -> DataFrame:
    return od.elbow(curve(spark, d), "f", "x", ["label"])


@query("w09_instability", f"with e as (select label, arg_max(x, abs(g_g_f) / pow(1 + g_f * g_f, 1.5)) filter (x > 1 and x < 12) elbow from {grad('g_f', grad('f', CURVE))} group by label), c as (select label, x, abs(ln(f) - ln(lag(f) over (partition by label order by x))) dl from {CURVE}) select label, round(coalesce(avg(dl) filter (x > elbow), 1), 6) instability from c join e using (label) group by label")
def instability(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d)
    return od.instability(c, "f", "x", od.elbow(c, "f", "x", ["label"]), ["label"]).select("label", r6("instability").alias("instability"))


@query("w10_w17_relative_drop", f"select label, round(ln(max(f) filter (x = 1)) - ln(max(f) filter (x = 6)), 6) log_drop, round((max(f) filter (x = 1) - max(f) filter (x = 6)) / (max(f) filter (x = 1) - max(f) filter (x = 12)), 6) share from {CURVE} group by label")
def relative_drop(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.max(F.when(F.col("x") == x, F.col("f")))
    return curve(spark, d).groupBy("label").agg(r6(F.ln(at(1)) - F.ln(at(6))).alias("log_drop"), r6((at(1) - at(6)) / (at(1) - at(12))).alias("share"))


@query("w12_empirical_cdf", "select event_type, event_id, round(cume_dist() over (partition by event_type order by value), 6) share from events")
def empirical_cdf(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_type", "event_id", r6(F.cume_dist().over(Window.partitionBy("event_type").orderBy("value"))).alias("share"))


@query("w14_condition_ratios", "with r as (select user_id, event_id, abs(value) + 1 v from events) select event_id, round(v / first_value(v) over w, 6) cumulative, round(coalesce(v / lag(v) over w, 1), 6) incremental from r window w as (partition by user_id order by event_id)")
def condition_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").select("user_id", "event_id", (F.abs("value") + 1).alias("v"))
    return od.condition_ratios(x, "v", "event_id", ["user_id"]).select("event_id", r6("cumulative").alias("cumulative"), r6("incremental").alias("incremental"))


@query("w16_running_best", "select event_id, min(value) over (partition by user_id order by event_id rows unbounded preceding) best from events")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", od.running_best("value", "event_id", ["user_id"]).alias("best"))


@query("w20_minmax", "select event_id, round(case when max(value) over w = min(value) over w then 0 else (value - min(value) over w) / (max(value) over w - min(value) over w + 1e-12) end, 6) scaled from events window w as (partition by user_id)")
def minmax(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", r6(od.minmax("value", ["user_id"])).alias("scaled"))


@query("j05_lexicographic_best", "select event_type, arg_min(event_id, struct_pack(a := round(value, 0), b := user_id, c := event_id))::bigint best from events group by event_type")
def lexicographic_best(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct(F.round("value", 0), "user_id", "event_id")).alias("best"))


@query("l60_array_functions", "select doc_id, len(list_distinct(w))::bigint n_distinct, (list_position(w, 'the'))::bigint at_the, array_to_string(w[3:5], '_') part, array_to_string(list_reverse(w[1:2]), '+') back from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents where lang = 'en')")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").where("lang = 'en'").select("doc_id", tx.words("text").alias("w"))
    at = F.array_position("w", "the")
    return x.select("doc_id", F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.when(at > 0, at).alias("at_the"), F.array_join(F.slice("w", 3, 3), "_").alias("part"), F.array_join(F.reverse(F.slice("w", 1, 2)), "+").alias("back"))


@query("l61_map_merge", "select event_id, coalesce(case when event_type = 'click' then 2 end, case when event_type = 'view' then 1 end, 0)::int weight from events")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    table = F.map_concat(F.create_map(F.lit("click"), F.lit(2)), F.create_map(F.lit("view"), F.lit(1)))
    return read(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(0)).alias("weight"))


@query("l62_json_safe", "select vec_id, case when label = 0 then null else round(10.0::double / label, 6) end safe from embeddings")
def json_safe(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("label") == 0, F.lit(float("inf"))).otherwise(10.0 / F.when(F.col("label") == 0, 1).otherwise(F.col("label")))
    return read(spark, d, "embeddings").select("vec_id", r6(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)).alias("safe"))


@query("l63_json_fields", "select event_id, json_extract_string(props, '$.k')::varchar k, len(props)::bigint n from events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


@query("l64_l66_time", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') iso, (epoch(ts) - epoch(timestamp '2024-01-01'))::bigint as elapsed, round(value / (epoch(ts) - epoch(timestamp '2024-01-01') + 1), 8)::double per_second from (select event_id, date_trunc('second', ts) ts, value from events)")
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), s.alias("elapsed"), F.round(F.col("value") / (s + 1), 8).alias("per_second"))


@query("l65_log_times", "select event_id, (event_id % 500)::bigint as seconds from events")
def log_times(spark: SparkSession, d: str) -> DataFrame:
    """Whole seconds between the two times of a log line, made here from each event's time."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    end = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 500)
    x = read(spark, d, "events").select("event_id", F.concat(F.lit("start "), iso(F.col("ts")), F.lit(" end "), iso(end)).alias("line"))
    at = lambda w: F.unix_timestamp(F.to_timestamp(F.regexp_extract("line", rf"{w} (\S+)", 1)))
    return x.select("event_id", (at("end") - at("start")).alias("seconds"))


@query("t04_entropy_stop", "select user_id, count(*)::bigint kept from (select user_id, value, event_id, min(event_id) filter (rn >= 2 and value > 60) over (partition by user_id) stop from (select *, row_number() over (partition by user_id order by event_id) rn from events)) where stop is null or event_id < stop group by user_id")
def entropy_stop(spark: SparkSession, d: str) -> DataFrame:
    from textloom.streaming.streams import entropy_stop as stop

    w = Window.partitionBy("user_id").orderBy("event_id")
    x = read(spark, d, "events").select("user_id", "value", F.row_number().over(w).alias("rn"))
    return stop(x, "user_id", "rn", "value", 2, 60.0).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("x_as_of_join", "select c.event_id, (select v.value from events v where v.user_id = c.user_id and v.event_type = 'view' and v.ts <= c.ts order by v.ts desc, v.event_id desc limit 1) asof_value from events c where c.event_type = 'click'")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    out = od.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "ts", "value")
    return out.select("event_id", "asof_value")


@query("x_cube", "select l_returnflag, l_linestatus, count(*)::bigint n, round(sum(l_quantity), 2) qty from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("x_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*)::bigint n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("x_tumbling_window", "select date_trunc('hour', ts) start, event_type, count(*)::bigint n, round(sum(value), 4) total from events group by all")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")
