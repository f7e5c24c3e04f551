"""Probability vectors from embeddings: softmax, entropies, divergences, ranks, nucleus, losses (H03-H10, L30-L48, W11-W15, J02-J12, U03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import schedules as sc
from textloom.functions import vectors as vx
from textloom.operators import stats as st
from textloom.registry import query, read

# logits of a row, and of the next one as its student
PAIRS = "(select a.vec_id, a.label, list_transform(a.embedding, lambda x: x::double * 4) t, list_transform(b.embedding, lambda x: x::double * 4) s from embeddings a join embeddings b on b.vec_id = (a.vec_id + 1) % 500)"
SOFT = "list_transform(list_transform({0}, lambda x: exp(x - list_max({0}))), lambda y: y / list_sum(list_transform({0}, lambda x: exp(x - list_max({0})))))"
PQ = f"(select vec_id, label, t, s, {SOFT.format('t')} p, {SOFT.format('s')} q from {PAIRS})"
Z = "list_zip(p, q)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, logits t and s, and their softmax p and q; every row is a teacher, its student has the id (vec_id + 1) % 500."""
    e = read(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 4)
    a = e.select("vec_id", "label", scaled.alias("t"), ((F.col("vec_id") + 1) % 500).alias("student"))
    b = e.where(F.col("vec_id").between(-499, 499)).select(F.col("vec_id").alias("student"), scaled.alias("s"))  # all ids that a remainder can have
    return a.join(b, "student").drop("student").withColumn("p", vx.softmax("t")).withColumn("q", vx.softmax("s"))


def r6(c):
    return F.round(c, 6)


@query("l30_softmax", f"select vec_id, round(p[1], 6) p0, round(list_max(p), 6) top, round(list_sum(p), 6) total, round(t[1] - list_max(t) - ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t))))), 6) logp0, round(({SOFT.format('list_transform(t, lambda z: z / 2)')})[1], 6) warm0 from {PQ}")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", r6(F.get("p", F.lit(0))).alias("p0"), r6(F.array_max("p")).alias("top"), r6(vx.total(F.col("p"))).alias("total"), r6(F.get(vx.log_softmax("t"), F.lit(0))).alias("logp0"), r6(F.get(vx.softmax("t", 2.0), F.lit(0))).alias("warm0"))


@query("l31_l32_entropy", f"select vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) nats, round(-list_sum(list_transform(p, lambda x: x * log2(x))), 6) bits, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 6) eps_nats, round(exp(-list_sum(list_transform(p, lambda x: x * ln(x)))), 5) ppl from {PQ}")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", r6(vx.entropy("p")).alias("nats"), r6(vx.entropy("p", 2)).alias("bits"), r6(vx.entropy("p", mode="eps_in_log")).alias("eps_nats"), F.round(vx.perplexity("p"), 5).alias("ppl"))


KL = f"list_sum(list_transform({Z}, lambda z: z[1] * (ln(z[1]) - ln(z[2]))))"
JS = f"list_sum(list_transform({Z}, lambda z: 0.5 * z[1] * (ln(z[1]) - ln((z[1] + z[2]) / 2)) + 0.5 * z[2] * (ln(z[2]) - ln((z[1] + z[2]) / 2))))"


@query("l33_l36_divergences", f"""select vec_id, round({KL}, 6) kl, round({KL} / ln(2), 6) kl_bits, round({JS}, 6) js, round(sqrt(greatest(0, 1 - list_sum(list_transform({Z}, lambda z: sqrt(z[1] * z[2]))))), 6) hellinger,
  round(0.5 * list_sum(list_transform({Z}, lambda z: abs(z[1] - z[2]))), 6) tv from {PQ}""")
def divergences(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", r6(vx.kl("p", "q")).alias("kl"), r6(vx.kl("p", "q", 2)).alias("kl_bits"), r6(vx.js("p", "q")).alias("js"), r6(vx.hellinger("p", "q")).alias("hellinger"), r6(vx.total_variation("p", "q")).alias("tv"))


@query("l37_pearson", "with x as (select vec_id, unnest(t) a, unnest(s) b from " + PAIRS + ") select vec_id, round(corr(a, b), 6) r from x group by vec_id")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", r6(vx.pearson("t", "s")).alias("r"))


@query("l38_confidence", f"select vec_id, (list_position(p, list_max(p)) - 1)::bigint top1, round(list_max(p), 6) confidence, (list_position(p, list_max(p)) - 1) = label correct, round(-ln(p[label + 1]), 6) nll from {PQ}")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", vx.argmax("p").alias("top1"), r6(F.array_max("p")).alias("confidence"), (vx.argmax("p") == F.col("label")).alias("correct"), r6(vx.cross_entropy("t", F.col("label"))).alias("nll"))


@query("l39_sampling", f"""with x as (select vec_id, unnest(p) v, generate_subscripts(p, 1) - 1 i, ('0x' || left(md5(vec_id || '-5'), 8))::bigint / 4294967296.0::double u from {PQ}),
  c as (select vec_id, i, u, sum(v) over (partition by vec_id order by i) m from x) select vec_id, least(count(*) filter (m <= u), 63)::bigint drawn from c group by vec_id""")
def sampling(spark: SparkSession, d: str) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("vec_id").cast("string"), F.lit("5"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return pairs(spark, d).select("vec_id", vx.sample("p", u).alias("drawn"))


@query("l40_el2n", f"select vec_id, round(sqrt(pow(1 - p[label + 1], 2) + list_sum(list_transform(p, lambda x: x * x)) - pow(p[label + 1], 2)), 6) el2n from {PQ}")
def el2n(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", r6(vx.el2n("p", F.col("label"))).alias("el2n"))


@query("l42_confidence_metrics", f"""select vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 6) norm_entropy, round(list_sort(p)[64] - list_sort(p)[63], 6) margin,
  round((select quantile_cont(v, 0.75) - quantile_cont(v, 0.25) from (select unnest(t) v)), 6) iqr from {PQ}""")
def confidence_metrics(spark: SparkSession, d: str) -> DataFrame:
    import math

    top = vx.ranked("p")
    return pairs(spark, d).select("vec_id", r6(vx.entropy("p") / math.log(64)).alias("norm_entropy"), r6(F.get(top, F.lit(0))["p"] - F.get(top, F.lit(1))["p"]).alias("margin"), r6(vx.quantile("t", 0.75) - vx.quantile("t", 0.25)).alias("iqr"))


@query("l47_l48_kd_losses", f"""select vec_id, round({KL}, 6) forward_kl, round(list_sum(list_transform({Z}, lambda z: z[2] * (ln(z[2]) - ln(z[1])))), 6) reverse_kl, round({JS}, 6) jsd, round(-ln(q[list_position(t, list_max(t))]), 6) hard_ce,
  (list_position(t, list_max(t)) = list_position(s, list_max(s))) agree, round(0.3 * {KL} - 0.7 * ln(q[label + 1]), 6) mixed from {PQ}""")
def kd_losses(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d)
    kl = vx.kd_loss("t", "s")
    return x.select("vec_id", r6(kl).alias("forward_kl"), r6(vx.kd_loss("t", "s", "reverse_kl")).alias("reverse_kl"), r6(vx.kd_loss("t", "s", "jsd")).alias("jsd"), r6(vx.cross_entropy("s", vx.argmax("t"))).alias("hard_ce"), (vx.argmax("t") == vx.argmax("s")).alias("agree"), r6(vx.mixed_loss(kl, vx.cross_entropy("s", F.col("label")), 0.3)).alias("mixed"))


@query("l44_l46_schedules", """select step, round(case when step < 20 then 0.001::double * (step + 1) / 20 else 0.001::double * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (step - 20) / 180.0::double)))) end, 9) lr, round(0.1 + 0.8 * least(1.0, step / 200.0::double), 6)::double beta,
  round(exp(least(20.0::double, step / 8.0::double)), 4) ppl from range(200) t(step)""")
def schedules(spark: SparkSession, d: str) -> DataFrame:
    x = spark.range(200).withColumnRenamed("id", "step")
    return x.select("step", F.round(sc.learning_rate("step", 200, 0.001, 20), 9).alias("lr"), r6(sc.beta_schedule("step", 200, 0.1, 0.9)).alias("beta"), F.round(sc.capped_perplexity(F.col("step") / 8.0), 4).alias("ppl"))


@query("l49_l51_formulas", """select n, round(1.69 + 406.4 / pow(n * 1e9, 0.34) + 410.7 / pow(n * 2e10, 0.28), 6)::double loss, round(6.0 * n * 1e9 * n * 2e10 / 1e20, 6)::double flops_e20, round(n * 2e10 / 14810.4 / 3600, 4)::double as "hours",
  round(case when 10 - n < 3 then 1 else 1 - ((10 - n) * (9 - n) * (8 - n)) / 720.0::double end, 6)::double pass_at_3 from (select unnest(range(1, 9))::double n)""")
def formulas(spark: SparkSession, d: str) -> DataFrame:
    x = spark.range(1, 9).select(F.col("id").cast("double").alias("n"))
    p, t = F.col("n") * 1e9, F.col("n") * 2e10
    return x.select("n", r6(sc.scaling_loss(p, t)).alias("loss"), r6(sc.training_flops(p, t) / 1e20).alias("flops_e20"), F.round(sc.gpu_hours(t, F.lit(14810.4)), 4).alias("hours"), r6(sc.pass_at_k(F.lit(10.0), "n", 3)).alias("pass_at_3"))


@query("w13_h07_target_rank", f"select vec_id, len(list_filter(p, lambda x: x >= p[label + 1]))::bigint rank from {PQ}")
def target_rank(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", vx.target_rank("p", F.col("label")).alias("rank"))


@query("h07_rank_summary", f"select round(avg(r), 6) mean_rank, median(r)::double median_rank, round(avg((r = 1)::int), 6) first, round(avg((r <= 5)::int), 6) top5, round(avg((r <= 10)::int), 6) top10 from (select len(list_filter(p, lambda x: x >= p[label + 1])) r from {PQ})")
def rank_summary(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select(vx.target_rank("p", F.col("label")).alias("r"))
    share = lambda k: r6(F.avg((F.col("r") <= k).cast("double")))
    return x.agg(r6(F.avg("r")).alias("mean_rank"), F.percentile("r", F.lit(0.5)).alias("median_rank"), share(1).alias("first"), share(5).alias("top5"), share(10).alias("top10"))


@query("h08_cross_entropy_bits", f"select round(avg(-log2(p[label + 1])), 6) bits, round(pow(2, avg(-log2(p[label + 1]))), 5) ppl from {PQ}")
def cross_entropy_bits(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select((-F.log2(F.get("p", F.col("label")))).alias("b"))
    return x.agg(r6(F.avg("b")).alias("bits"), F.round(F.pow(F.lit(2.0), F.avg("b")), 5).alias("ppl"))


RANKED = f"(select vec_id, i, v, sum(v) over (partition by vec_id order by v desc, i rows between unbounded preceding and current row) c from (select vec_id, unnest(p) v, generate_subscripts(p, 1) - 1 i from {PQ}))"


@query("w15_h09_nucleus", f"select vec_id, count(*) filter (c - v < 0.9)::bigint size from {RANKED} group by vec_id")
def nucleus(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", vx.nucleus_size("p", 0.9).alias("size"))


@query("h09_nucleus_coverage", f"select round(avg(hit), 6) coverage, round(avg(size), 6) mean_size, median(size)::double median_size from (select r.vec_id, max((i = label and c - v < 0.9)::int) hit, count(*) filter (c - v < 0.9) size from {RANKED} r join embeddings e on e.vec_id = r.vec_id group by r.vec_id)")
def nucleus_coverage(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select((F.get(vx.apply_top_p("p", 0.9), F.col("label")) > 0).cast("double").alias("hit"), vx.nucleus_size("p", 0.9).alias("size"))
    return x.agg(r6(F.avg("hit")).alias("coverage"), r6(F.avg("size")).alias("mean_size"), F.percentile("size", F.lit(0.5)).alias("median_size"))


@query("w11_cumulative_mass", f"select vec_id, k::bigint k, round(max(c) filter (rn <= k), 6) mass from (select *, row_number() over (partition by vec_id order by v desc, i) rn from {RANKED}), (select unnest([1, 3, 5, 10, 20]) k) group by all")
def cumulative_mass(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select("vec_id", vx.ranked("p").alias("r"))
    x = x.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10, 20)])))
    return x.select("vec_id", F.col("k").cast("long").alias("k"), r6(F.aggregate(F.slice("r", F.lit(1), F.col("k")), F.lit(0.0), lambda a, s: a + s["p"])).alias("mass"))


@query("j02_j03_top_k", f"select vec_id, i::bigint id, rn::bigint rank, round(v, 6) p from (select *, row_number() over (partition by vec_id order by v desc, i) rn from {RANKED}) where rn <= 5")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select("vec_id", F.posexplode(F.slice(vx.ranked("p"), 1, 5)).alias("r", "s"))
    return x.select("vec_id", F.col("s.i").cast("long").alias("id"), (F.col("r") + 1).cast("long").alias("rank"), r6(F.col("s.p")).alias("p"))


@query("u03_topk_overlap", f"""with a as (select vec_id, i, row_number() over (partition by vec_id order by v desc, i) rn from (select vec_id, unnest(p) v, generate_subscripts(p, 1) i from {PQ})), b as (select vec_id, i, row_number() over (partition by vec_id order by v desc, i) rn from (select vec_id, unnest(q) v, generate_subscripts(q, 1) i from {PQ}))
  select e.vec_id, count(b.i)::double / 10 as overlap from embeddings e join a on a.vec_id = e.vec_id and a.rn <= 10 left join b on b.vec_id = a.vec_id and b.i = a.i and b.rn <= 10 group by e.vec_id""")
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", vx.overlap(vx.top_k("p", 10), vx.top_k("q", 10), 10).alias("overlap"))


LONG = f"(select vec_id, label, unnest(p) v, generate_subscripts(p, 1) - 1 pos from {PQ})"


@query("h03_h05_vector_mean", f"select pos::int pos, round(avg(v), 8) mean, round(greatest(avg(v * v) - avg(v) * avg(v), 0), 8) var from {LONG} group by pos")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    x = st.vector_mean(pairs(spark, d), "p")
    return x.select("pos", F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"))


@query("h04_softmax_of_mean", f"with m as (select pos, avg(v) m from (select unnest(t) v, generate_subscripts(t, 1) - 1 pos from {PAIRS}) group by pos) select pos::int pos, round(exp(m) / sum(exp(m)) over (), 8) p from m")
def softmax_of_mean(spark: SparkSession, d: str) -> DataFrame:
    v = st.as_vector(st.vector_mean(pairs(spark, d), "t"), "pos", "mean")
    return v.select(F.posexplode(vx.softmax("vec")).alias("pos", "p")).select("pos", F.round("p", 8).alias("p"))


@query("h06_entropy_by_group", f"select label::bigint n, round(avg(h), 6) mean_entropy, round(stddev_pop(h), 6) std_entropy, round(avg(exp(h)), 5) mean_ppl from (select label, -list_sum(list_transform(p, lambda x: x * ln(x))) h from {PQ}) group by label")
def entropy_by_group(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select(F.col("label").cast("long").alias("n"), vx.entropy("p").alias("h"))
    return x.groupBy("n").agg(r6(F.avg("h")).alias("mean_entropy"), r6(F.stddev_pop("h")).alias("std_entropy"), F.round(F.avg(F.exp("h")), 5).alias("mean_ppl"))


@query("h10_histogram", f"select bin::int bin, count(r)::bigint n from range(5) b(bin) left join (select case when r < 2 then 0 when r < 6 then 1 when r < 11 then 2 when r < 33 then 3 when r <= 64 then 4 end k, r from (select len(list_filter(p, lambda x: x >= p[label + 1])) r from {PQ})) on k = bin group by bin")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select(vx.target_rank("p", F.col("label")).alias("r"))
    return st.histogram(x, "r", [1, 2, 6, 11, 33, 64])


@query("j12_sorted_distribution", f"select rn::bigint rank, round(avg(v), 8) p from (select v, row_number() over (partition by vec_id order by v desc, i) rn from {RANKED}) where rn <= 20 group by rn")
def sorted_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select(F.posexplode(F.slice(vx.ranked("p"), 1, 20)).alias("r", "s"))
    return x.groupBy((F.col("r") + 1).cast("long").alias("rank")).agg(F.round(F.avg("s.p"), 8).alias("p"))


@query("w21_unit_scale", "select vec_id, round((t[1] - list_min(t)) / (list_max(t) - list_min(t) + 1e-12), 6) first from " + PAIRS)
def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("vec_id", r6(F.get(vx.unit_scale("t"), F.lit(0))).alias("first"))


@query("h40_next_token_distribution", """with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents where lang = 'es'), b as (select w[i] c, w[i+1] t from (select w, unnest(range(1, len(w))) i from w)), k as (select t, count(*) n from b where c = 'de' group by t)
  select t as token, n::bigint n, round(n::double / sum(n) over (), 8) p from k""")
def next_token_distribution(spark: SparkSession, d: str) -> DataFrame:
    from textloom.functions import text as tx

    g = read(spark, d, "documents").where("lang = 'es'").select(F.explode(tx.ngrams(tx.words("text"), 2)).alias("g")).where(F.get("g", F.lit(0)) == "de")
    x = st.shares(g.select(F.get("g", F.lit(1)).alias("token")), "token")
    return x.select("token", "n", F.round("share", 8).alias("p"))


@query("h41_record_entropy", f"select vec_id, round(list_avg(e), 6) mean_term, round(list_max(e), 6) max_term from (select vec_id, list_transform(p, lambda x: -x * ln(x)) e from {PQ})")
def record_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("p", lambda x: -x * F.ln(x))
    return pairs(spark, d).select("vec_id", r6(vx.let(e, lambda v: vx.total(v) / F.size(v))).alias("mean_term"), r6(F.array_max(e)).alias("max_term"))


@query("h14_word_mass", f"select pos::int token, round(sum(v) / 500, 8) mass from {LONG} group by pos having sum(v) / 500 > 0.01")
def word_mass(spark: SparkSession, d: str) -> DataFrame:
    x = pairs(spark, d).select(F.posexplode("p").alias("token", "v")).groupBy("token").agg((F.sum("v") / 500).alias("m"))
    return x.where("m > 0.01").select("token", F.round("m", 8).alias("mass"))


@query("l41_corrected_probability")
def corrected_probability(spark: SparkSession, d: str) -> DataFrame:
    """Product of a word's piece probabilities, corrected by the word-initial mass before and after."""
    even = lambda v: vx.total(F.transform(v, lambda x, i: F.when(i % 2 == 0, x).otherwise(0.0)))
    x = pairs(spark, d)
    prod = F.get("p", F.col("label")) * F.get("q", F.col("label"))
    raw = prod * even(F.col("q")) / (even(F.col("p")) + 1e-12)
    return x.select("vec_id", r6(F.greatest(F.nanvl(raw, F.lit(0.0)), F.lit(0.0))).alias("p"))
