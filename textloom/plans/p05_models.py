"""Clusters, selection, the n-gram scorer, model comparison, representation analysis and run logs (N, O, P, Q, R, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import schedules as sc
from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import cluster as cl
from textloom.operators import compare as cp
from textloom.operators import linear as ln
from textloom.operators import runs as rn
from textloom.operators import scorer as sr
from textloom.operators import select as se
from textloom.registry import query, read

E = "(select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings)"


def emb(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def r6(c):
    return F.round(c, 6)


@query("n01_l2_normalise", f"select vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) \"first\" from {E}")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("vec_id", r6(F.get(vx.l2_normalise("v"), F.lit(0))).alias("first"))


@query("n02_g08_cosine_pairs", f"select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.v, b.v), 6) s from {E} a join {E} b on a.vec_id < b.vec_id and a.label = b.label")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cl.cosine_pairs(emb(spark, d), "v", "vec_id", "label").select("a", "b", r6("s").alias("s"))


CENTER = f"(select label, list(m order by i) c from (select label, i, avg(x) m from (select label, unnest(v) x, generate_subscripts(v, 1) i from {E}) group by label, i) group by label)"


@query("n03_centroids", f"select label, round(c[1], 6) \"first\", round(sqrt(list_dot_product(c, c)), 6) norm from {CENTER}")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return cl.centroids(emb(spark, d), "v", "label").select("label", r6(F.get("center", F.lit(0))).alias("first"), r6(vx.norm("center")).alias("norm"))


@query("n08_g09_nearest_label", f"select vec_id, case when s < 0.3 then 'unknown' else l end label, round(s, 6) similarity from (select e.vec_id, arg_max(c.label::varchar, list_cosine_similarity(e.v, c.c)) l, max(list_cosine_similarity(e.v, c.c)) s from {E} e, {CENTER} c group by e.vec_id)")
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d)
    return cl.nearest(x, "v", "vec_id", cl.centroids(x, "v", "label"), "label", "center", 0.3).select("vec_id", "label", r6("similarity").alias("similarity"))


@query("j06_representatives", f"select label, vec_id, rank::int rank from (select e.label, e.vec_id, row_number() over (partition by e.label order by list_cosine_similarity(e.v, c.c) desc, e.vec_id) rank from {E} e join {CENTER} c using (label)) where rank <= 5")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d)
    return cl.representatives(x, "v", "vec_id", "label", cl.centroids(x, "v", "label"), 5).select("label", "vec_id", "rank")


SAMPLE = E


@query("n04_silhouette", f"""with p as (select a.vec_id i, a.label ci, b.label cj, avg(list_distance(a.v, b.v)) d from {SAMPLE} a join {SAMPLE} b on a.vec_id <> b.vec_id group by all), s as (select i, min(d) filter (ci = cj) a, min(d) filter (ci <> cj) b from p group by i)
  select i as vec_id, round(case when a is null then 0 else (b - a) / greatest(a, b) end, 6) silhouette from s""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return cl.silhouette(emb(spark, d), "v", "vec_id", "label").select(F.col("i").alias("vec_id"), r6("silhouette").alias("silhouette"))


@query("h11_pair_statistics", f"with s as (select case when a.vec_id = b.vec_id then 0 else list_cosine_similarity(a.v, b.v) end s from {SAMPLE} a, {SAMPLE} b) select round(avg(s), 6) mean, round(quantile_cont(s, 0.5), 6) median, round(quantile_cont(s, 0.1), 6) p10, round(quantile_cont(s, 0.9), 6) p90, round(min(s), 6) min, round(max(s), 6) max from s")
def pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = cl.pair_statistics(emb(spark, d), "v", "vec_id")
    return x.select(*[r6(c).alias(c) for c in x.columns])


@query("n03_n05_kmeans_sweep")
def kmeans_sweep(spark: SparkSession, d: str) -> DataFrame:
    return cl.sweep(emb(spark, d), "v", [5, 8, 10])


@query("n05_best_k", "select 8::int k")
def best_k(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(5, 0.2), (8, 0.4), (10, 0.4)], "k int, silhouette double")
    return cl.best_k(t)


@query("n06_components")
def components(spark: SparkSession, d: str) -> DataFrame:
    _, x = cl.principal_components(emb(spark, d), "v", 2)
    return x.select("vec_id", r6(F.abs(F.get("components", F.lit(0)))).alias("c0"), r6(F.abs(F.get("components", F.lit(1)))).alias("c1"))


@query("n09_source_types", "select source, case when source in ('src0', 'src1') then 'web' when regexp_matches(source, '^src1') then 'books' else 'other' end source_type, count(*)::bigint n from documents group by all")
def source_types(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    kind = F.when(s.isin("src0", "src1"), "web").when(s.rlike("^src1"), "books").otherwise("other")
    return read(spark, d, "documents").groupBy("source", kind.alias("source_type")).agg(F.count("*").alias("n"))


@query("n13_tfidf", """with t as (select lang, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) x from documents), tf as (select lang, x, count(*) tf from t group by all), df as (select x, count(*) df from tf group by x)
  select lang, x as token, round(tf * ln((4 + 1) / (df + 1)::double), 5) tfidf from tf join df using (x) where tf >= 200""")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("lang", F.explode(tx.words("text")).alias("token"))
    w = cl.tfidf(t, "lang", "token")
    big = t.groupBy("lang", "token").agg(F.count("*").alias("n")).where("n >= 200")
    return w.join(big, ["lang", "token"], "left_semi").select("lang", "token", F.round("tfidf", 5).alias("tfidf"))


@query("n10_top_terms")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("lang", F.explode(tx.words("text")).alias("token"))
    return cl.top_terms(cl.tfidf(t, "lang", "token"), "lang", "token", "tfidf", 5).select("lang", "token", "rank")


@query("o01_perplexity_floor", "select vec_id from embeddings where abs(embedding[1]::double) * 30 <= ln(1000.0::double)")
def perplexity_floor(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d).withColumn("loss", F.abs(F.get("v", F.lit(0))) * 30)
    return se.below_perplexity(x, "loss").select("vec_id")


@query("o04_agreeing", f"select e.vec_id, round(list_cosine_similarity(e.v, c.c), 6) agreement from {E} e join {CENTER} c using (label) where list_cosine_similarity(e.v, c.c) >= 0")
def agreeing(spark: SparkSession, d: str) -> DataFrame:
    return se.agreeing(emb(spark, d), "v", "label").select("vec_id", r6("agreement").alias("agreement"))


@query("o03_intra_cluster_distance", f"select e.label, round(avg(1 - list_cosine_similarity(e.v, c.c)), 6) distance from {E} e join {CENTER} c using (label) group by e.label")
def intra_cluster_distance(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d)
    return x.join(cl.centroids(x, "v", "label"), "label").groupBy("label").agg(r6(F.avg(1 - vx.cosine("v", "center"))).alias("distance"))


@query("o05_random_projection")
def random_projection(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("vec_id", F.transform(se.project("v", 8, 3), lambda x: F.round(x, 6)).alias("projected"))


@query("o07_facility_location")
def facility_location(spark: SparkSession, d: str) -> DataFrame:
    return se.facility_location(emb(spark, d), "v", "vec_id", 5).select("rank", "id", r6("gain").alias("gain"))


@query("o08_k_center")
def k_center(spark: SparkSession, d: str) -> DataFrame:
    return se.k_center(emb(spark, d), "v", "vec_id", 6).select("rank", "id", r6("radius").alias("radius"))


@query("o09_gradient_match")
def gradient_match(spark: SparkSession, d: str) -> DataFrame:
    return se.gradient_match(emb(spark, d), "v", "vec_id", 4).select("rank", "id", r6("weight").alias("weight"))


# the n-gram scorer


def tokens(spark: SparkSession, d: str, where: str) -> DataFrame:
    return read(spark, d, "documents").where(where).select(F.col("doc_id").alias("id"), tx.words("text").alias("tokens"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The first six words of each text of more than eight."""
    x = raw(spark, d).select("id", tx.words("text", first=8).alias("tokens"))
    return x.where(F.size("tokens") > 8).select("id", F.slice("tokens", 1, 6).alias("tokens"))


W = "(select doc_id id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents)"


@query("o02_x05_ngram_perplexity", f"""with w as (select id, unnest(w) t, generate_subscripts(w, 1) i, w from {W}), u as (select t, count(*) n from w group by t), tot as (select sum(n) m from u), b as (select w[i-1] c, t, count(*) n from w where i > 1 group by all), bc as (select c, sum(n) m from b group by c),
  s as (select w.id, ln(coalesce(case when w.i > 1 then b.n::double / bc.m end, 0.4 * u.n / tot.m)) lp from w join u on u.t = w.t left join b on w.i > 1 and b.c = w.w[w.i-1] and b.t = w.t left join bc on bc.c = b.c, tot)
  select id, count(*)::bigint n, round(exp(least(-avg(lp), 50)), 4) perplexity from s group by id""")
def ngram_perplexity(spark: SparkSession, d: str) -> DataFrame:
    x = tokens(spark, d, "true")
    return sr.perplexity(sr.NgramScorer(2).fit(x).score(x)).select("id", "n", F.round("perplexity", 4).alias("perplexity"))


@query("x03_next_tokens")
def next_tokens(spark: SparkSession, d: str) -> DataFrame:
    m = sr.NgramScorer(3).fit(raw(spark, d))
    return m.next_tokens(prompts(spark, d), 3).select("id", "rank", "token", r6("p").alias("p"))


@query("x06_generate")
def generate(spark: SparkSession, d: str) -> DataFrame:
    m = sr.NgramScorer(3).fit(raw(spark, d))
    return sr.generate(m, prompts(spark, d), 3).select("id", F.array_join("tokens", " ").alias("text"))


@query("f18_f19_token_tree")
def token_tree(spark: SparkSession, d: str) -> DataFrame:
    m = sr.NgramScorer(2).fit(tokens(spark, d, "true"))
    roots = spark.createDataFrame([(0, ["de"]), (1, ["la"])], "id long, tokens array<string>")
    return sr.token_tree(m, roots, 2, 3).select("root", "path", "depth", "token", r6("p").alias("p"))


# two models: a row's logits against the next row's, ten rows a block


def positions(spark: SparkSession, d: str) -> DataFrame:
    from textloom.plans.p03_vectors import pairs

    x = pairs(spark, d).select(F.floor(F.col("vec_id") / 10).alias("block_id"), (F.col("vec_id") % 10).alias("pos"), F.col("label").cast("int").alias("label"), F.col("t").alias("t_logits"), F.transform(F.zip_with("t", "s", lambda a, b: 0.8 * a + 0.2 * b), lambda z: z).alias("s_logits"))
    return cp.position_metrics(x)


PAIRS = "(select a.vec_id, a.label, list_transform(a.embedding, lambda x: x::double * 4) t, list_transform(b.embedding, lambda x: x::double * 4) s0 from embeddings a join embeddings b on b.vec_id = (a.vec_id + 1) % 500)"
MIXED = f"(select vec_id, label, t, list_transform(list_zip(t, s0), lambda z: 0.8 * z[1] + 0.2 * z[2]) s from {PAIRS})"
SOFT = "list_transform({0}, lambda y: exp(y - list_max({0})) / list_sum(list_transform({0}, lambda x: exp(x - list_max({0})))))"
POS = f"(select vec_id, label, list_position(t, list_max(t)) - 1 t_top, list_position(s, list_max(s)) - 1 s_top, {SOFT.format('t')} p, {SOFT.format('s')} q from {MIXED})"


@query("p01_block_metrics", f"""select floor(vec_id / 10)::bigint block_id, round(avg((t_top = s_top)::int), 6) top1_match, round(avg(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * ln(z[1] / z[2])))), 6) kl, round(avg(0.5 * list_sum(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2])))), 6) tv,
  round(avg(-ln(p[label + 1])), 6) t_nll, round(avg(-ln(q[label + 1])), 6) s_nll, count(*)::bigint n_tokens from {POS} group by 1""")
def block_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = cp.block_metrics(positions(spark, d))
    return b.select("block_id", *[r6(c).alias(c) for c in ("top1_match", "kl", "tv", "t_nll", "s_nll")], "n_tokens")


@query("p02_contingency", f"select count(*) filter (t_top = label and s_top = label)::bigint both_ok, count(*) filter (t_top = label and s_top <> label)::bigint teacher_only, count(*) filter (t_top <> label and s_top = label)::bigint student_only, count(*) filter (t_top <> label and s_top <> label)::bigint none_ok from {POS}")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return cp.contingency(positions(spark, d))


@query("p03_u04_error_overlap", f"select count(*) filter (t_top <> label)::bigint teacher_error, count(*) filter (t_top <> label and s_top <> label)::bigint error_intersection, count(*) filter (t_top <> label or s_top <> label)::bigint error_union, count(*) filter (t_top <> label and s_top = t_top)::bigint same_wrong, round(count(*) filter (t_top <> label and s_top <> label)::double / greatest(count(*) filter (t_top <> label or s_top <> label), 1), 6) jaccard from {POS}")
def error_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = cp.block_metrics(positions(spark, d))
    return b.agg(*[F.sum(c).alias(c) for c in ("teacher_error", "error_intersection", "error_union", "same_wrong")], r6(F.sum("error_intersection") / F.greatest(F.sum("error_union"), F.lit(1))).alias("jaccard"))


DRAW = "(select r // 50 draw, ('0x' || left(md5(concat_ws('-', r // 50, r % 50, '3')), 8))::bigint % 50 i from range(200 * 50) t(r))"


@query("p08_p09_bootstrap", f"""with b as (select floor(vec_id / 10)::bigint i, avg((t_top = s_top)::int) v from {POS} group by 1), m as (select draw, avg(v) m from {DRAW} d join b using (i) group by draw)
  select round((select avg(v) from b), 6) estimate, round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi from m""")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    b = cp.block_metrics(positions(spark, d)).withColumnRenamed("block_id", "i")
    return cp.bootstrap_mean(b, "top1_match", 200, 3).select(r6("estimate").alias("estimate"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("p09_bootstrap_ratio", f"""with b as (select floor(vec_id / 10)::bigint i, count(*) filter (t_top <> label and s_top <> label) a, count(*) filter (t_top <> label or s_top <> label) c from {POS} group by 1), m as (select draw, sum(a)::double / greatest(sum(c), 1) m from {DRAW} d join b using (i) group by draw)
  select round((select sum(a)::double / greatest(sum(c), 1) from b), 6) estimate, round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi from m""")
def bootstrap_ratio(spark: SparkSession, d: str) -> DataFrame:
    b = cp.block_metrics(positions(spark, d)).withColumnRenamed("block_id", "i")
    return cp.bootstrap_ratio(b, "error_intersection", "error_union", 200, 3).select(r6("estimate").alias("estimate"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("p05_perturbation_grid", "select f || '_' || format('{:.3f}', l) as \"key\", f family, l as level from (select 'noise' f, unnest([0.01, 0.05])::double l union all select 'dropout', unnest([0.1])::double union all select 'replacement', unnest([0.1])::double)")
def perturbation_grid(spark: SparkSession, d: str) -> DataFrame:
    return cp.perturbations(spark, [0.01, 0.05], [0.1], [0.1])


HITS = "(('0x' || left(md5(concat_ws('-', doc_id, i, '7')), 8))::bigint / 4294967296.0::double) < 0.2"


@query("p06_token_perturbation", f"""select doc_id block_id, count(*) filter (i > 0 and {HITS})::bigint dropped, count(*) filter (i > 0 and {HITS} and t <> ids[1 + (i + 1 + ('0x' || left(md5(concat_ws('-', doc_id, i, '8')), 8))::bigint % (n - 1)) % n])::bigint replaced
  from (select doc_id, ids, len(ids) n, unnest(ids) t, unnest(range(len(ids))) i from (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda x: ('0x' || left(md5(x), 5))::int) ids from documents)) where n > 1 group by doc_id""")
def token_perturbation(spark: SparkSession, d: str) -> DataFrame:
    """Tokens lost by dropout and changed by replacement, a block a document."""
    from textloom.operators import pack as pk

    x = read(spark, d, "documents").select(F.col("doc_id").alias("block_id"), pk.word_ids("text").alias("t")).where(F.size("t") > 1)
    y = cp.perturb_tokens(x, "t", 0.2, 7, "dropout").withColumnRenamed("perturbed", "dropped")
    y = cp.perturb_tokens(y, "t", 0.2, 7, "replacement").withColumnRenamed("perturbed", "replaced")
    changed = lambda c: F.size(F.filter(F.zip_with("t", c, lambda a, b: ~a.eqNullSafe(b)), lambda z: z)).cast("long")
    return y.select("block_id", changed("dropped").alias("dropped"), changed("replaced").alias("replaced"))


LETTERS = "string_split(left(md5(({0})::varchar), 4), '')"


@query("p10_p12_generation_metrics", f"""select event_id, round(1 - levenshtein(array_to_string(a, ''), array_to_string(b, '')) / 4.0::double, 6) edit_similarity, coalesce(list_position(list_transform(list_zip(a, b), lambda z: z[1] <> z[2]), true) - 1, 4)::bigint common_prefix, a = b exact,
  round(len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / 4.0::double, 6) position_match from (select event_id, {LETTERS.format('event_id % 50')} a, {LETTERS.format('(event_id * 7) % 50')} b from events)""")
def generation_metrics(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda k: F.transform(F.filter(F.split(F.left(F.md5(k.cast("string")), F.lit(4)), ""), lambda x: x != ""), lambda x: F.ascii(x))
    e = read(spark, d, "events").select("event_id", ids(F.col("event_id") % 50).alias("a"), ids((F.col("event_id") * 7) % 50).alias("b"))
    m = e.select("event_id", *cp.generation_metrics("a", "b"))
    return m.select("event_id", r6("edit_similarity").alias("edit_similarity"), "common_prefix", "exact", r6("position_match").alias("position_match"))


@query("p11_robustness", f"""with b as (select floor(vec_id / 10)::bigint block_id, avg((t_top = label)::int) tm, avg((s_top = label)::int) sm, avg(-ln(p[label + 1])) tn, avg(-ln(q[label + 1])) sn from {POS} group by 1) select 'noise_0.010' as "key", round(avg(tm), 6) t_stability, round(avg(sm), 6) s_stability, round(avg(sm) - avg(tm), 6) gap, abs(avg(sm) - avg(tm)) <= 0.05 in_band from b""")
def robustness(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    b = p.groupBy("block_id").agg(F.avg(F.col("t_ok").cast("double")).alias("t_match"), F.avg(F.col("s_ok").cast("double")).alias("s_match"), F.avg("t_nll").alias("t_nll"), F.avg("s_nll").alias("s_nll"))
    r = cp.robustness(b, b.withColumn("key", F.lit("noise_0.010")), 0.05)
    return r.select("key", r6("t_stability").alias("t_stability"), r6("s_stability").alias("s_stability"), r6("gap").alias("gap"), "in_band")


@query("p14_verdict", "select m as model_id, case when lo >= 0.95 and kl <= 0.1 and band then 'equivalent' else 'not_equivalent' end verdict from (values ('a', 0.96, 0.05, true), ('b', 0.96, 0.2, true), ('c', 0.9, 0.05, true), ('d', 0.99, 0.01, false)) t(m, lo, kl, band)")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("a", 0.96, 0.05, True), ("b", 0.96, 0.2, True), ("c", 0.9, 0.05, True), ("d", 0.99, 0.01, False)], "model_id string, lo double, kl double, band boolean")
    return x.select("model_id", cp.verdict(F.col("lo"), F.col("kl"), F.col("band")).alias("verdict"))


# representation


@query("q01_q05_representation")
def representation(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d).select("vec_id", F.col("v").alias("x"), F.transform("v", lambda v, i: v + i * 0.01).alias("y"))
    train, test = x.where("vec_id % 2 = 0"), x.where("vec_id % 2 = 1")
    _, scale, r2 = ln.procrustes(train, test, "x", "y")
    row = (ln.cka(x, "x", "y"), ln.effective_rank(x, "x"), ln.spectrum_cosine(x, "x", "y"), scale, r2)
    return spark.createDataFrame([tuple(round(v, 6) for v in row)], "cka double, effective_rank double, spectrum_cosine double, scale double, r2 double")


@query("q08_g14_head_assignment")
def head_assignment(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    x = e.select(F.floor(F.col("vec_id") / 32).alias("example"), F.floor(F.col("vec_id") % 32 / 8).cast("int").alias("layer"), (F.col("vec_id") % 8).cast("int").alias("head"), F.col("v").alias("t"), F.col("v").alias("s"))
    return ln.match_heads(ln.head_similarity(x)).select("layer", "teacher_head", "student_head", r6("cosine").alias("cosine"))


@query("q09_layer_conditioning", f"with r as (select label example, vec_id layer, 0.01::double * sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(v, v)) rel from {E}) select example, layer, round(rel, 6) relative, 1.0::double cumulative from r")
def layer_conditioning(spark: SparkSession, d: str) -> DataFrame:
    x = emb(spark, d).select(F.col("label").alias("example"), F.col("vec_id").alias("layer"), F.col("v").alias("clean"), F.transform("v", lambda z: z * 1.01).alias("noisy"))
    return ln.layer_conditioning(x).select("example", "layer", r6("relative").alias("relative"), r6("cumulative").alias("cumulative"))


@query("q10_h37_weight_noise")
def weight_noise(spark: SparkSession, d: str) -> DataFrame:
    w = emb(spark, d).select(F.col("label").alias("tensor"), F.posexplode("v").alias("pos", "w"))
    n = ln.inject_noise(w, 0.1, 3)
    return n.groupBy("tensor").agg(F.count("*").alias("numel"), F.round(F.avg(F.abs(F.col("noisy") - F.col("w"))), 6).alias("mean_shift"))


@query("c24_eligible_parameters", "select name, ok from (values ('layers.0.attn.weight', true), ('layers.0.norm.weight', false), ('lm_head.weight', false), ('layers.0.attn.bias', false)) t(name, ok)")
def eligible_parameters(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("layers.0.attn.weight", 2), ("layers.0.norm.weight", 1), ("lm_head.weight", 2), ("layers.0.attn.bias", 1)], "name string, ndim int")
    return x.select("name", ln.eligible("name", "ndim", include="layers", exclude="lm_head").alias("ok"))


# run logs, from events: a run a user, a step an event


LOG = "(select user_id run, event_id update_step, 3 + value / 100 loss, abs(value) / 50 grad_norm, sum(8192) over (partition by user_id order by event_id)::bigint tokens_processed, sum(0.5::double + (event_id % 7) / 10.0::double) over (partition by user_id order by event_id) elapsed from events)"


@query("r01_r03_training_metrics", f"""with l as (select *, row_number() over w rn, count(*) over (partition by run) n, 8192 / (elapsed - coalesce(lag(elapsed) over w, 0)) speed from {LOG} window w as (partition by run order by update_step))
  select run, count(*)::bigint updates, round(avg(loss) filter (rn <= 5), 6) first_loss, round(avg(loss) filter (rn > n - 5), 6) last_loss, round(quantile_cont(speed, 0.5) filter (rn > 2), 3) speed_median, round(avg((grad_norm > 1)::int), 6) clipped, round(min(loss), 6) min_loss, max(tokens_processed)::bigint tokens from l group by run""")
def training_metrics(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events")
    log = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("update_step"), (3 + F.col("value") / 100).alias("loss"), (F.abs("value") / 50).alias("grad_norm"), F.sum(F.lit(8192)).over(w).alias("tokens_processed"), F.sum(0.5 + (F.col("event_id") % 7) / 10.0).over(w).alias("session_elapsed_seconds"))
    m = rn.training_metrics(log, warm=2, edge=5)
    return m.select("run", "updates", r6("first_loss").alias("first_loss"), r6("last_loss").alias("last_loss"), F.round("speed_median", 3).alias("speed_median"), r6("clipped").alias("clipped"), r6("min_loss").alias("min_loss"), "tokens")


# Five recorded benchmark rows, batch size and peak MiB.
BENCH = [(1, 5926.0, 2682.2), (2, 8270.0, 4493.2), (4, 13072.0, 5907.3), (6, 18240.08984375, 6343.3), (8, 22863.8828125, 6785.2)]


@query("r02_benchmark_metrics", "select 'a' gpu, round(regr_slope(m, b), 4) slope, round(regr_intercept(m, b), 4) intercept, round(regr_r2(m, b), 8) r2, 8::int best_batch, 6785.2::double best_speed, 10::int first_failure from (values (1, 5926.0::double), (2, 8270.0), (4, 13072.0), (6, 18240.08984375), (8, 22863.8828125)) t(b, m)")
def benchmark_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", b, "ok", s, m, 24564.0) for b, m, s in BENCH] + [("a", 10, "oom", None, None, 24564.0)]
    x = spark.createDataFrame(rows, "gpu string, batch_size int, status string, tokens_per_second double, peak_mib double, total_mib double")
    m = rn.benchmark_metrics(x)
    return m.select("gpu", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), "best_batch", "best_speed", "first_failure")


@query("r06_resume_compatible", "select false compatible, 'seq_len' differing")
def resume_compatible(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([(512, 8)], "seq_len int, batch int")
    b = spark.createDataFrame([(256, 8)], "seq_len int, batch int")
    return rn.resume_compatible(a, b, ["seq_len", "batch"]).select("compatible", F.array_join("differing", ",").alias("differing"))


@query("r08_run_arithmetic", "select 8192::bigint tokens_per_update, 1221::bigint total_updates")
def run_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    n = sc.tokens_per_update(512, 8, 2)
    return spark.createDataFrame([(n, sc.total_updates(10_000_000, n))], "tokens_per_update long, total_updates long")


@query("r09_h39_recovery", "select 'x' run, 17.73::double teacher, 200.0::double post, 18.18::double \"final\", round((200 - 18.18::double) / (200 - 17.73::double) * 100, 6) recovery_pct")
def recovery(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("x", "teacher_baseline", 0, 17.73), ("x", "post_noise", 0, 200.0), ("x", "eval", 500, 30.0), ("x", "eval_final", 2000, 18.18)], "run string, phase string, step int, ppl double")
    return rn.recovery_table(x).withColumn("recovery_pct", r6("recovery_pct"))


@query("k14_rotation", "select run, step::int step, rn > 2 victim from (select *, row_number() over (partition by run order by step desc) rn from (select label run, vec_id step from embeddings where vec_id % 2 = 0))")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "embeddings").select(F.col("label").alias("run"), F.col("vec_id").cast("int").alias("step"), (F.col("vec_id") % 2 == 0).alias("complete"))
    return rn.rotate(x, 2).select("run", "step", "victim")


@query("l43_ngram_sweep", "select 5::int n, 0.0::double score")
def ngram_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The size of least weighted score; each part scaled over the sweep."""
    from textloom.operators import ordered as od

    rows = [(3, 6.9, 0.4, 0.6, 1.0), (4, 6.5, 0.3, 0.5, 0.5), (5, 6.1, 0.1, 0.3, 0.0), (6, 6.4, 0.2, 0.5, 0.4)]
    x = spark.createDataFrame(rows, "n int, ce double, instability double, support double, edge double")
    score = 0.60 * od.minmax("ce") + 0.20 * od.minmax("instability") + 0.15 * od.minmax("support") + 0.05 * od.minmax("edge")
    return x.withColumn("score", r6(score)).agg(F.min_by(F.struct("n", "score"), F.struct("score", "ce", "n")).alias("b")).select("b.n", "b.score")


@query("l45_cost_projection", "select t as tokens, round(t / 14810.4 / 3600 * 0.3, 4)::double cost from (select unnest([1e9, 3e10])::double t)")
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(1e9,), (3e10,)], "tokens double")
    return x.select("tokens", F.round(sc.cost(sc.gpu_hours("tokens", F.lit(14810.4)), F.lit(0.3)), 4).alias("cost"))

