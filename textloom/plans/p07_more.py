"""The inventory's remaining rows: trained predicates, token masks, small joins and orders, probes, formats, resume logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import classify as cf
from textloom.operators import compare as cp
from textloom.operators import dedup as dd
from textloom.operators import ordered as od
from textloom.operators import pack as pk
from textloom.operators import stats as st
from textloom.operators.prefix import exclusive_sum
from textloom.registry import query, read


def r6(c):
    return F.round(c, 6)


@query("c01_h08_language_predicate")
def language_predicate(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", "text", "lang")
    out = cf.is_language(cf.fit_language(x.where("doc_id % 2 = 0"), "text", "lang"), x, "text", "en")
    return out.select("doc_id", "lang_pred", "passes")


@query("l15_n12_quality_classifier")
def quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", "text")
    train = x.join(read(spark, d, "labels"), "doc_id")
    return cf.score_quality(cf.fit_quality(train, "text", "quality"), x, "text").select("doc_id", F.round("score", 4).alias("score"))


@query("d05_minhash_near_copies")
def minhash_near_copies(spark: SparkSession, d: str) -> DataFrame:
    return dd.minhash_near_copies(read(spark, d, "documents"), "text", "doc_id")


@query("d07_tied_storage", "select label::int storage, min(vec_id)::bigint param from embeddings group by label")
def tied_storage(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "embeddings").select(F.col("label").alias("storage"), F.col("vec_id").alias("param"))
    return dd.first_by_key(x, "storage", "param")


VOCAB = [(0, "Ġthe"), (1, "ing"), (2, "▁la"), (3, "."), (4, "Ġ12"), (5, "##s"), (6, "<s>")]


@query("c20_word_start_mask", "select * from (values (0, true), (1, false), (2, true), (3, false), (4, true), (5, false), (6, false)) t(token_id, starts)")
def word_start_mask(spark: SparkSession, d: str) -> DataFrame:
    """A boundary marker starts a word; without any marker in the vocabulary, whatever lacks ## does."""
    v = spark.createDataFrame(VOCAB, "token_id int, token string").withColumn("m", F.col("token").rlike(r"^[Ġ▁\s]"))
    some = F.max("m").over(Window.partitionBy())
    return v.select("token_id", F.when(some, F.col("m")).otherwise(~F.col("token").startswith("##")).alias("starts"))


@query("c21_word_start_detector", "select * from (values (0, true, 'the'), (1, false, 'ing'), (2, true, 'la'), (3, false, ''), (4, false, ''), (5, false, 's'), (6, false, 's')) t(token_id, ok, word)")
def word_start_detector(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame(VOCAB, "token_id int, token string")
    word = F.regexp_extract("token", r"[A-Za-zÀ-ÿ]+", 0)
    return v.select("token_id", (F.col("token").rlike("^[Ġ▁]") & (word != "")).alias("ok"), word.alias("word"))


@query("c22_confidence_filter", "select count(*)::bigint n from (select list_max(p) m from (select list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) p from (select list_transform(embedding, lambda x: x::double * 4) e from embeddings))) where m >= 0.2")
def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    p = vx.softmax(F.transform("embedding", lambda x: x.cast("double") * 4))
    return read(spark, d, "embeddings").where(F.array_max(p) >= 0.2).agg(F.count("*").alias("n"))


@query("c23_first_failure", "select count(*) filter (status = 'ok')::bigint n_ok, arg_min(batch, batch) filter (status <> 'ok')::int first_failure from (values (1, 'ok'), (2, 'ok'), (4, 'oom'), (8, 'oom')) t(batch, status)")
def first_failure(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(1, "ok"), (2, "ok"), (4, "oom"), (8, "oom")], "batch int, status string")
    return x.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.min_by("batch", F.when(F.col("status") != "ok", F.col("batch"))).alias("first_failure"))


@query("c25_low_similarity", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) < 0.0")
def low_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").withColumn("cosine", vx.cosine("v", "w"))
    return j.where("cosine < 0").select("vec_id", r6("cosine").alias("cosine"))


@query("e16_resample", "select d draw, s slot, ('0x' || left(md5(concat_ws('-', d, s, '4')), 8))::bigint % 100 i from range(20) a(d), range(100) b(s)")
def resample(spark: SparkSession, d: str) -> DataFrame:
    return cp.resample(spark.range(100), "i", 100, 20, 4)


@query("g12_layer_difference", "select a.label as layer, round(avg(a.embedding[1]::double) - avg(a.embedding[2]::double), 8) difference from embeddings a group by a.label")
def layer_difference(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    one = lambda k, name: e.groupBy(F.col("label").alias("layer")).agg(F.avg(F.get("embedding", F.lit(k)).cast("double")).alias(name))
    return one(0, "student").join(one(1, "teacher"), "layer").select("layer", F.round(F.col("student") - F.col("teacher"), 8).alias("difference"))


@query("w01_w02_running_offsets", "select doc_id, coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as at from documents".replace(" as at", " as start"))
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return exclusive_sum(x, "n", [], "doc_id", "start").select("doc_id", "start")


@query("w08_early_stop", "select 4::int n")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The first size whose last three perplexities lie within 2 %; the last size where none does."""
    x = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 49.8), (4, 49.5), (5, 49.4)], "n int, ppl double")
    w = Window.orderBy("n").rowsBetween(-2, 0)
    flat = (F.count("ppl").over(w) == 3) & (F.max("ppl").over(w) / F.min("ppl").over(w) - 1 < 0.02)
    return x.withColumn("flat", flat).agg(F.coalesce(F.min(F.when(F.col("flat"), F.col("n"))), F.max("n")).alias("n"))


@query("w19_phase_anchors", "select 'r' run, 17.5::double teacher, 200.0::double post, 20.0::double latest")
def phase_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = [("r", "teacher_baseline", 0, 17.5), ("r", "post_noise", 0, 200.0), ("r", "eval", 5, 40.0), ("r", "eval", 9, 20.0), ("r", "train", 12, 3.0)]
    x = spark.createDataFrame(rows, "run string, phase string, step int, ppl double")
    at = lambda c: F.max_by("ppl", F.when(c, F.col("step")))
    return x.groupBy("run").agg(at(F.col("phase") == "teacher_baseline").alias("teacher"), at(F.col("phase") == "post_noise").alias("post"), at(F.col("phase").startswith("eval")).alias("latest"))


@query("j09_j11_ordered_series", "select i::int place, layer::int layer from (select row_number() over (order by layer) i, layer from (values (1), (2), (10), (12)) t(layer))")
def ordered_series(spark: SparkSession, d: str) -> DataFrame:
    """String keys of layers in numeric order, layer 0 left out."""
    x = spark.createDataFrame([("10",), ("0",), ("2",), ("12",), ("1",)], "layer string").select(F.col("layer").cast("int").alias("layer")).where("layer > 0")
    return x.select(F.row_number().over(Window.orderBy("layer")).alias("place"), "layer")


@query("j10_level_slice", "select family, level, row_number() over (partition by family order by level)::int place from (values ('noise', 0.1::double), ('noise', 0.01), ('dropout', 0.2)) t(family, level) where family = 'noise'")
def level_slice(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("noise", 0.1), ("noise", 0.01), ("dropout", 0.2)], "family string, level double").where("family = 'noise'")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("level")))


@query("l09_token_edit_distance", "select event_id, levenshtein(a, b)::int distance, (case when left(a, 1) <> left(b, 1) then 0 when left(a, 2) <> left(b, 2) then 1 when left(a, 3) <> left(b, 3) then 2 else 3 end)::bigint prefix from (select event_id, left(md5(event_id::varchar), 8) a, left(md5((event_id + 1)::varchar), 8) b from events) where left(a, 3) <> left(b, 3)")
def token_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: F.transform(F.filter(F.split(F.left(F.md5(c.cast("string")), F.lit(8)), ""), lambda x: x != ""), lambda x: F.ascii(x) * 1000)
    x = read(spark, d, "events").select("event_id", ids(F.col("event_id")).alias("a"), ids(F.col("event_id") + 1).alias("b"))
    return x.select("event_id", cp.token_levenshtein("a", "b").alias("distance"), cp.common_prefix("a", "b").alias("prefix")).where("prefix < 3")


@query("l10_generation_match", "select 0.75::double position_match, false exact")
def generation_match(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 4])], "a array<int>, b array<int>")
    return x.select(*cp.generation_metrics("a", "b")).select("position_match", "exact")


@query("l13_k15_formats", "select vec_id, format('{:.1f}%', label * 10.0::double) pct, format('{:.3f}', label / 100.0::double) as \"key\" from embeddings")
def formats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.format_string("%.1f%%", F.col("label") * 10.0).alias("pct"), F.format_string("%.3f", F.col("label") / 100.0).alias("key"))


@query("n07_x02_scored_labels", "select vec_id, label::varchar label from embeddings where label in (0, 1)")
def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """A scorer's (id, label, score) rows, reduced to each id's best label; any model can fill them."""
    x = read(spark, d, "embeddings").where("label in (0, 1)")
    s = x.select("vec_id", F.explode(F.array(F.struct(F.lit("0").alias("label"), (F.col("label") == 0).cast("double").alias("score")), F.struct(F.lit("1").alias("label"), (F.col("label") == 1).cast("double").alias("score")))).alias("s"))
    return s.groupBy("vec_id").agg(F.max_by("s.label", "s.score").alias("label"))


@query("n11_failure_policy", "select doc_id, case when doc_id % 10 = 3 then null else length(text)::double end dim from documents where doc_id % 10 <> 3")
def failure_policy(spark: SparkSession, d: str) -> DataFrame:
    """Failed embeddings are null and leave the table; a zero vector would join a cluster."""
    x = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 3, F.length("text").cast("double")).alias("dim"))
    return x.where("dim is not null")


@query("o10_weighted_means", "select label, round(sum(embedding[1]::double * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1), 6) \"first\" from embeddings group by label")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    """The centre update of weighted k-means."""
    w = F.col("vec_id") % 5 + 1
    return read(spark, d, "embeddings").groupBy("label").agg(r6(F.sum(F.get("embedding", F.lit(0)).cast("double") * w) / F.sum(w)).alias("first"))


@query("o10_weighted_kmeans")
def weighted_kmeans(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = read(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"), (F.col("vec_id") % 5 + 1).cast("double").alias("w"))
    return KMeans(k=5, seed=1, weightCol="w", predictionCol="cluster").fit(x).transform(x).groupBy("cluster").agg(F.count("*").alias("n"))


@query("p04_p11_stability", "select vec_id % 10 block_id, round(avg((label = (vec_id % 10))::int), 6) stability from embeddings group by 1")
def stability(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("vec_id") % 10
    return read(spark, d, "embeddings").groupBy(b.alias("block_id")).agg(r6(F.avg((F.col("label") == b).cast("double"))).alias("stability"))


@query("p07_noisy_embeddings")
def noisy_embeddings(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.linear import hash_normal

    x = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("n", F.col("v") + 0.01 * hash_normal(5, "vec_id", "pos"))
    return x.groupBy("vec_id").agg(r6(F.sqrt(F.avg(F.pow(F.col("n") - F.col("v"), F.lit(2.0))))).alias("shift"))


@query("p13_trajectory_kl", "select 2::bigint n, round((0.5 * ln(0.5 / 0.25) + 0.5 * ln(0.5 / 0.75)) , 6)::double kl")
def trajectory_kl(spark: SparkSession, d: str) -> DataFrame:
    """Mean divergence over the generated positions only: prompt length less 1 up to the end."""
    rows = [(i, [0.5, 0.5], [0.25, 0.75] if i >= 2 else [0.5, 0.5]) for i in range(4)]
    x = spark.createDataFrame(rows, "pos int, p array<double>, q array<double>").where("pos >= 2")
    return x.agg(F.count("*").alias("n"), r6(F.avg(vx.kl("p", "q"))).alias("kl"))


@query("p15_p17_paired_models", "select alpha, round(max(case when objective = 'soft' then ppl end) - max(case when objective = 'hard' then ppl end), 4) difference from (values (0.05::double, 'soft', 18.18::double), (0.05, 'hard', 214.24), (0.1, 'soft', 19.2), (0.1, 'hard', 159.53)) t(alpha, objective, ppl) group by alpha")
def paired_models(spark: SparkSession, d: str) -> DataFrame:
    # Recorded final perplexities of two objectives.
    x = spark.createDataFrame([(0.05, "soft", 18.18), (0.05, "hard", 214.24), (0.1, "soft", 19.2), (0.1, "hard", 159.53)], "alpha double, objective string, ppl double")
    p = x.groupBy("alpha").pivot("objective", ["soft", "hard"]).agg(F.max("ppl"))
    return p.select("alpha", F.round(F.col("soft") - F.col("hard"), 4).alias("difference"))


@query("p16_r07_resume", "select vec_id from embeddings where vec_id >= 300")
def resume(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id")
    return e.join(e.where("vec_id < 300"), "vec_id", "left_anti")


@query("q06_rotation_invariance", "select 1.0::double cka")
def rotation_invariance(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators import linear as ln

    e = read(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    y = F.reverse("x")  # a permutation is a rotation or reflection
    return spark.createDataFrame([(round(ln.cka(e.withColumn("y", y), "x", "y"), 6),)], "cka double")


@query("q07_linear_probe")
def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    p = cf.linear_probe(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding", "label")
    return st.macro_scores(st.confusion(p, "label", "pred", list(range(10)))).select(r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query("x01_byte_tokens", "select doc_id, octet_length(encode(text))::bigint n_tokens, coalesce(list_sum(list_transform(string_split(hex(encode(text)), ''), lambda c: strpos('123456789ABCDEF', c))), 0)::bigint digits from documents")
def byte_tokens(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", pk.byte_ids(F.col("text")).alias("t"))
    digits = F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a + F.floor(v / 16) + v % 16)
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), digits.alias("digits"))


@query("x04_x12_gather_targets", "select doc_id, p as pos, w[p + 1] token from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w, unnest([0, 3, 7])::int p from documents) where p < len(w)")
def gather_targets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a scored table at target positions, by an equi join on (id, position)."""
    at = read(spark, d, "documents").select("doc_id", F.posexplode(tx.words("text")).alias("pos", "token"))
    want = spark.createDataFrame([(0,), (3,), (7,)], "pos int")
    return at.join(F.broadcast(want), "pos").select("doc_id", "pos", "token")


@query("k09_atomic_json", "select 1::int n")
def atomic_json(spark: SparkSession, d: str) -> DataFrame:
    """A small result dumped by the driver and read back whole."""
    import json
    import os
    import tempfile

    from textloom.sources.sinks import atomic_json as dump

    path = os.path.join(tempfile.mkdtemp(), "a.json")
    dump({"n": 1}, path)
    with open(path) as f:
        return spark.createDataFrame([(json.load(f)["n"],)], "n int")


@query("e20_halved_batches", "select doc_id, length(text)::bigint n from documents")
def halved_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch scorer that halves its batch when it runs out of memory, down to single rows."""
    import pandas as pd

    def score(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > 5:  # stands for an out-of-memory error of a model
            half = len(part) // 2
            return pd.concat([score(part.iloc[:half]), score(part.iloc[half:])])
        return pd.DataFrame({"doc_id": part["doc_id"], "n": part["text"].str.len()})

    return read(spark, d, "documents").select("doc_id", "text").mapInPandas(lambda ps: (score(p) for p in ps if len(p)), "doc_id long, n long")


@query("w05_windowed_widths", "select vec_id, round(avg(embedding[1]::double) over (partition by label order by vec_id rows between 2 preceding and current row), 6) moving from embeddings")
def windowed_widths(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("w"))
    return x.select("vec_id", r6(od.moving_mean("w", 3, "vec_id", ["label"])).alias("moving"))
