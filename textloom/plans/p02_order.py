"""Sampling, splits, batches, packing, windows of tokens, set operations and top-k (E05-E19, F, U, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import mix as mx
from textloom.operators import pack as pk
from textloom.operators import prefix as px
from textloom.registry import query, read

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
BASE = f"select doc_id, lang, source, text, {WORDS} w from documents"
IDS = "list_transform(w, lambda x: ('0x' || left(md5(x), 5))::int)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def hex8(*parts: str) -> str:
    return f"('0x' || left(md5(concat_ws('-', {', '.join(parts)})), 8))::bigint"


@query("e05_hash_shuffle", "select doc_id, row_number() over (order by md5(concat_ws('-', doc_id, '42')), doc_id)::bigint - 1 as place from documents")
def hash_shuffle(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id").withColumn("h", mx.hash_order("doc_id", 42))
    return px.row_index(x, ["h", "doc_id"], "place").select("doc_id", "place")


@query("e07_tail_split", "select doc_id, case when row_number() over (order by doc_id) > (select count(*) from documents) - 100 then 'validation' else 'train' end split from documents")
def tail_split(spark: SparkSession, d: str) -> DataFrame:
    return mx.tail_split(docs(spark, d).select("doc_id"), "doc_id", 100)


@query("e08_c15_held_out", "select doc_id from (select doc_id, row_number() over (order by doc_id) rn from documents left join labels using (doc_id) where coalesce(quality::double, 'inf'::double) >= 0.5) where rn > 500")
def held_out(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).join(read(spark, d, "labels"), "doc_id", "left").where(tx.score_passes(F.col("quality").cast("double"), 0.5)).select("doc_id")
    return px.row_index(x, ["doc_id"], "i").where("i >= 500").select("doc_id")


@query("e09_f07_fixed_blocks", f"""select floor(g / 128)::bigint block_id, sum(t)::bigint total, count(*)::bigint n from (select unnest(list_append({IDS}, 7)) t, o + unnest(range(len(w) + 1)) g
  from (select *, coalesce(sum(len(w) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) o from ({BASE}))) group by 1 having count(*) = 128""")
def fixed_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = pk.pack(docs(spark, d).select("doc_id", pk.word_ids("text").alias("t")), "t", "doc_id", 128, 7)
    return b.select("block_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("tokens").cast("long").alias("n"))


@query("f07_packing", f"""select block_id, sum(t)::bigint total, min(g)::bigint first from (select unnest(list_append({IDS}, 7)) t, o + unnest(range(len(w) + 1)) g, floor((o + unnest(range(len(w) + 1))) / 512)::bigint block_id
  from (select *, coalesce(sum(len(w) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) o from ({BASE}))) group by block_id having count(*) = 512""")
def packing(spark: SparkSession, d: str) -> DataFrame:
    b = pk.pack(docs(spark, d).select("doc_id", pk.word_ids("text").alias("t")), "t", "doc_id", 512, 7)
    return b.select("block_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.col("block_id") * 512).alias("first"))


@query("k05_token_shards", f"""select shard, 'uint32' dtype, count(*)::bigint tokens from (select floor((o + unnest(range(len(w)))) / 10000)::bigint shard
  from (select *, coalesce(sum(len(w)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) o from ({BASE}))) group by shard""")
def token_shards(spark: SparkSession, d: str) -> DataFrame:
    return pk.shard_manifest(pk.shards(docs(spark, d).select("doc_id", pk.word_ids("text").alias("t")), "t", "doc_id", 10000, 1 << 20))


@query("k04_row_shards", "select floor((rn - 1) / 64)::bigint shard, count(*)::bigint n_rows, min(doc_id) first_doc from (select doc_id, row_number() over (order by doc_id) rn from documents) group by 1")
def row_shards(spark: SparkSession, d: str) -> DataFrame:
    from textloom.sources.sinks import sharded

    return sharded(docs(spark, d).select("doc_id"), "doc_id", 64).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"))


@query("k06_k07_exact_slice", "select count(*)::bigint n, sum(length(text))::bigint chars from (select text from documents order by doc_id limit 150)")
def exact_slice(spark: SparkSession, d: str) -> DataFrame:
    x = px.row_index(docs(spark, d).select("doc_id", "text"), ["doc_id"], "i").where("i < 150")
    return x.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("e10_full_batches", "select batch_id, count(*)::bigint n, min(doc_id) first_doc from (select floor((row_number() over (order by doc_id) - 1) / 48)::bigint batch_id, doc_id from documents) group by batch_id having count(*) = 48")
def full_batches(spark: SparkSession, d: str) -> DataFrame:
    return mx.batches(docs(spark, d).select("doc_id"), ["doc_id"], 48, drop_last=True).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("e12_capped_batches", "select batch_id, count(*)::bigint n from (select floor((row_number() over (order by doc_id) - 1) / 32)::bigint batch_id from (select doc_id from documents order by doc_id limit 150)) group by batch_id")
def capped_batches(spark: SparkSession, d: str) -> DataFrame:
    return mx.batches(docs(spark, d).select("doc_id"), ["doc_id"], 32, cap=150).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("e11_epochs", """select epoch, batch_id, sum(vec_id)::bigint ids from (select epoch, vec_id, floor((rn - 1) / 96)::bigint batch_id from (select epoch, vec_id, row_number() over (partition by epoch order by md5(concat_ws('-', vec_id, epoch, '7')), vec_id) rn,
  count(*) over (partition by epoch) n from embeddings, (select unnest(range(3))::int epoch)) where rn <= floor(n / 96) * 96) group by all""")
def epochs(spark: SparkSession, d: str) -> DataFrame:
    return mx.epochs(read(spark, d, "embeddings").select("vec_id"), "vec_id", 96, 3, 7).groupBy("epoch", "batch_id").agg(F.sum("vec_id").alias("ids"))


@query("e13_sample", "select vec_id from embeddings order by md5(concat_ws('-', vec_id, '5')), vec_id limit 100")
def sample(spark: SparkSession, d: str) -> DataFrame:
    return mx.sample_rows(read(spark, d, "embeddings").select("vec_id"), "vec_id", 100, 5).select("vec_id")


@query("e14_even_stride", "select vec_id from (select vec_id, row_number() over (order by vec_id) - 1 i, count(*) over () n from embeddings) where i in (select floor(k * (n - 1) / 49)::bigint from range(50) t(k))")
def even_stride(spark: SparkSession, d: str) -> DataFrame:
    return mx.even_stride(read(spark, d, "embeddings").select("vec_id"), ["vec_id"], 50).select("vec_id")


@query("e17_w18_strata", """select vec_id, label, round(p, 6) percent, case when p < 0.1 then 'easy' when p < 0.8 then 'core' else 'hard' end stratum
  from (select vec_id, label, percent_rank() over (partition by label order by embedding[1]::double, vec_id) p from embeddings)""")
def strata(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("loss"))
    return mx.strata(x, "label", "loss", "vec_id").select("vec_id", "label", F.round("percent", 6).alias("percent"), "stratum")


@query("o06_difficulty_quotas", """select vec_id, label, stratum from (select *, row_number() over (partition by label, stratum order by md5(concat_ws('-', vec_id, '3')), vec_id) rn from (select vec_id, label, case when p < 0.1 then 'easy' when p < 0.8 then 'core' else 'hard' end stratum
  from (select vec_id, label, percent_rank() over (partition by label order by embedding[1]::double, vec_id) p from embeddings))) where rn <= case stratum when 'easy' then 1 when 'core' then 7 when 'hard' then 2 end""")
def difficulty_quotas(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("loss"))
    return mx.quotas(mx.strata(x, "label", "loss", "vec_id"), "label", "vec_id", {"easy": 1, "core": 7, "hard": 2}, 3).select("vec_id", "label", "stratum")


@query("e06_interleave", f"""with a as (select doc_id, row_number() over (order by doc_id) - 1 k from documents where lang = 'fr'), b as (select doc_id, row_number() over (order by doc_id) - 1 k from documents where lang = 'de'),
  n as (select (select count(*) from a) na, (select count(*) from b) nb), p as (select i, ({hex8('i', "'9'")} / 4294967296.0::double) < 0.6 coin from range((select na + nb from n)) t(i)),
  c as (select i, coin, coalesce(sum(coin::int) over (order by i rows between unbounded preceding and 1 preceding), 0) h from p), t as (select i, coin, h, i - h tl, na, nb from c, n),
  s as (select i, case when h >= na then false when tl >= nb then true else coin end f, h, tl, na, nb from t), k as (select i, f, case when f then case when tl >= nb then i - nb else h end else case when h >= na then i - na else tl end end k from s)
  select i::bigint position, f from_first, coalesce(a.doc_id, b.doc_id) doc_id from k left join a on f and a.k = k.k left join b on not f and b.k = k.k""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", "lang")
    return mx.interleave(x.where("lang = 'fr'").drop("lang"), x.where("lang = 'de'").drop("lang"), "doc_id", 0.6, 9)


@query("e18_progressive_prefixes", f"select doc_id, n::bigint n, array_to_string(w[1:n], ' ') prefix from (select doc_id, w, unnest(list_filter(list_distinct(list_concat(range(2, 17, 2), [least(len(w), 16)])), lambda n: n <= least(len(w), 16))) n from ({BASE}) where len(w) >= 2)")
def progressive_prefixes(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", tx.words("text").alias("w")).where(F.size("w") >= 2)
    top = F.least(F.size("w"), F.lit(16))
    n = F.filter(F.array_distinct(F.concat(F.sequence(F.lit(2), F.lit(16), F.lit(2)), F.array(top))), lambda i: i <= top)
    x = x.withColumn("n", F.explode(n))
    return x.select("doc_id", F.col("n").cast("long").alias("n"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("prefix"))


@query("e19_expanding_windows", f"select doc_id, unnest(list_distinct(list_concat(range(64, len(w) + 1, 64), [len(w)])))::bigint size from ({BASE}) where len(w) >= 64")
def expanding_windows(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.size(tx.words("text")).alias("n")).where("n >= 64")
    return x.select("doc_id", F.explode(F.transform(F.array_distinct(F.concat(F.sequence(F.lit(64), F.col("n"), F.lit(64)), F.array("n"))), lambda i: i.cast("long"))).alias("size"))


@query("f01_f21_word_tokens", r"select doc_id, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+|[0-9]+'))::bigint n, list_first(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ]+|[0-9]+')) first from documents")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    p = F.lit("[A-Za-zÀ-ÿ]+|[0-9]+")
    return docs(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", p, F.lit(0))).cast("long").alias("n"), F.get(F.regexp_extract_all(F.lower("text"), p, F.lit(0)), F.lit(0)).alias("first"))


@query("f06_f13_ngram_contexts", f"select n::bigint n, array_to_string(w[i:i+n-2], ' ') context, w[i+n-1] target, count(*)::bigint hits from (select w, n, unnest(range(1, len(w) - n + 2)) i from ({BASE}), (select unnest([2, 3]) n) where lang = 'es') group by all having count(*) >= 3")
def ngram_contexts(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where("lang = 'es'").select(tx.words("text").alias("w"))
    out = None
    for n in (2, 3):
        g = x.select(F.explode(tx.ngrams(F.col("w"), n)).alias("g")).select(F.lit(n).cast("long").alias("n"), F.array_join(F.slice("g", 1, n - 1), " ").alias("context"), F.element_at("g", n).alias("target"))
        out = g if out is None else out.unionByName(g)
    return out.groupBy("n", "context", "target").agg(F.count("*").alias("hits")).where("hits >= 3")


@query("f08_f09_random_window", f"select doc_id, array_to_string(w[s+1:s+8], ' ') gram from (select doc_id, w, {hex8('doc_id', "'8'", "'11'")} % (len(w) - 7) s from ({BASE}) where len(w) >= 8)")
def random_window(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", tx.words("text").alias("w")).where(F.size("w") >= 8)
    return x.select("doc_id", F.array_join(pk.random_window(F.col("w"), "doc_id", 8, 11), " ").alias("gram"))


@query("f10_first_words", f"select doc_id, array_to_string(w[1:12], ' ') prompt from ({BASE})")
def first_words(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", pk.first_words("text", 12).alias("prompt"))


@query("f11_prefix_split", f"select doc_id, array_to_string(w[1:32], ' ') prefix, array_to_string(w[33:96], ' ') continuation from ({BASE}) where len(w) >= 96")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    x = pk.prefix_split(docs(spark, d).select("doc_id", tx.words("text").alias("w")), "w", 32, 64)
    return x.select("doc_id", F.array_join("prefix_tokens", " ").alias("prefix"), F.array_join("continuation_tokens", " ").alias("continuation"))


@query("f12_domain_ngrams", r"""select g gram, count(*)::bigint n from (select unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) g from (select list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda x: len(x) > 1 and x not in ('the', 'of', 'and')) t
  from documents where lang = 'en')) group by g having count(*) >= 2""")
def domain_ngrams(spark: SparkSession, d: str) -> DataFrame:
    t = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)), lambda x: (F.length(x) > 1) & ~x.isin("the", "of", "and"))
    x = docs(spark, d).where("lang = 'en'").select(F.explode(tx.joined_ngrams(t, 3)).alias("gram"))
    return x.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2")


@query("f17_token_slices", f"select doc_id, floor((i - 1) / 100)::bigint slice, count(*)::bigint n from (select doc_id, unnest(range(1, len(w) + 1)) i from ({BASE})) group by all")
def token_slices(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.posexplode(tx.words("text")).alias("i", "w"))
    return x.groupBy("doc_id", F.floor(F.col("i") / 100).alias("slice")).agg(F.count("*").alias("n"))


@query("f03_f20_recursive_chunks")
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return pk.chunk_documents(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))


@query("f05_chunk_records", "select format('{}_{:06d}_{:03d}', 'synthetic', doc_id, 0) chunk_id, 'synthetic' dataset, 'document' source_type, null::varchar domain, null::double confidence, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int token_count from documents")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    c = pk.chunk_records(docs(spark, d).select("doc_id", F.lit(0).alias("chunk_no"), F.col("text").alias("chunk")), "synthetic")
    return c.select("chunk_id", "dataset", "source_type", "domain", "confidence", "token_count")


@query("f04_logical_chunks")
def logical_chunks(spark: SparkSession, d: str) -> DataFrame:
    f = F.udf(lambda t: len(pk.logical_chunks(t, 64, 256)), "int")
    return docs(spark, d).select("doc_id", f("text").alias("n_chunks"))


@query("f14_rebuild_sentence")
def rebuild_sentence(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(0, ["Hello", ",", "world"], ["SpaceAfter=No", "_", "_"])], "sentence int, words array<string>, misc array<string>")
    return x.select("sentence", pk.rebuild_sentence(F.col("words"), F.col("misc")).alias("r")).select("sentence", "r.text", F.size("r.spans").alias("n_spans"))


@query("g07_f15_interval_overlap", """with w as (select event_id sentence, 0 word, (event_id % 7)::int s, (event_id % 7 + 5)::int e from events union all select event_id, 1, (event_id % 7 + 6)::int, (event_id % 7 + 9)::int from events),
  t as (select event_id sentence, k::int token, (k * 3)::int s, (k * 3 + 3)::int e from events, range(6) r(k)) select w.sentence, w.word::int word, min(token)::int token from w join t on w.sentence = t.sentence and t.s < w.e and t.e > w.s group by all""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("sentence"), (F.col("event_id") % 7).cast("int").alias("a"))
    w = e.select("sentence", F.lit(0).alias("word"), F.col("a").alias("start"), (F.col("a") + 5).alias("end")).unionByName(e.select("sentence", F.lit(1).alias("word"), (F.col("a") + 6).alias("start"), (F.col("a") + 9).alias("end")))
    t = e.select("sentence", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("token")).select("sentence", "token", (F.col("token") * 3).alias("start"), (F.col("token") * 3 + 3).alias("end"))
    return pk.first_overlap(w, t)


@query("f16_running_limit", "select doc_id, n::bigint n from (select doc_id, length(text) n, sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding) b from documents) where coalesce(b, 0) < 50000")
def running_limit(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n"))
    return px.exclusive_sum(x, "n", [], "doc_id", "b").where("b < 50000").select("doc_id", "n")


@query("u01_union_sources", "select source_rank::int source_rank, source, count(*)::bigint n from (select 0 source_rank, source from documents where source = 'src1' union all select 1, source from documents where source = 'src0') group by all")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("source")
    u = x.where("source = 'src1'").withColumn("source_rank", F.lit(0)).unionByName(x.where("source = 'src0'").withColumn("source_rank", F.lit(1)))
    return u.groupBy("source_rank", "source").agg(F.count("*").alias("n"))


@query("u02_intersection", "select count(*)::bigint n from (select distinct source from documents where lang = 'es' intersect select distinct source from documents where lang = 'de')")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return x.where("lang = 'es'").select("source").intersect(x.where("lang = 'de'").select("source")).agg(F.count("*").alias("n"))


@query("u06_except", "select doc_id from documents except select doc_id from labels")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id").exceptAll(read(spark, d, "labels").select("doc_id")).distinct()


@query("u07_shingle_jaccard", f"""with s as (select doc_id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) g from ({BASE})),
  c as (select *, case when len(g) > 0 then min(doc_id) over (partition by g) else doc_id end class_id from s), p as (select class_id, len(g) n, unnest(g) x from c where doc_id = class_id),
  j as (select a.class_id u, b.class_id v from p a join p b on a.x = b.x and a.class_id <> b.class_id group by a.class_id, b.class_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))), k as (select u, count(*) n from j group by u)
  select doc_id, class_id, coalesce(k.n, 0)::bigint n_links from c left join k on k.u = c.class_id""")
def shingle_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each document's class of equal sets of five-word shingles, and the number of other classes at 0.75 or more."""
    from textloom.operators import dedup as dd

    return dd.similar_sets(docs(spark, d).select("doc_id", tx.shingles("text", 5).alias("g")), "doc_id", "g")


@query("u05_union_vocabulary", f"""with p as (select x, count(*)::double / sum(count(*)) over () p from (select unnest(w) x from ({BASE}) where lang = 'es') group by x), q as (select x, count(*)::double / sum(count(*)) over () q from (select unnest(w) x from ({BASE}) where lang = 'fr') group by x),
  u as (select coalesce(p, 1e-10) p, coalesce(q, 1e-10) q from p full join q using (x)), s as (select sum(p) sp, sum(q) sq from u) select round(sum(p / sp * ln((p / sp) / (q / sq))), 6) kl, count(*)::bigint vocabulary from u, s""")
def union_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    def dist(lang: str, name: str) -> DataFrame:
        n = docs(spark, d).where(F.col("lang") == lang).select(F.explode(tx.words("text")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("x", (F.col("n") / F.col("t")).alias(name))

    u = dist("es", "p").join(dist("fr", "q"), "x", "full").select(F.coalesce("p", F.lit(1e-10)).alias("p"), F.coalesce("q", F.lit(1e-10)).alias("q"))
    s = u.crossJoin(F.broadcast(u.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))))
    a, b = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return s.agg(F.round(F.sum(a * F.ln(a / b)), 6).alias("kl"), F.count("*").alias("vocabulary"))


@query("j01_multi_key_sort", "select label, vec_id, row_number() over (order by label nulls first, vec_id desc)::bigint as place from embeddings order by place limit 50")
def multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy(F.col("label").asc_nulls_first(), F.col("vec_id").desc())
    x = read(spark, d, "embeddings").select("label", "vec_id").orderBy(F.col("label").asc_nulls_first(), F.col("vec_id").desc()).limit(50)
    return x.withColumn("place", F.row_number().over(w).cast("long"))


@query("j04_most_common", f"select x as word, count(*)::bigint n from (select unnest(w) x from ({BASE})) group by x order by n desc, word limit 25")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.explode(tx.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query("j07_examples_per_group", "select source, doc_id, left(text, 40) preview from (select *, row_number() over (partition by source order by doc_id) rn from documents) where rn <= 3")
def examples_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs(spark, d).select("source", "doc_id", F.left("text", F.lit(40)).alias("preview"), F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("j08_hard_limit", "select doc_id from documents where length(text) >= 200 and doc_id not in (select doc_id from labels) order by doc_id limit 120")
def hard_limit(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where(F.length("text") >= 200).select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return x.orderBy("doc_id").limit(120)
