"""Cleaning, rejects, quality ratios and exact or overlap dedup of documents (C, D, E01-E04, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import dedup as dd
from textloom.operators import mix as mx
from textloom.operators.storage import checkpointed
from textloom.registry import query, read

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')"
LINE_OK = f"(not starts_with({STRIP.format('x')}, '©') and len(list_filter(regexp_split_to_array({STRIP.format('x')}, '\\s+'), lambda w: w <> '')) >= 5 and right({STRIP.format('x')}, 1) in ('.', '!', '?', '\"', ''''))"
PHRASES = "regexp_matches(lower(x), 'terms of use|privacy policy|cookie policy|uses cookies|use of cookies|use cookies|terms and conditions|all rights reserved|see ap\\.org')"
CLEAN = f"""array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: {LINE_OK} and not contains(lower(x), 'javascript') and not ({PHRASES})),
  lambda x: regexp_replace(x, '\\[\\d+\\]|\\[citation needed\\]', '', 'gi')), chr(10))"""
SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""
ALPHA = r"(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1)::double)"
CAPS = r"(len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}') and not regexp_matches(x, '\p{Ll}') and length(x) > 2)) / greatest(len(w), 1)::double)"
GRAMS = "list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))"
REPEAT = f"(case when len(w) >= 3 then 1 - len(list_distinct({GRAMS}))::double / len({GRAMS}) else 0.0 end)"
BASE = f"select doc_id, lang, source, text, {WORDS} w from documents"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


@query("c02_c05_clean_lines", f"select doc_id, md5({CLEAN}) clean_md5, length({CLEAN})::bigint n_chars_clean from documents")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", tx.clean_lines("text").alias("c"))
    return x.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("long").alias("n_chars_clean"))


@query("c02_line_validity", f"select doc_id, count(*)::bigint n_lines, sum(({LINE_OK})::int)::bigint n_valid from (select doc_id, unnest(string_split(text, chr(10))) x from documents) group by doc_id")
def line_validity(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(tx.line_is_valid(F.col("x")).cast("long")).alias("n_valid"))


@query("c03_c04_line_notices", f"select doc_id, sum(contains(lower(x), 'javascript')::int)::bigint n_script, sum(({PHRASES})::int)::bigint n_furniture from (select doc_id, unnest(string_split(text, chr(10))) x from documents) group by doc_id")
def line_notices(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return x.groupBy("doc_id").agg(F.sum(tx.has_script_notice(F.col("x")).cast("long")).alias("n_script"), F.sum(tx.has_boilerplate(F.col("x")).cast("long")).alias("n_furniture"))


@query("c06_c08_document_rejects", "select doc_id, contains(text, '{') has_brace, regexp_matches(text, 'lorem ipsum', 'i') has_placeholder, regexp_matches(lower(text), '\\b(?:scum|worthless)\\b') has_bad_word from documents")
def document_rejects(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.has_brace("text").alias("has_brace"), tx.has_placeholder("text").alias("has_placeholder"), tx.has_bad_word("text", ["scum", "worthless"]).alias("has_bad_word"))


@query("c09_c12_quality_ratios", f"select doc_id, round({ALPHA}, 6) alpha, round({CAPS}, 6) caps, round({REPEAT}, 6) repeated, len(w) > 0 and {ALPHA} >= 0.4 and {CAPS} <= 0.4 and {REPEAT} <= 0.25 passes from ({BASE})")
def quality_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", tx.figures("text").alias("f"))
    return x.select("doc_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("alpha", "caps", "repeated")], tx.passes_figures(F.col("f")).alias("passes"))


@query("c13_length_window", f"select doc_id, len(w)::bigint n_words, len(w) between 20 and 8000 passes from ({BASE})")
def length_window(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.word_count("text").alias("n_words"), tx.passes_length("text").alias("passes"))


@query("c14_f02_sentences", f"select doc_id, len({SENTENCES})::bigint n_sentences, len({SENTENCES}) >= 3 passes from documents")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(tx.sentences("text")).cast("long")
    return docs(spark, d).select("doc_id", n.alias("n_sentences"), (n >= 3).alias("passes"))


@query("c15_c16_score_floor", "select d.doc_id, quality::double score, coalesce(quality::double, 'inf'::double) >= 0.5 passes from documents d left join labels l using (doc_id) where text is not null and trim(text) <> ''")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).join(read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id", "left").where(tx.not_blank("text"))
    return x.select("doc_id", "score", tx.score_passes("score", 0.5).alias("passes"))


@query("c18_minimum_length", f"select (len(w) >= 100) enough, count(*)::bigint n from ({BASE}) group by 1")
def minimum_length(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select((F.size(tx.words("text")) >= 100).alias("enough")).groupBy("enough").agg(F.count("*").alias("n"))


@query("c26_confidence_gate", "select vec_id, case when m < 0.03 then 'Unclassified' else 'label_' || label end assigned from (select vec_id, label, list_max(list_transform(embedding, lambda x: exp(x::double))) / list_sum(list_transform(embedding, lambda x: exp(x::double))) m from embeddings)")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    from textloom.functions import vectors as vx

    x = read(spark, d, "embeddings").select("vec_id", "label", F.array_max(vx.softmax("embedding")).alias("m"))
    return x.select("vec_id", F.when(F.col("m") < 0.03, "Unclassified").otherwise(F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("assigned"))


@query("d01_exact_dedup", "select doc_id from (select doc_id, row_number() over (partition by md5(text) order by doc_id) rn from documents) where rn = 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dd.exact_first(docs(spark, d), "text", "doc_id").select("doc_id")


TRIGRAMS = f"select doc_id, unnest(list_distinct(list_transform(range(1, len(s) - 1), lambda i: md5(array_to_string(s[i:i+2], ' '))))) h from (select doc_id, {SENTENCES} s from documents)"


@query("d02_sentence_trigrams", f"select h as trigram, count(*)::bigint n_docs, min(doc_id) first_doc from ({TRIGRAMS}) group by h")
def sentence_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return dd.trigram_postings(docs(spark, d), "text", "doc_id").groupBy(F.col("hash").alias("trigram")).agg(F.count("*").alias("n_docs"), F.min("seq").alias("first_doc"))


@query("d03_greedy_overlap")
def greedy_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dd.greedy_overlap(docs(spark, d), "text", "doc_id").select("doc_id")


@query("d04_conservative_overlap", f"select doc_id from documents where doc_id not in (select distinct t.doc_id from ({TRIGRAMS}) t join (select h, min(doc_id) f from ({TRIGRAMS}) group by h) m on t.h = m.h where m.f < t.doc_id)")
def conservative_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dd.conservative_overlap(docs(spark, d), "text", "doc_id").select("doc_id")


@query("d06_unique_ngrams", f"select g as gram, min(pos)::bigint first_pos from (select unnest({GRAMS}) g, doc_id * 100000 + unnest(range(1, len(w) - 1)) pos from ({BASE}) where lang = 'es') group by g")
def unique_ngrams(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where("lang = 'es'").select("doc_id", F.posexplode(tx.joined_ngrams(tx.words("text"), 3)).alias("p", "gram"))
    return dd.unique_ngrams(x.withColumn("pos", F.col("doc_id") * 100000 + F.col("p") + 1))


@query("d08_ordered_union", "select vec_id, min(r)::bigint as rank, vec_id as ord from (select vec_id, 0 r from embeddings where label = 3 union all select vec_id, 1 from embeddings where label in (3, 4)) group by vec_id order by min(r), vec_id limit 20")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("ord", F.col("vec_id"))
    x = dd.ordered_union([e.where("label = 3"), e.where("label in (3, 4)")], "vec_id", "ord", 20)
    return x.select("vec_id", F.col("at.rank").cast("long").alias("rank"), F.col("at.ord").alias("ord"))


BUDGET = f"""select doc_id, source, est, before from (select doc_id, source, len(w) * 1.3::double est, coalesce(sum(len(w) * 1.3::double) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) before
  from ({BASE})) where before < case source when 'src0' then 6000 when 'src1' then 10000 when 'src2' then 4000 end"""


@query("e01_e04_source_budget", f"select doc_id, source, round(est, 4) est, round(before, 4) before from ({BUDGET})")
def source_budget(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", "source", tx.estimated_tokens("text").alias("est"))
    out = mx.source_budget(x, "source", "doc_id", "est", 20000, {"src0": 0.3, "src1": 0.5, "src2": 0.2})
    return out.select("doc_id", "source", F.round("est", 4).alias("est"), F.round("before", 4).alias("before"))


@query("e02_global_budget", f"select doc_id, source, round(g, 4) global_before from (select doc_id, source, coalesce(sum(est) over (order by source, doc_id rows between unbounded preceding and 1 preceding), 0) g from ({BUDGET})) where g < 15000")
def global_budget(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("doc_id", "source", tx.estimated_tokens("text").alias("est"))
    x = mx.source_budget(x, "source", "doc_id", "est", 20000, {"src0": 0.3, "src1": 0.5, "src2": 0.2})
    return mx.global_budget(x, ["source", "doc_id"], "est", 15000).select("doc_id", "source", F.round("global_before", 4).alias("global_before"))


@query("l01_fold_ascii")
def fold_ascii(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(tx.fold_ascii("text")).alias("folded_md5"))


def norm(t: str) -> str:
    return STRIP.format(rf"regexp_replace(regexp_replace({t}, '[ \x0b\x0c\x1c-\x1f]+', ' ', 'g'), '\n{{4,}}', chr(10) || chr(10), 'g')")


@query("l02_normalise_space", f"select doc_id, md5({norm('text')}) norm_md5 from documents")
def normalise_space(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(tx.normalise_space("text")).alias("norm_md5"))


#: A stand-in for the profanity list, which is a parameter.
BAD = ["scum", "worthless"]
FOLDED = norm(r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')")
STAGES = f"""select doc_id, source, md5(text) h, case when lang <> 'en' then 'language' when rejected then 'document' when {STRIP.format('text')} = '' then 'empty' when len(w) not between 20 and 8000 then 'length'
  when not (len(w) > 0 and {ALPHA} >= 0.4 and {CAPS} <= 0.4 and {REPEAT} <= 0.25) then 'quality' when len({SENTENCES}) < 3 then 'sentences' end reason, len(w) * 1.3::double est
  from (select *, {WORDS} w from (select doc_id, source, lang, rejected, {CLEAN} text from (select *, contains(text, '{{') or regexp_matches(text, 'lorem ipsum', 'i') or regexp_matches(lower(text), '\\b(?:scum|worthless)\\b') rejected
  from (select doc_id, source, lang, {FOLDED} text from documents))))"""


def reasons(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, text (cleaned), h, est and the reason of the first rule that rejects a document: the language, then on the
    normalised text the document's rejects, its lines, and on what these leave its length, figures and sentences."""
    x = docs(spark, d).select("doc_id", "source", "lang", tx.normalise("text").alias("text"))
    rejected = tx.has_brace("text") | tx.has_placeholder("text") | tx.has_bad_word("text", BAD)
    x = x.select("doc_id", "source", "lang", rejected.alias("rejected"), tx.clean_lines("text").alias("text"))
    x = x.withColumn("f", tx.figures("text"))
    reason = F.when(F.col("lang") != "en", "language").when(F.col("rejected"), "document").when(~tx.not_blank("text"), "empty").when(~F.col("f.n_words").between(20, 8000), "length").when(~tx.passes_figures(F.col("f")), "quality").when(F.size(tx.sentences("text")) < 3, "sentences")
    # cut here: filters on the reason would otherwise move below and clean each text once more for every rule
    return checkpointed(x.select("doc_id", "source", F.when(reason.isNull(), F.col("text")).alias("text"), F.md5("text").alias("h"), reason.alias("reason"), (F.col("f.n_words") * F.lit(1.3)).alias("est")))


def first_copies(x: DataFrame) -> DataFrame:
    """reasons' rows with 'exact' for the later ones of equal accepted texts."""
    first = x.where("reason is null").groupBy("h").agg(F.min("doc_id").alias("first"))
    return x.join(first, "h", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("first") != F.col("doc_id")), "exact").otherwise(F.col("reason"))).drop("first")


@query("l03_clean_stages", f"select doc_id, case when reason is null and row_number() over (partition by reason is null, h order by doc_id) > 1 then 'exact' else reason end reason from ({STAGES})")
def clean_stages(spark: SparkSession, d: str) -> DataFrame:
    return first_copies(reasons(spark, d)).select("doc_id", "reason")


@query("l03_clean_pipeline")
def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All stages: after the exact copies, documents that share three sentences in a row with an earlier accepted one go."""
    x = checkpointed(first_copies(reasons(spark, d)))
    kept = dd.greedy_overlap(x.where("reason is null").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.lit(True).alias("kept"))
    return x.join(kept, "doc_id", "left").select("doc_id", F.when(F.col("reason").isNull() & F.col("kept").isNull(), "overlap").otherwise(F.col("reason")).alias("reason"), F.md5(F.when(F.col("kept"), F.col("text"))).alias("clean_md5"))


@query("corpus_budget_report", f"""with k as (select * from ({STAGES}) where reason is null), f as (select source, doc_id, est from (select *, row_number() over (partition by h order by doc_id) rn from k) where rn = 1),
  b as (select *, coalesce(sum(est) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) before from f) select source, count(*)::bigint docs, round(sum(est), 3) tokens from b where before < 5000 group by source""")
def corpus_budget_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source: the English documents that survive cleaning, quality and exact dedup under a token budget."""
    from textloom.operators.prefix import exclusive_sum

    x = reasons(spark, d).where("reason is null")
    first = x.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    x = x.join(first, ["h", "doc_id"], "left_semi")
    b = exclusive_sum(x, "est", ["source"], "doc_id", "before").where("before < 5000")
    return b.groupBy("source").agg(F.count("*").alias("docs"), F.round(F.sum("est"), 3).alias("tokens"))


@query("l05_hashes", "select doc_id, md5(text) md5, sha256(text) sha256 from documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("l04_string_functions", "select doc_id, starts_with(text, 'The') starts, ends_with(text, '.') ends, length(replace(lower(text), ' the ', ' '))::bigint n, left(trim(text), 12) head from documents")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).select("doc_id", t.startswith("The").alias("starts"), t.endswith(".").alias("ends"), F.length(F.replace(F.lower(t), F.lit(" the "), F.lit(" "))).cast("long").alias("n"), F.left(F.trim(t), F.lit(12)).alias("head"))


@query("l06_l07_cycle", "select doc_id, length(x) > 20 and contains(left(x, greatest(length(x) - 20, 0)), right(text, 20)) and length(text) >= 100 cycle from (select doc_id, text, right(text, 200) x from documents)")
def cycle(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tx.ends_in_cycle("text", 200, 20, 100).alias("cycle"))


@query("l08_json_reply", "select event_id, coalesce(json_extract_string(nullif(regexp_extract('reply: ' || props || ' ok', '(?s)\\{.*\\}', 0), ''), '$.domain'), trim('reply: ' || props || ' ok')) answer from events")
def json_reply(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").withColumn("reply", F.concat(F.lit("reply: "), F.col("props"), F.lit(" ok")))
    return x.select("event_id", tx.json_domain("reply").alias("answer"))


@query("l11_token_words", "select unnest(['Ġthe', '▁la', '##ing', 'plain']) token, regexp_replace(token, '^(Ġ|▁|##)', '') word")
def token_words(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([("Ġthe",), ("▁la",), ("##ing",), ("plain",)], "token string")
    return x.select("token", tx.word_from_token("token").alias("word"))


@query("l12_prompt_template", "select doc_id, 'Classify the text.' || chr(10) || left(text, 80) || chr(10) || 'Domain:' prompt from documents")
def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.format_string("%s\n%s\n%s", F.lit("Classify the text."), F.left("text", F.lit(80)), F.lit("Domain:")).alias("prompt"))


@query("c19_meaningful_tokens")
def meaningful_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t,) for t in ("Ġhouse", "house", "Ġa", "Ġthe", "ĠUSA", "Ġx1", "▁maison", None)]
    x = spark.createDataFrame(rows, "token string")
    return x.select("token", tx.is_meaningful_token("token", ("the", "of")).alias("meaningful"))
