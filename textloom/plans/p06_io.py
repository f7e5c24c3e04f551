"""Sources, sinks and streams: each query writes what it needs to shared scratch storage and reads it back (S, K, T, C17, C27-C30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import mix as mx
from textloom.operators import pack as pk
from textloom.operators.storage import put_text, scratch
from textloom.registry import query, read
from textloom.sources import readers as rd
from textloom.sources import sinks as sk
from textloom.streaming import streams as ss


@query("s01_c27_document_records", "select doc_id::varchar source_id, 'synthetic' source_name, md5(text) text_md5, lang meta_lang, n_chars::varchar meta_n from documents where text is not null and trim(text) <> ''")
def document_records(spark: SparkSession, d: str) -> DataFrame:
    spec = rd.SourceSpec(f"{d}/documents.parquet", name="synthetic", id_column="doc_id")
    x = rd.documents(rd.load(spark, spec), spec, "doc_id")
    return x.select("source_id", "source_name", F.md5("text").alias("text_md5"), F.element_at("metadata", F.lit("lang")).alias("meta_lang"), F.element_at("metadata", F.lit("n_chars")).alias("meta_n"))


@query("s02_s06_routed_source", "select count(*)::bigint n from documents")
def routed_source(spark: SparkSession, d: str) -> DataFrame:
    x = rd.local_or_remote(spark, rd.SourceSpec(f"{d}/no_such_table.parquet"), rd.SourceSpec(f"{d}/documents.parquet"))
    return x.agg(F.count("*").alias("n"))


@query("s03_strict_scan", "select doc_id from documents order by doc_id offset 100")
def strict_scan(spark: SparkSession, d: str) -> DataFrame:
    return rd.strict(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", 100).select("doc_id")


@query("s04_s07_lenient_scan", "select doc_id, length(text)::bigint n from documents where text <> ''")
def lenient_scan(spark: SparkSession, d: str) -> DataFrame:
    return rd.lenient(read(spark, d, "documents"), "text").select("doc_id", F.length("text").cast("long").alias("n"))


@query("s05_scored_jsonl", "select doc_id from (select doc_id, quality, row_number() over (order by doc_id) rn from documents left join labels using (doc_id) where coalesce(quality, 1) >= 0.5) where rn > 50")
def scored_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "scored")
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("score"))
    sk.append_jsonl(x, path)
    return rd.scored(rd.jsonl(spark, path, "doc_id long, score double"), "score", 0.5, "doc_id", 50).select("doc_id")


@query("s08_text_lines", "select file, count(*)::bigint n from (values ('a.jsonl'), ('a.jsonl'), ('b.txt'), ('b.txt')) t(file) group by file")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "lines")
    put_text(spark, f"{top}/a.jsonl", '{"text": "one"}\nnot json\n\n{"text": "two"}\n{"text": ""}\n')
    put_text(spark, f"{top}/b.txt", "three\n\nfour\n")
    return rd.text_lines(spark, top).groupBy("file").agg(F.count("*").alias("n"))


@query("s09_strict_jsonl", "select * from (values (1::bigint, 'one'), (3::bigint, 'two')) t(line, text)")
def strict_jsonl(spark: SparkSession, d: str) -> DataFrame:
    p = put_text(spark, scratch(spark, "strict") + "/a.jsonl", '{"text": "one"}\n\n{"text": "two"}\n')
    return rd.jsonl_strict(spark, p, "text string").select(F.col("line").cast("long").alias("line"), "text")


@query("s10_head", "select doc_id from documents order by doc_id limit 25")
def head(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("s11_s15_corpus_json", "select count(*)::bigint n, sum(length(text))::bigint chars from (select text from documents order by doc_id limit 80)")
def corpus_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "corpus")
    x = sk.exact_slice(read(spark, d, "documents").select("doc_id", "text"), "doc_id", 80, path)
    return x.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s12_conllu", "select 0::int sentence, 'Hello|world' words, 'INTJ|NOUN' tags")
def conllu(spark: SparkSession, d: str) -> DataFrame:
    row = lambda i, w, t: "\t".join([i, w, "_", t, *["_"] * 6])
    blocks = ["# c\n" + row("1", "Hello", "INTJ") + "\n" + row("1.1", "x", "NOUN") + "\n" + row("2", "world", "NOUN") + "\n" + row("3", "!", "PUNCT"), row("1-2", "du", "_") + "\n" + row("1", "de", "ADP")]
    p = put_text(spark, scratch(spark, "conllu") + "/a.conllu", "\n\n".join(blocks) + "\n")
    x = rd.conllu(spark, p, ["INTJ", "NOUN", "ADP"])
    return x.select(F.col("sentence").cast("int").alias("sentence"), F.array_join("words", "|").alias("words"), F.array_join("tags", "|").alias("tags"))


@query("s13_prompts", r"select idx::bigint idx, array_to_string(w[1:8], ' ') prompt, label, ['bad', 'good'][label + 1] label_name from (select row_number() over (order by doc_id) - 1 idx, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') w, quality::int label from documents join labels using (doc_id)) where idx < 60")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "text", "quality")
    return rd.prompts(x, "text", "quality", ["bad", "good"], "doc_id", 60, 8).select("idx", "prompt", "label", "label_name")


@query("s14_k02_ledger", "select doc_id from documents where doc_id >= 40")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "ledger")
    x = read(spark, d, "documents").select("doc_id")
    sk.append_ledger(x.where("doc_id < 30"), "doc_id", path)
    sk.append_ledger(x.where("doc_id < 40").unionAll(spark.createDataFrame([(5,)], "doc_id long")), "doc_id", path)
    done = rd.ledger(spark, path).select(F.col("id").cast("long").alias("doc_id"))
    return x.join(done, "doc_id", "left_anti")


@query("s16_tar_members", "select 'log.jsonl' member, 12::bigint n")
def tar_members(spark: SparkSession, d: str) -> DataFrame:
    import base64
    import io
    import tarfile

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for name, body in (("log.jsonl", b'{"step": 1}\n'), ("other.txt", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    path = scratch(spark, "tar") + "/a.tar.gz"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(jvm.java.util.Base64.getDecoder().decode(base64.b64encode(raw.getvalue()).decode()))
    out.close()
    return rd.tar_members(spark, path, "log").select("member", F.length("content").cast("long").alias("n"))


@query("s17_latest", "select 'run-02' as latest")
def latest(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "runs")
    for n in ("run-01", "run-02"):
        put_text(spark, f"{top}/{n}/log", "x")
    return spark.createDataFrame([((rd.latest(spark, f"{top}/run-*") or "").rpartition("/")[2],)], "latest string")


LOG_LINES = '{"phase": "teacher_baseline", "step": 0, "ppl": 17.5}\n{"phase": "post_noise", "step": 0, "ppl": 200.0}\n{"phase": "train", "step": 5, "ppl": null}\n{"phase": "eval_final", "step": 9, "ppl": 18.0}\n'


@query("s18_c17_torn_log", "select * from (values ('eval', 2::bigint), ('post_noise', 1::bigint), ('train', 1::bigint)) t(phase, n)")
def torn_log(spark: SparkSession, d: str) -> DataFrame:
    p = put_text(spark, scratch(spark, "log") + "/log.jsonl", LOG_LINES + '{"phase": "eval", "st')
    x = rd.run_log(spark, p, "phase string, step int, ppl double")
    out = None
    for name in ("eval", "post_noise", "train"):
        y = rd.phase(x, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("phase"), "n")
        out = y if out is None else out.unionByName(y)
    return out


@query("s19_strict_log", "select 4::bigint n, 9::int last_step")
def strict_log(spark: SparkSession, d: str) -> DataFrame:
    p = put_text(spark, scratch(spark, "log") + "/log.jsonl", LOG_LINES)
    return rd.run_log(spark, p, "phase string, step int, ppl double", tolerant=False).agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


@query("s20_c30_config_checks", "select * from (values ('known_keys', true, true), ('unknown_key_rejected', true, true), ('missing_key_rejected', true, false)) t(name, ok, fatal)")
def config_checks(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Settings:
        seq_len: int
        batch: int = 8

    def fails(values: dict) -> bool:
        try:
            rd.config(Settings, values)
        except ValueError:
            return True
        return False

    rows = [("known_keys", not fails({"seq_len": 512}), True), ("unknown_key_rejected", fails({"seq_len": 1, "x": 2}), True), ("missing_key_rejected", fails({"batch": 2}), False)]
    return spark.createDataFrame(rows, "name string, ok boolean, fatal boolean")


@query("s21_word_list", "select doc_id from documents where regexp_matches(lower(text), '\\b(?:scum|worthless|pathetic)\\b')")
def word_list(spark: SparkSession, d: str) -> DataFrame:
    p = put_text(spark, scratch(spark, "words") + "/bad.txt", "scum\nworthless\n\npathetic\n")
    bad = [r["id"] for r in rd.ledger(spark, p).orderBy("id").collect()]  # a packaged list of bounded size
    return read(spark, d, "documents").where(tx.has_bad_word("text", bad)).select("doc_id")


@query("s22_union_runs", "select 'a' gpu, 1::int batch, 2.0::double speed, null::varchar note union all select 'b', 4, null, 'oom'")
def union_runs(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([(1, 2.0)], "batch int, speed double")
    b = spark.createDataFrame([(4, "oom")], "batch int, note string")
    return rd.union_runs({"a": a, "b": b})


@query("k01_k03_split_records", "select doc_id, md5(left(text, 20)) prefix_md5, lang, source from documents")
def split_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "records")
    x = read(spark, d, "documents").select("doc_id", F.left("text", F.lit(20)).alias("prefix"), "lang", "source")
    pub, extra = sk.split_record(x.withColumn("pid", F.col("doc_id")), ["pid", "prefix"])
    sk.append_jsonl(pub, f"{path}/pairs")
    sk.append_jsonl(extra, f"{path}/extra")
    a = rd.jsonl(spark, f"{path}/pairs", "pid long, prefix string")
    b = rd.jsonl(spark, f"{path}/extra", "doc_id long, lang string, source string")
    return b.join(a, F.col("pid") == F.col("doc_id")).select("doc_id", F.md5("prefix").alias("prefix_md5"), "lang", "source")


@query("k04_t03_written_shards", "select floor((rn - 1) / 100)::int shard, count(*)::bigint n_rows from (select row_number() over (order by doc_id) rn from documents) group by 1")
def written_shards(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "shards")
    sk.write_shards(read(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, path)
    return spark.read.schema("doc_id long, source string, shard int").json(path).groupBy("shard").agg(F.count("*").alias("n_rows"))


@query("k05_binary_shards", "select shard, tokens, tokens * 4 as n_bytes from (select floor((o + unnest(range(len(w)))) / 4096)::bigint shard, count(*)::bigint tokens from (select *, coalesce(sum(len(w)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) o from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents)) group by 1)")
def binary_shards(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bin")
    x = read(spark, d, "documents").select("doc_id", pk.word_ids("text").alias("t"))
    sk.write_token_shards(x, "t", "doc_id", 4096, 1 << 20, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.regexp_extract("path", r"shard_(\d+)\.bin$", 1).cast("long").alias("shard"), F.col("length").alias("n_bytes"))
    meta = spark.read.option("multiLine", True).json(f"{path}/meta.json").select(F.explode("shards").alias("s")).select("s.shard", "s.tokens")
    return files.join(meta, "shard").select("shard", "tokens", "n_bytes")


@query("k08_cached_blocks", "select count(*)::bigint n from documents where lang = 'de'")
def cached_blocks(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "cache")
    x = read(spark, d, "documents").where("lang = 'de'").select("doc_id")
    sk.cached(x, top, {"seq_len": 512, "lang": "de"})
    return sk.cached(x.limit(0), top, {"lang": "de", "seq_len": 512}).agg(F.count("*").alias("n"))


@query("k10_k11_csv_and_vectors", "select label, count(*)::bigint n from embeddings group by label")
def csv_and_vectors(spark: SparkSession, d: str) -> DataFrame:
    top = scratch(spark, "csv")
    e = read(spark, d, "embeddings")
    sk.write_vectors(e, f"{top}/vec")
    sk.write_csv(spark.read.parquet(f"{top}/vec").groupBy("label").agg(F.count("*").alias("n")), f"{top}/csv", ["label"])
    return spark.read.schema("label int, n long").option("header", True).csv(f"{top}/csv")


@query("k12_text_corpus", "select count(*)::bigint n from (select unnest(string_split(text || chr(10), chr(10))) x from documents)")
def text_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "txt")
    sk.write_corpus(read(spark, d, "documents"), "text", path)
    return spark.read.text(path).agg(F.count("*").alias("n"))


@query("k13_t08_run_log", "select 3::bigint n, 2.0::double least")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "append")
    for i, loss in enumerate((4.0, 3.0, 2.0)):
        sk.append_jsonl(spark.createDataFrame([(i, loss)], "step int, loss double"), path)
    return rd.jsonl(spark, path, "step int, loss double").agg(F.count("*").alias("n"), F.min("loss").alias("least"))


@query("c28_c29_records", "select doc_id, md5(array_to_string(w[1:16], ' ')) prefix_md5, round(len(w) / 7.0::double, 6) entropy from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from documents)")
def records(spark: SparkSession, d: str) -> DataFrame:
    w = tx.words("text")
    r = F.struct(F.array_join(F.slice(w, 1, 16), " ").alias("prefix_text"), F.struct(F.lit("fixed").alias("mode"), F.transform(F.array(F.size(w) / 7.0), lambda v: F.round(v, 6)).alias("token_entropies")).alias("generation"))
    x = read(spark, d, "documents").select("doc_id", r.alias("record"))
    return x.select("doc_id", F.md5("record.prefix_text").alias("prefix_md5"), F.get("record.generation.token_entropies", F.lit(0)).alias("entropy"))


# streams: the table as a stream, all of it at once


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def drained(x: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives, through a Parquet sink where the mode allows it."""
    spark = x.sparkSession
    out, mark = scratch(spark, "stream"), scratch(spark, "mark")
    rows: list[str] = []

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        rows.append(f"{out}/epoch={epoch}")

    x.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    last = rows[-1:] if mode == "complete" else rows
    return spark.read.schema(x.schema).parquet(*last) if last else spark.createDataFrame([], x.schema)


@query("t01_stream_dedup", "select md5(text) text_hash from documents group by text")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return drained(ss.first_arrivals(stream_of(spark, d, "documents").select("doc_id", "text"), "text").select("text_hash"))


@query("t02_stream_resume", "select count(*)::bigint n from documents")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    out, led, mark = scratch(spark, "out"), scratch(spark, "ledger"), scratch(spark, "mark")
    for _ in range(2):  # the second run finds nothing new
        ss.write_once(stream_of(spark, d, "documents").select("doc_id"), "doc_id", out, led, mark).awaitTermination()
    return spark.read.schema("doc_id long").json(f"{out}/*").agg(F.count("*").alias("n"))


@query("t_windowed_counts", "select date_trunc('hour', ts) start, event_type, count(*)::bigint n from events group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    x = ss.windowed_counts(stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    return drained(x, "complete").select(F.col("window.start").alias("start"), "event_type", "n")


@query("t_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end b from events window w as (partition by user_id order by ts)), s as (select user_id, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, max(k)::bigint sessions from s group by user_id")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    x = ss.sessions(stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return drained(x, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("t06_context_monitor")
def context_monitor(spark: SparkSession, d: str) -> DataFrame:
    x = stream_of(spark, d, "events").select((F.col("user_id") % 5).alias("session"), F.col("event_type").alias("token"), F.col("value").alias("width"))
    return drained(ss.context_monitor(x, eps=500.0)).select("session", "breach_at", "n_tokens")


@query("t05_t07_trims", "select * from (values (0::bigint, '1,2,3', '1,2,9,10'), (1::bigint, '1,2', '1,2,9,10')) t(id, trimmed, kept)")
def trims(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(0, [1, 2, 3, 99, 5]), (1, [1, 2, 0, 0, 0])], "id long, t array<int>").withColumn("long", F.sequence(F.lit(1), F.lit(10)))
    return x.select("id", F.array_join(ss.trim_generation("t", 99, 0), ",").alias("trimmed"), F.array_join(ss.head_and_tail("long", 4), ",").alias("kept"))


@query("e15_permuted_cap", "select vec_id from embeddings order by md5(concat_ws('-', vec_id, '8')), vec_id limit 64")
def permuted_cap(spark: SparkSession, d: str) -> DataFrame:
    return mx.sample_rows(read(spark, d, "embeddings").select("vec_id"), "vec_id", 64, 8).select("vec_id")
