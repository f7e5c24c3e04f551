"""Tokenise, cut and pack: windows of tokens, prefixes, fixed-length blocks and token shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.prefix import exclusive_sum
from textloom.operators.storage import checkpointed


def word_ids(text) -> Column:
    """A stand-in tokenizer for tests and estimates: a stable 20-bit id for each word."""
    return F.transform(tx.words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 5), 16, 10).cast("int"))


def byte_ids(text) -> Column:
    """Byte tokenizer: the values of the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def _placed(x: DataFrame) -> DataFrame:
    """Rows (seq, t) that have tokens, with n and at, the tokens before each. The tokens are made once and stored; only their
    numbers are ordered, and the places come back by the row's number."""
    x = checkpointed(x.withColumn("n", F.size("t").cast("long")).withColumn("row", F.monotonically_increasing_id()))
    at = exclusive_sum(x.select("seq", "row", "n"), "n", [], ["seq", "row"], "at").where("n > 0").select("row", "at")
    return x.join(at, "row").drop("row")


def pack(df: DataFrame, tokens: str, seq: str, length: int, eos: int | None) -> DataFrame:
    """(block_id, tokens): the token stream in order of seq, one end id a document, cut in blocks; the short tail goes."""
    t = F.concat(F.col(tokens), F.array(F.lit(eos).cast("int"))) if eos is not None else F.col(tokens)
    x = _placed(df.select(F.col(seq).alias("seq"), t.alias("t")))
    # a document gives one piece for each block that it touches, not one row a token
    blocks = F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length))
    x = x.withColumn("block_id", F.explode(blocks))
    lo = F.greatest(F.col("block_id") * length - F.col("at"), F.lit(0))
    hi = F.least((F.col("block_id") + 1) * length - F.col("at"), F.col("n"))
    pieces = x.select("block_id", (F.col("at") + lo).alias("from"), F.slice("t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    whole = pieces.groupBy("block_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("from", "piece"))), lambda s: s["piece"])).alias("tokens"))
    return whole.where(F.size("tokens") == length)


def shards(df: DataFrame, tokens: str, seq: str, per_file: int, vocab: int, eos: int | None = None) -> DataFrame:
    """(shard, dtype, tokens): the stream cut in files of per_file tokens, the remainder kept."""
    t = F.concat(F.col(tokens), F.array(F.lit(eos).cast("int"))) if eos is not None else F.col(tokens)
    x = _placed(df.select(F.col(seq).alias("seq"), t.alias("t")))
    x = x.withColumn("shard", F.explode(F.sequence(F.floor(F.col("at") / per_file), F.floor((F.col("at") + F.col("n") - 1) / per_file))))
    lo = F.greatest(F.col("shard") * per_file - F.col("at"), F.lit(0))
    hi = F.least((F.col("shard") + 1) * per_file - F.col("at"), F.col("n"))
    return x.select("shard", F.lit("uint16" if vocab <= 65535 else "uint32").alias("dtype"), (F.col("at") + lo).alias("from"), F.slice("t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"), (hi - lo).alias("n"))


def shard_manifest(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("shard", "dtype").agg(F.sum("n").alias("tokens"))


def random_window(items: Column, key: str, n: int, seed: int) -> Column:
    """One window of n items, its start drawn by a hash of the key; null where there are fewer."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(n)), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.when(F.size(items) >= n, F.slice(items, (F.pmod(h, F.size(items) - n + 1) + 1).cast("int"), n))


def first_words(text, n: int) -> Column:
    return F.array_join(F.slice(tx.words(text), 1, n), " ")


def prefix_split(df: DataFrame, tokens: str, prefix: int, new: int) -> DataFrame:
    """Adds prefix_tokens and continuation_tokens; rows too short for both go."""
    t = F.col(tokens)
    return df.where(F.size(t) >= prefix + new).withColumn("prefix_tokens", F.slice(t, 1, prefix)).withColumn("continuation_tokens", F.slice(t, prefix + 1, new))


def recursive_chunks(text: str | None, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Chunks of at most size characters: cut at the coarsest separator that occurs, pieces joined up to size, with overlap."""
    if not text:
        return []
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep = next(s for s in separators if not s or s in text)
    finer = separators[separators.index(sep) + 1 :]
    pieces = text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size - overlap)]
    out: list[str] = []
    held: list[str] = []
    room = lambda ps: sum(map(len, ps)) + len(sep) * max(0, len(ps) - 1)
    for p in pieces:
        if len(p) > size:
            if held:
                out.append(sep.join(held))
                held = []
            out += recursive_chunks(p, size, overlap, finer)
            continue
        if held and room([*held, p]) > size:
            out.append(sep.join(held))
            while held and (room(held) > overlap or room([*held, p]) > size):
                held.pop(0)
        held.append(p)
    if held:
        out.append(sep.join(held))
    return [c.strip() for c in out if c.strip()]


def chunk_documents(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, chunk_no, chunk): the recursive chunks of each document, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, k, c) for i, t in zip(p[id_col], p[text_col]) for k, c in enumerate(recursive_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "chunk"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} long, chunk_no long, chunk string")


def logical_chunks(text: str | None, least: int, most: int) -> list[str]:
    """Paragraphs joined until they have least words, cut at sentences beyond most; a short rest joins its neighbour."""
    out: list[list[str]] = []
    for p in re.split(r"\n\s*\n|\n", text or ""):
        w = p.split()
        while len(w) > most:
            out.append(w[:most])
            w = w[most:]
        if not w:
            continue
        if out and len(out[-1]) < least and len(out[-1]) + len(w) <= most:
            out[-1] = out[-1] + w
        else:
            out.append(w)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + len(out[-1]) <= most:
        out[-2:] = [out[-2] + out[-1]]
    return [" ".join(w) for w in out]


def chunk_records(chunks: DataFrame, dataset: str) -> DataFrame:
    """Chunk records with their fixed schema; labels are filled in later."""
    nul = F.lit(None).cast("string")
    return chunks.select(
        F.format_string("%s_%06d_%03d", F.lit(dataset), F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"), F.lit(dataset).alias("dataset"), F.lit("document").alias("source_type"), nul.alias("domain"), nul.alias("field"),
        nul.alias("subfield"), F.lit(None).cast("double").alias("confidence"), F.size(tx.words("chunk")).alias("token_count"), F.col("chunk").alias("text"),
    )


def rebuild_sentence(words: Column, misc: Column) -> Column:
    """struct(text, spans) of words, a space after each but where its misc says SpaceAfter=No."""
    start = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(a["text"])
        span = F.struct(n.alias("start"), (n + F.length(x["w"])).alias("end"))
        space = F.when(x["m"].contains("SpaceAfter=No"), "").otherwise(" ")
        return F.struct(F.concat(a["text"], x["w"], space).alias("text"), F.concat(a["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(words, misc, lambda w, m: F.struct(w.alias("w"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda a: F.struct(F.rtrim(a["text"]).alias("text"), a["spans"].alias("spans")))


def first_overlap(word_spans: DataFrame, token_spans: DataFrame) -> DataFrame:
    """(sentence, word, token): the first token that overlaps each word, an interval join inside a sentence."""
    j = word_spans.alias("w").join(token_spans.alias("t"), (F.col("w.sentence") == F.col("t.sentence")) & (F.col("t.start") < F.col("w.end")) & (F.col("t.end") > F.col("w.start")))
    return j.groupBy(F.col("w.sentence").alias("sentence"), F.col("w.word").alias("word")).agg(F.min("t.token").alias("token"))
