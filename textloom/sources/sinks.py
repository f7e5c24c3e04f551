"""Sinks: JSONL, ledgers, fixed-size shards, binary token shards, resumable slices, caches, CSV and text corpora."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.pack import shards
from textloom.operators.prefix import row_index
from textloom.operators.storage import checkpointed, put_text
from textloom.sources.readers import exists, ledger


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_ledger(df: DataFrame, id_col: str, path: str) -> None:
    df.select(F.col(id_col).cast("string").alias("value")).write.mode("append").text(path)


def pending(df: DataFrame, id_col: str, spark: SparkSession, path: str) -> DataFrame:
    """Rows whose id no ledger line holds."""
    if not exists(spark, path):
        return df
    return df.join(ledger(spark, path).withColumnRenamed("id", id_col), id_col, "left_anti")


def split_record(df: DataFrame, public: list[str]) -> tuple[DataFrame, DataFrame]:
    """The public columns, and the others with the id."""
    return df.select(*public), df.select(*[c for c in df.columns if c not in public])


def sharded(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds shard: rows in order, size a shard."""
    return row_index(df, order, "_row").withColumn("shard", F.floor(F.col("_row") / size)).drop("_row")


def shard_state(x: DataFrame) -> DataFrame:
    """(shard, rows), from the data itself, so that an interrupted run cannot make it drift."""
    return x.groupBy("shard").agg(F.count("*").alias("rows"))


def write_shards(df: DataFrame, order: str, size: int, path: str) -> None:
    sharded(df, order, size).repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").json(path)


def write_token_shards(df: DataFrame, tokens: str, seq: str, per_file: int, vocab: int, path: str, eos: int | None = None) -> DataFrame:
    """Raw files shard_00000.bin of little-endian ids, 16-bit up to a vocabulary of 65535, and meta.json; returns the manifest.

    A task writes its shards one after the other, piece by piece, so a file is never in memory; a file gets its name when it
    is whole, so a task that runs twice leaves one. The manifest has a row a file.
    """
    p = shards(df, tokens, seq, per_file, vocab, eos).repartition("shard").sortWithinPartitions("shard", "from")
    width = "<u2" if vocab <= 65535 else "<u4"

    def write(batches):
        fs, top = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        fs.create_dir(top, recursive=True)
        now, out, n = None, None, 0

        def close():
            out.close()
            fs.move(f"{top}/.{now}-{uid}", f"{top}/shard_{now:05d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], names=["shard", "tokens"])

        uid = uuid.uuid4().hex
        for b in batches:
            off, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False)
            for shard, lo, hi in zip(b.column(0).to_pylist(), off, off[1:]):
                if shard != now:
                    if out:
                        yield close()
                    now, n, out = shard, 0, fs.open_output_stream(f"{top}/.{shard}-{uid}")
                out.write(flat[lo:hi].astype(width).tobytes())
                n += int(hi - lo)
        if out:
            yield close()

    m = checkpointed(p.select("shard", "piece").mapInArrow(write, "shard long, tokens long"))
    rows = [{"shard": r.shard, "tokens": r.tokens, "file": f"shard_{r.shard:05d}.bin"} for r in m.orderBy("shard").collect()]
    dtype = "uint16" if vocab <= 65535 else "uint32"
    put_text(df.sparkSession, f"{path}/meta.json", json.dumps({"dtype": dtype, "vocab_size": vocab, "total_tokens": sum(r["tokens"] for r in rows), "shards": rows}))
    return m.select("shard", F.lit(dtype).alias("dtype"), "tokens")


def exact_slice(df: DataFrame, order: str, n: int, path: str, exact: bool = True) -> DataFrame:
    """The first n rows as JSONL, written once: reused if its number of rows fits, an error if the source is too short."""
    spark = df.sparkSession
    if exists(spark, path + "/_SUCCESS"):
        old = spark.read.schema(df.schema).json(path)
        have = old.count()
        if have == n or (not exact and have >= n):
            return old
    part = row_index(df, order, "_row").where(F.col("_row") < n).drop("_row")
    part.write.mode("overwrite").json(path)
    out = spark.read.schema(df.schema).json(path)
    if exact and out.count() != n:
        raise ValueError(f"the source has fewer than {n} rows")
    return out


def cached(df: DataFrame, folder: str, settings: dict) -> DataFrame:
    """df stored under a key of its settings, and read from there where it was stored before."""
    import hashlib

    key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/{key}"
    if not exists(df.sparkSession, path + "/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def atomic_json(value, path: str) -> None:
    """A small driver-side result: written beside its place, then renamed over it."""
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    os.replace(tmp, path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small result as one CSV file with a header, in order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_corpus(df: DataFrame, text: str, path: str) -> None:
    """Plain text, a blank line after each document."""
    df.select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, order: list[str], limit: int = 200) -> str:
    """A small table as Markdown, for reports."""
    rows = df.orderBy(*order).limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])
