"""Structured Streaming forms: incremental dedup, resumable output, shard continuation, keyed context monitoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_arrivals(stream: DataFrame, text: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first arrival of each text. Under reordering this differs from the greedy batch form, which needs a global order."""
    x = stream.withColumn("text_hash", F.md5(text))
    return x.withWatermark(time, late).dropDuplicatesWithinWatermark(["text_hash"]) if time else x.dropDuplicates(["text_hash"])


def write_once(stream: DataFrame, id_col: str, out: str, ledger: str, checkpoint: str):
    """Write each micro-batch's rows that the ledger doesn't hold to its own folder, epoch=N, and then its ids to the ledger's.
    A batch that failed between the two is written again over both; its own ids in the ledger don't hold its rows back."""

    def put(batch: DataFrame, epoch: int) -> None:
        from textloom.sources.readers import exists

        spark, new = batch.sparkSession, batch
        if exists(spark, ledger):
            done = spark.read.schema("value string, epoch long").text(ledger).where(F.col("epoch") != epoch)
            new = batch.join(done.select(F.col("value").cast(batch.schema[id_col].dataType).alias(id_col)), id_col, "left_anti")
        new.write.mode("overwrite").json(f"{out}/epoch={epoch}")
        new.select(F.col(id_col).cast("string").alias("value")).write.mode("overwrite").text(f"{ledger}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and key, late rows dropped after the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide) if slide else F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


_CONTEXT = "session long, breach_at long, n_tokens long, head string, tail string, variance double"
_STATE = "n long, head array<string>, tail array<string>, widths array<double>"


def context_monitor(stream: DataFrame, span: int = 3, last: int = 4, eps: float = 1e-3, keep: int = 8) -> DataFrame:
    """Rows (session, token, width): append tokens, and when the variance of the last moving means passes eps, emit the
    context's head and tail and start anew. A session's state is a few tokens and widths, however long its context."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, head, tail, widths = (state.get[0], *(list(x) for x in state.get[1:])) if state.exists else (0, [], [], [])
        out = []
        for p in parts:
            for token, width in zip(p["token"], p["width"]):
                n += 1
                head = [*head, token] if n <= keep else head
                tail = [*tail, token][-keep:]
                widths = [*widths, float(width)][-(last + span - 1) :]
                if n < last:
                    continue
                means = [sum(w) / len(w) for k in range(len(widths) - last, len(widths)) for w in [widths[max(0, k - span + 1) : k + 1]]]
                mid = sum(means) / last
                var = sum((m - mid) ** 2 for m in means) / last
                if var > eps:
                    out.append((key[0], n, n, " ".join(head), " ".join(tail), var))
                    n, head, tail, widths = 0, [], [], []
        state.update((n, head, tail, widths))
        yield pd.DataFrame(out, columns=["session", "breach_at", "n_tokens", "head", "tail", "variance"])

    return stream.groupBy("session").applyInPandasWithState(run, _CONTEXT, _STATE, "append", GroupStateTimeout.NoTimeout)


def head_and_tail(tokens: str, most: int) -> Column:
    """The whole array, or its first and last halves where it is longer than most."""
    t = F.col(tokens)
    half = most // 2
    return F.when(F.size(t) <= most, t).otherwise(F.concat(F.slice(t, 1, half), F.slice(t, -(most - half), most - half)))


def entropy_stop(df: DataFrame, id_col: str, pos: str, entropy: str, least: int, threshold: float) -> DataFrame:
    """Rows before the first position of at least least whose entropy is above the threshold."""
    stop = df.groupBy(id_col).agg(F.min(F.when((F.col(pos) >= least) & (F.col(entropy) > threshold), F.col(pos))).alias("_stop"))
    return df.join(stop, id_col).where(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).drop("_stop")


def trim_generation(tokens: str, eos: int, pad: int) -> Column:
    """The tokens before the first end id, without trailing padding."""
    t = F.col(tokens)
    at = F.array_position(t, eos)
    cut = F.when(at > 0, F.slice(t, F.lit(1), (at - 1).cast("int"))).otherwise(t)
    ends = lambda x: F.array_max(F.transform(x, lambda v, i: F.when(v != pad, i + 1).otherwise(0)))
    return F.element_at(F.transform(F.array(cut), lambda x: F.slice(x, F.lit(1), F.coalesce(ends(x), F.lit(0)))), 1)
