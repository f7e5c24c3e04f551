"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sources get targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the words of all documents by
   weight; a target stops at CAP times its source's words, and the excess is shared anew until none is above.
2. A source's documents are dealt to shards of about SHARD_WORDS words by a hash of the id, so that no window holds a hot
   source. The words of a shard, in a seeded order of its documents, are cut into equal blocks of about BLOCK words.
3. Sainte-Laguë's method gives sources, then each source's groups of GROUP shards, then each group's shards, integer numbers
   of blocks by highest quotients. A task apportions one row a source, one a group of a source, or one a shard of a group.
4. A shard with q blocks to take from its n takes every block floor(q / n) times, and q mod n of them once more: those at
   the first places of a seeded permutation, which needs no list of blocks.

A document's words taken are the overlaps of its words with the blocks, repeats counted; they never exceed CAP times its
size. Everything is a function of the rows and the seed, so reruns agree.

Defined cases: null text has size 0; documents of size 0 take nothing and are in no shard; a very long document is cut in blocks
as any other; rows with a null source form one source, ranked last; sources with equal quotients go by rank, shards by number;
rows that repeat an id are documents of their own in a fixed order; an empty table gives no rows; other columns are kept by
mix_rows, whatever their names, and ignored by mix.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._common import WORD_RUN, materialise, release, ship, unused

BLOCK, SHARD_WORDS, CAP = 128, 1 << 20, 3
#: Shards of a source that are apportioned by one task.
GROUP = 4096
SEED = 20_240_601
#: Steps of the seeded permutations: primes above any number of blocks in a shard, so coprime to it.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def sainte_lague(weights: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none above its most; ties go to the earlier weight.

    Starts from the floors of the shares less one, which the method never undercuts for long lists, and gives the rest by a
    heap; takes back the lowest quotients where that start gave too many.
    """
    total = sum(weights)
    most = most if most is not None else [seats] * len(weights)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    got = [min(m, max(0, int(w * seats / total) - 1)) if w > 0 else 0 for w, m in zip(weights, most)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g, m) in enumerate(zip(weights, got, most)) if w > 0 and g < m]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size and target from rows (source, size). One row a source is ranked and shared in a single task."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", (1 + F.pmod(F.col("rank") - 1, F.lit(3))).cast("double"))
    # sources reach their caps in the order of cap / weight; below the first that does not, all share what is left by weight
    by = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = per.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    x = x.withColumn("left", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    x = x.withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left") / F.col("open")).withColumn("full", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    place = F.struct(F.col("source_size") * cap / F.col("weight"), "rank")
    x = x.withColumn("level", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), place)).over(whole))
    share = F.least(F.col("weight") * F.col("level"), cap * F.col("source_size").cast("double"))
    return x.select("source", "source_size", F.coalesce(share, cap * F.col("source_size").cast("double")).alias("target"), "rank")


def _source_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks to take of each source, from one row a source: its target in blocks of its own mean size."""
    pdf = pdf.sort_values("rank")
    wanted = (pdf.target * pdf.n / pdf.source_size.clip(lower=1)).tolist()
    return pdf.assign(blocks=sainte_lague(wanted, round(sum(wanted)), [CAP * int(n) for n in pdf.n]))[["rank", "blocks"]]


def _divided(by: str):
    """Shares a group's blocks among its rows in order of a column, by their numbers of blocks n."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        pdf["quota"] = sainte_lague(pdf.n.astype(float).tolist(), int(pdf.blocks.iloc[0]), [CAP * int(n) for n in pdf.n])
        return pdf.drop(columns="blocks")

    return run


def word_count(text):
    """The number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def _mixed(d: DataFrame, seed: int) -> DataFrame:
    """d (doc_id, source, size) with source_size, target and taken."""
    t = materialise(targets(d), "mix-targets")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long")
    d = d.join(t.withColumn("shards", shards), d["source"].eqNullSafe(t["source"])).drop(t["source"])
    d = d.withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    nothing = d.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    d = d.where("size > 0")
    cells = d.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    cells = cells.withColumn("n", F.greatest(F.lit(1), F.round(F.col("shard_size") / BLOCK)).cast("long")).withColumn("team", F.floor(F.col("shard") / GROUP))
    teams = cells.groupBy("rank", "team").agg(F.sum("n").alias("n"))
    per = teams.groupBy("rank").agg(F.sum("n").alias("n")).join(t.select("rank", "source_size", "target"), "rank")
    quotas = per.groupBy().applyInPandas(_source_quotas, "rank int, blocks long")
    teams = teams.join(quotas, "rank").groupBy("rank").applyInPandas(_divided("team"), "rank int, team long, n long, quota long")
    cells = cells.join(teams.select("rank", "team", F.col("quota").alias("blocks")), ["rank", "team"])
    cells = cells.groupBy("rank", "team").applyInPandas(_divided("shard"), "rank int, team long, shard long, shard_size long, n long, quota long").drop("team")
    before = Window.partitionBy("rank", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(before)).withColumn("start", F.col("end") - F.col("size")).join(cells, ["rank", "shard"])
    cell = F.xxhash64("rank", "shard", F.lit(seed + 1))
    d = d.withColumn("step", F.element_at(F.array(*[F.lit(s) for s in STEPS]).cast("array<long>"), (1 + F.pmod(cell, F.lit(len(STEPS)))).cast("int")))
    d = d.withColumn("shift", F.pmod(F.shiftright(cell, 8), F.col("n"))).withColumn("each", F.floor(F.col("quota") / F.col("n"))).withColumn("more", F.pmod(F.col("quota"), F.col("n")))

    # block b of a shard of S words holds the words from floor(b S / n) on
    edge = lambda b: F.floor(b * F.col("shard_size") / F.col("n"))
    block_of = lambda x: F.floor(((x + 1) * F.col("n") - 1) / F.col("shard_size"))

    def overlap(b):
        words = F.least(F.col("end"), edge(b + 1)) - F.greatest(F.col("start"), edge(b))
        place = F.pmod(b * F.pmod(F.col("step"), F.col("n")) + F.col("shift"), F.col("n"))
        return words * F.least(F.lit(CAP).cast("long"), F.col("each") + F.when(place < F.col("more"), 1).otherwise(0))

    blocks = F.sequence(block_of(F.col("start")), block_of(F.col("end") - 1))
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, b: acc + overlap(b))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return d.withColumn("taken", taken.cast("long")).select(*names).unionByName(nothing.select(*names))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target and taken."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return _mixed(materialise(d, "mix-sizes"), seed).select("doc_id", "size", "source_size", "target", "taken")


def mix_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs' rows as the mix takes them, all columns: each row floor(taken / size) times, and once more by a seeded draw
    against the rest, so that a source's expected words are those taken. Rows without words are left out; rows
    that repeat a document are each taken as often as the one of them that is taken most."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = materialise(d, "mix-sizes")
    m = _mixed(sizes, seed)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("taken") / F.col("size")) + F.when(draw < F.col("taken") / F.col("size") - F.floor(F.col("taken") / F.col("size")), 1).otherwise(0)
    plan = materialise(m.where("size > 0").select("doc_id", "source", "size", copies.alias("copies")).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0"), "mix-plan")
    release(sizes)
    size, copy = unused("size", docs.columns), unused("copy", docs.columns)
    own = docs.withColumn(size, word_count(F.col("text"))).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col(f"d.`{size}`") == F.col("p.size"))
    out = own.join(plan.hint("merge").alias("p"), on).withColumn(copy, F.explode(F.expr("sequence(1, p.copies)")))
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns])
