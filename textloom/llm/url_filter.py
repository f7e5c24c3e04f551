"""URL filters by rules and by a character language-model ratio, in DataFrame functions only.

A rule is a host and a path prefix; it fits its host and all subdomains, and the longest fitting rule decides. The other
URLs are judged by two Markov models of the characters of host and path, trained on all URLs that allow rules accept and on
all that block rules reject. The models have variable order: Witten-Bell smoothing falls back from two characters of context
to one, to none and to a uniform distribution where contexts are rare or new. The score is the difference of the two log
likelihoods over the number of characters; the threshold is the score that parts the two classes of rule-judged URLs best.

Characters are folded to 34 classes, so a model is a table of 34 cubed log ratios whatever the corpus: it becomes one literal
array in the plan, and scoring shuffles nothing.

Defined cases: a null URL, or one without ``://``, has empty host and path; no rule fits it and the model judges the empty
text; very long URLs are scored whole; of rules of one length that fit, the last by code point decides; a score at the threshold
is allowed; where no URL is accepted or none is rejected by rules, the rest is allowed; rows come one for one, repeated rows
and null ids too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Character classes: start, end, others, letters, digits (as 0) and separators.
ALPHABET = "^$*abcdefghijklmnopqrstuvwxyz0./-_"
A = len(ALPHABET)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins of a score, for the threshold.
BINS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL column."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits, or null. The list is part of the plan, so for hundreds of rules, not millions."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = r.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), r).otherwise(out)
    return out


def codes(host: Column, path: Column) -> Column:
    """The classes of the characters of host and path, with two starts and an end."""
    s = F.concat(F.lit("^^"), F.regexp_replace(F.regexp_replace(F.translate(F.concat(host, path), UPPER, LOWER), "[0-9]", "0"), r"[^a-z0./\-_]", "*"), F.lit("$"))
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)


def log_ratios(rows: DataFrame) -> DataFrame:
    """One row with an array of A cubed log ratios, from rows (accepted, x): by context and character."""
    at = F.explode(F.sequence(F.lit(0), F.size("x") - 3)).alias("i")
    grams = rows.select("accepted", "x", at).select("accepted", ((F.get("x", F.col("i")) * A + F.get("x", F.col("i") + 1)) * A + F.get("x", F.col("i") + 2)).alias("g"))
    seen = grams.groupBy("accepted", "g").agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(2 * A**3).select((F.col("id") % 2 == 1).alias("accepted"), F.floor(F.col("id") / 2).cast("int").alias("g"))
    t = grid.join(seen, ["accepted", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    t = t.withColumn("ab", F.floor(F.col("g") / A)).withColumn("b", F.col("ab") % A).withColumn("c", F.col("g") % A)
    over = lambda *k: Window.partitionBy("accepted", *k)
    t = t.withColumn("n3", F.sum("n").over(over("ab"))).withColumn("t3", F.sum((F.col("n") > 0).cast("double")).over(over("ab")))
    t = t.withColumn("bc", F.sum("n").over(over("b", "c"))).withColumn("n2", F.sum("n").over(over("b")))
    t = t.withColumn("t2", F.sum((F.col("bc") > 0).cast("double")).over(over("b")) / A)
    t = t.withColumn("n1", F.sum("n").over(over("c"))).withColumn("n0", F.sum("n").over(over()))
    t = t.withColumn("t1", F.sum((F.col("n1") > 0).cast("double")).over(over()) / (A * A))
    p1 = (F.col("n1") + F.col("t1") / A) / (F.col("n0") + F.col("t1"))
    p2 = F.when(F.col("n2") > 0, (F.col("bc") + F.col("t2") * F.col("p1")) / (F.col("n2") + F.col("t2"))).otherwise(F.col("p1"))
    p3 = F.when(F.col("n3") > 0, (F.col("n") + F.col("t3") * F.col("p2")) / (F.col("n3") + F.col("t3"))).otherwise(F.col("p2"))
    t = t.where("n0 > 0").withColumn("p1", p1).withColumn("p2", p2).withColumn("p3", p3)
    r = t.groupBy("g").agg(F.sum(F.when(F.col("accepted"), F.ln("p3")).otherwise(-F.ln("p3"))).alias("r"), F.count("*").alias("k"))
    return r.where("k = 2").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "r"))), lambda s: s["r"]).alias("ratios"))


def llr(x: Column, ratios: Column) -> Column:
    """The mean log ratio of the characters of x."""
    at = F.sequence(F.lit(0), F.size(x) - 3)
    total = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(ratios, ((F.get(x, i) * A + F.get(x, i + 1)) * A + F.get(x, i + 2)).cast("int")), F.lit(0.0)))
    return total / (F.size(x) - 2)


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the bin edge that parts accepted from rejected scores best; null where a class is missing."""
    bins = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("pos"), F.sum((~F.col("accepted")).cast("long")).alias("neg"))
    up = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # bins, not rows
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = F.sum("pos").over(up) / F.sum("pos").over(whole) - F.sum("neg").over(up) / F.sum("neg").over(whole)
    both = (F.sum("pos").over(whole) > 0) & (F.sum("neg").over(whole) > 0)
    t = bins.select("bin", F.when(both, gain).alias("gain"))
    return t.agg(F.max_by(F.col("bin") / BINS, F.struct("gain", -F.abs("bin"), "bin")).alias("t"), F.max("gain").alias("gain")).select(F.when(F.col("gain").isNotNull(), F.col("t")).alias("t"))


def url_filter(pages: DataFrame, allow: list[str], block: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict and score."""
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block])).withColumn("x", codes(F.col("host"), F.col("path")))
    known = p.where(F.col("rule").isNotNull()).select(F.col("rule").isin(*allow).alias("accepted") if allow else F.lit(False).alias("accepted"), "x")
    model = log_ratios(known).first()["ratios"]
    ratios = F.split(F.lit(",".join(map(repr, model or [0.0]))), ",").cast("array<double>")  # folded into a literal
    edge = threshold(known.select("accepted", llr(F.col("x"), ratios).alias("score"))).first()["t"]
    p = p.withColumn("score", llr(F.col("x"), ratios))
    good = F.lit(True) if edge is None else F.col("score") >= edge
    ruled = F.col("rule").isin(*allow) if allow else F.lit(False)
    verdict = F.when(F.when(F.col("rule").isNotNull(), ruled).otherwise(good), "allow").otherwise("block")
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
