"""Comparing two models: per-position and per-block metrics, bootstrap intervals, robustness, verdicts, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors as vx


def position_metrics(df: DataFrame, teacher: str = "t_logits", student: str = "s_logits", label: str = "label", k: int = 5, temperature: float = 2.0) -> DataFrame:
    """One row a position: agreement, divergences and correctness of two logit arrays."""
    x = df.withColumn("_t", vx.softmax(teacher)).withColumn("_s", vx.softmax(student)).withColumn("_tt", vx.softmax(teacher, temperature)).withColumn("_st", vx.softmax(student, temperature))
    x = x.withColumn("t_top", vx.argmax("_t")).withColumn("s_top", vx.argmax("_s"))
    y = F.col(label)
    t_ok, s_ok = F.col("t_top") == y, F.col("s_top") == y
    return x.select(
        "block_id", "pos", y.alias("label"), "t_top", "s_top", (F.col("t_top") == F.col("s_top")).cast("double").alias("top1_match"), vx.kl("_t", "_s").alias("kl"), vx.kl("_s", "_t").alias("reverse_kl"), vx.kl("_tt", "_st").alias("kl_temperature"),
        vx.js("_t", "_s").alias("js"), vx.total_variation("_t", "_s").alias("tv"), vx.pearson("_t", "_s").alias("correlation"), vx.overlap(vx.top_k("_t", k), vx.top_k("_s", k), k).alias("topk_overlap"),
        F.array_max("_t").alias("t_confidence"), F.array_max("_s").alias("s_confidence"), vx.cross_entropy(teacher, y).alias("t_nll"), vx.cross_entropy(student, y).alias("s_nll"),
        t_ok.alias("t_ok"), s_ok.alias("s_ok"),
    )


def block_metrics(positions: DataFrame) -> DataFrame:
    """Means of a block's positions and its raw counts."""
    count = lambda c: F.count_if(c)
    t, s = F.col("t_ok"), F.col("s_ok")
    means = ["top1_match", "kl", "reverse_kl", "kl_temperature", "js", "tv", "correlation", "topk_overlap", "t_confidence", "s_confidence", "t_nll", "s_nll"]
    return positions.groupBy("block_id").agg(
        *[F.avg(m).alias(m) for m in means], F.count("*").alias("n_tokens"), count(t & s).alias("both_ok"), count(t & ~s).alias("teacher_only"), count(~t & s).alias("student_only"), count(~t & ~s).alias("none_ok"),
        count(~t).alias("teacher_error"), count(~s).alias("student_error"), count(~t & ~s).alias("error_intersection"), count(~t | ~s).alias("error_union"), count(~t & ~s & (F.col("t_top") == F.col("s_top"))).alias("same_wrong"),
    )


def resample(df: DataFrame, index: str, n: int, samples: int, seed: int) -> DataFrame:
    """(draw, slot, index): for each draw n indexes with replacement, by hash."""
    spark = df.sparkSession
    slots = spark.range(samples * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("slot"))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("draw").cast("string"), F.col("slot").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return slots.withColumn(index, F.pmod(h, F.lit(n)))


def bootstrap_mean(blocks: DataFrame, value: str, samples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(estimate, lo, hi) by resampling blocks; one block gives a degenerate interval. blocks have index 0 to n - 1 as i."""
    n = blocks.count()
    tail = (1 - confidence) / 2
    if n < 2:
        return blocks.agg(F.avg(value).alias("estimate"), F.avg(value).alias("lo"), F.avg(value).alias("hi"))
    draws = resample(blocks, "i", n, samples, seed).join(blocks.select("i", F.col(value).alias("v")), "i").groupBy("draw").agg(F.avg("v").alias("m"))
    ci = draws.agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return blocks.agg(F.avg(value).alias("estimate")).crossJoin(ci)


def bootstrap_ratio(blocks: DataFrame, a: str, b: str, samples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    n = blocks.count()
    tail = (1 - confidence) / 2
    r = lambda x, y: F.sum(x) / F.greatest(F.sum(y), F.lit(1))
    if n < 2:
        return blocks.agg(r(a, b).alias("estimate"), r(a, b).alias("lo"), r(a, b).alias("hi"))
    draws = resample(blocks, "i", n, samples, seed).join(blocks.select("i", a, b), "i").groupBy("draw").agg(r(a, b).alias("m"))
    ci = draws.agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    return blocks.agg(r(a, b).alias("estimate")).crossJoin(ci)


def baseline_summary(blocks: DataFrame, means: list[str], ratios: dict[str, tuple[str, str]], perplexities: dict[str, str], samples: int = 2000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """(metric, estimate, lo, hi): means and ratios of sums of the blocks with intervals from one resampling of them, then the
    exponentials of some means, the tokens and the blocks, without intervals. Blocks have index 0 to n - 1 as i."""
    n = blocks.count()
    tail = (1 - confidence) / 2
    stats = [F.avg(m).alias(m) for m in means] + [(F.sum(a) / F.greatest(F.sum(b), F.lit(1))).alias(k) for k, (a, b) in ratios.items()]
    names = [*means, *ratios]
    drawn = resample(blocks, "i", n, samples, seed).join(blocks, "i").groupBy("draw").agg(*stats)
    ends = drawn.agg(*[F.percentile(k, F.array(F.lit(tail), F.lit(1 - tail))).alias(f"{k}_ci") for k in names])
    whole = blocks.agg(*stats, F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").cast("double").alias("blocks"))
    row = lambda k, v, lo, hi: F.struct(F.lit(k).alias("metric"), v.alias("estimate"), lo.alias("lo"), hi.alias("hi"))
    none = F.lit(None).cast("double")
    rows = [row(k, F.col(k), F.get(f"{k}_ci", F.lit(0)), F.get(f"{k}_ci", F.lit(1))) for k in names]
    rows += [row(k, F.exp(v), none, none) for k, v in perplexities.items()] + [row(k, F.col(k), none, none) for k in ("tokens", "blocks")]
    return whole.crossJoin(ends).select(F.explode(F.array(*rows)).alias("r")).select("r.*")  # one row by one row


def perturbations(spark, sigmas: list[float], dropouts: list[float], replacements: list[float]) -> DataFrame:
    """(key, family, level): the grid of conditions."""
    rows = [("noise", s) for s in sigmas] + [("dropout", d) for d in dropouts] + [("replacement", r) for r in replacements]
    return spark.createDataFrame(rows, "family string, level double").select(F.format_string("%s_%.3f", "family", "level").alias("key"), "family", "level")


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) by the md5 of keys and seed."""
    h = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def perturb_tokens(df: DataFrame, tokens: str, rate: float, seed: int, kind: str, eos: int = -1) -> DataFrame:
    """Adds perturbed: tokens dropped (null), or replaced by another position's of the block; the first and end ids stay."""
    t = F.col(tokens)
    u = lambda i, s: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("block_id").cast("string"), i.cast("string"), F.lit(str(s)))), 1, 8), 16, 10).cast("long")

    def one(x: Column, i: Column) -> Column:
        hit = (i > 0) & (x != eos) & (u(i, seed) / float(1 << 32) < rate)
        other = F.get(t, F.pmod(i + 1 + F.pmod(u(i, seed + 1), F.size(t) - 1), F.size(t)).cast("int"))
        return F.when(hit, F.lit(None) if kind == "dropout" else other).otherwise(x)

    return df.withColumn("perturbed", F.transform(t, one))


def token_levenshtein(a: str, b: str) -> Column:
    """Edit distance of two id arrays: distinct ids become letters of a private alphabet, then the built-in distance."""
    vocab = F.array_distinct(F.concat(a, b))
    letters = lambda v, ids: F.array_join(F.transform(ids, lambda x: F.char(F.lit(0) + F.array_position(v, x).cast("long"))), "")
    small = vx.let(vocab, lambda v: F.levenshtein(letters(v, F.col(a)), letters(v, F.col(b))))
    return small


def common_prefix(a: str, b: str) -> Column:
    """How many leading items two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.array_position(same, False)
    return F.when(n == 0, F.size(same)).otherwise(n - 1).cast("long")


def generation_metrics(a: str, b: str) -> list[Column]:
    n = F.greatest(F.size(a), F.size(b), F.lit(1))
    hits = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return [(1 - token_levenshtein(a, b) / n).alias("edit_similarity"), common_prefix(a, b).alias("common_prefix"), (F.col(a) == F.col(b)).alias("exact"), (hits / n).alias("position_match")]


def robustness(clean: DataFrame, perturbed: DataFrame, band: float) -> DataFrame:
    """Per condition: student and teacher stability, loss increases, the gap and whether it lies in the band."""
    j = perturbed.alias("p").join(clean.alias("c"), F.col("p.block_id") == F.col("c.block_id"))
    g = j.groupBy(F.col("p.key").alias("key")).agg(F.avg("p.t_match").alias("t_stability"), F.avg("p.s_match").alias("s_stability"), F.avg(F.col("p.t_nll") - F.col("c.t_nll")).alias("t_increase"), F.avg(F.col("p.s_nll") - F.col("c.s_nll")).alias("s_increase"))
    return g.withColumn("gap", F.col("s_stability") - F.col("t_stability")).withColumn("degradation_gap", F.col("s_increase") - F.col("t_increase")).withColumn("in_band", F.abs("gap") <= band)


def robustness_blocks(df: DataFrame, clean_t: str, clean_s: str, noisy_t: str, noisy_s: str, label: str = "label") -> DataFrame:
    """Means over a block's positions of two models' clean and perturbed logits: stability, agreement, divergences, losses, hits."""
    names = {"_ct": clean_t, "_cs": clean_s, "_pt": noisy_t, "_ps": noisy_s}
    x = df.select("block_id", F.col(label).alias("_y"), F.col(noisy_t).alias("_lt"), F.col(noisy_s).alias("_ls"), *[vx.softmax(v).alias(k) for k, v in names.items()])
    top = {k: vx.argmax(k) for k in names}
    values = {
        "teacher_top1_stability": top["_ct"] == top["_pt"], "student_top1_stability": top["_cs"] == top["_ps"], "perturbed_top1_match": top["_pt"] == top["_ps"],
        "perturbed_kl_teacher_student": vx.kl("_pt", "_ps"), "teacher_clean_to_perturbed_kl": vx.kl("_ct", "_pt"), "student_clean_to_perturbed_kl": vx.kl("_cs", "_ps"),
        "perturbed_teacher_nll": vx.cross_entropy("_lt", F.col("_y")), "perturbed_student_nll": vx.cross_entropy("_ls", F.col("_y")),
        "perturbed_teacher_correct": top["_pt"] == F.col("_y"), "perturbed_student_correct": top["_ps"] == F.col("_y"),
    }
    return x.groupBy("block_id").agg(*[F.avg(v.cast("double")).alias(k) for k, v in values.items()], F.count("*").alias("n_tokens"))


def verdict(match_lo: Column, kl_hi: Column, in_band: Column, least: float = 0.95, most_kl: float = 0.10) -> Column:
    """Equivalent only if intervals lie inside the bounds: not merely not different."""
    return F.when((match_lo >= least) & (kl_hi <= most_kl) & in_band, "equivalent").otherwise("not_equivalent")


def contingency(positions: DataFrame) -> DataFrame:
    t, s = F.col("t_ok"), F.col("s_ok")
    return positions.agg(F.count_if(t & s).alias("both_ok"), F.count_if(t & ~s).alias("teacher_only"), F.count_if(~t & s).alias("student_only"), F.count_if(~t & ~s).alias("none_ok"))
