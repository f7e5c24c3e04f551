"""Goldens and identities: packing, batches, vectors, fits, elbows, alignment, budgets, greedy dedup, streams."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import schedules as sc
from textloom.functions import text as tx
from textloom.functions import vectors as vx
from textloom.operators import cluster, compare, dedup, linear, mix, ordered, pack, prefix, runs, scorer, select, stats
from textloom.sources import readers, sinks


def one(df):
    return df.first()


def test_packing_golden(spark):
    d = spark.createDataFrame([(0, "ab"), (1, "cde"), (2, "f")], "seq long, s string")
    d = d.withColumn("t", F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: F.ascii(c) - 96))
    got = [r.tokens for r in pack.pack(d, "t", "seq", 4, 99).orderBy("block_id").collect()]
    assert got == [[1, 2, 99, 3], [4, 5, 99, 6]]
    assert pack.shard_manifest(pack.shards(d, "t", "seq", 4, 100)).orderBy("shard").collect()[-1].tokens == 2


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_packing_does_not_depend_on_partitions(spark, parts):
    rnd = random.Random(1)
    docs = [[rnd.randrange(50) for _ in range(rnd.randrange(40))] for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(docs)), "seq long, t array<int>").repartition(parts)
    flat = [x for t in docs for x in [*t, 7]]
    want = [flat[i : i + 16] for i in range(0, len(flat) - 15, 16)]
    assert [r.tokens for r in pack.pack(d, "t", "seq", 16, 7).orderBy("block_id").collect()] == want


def test_batches(spark):
    d = spark.range(10)
    assert sorted(r["count"] for r in mix.batches(d, ["id"], 2, cap=5).groupBy("batch_id").count().collect()) == [1, 2, 2]
    a, b = (mix.epochs(d, "id", 4, 2, 7).orderBy("epoch", "batch_id", "id").collect() for _ in range(2))
    assert a == b and len(a) == 16
    assert mix.batches(d, ["id"], 4, drop_last=True).count() == 8


def test_prefix_sums(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.randrange(9)) for i in range(200)]
    got = prefix.exclusive_sum(spark.createDataFrame(rows, "i long, g string, v long").repartition(9), "v", ["g"], "i", "s").collect()
    for r in got:
        assert r.s == sum(v for i, g, v in rows if g == r.g and i < r.i)


def test_identical_logits(spark):
    rnd = np.random.default_rng(0)
    rows = [(0, i, i % 5 + 1, rnd.normal(size=11).tolist()) for i in range(5)]
    d = spark.createDataFrame(rows, "block_id int, pos int, label int, t_logits array<double>").withColumn("s_logits", F.col("t_logits"))
    b = one(compare.block_metrics(compare.position_metrics(d, k=3)))
    assert b.top1_match == 1 and abs(b.kl) < 1e-12 and abs(b.kl_temperature) < 1e-12 and b.tv == 0 and b.topk_overlap == 1


def test_error_counts(spark):
    rows = [(0, 0, 0, [0.0, 3.0, 1.0], [0.0, 3.0, 1.0]), (0, 1, 0, [0.0, 3.0, 1.0], [0.0, 1.0, 3.0])]
    d = spark.createDataFrame(rows, "block_id int, pos int, label int, t_logits array<double>, s_logits array<double>")
    b = one(compare.block_metrics(compare.position_metrics(d, k=2)))
    assert (b.teacher_error, b.error_intersection, b.same_wrong) == (2, 2, 1)


def test_cka_rotation_and_procrustes(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(128, 8))
    q, _ = np.linalg.qr(rnd.normal(size=(8, 8)))
    d = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, 2 * x @ q + 1))], "i int, x array<double>, y array<double>")
    assert linear.cka(d, "x", "y") == pytest.approx(1, abs=1e-5)
    r, scale, r2 = linear.procrustes(d.where("i < 64"), d.where("i >= 64"), "x", "y")
    assert np.allclose(r, q, atol=1e-6) and scale == pytest.approx(2) and r2 == pytest.approx(1)
    assert 1 < linear.effective_rank(d, "x") <= 8 and linear.spectrum_cosine(d, "x", "y") == pytest.approx(1)


def test_assignment_is_optimal():
    from itertools import permutations

    rnd = np.random.default_rng(4)
    for n in (1, 2, 5, 6):
        c = rnd.normal(size=(n, n))
        got = linear.assign(c)
        assert sorted(got) == list(range(n))
        assert sum(c[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(n))))


def test_sentence_rebuild(spark):
    d = spark.createDataFrame([(["Hello", ",", "world"], ["SpaceAfter=No", "_", "_"])], "w array<string>, m array<string>")
    r = one(d.select(pack.rebuild_sentence(F.col("w"), F.col("m")).alias("r"))).r
    assert r.text == "Hello, world" and [(s.start, s.end) for s in r.spans] == [(0, 5), (5, 6), (7, 12)]


def test_correlations(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert one(d.agg(stats.pearson(d, "x", "y").alias("r"))).r == pytest.approx(1)
    assert one(stats.spearman(d, "x", "y")).rho == pytest.approx(1)
    assert one(d.limit(2).agg(stats.pearson(d, "x", "y").alias("r"))).r is None


def test_conditioning(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(0, k, [v * 2**k for v in base], [v * 2**k * 1.1 for v in base]) for k in range(3)]
    d = spark.createDataFrame(rows, "example int, layer int, clean array<double>, noisy array<double>")
    for r in linear.layer_conditioning(d).collect():
        assert r.cumulative == pytest.approx(1) and r.incremental == pytest.approx(1)


def test_moving_variance_golden(spark):
    widths = [0.5273725986480713, 0.5021706223487854, 0.3587738573551178, 0.3082716464996338]
    d = spark.createDataFrame(list(zip([24, 48, 72, 96], widths)), "n int, w double")
    x = ordered.moving_variance(d, "w", "n", 3, 4)
    assert [r.moving for r in x.orderBy("n").collect()] == pytest.approx([0.52737, 0.51477, 0.46277, 0.38974], abs=1e-5)
    r = one(ordered.first_breach(x, "n", 1e-10))
    assert r.breach == 96 and r.max_variance == pytest.approx(0.002934132889338137, abs=1e-12)


def test_gradient_equals_numpy(spark):
    x, y = [1.0, 2.0, 4.0, 7.0, 8.5], [9.0, 5.0, 3.0, 2.5, 2.4]
    d = spark.createDataFrame(list(zip(x, y)), "x double, f double")
    got = [r.g for r in d.select("x", ordered.gradient("f", "x").alias("g")).orderBy("x").collect()]
    assert got == pytest.approx(np.gradient(y, x).tolist())
    assert one(ordered.elbow(d.limit(2), "f", "x")).elbow == max(x[:2])


def test_run_arithmetic():
    n = sc.tokens_per_update(512, 8, 2)
    assert n == 8192 and sc.total_updates(10_000_000, n) == 1221


def test_line_rules(spark):
    # The nine phrases.
    phrases = ["terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies", "terms and conditions", "all rights reserved", "see ap.org"]
    good = ["One two[1] three four five.\r", "\t One two three four five! \t", "one two three [citation needed] four five'", "please sign up here for one more."]
    bad = ["© one two three four five.", "one two three four.", "one two three four five", "One JavaScript two three four.", *(f"we say {p.upper()} one two three." for p in phrases)]
    t = spark.createDataFrame([("\n".join([*good, *bad]),)], "t string")
    assert one(t.select(tx.clean_lines("t").alias("c"))).c == "\n".join(["One two three four five.\r", good[1], "one two three  four five'", good[3]])
    x = spark.createDataFrame([("\u00a0 a\x0b\x0c b \n\n\n\n\n c\x1c\r\n",)], "t string")
    assert one(x.select(tx.normalise_space("t").alias("c"))).c == "a b \n\n c"
    y = spark.createDataFrame([("Ünï ﬁ “x” 中 é\t.",)], "t string")
    assert one(y.select(tx.normalise("t").alias("c"))).c == "Uni fi x e\t."


def clean(text, bad=("scum", "worthless")):
    """The cleaning rules in plain Python, up to the sentences: (reason, text)."""
    t = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    t = re.sub(r"\n{4,}", "\n\n", re.sub(r"[^\S\n\t\r]+", " ", t)).strip()
    if "{" in t or "lorem ipsum" in t.lower() or any(re.search(rf"\b{w}\b", t.lower()) for w in bad):
        return "document", None
    kept = []
    for line in t.split("\n"):
        low, s = line.lower(), line.strip()
        if "javascript" in low or any(p in low for p in tx.BOILERPLATE) or s.startswith("©") or len(s.split()) < 5 or s[-1] not in ".!?\"'":
            continue
        kept.append(re.sub(r"(?i)\[\d+\]|\[citation needed\]", "", line))
    t = "\n".join(kept)
    w = t.split()
    if not w:
        return "empty", None
    if not 20 <= len(w) <= 8000:
        return "length", None
    g = list(zip(w, w[1:], w[2:]))
    if sum(map(str.isalpha, t)) / len(t) < 0.4 or sum(x.isupper() and len(x) > 2 for x in w) / len(w) > 0.4 or 1 - len(set(g)) / len(g) > 0.25:
        return "quality", None
    return None, t


def test_clean_pipeline_equals_the_loop(spark, sf):
    from textloom import registry
    from textloom.plans import p01_clean  # noqa: F401

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.reason, r.clean_md5) for r in registry.QUERIES["l03_clean_pipeline"](spark, sf).collect()}
    hashes, taken, seen = set(), set(), Counter()
    for r in sorted(docs, key=lambda r: r.doc_id):
        reason, t = ("language", None) if r.lang != "en" else clean(r.text)
        if t is not None:
            s = [x.strip() for x in re.sub(r"([.!?]+[\"')\]]*)\s+", "\\1\x01", t).split("\x01") if x.strip()]
            grams = {" ".join(s[k : k + 3]) for k in range(len(s) - 2)}
            reason = "sentences" if len(s) < 3 else "exact" if t in hashes else "overlap" if grams & taken else None
            if len(s) >= 3:
                hashes.add(t)
            if reason is None:
                taken |= grams
        seen[reason] += 1
        assert got[r.doc_id] == (reason, hashlib.md5(t.encode()).hexdigest() if reason is None else None)
    assert seen[None] > 5 and len(seen) >= 4


def test_document_rules(spark):
    t = ["a { b", "Lorem IPSUM dolor", "a scum here", "scummy", "", "A" * 50, "a b c " * 10, " ".join(["w"] * 19), " ".join(f"w{i}" for i in range(20))]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(t)], "i int, t string")
    r = {x.i: x for x in d.select("i", tx.has_brace("t").alias("b"), tx.has_placeholder("t").alias("p"), tx.has_bad_word("t", ["scum"]).alias("w"), tx.passes_quality("t").alias("q"), tx.passes_length("t").alias("n"), tx.repeat_ratio("t").alias("r")).collect()}
    assert r[0].b and r[1].p and r[2].w and not r[3].w and not r[4].q and not r[6].q and not r[7].n and r[8].n and r[5].r == 0


def test_unicode_words(spark):
    d = spark.createDataFrame([("a b　c\td\ne",)], "t string")
    assert one(d.select(tx.words("t").alias("w"))).w == list("abcde")
    f = spark.createDataFrame([("ﬁancé ß Привет é",)], "t string")
    assert one(f.select(tx.fold_ascii("t").alias("f"))).f == "fiance   e"
    n = spark.createDataFrame([(" a  b\t\tc\n\n\n\n\nd\n\n\ne ",)], "t string")
    assert one(n.select(tx.normalise_space("t").alias("n"))).n == "a b\t\tc\n\nd\n\n\ne"


def sequential_greedy(docs):
    seen, out = set(), []
    for i, s in docs:
        grams = {tuple(s[k : k + 3]) for k in range(len(s) - 2)}
        if not grams & seen:
            out.append(i)
            seen |= grams
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    docs = [(i, [f"{rnd.choice('abcde')} x." for _ in range(rnd.randrange(1, 7))]) for i in range(40)]
    d = spark.createDataFrame([(i, " ".join(s)) for i, s in docs], "i long, t string").repartition(3)
    assert sorted(r.i for r in dedup.greedy_overlap(d, "t", "i").collect()) == sequential_greedy(docs)
    assert {r.i for r in dedup.conservative_overlap(d, "t", "i").collect()} <= set(sequential_greedy(docs))


def test_budgets_keep_the_crossing_row(spark):
    d = spark.createDataFrame([(i, "a", 10) for i in range(10)] + [(i, "b", 10) for i in range(10, 20)], "i long, s string, e long")
    got = mix.source_budget(d, "s", "i", "e", 100, {"a": 0.25, "b": 0.5})
    assert sorted(r.i for r in got.collect()) == [0, 1, 2, 10, 11, 12, 13, 14]
    assert mix.global_budget(got, ["i"], "e", 45).count() == 5


@pytest.mark.parametrize("ratio", [0.0, 0.5, 1.0])
def test_interleave_keeps_both_orders(spark, ratio):
    a, b = spark.range(7).select(F.col("id").alias("k_id")), spark.range(100, 112).select(F.col("id").alias("k_id"))
    got = mix.interleave(a, b, "k_id", ratio, 3).orderBy("position").collect()
    ids = [r.k_id for r in got]
    assert [i for i in ids if i < 100] == list(range(7)) and [i for i in ids if i >= 100] == list(range(100, 112))
    if ratio == 1.0:
        assert ids[:7] == list(range(7))
    if ratio == 0.0:
        assert ids[:12] == list(range(100, 112))


def test_vector_identities(spark):
    d = spark.createDataFrame([([0.1, 0.2, 0.7], [0.3, 0.3, 0.4])], "p array<double>, q array<double>")
    r = one(d.select(vx.entropy("p", 2).alias("h"), vx.js("p", "q").alias("js"), vx.js("q", "p").alias("sj"), vx.nucleus_size("p", 0.8).alias("n"), vx.target_rank("q", F.lit(0)).alias("rank"), vx.apply_top_p("p", 0.8).alias("tp"), vx.apply_top_k("p", 1).alias("tk"), vx.sample("p", F.lit(0.95)).alias("s"), vx.quantile("p", 0.5).alias("m")))
    assert r.h == pytest.approx(-sum(x * math.log2(x) for x in (0.1, 0.2, 0.7))) and r.js == pytest.approx(r.sj)
    assert (r.n, r.rank, r.s, r.m) == (2, 3, 2, 0.2) and r.tp == pytest.approx([0, 2 / 9, 7 / 9]) and r.tk == [0, 0, 1]


def test_token_levenshtein(spark):
    rnd = random.Random(7)

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return p[-1]

    rows = [([rnd.randrange(50_000) % 9 for _ in range(rnd.randrange(1, 12))], [rnd.randrange(9) for _ in range(rnd.randrange(1, 12))]) for _ in range(40)]
    d = spark.createDataFrame(rows, "a array<int>, b array<int>").withColumn("d", compare.token_levenshtein("a", "b"))
    assert all(r.d == lev(r.a, r.b) for r in d.collect())


def test_histogram_last_bin_is_closed(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (3.1,)], "x double")
    assert [r.n for r in stats.histogram(d, "x", [0, 1, 2, 3]).orderBy("bin").collect()] == [1, 1, 2]


def test_benchmark_bundle(spark):
    from textloom.plans import p05_models

    r = one(p05_models.benchmark_metrics(spark, ""))
    assert (r.slope, r.intercept, r.r2) == (2437.2962, 3437.7504, 0.99971933) and r.first_failure == 10


def test_bootstrap_of_one_block(spark):
    r = one(compare.bootstrap_mean(spark.createDataFrame([(0, 0.5)], "i long, v double"), "v"))
    assert (r.estimate, r.lo, r.hi) == (0.5, 0.5, 0.5)


def test_selection(spark):
    rows = [(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 4.0]), (3, [0.1, 0.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    assert [r.id for r in select.k_center(d, "v", "id", 3).orderBy("rank").collect()] == [0, 1, 2]
    assert select.gradient_match(d, "v", "id", 1).first().id in (1, 3)
    assert select.facility_location(d.where("id > 0"), "v", "id", 2).count() == 2


def test_ngram_scorer(spark):
    d = spark.createDataFrame([(0, "a b a b a c".split())], "id long, tokens array<string>")
    m = scorer.NgramScorer(2, backoff=0.5).fit(d)
    got = {(r.pos, r.token): math.exp(r.logp) for r in m.score(d).collect()}
    assert got[(1, "b")] == pytest.approx(2 / 3) and got[(0, "a")] == pytest.approx(0.5 * 3 / 6)
    assert one(m.next_tokens(spark.createDataFrame([(9, ["a"])], "id long, tokens array<string>"), 1)).token == "b"
    assert one(scorer.generate(m, spark.createDataFrame([(9, ["a"])], "id long, tokens array<string>"), 2)).tokens == ["a", "b", "a"]


def test_silhouette_and_sizes(spark):
    d = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [10.0]), (3, 1, [11.0])], "id long, c int, v array<double>")
    s = {r.i: r.silhouette for r in cluster.silhouette(d, "v", "id", "c").collect()}
    assert s[0] == pytest.approx((10.5 - 1) / 10.5)
    assert [r.n for r in cluster.cluster_sizes(d, "c", 3).orderBy("cluster").collect()] == [2, 2, 0]


def test_recursive_chunks():
    text = "para one is here.\n\n" + "word " * 60 + "\n\nlast"
    chunks = pack.recursive_chunks(text, 100, 20)
    assert all(len(c) <= 100 for c in chunks) and chunks[0].startswith("para one") and chunks[-1].endswith("last")
    assert pack.recursive_chunks(None) == [] and pack.recursive_chunks("x" * 250, 100, 10)[0] == "x" * 100
    assert all(len(c.split()) <= 20 for c in pack.logical_chunks(text, 5, 20))


def test_strict_readers_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\nnot json\n')
    with pytest.raises(Exception, match="malformed line 2"):
        readers.jsonl_strict(spark, f"file://{tmp_path}/a.jsonl", "text string").collect()
    d = spark.createDataFrame([(0, "x"), (1, "")], "i long, t string")
    with pytest.raises(Exception, match="empty text"):
        readers.strict(d, "t", "i").collect()
    with pytest.raises(ValueError, match="no non-empty"):
        readers.non_empty_texts(d.where("i = 1").withColumnRenamed("t", "text"))
    with pytest.raises(ValueError, match="fewer"):
        sinks.exact_slice(d, "i", 5, f"file://{tmp_path}/slice")


def test_token_shard_bytes(spark, tmp_path):
    import json
    import struct

    from textloom.sources.sinks import write_token_shards

    d = spark.createDataFrame([(0, [1, 2, 3]), (1, [258]), (2, []), (3, [70000 % 65536, 7])], "doc_id long, t array<int>")
    for vocab, code in ((1000, "H"), (100_000, "I")):
        path = f"{tmp_path}/{code}"
        m = write_token_shards(d, "t", "doc_id", 4, vocab, path, eos=9)
        raw = b"".join(p.read_bytes() for p in sorted((tmp_path / code).glob("shard_*.bin")))
        assert struct.unpack(f"<10{code}", raw) == (1, 2, 3, 9, 258, 9, 9, 4464, 7, 9)
        meta = json.loads((tmp_path / code / "meta.json").read_text())
        assert meta["total_tokens"] == 10 and [s["tokens"] for s in meta["shards"]] == [4, 4, 2] and {r.dtype for r in m.collect()} == {meta["dtype"]}


def test_speed_ups_and_rotation(spark):
    m = spark.createDataFrame([("a", 10.0), ("b", 15.0)], "gpu string, best_speed double")
    assert {r.gpu: r.speed_up for r in runs.speed_ups(m, "a").collect()} == {"a": 1.0, "b": 1.5}
