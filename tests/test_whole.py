"""Registered queries give results for all rows of their tables, against brute force on rows of any id."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom import registry
from textloom.operators import blocks, cluster

import __spark_entry__  # noqa: F401


def run(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return registry.QUERIES[name](spark, str(tmp_path)).collect()


def documents(n, seed, words, langs="en"):
    rnd = random.Random(seed)
    return [(i * 37, " ".join(rnd.choices(words, k=rnd.randint(0, 25))), rnd.choice(langs.split())) for i in range(n)]


def families(seed):
    """Documents (id, text, lang) with chains of near copies, equal sets, short, empty and null texts."""
    rnd = random.Random(seed)
    docs = documents(40, seed, "a b c d e".split())
    base = [f"w{rnd.randrange(99)}" for _ in range(60)]
    for k in range(30):
        base = list(base)
        base[rnd.randrange(60)] = f"w{rnd.randrange(99)}"
        docs.append((6000 + k, " ".join(base), "en"))
    return docs + [(5000, docs[3][1], "en"), (5001, "a b", "en"), (5002, None, "en"), (5003, "a  b", "en"), (5004, "", "en"), (5005, "a b", "en")]


def shingle_sets(docs):
    return {i: frozenset({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ()) for i, t, _ in docs for w in [(t or "").split()]}


def similar(x, y):
    return bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)


def test_shingle_jaccard_all_documents(spark, tmp_path):
    docs = families(1)
    sets = shingle_sets(docs)
    first = {s: min(j for j, t in sets.items() if t == s) for s in sets.values() if s}
    links = {s: sum(similar(s, t) for t in first if t != s) for s in first}
    want = {i: (first.get(s, i), links.get(s, 0)) for i, s in sets.items()}
    got = run(spark, tmp_path, "u07_shingle_jaccard", "documents", docs, "doc_id long, text string, lang string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want and len(got) == len(docs) and max(n for _, n in want.values()) > 1


def test_near_copies_lose_no_document(spark, tmp_path):
    """Every link is a true one, and a document with a similar one has a link."""
    docs = families(3)
    sets = shingle_sets(docs)
    got = run(spark, tmp_path, "d05_minhash_near_copies", "documents", docs, "doc_id long, text string, lang string")
    assert all(similar(sets[r.seq], sets[r.first]) for r in got)
    linked = {r.seq for r in got} | {r.first for r in got}
    assert linked == {i for i, s in sets.items() if any(similar(s, t) for j, t in sets.items() if j != i)}


def test_context_monitor_equals_the_loop(spark, tmp_path):
    from textloom.operators.storage import scratch
    from textloom.streaming.streams import context_monitor

    rnd = random.Random(4)
    rows = [(i, i % 3, f"t{i}", rnd.random() * (20 if rnd.random() < 0.1 else 1)) for i in range(300)]
    path = scratch(spark, "monitor")
    spark.createDataFrame(rows, "n long, session long, token string, width double").coalesce(1).sortWithinPartitions("n").write.parquet(path)
    out = []
    x = spark.readStream.schema("n long, session long, token string, width double").parquet(path)
    context_monitor(x, eps=1.0).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", scratch(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    want, held = [], {}
    for _, s, token, width in rows:
        tokens, widths = held.setdefault(s, ([], []))
        tokens.append(token)
        widths.append(width)
        means = [np.mean(widths[max(0, k - 2) : k + 1]) for k in range(len(widths))]
        if len(means) >= 4 and np.var(means[-4:]) > 1.0:
            want.append((s, len(tokens), " ".join(tokens[:8]), " ".join(tokens[-8:])))
            held[s] = ([], [])
    assert sorted((r.session, r.breach_at, r.head, r.tail) for r in out) == sorted(want) and len(want) > 5


def test_stream_batch_that_repeats(spark, tmp_path):
    """A batch that failed after its rows were written is written over."""
    from textloom.streaming.streams import write_once

    src, out, led = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ledger"
    spark.range(10).write.parquet(src)
    x = spark.readStream.schema("id long").parquet(src)
    write_once(x, "id", out, led, f"{tmp_path}/mark").awaitTermination()
    for mark in ("again", "third"):  # as after a lost checkpoint: batch 0 once more
        write_once(x, "id", out, led, f"{tmp_path}/{mark}").awaitTermination()
        assert sorted(r.id for r in spark.read.schema("id long").json(f"{out}/*").collect()) == list(range(10))


def test_domain_ngrams_all_english_documents(spark, tmp_path):
    docs = documents(60, 2, "alpha beta The gamma x of delta2 Été".split(), "en fr")
    count = Counter()
    for _, t, lang in docs:
        w = [x for x in re.findall("[a-zà-ÿ]+", t.lower()) if len(x) > 1 and x not in ("the", "of", "and")] if lang == "en" else []
        count.update(" ".join(w[k : k + 3]) for k in range(len(w) - 2))
    got = run(spark, tmp_path, "f12_domain_ngrams", "documents", docs, "doc_id long, text string, lang string")
    assert {r.gram: r.n for r in got} == {g: n for g, n in count.items() if n >= 2} and len(got) > 20


@pytest.fixture(scope="module")
def vectors():
    """Rows (vec_id, embedding, label) of ids up to 2000 with copies, a label of one row, and their cosines and distances."""
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(150, 6)).astype(np.float32)
    v[100:112] = v[0]
    rows = [(i * 13, v[i].tolist(), 9 if i == 149 else i % 4) for i in range(150)]
    x = v.astype(float)
    n = np.sqrt((x * x).sum(1))
    return rows, (x @ x.T) / np.outer(n, n), np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("size", [16, 512])
def test_embedding_pairs_all_rows(spark, tmp_path, vectors, monkeypatch, size):
    monkeypatch.setattr(blocks, "ROWS", size)
    rows, cos, dist = vectors
    label = np.array([r[2] for r in rows])
    want = {}
    for i in range(150):
        by = {c: dist[i][own].mean() for c in set(label) if (own := (label == c) & (np.arange(150) != i)).any()}
        a, b = by.get(label[i]), min(m for c, m in by.items() if c != label[i])
        want[i * 13] = 0.0 if a is None else (b - a) / max(a, b)
    got = run(spark, tmp_path / "n04", "n04_silhouette", "embeddings", rows, EMBEDDINGS)
    assert {r.vec_id: r.silhouette for r in got} == pytest.approx(want, abs=2e-6) and len(got) == 150

    s = np.where(np.eye(150, dtype=bool), 0.0, cos).ravel()
    r = run(spark, tmp_path / "h11", "h11_pair_statistics", "embeddings", rows, EMBEDDINGS)[0]
    assert [r.mean, r.median, r.p10, r.p90, r.min, r.max] == pytest.approx([s.mean(), *np.quantile(s, [0.5, 0.1, 0.9]), s.min(), s.max()], abs=2e-6)

    got = run(spark, tmp_path / "n02", "n02_g08_cosine_pairs", "embeddings", rows, EMBEDDINGS)
    want = {(i * 13, j * 13): cos[i, j] for i in range(150) for j in range(i + 1, 150) if label[i] == label[j]}
    assert {(r.a, r.b): r.s for r in got} == pytest.approx(want, abs=2e-6) and len(got) == len(want)

    cover, want = np.zeros(150), []
    for _ in range(5):
        gain = np.maximum(np.maximum(cos, 0) - cover[:, None], 0).sum(0)
        gain[[j for j, _ in want]] = -1
        j = int(np.round(gain, 9).argmax())
        want.append((j, gain[j]))
        cover = np.maximum(cover, cos[:, j])
    got = sorted(run(spark, tmp_path / "o07", "o07_facility_location", "embeddings", rows, EMBEDDINGS))
    assert [(r.id, r.gain) for r in got] == [(j * 13, pytest.approx(g, abs=2e-6)) for j, g in want]


def test_pair_statistics_equal_cosines(spark):
    d = spark.createDataFrame([(i, [1.0, 0.0] if i < 30 else [0.0, 1.0]) for i in range(40)], "id long, v array<double>")
    r = cluster.pair_statistics(d, "v", "id", exclude_diagonal=True).first()
    same = (30 * 29 + 10 * 9) / (40 * 39)
    assert [r.mean, r.median, r.p10, r.p90, r.min, r.max] == pytest.approx([same, 1, 0, 1, 0, 1])
    assert cluster.pair_statistics(d.limit(0), "v", "id").first().mean is None


def test_layerwise_alignment_equals_numpy(spark, sf):
    """Every layer's value from all rows of the table; the row cap takes that many."""
    from textloom.operators import linear

    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    v = np.array([r["embedding"] for r in rows], float)
    got = {r["layer"]: (r["n"], r["cka"]) for r in registry.QUERIES["q02_layerwise_cka"](spark, sf).collect()}
    for layer in range(4):
        y = v + np.roll(v, -1, axis=1) * layer * 0.5
        a, b = v - v.mean(0), y - y.mean(0)
        want = np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
        assert got[layer][0] == len(rows) and abs(got[layer][1] - want) < 2e-6
    x = spark.createDataFrame([(0, i, [float(i), float(i * i % 7)]) for i in range(50)], "layer int, i int, v array<double>")
    assert [(r["layer"], r["n"]) for r in linear.layerwise_cka(x, "layer", "v", "v", "i", 20).collect()] == [(0, 20)]


@pytest.mark.parametrize("values", [[9, 5, 4, 1, 0.5, 0.1], [100, 50, 20, 10, 10, 10.1, 3, 1], [5, 4], [7], [3, 3, 3, 3, 9]])
def test_effective_size_equals_the_loop(spark, values):
    from textloom.operators import ordered

    seen = []
    for v in values:
        seen.append(v)
        if len(seen) >= 4 and max(seen[-3:]) - min(seen[-3:]) < 0.02 * sum(seen[-3:]) / 3:
            break
    steps = [b - a for a, b in zip(seen, seen[1:])]
    peaks = [k + 2 for k in range(1, len(steps) - 1) if steps[k] > steps[k - 1] and steps[k] > steps[k + 1]]
    x = spark.createDataFrame([("g", k + 1, float(v)) for k, v in enumerate(values)], "g string, x int, f double")
    kept = ordered.early_stop(x, "f", "x", ["g"])
    assert kept.count() == len(seen)
    assert ordered.difference_elbow(kept, "f", "x", ["g"]).first()["elbow"] == (peaks[0] if peaks else len(seen))


def test_best_ngram_size_equals_the_loop(spark, sf):
    """Elbow, penalties, scaling and choice of every label's sweep, by numpy on the table's rows."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["label"], {}).setdefault(r["vec_id"] % 4 + 1, []).append(r["embedding"][:12])
    want = {}
    for label, curves in sizes.items():
        found = []
        for n, vectors in sorted(curves.items()):
            x = np.arange(1.0, 13)
            f = np.abs(np.array(vectors, float)).mean(0) + 1 + 5 / x
            d1 = np.gradient(f, x)
            k = 1 + int(np.argmax((np.abs(np.gradient(d1, x)) / (1 + d1 * d1) ** 1.5)[1:-1]))
            after = np.abs(np.diff(np.log(f)))[k:]
            found.append([n, np.log(f[k]), after.mean() if len(after) else 1.0, max(0.0, (12 - len(vectors)) / 12), len(vectors) >= 12])
        lo, hi = np.min([c[1:3] for c in found], 0), np.max([c[1:3] for c in found], 0)
        for c in found:
            ce, unrest = (0.0 if hi[i] == lo[i] else (c[1 + i] - lo[i]) / (hi[i] - lo[i] + 1e-12) for i in (0, 1))
            c.append(0.60 * ce + 0.20 * unrest + 0.15 * c[3])
        best = min([c for c in found if c[4]] or found, key=lambda c: (c[5], c[1], c[0]))
        want[label] = (best[0], best[5], best[4])
    got = {r["label"]: (r["n"], r["score"], r["valid"]) for r in registry.QUERIES["l43_best_ngram_size"](spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) > 1
    for label, (n, score, valid) in want.items():
        assert got[label][0] == n and abs(got[label][1] - score) < 2e-6 and got[label][2] == valid
