"""The training-data operators against brute force, round trips and the defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from textloom.llm import chat_format, decontaminate, language_id, mixing, near_dedup, quality_classifier, quality_rules, token_count, token_output, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the of and a word " * 30_000
#: Null, empty, white space, ties, repeats, a very long text and a null id; columns that clash with the operators' own names.
ROWS = [(1, None, "en", "b"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (5, LONG, "en", "a"), (None, "no id here at all", "fr", "b"), (7, "Ünï çödé 中文 \x85 x" * 3, "fr", None)]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", "1 as size", "2 as n", "'x' as bucket", "3 as score", "'y' as h", "4 as n_chars")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def rows(df):
    return [r.asDict() for r in df.collect()]


# op1


def brute_chat(turns):
    by = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        out[conv] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["<|end|>", "</s>", "[INST]", "\\", "<", "[", "\n", "é", "😀", "a ", "<|role|>user<|text|>", ""]
    turns = [(c, t, rnd.choice(["user", "assistant", "system", None, "<|text|>"]), rnd.choice([None, "".join(rnd.choices(bits, k=rnd.randint(0, 9)))])) for c in [*range(60), None] for t in range(rnd.randint(1, 7))]
    turns += [(900, 1, "assistant", "x" * 300_000), (900, 1, "assistant", "x" * 300_000), (901, None, "user", "tie"), (901, None, "assistant", "tie")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'z' as formatted")
    f = chat_format.chat_format(d)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(f).collect()}
    assert got == brute_chat(turns)
    for r in f.collect():
        inside = re.sub(r"<\|role\|>|<\|text\|>|<\|end\|>", "", r.formatted)
        assert not re.search(r"</s>|\[INST\]|\[/INST\]|<\|", inside)


def test_chat_parts_and_empty(spark, monkeypatch):
    d = spark.createDataFrame([(1, t, "assistant", f"<{t}>") for t in range(5000)], "conv_id long, turn long, role string, text string")
    batch = d.orderBy("turn").select("conv_id", "role", "text").toArrow().to_batches()
    monkeypatch.setattr(chat_format, "PART_BYTES", 10_000)
    parts = [r for b in chat_format._format(iter(batch)) for r in b.to_pylist()]
    assert len(parts) > 1 and [p["part"] for p in parts] == list(range(len(parts)))
    assert [t for p in parts for _, t in chat_format.parse(p["formatted"])] == [f"<{t}>" for t in range(5000)]
    assert chat_format.read_back(chat_format.chat_format(d.limit(0))).count() == 0


# op2, op3


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def test_token_output(docs, texts):
    tok, at, want = library("byte_bpe_50k.json"), 0, {}
    for i in sorted(texts):
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = token_output.token_output(docs, P.path("byte_bpe_50k.json"))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want


def test_token_output_odd_rows(odd, none, spark):
    tok = library("byte_bpe_50k.json")
    got = token_output.token_output(odd, P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(ROWS)
    n = Counter((r.doc_id, r.n_tokens) for r in got)
    assert n == Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ROWS)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order][:1] == [None] and [r.doc_id for r in order[1:]] == sorted(r.doc_id for r in order[1:])
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]
    assert token_output.token_output(none, P.path("byte_bpe_50k.json")).count() == 0


def test_token_orc_files(docs, spark, tmp_path):
    out = f"file://{tmp_path}/orc"
    token_output.write_tokens(docs, out, P.path("byte_bpe_50k.json"))
    assert token_output.manifest(spark, out).agg({"n_docs": "sum"}).first()[0] == docs.count()
    assert token_output.lookup(spark, out, [17]).count() == 1


def scanned(df):
    """The rows that the scan of a collected DataFrame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    while leaf.nodeName().startswith("AdaptiveSparkPlan"):
        leaf = leaf.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_token_orc_prunes(spark, tmp_path):
    """Row groups are skipped by minimum and maximum, and by the Bloom filter for an id that lies between but isn't there."""
    out, n = f"file://{tmp_path}/orc", 30_000
    d = spark.range(n).selectExpr("id * 2 as doc_id", "concat('text number ', id) as text")
    token_output.write_tokens(d, out, P.path("byte_bpe_50k.json"))
    assert {f.suffix for f in tmp_path.glob("orc/part-*")} == {".orc"}
    assert scanned(token_output.read_tokens(spark, out)) == n
    assert token_output.lookup(spark, out, [20_000]).count() == 1 and 1 <= scanned(token_output.lookup(spark, out, [20_000])) <= 1000
    assert scanned(token_output.lookup(spark, out, [20_001])) == 0
    schema = token_output.read_tokens(spark, out).orderBy("doc_id").select("doc_id").limit(3).collect()
    assert [r.doc_id for r in schema] == [0, 2, 4]


def test_token_orc_stripes(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(token_output.ORC, "orc.stripe.size", "65536")
    monkeypatch.setitem(token_output.ORC, "orc.rows.between.memory.checks", "200")
    d = spark.range(6000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 40), i -> hash(id, i))) as text").coalesce(1)
    out = f"file://{tmp_path}/orc"
    token_output.write_tokens(d, out, P.path("byte_bpe_50k.json"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(str(p)) for p in tmp_path.glob("orc/*.orc")]
    assert max(jvm.org.apache.orc.OrcFile.createReader(p, jvm.org.apache.orc.OrcFile.readerOptions(conf)).getStripes().size() for p in files) > 1
    one = library("byte_bpe_50k.json")
    got = {r.doc_id: r.ids for r in token_output.read_tokens(spark, out).where("doc_id % 997 = 0").collect()}
    for r in d.where("doc_id % 997 = 0").collect():
        assert got[r.doc_id] == [*one.encode(r.text, add_special_tokens=False).ids, 0]


def test_hot_id_fills_several_ranges(spark):
    d = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "concat('t ', id) as text")
    got = token_output.token_output(d, P.path("byte_bpe_50k.json")).collect()
    order = sorted(got, key=lambda r: r.start)
    assert len(got) == 4000 and [r.doc_id for r in order] == sorted(r.doc_id for r in got)
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]


ALPHABET = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "12", "3", "é", "ß", "—", "!", "?", "\xa0", "\x1c", "\u0301", "中", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "²", "_", "'", "\x0b", "\x85", "ﬁ", "word ", "😀"]


def test_pieces_and_counts_equal_the_library():
    rnd = random.Random(1)
    x = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(3000)]
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    assert [a.tolist() for a in token_output.Pieces(byte).encode(x)] == [e.ids for e in byte.encode_batch(x, add_special_tokens=False)]
    plain = ["".join(rnd.choices([" ", "\n", "  ", "a", "the", "é,", "9", "'s", "!"], k=rnd.randint(0, 30))) for _ in range(6000)]
    assert [a.tolist() for a in token_output.Pieces(byte).encode(plain)] == [e.ids for e in byte.encode_batch(plain, add_special_tokens=False)]
    assert [token_count.count_tokens(P.path("word_bpe_49k.json"), t) for t in x] == [len(e.ids) for e in word.encode_batch(x, add_special_tokens=False)]


def test_other_tokenizers_go_to_the_library():
    word = library("word_bpe_49k.json")
    p = token_output.Pieces(word)
    assert not p.known and token_output.Pieces(library("byte_bpe_50k.json")).known
    x = ["Some words, 12 of them", "", "x " * 50]
    assert [a.tolist() for a in p.encode(x)] == [e.ids for e in word.encode_batch(x, add_special_tokens=False)]


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT", 50)
    tok, rnd = library("byte_bpe_50k.json"), random.Random(7)
    x = ["".join(rnd.choices([" ", "\n", "  ", "a", " the", "é,", "9", "'s", "!", "中"][: 9 + k % 2], k=400)) for k in range(40)] + ["a" * 500, " " * 300]
    assert [a.tolist() for a in token_output.Pieces(tok).encode(x)] == [e.ids for e in tok.encode_batch(x, add_special_tokens=False)]


def test_overlap_resynchronisation():
    rnd, tok = random.Random(2), library("word_bpe_49k.json")
    encode = lambda s: tok.encode(s, add_special_tokens=False)
    for t in ["", *("".join(rnd.choices(ALPHABET, k=3000)) for _ in range(5)), "a" * 20_000, "中" * 9000, "ab " * 9000, "x" * 4000 + " y" * 4000]:
        for chunk, overlap in ((600, 16), (100, 8), (64, 64)):
            parts = list(token_count.spliced(t, encode, chunk, overlap, 8))
            assert "".join(parts) == t and [i for p in parts for i in encode(p).ids] == encode(t).ids
        assert token_count.count_tokens(P.path("word_bpe_49k.json"), t) == len(encode(t).ids)


def test_chunks_stay_small():
    tok, sizes = library("word_bpe_49k.json"), []

    def encode(s):
        sizes.append(len(s))
        return tok.encode(s, add_special_tokens=False)

    parts = list(token_count.spliced("the word é, " * 40_000, encode))
    assert "".join(parts) == "the word é, " * 40_000 and max(map(len, parts)) <= token_count.CHUNK + token_count.OVERLAP
    assert len(parts) > 50 and max(sizes) <= token_count.OVERLAP + token_count.CONTEXT


def test_token_counts(odd, none, spark):
    tok = library("word_bpe_49k.json")
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(odd, P.path("word_bpe_49k.json")).collect())
    want = Counter((i, len((t or "").encode()), n, n > 2048) for i, t, *_ in ROWS for n in [len(tok.encode(t or "", add_special_tokens=False).ids)])
    assert got == want and token_count.token_counts(none, P.path("word_bpe_49k.json")).count() == 0


# op4


def distance(a, b):
    """The least edits of a to any substring of b."""
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_myers_and_leaks_against_brute_force():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcde", k=rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(6)]
    texts = [" ".join(word() for _ in range(30)) for _ in range(10)]
    for _, t in items:
        s = list(t)
        for _ in range(rnd.randint(0, 8)):
            k = rnd.randrange(len(s))
            s[k : k + 1] = rnd.choice([[], ["z"], [s[k], "q"]])
        texts.append(" ".join(word() for _ in range(5)) + " , " + "".join(s).upper() + "! " + word())
    m = decontaminate.Matcher(items, rate=0.06)
    for t in texts:
        n = decontaminate.normalise(t)
        want = {i: d for i, s in items for d in [distance(s, n)] if d <= int(0.06 * len(s))}
        assert {x[0]: x[1] for x in m.leaks(t)} == want


def test_short_items_are_whole_words():
    m = decontaminate.Matcher([(1, "cat"), (2, "a"), (3, "New York")])
    assert m.leaks("concatenate") == [] and [x[0] for x in m.leaks("The CAT!")] == [1] and [x[0] for x in m.leaks("a new-york")] == [2, 3]
    assert [x[0] for x in m.leaks("new yorker")] == []


def test_leak_span_is_the_passage():
    rnd = random.Random(15)
    item = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(30))
    for _ in range(30):
        s = list(item)
        for _ in range(rnd.randint(0, 8)):
            k = rnd.randrange(5, len(s) - 5)
            s[k : k + 1] = rnd.choice([[], ["z"], [s[k], "q"]])
        text = "xx yy " * rnd.randint(0, 5) + "".join(s) + " zz ww" * rnd.randint(0, 5)
        (_, d, _, start, end) = decontaminate.Matcher([(1, item)]).leaks(text)[0]
        whole = decontaminate.normalise(text)[start:end]
        assert distance(item, whole) == d and abs(len(whole) - len(item)) <= d
        assert distance(whole, item) <= d


def test_long_text_and_several_blocks(spark, monkeypatch):
    rnd = random.Random(16)
    items = [(i, " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(20))) for i in range(30)]
    docs = [(k, "filler words here " * 20_000 * (k == 0) + items[k][1].upper() + " and more") for k in range(10)] + [(None, items[11][1]), (50, "clean text"), (50, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(k, k) for k in range(10)] + [(-1, 11)])
    for size in (decontaminate.BLOCK_BYTES, 1500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()) == want
        assert [(r.doc_id, r.text) for r in decontaminate.drop_leaks(d, b).collect()] == [(50, "clean text"), (50, None)]


def test_leaks_on_tables(spark, sf, docs, texts, odd, none):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    exact = {(i, b.item_id) for b in items.collect() for i, t in texts.items() if decontaminate.normalise(b.text) in decontaminate.normalise(t)}
    assert exact <= got
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()}
    assert kept == set(texts) - {i for i, _ in got}
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "no id here at all")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bad).collect()] == [(None, 3)]
    assert decontaminate.find_leaks(none, bad).count() == 0 and decontaminate.find_leaks(odd, bad.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bad).columns == odd.columns


# op5


def brute_groups(texts, num=75, den=100):
    sets = {}
    for i, t in texts.items():
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if k and k * den >= (len(sets[a]) + len(sets[b]) - k) * num:
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_near_dedup_on_the_table(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_groups(texts)


def test_near_dedup_chains_and_families(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    texts, n = {}, 0
    for family in range(4):
        base = [word() for _ in range(90)]
        for k in range(25):  # a chain whose ends are far apart, and copies of its links
            base = list(base)
            base[rnd.randrange(90)] = word()
            texts[n] = " ".join(base)
            texts[n + 1] = " ".join(base).upper()
            n += 2
    shared = [word() for _ in range(60)]
    for k in range(40):  # a shared passage alone links nothing
        texts[n] = " ".join(shared + [word() for _ in range(60)])
        n += 1
    texts |= {n: None, n + 1: "", n + 2: "a b", n + 3: "A  B", n + 4: "a b c"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()}
    assert got == brute_groups(texts)


def brute_rows(rows):
    """Components over rows: the rows of one id are one node."""
    sets = [brute_groups({0: t})[0][0] for _, t in rows]
    grams = []
    for _, t in rows:
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            k = len(grams[a] & grams[b])
            if k and 100 * k >= 75 * (len(grams[a]) + len(grams[b]) - k):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, n, top(i)) for (i, _), n in zip(rows, sets))


def test_one_id_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    a, b = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(40))
    rows = [(1, a), (2, b), (9, a), (9, b)]
    passage = [word() for _ in range(70)]
    rows += [(100 + k, " ".join(passage + [word() for _ in range(20)])) for k in range(120)]
    rows += [(100 + k % 90, " ".join(passage[:60] + [word() for _ in range(9)])) for k in range(60)]
    base = [word() for _ in range(90)]
    for k in range(40):
        base = list(base)
        base[rnd.randrange(90)] = word()
        rows.append((400 + k // 2, " ".join(base)))
    rows += rows[:30]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_rows(rows)


def test_blocks_are_bounded(spark, monkeypatch):
    """A bucket of 2,000 documents with equal sketches and no link: whatever is compared at once has two blocks' rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", 128)
    rnd, n = random.Random(22), 2000
    sig, bands = bytearray(rnd.randbytes(near_dedup.T)), list(range(near_dedup.BANDS))
    f = spark.createDataFrame([(k, k, 50, sig, bands, sorted(rnd.getrandbits(62) for _ in range(50))) for k in range(n)], "doc_id long, k1 long, n_shingles long, sig binary, bands array<long>, shingles array<long>")
    none = spark.createDataFrame([], "node long, root long")
    seen = {}

    def watch(num, den):
        def run(batches):
            for b in batches:
                for k in zip(*(b.column(c).to_pylist() for c in (1, 2))):
                    seen[k] = seen.get(k, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*((10**6 + a * 1000 + b, c) for (a, b), c in seen.items()))], names=["u", "v"])

        return run

    monkeypatch.setattr(near_dedup, "_block_links", watch)
    rows = near_dedup._cross_links(f.selectExpr("cast(0 as long) as bucket", "doc_id", "k1"), none, f.drop("shingles"), f.select("doc_id", "k1", "shingles"), 75, 100)
    sizes = [r.u for r in rows.collect()]
    assert len(sizes) > 16 * 15 / 2 and max(sizes) < 2 * 128 * 1.5


def test_near_dedup_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    odd_set = len(near_dedup.shingle_set(ROWS[-1][1]))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 5, 5), (7, odd_set, 7)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketch_fills_and_estimates():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rnd.integers(0, 2**63, 80).astype(np.uint64)])
    s = near_dedup.sketch([np.unique(a), np.unique(b), np.array([7], np.uint64)])
    assert (s != near_dedup.FULL).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.12


def test_components_of_random_graphs(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    got = near_dedup.connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {x: top(x) for x in root if top(x) != x}
    assert {r.node: r.root for r in got.collect() if r.node != r.root} == want


# op6


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_at_the_smallest_scale(spark, sf, docs):
    """Eight rows of one class are enough."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_classifier.quality_scores(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert len({r.score for r in got}) > 20 and sum(r.predicted == y[r.doc_id] for r in held) >= 0.9 * len(held)
    kept = {r.doc_id for r in quality_classifier.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted} and 0 < len(kept) < len(got)


def test_quality_odd_rows(odd, none, spark, docs, sf):
    """Null, empty and very long texts through a model that knows both classes."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    labels = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id long, quality int"), allowMissingColumns=True)
    x = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 as doc_id", "text")).selectExpr("*", "1 as score", "2 as x", "'k' as y")
    got = [r for r in quality_classifier.quality_scores(x, labels).collect() if r.doc_id is None or r.doc_id >= 1_000_000]
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) > 2
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r.score) == r.score  # repeated rows agree
    assert by[1_000_001] == by[1_000_002] and not any(r.predicted for r in got if r.doc_id == 1_000_005)
    kept = quality_classifier.keep_good(x, labels)
    assert kept.columns == x.columns and 0 < kept.count() < x.count()
    one = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.quality_scores(odd, one).collect()} == {1.0}  # one class only
    pair = spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, quality int")
    assert len({r.score for r in quality_classifier.quality_scores(odd, pair, folds=1000).collect()}) > 1
    assert quality_classifier.quality_scores(none, labels).count() == 0 and quality_classifier.keep_good(none, labels).count() == 0


def test_statistics_against_brute_force():
    at = {n: i for i, n in enumerate(quality_classifier.NAMES)}
    for t in ["", None, "One two two. THREE!! 4#", "É a\nÉ a\nb, c; d", "x " * 300, "a b c a b c a b c longerthantwelve"]:
        s, raw = t or "", (t or "").encode()
        w = s.split()
        n, m = len(raw) + 60, len(w) + 10
        v = quality_classifier.statistics(t)
        lines = [x for x in s.split("\n") if x.strip()]
        assert v[at["words"]] == pytest.approx(math.log(m))
        assert v[at["digits"]] == pytest.approx(math.sqrt(sum(c.isdigit() for c in s) / n))
        assert v[at["upper"]] == pytest.approx(math.sqrt(sum(c.isupper() for c in s) / n))
        assert v[at["bangs"]] == pytest.approx(math.sqrt(s.count("!") / n))
        assert v[at["repeats"]] == pytest.approx(math.sqrt(sum(a == b for a, b in zip(w, w[1:])) / m))
        assert v[at["dup_lines"]] == pytest.approx(math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 2)))
        assert v[at["long_words"]] == pytest.approx(math.sqrt(sum(len(x.encode()) > 12 for x in w) / m))
        assert v[at["distinct"]] == pytest.approx(math.log(len(set(w)) + 10) / math.log(m))


def density(x, q):
    """The shrunk class densities, directly."""
    d, n = q.shape[1], [len(a) for a in x]
    covs = [np.cov(a.T, bias=True) for a in x]
    pooled = (n[0] * covs[0] + n[1] * covs[1] + np.eye(d)) / sum(n)
    s = np.sqrt(np.diag(pooled))

    def share(c, k, t):
        e = ((c * c.T).sum() + np.trace(c) ** 2) / (k - 1)
        gap = ((c - t) ** 2).sum()
        return min(1, e / gap) if gap > 0 else 1

    unit = pooled / s[:, None] / s
    a = share(unit, sum(n), np.eye(d))
    unit = (1 - a) * unit + a * np.eye(d)
    logs = []
    for rows, c, k in zip(x, covs, n):
        c = c / s[:, None] / s
        a = 0.1 + 0.9 * share(c, k, unit)
        c = (0.98 * ((1 - a) * c + a * unit) + 0.02 * np.eye(d)) * s[:, None] * s
        e = q - rows.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) + np.linalg.slogdet(c)[1]) + math.log(k))
    return logs[1] - logs[0]


@pytest.mark.parametrize("sizes", [(400, 900), (3, 40)])
def test_discriminant_against_density(sizes):
    rnd = np.random.default_rng(2)
    d = quality_classifier.DIM
    x = [rnd.normal(0, 1, (sizes[0], d)), rnd.normal(0.7, 1.3, (sizes[1], d))]
    m = quality_classifier.Model(np.array([np.concatenate([[len(a)], a.sum(0), (a.T @ a).ravel()]) for a in x]))
    q = rnd.normal(0.3, 1, (5, d))
    assert np.allclose(m.difference(q), density(x, q))


def test_calibration_is_the_maximum():
    rnd = np.random.default_rng(3)
    for scale in (1, 10, 16):
        bins = [(b * 0.5, float(k), float(n)) for b in range(-scale, scale + 1) for n in [rnd.integers(1, 200)] for k in [rnd.binomial(n, 1 / (1 + math.exp(-0.4 * b - 0.3)))]]
        m = quality_classifier.Model(np.ones((2, 1 + quality_classifier.DIM * (1 + quality_classifier.DIM))))
        m.calibrate(bins)
        one, zero = sum(k for _, k, _ in bins), sum(n - k for _, k, n in bins)
        aim = [(d, k * (one + 1) / (one + 2) + (n - k) / (zero + 2), n) for d, k, n in bins]
        gain = lambda a, b: sum(k * (a * d + b) - n * math.log1p(math.exp(a * d + b)) for d, k, n in aim) - 5e-4 * (a * a + b * b)  # noqa: E731, B023
        best = gain(m.slope, m.shift)
        assert all(best >= gain(m.slope + x, m.shift + y) for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))


# op7


def brute_url(url, allow, block):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [r for r in [*allow, *block] for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fit, key=len, default=None)


def markov(texts):
    """The smoothed model of op7, directly: p(c | a, b)."""
    tri = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
    bc, c1, ab, b1 = Counter(), Counter(), Counter(), Counter()
    for g, n in tri.items():
        bc[g[1:]] += n
        c1[g[2]] += n
        ab[g[:2]] += n
        b1[g[1]] += n
    n0, t0 = sum(tri.values()), len(c1)
    t3, t2 = Counter(g[:2] for g in tri), Counter(g[0] for g in bc)

    def p(g):
        p1 = (c1[g[2]] + t0 / url_filter.A) / (n0 + t0)
        p2 = (bc[g[1:]] + t2[g[1]] * p1) / (b1[g[1]] + t2[g[1]]) if b1[g[1]] else p1
        return (tri[g] + t3[g[:2]] * p2) / (ab[g[:2]] + t3[g[:2]]) if ab[g[:2]] else p2

    return p


def test_url_filter_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    allow, block = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]
    got = {r.page_id: r for r in url_filter.url_filter(pages, allow, block).collect()}
    fold = lambda h, p: "^^" + re.sub(r"[^a-z0./\-_]", "*", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), h + p))) + "$"
    sides = {True: [], False: []}
    for r in pages.collect():
        h, p, rule = brute_url(r.url, allow, block)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (h, p, rule)
        if rule:
            assert got[r.page_id].verdict == ("allow" if rule in allow else "block")
            sides[rule in allow].append(fold(h, p))
    yes, no = markov(sides[True]), markov(sides[False])
    for r in list(got.values())[:80]:
        s = fold(r.host, r.path)
        assert r.score == pytest.approx(sum(math.log(yes(s[i : i + 3]) / no(s[i : i + 3])) for i in range(len(s) - 2)) / (len(s) - 2), abs=1e-6)
    rest = [r for r in got.values() if not r.rule]
    edge = min((r.score for r in rest if r.verdict == "allow"), default=9)
    assert all((r.score >= edge) == (r.verdict == "allow") for r in rest)


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET?x", "x://example.net/en", "x://example.net/en/", "x://badexample.net/en/", "a://b://c/d", "x://é.org/fr/é#1"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'q' as host", "1 as x", "2 as score")
    allow, block = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.url_filter(d, allow, block).collect()}
    assert got == {i: brute_url(u, allow, block) for i, u in enumerate(urls)}
    long = spark.createDataFrame([(None, "http://a.example.net/en/" + "x" * 200_000), (3, "http://b.com/q"), (3, "http://b.com/q")], "page_id long, url string")
    out = url_filter.url_filter(d.select("page_id", "url").unionByName(long), allow, block).collect()
    assert [(len(r.path), r.rule) for r in out if r.page_id is None] == [(200_004, "example.net/en/")]
    again = [(r.host, r.path, r.rule, r.verdict, r.score) for r in out if r.page_id == 3 and r.host == "b.com"]
    assert len(again) == 2 and again[0] == again[1]
    tie = url_filter.url_filter(long, ["b.com/q"], ["com/q", "b.com/"]).collect()
    assert {r.rule for r in tie if r.page_id == 3} == {"b.com/q"}
    assert {r.verdict for r in url_filter.url_filter(d, [], ["net/"]).collect() if not r.rule} == {"allow"}
    assert url_filter.url_filter(d.limit(0), allow, block).count() == 0


# op8


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_odd_rows(odd, none):
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.identify(odd).collect()}
    assert {got[i][1:] for i in (1, 2, 3)} == {("und", 0.0)}
    assert got[5][1] == "en" and got[4][1] == "en" and got[None][1] in ("en", "fr") and all(0 <= v[2] <= 1 for v in got.values())
    assert all(v[0] == (zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2) for i, v in got.items())
    assert len(language_id.identify(odd).collect()) == len(ROWS) and language_id.identify(none).count() == 0


def test_language_votes_and_families_against_brute_force():
    """Random machines: the family of the largest margin, then the language with most votes, ties by margins."""
    rnd = np.random.default_rng(5)
    codes = {c: language_id.FAMILY.get(c, c) for c in ["en", "de", "nl", "sv", "fr", "es", "it", "ru", "uk", "xx", "yy"]}
    within = {}
    for c in sorted(codes):
        within.setdefault(codes[c], []).append(c)
    machines = {(f, "", ""): rnd.normal(size=language_id.DIM + 1).astype(np.float32) for f in within}
    machines |= {(f, a, b): rnd.normal(size=language_id.DIM + 1).astype(np.float32) for f, cs in within.items() for i, a in enumerate(cs) for b in cs[i + 1 :]}
    m = language_id.Model(codes, machines)
    margin = lambda k, x: float(machines[k][:-1] @ x + machines[k][-1])
    for _ in range(60):
        x = rnd.normal(size=language_id.DIM).astype(np.float32)
        f = max(sorted(within), key=lambda f: margin((f, "", ""), x))
        votes = {c: 0.0 for c in within[f]}
        for i, a in enumerate(within[f]):
            for b in within[f][i + 1 :]:
                v = margin((f, a, b), x)
                votes[a if v >= 0 else b] += 1
                votes[a] += 1e-3 * math.tanh(v)
                votes[b] -= 1e-3 * math.tanh(v)
        assert m.family(x)[0] == f and m.language(f, x)[0] == max(sorted(votes), key=votes.get)


def test_machine_is_the_optimum():
    """The weights minimise the regularised squared hinge loss: no small step lowers it."""
    rnd = np.random.default_rng(6)
    x, y = rnd.normal(size=(60, 5)).astype(np.float32), np.repeat([1.0, -1.0], 30)
    x[:30] += 0.8
    w = language_id.svm(x, y, c=1.0, epochs=2000)
    z = np.hstack([x, np.ones((60, 1))])
    loss = lambda v: 0.5 * v @ v + (np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
    assert all(loss(w) <= loss(w + 0.01 * s) for s in [*np.eye(6), *-np.eye(6)])


def test_many_languages(spark, monkeypatch):
    """Seventy languages, of which a table of common codes knows few: each is learned."""
    rnd = random.Random(23)
    words = {f"l{k:02d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 7))) for _ in range(40)] for k in range(68)} | {"en": ["the", "of", "house", "with"], "de": ["der", "haus", "mit", "und"]}
    rows = [(i * 100 + k, " ".join(rnd.choices(w, k=60)), c) for i, (c, w) in enumerate(words.items()) for k in range(24)]
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i][1], c) for i, _, c in rows if got[i][0]]
    assert len({c for _, c in held}) > 64 and sum(a == b for a, b in held) > 0.97 * len(held)


def test_sample_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 5)
    got = language_id.sample(docs.unionByName(docs), 4, 2).groupBy("lang").count().collect()
    assert {r["count"] for r in got} == {5}


# op9


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rnd = random.Random(seed)
    many = [(i, " ".join(["w"] * rnd.randint(0, 400)), rnd.choices(["a", "b", "Z", "é", "tiny", None], [60, 20, 15, 10, 1, 5])[0]) for i in range(1500)]
    d = spark.createDataFrame(many, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as n")
    got = mixing.mix(d).collect()
    assert len(got) == len(many) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()))
    src = {i: s for i, _, s in many}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[src[r.doc_id]] += r["size"]
        taken[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.02 * want[s])
    out = mixing.mix_rows(d)
    assert out.columns == d.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - taken[s]) <= 0.1 * taken[s] + 800 for s in taken)


def test_blocks_against_brute_force(spark, monkeypatch):
    """Block by block: the words a document has in the blocks that its shard's seeded permutation picks."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    monkeypatch.setattr(mixing, "GROUP", 3)
    rnd = random.Random(31)
    many = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 50, 400])), rnd.choice(["a", "b", "b", None])) for i in range(300)]
    d = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(d).collect()}
    h = {r.doc_id: r.h for r in d.selectExpr("doc_id", f"xxhash64(doc_id, cast(size(filter(split(text, ' '), x -> x <> '')) as long), {mixing.SEED}) h").collect()}
    rank = {s: i + 1 for i, s in enumerate(["a", "b", None])}
    size, source = {r: got[r]["size"] for r in got}, {i: s for i, _, s in many}
    sums, shards = Counter(), {}
    for i, s in source.items():
        sums[s] += size[i]
    for i, s in source.items():
        if size[i]:
            shards.setdefault((s, h[i] % max(1, -(-sums[s] // 2000))), []).append(i)
    n = {k: max(1, math.floor(sum(size[i] for i in v) / mixing.BLOCK + 0.5)) for k, v in shards.items()}
    targets = brute_targets(sums)
    blocks = {s: sum(v for (t, _), v in n.items() if t == s) for s in sums}
    wanted = [targets[s] * blocks[s] / sums[s] for s in rank]
    per = dict(zip(rank, mixing.sainte_lague(wanted, round(sum(wanted)), [mixing.CAP * blocks[s] for s in rank])))
    cells = {tuple(r)[:2]: r.c for r in spark.createDataFrame([(rank[s], k) for s, k in shards], "rank int, shard long").selectExpr("rank", "shard", f"xxhash64(rank, shard, {mixing.SEED + 1}) c").collect()}
    for s in rank:
        own = sorted(k for t, k in shards if t == s)
        teams = sorted({k // 3 for k in own})
        team_n = [sum(n[s, k] for k in own if k // 3 == g) for g in teams]
        for g, q in zip(teams, mixing.sainte_lague([float(x) for x in team_n], per[s], [mixing.CAP * x for x in team_n])):
            mine = [k for k in own if k // 3 == g]
            for k, quota in zip(mine, mixing.sainte_lague([float(n[s, k]) for k in mine], q, [mixing.CAP * n[s, k] for k in mine])):
                ids = sorted(shards[s, k], key=lambda i: (h[i], i))
                words = [i for i in ids for _ in range(size[i])]
                c, m = cells[rank[s], k], n[s, k]
                step, shift = mixing.STEPS[c % len(mixing.STEPS)] % m, (c >> 8) % m
                taken = Counter()
                for b in range(m):
                    times = quota // m + ((b * step + shift) % m < quota % m)
                    for i in words[b * len(words) // m : (b + 1) * len(words) // m]:
                        taken[i] += times
                assert all(got[i].taken == taken[i] for i in ids)


def test_sainte_lague_is_highest_quotients():
    rnd = random.Random(8)
    for _ in range(60):
        w = [rnd.choice([0, 1, 5, 20, 300]) * rnd.random() for _ in range(rnd.randint(1, 12))]
        seats = rnd.randint(0, 200)
        want = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            i = max((i for i in range(len(w)) if w[i] > 0), key=lambda i: (w[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(w, seats) == want


def test_mix_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    by = {(r.doc_id, r["size"]): r for r in got}
    assert all(by[i, 0].taken == 0 for i in (1, 2, 3)) and by[5, 150_000].taken > 0 and sum(r.taken for r in got) > 0
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0
    x = odd.selectExpr("*", "7 as _size", "8 as size_", "9 as copy")
    out = mixing.mix_rows(x)
    assert out.columns == x.columns and {(r._size, r.size_, r.copy) for r in out.collect()} == {(7, 8, 9)}


# op10


def brute_rules(t):
    w = WORD.findall(t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_rules_against_brute_force(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choices(["a", "b ", "the ", "\n", "\t", "# ", "é ", "\x0b", "X!"], k=rnd.randint(0, 120))) for _ in range(200)] + ["x y z " * 500, "a b c d e f g h " * 2, "a b c d e f g h"]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r.doc_id: counts(r) for r in quality_rules.quality_rules(d).collect()} == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_rules.quality_rules(docs).collect() if r.doc_id in y and not r.base_failed]
    clean, junk = [r.kept for r in got if y[r.doc_id]], [r.kept for r in got if not y[r.doc_id]]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.25


def test_rules_of_many_languages(spark):
    """Forty languages of their own words; documents without lang take the language whose common words they hold."""
    rnd = random.Random(41)
    rows, bad = [], []
    for k in range(40):
        letters = "".join(rnd.sample("abcdefghijklmnopqrstuvwxyz" if k % 2 else "абвгдежзиклмнопрстуфхцчшэюя", 16))
        words = ["".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(60)]
        text = lambda: " ".join(rnd.choices(words, weights=[40] * 6 + [1] * 54, k=300))  # noqa: B023, E731
        rows += [(k * 100 + i, text(), f"l{k:02d}") for i in range(20)] + [(k * 100 + 50, text(), None)]
        bad.append((k * 100 + 60, " ".join("".join(rnd.choices("qxzwk", k=5)) for _ in range(300)), f"l{k:02d}"))
    d = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(d).collect()}
    assert all(got[i] for i, *_ in rows) and sum(got[i] for i, *_ in bad) <= 1


def test_common_words_by_documents(spark, docs):
    want = {}
    for r in docs.collect():
        want.setdefault(r.lang, Counter()).update({w for w in WORD.findall(r.text or "") if len(w) <= quality_rules.LONGEST})
    got = {r.lang: r.known for r in quality_rules.common_words(docs).collect()}
    assert got == {k: sorted(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON]) for k, c in want.items()}


def test_rules_odd_rows(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    assert Counter((r.doc_id, counts(r)) for r in got) == Counter((i, brute_rules(t)) for i, t, *_ in ROWS)
    assert quality_rules.quality_rules(none).count() == 0


def test_js_distance(spark):
    x = spark.range(1).selectExpr("array(3L, 1L, 0L) h", "4L n", "array(0.25D, 0.25D, 0.5D) q")
    got = x.select(quality_rules.js_distance(x.h, x.n, x.q)).first()[0]
    p, q = [0.75, 0.25, 0], [0.25, 0.25, 0.5]
    kl = lambda a, b: sum(u * math.log2(u / v) for u, v in zip(a, b) if u)
    m = [(u + v) / 2 for u, v in zip(p, q)]
    assert got == pytest.approx(math.sqrt((kl(p, m) + kl(q, m)) / 2))
