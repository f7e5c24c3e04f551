"""The pipeline's stages, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
from test_operators import WORD, brute_groups, distance  # noqa: F401

from textloom.llm import decontaminate, mixing, quality_classifier
from textloom.llm._common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, f in corpus_pipeline.STAGES:
        seen.append(materialise(f(spark, seen[-1], sf), name))
    return [x.collect() for x in seen], [x.columns for x in seen]


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "mixing", "token_output"]
    assert all(c == stages[1][0] for c in stages[1][:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_keeps_what_scores(stages, spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.quality_scores(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in stages[0][1]} == good


def test_dedup_stage(stages):
    want = {i for i, (_, _, kept) in brute_groups({r.doc_id: r.text for r in stages[0][1]}).items() if kept}
    assert {r.doc_id for r in stages[0][2]} == want and len(stages[0][2]) == len(want)


def test_decontamination_stage(stages, spark, sf):
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = {r.doc_id for r in stages[0][3]}
    for r in stages[0][2]:
        s = decontaminate.normalise(r.text)
        if any(i in s for i in items):
            assert r.doc_id not in out
        elif r.doc_id not in out:  # within the budget, though not exact
            assert any(distance(i, s) <= int(decontaminate.RATE * len(i)) for i in items)


def test_mixing_stage(stages, spark):
    n = Counter(r.doc_id for r in stages[0][4])
    assert set(n) <= {r.doc_id for r in stages[0][3]} and max(n.values()) <= mixing.CAP
    assert all(WORD.search(r.text) for r in stages[0][4])


def test_token_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in stages[0][4])
    assert Counter((r.doc_id, r.n_tokens) for r in stages[0][5]) == want
    assert re.fullmatch("[a-z_,0-9]+", ",".join(stages[1][5]))


def test_repeated_rows_and_null_ids(spark, sf):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, "A b c d e f g h", "en", "s", 15), (None, "a b c d e f g h", "en", "s", 15), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, d, sf)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3] and out.columns == d.columns


def test_run_agrees_with_stages(spark, sf, stages):
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r.doc_id, r.n_tokens) for r in stages[0][5])
