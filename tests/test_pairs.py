"""Queries over pairs of embeddings give the SQL's rows where the table has more than 500 rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import registry

import __spark_entry__  # noqa: F401
from tests.test_queries import plain

NAMES = """
h06_entropy_by_group
h07_rank_summary
h08_cross_entropy_bits
h09_nucleus_coverage
h10_histogram
h14_word_mass
h41_record_entropy
j02_j03_top_k
l30_softmax
l31_l32_entropy
l33_l36_divergences
l37_pearson
l38_confidence
l39_sampling
""".split()


@pytest.fixture(scope="module")
def large(spark, sf, tmp_path_factory):
    """1,203 rows: the 500 of the smallest table, copies with other vectors under ids up to 1,199, and three ids below 0."""
    d = tmp_path_factory.mktemp("pairs")
    x = spark.read.parquet(f"{sf}/embeddings.parquet")
    moved = x.withColumn("embedding", F.transform(F.reverse("embedding"), lambda v: (v * F.lit(0.75)).cast("float")))
    ids = x.unionByName(moved.withColumn("vec_id", F.col("vec_id") + 500)).unionByName(moved.where("vec_id < 200").withColumn("vec_id", F.col("vec_id") + 1000))
    ids.unionByName(moved.where("vec_id between 1 and 3").withColumn("vec_id", -F.col("vec_id"))).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_pairs_of_large_table(spark, large, name):
    df = registry.QUERIES[name](spark, large)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{large}/embeddings.parquet/*.parquet'")
    want = c.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)
