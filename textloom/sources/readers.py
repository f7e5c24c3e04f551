"""Sources: document scans with explicit schemas, JSONL in strict and tolerant forms, CoNLL-U, logs, archives, configs."""

from __future__ import annotations

import dataclasses
import io
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType

from textloom.functions import text as tx
from textloom.operators.prefix import row_index


@dataclass(frozen=True)
class SourceSpec:
    """Where documents come from and how their columns are named."""

    path: str
    name: str = ""
    subset: str = ""
    format: str = "parquet"
    text_column: str = "text"
    id_column: str = "id"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    return spark.read.format(spec.format).load(spec.path)


def metadata(df: DataFrame, text_column: str) -> Column:
    """The scalar columns other than the text, as a map of strings."""
    keep = [f.name for f in df.schema.fields if f.name != text_column and isinstance(f.dataType, (NumericType, StringType, BooleanType))]
    parts = [x for c in keep for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.create_map(*parts) if parts else F.expr("cast(map() as map<string,string>)")


def documents(df: DataFrame, spec: SourceSpec, order: str) -> DataFrame:
    """The six-field document record; blank texts go, ids fall back to id, url, then the row's number."""
    some = lambda c: F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`").cast("string"))
    ids = [some(c) for c in dict.fromkeys((spec.id_column, "id", "url")) if c in df.columns]
    x = row_index(df, order, "_row")
    return x.where(tx.not_blank(spec.text_column)).select(
        F.coalesce(*ids, F.concat(F.lit("row-"), F.col("_row").cast("string"))).alias("source_id"), F.lit(spec.name).alias("source_name"), F.lit(spec.path).alias("source_dataset"), F.lit(spec.subset).alias("source_subset"),
        F.col(spec.text_column).alias("text"), metadata(df, spec.text_column).alias("metadata"),
    )


def strict(df: DataFrame, text: str, order: str, skip: int = 0) -> DataFrame:
    """Rows after skip; a null or empty text is an error."""
    ok = F.assert_true(F.coalesce(F.length(text), F.lit(0)) > 0, F.lit("empty text in a strict scan"))
    return row_index(df, order, "_row").where(F.col("_row") >= skip).where(ok.isNull()).drop("_row")


def lenient(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull() & (F.col(text) != ""))


def scored(df: DataFrame, score: str, least: float, order: str, skip: int = 0) -> DataFrame:
    """Rows that pass the score floor, after skip of them; rows with empty text count too."""
    return row_index(df.where(tx.score_passes(score, least)), order, "_row").where(F.col("_row") >= skip).drop("_row")


def local_or_remote(spark: SparkSession, local: SourceSpec, remote: SourceSpec) -> DataFrame:
    """The first source if its path exists, else the second."""
    return load(spark, local if exists(spark, local.path) else remote)


def jsonl(spark: SparkSession, path, schema: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """JSON lines; DROPMALFORMED skips bad lines, FAILFAST makes them errors."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows and their line numbers in their files; a malformed line is an error that names its line."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "")
    full = StructType.fromDDL(schema).add("_corrupt_record", StringType())
    x = raw.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.when(F.col("r._corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("malformed line "), (F.col("line") + 1).cast("string"))))
    return x.where(bad.isNull()).select((F.col("line") + 1).alias("line"), *[F.col(f"r.`{f.name}`") for f in full.fields[:-1]])


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all *.jsonl (field text, bad lines skipped) and *.txt (one a line) below folder, with their file."""
    f = F.col("_metadata.file_name").alias("file")
    parts = []
    for pattern, read in (("*.jsonl", lambda r: r.schema("text string").option("mode", "DROPMALFORMED").json(folder)), ("*.txt", lambda r: r.text(folder).withColumnRenamed("value", "text"))):
        parts.append(read(spark.read.option("pathGlobFilter", pattern)).select(f, "text"))
    return parts[0].unionByName(parts[1]).where(tx.not_blank("text"))


def non_empty_texts(df: DataFrame) -> DataFrame:
    out = lenient(df, "text").select("text")
    if out.isEmpty():
        raise ValueError("no non-empty text")
    return out


def conllu(spark: SparkSession, path: str, tags: list[str]) -> DataFrame:
    """(sentence, words, tags, misc); sentences with multiword ids go, empty nodes and unknown tags are skipped."""
    s = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n\s*\n")).alias("sentence", "block"))
    rows = F.transform(F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")), lambda x: F.split(x, "\t"))
    s = s.select("sentence", rows.alias("rows")).where(F.size("rows") > 0).where(~F.exists("rows", lambda r: F.get(r, F.lit(0)).contains("-")))
    ok = F.filter("rows", lambda r: ~F.get(r, F.lit(0)).contains(".") & F.get(r, F.lit(3)).isin(*tags))
    s = s.select("sentence", ok.alias("rows"))
    col = lambda i: F.transform("rows", lambda r: F.get(r, F.lit(i)))
    return s.select("sentence", col(1).alias("words"), col(3).alias("tags"), col(9).alias("misc"))


def prompts(df: DataFrame, text: str, label: str, names: list[str], order: str, n: int, first: int) -> DataFrame:
    """(idx, text, prompt, label, label_name): the first n rows, spaces collapsed, the first words as prompt."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    lookup = F.array(*[F.lit(x) for x in names])
    x = row_index(df, order, "idx").where(F.col("idx") < n)
    return x.select("idx", t.alias("text"), F.array_join(F.slice(F.split(t, " "), 1, first), " ").alias("prompt"), F.col(label).cast("int").alias("label"), F.get(lookup, F.col(label).cast("int")).alias("label_name"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a line ledger."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def tar_members(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(archive, member, content) of tar archives, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, data in zip(p["path"], p["content"]):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    rows += [(name, m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and pattern in m.name]
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last path, in name order, that a glob finds."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return max((s.getPath().toString() for s in found), default=None)


def union_runs(parts: dict[str, DataFrame], column: str = "gpu") -> DataFrame:
    """Tables of differing columns, one after the other, each with its name."""
    out = None
    for name, df in parts.items():
        x = df.withColumn(column, F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def run_log(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """A run's JSON lines; a torn last line is skipped unless the reader is strict."""
    return jsonl(spark, path, schema, "DROPMALFORMED" if tolerant else "FAILFAST")


def phase(df: DataFrame, name: str) -> DataFrame:
    """The rows of one phase of a run log; eval takes all evaluations, the post-noise one too."""
    p = F.col("phase")
    return df.where(p.startswith("eval") | (p == "post_noise") if name == "eval" else p == name)


def config(cls, values: dict):
    """A frozen dataclass of a mapping; unknown and missing keys are errors, nested dataclasses are built too."""
    known = {f.name: f for f in dataclasses.fields(cls)}
    if extra := sorted(set(values) - set(known)):
        raise ValueError(f"unknown keys: {extra}")
    if missing := sorted(k for k, f in known.items() if k not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING):
        raise ValueError(f"missing keys: {missing}")
    types = {k: f.type for k, f in known.items()}
    out = {k: config(types[k], v) if dataclasses.is_dataclass(types[k]) and isinstance(v, dict) else v for k, v in values.items()}
    made = cls(**out)
    if hasattr(made, "validate"):
        made.validate()
    return made


def load_config(path: str, cls):
    import yaml

    with open(path) as f:
        return config(cls, yaml.safe_load(f) or {})
