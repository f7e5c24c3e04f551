"""Helpers the training-data operators share: shared storage, code shipping and word rules."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import shipping
from textloom.operators.storage import base_folder

#: The separators of the word rule: space and the control characters 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\f\r"
#: A maximal run of anything else, for Java's and DuckDB's regular expressions.
WORD_RUN = r"[^\x20\x09-\x0D]+"

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run in storage that all executors share."""
    return f"{base_folder(spark)}/textloom-{_RUN}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:  # the session has ended; the folder's owner clears it
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one intermediate or output table; removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"textloom-{_RUN}" in path:
            _remove(df.sparkSession, path)


_HELD: dict[str, Callable[[], None]] = {}


def holds(name: str, forget: Callable[[], None]) -> None:
    """Register what a worker process remembers under a name."""
    _HELD[name] = forget


def claim(name: str) -> None:
    """In a worker that begins the work of one operator: let the others' memory go. Workers outlive stages."""
    for other, forget in _HELD.items():
        if other != name:
            forget()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application."""
    shipping.ship(spark)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in views of few rows. Spark bounds a batch in bytes; what Python makes of it is bounded by these."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def unused(name: str, taken: list[str]) -> str:
    """A column name that is not taken (names differ by more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of an id written in decimal, modulo n: the fold rule. Null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))
