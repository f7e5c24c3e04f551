"""Cutting lineage to storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary folder stands in only in local mode, where one machine is all."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "textloom-shared")
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint below spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base_folder(df.sparkSession) + "/textloom-checkpoints")
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in storage that all executors share."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Write one small text file into whatever store the path is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path
