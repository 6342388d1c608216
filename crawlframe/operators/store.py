"""Intermediate tables that are kept, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='crawlframe-')}")
    return _own_dir[0]


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (or another that all executors share) and read it back.

    Cuts the lineage, so that a lost executor costs a reread and not the whole
    job, and fixes values such as row ids that a rerun would deal out anew.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
