"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in a local session that configures none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or _own_folder()


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def every_column(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, …: names with dots or quotes can't pass through a Python worker."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


#: Rows that carry whole texts go to the Python workers in batches of so many, which bounds memory on both sides.
TEXTS = 1000


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to so many rows, or the session's own size if that is less, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) < rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back; ``batch`` bounds the rows of an Arrow batch.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = f"{folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    with batches_of(df.sparkSession, batch) if batch else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/tidemark/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
