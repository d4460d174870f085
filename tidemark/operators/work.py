"""Spreading units of heavy work over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` in an explicit number of partitions by ``keys``: rows are few but each is much work.

    Adaptive execution merges small shuffles into one task; it leaves explicit numbers alone.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
