"""Structured Streaming over tables of fits and mappings that grow by appended files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_fits(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and population deviation of each scenario, kept up to date; works on streams and tables alike."""
    s = stream.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    mean = F.col("s1") / F.col("n")
    return s.select(by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Each batch of the stream appended to a Parquet table, once; processes what there is and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
