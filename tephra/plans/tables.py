"""Tables in the shared folder: they cut the lineage of iterative plans and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(_write(df, tag))


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); one of our own where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: tables between stages need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tephra-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/tephra/{tag}-{uuid.uuid4().hex}"
    WORK.append(path)
    return path


#: Work tables of this driver; results are read from them, so they stay until remove_work.
WORK: list[str] = []


def remove_work(spark: SparkSession) -> None:
    """Delete the work tables of this driver, when its results are written or no longer needed."""
    while WORK:
        path = spark._jvm.org.apache.hadoop.fs.Path(WORK.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, tag: str) -> str:
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return path


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """df with a gapless number from 0 in the given order, without one task for all rows: sorted by range, numbered within each range, and
    moved by the rows before it. Rows that are equal in the order are numbered in any order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    held = written(ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order))), "numbered")
    counts = held.groupBy("__p").count().orderBy("__p").collect()  # one row a partition
    base, rows = 0, []
    for r in counts:
        rows.append((r["__p"], base))
        base += r["count"]
    before = df.sparkSession.createDataFrame(rows, "__p int, __base long")
    return held.join(F.broadcast(before), "__p").withColumn(name, F.col("__base") + F.col("__k") - 1).drop("__p", "__k", "__base")
