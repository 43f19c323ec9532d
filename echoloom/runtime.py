"""Materialising intermediate tables and numbering rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that this session writes its intermediate tables to.

    Where that is unset, a temporary folder is taken on a single machine; on a cluster its
    executors would not share it, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="settled")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Bytes of an Arrow batch of wide rows: ten thousand of them would fill a worker.
ARROW = 4 << 20


#: Spark's setting that files of a query's shuffles are removed as it ends, not when the driver happens to collect its plan.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, wide: bool = False, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, read again: without lineage, and read by column.

    Fingerprints are settled before they are exploded: else the optimizer repeats their
    computation below every Generate. wide: rows of texts or words, which go to Python in batches
    bounded by bytes and are written with delta encoding, half of what numbers of 64 bits take.
    release: what was shuffled for df is removed from disk once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW)} if wide else {}
    wanted |= {RELEASE: "true"} if release else {}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        (df.write.option("parquet.writer.version", "v2") if wide else df.write).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column of numbers from 0 by the given order; rows that are equal in it get numbers in no set order.

    Rows are dealt out by ranges of the order and numbered within them; each range starts at the
    count of rows before it. Only those counts, one for each range, meet in a task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + place).drop("_part", "_first")
