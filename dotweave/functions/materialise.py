"""Cuts long or iterative plans."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffles are needed no longer once a table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        place = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return f"{place}/{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share (spark.checkpoint.dir), so that nothing before it runs again.

    Tables are compressed Parquet, a fraction of the rows that a checkpoint writes,
    and the shuffles that made one are deleted with its end.
    """
    spark = df.sparkSession
    place = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(place)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(place)
    out.settled_at = place
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes the rows of a table that ``settle`` wrote and that no other table needs any more."""
    place = getattr(df, "settled_at", None)
    if place:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
