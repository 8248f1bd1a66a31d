"""New images as they arrive: each micro-batch of spot files goes through a step of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dotweave.sources.spots import STEM, numbered


def watch(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, gene: str = "gene", files_per_batch: int = 100, once: bool = True) -> StreamingQuery:
    """Runs ``step`` over the spots of the image files that are new in ``folder`` and writes its result below ``out``.

    A file is one image and arrives whole; its spots are numbered in the order of the file, as ``read_spots`` does. The batch's number names its folder and
    a repeated batch replaces its own, so a restart leaves no image twice.
    """
    files = spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_batch).schema(schema).csv(folder)
    spots = files.select(F.regexp_extract(F.col("_metadata.file_name"), STEM, 1).alias("image_id"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("__split"), "*").withColumnRenamed(gene, "gene")

    def batch(rows: DataFrame, number: int) -> None:
        step(numbered(rows.withColumn("__at", F.monotonically_increasing_id()))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
