"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(df: DataFrame, keep: list[str], text: str, added: str, rows: Callable[[list[str]], Iterable[tuple]]) -> DataFrame:
    """Adds the columns of the DDL string ``added`` to the columns ``keep``, from ``rows`` over the texts of an Arrow batch.

    Kept columns pass through Arrow untouched, so null and very large ids
    stay what they are. A null text is the empty text. Only ``keep`` and
    ``text`` are read; other columns, whatever their names, are not.
    """
    new = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in keep] + list(new))
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    out = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(rows(batch.column(n).to_pylist()))
            columns = list(zip(*got)) if got else [()] * len(new)
            made = [pa.array(c, type=out.field(n + i).type) for i, c in enumerate(columns)]
            kept = [batch.column(i).cast(out.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays(kept + made, schema=out)

    return source.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir.

    Without that setting one under the warehouse is used on a local master; a
    cluster must name it, as an executor's own disk is lost with it.
    """
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not re.fullmatch(r"local(\[[^-].*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        place = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    return place


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Of any table fewer than so many keys can hold more than one in so many of its rows.
HEAVY = 1_000
PARTS = 64


def deal(left: DataFrame, right: DataFrame, key: str, copies: str, spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column ``__part``, for a join on ``key`` and it: keys that hold more than 1 in HEAVY of the rows of ``left`` are dealt to PARTS parts by ``spread``.

    ``right`` counts the rows of ``left`` in column ``copies``, so the
    heavy keys are fewer than HEAVY and may be broadcast.
    """
    total = right.agg(F.sum(copies)).first()[0] or 0
    heavy = right.where(F.col(copies) > max(total // HEAVY, 1)).select(F.col(key).alias("__heavy")).distinct()
    hot = F.col("__heavy").isNotNull()
    a = left.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left").withColumn("__part", F.when(hot, F.pmod(spread, F.lit(PARTS)).cast("int")).otherwise(0)).drop("__heavy")
    parts = F.when(F.col(copies) > max(total // HEAVY, 1), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return a, right.withColumn("__part", F.explode(parts))
