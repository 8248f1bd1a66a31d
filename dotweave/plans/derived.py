"""Point clouds derived from the star-schema tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS = 3.75
WIDE = 7.5

SPOTS = """
base AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS image_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS spot_id,
         l_extendedprice * 0.001 AS x, l_quantity * 1.0 AS y, l_discount * 100 AS z, l_extendedprice AS px, l_returnflag AS condition, p_brand AS gene, substr(p_brand, 7, 1) AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey),
tiled AS (SELECT *, CAST(floor(x / 15) AS BIGINT) AS i, CAST(floor(y / 12.5) AS BIGINT) AS j FROM base),
spots AS (
  SELECT image_id, spot_id, x, y, z, px, condition, gene, label, 1 + i + 8 * j AS tile,
         CASE WHEN i <= 6 AND j <= 3 AND sqrt((x - (15 * i + 7.5)) * (x - (15 * i + 7.5)) + (y - (12.5 * j + 6.25)) * (y - (12.5 * j + 6.25))) <= 2.5 THEN 1 + i + 8 * j ELSE 0 END AS prior
  FROM tiled),
centroids AS (SELECT image_id, 1 + i + 8 * j AS cell, CAST(15 * i + 7.5 AS DOUBLE) AS x, CAST(12.5 * j + 6.25 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM (SELECT DISTINCT image_id FROM base), range(7) AS u(i), range(4) AS v(j)),
mask AS (
  SELECT image_id, CAST(label % 3 AS INTEGER) AS z, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, label FROM (
    SELECT xx, yy, 1 + xx // 15 + 8 * CAST(floor(yy / 12.5) AS BIGINT) AS label FROM range(105) AS a(xx), range(50) AS b(yy)
    WHERE sqrt((xx - (15 * (xx // 15) + 7.5)) * (xx - (15 * (xx // 15) + 7.5)) + (yy - (12.5 * floor(yy / 12.5) + 6.25)) * (yy - (12.5 * floor(yy / 12.5) + 6.25))) <= 2.5),
  (SELECT DISTINCT image_id FROM base))
"""


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, spot_id, x, y, z, px, condition, gene, label, tile, prior): ids count within an image, so no global sort is needed."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    order = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("image_id"),
        (F.expr(f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {order})").cast("bigint") - 1).alias("spot_id"),
        (F.col("l_extendedprice") * 0.001).alias("x"), (F.col("l_quantity") * 1.0).alias("y"), (F.col("l_discount") * 100).alias("z"),
        F.col("l_extendedprice").alias("px"), F.col("l_returnflag").alias("condition"), F.col("p_brand").alias("gene"), F.substring("p_brand", 7, 1).alias("label"),
    )
    rows = rows.withColumns({"i": F.floor(F.col("x") / 15), "j": F.floor(F.col("y") / 12.5)})
    dx, dy = F.col("x") - (15 * F.col("i") + 7.5), F.col("y") - (12.5 * F.col("j") + 6.25)
    tile = 1 + F.col("i") + 8 * F.col("j")
    inside = (F.col("i") <= 6) & (F.col("j") <= 3) & (F.sqrt(dx * dx + dy * dy) <= 2.5)
    return rows.withColumns({"tile": tile, "prior": F.when(inside, tile).otherwise(F.lit(0).cast("bigint"))}).drop("i", "j")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that have a spot with a known part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_suppkey").cast("string").alias("image_id")).distinct()


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 cells an image."""
    cells = images(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return cells.select("image_id", (1 + F.col("i") + 8 * F.col("j")).cast("bigint").alias("cell"), (15 * F.col("i") + 7.5).alias("x"), (12.5 * F.col("j") + 6.25).alias("y"), F.lit(0.0).alias("z"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nuclei as pixels of a raster."""
    grid = spark.range(105 * 50).select((F.col("id") % 105).alias("x"), F.floor(F.col("id") / 105).alias("y")).withColumns({"i": F.floor(F.col("x") / 15), "j": F.floor(F.col("y") / 12.5)})
    dx, dy = F.col("x") - (15 * F.col("i") + 7.5), F.col("y") - (12.5 * F.col("j") + 6.25)
    label = 1 + F.col("i") + 8 * F.col("j")
    pixels = grid.where(F.sqrt(dx * dx + dy * dy) <= 2.5).select((label % 3).cast("int").alias("z"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), label.alias("label"))
    return images(spark, sf_dir).crossJoin(F.broadcast(pixels))  # one raster of some hundred pixels for each image


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, cluster) of the embeddings."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("cluster"))
