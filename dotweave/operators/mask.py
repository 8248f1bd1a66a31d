"""Segmentation masks as long tables (image_id, z, y, x, label), background left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel(coordinate: Column, scale: float = 1.0) -> Column:
    """Whole pixel of a coordinate: cut off toward zero."""
    return (coordinate / F.lit(float(scale))).cast("bigint")


def to_pixels(spots: DataFrame, scale: dict[str, float]) -> DataFrame:
    return spots.withColumns({d: pixel(F.col(d), s) for d, s in scale.items() if d in spots.columns})


def add_prior(spots: DataFrame, mask: DataFrame, three_d: bool = False, prior: str = "prior", overwrite: bool = True) -> DataFrame:
    """Spots (pixel coordinates) plus the label of their pixel, 0 on background and outside."""
    if prior in spots.columns and not overwrite:
        raise ValueError(f"column {prior} exists")
    dims = ["z", "y", "x"] if three_d else ["y", "x"]
    place = mask.select("image_id", *[F.col(d).cast("bigint").alias(f"m{d}") for d in dims], F.col("label").alias("m"))
    keyed = spots.drop(prior).withColumns({f"m{d}": pixel(F.col(d)) for d in dims})
    out = keyed.join(place, ["image_id", *[f"m{d}" for d in dims]], "left")
    return out.drop(*[f"m{d}" for d in dims]).withColumn(prior, F.coalesce("m", F.lit(0)).cast("bigint")).drop("m")


def label_centroids(mask: DataFrame) -> DataFrame:
    """(image_id, cell, z, y, x): mean pixel of each label; z is 0 in a flat mask."""
    z = F.avg("z") if "z" in mask.columns else F.lit(0.0)
    return mask.where("label <> 0").groupBy("image_id", F.col("label").alias("cell")).agg(z.alias("z"), F.avg("y").alias("y"), F.avg("x").alias("x"))


def max_projection(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id", "y", "x").agg(F.max("label").alias("label"))


def scatter_groups(assigned: DataFrame, key: str = "cell_index_pred", with_outliers: bool = True) -> DataFrame:
    """The points to plot by label."""
    kept = assigned if with_outliers else assigned.where(F.col(key) != 0)
    return kept.select("image_id", F.col(key).alias("group"), "x", "y")
