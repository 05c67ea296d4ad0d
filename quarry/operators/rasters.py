"""Resizing of rasters kept as rows, and the size that a patch model wants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def patch_size(height: Column, width: Column, short_side: int = 518, patch: int = 14) -> tuple[Column, Column]:
    """Height and width scaled so that the shorter is short_side, each cut down to a multiple of the patch."""
    scale = short_side / F.least(height, width).cast("double")
    fit = lambda side: (F.floor(F.round(side * scale) / patch) * patch).cast("int")
    return fit(height), fit(width)


def _weights(spark: SparkSession, source: int, target: int, at: str, to: str) -> DataFrame:
    """(to, at, w): the places of the source that each place of the target is made of."""
    place = F.greatest((F.col("id") + 0.5) * (source / target) - 0.5, F.lit(0.0))
    low = F.least(F.floor(place), F.lit(source - 1)).cast("int")
    part = F.least(place - low, F.lit(1.0))
    both = F.array(F.struct(low.alias("at"), (1 - part).alias("w")), F.struct(F.least(low + 1, F.lit(source - 1)).alias("at"), part.alias("w")))
    rows = spark.range(target).select(F.col("id").cast("int").alias(to), F.explode(both).alias("e"))
    return rows.groupBy(to, F.col("e.at").alias(at)).agg(F.sum("e.w").alias(f"w_{at}")).filter(F.col(f"w_{at}") > 0)


def bilinear(raster: DataFrame, by: list[str], size: tuple[int, int], target: tuple[int, int], value: str = "score") -> DataFrame:
    """by, yy, xx, value: the raster stretched from size to target (height, width), pixel centres kept in place. Two joins
    with weights of one row or column each, which are as small as the target's sides."""
    spark = raster.sparkSession
    wide = raster.join(F.broadcast(_weights(spark, size[1], target[1], "x", "xx")), "x").groupBy(*by, "y", "xx").agg(F.sum(F.col(value) * F.col("w_x")).alias(value))
    return wide.join(F.broadcast(_weights(spark, size[0], target[0], "y", "yy")), "y").groupBy(*by, "yy", "xx").agg(F.sum(F.col(value) * F.col("w_y")).alias(value))
