"""Large rasters as tiles with margins, for operators that hold one image in a task, and drawing into rasters.

An operator whose window reaches at most ``margin`` pixels gives the same inner
pixels on tiles as on the whole image; at the image's own border a tile ends where
the image ends, so border rules hold there too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]


def tiled(px: DataFrame, side: int, margin: int) -> DataFrame:
    """Tiles as images: ``image_id`` becomes a struct of image, tile and place; pixels in margins belong to several tiles."""
    if margin < 0 or side <= margin:
        raise ValueError("a tile must be larger than its margin")
    place = lambda c: F.explode(F.expr(f"sequence(int(floor(({c} - {margin}) / {side})), int(floor(({c} + {margin}) / {side})))"))
    dims = px.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    d = px.join(dims, "image_id").withColumn("ty", place("y")).withColumn("tx", place("x"))
    d = d.where(f"ty >= 0 AND tx >= 0 AND ty * {side} <= _h AND tx * {side} <= _w")
    first = lambda t: F.greatest(F.col(t) * side - margin, F.lit(0))
    name = F.struct(F.col("image_id").alias("image"), "ty", "tx", first("ty").cast("int").alias("y0"), first("tx").cast("int").alias("x0"))
    return d.select(name.alias("image_id"), (F.col("y") - first("ty")).cast("int").alias("y"), (F.col("x") - first("tx")).cast("int").alias("x"), "v")


def untiled(px: DataFrame, side: int) -> DataFrame:
    """The images of tiles again: each pixel from the tile it is an inner pixel of."""
    d = px.select("image_id.*", (F.col("y") + F.col("image_id.y0")).alias("y"), (F.col("x") + F.col("image_id.x0")).alias("x"), "v")
    return d.where(f"floor(y / {side}) = ty AND floor(x / {side}) = tx").select(F.col("image").alias("image_id"), "y", "x", "v")


def segment_pixels(segments: DataFrame) -> DataFrame:
    """Pixels of segments ``image_id, x1, y1, x2, y2`` (integers): one for each step along the longer axis, rounded half up."""
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    d = segments.withColumn("_n", n).withColumn("_k", F.explode(F.expr("sequence(0, int(_n))")))
    at = lambda a, b: (F.col(a) + F.when(F.col("_n") > 0, F.floor((2 * (F.col(b) - F.col(a)) * F.col("_k") + F.col("_n")) / (2 * F.col("_n")))).otherwise(0)).cast("int")
    return d.select("image_id", at("y1", "y2").alias("y"), at("x1", "x2").alias("x")).distinct()


def circle_pixels(circles: DataFrame) -> DataFrame:
    """Pixels of circles ``image_id, row, col, radius``: those whose distance from the centre rounds to the radius."""
    reach = F.expr("sequence(int(floor(-radius)) - 1, int(ceil(radius)) + 1)")
    d = circles.withColumn("_a", F.explode(reach)).withColumn("_b", F.explode(reach))
    d = d.withColumn("y", F.floor(F.col("row") + 0.5) + F.col("_a")).withColumn("x", F.floor(F.col("col") + 0.5) + F.col("_b"))
    away = F.sqrt((F.col("y") - F.col("row")) * (F.col("y") - F.col("row")) + (F.col("x") - F.col("col")) * (F.col("x") - F.col("col")))
    return d.where((away >= F.col("radius") - 0.5) & (away < F.col("radius") + 0.5)).select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()


def painted(px: DataFrame, marks: DataFrame, value: int | Column) -> DataFrame:
    """The image with the pixels of a region set to a value; marks outside the image are left out."""
    value = F.lit(value) if isinstance(value, int) else value
    return px.join(marks.select(*KEY).distinct().withColumn("_on", F.lit(True)), KEY, "left").select(*KEY, F.when(F.col("_on"), value).otherwise(F.col("v")).alias("v"))
