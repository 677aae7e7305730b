"""Incremental training of the variation model on a stream of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(px: DataFrame) -> DataFrame:
    """Mergeable state of each pixel, ``n, s, ss``; on a stream, an update-mode aggregation."""
    return px.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def prepare(state: DataFrame, least: float = 0.0) -> DataFrame:
    """Mean and variance (at least ``least``) of a state."""
    m = F.col("s") / F.col("n")
    return state.select("y", "x", m.alias("mean"), F.greatest(F.col("ss") / F.col("n") - m * m, F.lit(least)).alias("var"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two states as one."""
    return a.unionByName(b).groupBy("y", "x").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
