"""Rasters, signals, point sets, colours and contours derived from the driver's tables.

``pixels(image_id, y, x, v)`` is the carrier of all image operators; rows of one
image are independent of every other image, so all operators partition by image
(and row, where they are separable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

SIDE = 64


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors make an image; a component in [-0.5, 0.5] is a grey value."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.5) * 255))).cast("int")
    return e.select(F.floor(F.col("vec_id") / SIDE).alias("image_id"), (F.col("vec_id") % SIDE).cast("int").alias("y"), "x", v.alias("v"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey-value profile for each user: values in the order of time."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.select("user_id", i.alias("i"), F.col("value").cast("double").alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sets for fits: one for each supplier."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of line items."""
    c = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e))).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c(F.col("l_quantity") * 5).alias("r"), c(F.round(F.col("l_discount") * 100) * 25).alias("g"), c(F.round(F.col("l_tax") * 100) * 31).alias("b"))


def contour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon for each customer: prices in the order of keys, on integer coordinates."""
    o = table(spark, sf_dir, "orders")
    i = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1
    return o.select(F.col("o_custkey").alias("contour_id"), i.alias("i"), F.floor(F.col("o_totalprice") / 100).alias("x"), (F.col("o_orderkey") % 1000).alias("y"))


#: The same views for the SQL side.
SQL = """
p AS (
  SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
    CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 0.5::DOUBLE) * 255))) AS INTEGER) AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
), dims AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM p GROUP BY image_id),
prof AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(value AS DOUBLE) AS v FROM events),
pts AS (SELECT l_suppkey AS case_id, l_quantity AS x, l_extendedprice AS y FROM lineitem),
rgb AS (SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(255, floor(l_quantity * 5))) AS INTEGER) AS r,
  CAST(greatest(0, least(255, round(l_discount * 100) * 25)) AS INTEGER) AS g, CAST(greatest(0, least(255, round(l_tax * 100) * 31)) AS INTEGER) AS b FROM lineitem),
k AS (SELECT o_custkey AS contour_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(floor(o_totalprice / 100) AS BIGINT) AS x, o_orderkey % 1000 AS y FROM orders)
"""
