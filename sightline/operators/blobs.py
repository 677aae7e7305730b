"""Shape features beyond the second moments, orders of regions and contours, structuring elements of any form.

Images are independent of each other; regions are labelled runs. Empty tables
give empty results; rows with nulls in their keys take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import partitions, saved
from . import levels as lv
from . import raster as r
from . import regions as rg

REGION = ["image_id", "region_id"]


def central_moments(labelled: DataFrame) -> DataFrame:
    """Area and normalised central moments n20 to n03 of each region."""
    m = lv.raw_moments(labelled).withColumn("a", F.col("m00").cast("double"))
    cx, cy = F.col("m10") / F.col("a"), F.col("m01") / F.col("a")
    m = m.withColumn("cx", cx).withColumn("cy", cy)
    mu = {
        "20": "m20 - cx * m10", "02": "m02 - cy * m01", "11": "m11 - cx * m01",
        "30": "m30 - 3 * cx * m20 + 2 * cx * cx * m10", "03": "m03 - 3 * cy * m02 + 2 * cy * cy * m01",
        "21": "m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01", "12": "m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10",
    }
    scale = lambda k: F.pow(F.col("a"), F.lit(2.0 if int(k[0]) + int(k[1]) == 2 else 2.5))
    return m.select(*REGION, F.col("m00").alias("area"), *[(F.expr(e) / scale(k)).alias(f"n{k}") for k, e in mu.items()])


def hu_moments(labelled: DataFrame) -> DataFrame:
    """The seven invariants of Hu."""
    d = central_moments(labelled).withColumns({"_p": F.expr("n30 + n12"), "_q": F.expr("n21 + n03"), "_s": F.expr("n30 - 3 * n12"), "_t": F.expr("3 * n21 - n03"), "_d": F.expr("n20 - n02")})
    hu = ["n20 + n02", "_d * _d + 4 * n11 * n11", "_s * _s + _t * _t", "_p * _p + _q * _q",
          "_s * _p * (_p * _p - 3 * _q * _q) + _t * _q * (3 * _p * _p - _q * _q)",
          "_d * (_p * _p - _q * _q) + 4 * n11 * _p * _q",
          "_t * _p * (_p * _p - 3 * _q * _q) - _s * _q * (3 * _p * _p - _q * _q)"]
    return d.select(*REGION, *[F.expr(e).alias(f"hu{i + 1}") for i, e in enumerate(hu)])


def elongation(f: DataFrame) -> DataFrame:
    """Eccentricity, elongation 1 - rb / ra, bulkiness pi ra rb / A and the structure factor of the equivalent ellipse (null for flat regions)."""
    e = lv.ellipse(f).join(f.select(*REGION, "area"), REGION)
    flat = lambda c: F.when(F.col("rb") > 0.001, c)
    bulk = F.pi() * F.col("ra") * F.col("rb") / F.col("area")
    return e.select(*REGION, flat(F.sqrt(1 - F.pow(F.col("rb") / F.col("ra"), F.lit(2.0)))).alias("eccentricity"), flat(1 - F.col("rb") / F.col("ra")).alias("elongation"), flat(bulk).alias("bulkiness"), flat(F.col("ra") / F.col("rb") * bulk - 1).alias("structure"))


def euler_number(region: DataFrame) -> DataFrame:
    """Components less holes of each image's region (8 neighbours), from counts of 2 x 2 cells."""
    cell = region.distinct().select("image_id", F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), F.lit(1 << (2 * a + b)).alias("bit")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    kind = cell.groupBy("image_id", "c.y", "c.x").agg(F.sum("c.bit").alias("bits"))
    # one pixel +1, three -1, two on a diagonal -2, each a quarter
    one, three, diagonal = F.col("bits").isin(1, 2, 4, 8), F.col("bits").isin(7, 11, 13, 14), F.col("bits").isin(6, 9)
    return kind.groupBy("image_id").agg(((F.count_if(one) - F.count_if(three) - 2 * F.count_if(diagonal)) / 4).cast("long").alias("euler"))


def select_shapes(f: DataFrame, bounds: dict[str, tuple[float, float]], every: bool = True) -> DataFrame:
    """Regions of which all features (or any) lie in their closed ranges."""
    if unknown := set(bounds) - set(f.columns):
        raise ValueError(f"unknown features {sorted(unknown)}")
    tests = [F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()]
    return f.where(reduce(lambda a, b: (a & b) if every else (a | b), tests))


def ordered(f: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Regions with their place (from 0) by a feature, or by "position" of their first pixel; ties by id."""
    if by != "position" and by not in f.columns:
        raise ValueError(f"unknown feature {by!r}")
    keys = [F.col("y0"), F.col("x0")] if by == "position" else [F.col(by)]
    keys = [k.desc() if descending else k.asc() for k in keys]
    return f.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy(*keys, "region_id")) - 1)


def ordered_contours(features: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Contours with their place (from 0) by a feature; ties by id. A sort by ranges, whose tasks' counts give the places."""
    if by not in features.columns:
        raise ValueError(f"unknown feature {by!r}")
    spark = features.sparkSession
    keys = [F.col(by).desc() if descending else F.col(by).asc(), F.col("contour_id")]
    d, _ = saved(features.repartitionByRange(partitions(spark), *keys).withColumn("_p", F.spark_partition_id()), "ordered")
    n = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a task
    before = n.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return d.withColumn("place", F.row_number().over(W.partitionBy("_p").orderBy(*keys)) - 1).join(before, "_p").withColumn("place", F.col("place") + F.col("_before")).drop("_p", "_before")


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contours of two sets, those of equal id joined end to end."""
    n = a.groupBy("contour_id").agg((F.max("i") + 1).alias("_n"))
    moved = b.join(n, "contour_id", "left").select("contour_id", (F.col("i") + F.coalesce("_n", F.lit(0))).alias("i"), "x", "y")
    return a.select("contour_id", "i", "x", "y").union(moved)


def dilate(region: DataFrame, element: list[tuple[int, int]]) -> DataFrame:
    """Pixels that a structuring element of (row, column) offsets reaches from the region."""
    at = F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in element]))
    return region.select("image_id", at.alias("q")).select("image_id", "q.y", "q.x").distinct()


def erode(region: DataFrame, element: list[tuple[int, int]]) -> DataFrame:
    """Pixels from which every offset of a structuring element stays in the region."""
    at = F.explode(F.array(*[F.struct((F.col("y") - a).alias("y"), (F.col("x") - b).alias("x")) for a, b in set(element)]))
    d = region.distinct().select("image_id", at.alias("q")).groupBy("image_id", "q.y", "q.x").count()
    return d.where(F.col("count") == len(set(element))).select(*r.KEY)


def grey_morphology(px: DataFrame, element: list[tuple[int, int]], dilation: bool) -> DataFrame:
    """Greatest or least value under a structuring element of (row, column) offsets; places outside the image do not count."""
    at = F.explode(F.array(*[F.struct((F.col("y") - a).alias("y"), (F.col("x") - b).alias("x")) for a, b in element]))
    d = px.select("image_id", "v", at.alias("q")).groupBy("image_id", "q.y", "q.x").agg((F.max if dilation else F.min)("v").alias("v"))
    return d.join(px.select(*r.KEY), r.KEY, "left_semi").select(*r.KEY, "v")


def hough_peaks(votes: DataFrame, angles: int, least: int, apart_t: int, apart_rho: int) -> DataFrame:
    """Lines with at least so many votes that no better one (ties: smaller angle, distance) within both distances beats; angles wrap with rho turned round."""
    d = votes.where(F.col("votes") >= least)
    wrapped = d.unionByName(d.select("image_id", (F.col("t") - angles).alias("t"), (-F.col("rho")).alias("rho"), "votes")).unionByName(d.select("image_id", (F.col("t") + angles).alias("t"), (-F.col("rho")).alias("rho"), "votes"))
    cells: Column = F.explode(F.array(*[F.struct((F.floor(F.col("ot") / (apart_t + 1)) + i).alias("ct"), (F.floor(F.col("orho") / (apart_rho + 1)) + j).alias("cr")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    o = wrapped.select("image_id", F.col("t").alias("ot"), F.col("rho").alias("orho"), F.col("votes").alias("ov"))
    o = o.withColumn("c", cells).select("image_id", "ot", "orho", "ov", "c.ct", "c.cr")
    a = d.withColumns({"ct": F.floor(F.col("t") / (apart_t + 1)), "cr": F.floor(F.col("rho") / (apart_rho + 1))})
    near = (F.abs(F.col("ot") - F.col("t")) <= apart_t) & (F.abs(F.col("orho") - F.col("rho")) <= apart_rho)
    better = (F.col("ov") > F.col("votes")) | ((F.col("ov") == F.col("votes")) & ((F.col("ot") < F.col("t")) | ((F.col("ot") == F.col("t")) & (F.col("orho") < F.col("rho")))))
    same = (a["image_id"] == o["image_id"]) & (a["ct"] == o["ct"]) & (a["cr"] == o["cr"])
    return a.join(o, same & near & better, "left_anti").select("image_id", "t", "rho", "votes")


def band_join(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of positions ``image_id, row, col, id`` of one image that differ by at most a tolerance each way, met in grid cells."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = a.withColumns({"_r": cell("row"), "_c": cell("col")})
    o = b.select("image_id", F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("id").alias("id2"))
    near = F.explode(F.array(*[F.struct((cell("row2") + i).alias("_r"), (cell("col2") + j).alias("_c")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    o = o.withColumn("q", near).select("image_id", "row2", "col2", "id2", "q._r", "q._c")
    d = left.join(o, ["image_id", "_r", "_c"])
    return d.where((F.abs(F.col("row") - F.col("row2")) <= tolerance) & (F.abs(F.col("col") - F.col("col2")) <= tolerance)).select("image_id", "id", "id2", (F.col("row2") - F.col("row")).alias("drow"), (F.col("col2") - F.col("col")).alias("dcol"))
