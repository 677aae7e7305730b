"""Further measures of rasters, regions, profiles, point sets, colours and contours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import raster as r
from . import regions as rg


def roberts(px: DataFrame) -> DataFrame:
    """Sum of both diagonal differences of each 2 x 2 block, clamped; 0 in the last row and column."""
    d = px.withColumn("a", F.lead("v").over(r.row_()))
    d = d.withColumn("b", F.lead("v").over(r.col_())).withColumn("c", F.lead("a").over(r.col_()))
    return d.select(*r.KEY, F.when(F.col("c").isNull(), 0).otherwise(r.clamp(F.abs(F.col("v") - F.col("c")) + F.abs(F.col("a") - F.col("b")))).alias("v"))


def triangle(px: DataFrame) -> DataFrame:
    """The bin farthest from the line between the histogram's peak and its farther end (ties: smallest), and its centre."""
    h = r.histogram(px)
    peak = h.groupBy("image_id").agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("u"))).alias("x1"), F.max("n").alias("y1"))
    peak = peak.withColumn("x2", F.when(F.col("x1") < 128, 255).otherwise(0))
    ends = h.select("image_id", F.col("v").alias("x2"), F.col("n").alias("y2"))
    peak = peak.join(ends, ["image_id", "x2"], "left").fillna(0, ["y2"])
    bins = peak.withColumn("v", F.explode(F.sequence(F.least("x1", "x2"), F.greatest("x1", "x2")))).join(h, ["image_id", "v"], "left").fillna(0, ["n"])
    bins = bins.withColumn("far", F.abs(F.expr("(y2 - y1) * v - (x2 - x1) * n + x2 * y1 - y2 * x1")))
    best = bins.groupBy("image_id").agg(F.max_by("v", F.struct("far", (-F.col("v")).alias("u"))).alias("v"))
    return best.select("image_id", "v", ((F.col("v") + 0.5) * 255 / 256).alias("threshold"))


def quarter_turn(px: DataFrame) -> DataFrame:
    """Turned by 90 degrees clockwise."""
    last = F.max("y").over(W.partitionBy("image_id"))
    return px.select("image_id", F.col("x").alias("y"), (last - F.col("y")).alias("x"), "v")


def grey_centre(px: DataFrame) -> DataFrame:
    """Grey sum and grey-weighted centroid; images without grey have no row."""
    g = px.groupBy("image_id").agg(F.sum("v").alias("volume"), F.sum(F.col("y") * F.col("v")).alias("sy"), F.sum(F.col("x") * F.col("v")).alias("sx"))
    return g.where("volume > 0").select("image_id", "volume", (F.col("sy") / F.col("volume")).alias("row"), (F.col("sx") / F.col("volume")).alias("col"))


def hysteresis(px: DataFrame, low: int, high: int) -> DataFrame:
    """Runs of the components of v >= low that hold a pixel with v >= high."""
    lab = rg.connection(rg.runs(r.in_range(px, low, 255)))
    strong = px.where(F.col("v") >= high).select("image_id", "y", "x")
    kept = lab.join(strong, ["image_id", "y"]).where("x >= cb AND x < ce").select("image_id", "region_id").distinct()
    return lab.join(kept, ["image_id", "region_id"], "left_semi").select(*rg.RUN, "region_id")


def off_border(f: DataFrame, px: DataFrame) -> DataFrame:
    """Regions that touch no border of their image."""
    dims = px.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    return f.join(dims, "image_id").where("y0 > 0 AND x0 > 0 AND y1 < _h AND x1 < _w").drop("_h", "_w")


def usual(f: DataFrame, feature: str, k: float) -> DataFrame:
    """Regions whose feature lies within k population deviations of their image's mean."""
    w = W.partitionBy("image_id")
    d = f.withColumn("_m", F.avg(feature).over(w)).withColumn("_s", F.stddev_pop(feature).over(w))
    return d.where(F.abs(F.col(feature) - F.col("_m")) <= k * F.col("_s")).drop("_m", "_s")


def roundness(labelled: DataFrame) -> DataFrame:
    """Circularity 4 pi A / P^2 and compactness P^2 / A, with P boundary pixels."""
    d = rg.features(labelled).select("image_id", "region_id", "area").join(rg.perimeter(labelled), ["image_id", "region_id"])
    p2 = F.col("perimeter") * F.col("perimeter")
    return d.select("image_id", "region_id", (4 * F.pi() * F.col("area") / p2).alias("circularity"), (p2 / F.col("area")).alias("compactness"))


def inertia(f: DataFrame) -> DataFrame:
    """Greatest and least moment of inertia from area and mean central moments."""
    half, det = (F.col("m20") + F.col("m02")) / 2, F.col("m20") * F.col("m02") - F.col("m11") * F.col("m11")
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - det))
    return f.select("image_id", "region_id", ((half + root) * F.col("area")).alias("ia"), ((half - root) * F.col("area")).alias("ib"))


def chosen_edges(e: DataFrame, which: str) -> DataFrame:
    """One edge of each profile: first, last or strongest (the first of equals)."""
    orders = {"first": ["i"], "last": [F.desc("i")], "strongest": [F.desc("amplitude"), "i"]}
    if which not in orders:
        raise ValueError(f"unknown selection {which!r}")
    return e.withColumn("_n", F.row_number().over(W.partitionBy("user_id").orderBy(*orders[which]))).where("_n = 1").drop("_n")


def fuzzy_edges(p: DataFrame, e: DataFrame, least: float, low: float = 0.3, high: float = 0.8) -> DataFrame:
    """Edges of at least ``low`` times the threshold and the profile's contrast, scored against the strongest."""
    c = p.groupBy("user_id").agg((F.max("v") - F.min("v")).alias("_c"))
    d = e.join(c, "user_id").where(F.col("amplitude") >= low * F.greatest(F.lit(float(least)), F.col("_c")))
    q = F.col("amplitude") / F.max("amplitude").over(W.partitionBy("user_id"))
    return d.withColumn("score", F.when(q < low, 0.0).when(q >= high, 1.0).otherwise((q - low) / (high - low))).drop("_c")


def robust_weights(p: DataFrame) -> DataFrame:
    """Huber and Tukey weights of y about its set's median, in units of MAD / 0.6745 (weight 1 where that is 0)."""
    m = p.groupBy("case_id").agg(F.median("y").alias("_m"))
    d = p.join(m, "case_id").withColumn("_d", F.abs(F.col("y") - F.col("_m")))
    s = d.groupBy("case_id").agg((F.median("_d") / 0.6745).alias("_s"))
    d = d.join(s, "case_id").withColumn("_r", F.when(F.col("_s") > 0, F.col("_d") / F.col("_s")).otherwise(0.0))
    t = 1 - F.col("_r") / 4.685 * (F.col("_r") / 4.685)
    return d.select("case_id", "x", "y", F.when(F.col("_r") <= 1.345, 1.0).otherwise(1.345 / F.col("_r")).alias("huber"), F.when(F.col("_r") > 4.685, 0.0).otherwise(t * t).alias("tukey"))


def mapped(p: DataFrame, m: tuple[float, ...]) -> DataFrame:
    """Points under a 3 x 3 matrix in rows (affine where its last row is 0, 0, 1)."""
    row = lambda i: F.col("x") * m[i] + F.col("y") * m[i + 1] + m[i + 2]
    return p.select("case_id", "x", "y", (row(0) / row(6)).alias("u"), (row(3) / row(6)).alias("w"))


def polar(p: DataFrame, cx: float, cy: float) -> DataFrame:
    """Distance and angle about a centre."""
    u, w = F.col("x") - cx, F.col("y") - cy
    return p.select("case_id", "x", "y", F.sqrt(u * u + w * w).alias("radius"), F.atan2(w, u).alias("angle"))


def distorted(p: DataFrame, k: tuple[float, float, float], t: tuple[float, float]) -> DataFrame:
    """Radial and tangential lens distortion of normalised points."""
    x, y = F.col("x"), F.col("y")
    r2 = x * x + y * y
    radial = 1 + k[0] * r2 + k[1] * (r2 * r2) + k[2] * (r2 * r2 * r2)
    return p.select("case_id", "x", "y", (x * radial + 2 * t[0] * x * y + t[1] * (r2 + 2 * x * x)).alias("u"), (y * radial + t[0] * (r2 + 2 * y * y) + 2 * t[1] * x * y).alias("w"))


def hsl(c: DataFrame) -> DataFrame:
    """Hue in degrees, saturation and lightness in 0..1."""
    red, green, blue = (F.col(x) / 255.0 for x in "rgb")
    hi, lo = F.greatest(red, green, blue), F.least(red, green, blue)
    d, light = hi - lo, (hi + lo) / 2
    hue = F.when(d == 0, 0.0).when(hi == red, 60 * F.pmod((green - blue) / d + 6, F.lit(6.0))).when(hi == green, 60 * ((blue - red) / d + 2)).otherwise(60 * ((red - green) / d + 4))
    sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
    return c.select("l_orderkey", "l_linenumber", hue.alias("h"), sat.alias("s"), light.alias("l"))


def assigned(c: DataFrame, centres: list[tuple[int, int, int]]) -> DataFrame:
    """The nearest of a few fixed centres (ties: the first)."""
    far = [reduce(lambda a, b: a + b, [(F.col(n) - q) * (F.col(n) - q) for n, q in zip("rgb", k, strict=True)]) for k in centres]
    best = F.array_min(F.array(*[F.struct(f.alias("d"), F.lit(i).alias("i")) for i, f in enumerate(far)]))
    return c.withColumn("cluster", best["i"])


def _edges_of(k: DataFrame) -> DataFrame:
    w = W.partitionBy("contour_id").orderBy("i")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return k.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("ny", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))


def contains(k: DataFrame, x: float, y: float) -> DataFrame:
    """Whether a point lies in each closed contour: an odd number of edges crosses the ray to its right."""
    cross = ((F.col("y") > y) != (F.col("ny") > y)) & (F.lit(x) < (F.col("nx") - F.col("x")) * (y - F.col("y")) / (F.col("ny") - F.col("y")) + F.col("x"))
    return _edges_of(k).groupBy("contour_id").agg((F.count_if(F.when(F.col("y") == F.col("ny"), False).otherwise(cross)) % 2 == 1).alias("inside"))


def vertex_distance(k: DataFrame, x: float, y: float) -> DataFrame:
    """Distance from a point to the nearest vertex of each contour."""
    return k.groupBy("contour_id").agg(F.sqrt(F.min((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))).alias("distance"))


def smoothed(k: DataFrame) -> DataFrame:
    """Each point the mean of itself and its neighbours (fewer at the ends)."""
    w = W.partitionBy("contour_id").orderBy("i").rowsBetween(-1, 1)
    return k.select("contour_id", "i", F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"))
