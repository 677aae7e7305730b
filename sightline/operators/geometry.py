"""Profiles, edges, fits, contours, Hough lines and colours."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def along():
    """The order of a profile."""
    return W.partitionBy("user_id").orderBy("i")


def derivative(p: DataFrame) -> DataFrame:
    """Central differences of a profile, one-sided at its ends."""
    before, after = F.coalesce(F.lag("v").over(along()), F.col("v")), F.coalesce(F.lead("v").over(along()), F.col("v"))
    return p.select("user_id", "i", ((after - before) / 2).alias("g"))


def edges(p: DataFrame, least: float) -> DataFrame:
    """Peaks of |derivative| of at least ``least``, with sub-sample positions (parabola, at most half a step)."""
    d = derivative(p).withColumn("a", F.abs("g")).withColumn("l", F.coalesce(F.lag(F.abs("g")).over(along()), F.lit(0.0))).withColumn("r", F.coalesce(F.lead(F.abs("g")).over(along()), F.lit(0.0)))
    d = d.where((F.col("a") >= least) & (F.col("a") >= F.col("l")) & (F.col("a") > F.col("r")))
    bend = F.col("l") - 2 * F.col("a") + F.col("r")
    off = F.when(bend == 0, 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("l") - F.col("r")) / bend)))
    return d.select("user_id", "i", (F.col("i") + off).alias("position"), F.col("a").alias("amplitude"), F.when(F.col("g") > 0, "rising").otherwise("falling").alias("polarity"))


def pairs(e: DataFrame) -> DataFrame:
    """Each rising edge with the next edge if that is falling: position, width, gap to the next pair."""
    w = W.partitionBy("user_id").orderBy("i")
    d = e.withColumn("p2", F.lead("position").over(w)).withColumn("s2", F.lead("polarity").over(w)).where("polarity = 'rising' AND s2 = 'falling'")
    return d.select("user_id", "i", ((F.col("position") + F.col("p2")) / 2).alias("centre"), (F.col("p2") - F.col("position")).alias("width"), (F.lead("position").over(w) - F.col("p2")).alias("gap"))


def fit_line(p: DataFrame) -> DataFrame:
    """Total least squares: the main axis of each point set through its centroid."""
    g = p.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    return g.where("n >= 2").select("case_id", "n", "mx", "my", (0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))).alias("angle"))


def fit_circle(p: DataFrame) -> DataFrame:
    """Algebraic circle fit about the centroid, solved in closed form."""
    w = W.partitionBy("case_id")
    d = p.withColumn("mx", F.avg("x").over(w)).withColumn("my", F.avg("y").over(w)).withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    s = lambda e: F.sum(F.expr(e))
    g = d.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), s("u*u").alias("uu"), s("v*v").alias("vv"), s("u*v").alias("uv"), s("u*u*u + u*v*v").alias("p"), s("v*v*v + v*u*u").alias("q"))
    g = g.withColumn("det", F.expr("uu * vv - uv * uv")).where("n >= 3 AND det <> 0")
    g = g.withColumn("a", F.expr("(p * vv - q * uv) / (2 * det)")).withColumn("b", F.expr("(q * uu - p * uv) / (2 * det)"))
    return g.select("case_id", (F.col("mx") + F.col("a")).alias("cx"), (F.col("my") + F.col("b")).alias("cy"), F.sqrt(F.expr("a * a + b * b + (uu + vv) / n")).alias("radius"))


def mad_inliers(p: DataFrame, factor: float = 2.5) -> DataFrame:
    """Points within median + factor * 1.4826 * MAD of their set's median y."""
    m = p.groupBy("case_id").agg(F.median("y").alias("m"))
    d = p.join(m, "case_id").withColumn("d", F.abs(F.col("y") - F.col("m")))
    s = d.groupBy("case_id").agg(F.median("d").alias("mad"))
    return d.join(s, "case_id").where(F.col("d") <= factor * 1.4826 * F.col("mad")).select("case_id", "x", "y")


def contour_features(k: DataFrame) -> DataFrame:
    """Points, closed area (shoelace; 0 below three points), open length and box of each contour."""
    w = W.partitionBy("contour_id").orderBy("i")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = k.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("fx", F.first("x").over(whole)).withColumn("fy", F.first("y").over(whole))
    cross = F.col("x") * F.coalesce("ny", "fy") - F.coalesce("nx", "fx") * F.col("y")
    step = F.coalesce(F.sqrt(((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))).cast("double")), F.lit(0.0))
    g = d.groupBy("contour_id").agg(F.count(F.lit(1)).alias("n"), F.sum(cross).alias("s"), F.sum(step).alias("length"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return g.select("contour_id", "n", F.when(F.col("n") >= 3, F.abs("s") / 2).otherwise(0.0).alias("area"), "length", "x0", "y0", "x1", "y1")


def turning(k: DataFrame) -> DataFrame:
    """Twice the signed area of each inner point's triangle: the sign of its turn."""
    w = W.partitionBy("contour_id").orderBy("i")
    d = k.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    return d.where("px IS NOT NULL AND nx IS NOT NULL").select("contour_id", "i", F.expr("(x - px) * (ny - y) - (y - py) * (nx - x)").alias("turn"))


def hough(region: DataFrame, angles: int) -> DataFrame:
    """Votes of region pixels for lines x cos t + y sin t = rho, t in steps of pi / angles."""
    a = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(round(math.cos(i * math.pi / angles), 12)).alias("c"), F.lit(round(math.sin(i * math.pi / angles), 12)).alias("s")) for i in range(angles)]))
    d = region.select("image_id", "y", "x", a.alias("a"))
    return d.groupBy("image_id", F.col("a.t").alias("t"), F.floor(F.col("x") * F.col("a.c") + F.col("y") * F.col("a.s") + 0.5).alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def suppress(found: DataFrame, by: str, distance: int) -> DataFrame:
    """Positions that no better one (ties: smaller row, column) within a square distance beats."""
    o = found.select(F.col("image_id"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.col(by).alias("o"))
    cell = lambda c: F.floor(F.col(c) / (distance + 1))
    a = found.withColumn("cy", cell("y")).withColumn("cx", cell("x"))
    near = F.explode(F.array(*[F.struct((cell("oy") + i).alias("cy"), (cell("ox") + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    o = o.withColumn("q", near).select("image_id", "oy", "ox", "o", "q.cy", "q.cx")
    better = (F.abs(F.col("oy") - F.col("y")) <= distance) & (F.abs(F.col("ox") - F.col("x")) <= distance) & ((F.col("o") > F.col(by)) | ((F.col("o") == F.col(by)) & ((F.col("oy") < F.col("y")) | ((F.col("oy") == F.col("y")) & (F.col("ox") < F.col("x"))))))
    same = (a["image_id"] == o["image_id"]) & (a["cy"] == o["cy"]) & (a["cx"] == o["cx"])
    return a.join(o, same & better, "left_anti").drop("cy", "cx")


GREY = {
    "luminosity": lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b,
    "bt709": lambda r, g, b: 0.2126 * r + 0.7152 * g + 0.0722 * b,
    "average": lambda r, g, b: (r + g + b) / 3,
    "lightness": lambda r, g, b: (F.greatest(r, g, b) + F.least(r, g, b)) / 2,
    "max": lambda r, g, b: F.greatest(r, g, b),
    "min": lambda r, g, b: F.least(r, g, b),
}


def grey(c: DataFrame, method: str = "luminosity") -> DataFrame:
    """Grey values of colours, truncated."""
    if method not in GREY:
        raise ValueError(f"unknown method {method!r}")
    return c.withColumn("v", F.floor(GREY[method](F.col("r"), F.col("g"), F.col("b"))).cast("int"))


def grey_fast(c: DataFrame) -> DataFrame:
    """(77 r + 150 g + 29 b) >> 8."""
    return c.withColumn("v", F.shiftright(77 * F.col("r") + 150 * F.col("g") + 29 * F.col("b"), 8))


def ycrcb(c: DataFrame) -> DataFrame:
    """BT.601 luma and colour differences, clamped and truncated."""
    cut = lambda e: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), e))).cast("int")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return c.select("l_orderkey", "l_linenumber", cut(0.299 * r + 0.587 * g + 0.114 * b).alias("yy"), cut(128 + 0.5 * r - 0.418688 * g - 0.081312 * b).alias("cr"), cut(128 - 0.168736 * r - 0.331264 * g + 0.5 * b).alias("cb"))


def hsv(c: DataFrame) -> DataFrame:
    """Hue in degrees, saturation and value in 0..1."""
    r, g, b = (F.col(x).cast("double") for x in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, 60 * (g - b) / d + F.when(g < b, 360.0).otherwise(0.0)).when(hi == g, 60 * (b - r) / d + 120).otherwise(60 * (r - g) / d + 240)
    return c.select("l_orderkey", "l_linenumber", h.alias("h"), F.when(hi == 0, 0.0).otherwise(d / hi).alias("s"), (hi / 255).alias("val"))


def gaussian(sigma: float) -> list[float]:
    """A normalised kernel of radius ceil(3 sigma)."""
    r = math.ceil(3 * sigma)
    k = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / reduce(lambda a, b: a + b, k) for x in k]
