"""Segments, hulls and moments of contours, camera models, colour spaces and k-means.

A contour is ``contour_points(contour_id, i, x, y)``; windows and groups hold one
contour. Null coordinates take no part; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(k: DataFrame) -> DataFrame:
    """Each point with its follower; the last point of an open contour has none."""
    w = W.partitionBy("contour_id").orderBy("i")
    return k.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("nx IS NOT NULL")


def segment_measures(k: DataFrame, px: float, py: float) -> DataFrame:
    """Length, direction and distance to a point of each segment (a segment of no length is its point)."""
    d = segments(k).withColumns({"dx": F.expr("nx - x"), "dy": F.expr("ny - y")}).withColumn("ll", F.expr("dx * dx + dy * dy").cast("double"))
    d = d.withColumn("t", F.when(F.col("ll") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - F.col("x")) * F.col("dx") + (py - F.col("y")) * F.col("dy")) / F.col("ll")))).otherwise(0.0))
    ex, ey = F.col("x") + F.col("t") * F.col("dx") - px, F.col("y") + F.col("t") * F.col("dy") - py
    return d.select("contour_id", "i", F.sqrt("ll").alias("length"), F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")).alias("angle"), F.sqrt(ex * ex + ey * ey).alias("distance"))


def crossings(k: DataFrame) -> DataFrame:
    """Pairs of one contour's segments that cross inside both, with the place."""
    a, b = segments(k).alias("a"), segments(k).alias("b")
    d = a.join(b, (F.col("a.contour_id") == F.col("b.contour_id")) & (F.col("a.i") < F.col("b.i")))
    side = lambda p, q, s: f"({p}.nx - {p}.x) * ({q}.{s}y - {p}.y) - ({p}.ny - {p}.y) * ({q}.{s}x - {p}.x)"
    d = d.selectExpr("a.contour_id", "a.i AS i", "b.i AS j", "a.x AS x", "a.y AS y", "a.nx AS nx", "a.ny AS ny", f"{side('a', 'b', '')} AS s", f"{side('a', 'b', 'n')} AS t", f"{side('b', 'a', '')} AS u", f"{side('b', 'a', 'n')} AS w")
    d = d.where("sign(s) * sign(t) < 0 AND sign(u) * sign(w) < 0").withColumn("f", F.expr("double(u) / double(u - w)"))
    return d.selectExpr("contour_id", "i", "j", "x + f * (nx - x) AS cx", "y + f * (ny - y) AS cy")


def moments(k: DataFrame) -> DataFrame:
    """Signed area and centroid of the closed contour; no row where the area is zero."""
    w = W.partitionBy("contour_id").orderBy("i")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = k.select("contour_id", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("nx"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("ny"))
    d = d.withColumn("c", F.expr("x * ny - nx * y"))
    g = d.groupBy("contour_id").agg(F.sum("c").alias("s"), F.sum(F.expr("(x + nx) * c")).alias("sx"), F.sum(F.expr("(y + ny) * c")).alias("sy")).where("s <> 0")
    return g.select("contour_id", (F.col("s") / F.lit(2.0)).alias("area"), (F.col("sx") / (F.col("s") * 3.0)).alias("cx"), (F.col("sy") / (F.col("s") * 3.0)).alias("cy"))


def arc_length(k: DataFrame) -> DataFrame:
    """Length along the contour from its first point to each point."""
    w = W.partitionBy("contour_id").orderBy("i")
    step = F.sqrt(F.pow((F.col("x") - F.lag("x").over(w)).cast("double"), F.lit(2.0)) + F.pow((F.col("y") - F.lag("y").over(w)).cast("double"), F.lit(2.0)))
    return k.withColumn("_s", F.coalesce(step, F.lit(0.0))).select("contour_id", "i", F.sum("_s").over(w).alias("length"))


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Greatest distance from a point of a contour in ``a`` to the contour of the same name in ``b``."""
    other = b.select("contour_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = a.join(other, "contour_id").groupBy("contour_id", "i").agg(F.min(F.expr("(x - ox) * (x - ox) + (y - oy) * (y - oy)")).alias("d"))
    return d.groupBy("contour_id").agg(F.sqrt(F.max("d").cast("double")).alias("distance"))


def _hull(g: pd.DataFrame) -> pd.DataFrame:
    points = sorted(set(zip(g["x"].tolist(), g["y"].tolist(), strict=True)))

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1]) if len(points) > 1 else points
    return pd.DataFrame({"contour_id": g["contour_id"].iloc[0], "j": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})


def hull(k: DataFrame) -> DataFrame:
    """Corners of each contour's convex hull, in order; a line has its two ends, repeated points count once."""
    t = dict(k.dtypes)
    own = k.select("contour_id", "x", "y").dropna()
    return own.groupBy("contour_id").applyInPandas(_hull, f"contour_id {t['contour_id']}, j int, x {t['x']}, y {t['y']}")


def _sides(h: DataFrame) -> DataFrame:
    w = W.partitionBy("contour_id").orderBy("j")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return h.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})


def hull_features(k: DataFrame) -> DataFrame:
    """Corners, area and perimeter of the hull (a line is walked both ways)."""
    s = _sides(hull(k))
    return s.groupBy("contour_id").agg(F.count(F.lit(1)).alias("corners"), (F.sum(F.expr("x * ny - nx * y")) / F.lit(2.0)).alias("area"), F.sum(F.sqrt(F.expr("double((nx - x) * (nx - x) + (ny - y) * (ny - y))"))).alias("perimeter"))


def smallest_rectangle(k: DataFrame) -> DataFrame:
    """Area of the smallest rectangle along a side of the hull; contours of one place have no row."""
    h = hull(k)
    s = _sides(h).where("nx <> x OR ny <> y")
    o = h.select("contour_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = s.join(o, "contour_id").withColumns({"a": F.expr("(nx - x) * (ox - x) + (ny - y) * (oy - y)"), "b": F.expr("(nx - x) * (oy - y) - (ny - y) * (ox - x)"), "ll": F.expr("(nx - x) * (nx - x) + (ny - y) * (ny - y)")})
    d = d.groupBy("contour_id", "j").agg(((F.max("a") - F.min("a")).cast("double") * (F.max("b") - F.min("b")) / F.first("ll")).alias("area"))
    return d.groupBy("contour_id").agg(F.min("area").alias("area"))


def _line(c: list[str], m: tuple[float, ...], i: int) -> Column:
    return F.col(c[0]) * m[i] + F.col(c[1]) * m[i + 1] + F.col(c[2]) * m[i + 2] + m[i + 3]


def rigid(p: DataFrame, m: tuple[float, ...]) -> DataFrame:
    """Points (x, y, z) by a 3 x 4 matrix."""
    return p.withColumns({n: _line(["x", "y", "z"], m, 4 * i) for i, n in enumerate("xyz")})


def project(p: DataFrame, focal: tuple[float, float], centre: tuple[float, float], k: tuple[float, float, float], t: tuple[float, float]) -> DataFrame:
    """Image places of points before a pin-hole camera with radial and tangential distortion; points behind it are null."""
    d = p.withColumns({"a": F.when(F.col("z") > 0, F.col("x") / F.col("z")), "b": F.when(F.col("z") > 0, F.col("y") / F.col("z"))}).withColumn("q", F.expr("a * a + b * b"))
    f = 1 + F.col("q") * (k[0] + F.col("q") * (k[1] + F.col("q") * k[2]))
    a, b, q = F.col("a"), F.col("b"), F.col("q")
    u, v = a * f + 2 * t[0] * a * b + t[1] * (q + 2 * a * a), b * f + t[0] * (q + 2 * b * b) + 2 * t[1] * a * b
    return d.withColumns({"u": u * focal[0] + centre[0], "v": v * focal[1] + centre[1]}).drop("a", "b", "q")


def project_fisheye(p: DataFrame, focal: tuple[float, float], centre: tuple[float, float], k: tuple[float, float, float, float]) -> DataFrame:
    """Image places by the equidistant model with four angle terms; points behind are null, points on the axis the centre."""
    d = p.where("z IS NOT NULL").withColumns({"a": F.when(F.col("z") > 0, F.col("x") / F.col("z")), "b": F.when(F.col("z") > 0, F.col("y") / F.col("z"))}).withColumn("n", F.expr("sqrt(a * a + b * b)")).withColumn("o", F.atan("n")).withColumn("s", F.expr("o * o"))
    s = F.col("s")
    f = F.when(F.col("n") > 0, F.col("o") * (1 + s * (k[0] + s * (k[1] + s * (k[2] + s * k[3])))) / F.col("n")).otherwise(F.when(F.col("n") == 0, 1.0))
    return d.withColumns({"u": F.col("a") * f * focal[0] + centre[0], "v": F.col("b") * f * focal[1] + centre[1]}).drop("a", "b", "n", "o", "s")


#: Linear sRGB to XYZ for the D65 white, that white, and the bounds of the CIE curves.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 0.008856, 903.3


def xyz(c: DataFrame) -> DataFrame:
    """CIE XYZ of sRGB bytes r, g, b."""
    part = lambda n: F.col(n) / 255.0
    linear = [F.when(part(n) <= 0.04045, part(n) / 12.92).otherwise(F.pow((part(n) + 0.055) / 1.055, F.lit(2.4))) for n in "rgb"]
    return c.withColumns({n: reduce(lambda a, b: a + b, [e * f for e, f in zip(linear, line, strict=True)]) for n, line in zip("xyz", TO_XYZ, strict=True)})


def lab(c: DataFrame) -> DataFrame:
    """CIE L*a*b* of sRGB bytes."""
    f = lambda n, w: F.when(F.col(n) / w > EPSILON, F.cbrt(F.col(n) / w)).otherwise((F.col(n) / w * KAPPA + 16) / 116.0)
    fx, fy, fz = (f(n, w) for n, w in zip("xyz", WHITE, strict=True))
    return xyz(c).withColumns({"ll": 116 * fy - 16, "aa": 500 * (fx - fy), "bb": 200 * (fy - fz)}).drop("x", "y", "z")


def nearest(c: DataFrame, centres: list[tuple[float, ...]]) -> DataFrame:
    """Number of each colour's nearest centre, the smaller of equals."""
    far = lambda m: reduce(lambda a, b: a + b, [(F.col(n) - F.lit(float(q))) * (F.col(n) - F.lit(float(q))) for n, q in zip("rgb", m, strict=True)])
    return c.withColumn("cluster", F.array_min(F.array(*[F.struct(far(m).alias("d"), F.lit(i).alias("n")) for i, m in enumerate(centres)]))["n"])


def kmeans(c: DataFrame, centres: list[tuple[float, ...]], rounds: int, epsilon: float | None = None) -> list[tuple[float, ...]]:
    """Centres after some rounds, or sooner if all move less than ``epsilon``; each round is one aggregate of as many rows as centres, and an empty cluster keeps its own."""
    for _ in range(rounds):
        got = {x["cluster"]: (x["r"], x["g"], x["b"]) for x in nearest(c, centres).groupBy("cluster").agg(*(F.avg(n).alias(n) for n in "rgb")).collect()}
        old, centres = centres, [got.get(i, m) for i, m in enumerate(centres)]
        if epsilon is not None and max(map(math.dist, old, centres), default=0.0) < epsilon:
            break
    return centres
