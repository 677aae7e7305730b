"""Calipers: profiles sampled from images along rotated rectangles, edges and pairs in them, robust fits of their points.

A handle is ``handle_id, image_id, row, col, phi, length1, length2``: a rectangle
about a centre, measured along ``phi`` over 2 length1 + 1 samples, each the mean of
2 length2 + 1 bilinear samples across. Samples outside the image leave out their
place. A profile holds a handle's samples only, so every handle is independent.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profiles(px: DataFrame, handles: DataFrame) -> DataFrame:
    """``handle_id, i, v``: the mean grey value at each place along a handle; i runs from -length1 to length1."""
    h = handles.withColumn("i", F.explode(F.expr("sequence(-length1, length1)"))).withColumn("j", F.explode(F.expr("sequence(-length2, length2)")))
    sin, cos = F.sin("phi"), F.cos("phi")
    # rows grow downwards: the direction phi is (cos, -sin) in (column, row)
    h = h.withColumn("u", F.col("col") + F.col("i") * cos + F.col("j") * sin).withColumn("w", F.col("row") - F.col("i") * sin + F.col("j") * cos)
    h = h.withColumns({"u": F.round("u", 9), "w": F.round("w", 9)}).withColumns({"u0": F.floor("u"), "w0": F.floor("w")})
    share = lambda c, c0, k: F.col(c) - F.col(c0) if k else 1 - F.col(c) + F.col(c0)
    cell = F.explode(F.array(*[F.struct((F.col("w0") + a).alias("y"), (F.col("u0") + b).alias("x"), (share("w", "w0", a) * share("u", "u0", b)).alias("f")) for a in (0, 1) for b in (0, 1)]))
    d = h.select("handle_id", "image_id", "i", "j", cell.alias("c")).select("handle_id", "image_id", "i", "j", "c.y", "c.x", "c.f").where("f > 0")
    d = d.join(px, ["image_id", "y", "x"]).groupBy("handle_id", "i", "j").agg(F.sum(F.col("f") * F.col("v")).alias("v"), F.sum("f").alias("f")).where("f > 0.999999")
    return d.groupBy("handle_id", "i").agg(F.avg("v").alias("v"))


def slope_kernel(sigma: float) -> list[float]:
    """Derivative of a Gaussian, with the sum of |weights| times places such that a unit ramp gives 1."""
    r = max(1, math.ceil(3 * sigma))
    k = [-t * math.exp(-t * t / (2 * sigma * sigma)) for t in range(-r, r + 1)]
    unit = sum(-t * w for t, w in zip(range(-r, r + 1), k, strict=True))
    return [round(-w / abs(unit), 12) for w in k]


def edges(profile: DataFrame, sigma: float, least: float) -> DataFrame:
    """Peaks of the smoothed derivative: ``handle_id, i, position, amplitude, polarity``; places nearer to an end than the kernel give none."""
    k = slope_kernel(sigma)
    r = len(k) // 2
    w = W.partitionBy("handle_id").orderBy("i")
    g = reduce(lambda a, b: a + b, [F.lag("v", -t).over(w) * F.lit(c) for t, c in zip(range(-r, r + 1), k, strict=True)])
    d = profile.withColumn("g", g).where("g IS NOT NULL")
    d = d.withColumns({"a": F.abs("g"), "l": F.lag(F.abs("g")).over(w), "q": F.lead(F.abs("g")).over(w)}).where("l IS NOT NULL AND q IS NOT NULL")
    d = d.where((F.col("a") >= least) & (F.col("a") >= F.col("l")) & (F.col("a") > F.col("q")))
    bend = F.col("l") - 2 * F.col("a") + F.col("q")
    off = F.when(bend == 0, 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("l") - F.col("q")) / bend)))
    return d.select("handle_id", "i", (F.col("i") + off).alias("position"), F.col("a").alias("amplitude"), F.when(F.col("g") > 0, "positive").otherwise("negative").alias("polarity"))


def pairs(e: DataFrame, ideal: float | None = None) -> DataFrame:
    """Each edge with the next of the other polarity: centre, width, and a score of contrast balance (and of nearness to an ideal width)."""
    w = W.partitionBy("handle_id").orderBy("i")
    d = e.withColumns({"p2": F.lead("position").over(w), "a2": F.lead("amplitude").over(w), "s2": F.lead("polarity").over(w)}).where("polarity <> s2")
    width = F.col("p2") - F.col("position")
    score = F.least("amplitude", "a2") / F.greatest("amplitude", "a2")
    if ideal:
        score = score * F.greatest(F.lit(0.0), 1 - F.abs(width - ideal) / ideal)
    return d.select("handle_id", "i", "polarity", ((F.col("position") + F.col("p2")) / 2).alias("centre"), width.alias("width"), score.alias("score"))


def located(e: DataFrame, handles: DataFrame) -> DataFrame:
    """Edges with their row and column in the image."""
    h = handles.select("handle_id", "image_id", "row", "col", "phi")
    return e.join(h, "handle_id").select("handle_id", "image_id", "i", (F.col("row") - F.col("position") * F.sin("phi")).alias("row"), (F.col("col") + F.col("position") * F.cos("phi")).alias("col"), "amplitude", "polarity")


def _axis(d: DataFrame) -> DataFrame:
    """Main axis of weighted points: ``case_id, mx, my, angle``."""
    g = d.groupBy("case_id").agg(*(F.sum(F.expr(f"w * {e}")).alias(n) for n, e in {"s": "1", "sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y"}.items()), F.count(F.lit(1)).alias("n")).where("s > 0 AND n >= 2")
    g = g.select("case_id", F.expr("sx / s").alias("mx"), F.expr("sy / s").alias("my"), F.expr("sxx / s - (sx / s) * (sx / s)").alias("cxx"), F.expr("syy / s - (sy / s) * (sy / s)").alias("cyy"), F.expr("sxy / s - (sx / s) * (sy / s)").alias("cxy"))
    return g.select("case_id", "mx", "my", (0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))).alias("angle"))


def fit_line_robust(p: DataFrame, rounds: int = 3, huber: float = 1.345) -> DataFrame:
    """A line by iterated reweighting: Huber weights of distances in units of their median / 0.6745.

    Every round is windows over a set's points, so all rounds share one exchange.
    """
    of = W.partitionBy("case_id")
    d = p.select("case_id", "x", "y", F.lit(1.0).alias("w"))
    for _ in range(rounds):
        s = {"s": "w", "sx": "w * x", "sy": "w * y", "sxx": "w * x * x", "syy": "w * y * y", "sxy": "w * x * y"}
        e = d.select("*", *(F.sum(F.expr(c)).over(of).alias(n) for n, c in s.items()))
        e = e.select("case_id", "x", "y", F.expr("sx / s").alias("mx"), F.expr("sy / s").alias("my"), F.expr("0.5D * atan2(2 * (sxy / s - (sx / s) * (sy / s)), (sxx / s - (sx / s) * (sx / s)) - (syy / s - (sy / s) * (sy / s)))").alias("angle"))
        e = e.select("case_id", "x", "y", F.abs((F.col("y") - F.col("my")) * F.cos("angle") - (F.col("x") - F.col("mx")) * F.sin("angle")).alias("_d"))
        e = e.select("*", (F.median("_d").over(of) / 0.6745).alias("_s"))
        d = e.select("case_id", "x", "y", F.when((F.col("_s") <= 0) | (F.col("_d") <= huber * F.col("_s")), 1.0).otherwise(huber * F.col("_s") / F.col("_d")).alias("w"))
    return _axis(d)


def ransac_line(p: DataFrame, tries: int, within: float) -> DataFrame:
    """The line through two points with most points within a distance, refitted to these: ``case_id, inliers, mx, my, angle``.

    Points are numbered by (x, y); try t takes the points 7919 t and 104729 t + 1
    modulo their number, so reruns agree. Ties go to the first try. A set's points
    meet each of its tries once.
    """
    n = W.partitionBy("case_id")
    d = p.select("case_id", "x", "y").withColumns({"i": F.row_number().over(n.orderBy("x", "y")) - 1, "n": F.count(F.lit(1)).over(n)}).where("n >= 2")
    t = d.groupBy("case_id").agg(F.max("n").alias("n")).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    t = t.withColumns({"i1": (F.col("t") * 7919) % F.col("n"), "i2": (F.col("t") * 104729 + 1) % F.col("n")}).drop("n")
    at = lambda k: d.select("case_id", F.col("i").alias(f"i{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    t = t.join(at(1), ["case_id", "i1"]).join(at(2), ["case_id", "i2"]).withColumns({"dx": F.expr("x2 - x1"), "dy": F.expr("y2 - y1")}).where("dx <> 0 OR dy <> 0")
    t = t.withColumn("lines", F.struct("t", "x1", "y1", "dx", "dy")).groupBy("case_id").agg(F.array_sort(F.collect_list("lines")).alias("lines"))
    off = lambda q: F.abs((F.col("y") - q["y1"]) * q["dx"] - (F.col("x") - q["x1"]) * q["dy"]) <= within * F.sqrt(q["dx"] * q["dx"] + q["dy"] * q["dy"])
    hit = d.join(t, "case_id").select("case_id", "x", "y", F.explode("lines").alias("q")).where(off(F.col("q")))
    votes = hit.groupBy("case_id", "q.t").agg(F.count(F.lit(1)).alias("inliers"))
    best = votes.groupBy("case_id").agg(F.max_by(F.struct("t", "inliers"), F.struct("inliers", -F.col("t"))).alias("b")).select("case_id", "b.t", "b.inliers")
    own = hit.select("case_id", "x", "y", "q.t").join(best, ["case_id", "t"])
    return _axis(own.select("case_id", "x", "y", F.lit(1.0).alias("w"))).join(best.select("case_id", "inliers"), "case_id").select("case_id", "inliers", "mx", "my", "angle")


def undistorted(p: DataFrame, k: tuple[float, float, float], t: tuple[float, float], rounds: int = 8) -> DataFrame:
    """The inverse of lens distortion by fixed-point steps: the points of which the distortion is (x, y)."""
    u, w = F.col("x"), F.col("y")
    d = p.select("case_id", "x", "y", u.alias("u"), w.alias("w"))
    for _ in range(rounds):
        d = d.withColumn("r2", F.expr("u * u + w * w"))
        d = d.withColumn("s", 1 + k[0] * F.col("r2") + k[1] * (F.col("r2") * F.col("r2")) + k[2] * (F.col("r2") * F.col("r2") * F.col("r2")))
        du, dw = 2 * t[0] * F.col("u") * F.col("w") + t[1] * (F.col("r2") + 2 * F.col("u") * F.col("u")), t[0] * (F.col("r2") + 2 * F.col("w") * F.col("w")) + 2 * t[1] * F.col("u") * F.col("w")
        d = d.select("case_id", "x", "y", ((u - du) / F.col("s")).alias("u"), ((w - dw) / F.col("s")).alias("w"))
    return d
