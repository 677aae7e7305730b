"""Local thresholds, grey-level maps, general kernels, distances and edges of rasters.

Images are independent of each other; a window holds one row, one column or one
image. Null pixels take no part; empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import raster as r
from . import regions as rg


def gamma(px: DataFrame, power: float) -> DataFrame:
    """255 (v / 255) ^ power, truncated."""
    return r.point(px, lambda v: r.clamp(F.pow(v / 255.0, F.lit(power)) * 255.0))


def logarithm(px: DataFrame) -> DataFrame:
    """Grey values on a logarithmic scale from 0 to 255."""
    return r.point(px, lambda v: r.clamp(F.log(v + F.lit(1.0)) / F.log(F.lit(256.0)) * 255.0))


def binary(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Logic of two aligned images where a value above zero is set: and, or, xor, diff."""
    ops = {"and": lambda p, q: p & q, "or": lambda p, q: p | q, "xor": lambda p, q: p != q, "diff": lambda p, q: p & ~q}
    if op not in ops:
        raise ValueError(f"unknown operation {op!r}")
    return r.combine(a, b, lambda p, q: F.when(ops[op](p > 0, q > 0), 255).otherwise(0))


def counts(px: DataFrame, lo: int, hi: int) -> DataFrame:
    """Pixels that are not zero or lie in a range, their share, and whether only 0 and 255 occur."""
    v = F.col("v")
    return px.groupBy("image_id").agg(F.count_if(v != 0).alias("nonzero"), F.count_if(v.between(lo, hi)).alias("in_range"), F.avg((v > 0).cast("double")).alias("foreground"), F.bool_and(v.isin(0, 255)).alias("is_binary"))


def local_moments(px: DataFrame, radius: int) -> DataFrame:
    """Pixels with the mean and population deviation of their square window."""
    n = float((2 * radius + 1) ** 2)
    w1, w2 = r.row_().rowsBetween(-radius, radius), r.col_().rowsBetween(-radius, radius)
    d = r.padded(px, radius, radius).select("*", F.sum("v").over(w1).alias("_a"), F.sum(F.col("v") * F.col("v")).over(w1).alias("_b"))
    d = d.withColumns({"_a": F.sum("_a").over(w2), "_b": F.sum("_b").over(w2)}).where("y BETWEEN 0 AND _h AND x BETWEEN 0 AND _w")
    return d.select(*r.KEY, "v", (F.col("_a") / n).alias("mean"), F.sqrt((F.col("_b") * n - F.col("_a") * F.col("_a")) / (n * n)).alias("deviation"))


def adaptive(px: DataFrame, radius: int, method: str, k: float, span: float = 128.0) -> DataFrame:
    """Region above a local threshold: mean (mean - k), niblack (mean + k s), sauvola, wolf (its local form)."""
    m, s = F.col("mean"), F.col("deviation")
    d = local_moments(px, radius)
    limits = {"mean": m - k, "niblack": m + k * s, "sauvola": m * (1 + k * (s / span - 1)), "wolf": m - k * (1 - s / span) * m}
    if method not in limits:
        raise ValueError(f"unknown method {method!r}")
    return d.where(F.col("v") > limits[method]).select(*r.KEY)


def convolve(px: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Correlation with an odd two-dimensional kernel, as a double."""
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2
    d = r.padded(px, rx, ry)
    rows = [reduce(lambda a, b: a + b, [F.lag("v", rx - j).over(r.row_()) * F.lit(f) for j, f in enumerate(line)]).alias(f"_{i}") for i, line in enumerate(kernel)]
    d = d.select("*", *rows)
    total = reduce(lambda a, b: a + b, [F.lag(f"_{i}", ry - i).over(r.col_()) for i in range(len(kernel))])
    return r._inner(d.withColumn("t", total), F.col("t").cast("double"))


def slopes(px: DataFrame) -> DataFrame:
    """Sobel derivatives gx, gy of each pixel."""
    x1, x2, down = F.lag("v").over(r.row_()), F.lead("v").over(r.row_()), r.col_()
    d = r.padded(px, 1, 1).select("*", (x2 - x1).alias("_d"), (x1 + 2 * F.col("v") + x2).alias("_s"))
    gx = F.lag("_d").over(down) + 2 * F.col("_d") + F.lead("_d").over(down)
    gy = F.lead("_s").over(down) - F.lag("_s").over(down)
    d = d.select("*", gx.cast("double").alias("gx"), gy.cast("double").alias("gy"))
    return d.where("y BETWEEN 0 AND _h AND x BETWEEN 0 AND _w").select(*r.KEY, "gx", "gy")


def unsharp(px: DataFrame, sigma_kernel: list[float], amount: float, least: float) -> DataFrame:
    """v + amount (v - blurred), where the two differ by more than a limit."""
    b = r.separable(px, sigma_kernel, sigma_kernel)
    return r.combine(px, b, lambda v, g: F.when(F.abs(v - g) > least, r.clamp(v + amount * (v - g))).otherwise(v))


def bilateral(px: DataFrame, radius: int, spatial: float, range_: float) -> DataFrame:
    """Mean of a square window, weighted by distance in place and in grey value, as a double."""
    side = range(-radius, radius + 1)
    place = F.array(*[F.lit(math.exp(-(dy * dy + dx * dx) / (2 * spatial * spatial))) for dy in side for dx in side])
    d = r.padded(px, radius, radius).withColumn("s", F.collect_list("v").over(r.row_().rowsBetween(-radius, radius)))
    d = d.withColumn("t", F.flatten(F.collect_list("s").over(r.col_().rowsBetween(-radius, radius)))).where("y BETWEEN 0 AND _h AND x BETWEEN 0 AND _w")
    weight = F.zip_with("t", place, lambda q, w: w * F.exp((q - F.col("v")) * (q - F.col("v")) / F.lit(-2 * range_ * range_)))
    d = d.withColumn("w", weight)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, q: s + q)
    return d.select(*r.KEY, (add(F.zip_with("t", "w", lambda q, w: q * w)) / add(F.col("w"))).alias("v"))


def local_maxima(px: DataFrame) -> DataFrame:
    """Pixels above all of their neighbours (those outside the image do not count)."""
    low = F.lit(-1)
    d = px.withColumn("a", F.greatest(F.lag("v", 1, -1).over(r.row_()), F.lead("v", 1, -1).over(r.row_()))).withColumn("b", F.greatest("a", "v"))
    near = F.greatest(F.col("a"), F.coalesce(F.lag("b").over(r.col_()), low), F.coalesce(F.lead("b").over(r.col_()), low))
    return d.withColumn("n", near).where("v > n").select(*r.KEY, "v")


def match_histogram(px: DataFrame, reference: DataFrame) -> DataFrame:
    """Each grey value becomes the one whose share in the reference is nearest to its own, the least of equals; a reference has at most 256 values."""
    c = r.cdf(px).select("image_id", "v", "c", "total")
    ref = r.cdf(reference).groupBy().agg(F.array_sort(F.collect_list(F.struct("v", "c", "total"))).alias("_r"))
    # values that the reference lacks have the share of the value below them, 0 before the first
    options = F.concat(F.when(F.element_at("_r", 1)["v"] > 0, F.array(F.struct(F.lit(0).alias("v"), F.lit(0).cast("long").alias("c"), F.element_at("_r", 1)["total"].alias("total")))).otherwise(F.slice("_r", 1, 0)), F.col("_r"))
    gap = lambda s: F.abs(s["c"] * F.col("total") - F.col("c") * s["total"])
    best = F.array_min(F.transform(options, lambda s: F.struct(gap(s).alias("gap"), s["v"].alias("v"))))["v"]
    lut = c.join(F.broadcast(ref)).select("image_id", "v", best.alias("u"))  # one row
    return px.join(lut, ["image_id", "v"]).select(*r.KEY, F.col("u").alias("v"))


def distances(px: DataFrame, threshold: int, metric: str) -> DataFrame:
    """Distance of each pixel with v >= threshold to the nearest below it: l1, linf or l2; null where an image has none.

    Columns are done by running maxima and minima of the last place outside; rows
    by running minima (l1), or by the row's own array (linf, l2).
    """
    if metric not in ("l1", "linf", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    out = F.when(F.col("v") < threshold, F.col("y"))
    up, down = r.col_().rowsBetween(W.unboundedPreceding, 0), r.col_().rowsBetween(0, W.unboundedFollowing)
    d = px.withColumn("g", F.least(F.col("y") - F.max(out).over(up), F.min(out).over(down) - F.col("y")))
    if metric == "l1":
        left, right = r.row_().rowsBetween(W.unboundedPreceding, 0), r.row_().rowsBetween(0, W.unboundedFollowing)
        v = F.least(F.min(F.col("g") - F.col("x")).over(left) + F.col("x"), F.min(F.col("g") + F.col("x")).over(right) - F.col("x"))
        return d.select(*r.KEY, "v", v.alias("distance")).where(F.col("v") >= threshold).select(*r.KEY, F.col("distance").cast("double").alias("distance"))
    d = d.withColumn("_r", F.collect_list(F.when(F.col("g").isNotNull(), F.struct("x", "g"))).over(W.partitionBy("image_id", "y"))).where(F.col("v") >= threshold)
    away = (lambda s: F.greatest(F.abs(s["x"] - F.col("x")), s["g"])) if metric == "linf" else (lambda s: (s["x"] - F.col("x")) * (s["x"] - F.col("x")) + s["g"] * s["g"])
    best = F.array_min(F.transform("_r", away)).cast("double")
    return d.select(*r.KEY, (best if metric == "linf" else F.sqrt(best)).alias("distance"))


def thin_edges(px: DataFrame) -> DataFrame:
    """Gradient amplitude |gx| + |gy| where no neighbour along the gradient is larger, else 0; borders are 0.

    The gradient's direction is rounded to a multiple of 45 degrees: within 22.5
    degrees of an axis if the smaller part is below 0.41421356 of the larger.
    """
    d = slopes(px).withColumn("m", F.abs("gx") + F.abs("gy"))
    d = d.withColumns({"_l": F.lag("m").over(r.row_()), "_r": F.lead("m").over(r.row_()), "_u": F.lag("m").over(r.col_()), "_d": F.lead("m").over(r.col_())})
    d = d.withColumns({"_ul": F.lag("_u").over(r.row_()), "_ur": F.lead("_u").over(r.row_()), "_dl": F.lag("_d").over(r.row_()), "_dr": F.lead("_d").over(r.row_())})
    t, gx, gy = 0.41421356, F.col("gx"), F.col("gy")
    pick = lambda a, b, c, e: F.when(F.abs(gy) <= F.abs(gx) * t, F.col(a)).when(F.abs(gx) <= F.abs(gy) * t, F.col(b)).when(gx * gy > 0, F.col(c)).otherwise(F.col(e))
    d = d.withColumn("_p", pick("_l", "_u", "_ul", "_ur")).withColumn("_q", pick("_r", "_d", "_dr", "_dl"))
    kept = F.col("_p").isNotNull() & F.col("_q").isNotNull() & (F.col("m") >= F.col("_p")) & (F.col("m") >= F.col("_q"))
    inside = F.col("_ul").isNotNull() & F.col("_dr").isNotNull()
    return d.select(*r.KEY, F.when(kept & inside, F.col("m")).otherwise(0.0).cast("int").alias("v"))


def strong_edges(px: DataFrame, low: int, high: int) -> DataFrame:
    """Runs of thin edges of at least ``low`` that are connected to one of at least ``high``."""
    e = thin_edges(px)
    lab = rg.connection(rg.runs(e.where(F.col("v") >= low).select(*r.KEY)))
    kept = lab.join(e.where(F.col("v") >= high).select(*r.KEY), ["image_id", "y"]).where("x >= cb AND x < ce").select("image_id", "region_id").distinct()
    return lab.join(kept, ["image_id", "region_id"], "left_semi").select(*rg.RUN, "region_id")


def resample(px: DataFrame, grid: DataFrame) -> DataFrame:
    """Bilinear samples at (u, w) = (column, row) of ``grid(image_id, y, x, u, w)``; only full cells give a row."""
    g = grid.withColumn("u0", F.floor("u").cast("int")).withColumn("w0", F.floor("w").cast("int"))
    part = lambda c, o, k: F.col(c) - F.col(o) if k else 1 - F.col(c) + F.col(o)
    cells = F.array(*[F.struct((F.col("w0") + a).alias("sy"), (F.col("u0") + b).alias("sx"), (part("w", "w0", a) * part("u", "u0", b)).alias("f")) for a in (0, 1) for b in (0, 1)])
    g = g.select(*r.KEY, F.inline(cells))
    src = px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    d = g.join(src, ["image_id", "sy", "sx"]).groupBy(*r.KEY).agg(F.sum(F.col("f") * F.col("v")).alias("v"), F.count(F.lit(1)).alias("n"))
    return d.where("n = 4").select(*r.KEY, "v")


def projective(px: DataFrame, m: tuple[float, ...]) -> DataFrame:
    """Warp by the 3 x 3 matrix from output to input places."""
    x, y = F.col("x"), F.col("y")
    row = lambda i: x * m[i] + y * m[i + 1] + m[i + 2]
    return resample(px, px.select(*r.KEY, (row(0) / row(6)).alias("u"), (row(3) / row(6)).alias("w")))


def unwrapped(px: DataFrame, cy: float, cx: float, inner: float, outer: float, height: int, width: int) -> DataFrame:
    """A ring of each image as a rectangle: row = radius, column = angle."""
    each = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    radius, angle = F.col("y") * ((outer - inner) / (height - 1)) + inner, F.col("x") * (2 * math.pi / width)
    return resample(px, each.select(*r.KEY, (radius * F.cos(angle) + cx).alias("u"), (radius * F.sin(angle) + cy).alias("w")))


def shape_match(px: DataFrame, template: DataFrame, least: float, turns: list[float]) -> DataFrame:
    """Mean cosine between a template's gradients and an image's, at each place and turn where all its points lie inside.

    The template's points are those with |gx| + |gy| >= least, at most its own
    pixels (4096 are the most), so the exploded rows grow with the image only. Its
    origin is (0, 0).
    """
    if template.limit(4097).count() > 4096:
        raise ValueError("templates over 64 x 64 pixels need a pyramid")
    unit = lambda d: d.withColumn("_n", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    t = unit(slopes(template).where(F.abs("gx") + F.abs("gy") >= least)).select(F.col("y").alias("ty"), F.col("x").alias("tx"), (F.col("gx") / F.col("_n")).alias("tu"), (F.col("gy") / F.col("_n")).alias("tw"))
    cs = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(round(math.cos(a), 12)).alias("c"), F.lit(round(math.sin(a), 12)).alias("s")) for i, a in enumerate(turns)])
    t = t.select("*", F.inline(cs)).select("turn", F.floor(F.expr("tx * c - ty * s + 0.5D")).cast("int").alias("dx"), F.floor(F.expr("tx * s + ty * c + 0.5D")).cast("int").alias("dy"), F.expr("tu * c - tw * s").alias("tu"), F.expr("tu * s + tw * c").alias("tw"))
    t = t.withColumn("points", F.count(F.lit(1)).over(W.partitionBy("turn")))
    g = unit(slopes(px)).select(*r.KEY, F.when(F.col("_n") > 0, F.col("gx") / F.col("_n")).otherwise(0.0).alias("u"), F.when(F.col("_n") > 0, F.col("gy") / F.col("_n")).otherwise(0.0).alias("w"))
    d = g.join(F.broadcast(t)).select("image_id", "turn", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "points", F.expr("tu * u + tw * w").alias("e"))
    d = d.groupBy("image_id", "turn", "y", "x").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n"), F.first("points").alias("points"))
    return d.where("n = points").select("image_id", "turn", "y", "x", (F.col("s") / F.col("n")).alias("score"))


def region_grey(labelled: DataFrame, px: DataFrame) -> DataFrame:
    """Least, greatest and mean grey value and population deviation of each region."""
    d = px.join(labelled.select("image_id", "region_id", "y", F.explode(F.expr("sequence(cb, ce - 1)")).alias("x")), r.KEY)
    return d.groupBy("image_id", "region_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))


def holes(region: DataFrame, frame: DataFrame) -> DataFrame:
    """Labelled runs of the complement's 4-connected components that do not touch the frame's border."""
    lab = rg.connection(rg.complement(rg.runs(region), frame), eight=False)
    box = frame.groupBy("image_id").agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("cb").alias("_c0"), F.max("ce").alias("_c1"))
    out = lab.join(box, "image_id").where("y = _y0 OR y = _y1 OR cb = _c0 OR ce = _c1").select("image_id", "region_id").distinct()
    return lab.join(out, ["image_id", "region_id"], "left_anti").select(*rg.RUN, "region_id")


def filled(region: DataFrame, frame: DataFrame) -> DataFrame:
    """The region with its holes."""
    return rg.union(rg.runs(region), holes(region, frame).select(*rg.RUN))


def ellipse(f: DataFrame) -> DataFrame:
    """Half axes and direction of the ellipse with the same second moments, and their ratio (null for a flat region)."""
    d = f.withColumn("_s", F.expr("sqrt((m20 - m02) * (m20 - m02) + 4 * m11 * m11)"))
    half = lambda sign: F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) * (F.col("m20") + F.col("m02") + sign * F.col("_s"))))
    d = d.withColumns({"ra": half(1), "rb": half(-1)})
    return d.select("image_id", "region_id", "ra", "rb", F.expr("0.5D * atan2(CASE WHEN m11 = 0 THEN 0D ELSE 2 * m11 END, m02 - m20)").alias("phi"), F.when(F.col("rb") > 0.001, F.col("ra") / F.col("rb")).alias("anisometry"))


def raw_moments(labelled: DataFrame) -> DataFrame:
    """Sums of x^p y^q to the third order, exact."""
    d = labelled.select("image_id", "region_id", "y", F.explode(F.expr("sequence(bigint(cb), bigint(ce - 1))")).alias("x")).withColumn("y", F.col("y").cast("long"))
    power = lambda c, k: reduce(lambda a, b: a * b, [F.col(c)] * k, F.lit(1).cast("long"))
    return d.groupBy("image_id", "region_id").agg(*[F.sum(power("x", p) * power("y", q)).alias(f"m{p}{q}") for p in range(4) for q in range(4 - p)])


def inner_boundary(region: DataFrame) -> DataFrame:
    """Pixels of a region with one of their four neighbours outside it."""
    d = region.withColumns({"_l": F.lag("x").over(r.row_()), "_r": F.lead("x").over(r.row_()), "_u": F.lag("y").over(r.col_()), "_d": F.lead("y").over(r.col_())})
    all_in: Column = (F.col("_l") == F.col("x") - 1) & (F.col("_r") == F.col("x") + 1) & (F.col("_u") == F.col("y") - 1) & (F.col("_d") == F.col("y") + 1)
    return d.where(~F.coalesce(all_in, F.lit(False))).select(*r.KEY)
