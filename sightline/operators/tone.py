"""Grey tones and colours: limited equalisation by tiles, texture over directions, further colour spaces.

Images are independent of each other. Null pixels take no part; empty tables
give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import raster as r


def tile_curves(px: DataFrame, tiles: int, limit: float, bins: int = 256) -> DataFrame:
    """Curves ``image_id, ty, tx, v, u`` of each tile: its cumulated histogram, clipped at ``limit`` times an even share, the excess spread evenly."""
    dims = px.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    d = px.join(dims, "image_id").withColumn("ty", F.floor(F.col("y") / F.ceil(F.col("_h") / tiles))).withColumn("tx", F.floor(F.col("x") / F.ceil(F.col("_w") / tiles)))
    n = d.groupBy("image_id", "ty", "tx", F.floor(F.col("v") * bins / 256).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    tile = n.groupBy("image_id", "ty", "tx").agg(F.sum("n").alias("size"))
    clip = F.greatest(F.lit(1), F.floor(F.col("size") * limit / bins)) if limit > 0 else F.col("size")
    full = tile.withColumn("clip", clip).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = full.join(n, ["image_id", "ty", "tx", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = W.partitionBy("image_id", "ty", "tx")
    full = full.withColumn("over", F.sum(F.greatest(F.col("n") - F.col("clip"), F.lit(0))).over(of))
    full = full.withColumn("n", F.least("n", "clip") + F.floor(F.col("over") / bins) + (F.col("b") < F.col("over") % bins).cast("int"))
    full = full.withColumn("u", F.floor(F.least(F.lit(255.0), F.sum("n").over(of.orderBy("b")) * 255.0 / F.sum("n").over(of))))
    per = 256 // bins
    return full.select("image_id", "ty", "tx", F.explode(F.sequence(F.col("b") * per, F.col("b") * per + per - 1)).alias("v"), "u")


def limited_equalize(px: DataFrame, tiles: int = 8, limit: float = 2.0) -> DataFrame:
    """Equalisation by tiles with a contrast limit; each pixel blends the curves of the four nearest tiles, rounded."""
    curves = tile_curves(px, tiles, limit)
    dims = px.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    d = px.join(dims, "image_id")
    for c, size in (("y", "_h"), ("x", "_w")):
        d = d.withColumn(f"p{c}", (F.col(c) + 0.5) * tiles / F.col(size) - 0.5).withColumn(f"f{c}", F.col(f"p{c}") - F.floor(f"p{c}"))
        inside = lambda e: F.greatest(F.lit(0), F.least(e, F.lit(tiles - 1)))
        d = d.withColumn(f"a{c}", inside(F.floor(f"p{c}"))).withColumn(f"b{c}", inside(F.floor(f"p{c}") + 1))
        d = d.withColumn(f"f{c}", F.when(F.col(f"a{c}") == F.col(f"b{c}"), 0.0).otherwise(F.col(f"f{c}")))
    share = lambda c, k: F.col(f"f{c}") if k else 1 - F.col(f"f{c}")
    corner = F.explode(F.array(*[F.struct(F.col("by" if i else "ay").alias("ty"), F.col("bx" if j else "ax").alias("tx"), (share("y", i) * share("x", j)).alias("w")) for i in (0, 1) for j in (0, 1)]))
    d = d.select(*r.KEY, "v", corner.alias("c")).select(*r.KEY, "v", "c.ty", "c.tx", "c.w").join(curves, ["image_id", "ty", "tx", "v"])
    return d.groupBy(*r.KEY).agg(F.floor(F.round(F.sum(F.col("w") * F.col("u")), 9) + 0.5).cast("int").alias("v"))


def texture(px: DataFrame, levels: int) -> DataFrame:
    """Mean over the four directions of the co-occurrence features, with mean, variance and correlation (0 for one level)."""
    parts = []
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        parts.append(r.glcm(px, levels, dy, dx).withColumn("dir", F.lit(k)))
    g = reduce(lambda a, b: a.unionByName(b), parts)
    of = W.partitionBy("image_id", "dir")
    g = g.withColumn("p", F.col("n") / F.sum("n").over(of))
    f = g.groupBy("image_id", "dir").agg(
        F.sum(F.expr("p * (i - j) * (i - j)")).alias("contrast"), F.sum(F.expr("p * p")).alias("energy"), F.sum(F.expr("p / (1 + (i - j) * (i - j))")).alias("homogeneity"),
        F.sum(F.expr("p * i")).alias("mean"), F.sum(F.expr("p * i * i")).alias("_ii"), F.sum(F.expr("p * i * j")).alias("_ij"),
    )
    var = F.col("_ii") - F.col("mean") * F.col("mean")
    f = f.withColumn("variance", var).withColumn("correlation", F.when(F.col("variance") > 1e-12, (F.col("_ij") - F.col("mean") * F.col("mean")) / F.col("variance")).otherwise(0.0))
    names = ("contrast", "energy", "homogeneity", "mean", "variance", "correlation")
    return f.groupBy("image_id").agg(*(F.avg(c).alias(c) for c in names))


def luv(xyz: DataFrame, white: tuple[float, float, float]) -> DataFrame:
    """CIE L*, u*, v* of x, y, z columns (0..1)."""
    xn, yn, zn = white
    d = F.col("x") + 15 * F.col("y") + 3 * F.col("z")
    dn = xn + 15 * yn + 3 * zn
    t = F.col("y") / yn
    light = F.when(t > 0.008856, 116 * F.cbrt(t) - 16).otherwise(903.3 * t)
    u, v = F.when(d > 0, 4 * F.col("x") / d).otherwise(4 * xn / dn), F.when(d > 0, 9 * F.col("y") / d).otherwise(9 * yn / dn)
    rest = [c for c in xyz.columns if c not in ("x", "y", "z")]
    e = xyz.withColumns({"ll": light, "_u": u, "_v": v})
    return e.select(*rest, "ll", (13 * F.col("ll") * (F.col("_u") - 4 * xn / dn)).alias("uu"), (13 * F.col("ll") * (F.col("_v") - 9 * yn / dn)).alias("vv"))


def mixed_channels(c: DataFrame, m: list[list[float]]) -> DataFrame:
    """Channels r, g, b under a 3 x 3 or 3 x 4 matrix, clamped to a byte and truncated."""
    line = lambda w: r.clamp(F.col("r") * float(w[0]) + F.col("g") * float(w[1]) + F.col("b") * float(w[2]) + (float(w[3]) if len(w) > 3 else 0.0))
    rest = [x for x in c.columns if x not in ("r", "g", "b")]
    return c.select(*rest, *(line(w).alias(x) for w, x in zip(m, "rgb", strict=True)))


def white_balance(c: DataFrame, by: list[str]) -> DataFrame:
    """Channels scaled so that their means within a group are equal (grey world), clamped and truncated; a channel of mean 0 stays."""
    means = c.groupBy(*by).agg(*(F.avg(x).alias(f"_{x}") for x in "rgb")) if by else c.agg(*(F.avg(x).alias(f"_{x}") for x in "rgb"))
    grey = (F.col("_r") + F.col("_g") + F.col("_b")) / 3
    d = c.join(means, by) if by else c.join(F.broadcast(means))  # one row
    rest = [x for x in c.columns if x not in ("r", "g", "b")]
    return d.select(*rest, *(F.when(F.col(f"_{x}") > 0, r.clamp(F.round(F.col(x) * grey / F.col(f"_{x}"), 9))).otherwise(F.col(x)).alias(x) for x in "rgb"))
