"""Image operators on ``pixels(image_id, y, x, v)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["image_id", "y", "x"]


def row_():
    """Along a row; windows need a session, so they are made when used."""
    return W.partitionBy("image_id", "y").orderBy("x")


def col_():
    """Along a column."""
    return W.partitionBy("image_id", "x").orderBy("y")


def clamp(c: Column) -> Column:
    """To 0..255, then truncated."""
    return F.floor(F.greatest(F.lit(0), F.least(F.lit(255), c))).cast("int")


def point(px: DataFrame, f) -> DataFrame:
    """A function of the grey value."""
    return px.select(*KEY, f(F.col("v")).alias("v"))


def threshold(px: DataFrame, t: int, mode: str = "binary") -> DataFrame:
    """Strictly above t: binary, inv, trunc, tozero, tozero_inv."""
    v, above = F.col("v"), F.col("v") > t
    modes = {"binary": (F.lit(255), F.lit(0)), "inv": (F.lit(0), F.lit(255)), "trunc": (F.lit(t), v), "tozero": (v, F.lit(0)), "tozero_inv": (F.lit(0), v)}
    if mode not in modes:
        raise ValueError(f"unknown threshold mode {mode!r}")
    return px.select(*KEY, F.when(above, modes[mode][0]).otherwise(modes[mode][1]).cast("int").alias("v"))


def multilevel(px: DataFrame, levels: list[int]) -> DataFrame:
    """The number of levels that are not above the value."""
    return px.select(*KEY, reduce(lambda a, b: a + b, [(F.col("v") >= t).cast("int") for t in levels]).alias("v"))


def in_range(px: DataFrame, lo: float, hi: float) -> DataFrame:
    """Pixels of the region lo <= v <= hi, bounds clamped to a byte and truncated."""
    cut = lambda t: int(min(255, max(0, t)))
    return px.where(F.col("v").between(cut(lo), cut(hi))).select(*KEY)


def combine(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """A function of the aligned pixels of two images."""
    return a.join(b.withColumnRenamed("v", "v2"), KEY).select(*KEY, f(F.col("v"), F.col("v2")).alias("v"))


def dyn_threshold(px: DataFrame, ref: DataFrame, offset: int, mode: str = "light") -> DataFrame:
    """Pixels that differ from a reference image by more than an offset."""
    d = F.col("v") - F.col("v2")
    test = {"light": d > offset, "dark": d < -offset, "equal": F.abs(d) <= offset, "not_equal": F.abs(d) > offset}[mode]
    return px.join(ref.withColumnRenamed("v", "v2"), KEY).where(test).select(*KEY)


def padded(px: DataFrame, rx: int, ry: int, border: str = "mirror") -> DataFrame:
    """The images with borders mirrored about their edge pixels (each image larger than the radii), or with the edge pixels repeated ("clamp")."""
    if border not in ("mirror", "clamp"):
        raise ValueError(f"unknown border {border!r}")
    dims = px.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))

    def places(c, last, r):
        own = F.array(F.col(c))
        if not r:
            return F.explode(own)
        if border == "clamp":
            beyond = lambda at, a, b: F.when(F.col(c) == at, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
            return F.explode(F.concat(own, beyond(F.lit(0), F.lit(-r), F.lit(-1)), beyond(F.col(last), F.col(last) + 1, F.col(last) + r)))
        low, high = F.when((F.col(c) > 0) & (F.col(c) <= r), -F.col(c)), F.when((F.col(c) < F.col(last)) & (F.col(c) >= F.col(last) - r), 2 * F.col(last) - F.col(c))
        return F.explode(F.array_compact(F.array(F.col(c), low, high)))

    d = px.join(dims, "image_id")
    d = d.select("image_id", "_h", "_w", "v", "x", places("y", "_h", ry).alias("y"))
    return d.select("image_id", "_h", "_w", "v", "y", places("x", "_w", rx).alias("x"))


def _inner(d: DataFrame, v: Column) -> DataFrame:
    return d.where("y BETWEEN 0 AND _h AND x BETWEEN 0 AND _w").select(*KEY, v.alias("v"))


def separable(px: DataFrame, kx: list[float], ky: list[float]) -> DataFrame:
    """Correlation with two odd kernels, as a double."""
    rx, ry = len(kx) // 2, len(ky) // 2
    taps = lambda c, k, w: reduce(lambda a, b: a + b, [F.lag(c, -j).over(w) * F.lit(f) for j, f in zip(range(-(len(k) // 2), len(k) // 2 + 1), k, strict=True) if f])
    d = padded(px, rx, ry).withColumn("s", taps("v", kx, row_()))
    return _inner(d.withColumn("t", taps("s", ky, col_())), F.col("t").cast("double"))


def box_aggregate(px: DataFrame, rx: int, ry: int, f) -> DataFrame:
    """f over a (2 rx + 1) x (2 ry + 1) window, for f that can be applied by rows, then columns (sum, min, max)."""
    d = padded(px, rx, ry).withColumn("s", f("v").over(row_().rowsBetween(-rx, rx)))
    return _inner(d.withColumn("t", f("s").over(col_().rowsBetween(-ry, ry))), F.col("t"))


def box_mean(px: DataFrame, r: int) -> DataFrame:
    """Mean of a square window, truncated."""
    return point(box_aggregate(px, r, r, F.sum), lambda v: F.floor(v / float((2 * r + 1) ** 2)).cast("int"))


def erode(px: DataFrame, r: int) -> DataFrame:
    """Grey erosion by a square."""
    return box_aggregate(px, r, r, F.min)


def dilate(px: DataFrame, r: int) -> DataFrame:
    """Grey dilation by a square."""
    return box_aggregate(px, r, r, F.max)


def window_values(px: DataFrame, r: int) -> DataFrame:
    """Pixels with ``t``: all values of a square window, edge pixels repeated beyond the border."""
    d = padded(px, r, r, "clamp").withColumn("s", F.collect_list("v").over(row_().rowsBetween(-r, r)))
    d = d.withColumn("t", F.flatten(F.collect_list("s").over(col_().rowsBetween(-r, r))))
    return d.where("y BETWEEN 0 AND _h AND x BETWEEN 0 AND _w").select(*KEY, "v", "t")


def rank(px: DataFrame, r: int, at: int) -> DataFrame:
    """The value of a rank (0: least; beyond the window: greatest) in a square window, edge pixels repeated."""
    n = (2 * r + 1) ** 2
    return window_values(px, r).select(*KEY, F.element_at(F.array_sort("t"), min(max(at, 0), n - 1) + 1).alias("v"))


def median(px: DataFrame, r: int) -> DataFrame:
    """The median of a square window, edge pixels repeated."""
    return rank(px, r, (2 * r + 1) ** 2 // 2)


def local_entropy(px: DataFrame, r: int, bins: int = 32) -> DataFrame:
    """Entropy in bits of the grey values of a square window, in equal bins, edge pixels repeated."""
    n = float((2 * r + 1) ** 2)
    d = window_values(px, r).withColumn("t", F.transform("t", lambda v: F.floor(v * bins / 256)))
    share = F.transform(F.array_distinct("t"), lambda b: F.size(F.filter("t", lambda q: q == b)) / n)
    return d.select(*KEY, F.aggregate(share, F.lit(0.0), lambda s, q: s - q * F.log2(q)).alias("v"))


def local_deviation(px: DataFrame, r: int) -> DataFrame:
    """Population standard deviation of a square window."""
    n = float((2 * r + 1) ** 2)
    d = padded(px, r, r)
    w1, w2 = row_().rowsBetween(-r, r), col_().rowsBetween(-r, r)
    d = d.withColumn("a", F.sum("v").over(w1)).withColumn("b", F.sum(F.col("v") * F.col("v")).over(w1))
    d = d.withColumn("a", F.sum("a").over(w2)).withColumn("b", F.sum("b").over(w2))
    return _inner(d, F.sqrt((F.col("b") * n - F.col("a") * F.col("a")) / (n * n)))


def gradient(px: DataFrame, smooth: list[float]) -> DataFrame:
    """|gx| + |gy|, clamped; smooth [1, 2, 1] is Sobel's, [1, 1, 1] Prewitt's."""
    a, b, c = smooth
    before, after = F.lag("v").over(row_()), F.lead("v").over(row_())
    d = padded(px, 1, 1).select("*", (after - before).alias("_d"), (a * before + b * F.col("v") + c * after).alias("_s"))
    gx = a * F.lag("_d").over(col_()) + b * F.col("_d") + c * F.lead("_d").over(col_())
    gy = F.lead("_s").over(col_()) - F.lag("_s").over(col_())
    return _inner(d.withColumn("t", clamp(F.abs(gx) + F.abs(gy))), F.col("t"))


def laplace(px: DataFrame) -> DataFrame:
    """Sum of second differences."""
    d = padded(px, 1, 1).withColumn("_x", F.lag("v").over(row_()) + F.lead("v").over(row_()) - 4 * F.col("v"))
    return _inner(d.withColumn("t", F.col("_x") + F.lag("v").over(col_()) + F.lead("v").over(col_())), F.col("t").cast("int"))


def integral(px: DataFrame) -> DataFrame:
    """Sums of all values above and to the left, both included."""
    s = px.withColumn("s", F.sum("v").over(row_()))
    return s.select(*KEY, F.sum("s").over(col_()).alias("v"))


def lbp(px: DataFrame) -> DataFrame:
    """Local binary patterns: bit 0 north, clockwise; a neighbour that is not smaller sets its bit; 0 at borders."""
    at = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    d = px.withColumns({f"_{dx + 1}": F.lag("v", -dx).over(row_()) for dx in (-1, 0, 1)})
    d = d.withColumns({f"_{dx + 1}{dy + 1}": F.lag(f"_{dx + 1}", -dy).over(col_()) for dx in (-1, 0, 1) for dy in (-1, 0, 1)})
    bits = reduce(lambda a, b: a + b, [(F.col(f"_{dx + 1}{dy + 1}") >= F.col("v")).cast("int") * (1 << i) for i, (dy, dx) in enumerate(at)])
    return d.select(*KEY, F.coalesce(bits, F.lit(0)).alias("v"))


def histogram(px: DataFrame) -> DataFrame:
    """``image_id, v, n``."""
    return px.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def cdf(px: DataFrame) -> DataFrame:
    """The histogram with its running and total counts."""
    w = W.partitionBy("image_id")
    return histogram(px).withColumn("c", F.sum("n").over(w.orderBy("v"))).withColumn("total", F.sum("n").over(w))


def percentile(px: DataFrame, q: float) -> DataFrame:
    """The least value with at least the share q at or below it."""
    return cdf(px).where(F.col("c") >= F.col("total") * q).groupBy("image_id").agg(F.min("v").alias("v"))


def entropy(px: DataFrame) -> DataFrame:
    """Entropy of the grey values in bits."""
    p = F.col("n") / F.col("total")
    return cdf(px).groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def otsu(px: DataFrame) -> DataFrame:
    """The first value that maximises the variance between two classes, and the centre of its bin."""
    w = W.partitionBy("image_id").orderBy("v")
    d = cdf(px).withColumn("m", F.sum(F.col("n") * F.col("v")).over(w)).withColumn("mt", F.sum(F.col("n") * F.col("v")).over(W.partitionBy("image_id")))
    n0, n1 = F.col("c").cast("double"), (F.col("total") - F.col("c")).cast("double")
    gap = F.col("m") / n0 - (F.col("mt") - F.col("m")) / n1
    d = d.where("c < total").withColumn("between", n0 * n1 * gap * gap)
    best = d.groupBy("image_id").agg(F.max_by("v", F.struct("between", (-F.col("v")).alias("u"))).alias("v"))
    return best.select("image_id", "v", ((F.col("v") + 0.5) * 255 / 256).alias("threshold"))


def equalize(px: DataFrame) -> DataFrame:
    """Histogram equalisation by (cdf - least cdf) / (1 - least cdf), rounded; an image of one value becomes 0."""
    span = F.col("total") - F.col("lo")
    lut = cdf(px).withColumn("lo", F.min("c").over(W.partitionBy("image_id")))
    lut = lut.select("image_id", "v", F.when(span > 0, F.floor(((F.col("c") - F.col("lo")) * 510 + span) / (2 * span))).otherwise(0).cast("int").alias("to"))
    return px.join(lut, ["image_id", "v"]).select(*KEY, F.col("to").alias("v"))


def stretch(px: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """The grey values between two percentiles (centres of their bins) spread over 0..255, rounded; unchanged if they are one."""
    centre = lambda q: F.min(F.when(F.col("c") >= F.floor(F.col("total") * q / 100), (F.col("v") + 0.5) * 255 / 256))
    first = F.lit(0.5 * 255 / 256)  # a percentile of no pixels is the first bin
    at = lambda q: F.when(F.floor(F.max("total") * q / 100) == 0, first).otherwise(centre(q))
    r = cdf(px).groupBy("image_id").agg(at(low).alias("lo"), at(high).alias("hi"))
    to = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("v") - F.col("lo")) * (255 / (F.col("hi") - F.col("lo")))))
    return px.join(r, "image_id").select(*KEY, F.when(F.col("hi") > F.col("lo"), F.floor(to + 0.5).cast("int")).otherwise(F.col("v")).alias("v"))


def intensity(px: DataFrame, roi: DataFrame | None = None) -> DataFrame:
    """Least, greatest, mean and population deviation of each image, or of a region of it; zeros for an image without pixels in the region."""
    d = px.withColumn("_in", F.lit(True)) if roi is None else px.join(roi.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left")
    v = F.when(F.col("_in"), F.col("v"))
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    return d.groupBy("image_id").agg(zero(F.min(v), 0).alias("lo"), zero(F.max(v), 0).alias("hi"), zero(F.avg(v), 0.0).alias("mean"), zero(F.stddev_pop(v), 0.0).alias("deviation"))


def glcm(px: DataFrame, levels: int, dy: int, dx: int) -> DataFrame:
    """Grey-level co-occurrence of neighbours, counted both ways: ``image_id, i, j, n``."""
    level = F.least(F.floor(F.col("v") * levels / 256), F.lit(levels - 1)).cast("int")
    d = px.withColumn("i", level)
    d = d.withColumn("a", F.lag("i", -dx).over(row_())) if dx else d.withColumn("a", F.col("i"))
    d = d.withColumn("j", F.lag("a", -dy).over(col_())) if dy else d.withColumn("j", F.col("a"))
    d = d.where("j IS NOT NULL").groupBy("image_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    both = d.union(d.select("image_id", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    return both.groupBy("image_id", "i", "j").agg(F.sum("n").alias("n"))


def glcm_features(g: DataFrame) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy, entropy and greatest probability."""
    p, d = F.col("n") / F.sum("n").over(W.partitionBy("image_id")), F.col("i") - F.col("j")
    g = g.withColumn("p", p).withColumn("d", d)
    return g.groupBy("image_id").agg(F.sum(F.expr("p * d * d")).alias("contrast"), F.sum(F.expr("p * abs(d)")).alias("dissimilarity"), F.sum(F.expr("p / (1 + d * d)")).alias("homogeneity"), F.sum(F.expr("p * p")).alias("energy"), (-F.sum(F.expr("p * log2(p + 1e-10D)"))).alias("entropy"), F.max("p").alias("most"))


def pyramid(px: DataFrame) -> DataFrame:
    """Half the size; each pixel the truncated mean of four (odd edges are left out)."""
    d = px.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return d.where("n = 4").select(*KEY, F.floor(F.col("s") / 4).cast("int").alias("v"))


def mirror(px: DataFrame, axis: str) -> DataFrame:
    """Mirrored: row (upside down), column (left to right), diagonal (transposed)."""
    if axis == "diagonal":
        return px.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "v")
    c = {"row": "y", "column": "x"}[axis]
    return px.withColumn(c, (F.max(c).over(W.partitionBy("image_id")) - F.col(c)).cast("int")).select(*KEY, "v")


def crop(px: DataFrame, y0: int, x0: int, h: int, w: int) -> DataFrame:
    """A rectangle, moved to the origin."""
    d = px.where(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1))
    return d.select("image_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def affine(px: DataFrame, m: tuple[float, ...]) -> DataFrame:
    """Warp by bilinear sampling: out(y, x) = in(m0 x + m1 y + m2, m3 x + m4 y + m5) as (column, row); only full cells."""
    grid = px.select("image_id", "y", "x")
    u, v = F.col("x") * m[0] + F.col("y") * m[1] + m[2], F.col("x") * m[3] + F.col("y") * m[4] + m[5]
    g = grid.withColumn("u", u).withColumn("w", v).withColumn("u0", F.floor("u").cast("int")).withColumn("w0", F.floor("w").cast("int"))
    cell = F.explode(F.array(*[F.struct((F.col("w0") + a).alias("sy"), (F.col("u0") + b).alias("sx"), ((F.col("w") - F.col("w0") if a else 1 - F.col("w") + F.col("w0")) * (F.col("u") - F.col("u0") if b else 1 - F.col("u") + F.col("u0"))).alias("f")) for a in (0, 1) for b in (0, 1)]))
    g = g.select(*KEY, cell.alias("c")).select(*KEY, F.col("c.sy").alias("sy"), F.col("c.sx").alias("sx"), F.col("c.f").alias("f"))
    src = px.select(F.col("image_id"), F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    d = g.join(src, ["image_id", "sy", "sx"]).groupBy(*KEY).agg(F.sum(F.col("f") * F.col("v")).alias("s"), F.count(F.lit(1)).alias("n"))
    return d.where("n = 4").select(*KEY, F.col("s").alias("v"))


def variation_model(px: DataFrame) -> DataFrame:
    """Mean and population variance of every pixel over the training images."""
    return px.groupBy("y", "x").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def variation_compare(px: DataFrame, model: DataFrame, absolute: float, factor: float) -> DataFrame:
    """Pixels that differ from the model by more than both thresholds."""
    limit = F.greatest(F.lit(float(absolute)), F.sqrt("var") * factor)
    return px.join(model, ["y", "x"]).where(F.abs(F.col("v") - F.col("mean")) > limit).select(*KEY)


def ncc(px: DataFrame, template: DataFrame, size: int) -> DataFrame:
    """Normalised cross-correlation of a size x size template at every full position.

    The template has a fixed number of rows, which is checked before it is
    broadcast; each pixel meets each once.
    """
    if size > 64 or template.limit(size * size + 1).count() != size * size:
        raise ValueError("the template is not a square of the given size" if size <= 64 else "templates over 64 x 64 need a pyramid")
    t = template.select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("v").alias("t"))
    d = px.crossJoin(F.broadcast(t))
    d = d.groupBy("image_id", (F.col("y") - F.col("ty")).alias("y"), (F.col("x") - F.col("tx")).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sv"), F.sum("t").alias("st"), F.sum(F.col("v") * F.col("v")).alias("svv"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.sum(F.col("v") * F.col("t")).alias("svt")).where(F.col("n") == size * size)
    top, a, b = F.expr("n * svt - sv * st"), F.expr("n * svv - sv * sv"), F.expr("n * stt - st * st")
    return d.select(*KEY, F.when((a > 0) & (b > 0), top / F.sqrt(a.cast("double") * b)).otherwise(0.0).alias("score"))
