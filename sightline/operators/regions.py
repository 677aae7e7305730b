"""Regions as runs ``(image_id, y, cb, ce)``, ends exclusive, and their components and features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import saved, ship
from .components import components

RUN = ["image_id", "y", "cb", "ce"]


def runs(region: DataFrame) -> DataFrame:
    """Run-length form of a region's pixels (gaps and islands)."""
    d = region.distinct().withColumn("g", F.col("x") - F.row_number().over(W.partitionBy("image_id", "y").orderBy("x")))
    return d.groupBy("image_id", "y", "g").agg(F.min("x").alias("cb"), (F.max("x") + 1).alias("ce")).select(*RUN)


def mask(r: DataFrame) -> DataFrame:
    """The pixels of runs."""
    return r.select("image_id", "y", F.explode(F.sequence("cb", F.col("ce") - 1)).alias("x")).distinct()


def merge(r: DataFrame) -> DataFrame:
    """Overlapping and touching runs joined."""
    w = W.partitionBy("image_id", "y").orderBy("cb", "ce")
    d = r.withColumn("new", F.coalesce((F.col("cb") > F.max("ce").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    d = d.withColumn("g", F.sum("new").over(w))
    return d.groupBy("image_id", "y", "g").agg(F.min("cb").alias("cb"), F.max("ce").alias("ce")).select(*RUN)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of either region."""
    return merge(a.select(*RUN).union(b.select(*RUN)))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of both regions: an interval join by row."""
    o = b.select("image_id", "y", F.col("cb").alias("ob"), F.col("ce").alias("oe"))
    d = a.join(o, ["image_id", "y"]).where("cb < oe AND ob < ce")
    return merge(d.select("image_id", "y", F.greatest("cb", "ob").alias("cb"), F.least("ce", "oe").alias("ce")))


def complement(r: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixels of the frame (full rows as runs) outside the region."""
    w = W.partitionBy("image_id", "y").orderBy("cb")
    rows = frame.select("image_id", "y", F.col("cb").alias("fb"), F.col("ce").alias("fe"))
    m = merge(r)
    gaps = m.join(rows, ["image_id", "y"]).withColumn("pb", F.coalesce(F.lag("ce").over(w), F.col("fb")))
    inner = gaps.select("image_id", "y", F.col("pb").alias("cb"), F.col("cb").alias("ce"))
    tail = gaps.groupBy("image_id", "y").agg(F.max("ce").alias("cb"), F.max("fe").alias("ce"))
    empty = rows.join(m, ["image_id", "y"], "left_anti").select("image_id", "y", F.col("fb").alias("cb"), F.col("fe").alias("ce"))
    return inner.union(tail).union(empty).where("cb < ce").select(*RUN)


def difference(a: DataFrame, b: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixels of a outside b."""
    return intersection(a, complement(b, frame))


def shifted(r: DataFrame, dy: int, dx: int) -> DataFrame:
    """The region moved."""
    return r.select("image_id", (F.col("y") + dy).alias("y"), (F.col("cb") + dx).alias("cb"), (F.col("ce") + dx).alias("ce"))


def dilate(r: DataFrame, ry: int, rx: int) -> DataFrame:
    """Dilation by a (2 rx + 1) x (2 ry + 1) rectangle: widened runs on near rows."""
    d = r.select("image_id", F.explode(F.sequence(F.col("y") - ry, F.col("y") + ry)).alias("y"), (F.col("cb") - rx).alias("cb"), (F.col("ce") + rx).alias("ce"))
    return merge(d)


def erode(r: DataFrame, ry: int, rx: int) -> DataFrame:
    """Erosion by a rectangle: pixels whose whole rectangle lies in the region."""
    narrow = merge(r).select("image_id", "y", (F.col("cb") + rx).alias("cb"), (F.col("ce") - rx).alias("ce")).where("cb < ce")
    px = mask(narrow).select("image_id", "x", F.explode(F.sequence(F.col("y") - ry, F.col("y") + ry)).alias("y"))
    full = px.groupBy("image_id", "y", "x").count().where(F.col("count") == 2 * ry + 1)
    return runs(full.select("image_id", "y", "x"))


def _label(eight: bool):
    """Components of one image's disjoint runs by union-find; the smaller place in (row, column) order wins."""

    def run(t: pa.Table) -> pa.Table:
        y, cb, ce = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "cb", "ce"))
        order = np.lexsort((cb, y))
        y, cb, ce = y[order], cb[order], ce[order]
        # a run's neighbours are consecutive runs of the next row
        span = int(max(ce.max() - cb.min(), 1)) + 4
        at = lambda row, col: (row - y[0]) * span + (col - cb.min()) + 1
        reach = 0 if eight else 1
        first = np.searchsorted(at(y, ce), at(y + 1, cb + reach))
        last = np.searchsorted(at(y, cb), at(y + 1, ce - reach), "right")
        n = np.maximum(last - first, 0)
        a = np.repeat(np.arange(len(y)), n)
        b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parent = list(range(len(y)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        top = np.array([root(i) for i in range(len(y))])
        u = t.take(pa.array(order))
        return u.append_column("region_id", pa.array((y[top] << 32) + cb[top], pa.int64()))

    return run


def connection(r: DataFrame, eight: bool = True, tiled: bool = False) -> DataFrame:
    """Runs with ``region_id``: row * 2^32 + column of the first run of their component, unique within an image.

    An image's runs are labelled in one task, as every window over an image is
    one; ``tiled`` links runs by joins over the whole table instead, for images of
    which the runs do not fit a task. Ids of images may be of any type.
    """
    d = merge(r)
    if not tiled:
        ship(d.sparkSession)
        kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
        return d.groupBy("image_id").applyInArrow(_label(eight), ", ".join(f"{c} {kinds[c]}" for c in RUN) + ", region_id long")
    d, _ = saved(d.withColumn("id", F.monotonically_increasing_id()), "runs")
    e = 0 if eight else 1
    o = d.select("image_id", (F.col("y") - 1).alias("y"), F.col("cb").alias("ob"), F.col("ce").alias("oe"), F.col("id").alias("b"))
    links = d.join(o, ["image_id", "y"]).where((F.col("cb") <= F.col("oe") - e) & (F.col("ob") <= F.col("ce") - e)).select(F.col("id").alias("a"), "b")
    d = d.join(components(links), d["id"] == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    first = d.groupBy("root").agg(F.min(F.shiftleft(F.col("y").cast("long"), 32) + F.col("cb")).alias("region_id"))
    return d.join(first, "root").select(*RUN, "region_id")


def features(labelled: DataFrame) -> DataFrame:
    """Area, box, centroid and central moments of each region, from run sums (exact for columns up to a million)."""
    labelled = labelled.withColumns({c: F.col(c).cast("long") for c in ("y", "cb", "ce")})
    n, y = F.col("ce") - F.col("cb"), F.col("y")
    sx = (F.col("cb") + F.col("ce") - 1) * n / 2
    # sum of squares of cb .. ce - 1
    sq = lambda k: k * (k + 1) * (2 * k + 1) / 6
    sxx = sq(F.col("ce") - 1) - sq(F.col("cb") - 1)
    g = labelled.groupBy("image_id", "region_id").agg(F.sum(n).alias("area"), F.min("y").cast("int").alias("y0"), F.max("y").cast("int").alias("y1"), F.min("cb").cast("int").alias("x0"), (F.max("ce") - 1).cast("int").alias("x1"), F.sum(y * n).alias("sy"), F.sum(sx).alias("sx"), F.sum(y * y * n).alias("syy"), F.sum(sxx).alias("sxx"), F.sum(y * sx).alias("sxy"))
    a = F.col("area").cast("double")
    c = lambda s, p, q: F.col(s) / a - F.col(p) / a * (F.col(q) / a)
    g = g.select("image_id", "region_id", "area", "y0", "x0", "y1", "x1", (F.col("sy") / a).alias("row"), (F.col("sx") / a).alias("col"), c("syy", "sy", "sy").alias("m20"), c("sxx", "sx", "sx").alias("m02"), c("sxy", "sy", "sx").alias("m11"))
    return g.withColumn("rectangularity", a / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)))


def perimeter(labelled: DataFrame, eight: bool = True) -> DataFrame:
    """Number of boundary pixels: those with one of 8 (or 4) neighbours outside their region."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not a or not b)]
    px = labelled.select("image_id", "region_id", "y", F.explode(F.sequence("cb", F.col("ce") - 1)).alias("x"))
    moved = F.explode(F.array(F.struct("y", "x", F.lit(1).alias("own")), *[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), F.lit(0).alias("own")) for a, b in near])).alias("q")
    found = px.select("image_id", "region_id", moved).groupBy("image_id", "region_id", "q.y", "q.x").agg(F.max("q.own").alias("own"), F.count(F.lit(1)).alias("n"))
    return found.where(f"own = 1 AND n < {len(near) + 1}").groupBy("image_id", "region_id").agg(F.count(F.lit(1)).alias("perimeter"))


def select_shape(f: DataFrame, feature: str, lo: float, hi: float) -> DataFrame:
    """Regions with a feature in the closed range."""
    if feature not in f.columns:
        raise ValueError(f"unknown feature {feature!r}")
    return f.where(F.col(feature).between(lo, hi))


def largest(f: DataFrame, n: int) -> DataFrame:
    """The n largest regions of each image."""
    w = W.partitionBy("image_id").orderBy(F.desc("area"), "region_id")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
