"""Mixing sources to target weights by systematic sampling, without Python.

Every document of a source expects the same number of copies, target / size of
the source, at most two. The documents of a source stand in the order of their
size (ties by a hash of the id), expected copies are summed along that order,
one offset is added, and a copy is emitted for each integer boundary crossed.
As neighbours in that order have near sizes, the words taken from a source miss
its target by about one document's size at most.

How it runs. The place in the order comes from counts, never from one sorted
source: counts by (source, size, hash range) are summed to counts by (source,
size), whose running sum has one row for each distinct size; documents are only
ranked within a (source, size, hash range) cell. A hot source or one size that
a third of all documents share is thus spread over 4096 cells a size. Offsets
and order follow from md5, so reruns agree on any cluster.

Cases. Null or empty text: size 0, never counted as words but placed like any
other document. Null source: a source of its own, last. A source without words
has target 0; if there are no words at all, every target is 0. Null ids sort
first and count; rows of one id have one place in the order and are numbered
there, so a third of all rows under one id (or none) and of one size share a
task's window. Equal rows are documents of their own. Very long texts are counted
whole. Empty tables give empty results. Further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import saved, table

WEIGHTS = (5, 2, 1)
#: Words of the mix to words of the corpus, and most copies of a document.
SHARE, MOST = 1.5, 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: shares of the total by weight, none above ``most`` sizes.

    The excess of capped sources is reshared by weight until none is above.
    That level is found at once: sources are ordered by most * size / weight,
    and the first that stays below the level of what those before it leave sets
    it. One row a source is all that this reads.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") % len(weights)).cast("int") + 1)
    s = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    s = s.withColumn("cap", (F.col("source_size") * most).cast("long")).withColumn("turn", F.col("cap") / F.col("w"))
    order = W.orderBy("turn", "n")
    whole = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = F.min(F.when(F.col("turn") >= F.col("level"), F.struct("turn", "n", "level"))).over(whole)["level"]
    return s.withColumn("water", level).select("source", "source_size", F.when(F.col("water").isNull() | (F.col("turn") < F.col("water")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("water")).alias("target"))


def _unit(x: Column, digits: int = 8) -> Column:
    """A number from 0 below 1 out of a string's md5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, digits), 16, 10).cast("double") / float(16**digits)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, size, source, source_size, target, copies`` of every document, and the columns ``keep`` as a struct ``row``."""
    name = lambda c: F.col(f"`{c}`")
    d = docs.select(name(id_col).cast("long").alias("id"), n_words(name(text_col)).alias("size"), name(source_col).cast("string").alias("source"), *([F.struct(*[name(c) for c in keep]).alias("row")] if keep else []))
    d = d.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))).withColumn("cell", F.substring("h", 1, 3))
    light = d.drop("row") if keep else None
    if not keep:  # sizes are counted once; what follows reads a few numbers a document
        light = d = saved(d, "sizes")[0]
    cells = light.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = by_size.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1))).select("source", "size", "before")
    t = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    at = cells.withColumn("within", F.sum("n").over(W.partitionBy("source", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)))
    at = at.join(before.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "before"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")))
    at = at.join(t.select(F.col("source").alias("s2"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s2")))
    at = at.select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.col("cell").alias("c3"), (F.coalesce("within", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("first"), "source_size", "target")
    d = d.withColumn("place", F.row_number().over(W.partitionBy("source", "size", "cell").orderBy("h", "id")) - 1)
    d = d.join(at, F.col("source").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3")) & (F.col("cell") == F.col("c3")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(f"{seed}:source:"), F.coalesce("source", F.lit(""))))
    place = F.col("first") + F.col("place")
    n = F.floor(offset + (place + 1) * rate) - F.floor(offset + place * rate)
    return d.select("id", "size", "source", "source_size", "target", n.cast("long").alias("copies"), *(["row"] if keep else []))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken."""
    cols = tuple(docs.columns)
    c = copies(docs, keep=cols, **kw).where("copies > 0")
    return c.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "row").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    c = copies(table(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2 AS cap, [5, 2, 1][n % 3 + 1] AS w FROM s
), k AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS turn FROM c
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY turn, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY turn, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k
), t AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR turn < water THEN CAST(cap AS DOUBLE) ELSE w * water END AS target
  FROM (SELECT *, (SELECT arg_min(level, turn) FROM l WHERE turn >= level) AS water FROM l)
), p AS (
  SELECT d.doc_id, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, h, doc_id) - 1 AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:source:' || coalesce(d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS o
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(o + (place + 1) * rate) - floor(o + place * rate) AS BIGINT) AS taken FROM p
"""
