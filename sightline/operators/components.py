"""Connected components by repeated contraction, all in DataFrame joins.

Each round every node takes the smallest id among itself and its neighbours as
parent; edges are rewritten to parents of parents and those inside one node
vanish. At least half of the linked nodes vanish in a round, so there are
O(log n) rounds. Each round's tables are written to the shared folder, which
cuts lineage and survives lost executors. Nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_saved, saved


def _forest(batches):
    """A part of the edges as stars of the same local components."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in list(parent)]
    a = np.array([p for p in found if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.record_batch([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b`` (longs); root: the least id reachable.

    Null ends and self links are left out; repeated edges are harmless; no
    edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long")
    e, e_path = saved(e, "edges")
    labels, l_path = None, None
    while e.limit(1).count():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        p, p_path = saved(p, "parents")
        up = p.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        p2 = p.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        p2, p2_path = saved(p2, "grandparents")
        to = lambda c: p2.select(F.col("a").alias(c), F.col("p").alias(f"p{c}"))  # noqa: B023, E731
        rest = e.join(to("a"), "a").join(to("b"), "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        rest, rest_path = saved(rest, "edges")
        if labels is None:
            new = p2.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            new = labels.join(p2.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        new, new_path = saved(new, "labels")
        for old in (e_path, p_path, p2_path, l_path):
            if old:
                drop_saved(spark, old)
        e, e_path, labels, l_path = rest, rest_path, new, new_path
    drop_saved(spark, e_path)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")
