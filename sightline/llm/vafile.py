"""Exact top-k inner products with vector-approximation files.

Components are turned into integers floor(256 x). The approximation keeps for
each component only which of 16 cells it lies in; the cells' edges bound every
inner product. A block of vectors is searched for a block of queries by
scanning its approximations (two matrix products give all upper bounds), then
reading exact vectors in the order of their bounds until the kth best score is
above every bound left. Scores and the order of ties are exact.

How it runs. Vectors and queries (a stated set) are dealt into blocks by hashes,
and each pair of blocks is one cell of a grid: a task holds ``BLOCK`` vectors and
``QUERIES`` queries whatever the tables' sizes. A cell returns its k best for a
query, and the k best of those are taken. Work is queries times vectors, as the
contract states all rows as candidates, in blocks of matrix products; a query
travels once for each block of vectors, a vector once for each of queries.

Cases. Vectors null, empty, or with a null or non-finite component take no part.
Only vectors of equal length meet. A query is not its own candidate: rows of its
id are left out. Repeated ids are candidates of their own, and each query row has
k results of its own. Null ids take no part. Empty tables give empty results; no
text is read, and further columns never clash. Fewer than k candidates: all. Ties go to the smaller id. Large components are reckoned with as
Python integers; a score among the k best that does not fit a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship, table

CELL_BITS = 4
#: Vectors and queries of a cell, and queries searched at once.
BLOCK, QUERIES, AT_ONCE = 8192, 8192, 256


class Approximation:
    """The approximation file of a block: a cell number for every component."""

    def __init__(self, x: np.ndarray):
        n = 1 << CELL_BITS
        self.edges = np.quantile(x, np.linspace(0, 1, n + 1), axis=0, method="lower")
        self.cells = np.zeros(x.shape, np.uint8)
        for e in self.edges[1:-1]:
            self.cells += x > e
        # a cell's least and greatest value, whatever the quantiles were
        self.low, self.high = np.zeros((n, x.shape[1])), np.zeros((n, x.shape[1]))
        for c in range(n):
            inside = self.cells == c
            self.low[c] = np.where(inside, x, np.inf).min(axis=0)
            self.high[c] = np.where(inside, x, -np.inf).max(axis=0)

        dims = np.arange(x.shape[1])
        # what the cells' edges are for each vector
        self.from_, self.to = self.low[self.cells, dims].T, self.high[self.cells, dims].T
        self.size = np.maximum(np.abs(self.from_), np.abs(self.to))

    def slack(self, q: np.ndarray) -> np.ndarray:
        """For all queries and vectors, more than the rounding of their bound: its terms may cancel."""
        return 1e-9 * (np.abs(q) @ self.size) + 1e-6

    def upper(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of all queries (rows) and vectors."""
        return np.maximum(q, 0) @ self.to + np.minimum(q, 0) @ self.from_


def _exact(x: np.ndarray) -> np.ndarray:
    """As doubles, if every product sum is below 2^53, else as Python integers."""
    return x if not x.size or float(np.abs(x).max()) ** 2 * x.shape[1] < 2.0**53 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, vector id, score) of each query's k best in the block."""
    out = []
    both = _exact(np.concatenate([x, q]))
    ex, eq = both[:len(x)], both[len(x):]
    va = Approximation(x)
    for s in range(0, len(q), AT_ONCE):
        bounds = va.upper(q[s:s + AT_ONCE]) + va.slack(q[s:s + AT_ONCE])
        for i, bound in enumerate(bounds):
            order = np.argsort(-bound)
            best_id, best, at, step = np.empty(0, np.int64), np.empty(0, ex.dtype), 0, 4 * k
            while at < len(order):
                if len(best) >= k and bound[order[at]] < best[k - 1]:
                    break  # no vector left can reach the kth result
                rows = order[at:at + step]
                rows = rows[ids[rows] != q_ids[s + i]]
                all_id, all_score = np.append(best_id, ids[rows]), np.append(best, ex[rows] @ eq[s + i])
                top = sorted(range(len(all_id)), key=lambda j: (-all_score[j], all_id[j]))[:k] if ex.dtype == object else np.lexsort((all_id, -all_score))[:k]
                best_id, best = all_id[top], all_score[top]
                at, step = at + step, 2 * step
            out += [(s + i, int(v), int(z)) for v, z in zip(best_id, best, strict=True)]
    return out


def _block(k: int):
    def run(key, vectors, queries):
        kinds = lambda t: (t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("q").combine_chunks())
        found = []
        if vectors.num_rows and queries.num_rows:
            vi, vn, vq = kinds(vectors)
            qi, qn, qq = kinds(queries)
            copy = queries.column("copy").to_numpy()
            pick = lambda a, m, n: a.filter(pa.array(m)).flatten().to_numpy().astype(np.float64).reshape(-1, n)
            for n in np.unique(qn):
                a, b = vn == n, qn == n
                if a.any():
                    own, nth = qi[b], copy[b]
                    found += [(int(own[i]), int(nth[i]), v, z) for i, v, z in search(vi[a], pick(vq, a, n), own, pick(qq, b, n), k)]
        cols = list(zip(*found, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "copy", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all rows for every query row."""
    ship(vectors.sparkSession)
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("id").isNotNull()
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), is_query.alias("is_query"), v.alias("v")).where(ok)
    d = d.select("id", "is_query", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("q"), F.size("v").alias("n"))
    n = d.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("is_query"), 1)).alias("asked")).first()
    blocks, asking = max(1, -(-n["all"] // BLOCK)), max(1, -(-n["asked"] // QUERIES))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k, *by: F.pmod(F.xxhash64(*by), F.lit(k)).cast("int")
    all_v = d.select("id", "q", "n", dealt(blocks, "id", "q").alias("block"), each(asking).alias("part"))
    queries = d.where("is_query").withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("q")).cast("long"))
    asked = queries.select("id", "copy", "q", "n", dealt(asking, "id", "copy").alias("part"), each(blocks).alias("block"))
    best = all_v.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_block(k), "query_id long, copy long, vec_id long, score long")
    w = W.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the 5 best of all ``embeddings`` for every row whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q) AS copy FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT a.vec_id AS query_id, copy, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, copy ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
