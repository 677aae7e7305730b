"""Quality classifier: hierarchical empirical Bayes.

A logistic regression on surface features of the text, trained on labelled
rows, gives each document its evidence p. Hosts and paths then get posteriors
by grouped sums: a path's rate is shrunk toward its host's, a host's toward the
global one. The strengths follow from the analysis of variance of the evidence:
pseudo-counts are the variance within groups by that between the groups of one
parent, so sites that differ little are shrunk much, and sparse ones most. A
document's score is its evidence with the prior odds of its site in place of the
global odds. Its own evidence is taken out of its site's sums first, so it
does not count twice; a document alone on its host has the global rate as prior.

How it runs. The evidence is computed once and written; hosts and paths are
grouped aggregates with partial sums, so a hot host costs one row a task. The
strengths are a few numbers. At most ``SAMPLE`` labelled rows train the
regression; every document is scored whole.

Sites. :func:`host_of` and :func:`path_of` read them from a url column. The table
``documents`` has no urls: there the query takes a document's source as its host
and its language as the path.

Cases. Null or empty text: features of an empty text; very long texts are read
whole. Null host or path: a group of its own. Null ids are passed on, repeated
rows are documents of their own. Null labels are skipped. Without labels of both
classes the evidence is the labelled share (1 without labels). A score of exactly
``keep_at`` is kept. Empty tables give empty results. Only the named columns are
read, so further columns never clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_saved, saved, ship, table
from .logistic import Logistic
from .toxicity import labelled_sample

SAMPLE = 8000
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 space, 2 letter, 3 capital, 4 digit, 5 stop or comma; bytes from 128: letters
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123] = _CLASS[128:] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[44, 46, 39, 45]] = 5
FEATURES = 11


def surface(text: str) -> list[float]:
    """Features of a whole text."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * FEATURES
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6)
    size, solid, k = len(data), max(1, len(data) - n[1]), len(words)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [np.log1p(k), size / k, n[0] / solid, n[3] / solid, n[4] / solid, n[5] / solid, same / k, len(counts) / k ** 0.8, max(counts.values()) / k, 1 - len(set(lines)) / len(lines), sum(not _CLASS[w[-1]] for w in words) / k]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and roots: one bend a feature."""
    return np.column_stack([x, x**2, np.sqrt(np.abs(x))])


def _surfaces(texts) -> np.ndarray:
    return _expand(np.array([surface(t or "") for t in texts]).reshape(-1, FEATURES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE):
    """The regression and the labelled share of good documents (no regression if a class is missing)."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            f = np.array([surface(t or "") for t in b.column(0).to_pylist()]).reshape(-1, FEATURES)
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(c)) for c in f.T), b.column(1)], names=[*(f"f{i}" for i in range(FEATURES)), "y"])

    d = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    t = labelled_sample(d, labels, "quality", id_col, most).select("text", "y").mapInArrow(run, ", ".join([*(f"f{i} double" for i in range(FEATURES)), "y int"])).toArrow()
    x, y = np.column_stack([t.column(f"f{i}").to_numpy() for i in range(FEATURES)]), t.column("y").to_numpy().astype(float)
    order = np.lexsort(np.column_stack([y, x]).T)
    share = float(y.mean()) if len(y) else 1.0
    return (Logistic(_expand(x[order]), y[order]) if 0 < y.sum() < len(y) else None), share


def evidence(docs: DataFrame, model, share: float, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """``id, host, path, p``."""
    ship(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            p = model(_surfaces(b.column(3).to_pylist())) if model is not None else np.full(b.num_rows, share)
            yield pa.record_batch([*b.columns[:3], pa.array(np.clip(p, 1e-6, 1 - 1e-6))], names=["id", "host", "path", "p"])

    return d.mapInArrow(run, "id long, host string, path string, p double")


def host_of(url: Column) -> Column:
    """The host of a url, lowered, without user and port; null for what is no url."""
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def path_of(url: Column) -> Column:
    """The first directory of a url's path; empty if it has none."""
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)


def strength(groups: DataFrame, within: float) -> float:
    """Pseudo-counts of the prior of groups ``n, s`` with parents' sums ``pn, ps``: the variance within by that between."""
    m = F.col("s") / F.col("n") - F.col("ps") / F.col("pn")
    r = groups.agg(F.sum(F.col("n") * m * m).alias("between"), F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("pn")).alias("free"), F.sum(1 - F.col("n") / F.col("pn")).alias("kinds")).first()
    if not r.free or within <= 0:
        return 100.0
    spread = (r.between - r.kinds * within) / r.free  # what chance alone would give taken off
    return float(min(max(within / max(spread, 1e-9), 1.0), 1e4))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, keep_at: float = 0.5) -> DataFrame:
    """``id, evidence, host_rate, path_rate, score, keep`` of every document; the rates are without its own evidence."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model, share = train(docs, labels, id_col, text_col)
    e, _ = saved(evidence(docs, model, share, id_col, text_col, host, path), "evidence")
    paths, p_path = saved(e.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.count(F.lit(1)).alias("g")).first()
    rate = total.s / total.n if total.n else share
    within = (total.q - total.ss) / (total.n - total.g) if total.n and total.n > total.g else 0.0
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("w"), "n", "s", "hn", "hs")
    sites, _ = saved(both, "sites")
    kh = strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s"), F.lit(total.n or 1).alias("pn"), F.lit(total.s or 0.0).alias("ps")), within)
    kp = strength(sites.select("n", "s", F.col("hn").alias("pn"), F.col("hs").alias("ps")), within)
    out = e.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("w")))
    drop_saved(docs.sparkSession, p_path)
    p, odds = F.col("p"), lambda c: F.log(c / (1 - c))
    held = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("host_rate", held((F.col("hs") - p + kh * rate) / (F.col("hn") - 1 + kh)))
    out = out.withColumn("path_rate", held((F.col("s") - p + kp * F.col("host_rate")) / (F.col("n") - 1 + kp)))
    z = odds(p) + odds(F.col("path_rate")) - odds(F.lit(float(min(max(rate, 1e-6), 1 - 1e-6))))
    score = 1 / (1 + F.exp(-z))
    return out.select("id", p.alias("evidence"), "host_rate", "path_rate", score.alias("score"), (score >= keep_at).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: posteriors of the whole ``documents``; hosts are sources, paths their languages."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
