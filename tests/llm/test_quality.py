import math
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import quality as q

SF = "/root/testdata/sf0.1"


def plain(rows):
    """Rates and scores of (host, path, evidence) rows, reckoned plainly."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, w, p in rows:
        hosts[h].append(p)
        paths[h, w].append(p)
    every = [p for _, _, p in rows]
    rate, n = np.mean(every), len(rows)
    within = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in paths.values()) / (n - len(paths)) if n > len(paths) else 0.0

    def strength(groups, parent):
        between = sum(len(x) * (np.mean(x) - np.mean(parent(k))) ** 2 for k, x in groups.items())
        free = sum(len(x) - len(x) ** 2 / len(parent(k)) for k, x in groups.items())
        kinds = sum(1 - len(x) / len(parent(k)) for k, x in groups.items())
        if not free or within <= 0:
            return 100.0
        return min(max(within / max((between - kinds * within) / free, 1e-9), 1.0), 1e4)

    kh, kp = strength(hosts, lambda k: every), strength(paths, lambda k: hosts[k[0]])
    lo = lambda x: math.log(x / (1 - x))
    out = []
    for h, w, p in rows:
        host = (sum(hosts[h]) - p + kh * rate) / (len(hosts[h]) - 1 + kh)
        path = (sum(paths[h, w]) - p + kp * host) / (len(paths[h, w]) - 1 + kp)
        out.append((host, path, 1 / (1 + math.exp(-(lo(p) + lo(path) - lo(rate))))))
    return out


def test_held_out_accuracy_and_posteriors_against_plain_sums(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    d = d.join(y.select("doc_id"), "doc_id").repartition(8).cache()
    truth = {r.doc_id: r.quality for r in y.collect()}
    got = sorted(q.classify(d, y).collect())
    assert len(got) == len(truth)
    held = [r for r in got if zlib.crc32(str(r.id).encode()) % 5 == 0]
    z, k = np.array([truth[r.id] for r in held]), np.array([r.keep for r in held])
    assert (z == k).mean() > 0.93 and k[z == 1].mean() > 0.97
    site = {r.doc_id: (r.source, r.lang) for r in d.select("doc_id", "source", "lang").collect()}
    want = plain([(*site[r.id], r.evidence) for r in got])
    np.testing.assert_allclose([(r.host_rate, r.path_rate, r.score) for r in got], want, atol=1e-6)


def test_sites_move_scores_and_a_lone_document_does_not_vote_for_itself(spark):
    words = "the plain words of a text that says something about many other things, and more of it. "
    rows = [(i, words * 3 + f"number {i} of them", f"h{i % 4}", f"p{i % 3}", 1) for i in range(240)]
    rows += [(i, "zzz " * 40 + "!!! 777 " * 20, "bad", f"p{i % 3}", 0) for i in range(240, 400)]
    rows += [(1000, words * 2 + "zzz zzz", "bad", "p1", 1), (1001, words * 2 + "zzz zzz", "h1", "p1", 1), (1002, words * 2 + "zzz zzz", "alone", "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, y int")
    got = {r.id: r for r in q.classify(d, d.select("doc_id", F.col("y").alias("quality"))).collect()}
    assert got[1000].evidence == got[1001].evidence == got[1002].evidence
    assert got[1000].score < got[1002].score < got[1001].score
    assert abs(got[1002].score - got[1002].evidence) < 1e-9  # the prior is the global rate


def test_hosts_and_paths_of_urls(spark):
    urls = ["https://blog.X.example.com/en/12?x=/a/b", "http://u:p@h.example.org:8080/fr/de/3#top", "https://e.example", "https://e.example/12.html", "no url", None]
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in d.select(q.host_of(F.col("url")), q.path_of(F.col("url"))).collect()]
    assert got == [("blog.x.example.com", "en"), ("h.example.org", "fr"), ("e.example", ""), ("e.example", ""), (None, ""), (None, None)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = q.classify(pages, labels, host=q.host_of(F.col("url")), path=q.path_of(F.col("url")))
    assert got.count() == 2500 and got.select("path_rate").distinct().count() > 20


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b", None, "en", 1.0), (1, "a b", None, "en", 1.0), (2, None, "s", None, 1.0), (None, "", "s", None, 1.0), (3, "x " * 90_000, "s", "en", 1.0)], "doc_id long, text string, source string, lang string, score double")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (3, None)]):
        y = spark.createDataFrame(labels, "doc_id long, quality int")
        got = q.classify(d, y).collect()
        assert len(got) == 5 and all(0 < r.score < 1 for r in got)
    assert q.classify(d.limit(0), y).collect() == []
