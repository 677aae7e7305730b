import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sightline.llm import toxicity as t

SF = "/root/testdata/sf0.1"
part = lambda i: zlib.crc32(str(i).encode()) % 5


def test_held_out_accuracy_in_every_language(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    d = d.join(y.select("doc_id"), "doc_id").repartition(8).cache()
    truth, lang = {r.doc_id: r.toxic for r in y.collect()}, {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = [r for r in t.scores(d, t.train(d, y)).collect() if part(r.doc_id) == 0]
    caught, wrong, toxic = Counter(), Counter(), Counter()
    for r in got:
        toxic[lang[r.doc_id]] += truth[r.doc_id]
        caught[lang[r.doc_id]] += truth[r.doc_id] and r.score >= 0.5
        wrong[lang[r.doc_id]] += not truth[r.doc_id] and r.score >= 0.5
    assert len(got) > 500 and sum(wrong.values()) <= 0.005 * len(got)
    assert sum(caught.values()) >= 0.92 * sum(toxic.values())
    assert all(caught[x] >= 0.85 * n for x, n in toxic.items()), (caught, toxic)


def brute(rows):
    """Plain counts of all nodes, as (n0, n1) by node, contexts' totals and kinds, distinct words by node."""
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for text, y in rows:
        w = t.words_of(text)
        words[y].update(set(w))
        pairs[y].update({b + t.END + a for a, b in zip(w, w[1:], strict=False)})
    n, v, child = defaultdict(lambda: [0, 0]), Counter(), defaultdict(set)
    for w in words[0].keys() | words[1].keys():
        parent = ""
        for k, x in enumerate(t.path(w)):
            parent = w[:k]
            n[x][0] += words[0][w]
            n[x][1] += words[1][w]
            v[x] += 1
            child[parent].add(x)
    p = {}
    for parent, xs in child.items():
        m, kinds, mv = [sum(n[x][y] for x in xs) for y in (0, 1)], [sum(n[x][y] > 0 for x in xs) for y in (0, 1)], sum(v[x] for x in xs)
        for x in xs:
            s = v[x] / mv
            p[x] = [(max(n[x][y] - t.DISCOUNT, 0) + t.DISCOUNT * kinds[y] * s) / m[y] if m[y] else s for y in (0, 1)], [n[x][0], n[x][1], *m]
        for y in (0, 1):
            assert abs(sum(p[x][0][y] for x in xs) - 1) < 1e-9  # a proper distribution
    by_word = defaultdict(list)
    for x in pairs[1]:
        by_word[x.split(t.END)[0]] += [x] * (pairs[1][x] >= t.PAIR)
    for w, named in by_word.items():
        rest = [max(words[y][w] - sum(pairs[y][x] for x in named), 0) for y in (0, 1)]
        m = [sum(pairs[y][x] for x in named) + rest[y] for y in (0, 1)]
        kinds = [sum(pairs[y][x] > 0 for x in named) + (rest[y] > 0) for y in (0, 1)]
        for x in named:
            s = 1 / (len(named) + 1)
            p[x] = [(max(pairs[y][x] - t.DISCOUNT, 0) + t.DISCOUNT * kinds[y] * s) / m[y] if m[y] else s for y in (0, 1)], [pairs[0][x], pairs[1][x], *m]
    return p


def statistic(a, b, m0, m1):
    term = lambda x, whole, one, n: x * math.log(x * n / (whole * one)) if x else 0.0
    n, k = m0 + m1, a + b
    return 2 * (term(a, m0, k, n) + term(b, m1, k, n) + term(m0 - a, m0, n - k, n) + term(m1 - b, m1, n - k, n))


def test_nodes_against_plain_counts(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").select("text", "toxic")
    rows = [(r.text, r.toxic) for r in d.collect()]
    want = {}
    for x, (p, (n0, n1, m0, m1)) in brute(rows).items():
        r = math.log(p[1] / p[0])
        if n0 + n1 >= t.LEAST and statistic(n0, n1, m0, m1) >= t.CLEAR and abs(r) >= t.FACTOR:
            want[x] = r
    from sightline.session import ship

    ship(spark)
    frame = spark.createDataFrame(rows, "text string, y int")
    got = {r.node: r.ratio for r in t.nodes_of(frame).collect()}
    assert len(want) > 8 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(t, "PAIRS", 0)  # too many pairs to broadcast: all are counted
    assert {r.node: r.ratio for r in t.nodes_of(frame).collect()} == pytest.approx(got)


def plain(nodes, text):
    w = t.words_of(text)
    own = lambda k: sum(nodes.get(x, 0.0) for x in t.path(k))
    best, total = {}, 0.0
    for u, k in zip(["", *w], w, strict=False):
        e = own(k) + (nodes.get(k + t.END + u, 0.0) if u else 0.0)
        total += e
        best[k] = max(best.get(k, own(k)), e)
    return [*sorted([*best.values(), *[0.0] * t.TOP], reverse=True)[:t.TOP], total / len(w) if w else 0.0]


NODES = {"th": 0.5, "a": -0.3, "tion\3": 0.9, "the\3of": 1.5, "dis": 2.0, "an\3": -1.0, "é": 1.1, "xxxxxxxx": 0.4, "a\3the": -2.0}
TEXTS = ["of the nation, of the discard", "an a an", "", None, "x" * 100 + "the", "12 __ ²the İSTANBUL Été", "the " * 30, "a\nof\nthe", "z" * 3_000_000 + " dis", "of the a. of a the \U0001d400dis"]


def test_scan_equals_plain_reading_and_joins(spark):
    scorer, want = t.Scorer(NODES), np.array([plain(NODES, x) for x in TEXTS])
    np.testing.assert_allclose(scorer(TEXTS), want, atol=1e-12)
    d = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)], "doc_id long, text string, e0 string")
    nodes = spark.createDataFrame(list(NODES.items()), "node string, ratio double")
    got = sorted(t.features(d, nodes, None, "text", ("doc_id",)).collect())
    np.testing.assert_allclose([r[1:] for r in got], want, atol=1e-9)


@pytest.mark.parametrize("labelled", [[], [(1, 0, 1), (2, 0, 1)], [(1, 1, 1), (1, None, None), (None, 1, 1)]])
def test_edges(spark, labelled):
    d = spark.createDataFrame([(1, "a b", 1.0), (1, "a b", 1.0), (2, None, 1.0), (None, "", 1.0), (3, "12 !!", 1.0), (4, "x" * 200, 1.0)], "doc_id long, text string, score double")
    y = spark.createDataFrame(labelled, "doc_id long, toxic int, quality int")
    got = t.scores(d, t.train(d, y)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert t.scores(d.limit(0), t.train(d, y)).collect() == []


def test_all_labelled_rows_are_counted_and_phrases_are_learnt(spark, monkeypatch):
    """Twenty insults by turns, and a phrase of two harmless words; the bound is for the calibration alone."""
    insult = lambda i: "".join("bdfgklmprt"[int(c)] + "aeiou"[int(c) % 5] for c in str(7919 * (i % 20 + 1000)))
    rows = [(i, f"words of plain text {insult(i // 2) if i % 2 else 'more'} of plain {'text words' if i % 4 < 3 else 'words text'} {'some body' if i % 2 else 'body then some'}", i % 2) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = t.train(d, d.select("doc_id", "toxic"), most=20)
    n = Counter(part(i) in (1, 2, 3) for i, _, y in rows if y)
    scorer = t.Scorer(model.held.value)
    assert n[True] > 300 and min(scorer.word(insult(i)) for i in range(20)) > 3 > 0.7 > abs(scorer.word("plain"))
    phrase, parted = scorer(["some body", "body then some"])[:, 0]
    assert phrase > parted + 0.7
    got = {r.doc_id: r.score for r in t.scores(d, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    joined = {r.doc_id: r.score for r in t.scores(d, t.train(d, d.select("doc_id", "toxic"), most=20, broadcast=0)).collect()}
    assert joined == pytest.approx(got)
