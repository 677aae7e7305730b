from itertools import combinations

import numpy as np

import corpus_pipeline as c
from sightline.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(a, n):
    return [f"w{a}x{i}" for i in range(n)]


def plain(rows):
    """Rows that stay: components of all pairs by a plain comparison of shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    least = list(range(len(rows)))
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while True:
        new = list(least)
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            return sorted(rows[i] for i in range(len(rows)) if least[i] == i)
        least = new


def run(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in c.near_dedup_stage(spark, d, "").collect()), key=str)


def test_stage_finds_all_pairs_of_similarity_08(spark):
    rows = []
    for k in range(12):  # edits of whole stretches: similarity from 1 down to about 0.7
        base = words(k, 200)
        for e in range(5):
            w = list(base)
            w[50:50 + 9 * e] = words(f"{k}y{e}", 9 * e)
            rows.append((len(rows), " ".join(w)))
    boiler = " ".join(words("b", 30))  # common to texts that are no copies
    rows += [(1000 + i, boiler + " " + " ".join(words(f"z{i}", 60))) for i in range(40)]
    rows += [(2000 + i, " ".join(words("h", 100 - i % 30))) for i in range(50)]
    rows += [(3000, ""), (3001, None), (3002, "one two"), (3003, "One  two"), (3004, "one three")]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_different_texts_of_one_id_stay(spark):
    a, b = " ".join(words("a", 40)), " ".join(words("b", 40))
    assert run(spark, [(5, a), (5, b), (5, b), (7, a)]) == [(5, a), (5, b)]
    assert run(spark, [(1, a), (5, a), (5, b)]) == [(1, a), (5, b)]


def test_size_filter_and_prefix():
    s = jaccard.shingles(jaccard.word_hashes(b"a b c d e f g"))
    assert len(s) == 3 and len(jaccard.prefix(s, s[:1])) == 1 and jaccard.prefix(s, s[:1])[0] == s[1]
    assert jaccard.near(10, 8, 8) and not jaccard.near(10, 7, 7)


def test_sketch_bounds_what_is_common():
    r = np.random.default_rng(1)
    for n, m, k in ((1, 1, 1), (1, 2, 1), (7, 9, 5), (500, 430, 400), (3000, 900, 20)):
        h = r.integers(0, 1 << 64, n + m - k, np.uint64)
        a, b = np.sort(h[:n]), np.sort(h[n - k:])
        assert k <= jaccard.at_most(jaccard.sketch(a), jaccard.sketch(b)) <= min(n, m)
    assert not len(jaccard.sketch(np.arange(2000, dtype=np.uint64)))
