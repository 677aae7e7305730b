import hashlib
import re

from sightline.llm import hashing, substring


def brute(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j:j + k])
            least[key] = min(least.get(key, i), i) if i is not None else least.get(key)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            m = least[tuple(w[j:j + k])]
            if i is not None and m is not None and m < i:
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **k):
    d = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, bucket int")
    return sorted((tuple(r) for r in substring.dedup_substrings(d, texts=False, **k).collect()), key=str)


def test_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(i + 5000, " ".join((t or "").split()[5:60])) for i, t in rows[:60]]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 500


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(40))
    rows = [(1, p), (1, p), (2, None), (3, ""), (4, "x\x0by z  " + p), (5, " ".join(p.split()[3:16])), (6, " ".join(p.split()[3:15])), (None, p), (9, "a " * 50), (8, "a " * 30), (-3, "q r " + p)]
    got = run(spark, rows)
    assert got == brute(rows)


def test_texts_and_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e"), (2, "z a b c d")], "doc_id long, text string")
    got = {r.id: r.kept for r in substring.dedup_substrings(d, window=3).collect()}
    assert got == {1: "a b c d e", 2: "z"}
    assert substring.dedup_substrings(d.limit(0)).collect() == []


def test_long_text_is_hashed_in_parts(monkeypatch):
    data = ("word soup é " * 500).encode()
    whole = hashing.word_hashes(data)
    monkeypatch.setattr(hashing, "CHUNK", 37)
    assert (hashing.word_hashes(data) == whole).all() and len(whole) == 1500


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words and their complements agree in every polynomial hash modulo 2^64; they are different words."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    p = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([a, *p])), (2, " ".join([b, *p])), (3, " ".join([a, *p])), (4, " ".join([*p, a[:200]])), (5, " ".join([*p, b[:200]]))]
    got = run(spark, rows)
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 13, 0, 0]


def test_windows_with_equal_first_hash_are_told_apart():
    import numpy as np

    h, g = np.array([3, 5, 5, 9], np.uint64), np.array([1, 1, 2, 1], np.uint64)
    s, z = np.array([5, 5, 5, 9, 4], np.uint64), np.array([2, 1, 7, 1, 1], np.uint64)
    assert substring._told(h, g, s, z).tolist() == [2, 1, -1, 3, -1]
    order, at = substring._groups(np.array([5, 5, 5], np.uint64), np.array([2, 1, 2], np.uint64))
    assert order.tolist() == [1, 0, 2] and at.tolist() == [0, 1]


def test_very_long_text_against_brute_force(spark):
    rows = [(1, " ".join(f"u{i % 5000}" for i in range(60_000))), (2, " ".join(f"u{i}" for i in range(4000, 5200))), (3, "x" * 300_000 + " " + " ".join(f"u{i}" for i in range(4990)))]
    assert run(spark, rows) == brute(rows)
