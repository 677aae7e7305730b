import random
import re

import xxhash
from pyspark.sql import functions as F

from sightline.llm import simhash
from sightline.operators import components


def brute_fp(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fp)."""
    ids = [r[0] for r in rows]
    root = {i: i for i in ids}
    changed = True
    near = [(a, b) for a, x in rows for b, y in rows if (x ^ y).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one  TWO"), (9005, "É a b c")]
    rows += [(10000 + i, t + " extra tail") for i, t in rows[:40]]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(d).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    assert {i: x for i, (x, _) in got.items()} == dict(fps)
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)
    assert len({c for _, c in got.values()}) < len(rows) - 20


def test_covering_family_finds_every_pair():
    r, m = random.Random(1), simhash.masks(3)
    assert len(m) == 15
    for _ in range(4000):
        diff = sum(1 << i for i in r.sample(range(64), r.randint(0, 3)))
        assert any(x & diff == 0 for x in m)


def test_large_groups_are_dealt_again(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = list({base ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for _ in range(260)} | {r.getrandbits(64) for _ in range(50)})
    rows = [(i, x) for i, x in enumerate(fps)]
    nodes = spark.createDataFrame([(simhash._signed(x), i) for i, x in rows], "fp long, node long")
    want = brute_components(rows)
    for large in (20, 2000):
        got = dict(map(tuple, components.components(simhash.links(nodes, large=large)).collect()))
        assert {i: got.get(i, i) for i, _ in rows} == want


def test_nulls_and_empty(spark):
    d = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "zz yy xx")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(d).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert simhash.near_duplicates(d.limit(0)).collect() == []


def test_chain(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.components(e).collect()} == {0}


def test_a_group_of_20000_near_equal_fingerprints(spark, monkeypatch):
    """Most share all masks of some table; no task holds more than ``large`` of a group before the last deal."""
    r = random.Random(9)
    base = r.getrandbits(64)
    fps = list({base ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for _ in range(22_000)})[:20_000]
    far = [base ^ ((1 << 64) - 1) ^ sum(1 << i for i in r.sample(range(64), 20)) for _ in range(20)]
    nodes = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(fps + far)], "fp long, node long")
    got = dict(map(tuple, components.components(simhash.links(nodes, large=1000)).collect()))
    near = {i for i, x in enumerate(fps) if (x ^ base).bit_count() <= 3}
    assert len({got.get(i, i) for i in near}) == 1 and len(near) > 5_000
    assert all(got.get(len(fps) + i, len(fps) + i) == len(fps) + i for i in range(20) if min((far[i] ^ x).bit_count() for x in far[:i] + far[i + 1:]) > 3)


def test_large_groups_are_passed_on_in_parts():
    import numpy as np
    import pyarrow as pa

    def batches():
        for i in range(50):
            n = np.arange(i * 100, i * 100 + 100)
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (n * 0 + 2, n * 0 + 7, n, n)], names=["t", "key", "fp", "node"])
        yield pa.record_batch([pa.array(np.array(x)) for x in ([2, 2], [8, 8], [1, 3], [11, 10])], names=["t", "key", "fp", "node"])

    out = list(simhash._grouped(3, 1000)(batches()))
    assert max(b.num_rows for b in out) <= 1100 and sum(b.num_rows for b in out) == 5001
    assert [r for b in out for r in b.to_pylist() if r["t"] < 0] == [{"t": -1, "a": 11, "b": 10}]


def test_very_long_text_and_clashing_columns(spark):
    t = " ".join(f"w{i % 3000}" for i in range(70_000))
    d = spark.createDataFrame([(1, t, 0, 0), (2, t, 0, 0), (3, None, 0, 0)], "doc_id long, text string, fp int, component_id int")
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {1: (brute_fp(t), 1), 2: (brute_fp(t), 1), 3: (0, 3)}
