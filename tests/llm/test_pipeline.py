import hashlib

import pytest

import corpus_pipeline as c
from sightline.llm import bpe, mixing, secrets, toxicity
from sightline.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similar_groups(rows):
    """Smallest id of the component of each text, by a plain comparison of all shingle sets."""
    sets = []
    for _, t in rows:
        w = "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "").encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_stages_against_plain_versions(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    kept = c.toxicity_stage(spark, docs, sf).cache()
    scorer = toxicity.Scorer(model.held.value)
    want = {r.doc_id for r in docs.collect() if model.calibrate(scorer([r.text]))[0] < 0.5}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns

    once = c.near_dedup_stage(spark, kept, sf).cache()
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    assert sorted(r.doc_id for r in once.collect()) == [rows[i][0] for i, m in enumerate(similar_groups(rows)) if i == m] and once.columns == docs.columns

    clean = c.secrets_stage(spark, once, sf).cache()
    for r in clean.collect():
        assert not secrets.base_spans(r.text) and r.n_chars >= 0
    assert clean.count() == once.count() and clean.columns == docs.columns

    mixed = c.mixing_stage(spark, clean, sf).cache()
    n = {r.id: r.copies for r in mixing.copies(clean).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: k for i, k in n.items() if k} and mixed.columns == docs.columns

    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = c.tokens_stage(spark, mixed, sf).collect()
    assert len(out) == sum(n.values())
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)
    e = bpe.Encoder(bpe.load_ranks(bpe.default_ranks()[0]), bpe.default_ranks()[1])
    assert all(r.n_tokens == sum(p[0] for p in e.chunks(texts[r.doc_id])) for r in out[:20])


LONG = " ".join(f"w{i % 900}" for i in range(30_000))
ROWS = [
    (1, "a plain text of several words", "en", "s", 29), (1, "a plain text of several words", "en", "s", 29), (1, "another text of the same id", "en", "s", 27),
    (2, None, "en", "s", None), (3, "", None, None, 0), (None, "no id, yet a text", "en", "t", 17), (None, None, None, None, None),
    (4, LONG, "en", "t", len(LONG)), (5, "password = abcdefgh12 and more words here", "en", None, 41),
]


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_nulls_ties_repeated_rows_long_texts_and_further_columns(spark, sf, rows, name):
    """Each stage on awkward rows, empty tables, and columns named like those it makes."""
    d = spark.createDataFrame([(*r, 0.5, "x", 7) for r in rows], SCHEMA + ", score double, spans string, copies int")
    out = dict(c.STAGES)[name](spark, d, sf)
    got = out.collect()
    plain = [r for r in rows]
    if name != c.STAGES[-1][0]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    key = lambda x: str(tuple(x))
    if name in ("toxicity", "secrets"):
        assert len(got) == len(plain)
    if name == "toxicity":
        assert sorted(map(key, got)) == sorted(map(key, plain))
    if name == "secrets" and rows:
        by = {(r.doc_id, r.source): r.text for r in got}
        assert by[5, None] == "<assign> and more words here" and by[2, "s"] is None and by[4, "t"] == LONG
    if name == "simhash":
        # of equal texts one stays; a null and an empty text are copies; rows without id all stay
        assert sorted(map(key, got)) == sorted(map(key, [plain[0], *plain[2:4], *plain[5:]] if rows else []))
    if name == "mixing":
        assert all(sum(tuple(r) == x for r in got) <= 2 * sum(y == x for y in plain) for x in plain)
    if name == "bpe":
        assert len(got) == len(plain) and all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r in got for i, t, *_ in plain if i == r.doc_id and i in (3, 4, 5))
