import weakref

import pyarrow as pa

from sightline.llm import bpe, resident, toxicity


def test_a_worker_keeps_nothing_of_other_operators():
    """The encoder of an earlier stage is gone when toxicity counts in the same worker."""
    ranks = {bytes([i]): i for i in range(256)}
    e = weakref.ref(bpe._encoder(ranks, r"\S+|\s+"))
    assert e() is bpe._encoder(ranks, r"\S+|\s+")
    b = pa.record_batch([pa.array(["ab cd", "ab"]), pa.array([0, 1])], names=["text", "y"])
    out = pa.Table.from_batches(toxicity._counter(None)(iter([b]))).to_pylist()
    assert sorted((r["key"], r["n0"], r["n1"]) for r in out) == [("ab", 1, 1), ("cd", 1, 0)]
    assert e() is None


def test_an_operator_keeps_what_it_made():
    made = resident.kept("x", 1, object)
    assert list(resident.lean("x")(iter)([1, 2])) == [1, 2]
    assert resident.kept("x", 1, object) is made and resident.kept("x", 2, object) is not made
    assert list(resident.lean()(iter)([])) == [] and not resident._KEPT


def test_batches_are_given_on_in_small_parts():
    b = pa.record_batch([pa.array(range(1234))], names=["x"])
    got = list(resident.parts(iter([b, b.slice(0, 0)])))
    assert [p.num_rows for p in got] == [500, 500, 234] and pa.Table.from_batches(got).to_pydict() == b.to_pydict()


def test_words_in_use_outlive_rare_ones(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    e = bpe.Encoder({bytes([i]): i for i in range(256)}, r"\S+|\s+")
    for i in range(100):
        assert [p[2] for p in e.chunks(f"ab{i}")] == [f"ab{i}".encode()] and e.chunks("ab")[0][0] == 2
        assert "ab" in e.known and len(e.known) + len(e.older) <= 20
