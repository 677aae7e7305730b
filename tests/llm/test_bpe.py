import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sightline.llm import bpe

PATH, PATTERN = bpe.default_ranks()
RANKS = bpe.load_ranks(PATH)
TK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", None, " ", "  x", "a  b\n\n c \t\r\n", "it's I'LL we'd 's'", "x\x85y\x1cz\x1f 　 k", "日本語 １２ ٣٤ ½", "🙂🙂 é ‍", "<|endoftext|>", "a" * 3000, "ab" * 2500, " \n" * 40, "Ünï-cödé!!??  ...", " x ", "'re're", " 's"]


def test_against_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (None, "x y")]
    d = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, ids int")
    want = []
    for i, t in rows:
        ids = TK.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(d, PATH, PATTERN).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(d.limit(0), PATH, PATTERN).collect() == []


def test_round_trip_in_frames(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    e = bpe.encode(d, PATH, PATTERN)
    got = {r.doc_id: (r.ids, bytes(r.bytes)) for r in bpe.decode(e, PATH).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == (TK.encode_ordinary(t or ""), (t or "").encode())


def test_higher_order_fold(spark):
    words = [b" the", b"xyzzy", " né".encode(), b"a", b"thing"]
    d = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    got = {bytes(r.word): r.ids for r in bpe.encode_words(d, PATH).collect()}
    assert got == {w: bpe.fold(w, RANKS) for w in words}


def test_folds_agree():
    r = random.Random(5)
    for _ in range(200):
        w = bytes(r.choice(b"abcdeftion ") for _ in range(r.randint(2, 60)))
        assert bpe._fold_long([w[i:i + 1] for i in range(len(w))], RANKS) == _plain(w)


def _plain(w):
    p = [w[i:i + 1] for i in range(len(w))]
    while True:
        best = min(((RANKS[p[i] + p[i + 1]], i) for i in range(len(p) - 1) if p[i] + p[i + 1] in RANKS), default=None)
        if best is None:
            return [RANKS[x] for x in p]
        p[best[1]:best[1] + 2] = [p[best[1]] + p[best[1] + 1]]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    e = bpe.Encoder(RANKS, PATTERN)
    e.chunks(" ".join(map(str, range(100))))
    assert len(e.known) <= 10


def test_words_are_folded_together():
    """What a new word costs: folding one by one is most of the query's work."""
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcdefghinorstu") for _ in range(r.randint(6, 14))) for _ in range(40_000))
    e, words = bpe.Encoder(RANKS, PATTERN), set(text.split(" "))
    at = time.process_time()
    plain = [bpe.fold(f" {w}".encode(), RANKS) for w in words]
    between = time.process_time()
    (n, ids, _), = e.digests([text])
    assert time.process_time() - between < 0.8 * (between - at) and len(plain) == len(words)
    want = TK.encode_ordinary(text)
    assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


def test_fold_of_many_words_is_the_plain_fold():
    r = random.Random(7)
    word = lambda n: bytes(r.choice(b"abcdetion \xc3\xa9") for _ in range(n))
    words = [word(n) for n in (*range(140), 700, 2100) for _ in range(6)]
    # ranks in no order, gaps between them, words that are pieces yet fold to others
    odd = list({bytes([i]) for i in range(256)} | {word(r.randint(2, 4)) for _ in range(900)} | {word(9) for _ in range(20)})
    numbers = r.sample(range(5000), len(odd))
    for ranks in (RANKS, dict(zip(odd, numbers, strict=True)), {bytes([i]): i for i in range(256)}):
        f = bpe.Folder(ranks)
        some = [*words, *(p for p in odd if p in ranks)]
        places, counts = f(some)
        assert [x.tolist() for x in np.split(f.numbers[places], np.cumsum(counts)[:-1])] == [bpe.fold(w, ranks) if w else [] for w in some]
    assert [x.tolist() for x in f([])] == [[], []]
    few = bpe.Folder({b"a": 0, b"bc": 1})
    assert [x.tolist() for x in few([b"abca", b"bc"])] == [[0, 1, 0, 1], [3, 1]]
    with pytest.raises(KeyError):
        few([b"ab"])


def test_texts_over_several_segments(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 30)
    texts = [t or "" for t in ODD] * 2 + [" ".join(f"w{i % 40}" for i in range(300)), "x" * 600, ""]
    for n in (1, 7, 1 << 17):
        monkeypatch.setattr(bpe.Encoder, "SEGMENT", n)
        e = bpe.Encoder(RANKS, PATTERN)
        want = [TK.encode_ordinary(t) for t in texts]
        assert [x.tolist() for x, in e.ids(texts)] == want
        assert e.digests(texts) == [(len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(want, texts, strict=True)]
        assert len(e.known) + len(e.older) <= 30 and e.known.held + e.older.held <= 30 * bpe.LONGEST // 4
