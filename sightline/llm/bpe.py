"""Byte-level BPE encoding and decoding with a given rank file.

A text is cut into words by the tokenizer's pattern, and each distinct word's
bytes are folded by ranked merges: of all neighbouring pieces the pair of least
rank joins, until no pair has a rank. Decoding concatenates the pieces' bytes.

:func:`encode_words` is the fold in Spark's higher-order functions over a table
of distinct words with the ranks as a literal: an array of short maps by hash, so
a look-up does not read the map from its start. A word still costs about half a
millisecond of two cores, as lambdas are interpreted; the README has the
figures. :func:`encode` therefore does the same fold in Arrow
batches, for all words at once that a batch has and the worker does not know
(:class:`Folder`), with a bounded cache of distinct words in each Python worker.
Nothing is shuffled, and a worker holds one batch of texts, the ranks (a fixed
file) and at most ``CACHE`` words.

Cases. Null or empty text: no ids. Text that looks like a special token is
ordinary text. Null ids of rows are passed on. Repeated rows are encoded each; of
pairs of equal rank the first joins. Very long texts and words are read whole.
Empty tables give empty results. Other columns than those kept never clash; a
kept column must not be named like a result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .resident import kept, lean, parts

#: Words of which a worker remembers the ids.
CACHE = 150_000
#: Four times the characters that such a word has on average at most.
LONGEST = 64
#: Unicode white space, as the pattern's \\s; Python's has four control characters more.
SPACE = "\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 piece and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    return [ranks[p] for p in fold_pieces(word, ranks)]


def fold_pieces(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of one word."""
    if word in ranks:
        return [word]
    none, n, get = 1 << 60, len(word), ranks.get
    if n > 2000:
        return _live_long([word[i:i + 1] for i in range(n)], ranks)
    cuts = list(range(n + 1))  # pieces are the slices between cuts
    rank = [get(word[i:i + 2], none) for i in range(n - 1)]
    while rank and (least := min(rank)) < none:
        i = rank.index(least)
        del rank[i], cuts[i + 1]
        if i < len(rank):
            rank[i] = get(word[cuts[i]:cuts[i + 2]], none)
        if i:
            rank[i - 1] = get(word[cuts[i - 1]:cuts[i + 1]], none)
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _fold_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The ids of a very long word."""
    return [ranks[p] for p in _live_long(parts, ranks)]


def _live_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The same fold for very long words: a heap of pairs and a linked list of pieces."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = list(parts)

    def pair(i):
        j = after[i]
        if j < n and (r := ranks.get(live[i] + live[j])) is not None:
            heapq.heappush(heap, (r, i, live[i], live[j]))

    heap: list = []
    for i in range(n):
        pair(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if live[i] != a or j >= n or live[j] != b:
            continue
        live[i], live[j] = a + b, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            pair(before[i])
        pair(i)
    return [p for p in live if p]


class _Numbers(dict):
    """Numbers keys as they are first asked for; ``fresh`` has those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        n = self[key] = len(self)
        return n

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class _Known(_Numbers):
    """Words by number, and the places of their pieces: word i has ``sizes[i]`` from ``starts[i]``."""

    def __init__(self):
        super().__init__()
        self.held, self.flat, self.starts, self.sizes = 0, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def put(self, some: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> None:
        """What the words of these numbers have."""
        if (n := len(self) - len(self.sizes)) > 0:
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros(n, np.int64)]), np.concatenate([self.sizes, np.zeros(n, np.int64)])
        self.starts[some], self.sizes[some] = _ends(sizes)[:-1] + len(self.flat), sizes
        self.flat = np.concatenate([self.flat, places])


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where each of some runs ends, after a 0: run i is between i and i + 1."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` of these starts and sizes, one after another."""
    return flat[np.repeat(starts - _ends(sizes)[:-1], sizes) + np.arange(sizes.sum())]


class Folder:
    """The fold of many words at once, over places: a piece's place is its position by rank.

    Words of like lengths are rows of a matrix. In each round every row joins its
    first pair of least rank, and a row without such a pair is done. Pairs are
    looked up in an open hash table of all pairs of pieces that make a piece.
    """

    EMPTY = np.uint64(2**64 - 1)
    STEP = np.uint64(0x9E3779B97F4A7C15)
    #: Longest words (in bytes) of each matrix, and its rows; longer words are folded one by one.
    WIDTHS, ROWS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64), 8192

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        order = sorted(ranks, key=ranks.__getitem__)
        self.numbers = np.array([ranks[p] for p in order], np.int64)
        self.pieces = pa.array(order, pa.large_binary())
        # a byte that is no piece has a place behind all pieces; it may yet be part of one
        order += [x for x in (bytes([i]) for i in range(256)) if x not in ranks]
        self.place = {p: i for i, p in enumerate(order)}
        self.none = len(order)
        self.first = np.array([self.place[bytes([i])] for i in range(256)], np.int32)
        get, n, found = self.place.get, np.uint64(self.none + 1), array("q")
        for p, i in self.place.items():
            for k in range(1, len(p)):
                if (x := get(p[:k])) is not None and (y := get(p[k:])) is not None:
                    found.extend((x, y, i))
        x, y, i = np.array(found, np.int64).reshape(-1, 3).T.copy()
        self._table(x.astype(np.uint64) * n + y.astype(np.uint64), i.astype(np.int32))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, (3 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        # a key lies at its home or behind it, with no empty slot between
        self.keys = np.full((1 << bits) + len(keys) + 1, self.EMPTY)
        self.values = np.full(len(self.keys), self.none, np.int32)
        at, todo = (keys * self.STEP >> self.shift).astype(np.int64), np.arange(len(keys))
        while todo.size:
            free = np.flatnonzero(self.keys[at[todo]] == self.EMPTY)
            _, one = np.unique(at[todo[free]], return_index=True)
            put = todo[free[one]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = np.delete(todo, free[one])
            at[todo] += 1
        used = int(np.flatnonzero(self.keys != self.EMPTY).max(initial=0))
        end = max(1 << bits, used + 1) + 1
        self.keys, self.values = self.keys[:end].copy(), self.values[:end].copy()

    def pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the joined pairs, ``none`` for those that make no piece."""
        key = x.astype(np.uint64) * np.uint64(self.none + 1) + y.astype(np.uint64)
        at = (key * self.STEP >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], np.int32(self.none))
        more = np.flatnonzero((there != key) & (there != self.EMPTY))
        while more.size:
            at[more] += 1
            there = self.keys[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (there != self.EMPTY)]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words' pieces, one after another, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at, data = _ends(sizes), np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(data), -1, np.int32)
        counts = np.ones(len(words), np.int64)
        whole = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        out[at[:-1][whole >= 0]] = whole[whole >= 0]
        counts[sizes == 0] = 0
        rest = np.flatnonzero((whole < 0) & (sizes > 0))
        width = np.searchsorted(self.WIDTHS, sizes[rest])
        for k in np.unique(width):
            rows = rest[width == k]
            if k == len(self.WIDTHS):
                for i in rows:
                    ids = [self.place[p] for p in fold_pieces(words[i], self.ranks)]
                    out[at[i]:at[i] + len(ids)], counts[i] = ids, len(ids)
                continue
            for n in range(0, len(rows), self.ROWS):
                self._matrix(data, at, rows[n:n + self.ROWS], self.WIDTHS[k], out, counts)
        out = out[out >= 0]
        if len(self.numbers) < self.none and out.max(initial=0) >= len(self.numbers):
            raise KeyError("a byte that no rank is given for")
        return out, counts

    def _matrix(self, data: np.ndarray, at: np.ndarray, rows: np.ndarray, width: int, out: np.ndarray, counts: np.ndarray) -> None:
        """Fold of words of at most ``width`` bytes, 2 at least; their places go to ``out``."""
        cell = at[rows][:, None] + np.arange(width)
        inside = cell < at[rows + 1][:, None]
        pieces = np.full(cell.shape, self.none, np.int32)
        pieces[inside] = self.first[data[cell[inside]]]
        best = self.pair(pieces[:, :-1].ravel(), pieces[:, 1:].ravel()).reshape(len(rows), -1)

        def done(some):
            there = pieces[some]
            real = there != self.none
            counts[rows[some]] = real.sum(1)
            out[(at[rows[some]][:, None] + np.arange(there.shape[1]))[real]] = there[real]

        while len(rows):
            if not best.shape[1]:
                return done(slice(None))
            j = best.argmin(1)
            joined = best[np.arange(len(rows)), j]
            if (live := joined != self.none).sum() < len(rows):
                done(~live)
                pieces, best, rows, j, joined = pieces[live], best[live], rows[live], j[live], joined[live]
            if not (n := len(rows)):
                return
            row = np.arange(n)
            pieces[row, j] = joined
            stay = np.ones(pieces.shape, bool)
            stay[row, j + 1] = False
            pieces = pieces[stay].reshape(n, -1)
            best = best[stay[:, 1:]].reshape(n, -1)
            # pair i is of the pieces i and i + 1: those with the joined piece are new
            for i in (j - 1, j):
                some = np.flatnonzero((i >= 0) & (i < best.shape[1]))
                c = i[some]
                best[some, c] = self.pair(pieces[some, c], pieces[some, c + 1])


class Encoder:
    """Encodes texts; keeps the results of distinct words up to a bound.

    The words of some texts that are not known are folded together; then all ids
    of these texts are gathered at once.
    """

    #: Words that are worked on at once.
    SEGMENT = 1 << 17

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fold = Folder(ranks)
        self.names = pa.array([f",{r}".encode() for r in self.fold.numbers.tolist()], pa.large_binary())
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        # in two halves, so that words in use outlive rare ones
        self.known, self.older = _Known(), _Known()

    def _learn(self) -> None:
        """Take the words that are new from the older half, or fold them."""
        k, old = self.known, self.older
        fresh, k.fresh = k.fresh, []
        if not fresh:
            return
        k.held += sum(map(len, fresh))
        were = np.fromiter((old.get(x, -1) for x in fresh), np.int64, len(fresh))
        number, has = np.arange(len(k) - len(fresh), len(k)), were >= 0
        k.put(number[has], _gather(old.flat, old.starts[were[has]], old.sizes[were[has]]), old.sizes[were[has]])
        k.put(number[~has], *self.fold([x.encode() for x, i in zip(fresh, were.tolist(), strict=True) if i < 0]))

    def _bound(self) -> None:
        """Both halves have at most ``CACHE`` words, and characters in proportion."""
        fits = lambda n, held: n <= CACHE and held <= CACHE * LONGEST // 4
        k, old = self.known, self.older
        if not fits(len(k) + len(old), k.held + old.held):
            self.known, self.older = _Known(), k if fits(len(k), k.held) else _Known()

    def _segments(self, texts: list[str]):
        """Words of the texts, some at once, with the text and the number of each run of them."""
        words: list[str] = []
        runs: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            found = self.words(t)
            for at in range(0, len(found), self.SEGMENT):
                some = found[at:at + self.SEGMENT]
                if words and len(words) + len(some) > self.SEGMENT:
                    yield words, runs
                    words, runs = [], []
                words += some
                runs.append((i, len(some)))
        if words:
            yield words, runs

    def runs(self, texts: list[str]):
        """Places of the texts' pieces: arrays of runs, where the runs end, and of which text each is."""
        for words, runs in self._segments(texts):
            if len(self.known) >= CACHE // 2:
                self.known, self.older = _Known(), self.known
            at = self.known.of(words)
            self._learn()
            sizes = self.known.sizes[at]
            places, ends = _gather(self.known.flat, self.known.starts[at], sizes), _ends(sizes)[_ends(np.array([n for _, n in runs]))]
            del at, sizes
            self._bound()
            yield places, ends, [i for i, _ in runs]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids joined by commas, digest of the decoded ids."""
        counts, ids, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for places, ends, of in self.runs(texts):
            places = pa.array(places)
            for hashes, known, skip in ((ids, self.names, 1), (decoded, self.fold.pieces, 0)):
                data, at = _joined(known.take(places))
                for i, a, b in zip(of, at[ends[:-1]].tolist(), at[ends[1:]].tolist(), strict=True):
                    # a text's first id has no comma before it
                    hashes[i].update(data[a if counts[i] or a == b else a + skip:b])
            for i, n in zip(of, np.diff(ends).tolist(), strict=True):
                counts[i] += n
        return [(n, x.hexdigest(), y.hexdigest()) for n, x, y in zip(counts, ids, decoded, strict=True)]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray]]:
        """The ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for places, ends, of in self.runs(texts):
            ids = self.fold.numbers[places].astype(np.int32)
            for i, a, b in zip(of, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i].append(ids[a:b])
        return [(np.concatenate(x) if x else np.zeros(0, np.int32),) for x in out]

    def chunks(self, text: str) -> list[tuple[int, str, bytes, tuple[int, ...]]]:
        """For the words of a text, in order: number of ids, ids joined by commas, their bytes, ids."""
        out = []
        for x in self.words(text):
            for places, _, _ in self.runs([x]):
                ids = self.fold.numbers[places].tolist()
                out.append((len(ids), ",".join(map(str, ids)), b"".join(self.fold.pieces.take(pa.array(places)).to_pylist()), tuple(ids)))
        return out


def _joined(a: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values of an array of binaries, and where each begins and the last ends."""
    _, offsets, data = a.buffers()
    return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]


def _encoder(ranks, pattern: str) -> Encoder:
    """One encoder for a worker, which outlives its tasks until another operator runs there."""
    key = (ranks.id, pattern) if hasattr(ranks, "id") else (id(ranks), pattern)
    return kept("bpe", key, lambda: Encoder(ranks.value if hasattr(ranks, "value") else ranks, pattern))


def _run(docs: DataFrame, rank_path: str, pattern: str, of, schema: str, kept: list[Column]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(rank_path))
    ranks = _Held(ranks)
    d = docs.select(*kept)
    names = d.columns[:-1]
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]]
    extra = [(x.split()[0], x.split()[1]) for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    @lean("bpe")
    def run(batches):
        e = _encoder(ranks, pattern)
        for b in parts(batches):
            rows = of(e, [t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in extra]
            yield pa.record_batch([*b.columns[:-1], *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, extra, strict=True))], names=[*names, *(n for n, _ in extra)])

    return d.mapInArrow(run, ", ".join([*types, *(f"`{n}` {k}" for n, k in extra)]))


class _Held:
    """A broadcast with a name that is the same in every task."""

    def __init__(self, b):
        self.b, self.id = b, b._jbroadcast.id() if b._jbroadcast is not None else 0

    @property
    def value(self):
        return self.b.value

    def __getstate__(self):
        return {"b": self.b, "id": self.id}


def default_ranks() -> tuple[str, str]:
    """Rank file and pattern of the installed public tokenizer."""
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns but the text, and ``out_col`` (array of int): the text's ids."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, out_col)]
    return _run(docs, rank_path, pattern, Encoder.ids, f"{out_col} array<int>", [*rest, F.col(f"`{text_col}`").cast("string")])


def decode(docs: DataFrame, rank_path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """All columns and ``out_col`` (binary): the concatenated pieces of the ids, null for null."""
    pieces = [""] * (max((ranks := load_ranks(rank_path)).values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p.hex()
    # one string literal, folded to an array literal once; element r + 1 is the piece of rank r
    table_ = F.transform(F.split(F.lit(",".join(pieces)), ","), F.unhex)
    joined = F.aggregate(F.transform(F.col(f"`{ids_col}`"), lambda i: F.element_at(table_, i + 1)), F.lit(b""), lambda a, b: F.concat(a, b))
    return docs.withColumn(out_col, joined)


def digests(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``n_tokens, ids_sha256, decoded_sha256`` of the whole round trip."""
    return _run(docs, rank_path, pattern, Encoder.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", [*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string")])


#: Buckets of the rank literal.
BUCKETS = 1 << 16


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal that is not searched from its start: an array of short maps by the piece's hash, each as a string.

    Only ``split`` makes it, which the optimiser folds into one literal; a
    higher-order function there would run again for every look-up.
    """
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for p, r in ranks.items():
        buckets[xxhash.xxh64_intdigest(p, 42) % BUCKETS].append(f"{p.hex().upper()}:{r}")  # Spark's xxhash64 has the seed 42
    return F.split(F.lit(";".join(",".join(b) for b in buckets)), ";")


def encode_words(words: DataFrame, rank_path: str) -> DataFrame:
    """``word`` (binary) and ``ids``: the fold in higher-order functions, the ranks a literal in buckets."""
    table_ = rank_literal(load_ranks(rank_path))
    none = F.lit(1 << 30)
    found = lambda p: F.try_element_at(F.str_to_map(F.get(table_, F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")), F.lit(","), F.lit(":")), F.hex(p)).cast("int")
    rank = lambda p: F.coalesce(found(p), none)
    first = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)))
    cut = lambda p, a, n: F.slice(p, a, n)
    scored = lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(rank(F.concat(F.get(p, i), F.get(p, i + 1))).alias("r"), i.alias("i"))))

    def step(state, _):
        # the least rank, the first of equals; nothing left to merge: as it is
        p, i = state["p"], state["best"]["i"]
        merged = F.concat(cut(p, F.lit(1), i), F.array(F.concat(F.get(p, i), F.get(p, i + 1))), cut(p, i + 3, F.size(p)))
        return F.when(state["best"]["r"] < none, _state(merged)).otherwise(state)

    def _state(p):
        best = F.coalesce(F.array_min(scored(p)), F.struct(none.alias("r"), F.lit(0).alias("i")))
        return F.struct(p.alias("p"), best.alias("best"))

    w = words.select("word").where(F.length("word") > 0)
    parts = F.aggregate(F.sequence(F.lit(1), F.length("word")), _state(first), step, lambda s: s["p"])
    return w.select("word", F.transform(parts, lambda p: F.coalesce(found(p), F.lit(-1))).alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: digests of the round trip of the whole ``documents``."""
    return digests(table(spark, sf_dir, "documents"), *default_ranks())
