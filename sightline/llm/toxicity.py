"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, give each word and the word
before it two log-likelihoods. A word is spelt letter by letter, each letter
given all letters before it (beyond ``DEPTH`` letters the rest of the word is
one symbol), then its end; after a word's end stands the word before it, so
phrases of two words are learnt too. In a context x

    P_y(c | x) = (max(n_y(xc) - D, 0) + D T_y(x) S(c | x)) / n_y(x)

with n_y the documents of class y, T_y(x) the kinds of symbols that class y has
after x, and S the backoff that both classes share: the share of distinct words
through x that go on with c. A context that a class does not know gives S, and
all P_y(. | x) sum to one. A word's evidence is the sum of log P_toxic - log
P_ordinary along its path. Rare expressions are smoothed by the shared backoff:
a node in fewer than ``LEAST`` documents, or whose classes differ from those of
its context by a log-likelihood test below ``CLEAR`` or a factor below two, keeps
no counts of its own and speaks for neither class. A document's features are the mean of its
words' evidence (its length-normalised log-likelihood ratio) and that of its
``TOP`` strongest distinct words; a logistic regression turns them into a score.

How it trains. Rows whose crc32(id) mod 5 is 0 are held out. All labelled rows of
remainders 1 to 3 are counted by grouped aggregates over words; prefixes are
summed from distinct words, so counting follows the input and nothing of it
reaches the driver but the clear nodes, if at most ``NODES``. The labels are
broadcast up to ``LABELS`` rows, else joined by a shuffle; above ``NODES`` the
documents' words are joined with the nodes instead of a broadcast. Only the
calibration takes a sample: at most ``SAMPLE`` rows of remainder 4, of least
md5(id). Every text is scored whole; with a broadcast nothing of it is shuffled.

Cases. Words are runs of at most 40 letters, lowered (longer runs are cut). Null
or empty text or one without letters: no evidence, scored like any other. Null
ids: not held out. Null labels are skipped, repeated labels of an id count as
toxic if any is. If the counted rows lack a class, every score is the share of
toxic rows in all (0 without rows). Empty tables give empty results. Repeated
rows are scored each; only named columns are read, so others never clash.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_saved, saved, ship, table
from .hashing import mix
from .logistic import Logistic
from .resident import kept, lean, parts

DISCOUNT, DEPTH, TOP = 0.75, 8, 4
#: Documents that a node needs, toxic documents that a pair needs, and the least log-likelihood statistic (chi-squared, one degree).
LEAST, PAIR, CLEAR = 3, 4, 15.0
#: The least factor by which a node's two probabilities differ, as a logarithm.
FACTOR = 0.7
#: Most labelled rows of the calibration; words and pairs that a worker counts before it passes them on.
SAMPLE, CACHE = 8000, 100_000
#: Characters of texts that are scanned at once.
PART = 500_000
#: Most rows of labels, of pairs to count and of nodes that are broadcast.
LABELS, PAIRS, NODES = 2_000_000, 500_000, 500_000
#: A word's end.
END = "\3"
_WORDS = re.compile(r"[^\W\d_]{1,40}").findall


def words_of(text: str | None) -> list[str]:
    """The words of a text, in order."""
    return _WORDS((text or "").lower())


def path(word: str) -> list[str]:
    """The nodes on a word's way: its prefixes, and its end."""
    return [*(word[:k] for k in range(1, min(len(word), DEPTH) + 1)), word + END]


_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point whether it is a letter of a word."""
    if not _LETTERS:
        t = np.zeros(0x110000, bool)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        for m in re.finditer(r"[^\W\d_]+", "".join(map(chr, points))):
            t[points[m.start()]:points[m.end() - 1] + 1] = True
        t[0xD800:0xE000] = False
        _LETTERS.append(t)
    return _LETTERS[0]


class _Table:
    """Values by 64-bit hash, behind a bitmap that says which hashes to look up."""

    def __init__(self, entries: list[tuple[int, float]]):
        entries = sorted(entries)
        self.keys, self.values = np.array([h for h, _ in entries], np.uint64), np.array([r for _, r in entries])
        self.some = np.zeros(1 << 20, bool)
        self.some[self.keys >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes have a value, and the values."""
        at = np.flatnonzero(self.some[h >> np.uint64(44)]) if len(self.keys) else np.empty(0, int)
        i = np.minimum(np.searchsorted(self.keys, h[at]), max(0, len(self.keys) - 1))
        found = self.keys[i] == h[at] if len(at) else np.empty(0, bool)
        return at[found], self.values[i[found]]


def _spelt(word: str) -> int:
    """The hash of a word's letters, as :meth:`Scorer._words` finds it."""
    h = 0
    for c in word:
        h = (h + ord(c)) * int(_MIX) & (1 << 64) - 1
    return h


def _paired(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(mix(before) + word * np.uint64(3))


class Scorer:
    """Evidence of texts."""

    def __init__(self, nodes: dict[str, float]):
        self.nodes = nodes
        prefixes, ends, pairs = [], [], []
        for n, r in nodes.items():
            w, end, u = n.partition(END)
            if u:
                pairs.append((int(_paired(np.array([_spelt(w)], np.uint64), np.array([_spelt(u)], np.uint64))[0]), r))
            else:
                (ends if end else prefixes).append((_spelt(w), r))
        self.prefixes, self.ends, self.pairs = _Table(prefixes), _Table(ends), _Table(pairs)

    def word(self, w: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        get = self.nodes.get
        return sum([get(n, 0.0) for n in path(w)])

    def _words(self, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Evidence and hash of each word."""
        e, whole = np.zeros(len(start)), np.zeros(len(start), np.uint64)
        at, h, from_, left = np.arange(len(start)), np.zeros(len(start), np.uint64), start, size
        for k in range(40):
            if not len(at):
                break
            h = (h + c[from_ + k]) * _MIX
            if k < DEPTH:
                i, r = self.prefixes(h)
                e[at[i]] += r
            more = left > k + 1
            whole[at[~more]] = h[~more]
            at, h, from_, left = at[more], h[more], from_[more], left[more]
        i, r = self.ends(whole)
        e[i] += r
        return e, whole

    def _part(self, texts: list[str], out: np.ndarray) -> None:
        s = "\n".join(texts)
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = np.zeros(len(c) + 2, np.int8)
        letter[1:-1] = _letters()[c]
        edge = np.diff(letter)
        run = np.flatnonzero(edge == 1)
        long = np.flatnonzero(edge == -1) - run
        pieces = -(-long // 40)
        skip = 40 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        start = np.repeat(run, pieces) + skip
        size = np.minimum(np.repeat(long, pieces) - skip, 40)
        if not len(start):
            return
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        own, word = self._words(c, start, size)
        e = own.copy()
        i, r = self.pairs(_paired(word[1:], word[:-1]))
        near = text[i] == text[i + 1]
        e[i[near] + 1] += r[near]
        out[:, TOP] = np.bincount(text, e, len(texts)) / np.maximum(1, np.bincount(text, minlength=len(texts)))
        # each text's strongest distinct words
        best = np.maximum(own, e)
        at = np.flatnonzero(best > 0)
        at = at[np.lexsort((-best[at], word[at], text[at]))]
        if len(at):
            new = np.append(True, (word[at][1:] != word[at][:-1]) | (text[at][1:] != text[at][:-1]))
            at = at[new]
            at = at[np.lexsort((-best[at], text[at]))]
            first = np.flatnonzero(np.append(True, text[at][1:] != text[at][:-1]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            top = rank < TOP
            out[text[at][top], rank[top]] = best[at][top]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: evidence of its strongest distinct words, descending, and the mean of all."""
        out, at, size, lower = np.zeros((len(texts), TOP + 1)), 0, 0, []
        for i, t in enumerate(texts):
            lower.append((t or "").lower())
            size += len(lower[-1])
            if size >= PART or i + 1 == len(texts):
                self._part(lower, out[at:i + 1])
                at, size, lower = i + 1, 0, []
        return out


def _scorer(held) -> Scorer:
    """One scorer for a worker, which outlives its tasks until another operator runs there."""
    return kept("toxicity", held.id, lambda: Scorer(held.value))


def _counter(pairs):
    """Documents by class that have a word, and a pair: with ``pairs`` None all pairs of toxic documents, else those in it (all if empty) of ordinary ones."""

    @lean("toxicity")
    def run(batches):
        n = Counter(), Counter()
        wanted = pairs.value if pairs is not None else None
        second = {p[:p.index(END)] for p in wanted or ()}

        def counted():
            keys = list(n[0].keys() | n[1].keys())
            return pa.record_batch([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in n)], names=["key", "n0", "n1"])

        for b in parts(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(t)
                if wanted is None:
                    n[y].update(set(words))
                if wanted is None and y or wanted is not None and not y and not wanted:
                    n[y].update({w + END + u for u, w in zip(words, words[1:], strict=False)})
                elif wanted and not y:
                    n[y].update({w + END + u for u, w in zip(words, words[1:], strict=False) if w in second} & wanted)
                if len(n[0]) + len(n[1]) > CACHE:
                    yield counted()
                    n[0].clear()
                    n[1].clear()
        yield counted()

    return run


def remainder(id_col):
    """crc32 of the id as text, mod 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def _labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    n = F.col(f"`{id_col}`").cast("long")
    y = labels.select(n.alias("__id"), F.col(f"`{label}`").cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)")
    return y.groupBy("__id").agg(F.max("__y").alias("__y")).withColumn("__part", remainder(F.col("__id"))).where("__part <> 0")


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """``text, y, part`` of all labelled rows that are not held out; ``part``: their remainder."""
    y = _labels(labels, label, id_col)
    y = F.broadcast(y) if y.limit(LABELS + 1).count() <= LABELS else y
    return docs.withColumn("__id", F.col(f"`{id_col}`").cast("long")).join(y, "__id").select(F.col("text"), F.col("__y").alias("y"), F.col("__part").alias("part"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, most: int, parts: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """``text, y, part`` of at most ``most`` labelled rows of these remainders."""
    y = _labels(labels, label, id_col).where(F.col("__part").isin(*parts))
    y = y.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(most)  # the bound of the broadcast below
    d = docs.withColumn("__id", F.col(f"`{id_col}`").cast("long"))
    return d.join(F.broadcast(y), "__id").select(F.col("text"), F.col("__y").alias("y"), F.col("__part").alias("part"))


def clarity(n0: Column, n1: Column, m0: Column, m1: Column) -> Column:
    """Log-likelihood statistic of a node's classes (n) against those of its whole context (m)."""
    term = lambda x, whole, part, all_: F.when(x > 0, x * F.log(x * all_ / (whole * part))).otherwise(0.0)
    m, n = m0 + m1, n0 + n1
    return 2 * (term(n0, m0, n, m) + term(n1, m1, n, m) + term(m0 - n0, m0, m - n, m) + term(m1 - n1, m1, m - n, m))


def _ratio(shared: Column) -> Column:
    """log P_1 - log P_0 of a row with a node's n0, n1, its context's m0, m1 and kinds t0, t1."""
    p = lambda n, m, t: F.when(m > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * t * shared) / m).otherwise(shared)
    return F.log(p(F.col("n1"), F.col("m1"), F.col("t1"))) - F.log(p(F.col("n0"), F.col("m0"), F.col("t0")))


_CLEAR = lambda: (F.col("n0") + F.col("n1") >= LEAST) & (clarity(F.col("n0"), F.col("n1"), F.col("m0"), F.col("m1")) >= CLEAR)


def spelling(words: DataFrame) -> DataFrame:
    """``node, parent, n0, n1, v, m0, m1, t0, t1, mv`` of every prefix and end of ``key, n0, n1``; v, mv: distinct words through the node and its context."""
    size = F.least(F.length("key"), F.lit(DEPTH))
    k = words.select("key", "n0", "n1", size.alias("size"), F.explode(F.sequence(F.lit(1), size + 1)).alias("k"))
    k = k.select(F.when(F.col("k") <= F.col("size"), F.substring("key", F.lit(1), F.col("k"))).otherwise(F.concat("key", F.lit(END))).alias("node"), F.substring("key", F.lit(1), F.col("k") - 1).alias("parent"), "n0", "n1")
    n = k.groupBy("parent", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("v"))
    of = W.partitionBy("parent")
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long")).over(of)
    return n.select("*", F.sum("n0").over(of).alias("m0"), F.sum("n1").over(of).alias("m1"), kinds("n0").alias("t0"), kinds("n1").alias("t1"), F.sum("v").over(of).alias("mv"))


def preceding(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The same of pairs: the context is the word's end, the other words before it are one symbol more, the backoff is even."""
    p = pairs.select("key", F.substring_index("key", END, 1).alias("word"), "n0", "n1").join(words.select(F.col("key").alias("word"), F.col("n0").alias("w0"), F.col("n1").alias("w1")), "word")
    of = W.partitionBy("word")
    for y in "01":
        named, rest = F.sum(f"n{y}").over(of), F.greatest(F.col(f"w{y}") - F.sum(f"n{y}").over(of), F.lit(0))
        p = p.withColumn(f"m{y}", named + rest).withColumn(f"t{y}", F.sum((F.col(f"n{y}") > 0).cast("long")).over(of) + (rest > 0).cast("long"))
    return p.select(F.col("key").alias("node"), F.concat("word", F.lit(END)).alias("parent"), "n0", "n1", F.lit(1).alias("v"), "m0", "m1", "t0", "t1", (F.count(F.lit(1)).over(of) + 1).alias("mv"))


def nodes_of(counted: DataFrame) -> DataFrame:
    """``node, ratio`` of the clear nodes of ``text, y`` rows."""
    spark = counted.sparkSession
    total = lambda d: d.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    schema = "key string, n0 long, n1 long"
    counts, c_path = saved(total(counted.mapInArrow(_counter(None), schema)).where(~F.contains("key", F.lit(END)) | (F.col("n1") >= PAIR)), "words")
    pair = F.contains("key", F.lit(END))
    found, words = counts.where(pair).select("key", "n1"), counts.where(~pair)
    few = [r.key for r in found.select("key").limit(PAIRS + 1).collect()]
    held = spark.sparkContext.broadcast(set(few) if len(few) <= PAIRS else set())
    ordinary = total(counted.where("y = 0").mapInArrow(_counter(held), schema)).select("key", "n0") if few else found.select("key", F.lit(0).alias("n0")).limit(0)
    pairs = found.join(ordinary, "key", "left").select("key", F.coalesce("n0", F.lit(0)).alias("n0"), "n1")
    both = spelling(words).unionByName(preceding(pairs, words)).where(_CLEAR())
    out, _ = saved(both.select("node", _ratio(F.col("v") / F.col("mv")).alias("ratio")).where(F.abs("ratio") >= FACTOR), "nodes")
    drop_saved(spark, c_path)
    return out


class Model:
    """What training gives: the clear nodes (a table, and broadcast if few) and the calibration, or a share if a class is missing."""

    def __init__(self, share: float, nodes: DataFrame | None = None, held=None, calibrate: Logistic | None = None):
        self.share, self.nodes, self.held, self.calibrate = share, nodes, held, calibrate


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, broadcast: int = NODES) -> Model:
    """Fit the models and the calibration."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    s = labelled(d, labels, "toxic", id_col)
    n = {(r.y, r.own): r["count"] for r in s.groupBy("y", (F.col("part") == 4).alias("own")).count().collect()}
    toxic, rows = sum(k for (y, _), k in n.items() if y), sum(n.values())
    if not all(n.get((y, False)) for y in (0, 1)):
        return Model(toxic / rows if rows else 0.0)
    nodes = nodes_of(s.where("part <> 4").select("text", "y"))
    held = None
    if nodes.count() <= broadcast:
        from .bpe import _Held

        t = nodes.toArrow()
        held = _Held(spark.sparkContext.broadcast(dict(zip(t.column("node").to_pylist(), t.column("ratio").to_pylist(), strict=True))))
    cal, c_path = saved(labelled_sample(d, labels, "toxic", id_col, most, (4,) if all(n.get((y, True)) for y in (0, 1)) else (1, 2, 3, 4)), "toxic")
    cols = [f"e{i}" for i in range(TOP + 1)]
    c = features(cal, nodes, held, "text", ("y",)).toArrow()
    x = np.column_stack([c.column(k).to_numpy() for k in cols])
    order = np.lexsort(x.T)  # rows come in any order; the fit must not depend on it
    fit = Logistic(x[order], c.column("y").to_numpy()[order].astype(float))
    drop_saved(spark, c_path)
    return Model(toxic / rows, nodes, held, fit)


def features(docs: DataFrame, nodes: DataFrame, held, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and ``e0`` to ``e4``: the features of every row."""
    own, text = [F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text")
    cols = [f"e{i}" for i in range(TOP + 1)]
    if held is None:
        return _joined(docs.select(*own, text), nodes, keep, cols)
    # a text that is kept goes to the workers once
    at = keep.index(text_col) if text_col in keep and dict(docs.dtypes)[text_col] == "string" else len(keep)
    d = docs.select(*own, *[text] * (at == len(keep)))

    @lean("toxicity")
    def run(batches):
        for b in parts(batches):
            f = _scorer(held)(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns[:len(keep)], *(pa.array(np.ascontiguousarray(x)) for x in f.T)], names=[*keep, *cols])

    return d.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:len(keep)]), *(f"{c} double" for c in cols)]))


def _joined(d: DataFrame, nodes: DataFrame, keep: tuple[str, ...], cols: list[str]) -> DataFrame:
    """The features by joins, for more nodes than a broadcast may hold."""
    d, _ = saved(d.withColumn("__row", F.monotonically_increasing_id()), "scored")

    @lean("toxicity")
    def split(batches):
        for b in batches:
            rows, w, u, n = [], [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, seen = words_of(t), {}
                for k in zip(words, ["", *words], strict=False):
                    seen[k] = seen.get(k, 0) + 1
                rows += [r] * len(seen)
                w += [k[0] for k in seen]
                u += [k[1] for k in seen]
                n += seen.values()
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(w, pa.string()), pa.array(u, pa.string()), pa.array(n, pa.int64())], names=["row", "w", "u", "n"])

    at, _ = saved(d.select("__row", "__text").mapInArrow(split, "row long, w string, u string, n long"), "positions")
    size = F.least(F.length("w"), F.lit(DEPTH))
    ways = F.transform(F.sequence(F.lit(1), size + 1), lambda k: F.when(k <= size, F.substring("w", F.lit(1), k)).otherwise(F.concat("w", F.lit(END))))
    word = at.select("w").distinct().select("w", F.explode(ways).alias("node")).join(nodes, "node").groupBy("w").agg(F.sum("ratio").alias("e"))
    pair = nodes.where(F.substring_index("node", END, -1) != "").select(F.col("node").alias("pair"), F.col("ratio").alias("r"))
    e = at.withColumn("pair", F.concat("w", F.lit(END), "u")).join(word, "w", "left").join(pair, "pair", "left")
    e = e.select("row", "w", "n", F.coalesce("e", F.lit(0.0)).alias("e"), F.coalesce("r", F.lit(0.0)).alias("r"))
    # a word's best is at least its own evidence
    e = e.groupBy("row", "w").agg(F.max(F.col("e") + F.greatest("r", F.lit(0.0))).alias("best"), F.sum((F.col("e") + F.col("r")) * F.col("n")).alias("total"), F.sum("n").alias("n"))
    top = W.partitionBy("row").orderBy(F.desc("best"), "w")
    e = e.withColumn("k", F.row_number().over(top)).groupBy("row").agg(*(F.greatest(F.max(F.when(F.col("k") == i + 1, F.col("best"))), F.lit(0.0)).alias(c) for i, c in enumerate(cols[:-1])), (F.sum("total") / F.sum("n")).alias(cols[-1]))
    out = d.join(e, F.col("__row") == F.col("row"), "left")
    return out.select(*(F.col(f"`{c}`") for c in keep), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols))


def scores(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` of every row."""
    ship(docs.sparkSession)
    if model.calibrate is None:
        return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(model.share)).alias("score"))
    e = features(docs, model.nodes, model.held, text_col, keep)
    return e.select(*(F.col(f"`{c}`") for c in keep), model.calibrate.column([f"e{i}" for i in range(TOP + 1)]).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: scores of the whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    s = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
