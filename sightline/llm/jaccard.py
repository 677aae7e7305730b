"""Near copies by SimHash, completed to exact Jaccard similarity of five-word shingles.

Two texts are near copies if their shingle sets have a similarity of at least
4/5; groups are the components of those pairs. SimHash fingerprints of the
shingles, linked by the covering tables of :mod:`simhash`, give the first links,
each checked on the whole sets. Texts of that similarity differ in ten bits of
64 on average, which no covering family of a usable size reaches (2^11 tables),
so the links are completed: sets of n and m shingles that similar share one of
the first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1 in any order common to all
(prefix filter), so no pair is missed. The order puts shingles that a sample
finds in many texts last and is otherwise that of their hashes; the sample sways
only the work, not the result.

How it runs. Equal word sequences are first joined by a grouped minimum. The
others' prefixes are dealt by shingle; only texts that are not yet in one
component are compared. A group of up to ``SMALL`` gives all its pairs that sizes
and places allow; a larger one gives, in ``ROUNDS`` rounds, those of one member of
its largest component with all others, and when these are checked all pairs that
are still in different components. Candidates
that a sketch (a bound, never too low) does not rule out are checked on the
whole sets.

Cases. Words are runs without ASCII white space, ASCII letters lowered. Fewer
words than a shingle: the whole sequence is one shingle; none: all such texts
are copies. Null ids take no part. Repeated ids: rows of different texts are
rows of their own. Very long texts are read whole. Empty tables give no groups.
Columns beyond those named are passed through by :func:`once`; none of them may
be called ``__id`` or ``__key``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import saved, ship
from . import simhash
from .hashing import pack_sorted, sequence_hashes, unpack_sorted, word_hashes
from .resident import lean

_U = np.uint64
#: Words of a shingle, and the least similarity as a fraction.
WORDS, NUM, DEN = 5, 4, 5
#: Groups up to this size give all pairs at once; in larger ones the whole sets are compared within the group.
SMALL = 16
#: Parts of the hash range that are counted to rule out pairs of a larger group.
BINS = 256
#: Bits of a shingle's hash that travel to a group: two sets of 500 agree by chance in one in a thousand million.
KEPT = 48
#: Most rows of ids that are broadcast to texts; beyond, both are shuffled.
FEW = 500_000
#: One text of so many is read for the order, and the shingles that are put last: at least so often found, at most so many.
EVERY, OFTEN, LAST = 16, 8, 50_000


def words(text) -> np.ndarray:
    return word_hashes(text.as_buffer().to_pybytes().lower()) if text.is_valid else np.empty(0, _U)


def shingles(w: np.ndarray) -> np.ndarray:
    """The sorted set of a word sequence's shingles."""
    return np.unique(sequence_hashes(w, min(WORDS, len(w)))) if len(w) else np.zeros(1, _U)


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(s), simhash.CHUNK):
        ones += np.unpackbits(s[i:i + simhash.CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s)).view(">i8")[0])


def prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles, of which near copies share one; ``last`` (sorted) come after all others."""
    n = len(s) - -(-NUM * len(s) // DEN) + 1
    if len(last):
        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
        if late.any():
            s = np.concatenate([s[~late], s[late]])
    return s[:n]


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles each part of the hash range has, in 2^k parts of about two to four; empty if a byte does not hold a number."""
    k = max(0, len(s).bit_length() - 2)
    n = np.bincount((s >> _U(63 - k) >> _U(1)).astype(np.int64), minlength=1 << k)
    return n.astype(np.uint8) if n.max() < 256 else np.empty(0, np.uint8)


def at_most(x: np.ndarray, y: np.ndarray) -> float:
    """A bound of what two sets have in common, from their sketches."""
    if not len(x) or not len(y):
        return float("inf")
    k = min(len(x), len(y))
    return float(np.minimum(*(v.reshape(k, -1).sum(axis=1, dtype=np.int64) for v in (x, y))).sum())


def near(n, m, common):
    """Whether sets of n and m shingles with so many in common are near copies."""
    return DEN * common >= NUM * (n + m - common)


def _pairs(a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Those pairs of rows (shingle, node, n, place, ...) which size and place leave possible."""
    n, m = a[i, 2], a[j, 2]
    ok = near(n, m, np.minimum(n - a[i, 3], m - a[j, 3]))  # at the first shingle in common no more than these can be
    x, y = a[i[ok], 1], a[j[ok], 1]
    return np.column_stack([np.minimum(x, y), np.maximum(x, y)])


def _groups(batches):
    """Groups of at least two rows sorted by the first column."""
    held = []
    for b in batches:
        a = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
        if not len(a):
            continue
        edge = np.concatenate([[0], np.flatnonzero(a[1:, 0] != a[:-1, 0]) + 1, [len(a)]])
        if held and held[0][0, 0] != a[0, 0]:
            g = np.concatenate(held)
            held = []
            if len(g) > 1:
                yield g
        if len(edge) == 2:
            held.append(a)
            continue
        g = np.concatenate([*held, a[:edge[1]]])
        if len(g) > 1:
            yield g
        for k in np.flatnonzero(np.diff(edge)[1:-1] > 1) + 1:
            yield a[edge[k]:edge[k + 1]]
        held = [a[edge[-2]:].copy()]
    if held and len(g := np.concatenate(held)) > 1:
        yield g


def _batch(rows: list[np.ndarray], names: list[str]):
    a = np.concatenate(rows)
    return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in a.T], names=names)


_OUT = ["h", "a", "b", "place"]


def _few():
    """Rows h, node, n, place, root: pairs (place -1) of different components, and the rows of groups over ``SMALL`` that have any left."""

    @lean()
    def run(batches):
        out, n = [], 0
        for g in _groups(batches):
            k = len(g)
            if (g[:, 4] == g[0, 4]).all():
                continue
            if k <= SMALL:
                i, j = np.triu_indices(k, 1)
                i, j = i[g[i, 4] != g[j, 4]], j[g[i, 4] != g[j, 4]]
            else:
                # a member of the group's largest component with all of other components
                roots, size = np.unique(g[:, 4], return_counts=True)
                of = g[:, 4] == roots[size.argmax()]
                j = np.flatnonzero(~of)
                i = np.full(len(j), np.flatnonzero(of)[0])
                out.append(g[:, :4])
            p = _pairs(g, i, j)
            if len(p):
                out.append(np.column_stack([np.zeros(len(p), np.int64), p, np.full(len(p), -1)]))
            n += k + len(p)
            if n > 50_000:
                if out:
                    yield _batch(out, _OUT)
                out, n = [], 0
        if out:
            yield _batch(out, _OUT)

    return run


def _with_binary(batches):
    """Groups of rows sorted by the first column: their numbers, and the bytes of their last column."""
    held: list[tuple[np.ndarray, list]] = []

    def group():
        return np.concatenate([a for a, _ in held]), [x.as_buffer() for _, xs in held for x in xs]

    for b in batches:
        a = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:-1]])
        if not len(a):
            continue
        edge = np.concatenate([[0], np.flatnonzero(a[1:, 0] != a[:-1, 0]) + 1, [len(a)]])
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            if held and held[0][0][0, 0] != a[s, 0]:
                yield group()
                held = []
            held.append((a[s:e], [b.column(b.num_columns - 1)[int(i)] for i in range(s, e)]))
    if held:
        yield group()


class _Bounds:
    """Bounds of what a member's set can have in common with others', from their sketches (see :func:`at_most`)."""

    def __init__(self, sketches: list[np.ndarray]):
        self.size = np.array([len(x) for x in sketches])
        self.rows = {k: np.flatnonzero(self.size == k) for k in np.unique(self.size)}
        self.place = np.zeros(len(sketches), int)
        for at in self.rows.values():
            self.place[at] = np.arange(len(at))
        self.tables = {(k, k): np.stack([sketches[i] for i in at]).astype(np.int32) for k, at in self.rows.items()}

    def _table(self, k: int, parts: int) -> np.ndarray:
        if (k, parts) not in self.tables:
            self.tables[k, parts] = self.tables[k, k].reshape(-1, parts, k // parts).sum(axis=2)
        return self.tables[k, parts]

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        out = np.full(len(others), np.iinfo(np.int64).max // 16)
        for k in self.rows:
            at = np.flatnonzero(self.size[others] == k)
            if parts := int(min(k, self.size[i])) if len(at) else 0:
                out[at] = np.minimum(self._table(self.size[i], parts)[self.place[i]], self._table(k, parts)[self.place[others[at]]]).sum(axis=1)
        return out


@lean()
def _needed(batches):
    """Members of a group that may be near copies of a member of another component."""
    for g, data in _with_binary(batches):
        roots, at, size = np.unique(g[:, 4], return_inverse=True, return_counts=True)
        if len(roots) < 2:
            continue
        bounds, need = _Bounds([np.frombuffer(x, np.uint8) for x in data]), np.zeros(len(g), bool)
        for i in np.flatnonzero(at != size.argmax()).tolist():
            n = g[i, 2]
            # at the first shingle in common no more than these can be
            j = np.flatnonzero((at != at[i]) & near(n, g[:, 2], np.minimum(n - g[i, 3], g[:, 2] - g[:, 3])))
            j = j[near(n, g[j, 2], bounds(i, j))]
            if len(j):
                need[i] = need[j] = True
        if need.any():
            yield _batch([g[need]], ["h", "node", "n", "place", "root"])


def _near_ones(g: np.ndarray, sets: list, bins: np.ndarray, i: int, others: np.ndarray, cluster: np.ndarray):
    """Members among the others that are near copies of member i, those of like size first; members of its own cluster by then are passed over."""
    n, m = g[i, 2], g[others, 2]
    # at the first shingle in common no more than these can be
    j = others[near(n, m, np.minimum(n - g[i, 3], m - g[others, 3]))]
    j = j[np.argsort(np.abs(g[j, 2] - n), kind="stable")]
    at, step = 0, 16
    while at < len(j):
        part = j[at:at + step]
        part = part[cluster[part] != cluster[i]]
        for k in part[near(n, g[part, 2], np.minimum(bins[i], bins[part]).sum(axis=1))]:
            if cluster[k] != cluster[i] and near(n, g[k, 2], len(np.intersect1d(sets[i], sets[k], assume_unique=True))):
                yield int(k)
        at, step = at + step, 8 * step


@lean()
def _linked(batches):
    """Links that join the components of each group's members as all its near copies do."""
    for g, data in _with_binary(batches):
        sets = [unpack_sorted(x) for x in data]
        roots, at, size = np.unique(g[:, 4], return_inverse=True, return_counts=True)
        if len(roots) < 2:
            continue
        bins = np.stack([np.bincount((s >> _U(KEPT - 8)).astype(np.int64), minlength=BINS) for s in sets]).astype(np.int32)
        links, seen, cluster = [], np.empty(0, np.int64), at.copy()
        for c in np.argsort(-size, kind="stable"):
            own = np.flatnonzero(at == c)
            for i in own.tolist() if len(seen) else ():
                others = seen[cluster[seen] != cluster[i]]
                for k in _near_ones(g, sets, bins, i, others, cluster):
                    if cluster[k] != cluster[i]:
                        links.append((g[i, 1], g[k, 1]))
                        cluster[cluster == cluster[k]] = cluster[i]
                        if not (cluster[seen] != cluster[i]).any():
                            break
            seen = np.append(seen, own)
        if links:
            yield _batch([np.array(links, np.int64)], ["a", "b"])


@lean()
def _possible(batches):
    """The pairs whose sketches let them be near copies."""
    for b in batches:
        ok = []
        for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
            ok.append(bool(near(n, m, at_most(*(np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))))))
        yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])


@lean()
def _similar(batches):
    """The pairs whose sets are near copies."""
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
            ok.append(near(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])


def few(ids: DataFrame) -> DataFrame:
    """The rows for a join with texts: broadcast, if they are few."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``id, key``: the smallest id of each component, and a digest of its text's words; and the same of all rows."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")

    @lean()
    def some(batches):
        for b in batches:
            yield pa.record_batch([pa.array(np.concatenate([shingles(words(x)) for x in b.column(0)] or [np.empty(0, _U)]).view(np.int64))], names=["h"])

    often = d.where(F.pmod(F.xxhash64("id"), F.lit(EVERY)) == 0).select("text").mapInArrow(some, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    last = np.sort(np.array([r.h for r in often.orderBy(F.desc("count"), "h").limit(LAST).collect()], np.int64).view(_U))

    @lean()
    def prefixes(batches):
        for b in batches:
            keys, sizes, firsts, sketches, prints = [], [], [], [], []
            for x in b.column(1):
                w = words(x)
                s = shingles(w)
                keys.append(xxhash.xxh3_128_digest(w.tobytes()))
                sizes.append(len(s))
                firsts.append(prefix(s, last).view(np.int64))
                sketches.append(sketch(s).tobytes())
                prints.append(fingerprint(s))
            yield pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(prints, pa.int64())], names=["id", "key", "n", "first", "sketch", "fp"])

    rows, _ = saved(d.mapInArrow(prefixes, "id long, key binary, n long, first array<long>, sketch binary, fp long"), "shingled")
    # the others depend on the key alone
    nodes = rows.groupBy("key").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", "first", "sketch", "fp")))
    nodes, _ = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    def sets_of(asked: DataFrame, pack) -> DataFrame:
        """``node, s``: the whole sets of some nodes."""
        asked, _ = saved(asked.distinct().join(nodes.select("node", "key", F.col("least").alias("id")), "node"), "asked")

        @lean()
        def sets(batches):
            for b in batches:
                out = [(n, pack(shingles(w))) for n, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) if xxhash.xxh3_128_digest((w := words(x)).tobytes()) == k]
                yield pa.record_batch([pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["node", "s"])

        return saved(d.join(few(asked), "id").select("node", "key", "text").mapInArrow(sets, "node long, s binary").dropDuplicates(["node"]), "sets")[0]

    def checked(pairs: DataFrame) -> DataFrame:
        """Of the candidates those that are near copies, from the whole sets of the texts in them."""
        end = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(end("a"), "a").join(end("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        pairs, _ = saved(pairs.mapInArrow(_possible, "a long, b long"), "candidates")
        s = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), np.ndarray.tobytes)
        both = pairs.join(s.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        return saved(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "similar")[0]

    # SimHash: texts of one fingerprint, and fingerprints within the radius
    of_print = nodes.groupBy("fp").agg(F.min("node").alias("root"))
    same = nodes.select("fp", "node").join(of_print, "fp").where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    links = checked(same.union(simhash.links(of_print.select("fp", F.col("root").alias("node")))))
    # the rest, by prefixes
    places = nodes.select("node", "n", F.posexplode("first").alias("place", "h")).select("h", "node", "n", F.col("place").cast("long").alias("place"))

    def apart(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows with their components so far."""
        roots, _ = saved(components(links), "roots")
        return rows.join(roots, "node", "left").select("h", "node", "n", "place", F.coalesce("root", "node").alias("root"))

    by_shingle = lambda rows: rows.repartition("h").sortWithinPartitions("h")
    found, _ = saved(by_shingle(apart(places, links)).mapInArrow(_few(), "h long, a long, b long, place long"), "shared")
    links = links.union(checked(found.where("place < 0").select("a", "b")))
    large, _ = saved(apart(found.where("place >= 0").select("h", F.col("a").alias("node"), F.col("b").alias("n"), "place"), links), "large")
    several = large.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    large = large.join(several, "h").join(nodes.select("node", "sketch"), "node").select("h", "node", "n", "place", "root", "sketch")
    large, _ = saved(by_shingle(large).mapInArrow(_needed, "h long, node long, n long, place long, root long"), "needed")
    large = large.join(sets_of(large.select("node"), lambda s: pack_sorted(s >> _U(64 - KEPT))), "node").select("h", "node", "n", "place", "root", "s")
    more, _ = saved(by_shingle(large).mapInArrow(_linked, "a long, b long"), "linked")
    links = links.union(more)
    label = nodes.select("node", "key", "least").join(components(links), "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))
    kept, _ = saved(label.groupBy("root").agg(F.min(F.struct("least", "key")).alias("x")).select(F.col("x.least").alias("id"), "x.key"), "kept")
    return kept, rows.select("id", "key")


def once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id; rows without id stay.

    Texts are not shuffled if the ids that go are few. Rows that share an id are
    told apart by their words.
    """
    kept, rows = groups(docs, id_col, text_col)
    cols, name = docs.columns, F.col(f"`{id_col}`")
    own_id = lambda ids: ids.select(F.col("id").alias("__id"))
    shared, _ = saved(rows.groupBy("id").count().where("count > 1").select("id"), "shared_ids")
    gone, _ = saved(rows.select("id").join(kept, "id", "left_anti").union(shared).distinct(), "gone")
    single = docs.where(name.isNotNull()).join(few(own_id(gone)), name.cast("long") == F.col("__id"), "left_anti")
    # rows of one id that hold the same words are copies too
    several = docs.join(few(own_id(shared)), name.cast("long") == F.col("__id"))
    several = several.join(kept.select(F.col("id").alias("__kept"), F.col("key").alias("__key")), F.col("__id") == F.col("__kept")).drop("__id", "__kept")
    at = cols.index(text_col)

    @lean()
    def own(batches):
        for b in batches:
            yield b.filter(pa.array([xxhash.xxh3_128_digest(words(t).tobytes()) == k for t, k in zip(b.column(at), b.column(len(cols)).to_pylist(), strict=True)], pa.bool_()))

    several = several.mapInArrow(own, several.schema)
    several = several.groupBy(f"`{id_col}`", "__key").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("x")).select("x.*")
    return single.union(several).union(docs.where(name.isNull()))
