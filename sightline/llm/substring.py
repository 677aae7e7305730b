"""Substring dedup by fixed-block anchors.

A repeat of ``window`` words covers at least one whole block of
``(window + 1) // 2`` words of the earlier document, if the blocks start at
every multiple of their length. So the non-overlapping blocks of all documents
are the index, every rolling window of that length probes it, and only words
round a hit are looked at again: hits are extended by the hashes of the full
windows round them, and overlapping full windows join to maximal repeats.

How it runs. Documents are dealt into batches of a few MB by a hash. A batch
asks each hash bucket about all its sequences in one packed row, and gets one
packed row back. There are two such rounds: the anchors, then the full windows
round live anchors. A sequence is asked for once by a batch, so a passage that
millions of documents share costs a bucket one entry a batch; no pairs of
documents are ever made. Texts are shuffled once; the three passes over them
read the same exchange. Packed rows number batches times buckets, like the
blocks of any shuffle between them; a row's size is what a batch has for a bucket.

Windows are told apart by 96 bits, of two independent hashes of every word (see
``hashing``), each summed over the window: among 10^13 different windows a chance
agreement is expected less than once in a thousand runs. Anchors only choose
what to look at.

Cases. Null or empty text: no words. Very long texts are hashed in parts and
kept whole. Null id: the row is returned unchanged and is no
reference. Rows of equal id do not remove words from each other. Fewer words
than a window: nothing is removed. Empty tables give empty results. Only the
two named columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions, ship
from .hashing import pack_sorted, sequence_hashes, unpack_sorted, word_hashes

_U = np.uint64
#: Batches for each shuffle partition.
BATCHES = 4
#: Bits of an anchor's hash. A chance hit only costs a second look.
ANCHOR_BITS = 48


def _texts(t: pa.Table):
    """Each row's id (None too) and the bytes of its text."""
    for i, x in zip(t.column("id").to_pylist(), t.column("text"), strict=True):
        yield i, b"" if not x.is_valid else x.as_buffer().to_pybytes()


def _sequences(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of every ``k`` consecutive words, of rows with an id."""
    h, row, place = [], [], []
    for r, (i, data) in enumerate(_texts(t)):
        if i is None:
            continue
        s = sequence_hashes(word_hashes(data), k)
        h.append(s)
        row.append(np.full(len(s), r, np.int64))
        place.append(np.arange(len(s)))
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(h, _U), join(row, np.int64), join(place, np.int64)


def _ids(t: pa.Table) -> np.ndarray:
    return np.array([0 if i is None else i for i in t.column("id").to_pylist()], np.int64)


def _groups(h: np.ndarray, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the hashes (and second hashes), and where each distinct one starts in it."""
    order = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    if not len(h):
        return order, np.empty(0, np.int64)
    new = h[order][1:] != h[order][:-1]
    if g is not None:
        new |= g[order][1:] != g[order][:-1]
    return order, np.flatnonzero(np.append(True, new))


def _told(h: np.ndarray, g: np.ndarray, s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Where each pair of hashes (s, z) stands in (h, g), sorted by h; -1: nowhere."""
    at = np.searchsorted(h, s)
    most = int(np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))).max())
    out = np.full(len(s), -1)
    for k in range(most):
        i = np.minimum(at + k, len(h) - 1)
        out[(h[i] == s) & (g[i] == z)] = i[(h[i] == s) & (g[i] == z)]
    return out


def _by_bucket(u: np.ndarray, n: int, bits: int) -> list[tuple[int, slice]]:
    """Slices of sorted hashes for each of ``n`` buckets; buckets are ranges of hashes."""
    b = ((u >> _U(bits - 32)) * _U(n)) >> _U(32)
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    ends = [*starts[1:], len(b)] if len(b) else []
    return [(int(b[s]), slice(s, e)) for s, e in zip(starts, ends, strict=True)]


_ASK = "batch long, bucket int, hashes binary, extra binary"
_REPLY = "batch long, bucket int, reply binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _anchors(t: pa.Table, block: int):
    h, row, place = _sequences(t, block)
    h >>= _U(64 - ANCHOR_BITS)
    return h, row, place


def _ask_anchors(block: int, buckets: int):
    def ask(key, t):
        h, row, place = _anchors(t, block)
        order, at = _groups(h)
        if not len(at):
            return _rows(_ASK, [])
        ids = _ids(t)[row][order]
        indexed = np.maximum.reduceat((place[order] % block == 0).astype(np.uint8), at)
        several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        u = h[order][at]
        return _rows(_ASK, [(key[0].as_py(), b, pack_sorted(u[s]), np.packbits(indexed[s]).tobytes() + np.packbits(several[s]).tobytes()) for b, s in _by_bucket(u, buckets, ANCHOR_BITS)])

    return ask


def _collect(batches) -> tuple[list[tuple[int, int]], list[np.ndarray], list[bytes]]:
    names, hashes, extra = [], [], []
    for b in batches:
        for r in b.to_pylist():
            names.append((r["batch"], r["bucket"]))
            hashes.append(unpack_sorted(r["hashes"]))
            extra.append(r["extra"])
    return names, hashes, extra


def _answer_anchors(batches):
    """Live: a block of some document that at least two documents have somewhere."""
    names, hashes, extra = _collect(batches)
    if not names:
        return
    lens = [len(x) for x in hashes]
    bits = [np.unpackbits(np.frombuffer(e, np.uint8).reshape(2, -1), axis=1, count=n) for e, n in zip(extra, lens, strict=True)]
    indexed, several = np.concatenate(bits, axis=1)
    order, at = _groups(np.concatenate(hashes))
    size = np.diff(np.append(at, len(order)))
    live = (np.maximum.reduceat(indexed[order], at) > 0) & ((size > 1) | (np.maximum.reduceat(several[order], at) > 0))
    mask = np.empty(len(order), np.uint8)
    mask[order] = np.repeat(live, size)
    ends = np.cumsum(lens)
    yield from _rows(_REPLY, [(*n, np.packbits(mask[e - k:e]).tobytes()) for n, e, k in zip(names, ends, lens, strict=True)]).to_batches()


def _ask_windows(window: int, block: int, buckets: int):
    def ask(key, t, replies):
        h, row, place = _anchors(t, block)
        order, at = _groups(h)
        if not len(at):
            return _rows(_ASK, [])
        u = h[order][at]
        masks = dict(zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist(), strict=True))
        live = np.concatenate([np.unpackbits(np.frombuffer(masks[b], np.uint8), count=s.stop - s.start) for b, s in _by_bucket(u, buckets, ANCHOR_BITS)])
        hit = np.empty(len(h), np.uint8)
        hit[order] = np.repeat(live, np.diff(np.append(at, len(order))))
        seen, ids = np.append(0, np.cumsum(hit)), _ids(t)
        hashes, others, owner, at = [], [], [], 0
        for r, (i, data) in enumerate(_texts(t)):
            if i is None:
                continue
            words = word_hashes(data)
            n, full = max(0, len(words) - block + 1), max(0, len(words) - window + 1)
            if full:
                # a full window's blocks start at its first word up to window - block further
                near = seen[at + window - block + 1:at + window - block + 1 + full] > seen[at:at + full]
                if near.any():
                    hashes.append(sequence_hashes(words, window)[near])
                    others.append(_second(data, window)[near])
                    owner.append(np.full(len(hashes[-1]), ids[r]))
            at += n
        if not hashes:
            return _rows(_ASK, [])
        h, g, owner = np.concatenate(hashes), np.concatenate(others), np.concatenate(owner)
        order, at = _groups(h, g)
        least, most = np.minimum.reduceat(owner[order], at), np.maximum.reduceat(owner[order], at)
        u, v = h[order][at], g[order][at]
        return _rows(_ASK, [(key[0].as_py(), b, pack_sorted(u[s]), _planes(v[s]) + _planes(least[s]) + np.packbits(least[s] != most[s]).tobytes()) for b, s in _by_bucket(u, buckets, 64)])

    return ask


def _second(data: bytes, window: int) -> np.ndarray:
    """The second hashes of all windows."""
    return (sequence_hashes(word_hashes(data, 1), window) >> _U(32)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Values as byte planes, which compress well."""
    return values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(data: bytes, n: int, at: int, kind: str) -> np.ndarray:
    """``n`` values from a place (in bytes a value) on."""
    k = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, k * n, n * at).reshape(k, -1).T).view(kind).ravel()


def _answer_windows(batches):
    """The smallest id that has each window, where it may matter to the asking batch."""
    names, hashes, extra = _collect(batches)
    if not names:
        return
    lens = [len(x) for x in hashes]
    g = np.concatenate([_from_planes(e, n, 0, "<u4") for e, n in zip(extra, lens, strict=True)])
    least = np.concatenate([_from_planes(e, n, 4, "<i8") for e, n in zip(extra, lens, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8, offset=12 * n), count=n) for e, n in zip(extra, lens, strict=True)])
    h = np.concatenate(hashes)
    order, at = _groups(h, g)
    smallest = np.empty(len(h), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(order))))
    tell = (smallest < least) | (several > 0)
    rows, end = [], 0
    for name, n in zip(names, lens, strict=True):
        m = tell[end:end + n]
        if m.any():
            part = slice(end, end + n)
            rows.append((*name, pack_sorted(h[part][m]) + _planes(g[part][m]) + _planes(smallest[part][m])))
        end += n
    yield from _rows(_REPLY, rows).to_batches()


_OUT = "id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def _remove(window: int, texts: bool):
    schema = _OUT if texts else _OUT.rpartition(",")[0]

    def out(key, t, replies):
        known = [(x, len(x) // 20) for x in replies.column("reply").to_pylist()]
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        h = join([unpack_sorted(x[:8 * n]) for x, n in known], _U)
        g, least = join([_from_planes(x, n, 8, "<u4") for x, n in known], np.uint32), join([_from_planes(x, n, 12, "<i8") for x, n in known], np.int64)
        order = np.argsort(h)
        h, g, least = h[order], g[order], least[order]
        rows = []
        for i, data in _texts(t):
            words = data.split()
            gone = np.zeros(len(words), bool)
            if i is not None and len(h) and len(words) >= window:
                s = sequence_hashes(word_hashes(data), window)
                asked = np.flatnonzero(h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s)
                at = _told(h, g, s[asked], _second(data, window)[asked]) if len(asked) else asked
                starts = asked[(at >= 0) & (least[at] < i)]
                edge = np.zeros(len(words) + 1, np.int64)
                edge[starts] += 1
                np.subtract.at(edge, starts + window, 1)
                gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(compress(words, ~gone) if gone.any() else words)
            rows.append((i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *[kept] * texts))
        return _rows(schema, rows)

    return out, schema


def dedup_substrings(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", window: int = 13, texts: bool = True) -> DataFrame:
    """Remove each word covered by ``window`` words that a document of smaller id also has.

    Returns ``id, n_words, n_removed, kept_sha256`` and, if ``texts``, ``kept``
    (the words left, joined by one space). See the module for edge cases.
    """
    spark = docs.sparkSession
    ship(spark)
    block, buckets = (window + 1) // 2, partitions(spark)
    col = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    d = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    d = d.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(BATCHES * buckets)))
    deal = lambda asks: asks.repartitionById(buckets, F.col("bucket"))
    with_replies = lambda r, f, schema: d.groupBy("batch").cogroup(r.groupBy("batch")).applyInArrow(f, schema)
    asks = d.groupBy("batch").applyInArrow(_ask_anchors(block, buckets), _ASK)
    live = deal(asks).mapInArrow(_answer_anchors, _REPLY)
    asks = with_replies(live, _ask_windows(window, block, buckets), _ASK)
    owners = deal(asks).mapInArrow(_answer_windows, _REPLY)
    f, schema = _remove(window, texts)
    out = with_replies(owners, f, schema)
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the digest columns over the whole ``documents``."""
    from ..session import table

    return dedup_substrings(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("id", "doc_id")
