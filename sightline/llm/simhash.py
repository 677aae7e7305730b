"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint bit is set if over half of the shingles' hashes have it set.
For the radius r, each of the 64 bit positions gets a nonzero vector of r + 1
bits; table v (nonzero, 2^(r+1) - 1 of them) compares the positions whose
vector has an odd inner product with v. Any r differing positions leave some v
orthogonal to all their vectors, so every pair within the radius agrees in that
table: no pair is missed (Pagh, "Locality-sensitive hashing without false
negatives", 2016).

How it runs. Equal fingerprints are first joined by a grouped minimum, so exact
copies cost nothing later. Distinct fingerprints are dealt by table and masked
value, sorted, and read group by group; a group yields links to the members'
local roots only (fewer links than members), found by direct comparison in
blocks. A group is held up to ``large`` members; what goes beyond is passed on row
by row and dealt again, by r + 1 blocks of its uncompared positions (of at most r
differing positions one block is free), at most ``LEVELS`` times. In the last
deal so few positions are left open (14 for r = 3) that the distinct fingerprints
of a group number at most two to that power, so no task holds an unbounded
group. Components of the links come from the engine's component operator.

Cases. Null text or a text without words: fingerprint zero, linked like any
other. Fewer words than a shingle: the whole sequence is one shingle. Null id:
a row with its fingerprint; the component is that of its fingerprint, null if no
row with an id has it. Repeated ids: each row is returned. Ties: all of several
fingerprints at the same distance are linked. Very long texts are hashed whole,
bits counted in parts. Empty tables give empty results. Only the two named
columns are read, so further columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship, table
from ..operators.components import components
from .resident import lean

_U = np.uint64
BITS, SEED = 64, 42
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: How often groups that are too large are dealt again.
LEVELS = 3


def fingerprint(data: bytes, k: int = 3) -> int:
    """The 64-bit fingerprint of a text's bytes."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - k + 1)
    spans = zip(starts[:n].tolist(), (ends[k - 1:] if len(words) >= k else ends[-1:]).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[s:e], SEED) for s, e in spans), _U, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        part = h[i:i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``id, fp``: the fingerprint as a signed long."""
    ship(docs.sparkSession)

    @lean()
    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint(x.as_buffer().to_pybytes(), k)) if x.is_valid else 0 for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.mapInArrow(run, "id long, fp long")


def masks(radius: int) -> list[int]:
    """The masks of the covering family, as signed longs."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(BITS)]
    return [_signed(sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)) for v in range(1, 1 << (radius + 1))]


def _links(fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same nodes as all pairs of the group within the radius."""
    left, links = np.arange(len(fp)), []
    while len(left):  # grow one component at a time, taking its members out
        seen, front = [left[0]], left[:1]
        left = left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                rest = np.flatnonzero(~near)
                step = max(1, (1 << 22) // max(1, len(rest)))
                for j in range(i, min(i + 256, len(front)), step):
                    block = front[j:min(j + step, i + 256)]
                    near[rest] |= (np.bitwise_count(fp[block][:, None] ^ fp[left[rest]][None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            seen += front.tolist()
        if len(seen) > 1:
            root = min(node[seen])
            links += [(int(x), int(root)) for x in node[seen] if x != root]
    return links


def _grouped(radius: int, large: int | None):
    """Reads rows sorted by table and key; yields links (table -1), or the rows of groups over ``large`` again."""

    def batch(t, a, b):
        return pa.record_batch([pa.array(x, pa.int64()) for x in (t, a, b)], names=["t", "a", "b"])

    @lean()
    def run(batches):
        key, held, n, over = None, [], 0, False

        def passed():
            a = np.concatenate(held)
            held.clear()
            return batch(a[:, 0], a[:, 2], a[:, 3])

        def end():
            if over:
                return passed() if held else None
            a = np.concatenate(held)
            found = np.array(_links(a[:, 2].view(_U), a[:, 3], radius), np.int64).reshape(-1, 2) if len(a) > 1 else ()
            return batch(np.full(len(found), -1), found[:, 0], found[:, 1]) if len(found) else None

        for b in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if not len(a):
                continue
            cuts = np.flatnonzero((a[1:, :2] != a[:-1, :2]).any(axis=1)) + 1
            for part in np.split(a, cuts) if len(cuts) < 64 else _several(a, cuts):
                if key != (part[0, 0], part[0, 1]):
                    if key is not None and (out := end()):
                        yield out
                    key, held, n, over = (part[0, 0], part[0, 1]), [], 0, False
                held.append(part)
                n += len(part)
                over = bool(large) and n > large
                if over:
                    yield passed()
        if key is not None and (out := end()):
            yield out

    return run


def _several(a: np.ndarray, cuts: np.ndarray):
    """The first and last group, and those between that have at least two rows."""
    edge = np.concatenate([[0], cuts, [len(a)]])
    size = np.diff(edge)
    size[[0, -1]] = 2
    for g in np.flatnonzero(size > 1):
        yield a[edge[g]:edge[g + 1]]


def links(nodes: DataFrame, radius: int = 3, large: int = 2000) -> DataFrame:
    """``a, b``: links of ``fp, node`` rows whose components are those of all pairs within the radius."""
    again, found, cells = nodes.select(F.lit(0).cast("long").alias("t"), "fp", "node"), [], [masks(radius)]
    for level in range(LEVELS + 1):
        # the masks of each cell of the level before
        by_cell = F.array(*[F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(_signed(m & (1 << 64) - 1)).alias("m")) for t, m in part]) for part in _numbered(cells)])
        dealt = again.select(F.explode(by_cell[F.col("t").cast("int")]).alias("x"), "fp", "node").select("x.t", F.col("x.m").bitwiseAND(F.col("fp")).alias("key"), "fp", "node")
        dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp", "node")
        out, _ = saved(dealt.mapInArrow(_grouped(radius, large if level < LEVELS else None), "t long, a long, b long"), "near")
        found.append(out.where("t < 0").select("a", "b"))
        again = out.where("t >= 0").select("t", F.col("a").alias("fp"), F.col("b").alias("node"))
        if level == LEVELS or not again.limit(1).count():
            break
        cells = [_finer(m, radius) for part in cells for m in part]
    links_, *rest = found
    for r in rest:
        links_ = links_.union(r)
    return links_


def _numbered(cells: list[list[int]]):
    """Each cell's masks, numbered on."""
    n = 0
    for part in cells:
        yield list(enumerate(part, n))
        n += len(part)


def _finer(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 blocks of its open positions more: one of them is free of differences."""
    open_bits = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in open_bits[j::radius + 1]) for j in range(radius + 1)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """``id, fp, component_id`` of every row; component: smallest id reachable by links."""
    fps, _ = saved(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes = fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node"))
    nodes, _ = saved(nodes, "nodes")
    roots = components(links(nodes, radius))
    label = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(label, "fp", "left").select("id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprints and components of the whole ``documents``."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
