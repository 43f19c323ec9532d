"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within ``distance`` bits agree on one of distance + 1 blocks of bits. For each block
the index is a hierarchy over codes whose bits are put in order with that block first. Its topmost
nodes hold the codes that share the first few bits, as few as leave about NODE codes to a node, and
are dealt out over the cluster. Within a node, codes are sorted by Gray rank; further nodes hold
the bits that a run of codes shares (pattern under mask), and a search adds up differences from
the top down and drops a whole run as soon as they exceed the distance. A node of too many codes
is divided by the rest of its block, then by blocks of what is left of the bits, again distance + 1
of them, so that no pair in reach is parted and a node cannot stay full: after a few divisions
there are not bits enough left. Copies of a text have one fingerprint and take part once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, cut, packed, row_key, slices, small, spread_join
from .graph import components

#: Nodes that one node of the next level up covers; codes aimed at, and at most, in one of the dealt nodes.
FAN, NODE, FULL = 16, 1024, 16_384


def _hashed(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's word shingles in parts; the whole sequence where it has fewer words, nothing where it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), 1 << 15):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[i : i + (1 << 15)].tolist(), ends[i : i + (1 << 15)].tolist(), strict=True)], np.uint64)


def _margins(parts: Iterable[np.ndarray], words: int) -> np.ndarray:
    """For each of 64 * words bits: shingle hashes with that bit less those without. Words after the first are mixed from the same hash."""
    total, n = np.zeros((words, 64), np.int64), 0
    for h in parts:
        for k in range(words):
            bits = np.unpackbits((_mixed(h, k) if k else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[k] += bits.sum(0, dtype=np.int64)
        n += len(h)
    return 2 * total.reshape(-1) - n


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash, signed, of word shingles with repeats; 0 for null or a text without words."""
    return int(np.packbits(_margins(_hashed(text, width), 1) > 0, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, rk, fp), a written table: one row for each row of docs; rk is the row's content key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = [fingerprint(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(fps, pa.int64())], ["doc_id", "rk", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return cut(named.withColumn("rk", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(run, f"doc_id {kind}, rk binary, fp long"), texts=True)


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _gray_code(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(1))


def _layouts(distance: int, level: int, coarse: int = 0) -> list[tuple[list[int], int]]:
    """For each path of the level: the order of bits with the key bits first, and how many are key bits.

    A path of level 0 or 1 is a block, of which level 0 takes the first ``coarse`` bits as key; each
    further level adds one of distance + 1 blocks of the bits left.
    """
    parts = distance + 1
    paths: list[list[int]] = [[]]
    for _ in range(max(1, level)):
        paths = [[*own, *block.tolist()] for own in paths for block in np.array_split(np.array([i for i in range(64) if i not in own]), parts)]
    return [([*own, *[i for i in range(64) if i not in own]], min(coarse, len(own)) if level == 0 else len(own)) for own in paths]


def _permute(x: np.ndarray, order: list[int]) -> np.ndarray:
    bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits[:, order], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _deal(distance: int, level: int, coarse: int):
    """Rows (path, fp) to rows (path, key, rank, fp) of the level. Above level 0, path is that of the level before."""
    layouts, parts = _layouts(distance, level, coarse), distance + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, paths = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "path"))
            for t, (order, n_key) in enumerate(layouts):
                fp = fps if level == 0 else fps[paths == (t if level == 1 else t // parts)]
                if not len(fp):
                    continue
                code = _permute(fp.view(np.uint64), order)
                key = code >> np.uint64(64 - n_key) if n_key else np.zeros(len(code), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64)), pa.array(_gray_rank(code).view(np.int64)), pa.array(fp)], ["path", "key", "rank", "fp"])

    return run


class _Union:
    """Smallest index reachable, over pairs of indexes that come in bulk."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.of[a], self.of[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.of, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def hierarchy(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the leaves up, each (pattern, mask): the bits that FAN nodes of the level below share.

    codes: one 64-bit word each, or a row of several.
    """
    levels = [(codes, np.full(codes.shape, ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        shared = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern, at))
        levels.append((pattern[at] & shared, shared))
    return levels


def _bits(x: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(x)
    return n if n.ndim == 1 else n.sum(1, dtype=np.int64)


def search(levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, distance: int, tried: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query index, leaf index) of all pairs within the distance, from the top level down. tried: gets how many nodes each level was asked for."""
    pattern, mask = levels[-1]
    q, node = np.repeat(np.arange(len(queries)), len(pattern)), np.tile(np.arange(len(pattern)), len(queries))
    far = _bits((queries[q] ^ pattern[node]) & mask[node])
    for k in range(len(levels) - 1, -1, -1):
        if tried is not None:
            tried.append(len(q))
        keep = far <= distance
        q, node, far = q[keep], node[keep], far[keep]
        if k == 0:
            break
        below, own = levels[k - 1]
        child = node[:, None] * FAN + np.arange(FAN)
        real = child < len(below)
        parent = np.broadcast_to(node[:, None], child.shape)[real]
        q, far, node = np.broadcast_to(q[:, None], child.shape)[real], np.broadcast_to(far[:, None], child.shape)[real], child[real]
        far = far + _bits((queries[q] ^ below[node]) & own[node] & ~levels[k][1][parent])  # only bits not counted above
    return q, node


def _meet(node: np.ndarray, rank: np.ndarray, fp: np.ndarray, distance: int) -> pa.RecordBatch:
    """At most one edge for each fingerprint, to the smallest it reaches within the nodes at hand. node: sorted."""
    code, union = _gray_code(rank.view(np.uint64)), _Union(len(node))
    edge = np.flatnonzero(np.diff(node)) + 1
    for s, e in zip(np.concatenate(([0], edge)).tolist(), np.concatenate((edge, [len(node)])).tolist(), strict=True):
        if e - s < 2:
            continue
        levels, chunk = hierarchy(code[s:e]), max(1, 2_000_000 // (e - s))
        for i in range(s, e, chunk):
            q, leaf = search(levels, code[i : min(e, i + chunk)], distance)
            union.add(q + i, leaf + s)
    moved = np.flatnonzero(union.of != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[union.of[moved]])], ["a", "b"])


def _nodes(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rank, fp = (np.empty(0, np.int64) for _ in range(3))
        last = None
        for b in batches:
            path, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("path", "key"))
            new = np.ones(len(key), np.int64)
            new[1:] = (path[1:] != path[:-1]) | (key[1:] != key[:-1])
            new[0] = last != (path[0], key[0])
            last = (path[-1], key[-1])
            node = np.concatenate((node, (node[-1] if len(node) else 0) + np.cumsum(new)))
            rank, fp = (np.concatenate((x, b.column(c).to_numpy(zero_copy_only=False))) for x, c in ((rank, "rank"), (fp, "fp")))
            if len(node) >= 50_000 and (whole := int(np.searchsorted(node, node[-1]))):
                yield _meet(node[:whole], rank[:whole], fp[:whole], distance)
                node, rank, fp = node[whole:], rank[whole:], fp[whole:]
        if len(node):
            yield _meet(node, rank, fp, distance)

    return run


def links(fps: DataFrame, distance: int = 2, node: int = NODE, full: int = FULL, broadcast_rows: int = 100_000) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints which chains of links within the distance connect.

    fps: distinct, column ``fp``, a written table. node: codes aimed at in a dealt node; nodes
    of more than ``full`` codes are divided. There are as many nodes as shuffle partitions at least.
    """
    n, parts = fps.count(), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coarse = max(0, int(np.ceil(np.log2(max(1, n / node, parts if n > parts else 1)))))
    now, found, level = fps.select(F.lit(0).alias("path"), "fp"), [], 0
    while True:
        dealt = now.mapInArrow(_deal(distance, level, coarse), "path int, key long, rank long, fp long")
        last = all(2 ** (64 - n_key) <= full for _, n_key in _layouts(distance, level, coarse))
        hot = cut(dealt.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > full).select("path", "key"))
        divided = not last and not small(hot, 0)
        rest = bounded_join(dealt, hot, ["path", "key"], "left_anti", broadcast_rows) if divided else dealt
        found.append(rest.repartition("path", "key").sortWithinPartitions("path", "key", "rank").mapInArrow(_nodes(distance), "a long, b long"))
        if not divided:
            return reduce(DataFrame.unionAll, found).distinct()
        now, level = cut(bounded_join(dealt, hot, ["path", "key"], "left_semi", broadcast_rows).select("path", "fp")), level + 1


def _resolved(docs: DataFrame, doc_id: str, text: str, width: int, distance: int) -> DataFrame:
    """(doc_id, rk, fp, component_id, winner): winner is the row key of the component's row that stays."""
    prints = fingerprints(docs, doc_id, text, width)
    each = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rk")).alias("w"), F.count("*").alias("n")))
    joined = components(links(each, distance), "a", "b")
    rooted = cut(each.join(joined, each.fp == joined.node, "left").select("fp", "n", "first_id", "w", F.coalesce("component", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("w").alias("w"), F.count("*").alias("m")).select("root", "component_id", F.col("w.rk").alias("winner"), "m"))
    of = cut(spread_join(rooted.select("fp", "n", "root"), least, "root", counted="m").select("fp", "n", "component_id", "winner"))
    return spread_join(prints, of, "fp", counted="n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id whose fingerprint is reachable by links of at most
    ``distance`` differing bits. Null text counts as empty, and texts without words have
    fingerprint zero, linked like any other. Null ids get a row too but are never a component's
    smallest (a component of null ids only has a null component_id). Repeated rows each get a row.
    An empty table gives no rows. Columns other than the two named are not read.
    """
    return _resolved(docs, doc_id, text, width, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _only(docs: DataFrame, kept: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> DataFrame:
    """The rows of docs whose row key is in kept (rk, _n), once each."""
    rows = packed(docs, rk=row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    once = bounded_join(rows, kept.where("_n = 1").select("rk"), "rk", "left_semi", broadcast_rows, wide=True).select("_row.*")
    again = kept.where("_n > 1").select("rk")
    if small(again, 0):
        return once
    repeats = bounded_join(rows, again, "rk", "left_semi", broadcast_rows, wide=True).groupBy("rk").agg(F.first("_row").alias("_row"))
    return once.unionAll(repeats.select("_row.*"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Null ids come last; rows that share the id are told apart by content hash, and of rows equal
    in id and text one stays. All columns are kept. Texts move only where the winners' keys are
    too many to broadcast, or a winner is repeated.
    """
    kept = cut(_resolved(docs, doc_id, text, width, distance).where("rk = winner").groupBy("rk").agg(F.count("*").alias("_n")))
    return _only(docs, kept, doc_id, text, broadcast_rows)


@dataclass(frozen=True)
class Wide:
    """Near copies by wide fingerprints of distinct shingles: 64 * words bits, linked within ``radius`` and then verified on the texts.

    Fingerprints of texts at similarity 0.8 differ in 39 of 256 bits on average and in 52 almost
    never. Each is filed in ``tables`` cells of ``key_bits`` bits, and in the ``probes`` - 1 cells
    that flipping its least certain key bits gives. A larger corpus wants more key bits, no more
    rows. Nodes above ``node_rows`` are split into pairs of chunks, texts with more than
    ``text_links`` links are dealt out by salt. Texts behind failed links meet in chunks of
    ``chunk`` bytes of shingles.
    """

    words: int = 4
    radius: int = 52
    tables: int = 8
    key_bits: int = 20
    probes: int = 8
    node_rows: int = 16_384
    text_links: int = 256
    chunk: int = 16 << 20


#: Sets of at most three of the six least certain bits.
_FLIPS = np.array([[i in c for i in range(6)] for r in range(4) for c in combinations(range(6), r)], np.int64)


def cells(margins: np.ndarray, w: Wide) -> np.ndarray:
    """The cells of a fingerprint: table, then key bits, for each table the likeliest under noise first."""
    z = margins[: w.tables * w.key_bits].reshape(w.tables, w.key_bits)
    order = np.argsort(np.abs(z), axis=1, kind="stable")[:, :6]
    cost = np.take_along_axis(np.abs(z), order, 1) @ _FLIPS.T
    chosen = _FLIPS[np.argsort(cost, axis=1, kind="stable")[:, : w.probes]]
    flips = (chosen << order[:, None, :]).sum(2)
    base = ((z > 0).astype(np.int64) << np.arange(w.key_bits)).sum(1)
    return ((np.arange(w.tables)[:, None] << w.key_bits) | (base[:, None] ^ flips)).reshape(-1)


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Indexes of edges of a minimum spanning forest: it connects at every distance what all the edges connect."""
    of, out = np.arange(n), []
    for d in np.unique(far):
        at = np.flatnonzero(far == d)
        while len(at):
            ra, rb = of[a[at]], of[b[at]]
            apart = ra != rb
            at, hi, lo = at[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            roots, first = np.unique(hi, return_index=True)  # every root is hooked once, to a smaller one
            out.append(at[first])
            of[roots] = lo[first]
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of = up
    return np.concatenate(out) if out else np.empty(0, int)


def _within(key: np.ndarray, sig: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all pairs i < j of one node within the radius, in parts. key, sig: as _ordered gives them."""
    edge = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
    sizes = ends - starts
    rows = np.repeat(sizes <= FAN, sizes)
    for step in range(1, FAN):
        i = np.flatnonzero(rows[:-step] & (key[step:] == key[:-step])) if len(key) > step else np.empty(0, int)
        if not len(i):
            break
        d = _bits(sig[i] ^ sig[i + step])
        near = d <= radius
        yield i[near], i[near] + step, d[near]
    for s, e in zip(starts[sizes > FAN], ends[sizes > FAN], strict=True):
        levels, chunk = hierarchy(sig[s:e]), max(1, 500_000 // int(e - s))
        for i in range(int(s), int(e), chunk):
            q, leaf = search(levels, sig[i : min(e, i + chunk)], radius)
            up = q + i < leaf + s
            q, leaf = q[up] + i, leaf[up] + s
            yield q, leaf, _bits(sig[q] ^ sig[leaf])


def _ordered(key: np.ndarray, sig: np.ndarray) -> np.ndarray:
    return np.lexsort((_gray_rank(sig[:, 0]), key))


def _batch(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sig[k]], pa.binary()) for k in (a, b)], ["a", "b"])


def _near(key: np.ndarray, sig: np.ndarray, radius: int) -> pa.RecordBatch:
    """Forest edges within the nodes at hand. key: sorted; sig: words of each fingerprint."""
    order = _ordered(key, sig)
    key, sig = key[order], sig[order]
    held = [np.empty(0, int)] * 3
    for found in _within(key, sig, radius):
        held = [np.concatenate((x, y)) for x, y in zip(held, found, strict=True)]
        if len(held[0]) > 1_000_000:
            at = forest(*held, len(key))
            held = [x[at] for x in held]
    at = forest(*held, len(key))
    return _batch(sig, held[0][at], held[1][at])


def _near_nodes(w: Wide):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, last = np.empty(0, np.int64), np.empty((0, w.words), np.uint64), None
        for b in batches:
            part = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")], 1)
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]).any(1)
            new[0] = last is None or (part[0] != last).any()
            key = np.concatenate((key, (key[-1] if len(key) else 0) + np.cumsum(new)))
            rows = np.concatenate((rows, np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(-1, w.words)))
            last = part[-1]
            if len(key) >= 50_000 and (whole := int(np.searchsorted(key, key[-1]))):
                yield _near(key[:whole], rows[:whole], w.radius)
                key, rows = key[whole:], rows[whole:]
        if len(key):
            yield _near(key, rows, w.radius)

    return run


def near_links(classes: DataFrame, w: Wide = Wide()) -> DataFrame:  # noqa: B008
    """(a, b): pairs of fingerprints that connect, at every distance up to the radius, what all pairs connect.

    classes: distinct ``sig`` with its ``cells``.
    """
    filed = classes.select("sig", F.explode("cells").alias("key"))
    full = cut(filed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > w.node_rows))
    dealt = filed.select("key", "sig", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    if not small(full, 0):
        chunks = full.select("key", F.ceil(F.col("rows") / w.node_rows).cast("int").alias("m"))
        of = bounded_join(filed, chunks, "key", "left", 100_000).withColumn("m", F.coalesce("m", F.lit(1)))
        of = of.withColumn("part", F.pmod(F.xxhash64("sig"), "m").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        dealt = of.select("key", "sig", F.least("part", "i").alias("lo"), F.greatest("part", "i").alias("hi"))
    met = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return met.mapInArrow(_near_nodes(w), "a binary, b binary").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _distinct(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashed(text, width)]))


def similarity(a: str | None, b: str | None, width: int = 5) -> float:
    """Jaccard similarity of two texts' word shingles; 1 where neither has words."""
    return _overlap(_distinct(a, width), _distinct(b, width))


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float, w: Wide) -> DataFrame:
    """The pairs (a, b, ra, rb) whose texts have the similarity. texts: rk, text. A text with many links is copied to as many tasks."""

    def end(left: DataFrame, r: str, other: str, t: str) -> DataFrame:
        busy = cut(pairs.groupBy(r).agg(F.ceil(F.count("*") / w.text_links).cast("int").alias("m")))
        copied = texts.select(F.col("rk").alias(r), F.col("text").alias(t)).join(busy, r).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).drop("m")
        many = busy.where("m > 1")  # fewer than links / text_links
        salted = bounded_join(left, many, r, "left", 100_000).withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("m", F.lit(1))).cast("int")).drop("m")
        return salted.join(copied, [r, "salt"]).drop("salt")

    met = end(end(pairs, "ra", "b", "ta"), "rb", "a", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = b.column("ta").to_pylist(), b.column("tb").to_pylist()
            sets = {t: _distinct(t, width) for t in {*ta, *tb}}
            near = [_overlap(sets[x], sets[y]) >= least for x, y in zip(ta, tb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def alike_of(sets: list[np.ndarray], root: list, ask: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that join the roots of one node as all its pairs at similarity ``least`` or more would: fewer than there are texts.

    sets: distinct shingles of each text. ask: the texts to compare with all others; pairs of two
    texts that are not asked for are left out. Overlaps are counted through an index of shingles,
    and only across what is not joined yet.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(size)
    which = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(which, kind="stable")]
    shared = np.bincount(which)
    first = np.cumsum(shared) - shared
    of, edges = np.unique(np.array(root, object), return_inverse=True)[1].reshape(-1), []
    for i in np.flatnonzero(ask).tolist():
        own = which[ends[i] - size[i] : ends[i]]
        own = own[shared[own] > 1]
        n = shared[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((of != of[i]) & (both / np.maximum(1, size + size[i] - both) >= least))
        for j in near.tolist():
            if of[j] != of[i]:
                of[of == of[j]] = of[i]
                edges.append((i, j))
    return edges


def _alike_nodes(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(rows: list[tuple]) -> pa.RecordBatch:
            sig, root, shingles, ask = zip(*rows, strict=True)
            found = alike_of([np.frombuffer(x, np.uint64) for x in shingles], root, np.array(ask), least)
            return pa.RecordBatch.from_arrays([pa.array([sig[e[k]] for e in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        held, at = [], None
        for b in batches:
            node = zip(*(b.column(c).to_pylist() for c in ("bundle", "lo", "hi")), strict=True)
            rows = zip(*(b.column(c).to_pylist() for c in ("sig", "root", "shingles", "ask")), strict=True)
            for here, row in zip(node, rows, strict=True):
                if held and here != at:
                    yield met(held)
                    held = []
                at = here
                held.append(row)
        if held:
            yield met(held)

    return run


def _behind(member: DataFrame, rep: DataFrame, texts: DataFrame, width: int, least: float, w: Wide) -> DataFrame:
    """(a, b): edges that join, within each bundle of linked fingerprints, all texts that chains of the similarity join.

    member: sig, bundle, root (what is joined already). Only bundles of several roots are read, and
    in those pairs of different roots are compared, inside tasks: a bundle is dealt out in chunks
    of ``w.chunk`` bytes, of which those of its commonest root, the core, do not meet each other.
    Rows that come out are fewer than the texts of each chunk pair.
    """
    tally = member.groupBy("bundle", "root").agg(F.count("*").alias("n"))
    several = cut(tally.groupBy("bundle").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1").select("bundle", F.col("top.root").alias("top")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [_distinct(t, width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("sig", "bundle", "root", "core")), pa.array(sets, pa.binary())], ["sig", "bundle", "root", "core", "shingles"])

    split = cut(bounded_join(member, several, "bundle", "inner", 100_000).select("sig", "bundle", "root", (F.col("root") == F.col("top")).alias("core")))
    whole = split.join(rep, "sig").join(texts, "rk").select("sig", "bundle", "root", "core", "text")
    held = cut(whole.mapInArrow(run, "sig binary, bundle binary, root binary, core boolean, shingles binary"), texts=True)
    size = F.octet_length("shingles") + 64
    sizes = held.groupBy("bundle").agg(F.sum(size).alias("all"), F.sum(F.when(F.col("core"), size)).alias("in_core"))
    one = F.col("all") <= w.chunk
    chunks = cut(sizes.select("bundle", F.when(one, 1).otherwise(F.ceil((F.col("all") - F.col("in_core")) / w.chunk)).cast("int").alias("mr"), F.when(one, 0).otherwise(F.ceil(F.col("in_core") / w.chunk)).cast("int").alias("mc")))
    parted = bounded_join(held, chunks, "bundle", "inner", 100_000)
    in_core = F.col("core") & (F.col("mc") > 0)
    part = F.when(in_core, F.col("mr") + F.pmod(F.xxhash64("sig"), F.col("mc"))).otherwise(F.pmod(F.xxhash64("sig"), F.col("mr"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_core, F.col("mr")).otherwise(F.col("mr") + F.col("mc")) - 1)
    dealt = parted.withColumn("part", part).withColumn("i", F.explode(others)).select("sig", "bundle", "root", "shingles", F.least("part", "i").alias("lo"), F.greatest("part", "i").alias("hi"), (~F.col("core") & (F.col("part") <= F.col("i"))).alias("ask"))
    return dealt.repartition("bundle", "lo", "hi").sortWithinPartitions("bundle", "lo", "hi").mapInArrow(_alike_nodes(least), "a binary, b binary")


def _near_copies(docs: DataFrame, doc_id: str, text: str, width: int, least: float, w: Wide, broadcast_rows: int) -> DataFrame:
    """(rk, component): row keys with their component, named by its winner's row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sig, key = [], []
            for t in b.column("text").to_pylist():
                own = _distinct(t, width)  # similarity is one of sets, so repeats must not move a fingerprint
                m = _margins((own[i : i + (1 << 15)] for i in range(0, len(own), 1 << 15)), w.words)
                sig.append(np.packbits(m > 0, bitorder="little").tobytes())
                key.append(cells(m, w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(sig, pa.binary()), pa.array(key, pa.list_(pa.int64()))], ["doc_id", "rk", "sig", "cells"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("rk", row_key(F.col("doc_id"), F.col("text")))
    prints = cut(named.mapInArrow(run, f"doc_id {kind}, rk binary, sig binary, cells array<long>"), texts=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rk")).alias("w")
    each = cut(prints.groupBy("sig").agg(first, F.first("cells").alias("cells"), F.count("*").alias("n")))
    links = cut(near_links(each, w), texts=True)
    rep = each.select("sig", F.col("w.rk").alias("rk"))
    wanted = cut(links.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(rep, "sig"))
    texts = cut(bounded_join(named.select("rk", "text"), wanted.select("rk").distinct(), "rk", "left_semi", broadcast_rows, wide=True).groupBy("rk").agg(F.first("text").alias("text")))

    one = cut(spread_join(links, rep.select(F.col("sig").alias("a"), F.col("rk").alias("ra")), "a"))
    pairs = cut(spread_join(one, rep.select(F.col("sig").alias("b"), F.col("rk").alias("rb")), "b").select("a", "b", "ra", "rb"))
    good = cut(_verified(pairs, texts, width, least, w), texts=True)
    joined = components(good, "a", "b")
    if not small(links.join(good, ["a", "b"], "left_anti"), 0):
        # a link that fails may have stood for pairs that hold, so texts that links connect and verified links do not are compared
        bundles = components(links, "a", "b").withColumnRenamed("component", "bundle")
        member = cut(bundles.join(joined, "node", "left").select(F.col("node").alias("sig"), "bundle", F.coalesce("component", "node").alias("root")))
        more = cut(_behind(member, rep, texts, width, least, w), texts=True)
        if not small(more, 0):
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b")
    rooted = cut(each.join(joined, each.sig == joined.node, "left").select("sig", "w", "n", F.coalesce("component", "sig").alias("root")))
    winners = cut(rooted.groupBy("root").agg(F.min("w").alias("w"), F.count("*").alias("m")).select("root", F.col("w.rk").alias("component"), "m"))
    of = cut(spread_join(rooted.select("sig", "n", "root"), winners, "root", counted="m").select("sig", "n", "component"))
    return spread_join(prints.select("sig", "rk"), of, "sig", counted="n").select("rk", "component")


def one_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, wide: Wide = Wide(), broadcast_rows: int = 500_000) -> DataFrame:  # noqa: B008
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Components are those of texts whose word shingles have Jaccard similarity ``least`` or more:
    wide fingerprints find the pairs, the texts decide. Null ids come last; rows that share the id
    are told apart by content hash, and of rows equal in id and text one stays. Null texts and
    texts without words are one component. All columns are kept; an empty table gives no rows.
    Texts move only where they have links, the winners' keys are too many to broadcast, or a
    winner is repeated.
    """
    found = _near_copies(docs, doc_id, text, width, least, wide, broadcast_rows)
    kept = cut(found.where("rk = component").groupBy("rk").agg(F.count("*").alias("_n")))
    return _only(docs, kept, doc_id, text, broadcast_rows)
