"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity``. Only the histogram of piece lengths (at
most ``capacity`` numbers, whatever the corpus) comes to the driver. From it a plan is made:
a table of counts keyed by length is asked for the exact complement of the longest length left
and of its sums with every one and every two other lengths; each find is used as often as the counts allow at once, so every
step uses up a length. What has no exact complement is packed best-fit by counts. Executors then
place each piece by its rank within its length, so the placing is one pass over small rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces_of, slices

_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _chunks(text: str) -> list[str]:
    """Chunks between white space; Latin-1 texts in lower case, as the vocabulary's normalizer has them."""
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def encode(path: str, texts: list[str | None], remember: int | None = None) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text.

    For vocabularies that put text in lower case and whose pre-tokenizer drops white space and
    never looks across it: a text's ids are then those of its chunks, one after the other.
    """
    flat: list[str] = []
    ends = [0]
    for t in texts:
        flat += _chunks(t) if t else ()
        ends.append(len(flat))
    ids = pieces_of(path, lengths=False, generation=remember)(flat)
    return [b"".join(ids[s:e]) for s, e in zip(ends, ends[1:], strict=False)]


def _fill(table: np.ndarray, lengths: np.ndarray, longest: int, gap: int, three: bool) -> tuple[int, ...] | None:
    """The two or three lengths, none above longest, that fill the gap exactly and most often; None if no left ones do.

    table: pieces left, by length; lengths: those with any. All sums are looked at.
    """
    a = lengths[lengths <= gap // (3 if three else 2)]
    if three:
        b = lengths[lengths <= gap // 2]
        a, b = np.repeat(a, len(b)), np.tile(b, len(a))
        a, b = a[b >= a], b[b >= a]
        c = gap - a - b
        ok = (c >= b) & (c <= longest)
        ok[ok] = table[c[ok]] > 0
        rows = np.stack((a[ok], b[ok], c[ok]))
    else:
        c = gap - a
        ok = c <= longest
        ok[ok] = table[c[ok]] > 0
        rows = np.stack((a[ok], c[ok]))
    if not rows.shape[1]:
        return None
    rows = np.vstack((np.full((1, rows.shape[1]), longest), rows))
    times = np.min([table[x] // (rows == x).sum(0) for x in rows], axis=0)
    at = int(times.argmax())
    return tuple(rows[1:, at].tolist()) if times[at] else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that use up the counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    table = np.zeros(capacity + 1, np.int64)
    for n, c in left.items():
        table[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], times: int) -> None:
        out.append((lengths, times))
        for n in lengths:
            left[n] -= times
            table[n] -= times
        for n in set(lengths):
            if not left[n]:
                del left[n]

    def times(lengths: tuple[int, ...]) -> int:
        return min(left.get(n, 0) // lengths.count(n) for n in set(lengths))

    for longest in sorted(left, reverse=True):
        while longest in left:
            gap = capacity - longest
            found = None
            if gap == 0:
                found = (longest,)
            elif times((longest, gap)):
                found = (longest, gap)
            else:
                lengths = np.flatnonzero(table)
                more = _fill(table, lengths, longest, gap, three=False) or _fill(table, lengths, longest, gap, three=True)
                if more:
                    found = (longest, *more)
            if not found:
                break
            use(found, times(found))
    while left:  # best fit of the rest: the longest that still fits, again and again
        lengths, room, used = [], capacity, {}
        order = sorted(left, reverse=True)
        for n in order:
            while n <= room and used.get(n, 0) < left[n]:
                lengths.append(n)
                room -= n
                used[n] = used.get(n, 0) + 1
        use(tuple(lengths), max(1, times(tuple(lengths))))
    return out


def _slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length its intervals of ranks: the first sequence of each and the offset within them."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in made:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            rows.append((n, rank, base, offset))
            taken[n] = rank + times
            offset += n
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"at": a[:, 0], "rank": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


def pieces(docs: DataFrame, path: str, capacity: int, doc_id: str, text: str, end_id: int, remember: int, slice_bytes: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")
        for b in slices(batches, "text", slice_bytes):
            ids, rows = b.column("doc_id"), []
            for i, own_ids in enumerate(encode(path, b.column("text").to_pylist(), remember)):
                data = own_ids + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((i, k, at // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            a = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), pa.array(a[:, 2]), pa.array(a[:, 3]), pa.array(a[:, 4]), pa.array(np.full(len(a), part, np.int32)), pa.array(a[:, 5])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, remember: int = 600_000, slice_bytes: int = 3 << 19) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    path: a vocabulary file of the tokenizers library whose pre-tokenizer drops white space. A
    document is its ids and then ``end_id``; null and empty texts are that id alone. Only
    documents longer than ``capacity`` are cut. Ids may be null or repeated: every row is packed.
    An empty table gives no rows; other columns are not read. remember (pieces, twice) and
    slice_bytes bound a worker's memory at the cost of encoding more often; results don't depend on them.
    """
    cuts = cut(pieces(docs, path, capacity, doc_id, text, end_id, remember, slice_bytes), texts=True)
    by_part = cut(cuts.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slot = _slots(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # a length may hold most pieces, but never more than a task's in one part: no key of the join is larger than a task was
    ranked = cuts.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(slot["rank"].max(initial=0)) + 2 if len(slot["rank"]) else 2
        big = max(span, max(counts.values(), default=0) + 2)
        keys = slot["at"] * big + slot["rank"]
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, n * big + rank, side="right") - 1
            seq = slot["base"][at] + rank - slot["rank"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(slot["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cuts.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
