"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected to eight dimensions for each table (and block) by random normals,
scaled, and decoded to the nearest point of the lattice E8. A vector is filed under that cell and
the nearest of its 240 neighbours, so close vectors almost surely share a cell in some table. Cells
are dealt out by key; within a cell cosines are verified in double precision. A pair that meets
in several cells counts in the first one they share, which both ends tell from their own cells,
so links are counted without listing pairs. A cell above ``cell_rows`` is split into chunks, and
each pair of chunks is a task of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, cut, small, spread_join
from .graph import components


@dataclass(frozen=True)
class Lattice:
    """tables x probes cells for each vector, each cell a point of E8 in each of ``blocks`` blocks."""

    tables: int = 4
    probes: int = 4
    scale: float = 1.5
    blocks: int = 1
    seed: int = 11
    cell_rows: int = 4096


#: Settings by the number of distinct vectors of the largest label. Each finds 0.995 of the pairs at cosine
#: 0.93 or more, and unlike vectors share a cell ever more rarely, so that the comparisons of a row stay bounded
#: (measured: 0.028, 0.0042, 0.00026, 0.00006, 0.000004 and 0.0000005 of a label's rows).
LADDER = (
    (10_000, Lattice()),
    (100_000, Lattice(tables=4, probes=8, scale=2.0, blocks=2)),
    (2_000_000, Lattice(tables=4, probes=16, scale=1.5, blocks=2)),
    (20_000_000, Lattice(tables=5, probes=16, scale=2.0, blocks=3)),
    (200_000_000, Lattice(tables=6, probes=32, scale=1.6, blocks=3)),
    (None, Lattice(tables=6, probes=64, scale=1.8, blocks=4)),
)


#: The setting of any input, so that which pairs are found depends on the two vectors alone.
SETTING = LADDER[1][1]


def lattice_for(rows: int) -> Lattice:
    """The setting for a label of that many distinct vectors, for callers that give one by size; others find other pairs of the last 0.005."""
    return next(p for most, p in LADDER if most is None or rows <= most)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: pairs of +-1, and halves with an even number of minus signs."""
    whole = [v for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1) for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *halves], np.float64)


SHORTEST = _shortest()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    e = x[odd] - r[odd]
    k = np.abs(e).argmax(1)
    r[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def _near(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point and its best neighbours for each row, hashed, with squared distances."""
    p = decode(x)
    r = x - p
    toward = r @ SHORTEST.T
    k = min(probes - 1, 240)
    top = np.argpartition(-toward, k, axis=1)[:, :k] if k else np.empty((len(x), 0), int)
    points = np.concatenate([p[:, None], p[:, None] + SHORTEST[top]], axis=1)
    own = (r**2).sum(1)[:, None]
    far = np.concatenate([own, own - 2 * np.take_along_axis(toward, top, 1) + 2], axis=1)
    h = np.zeros(points.shape[:2], np.uint64)
    for i in range(8):
        h = _mix(h ^ (points[..., i] * 2).astype(np.int64).view(np.uint64))
    return h, far


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def cells(x: np.ndarray, lab: np.ndarray, p: Lattice) -> np.ndarray:
    """Cell keys [row, table, probe] of vectors of one dimension; labels are part of the key."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((len(x), p.tables, p.probes), np.uint64)
    for t in range(p.tables):
        matrix = np.random.default_rng((p.seed, t, x.shape[1])).normal(size=(x.shape[1], 8 * p.blocks)) / p.scale
        y, h, far = unit @ matrix, None, None
        for b in range(p.blocks):
            hb, fb = _near(y[:, 8 * b : 8 * b + 8], p.probes)
            if h is None:
                h, far = hb, fb
                continue
            every = (far[:, :, None] + fb[:, None, :]).reshape(len(x), -1)
            best = np.argsort(every, axis=1, kind="stable")[:, : p.probes]
            h = np.take_along_axis(_mix(h[:, :, None] ^ hb[:, None, :] * np.uint64(31)).reshape(len(x), -1), best, 1)
            far = np.take_along_axis(every, best, 1)
        out[:, t] = _mix(h ^ _mix(lab.view(np.uint64) ^ np.uint64(t * 1_000_003 + x.shape[1]))[:, None])
    return out


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _file(kind: str, p: Lattice):
    """Rows of classes to rows of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                sizes = b.column("e").value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    own = b.take(pa.array(rows))
                    x = own.column("e").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), -1)
                    keys = cells(x.astype(np.float64), own.column("lab").to_numpy(zero_copy_only=False), p).reshape(len(rows), -1)
                    n = keys.shape[1]
                    index = pa.array(np.repeat(np.arange(len(rows)), n))
                    raw = pa.array([v.tobytes() for v in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(own.column(c).take(index) for c in ("h1", "h2", "lab", "c", "n")), raw.take(index)], ["key", "h1", "h2", "lab", "c", "n", "e"])

    return run


def _verify(kind: str, p: Lattice, least: float):
    """Rows of whole cells, sorted, to (h1, h2, links, c, root)."""
    columns = ("key", "lo", "hi", "part", "lab", "h1", "h2", "c", "n")

    def solve(rows: dict[str, np.ndarray], raw: list[bytes]) -> pa.RecordBatch:
        new = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["lo"]) != 0) | (np.diff(rows["hi"]) != 0)) + 1
        edges = np.concatenate(([0], new, [len(raw)]))
        found_a, found_b = [], []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if e - s < 2:
                continue
            x = _matrix(raw[s:e], kind)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cross = rows["lo"][s] != rows["hi"][s]
            part, lab = rows["part"][s:e], rows["lab"][s:e]
            for i in range(0, e - s, 1024):
                a, b = np.nonzero(x[i : i + 1024] @ x.T >= least)
                a = a + i
                keep = (a < b) & (lab[a] == lab[b])
                if cross:
                    keep &= part[a] != part[b]
                found_a.append(a[keep] + s)
                found_b.append(b[keep] + s)
        a, b = (np.concatenate(f) if f else np.empty(0, int) for f in (found_a, found_b))
        a, b = _first_shared(a, b, rows, raw)
        links = np.bincount(a, rows["n"][b], len(raw)) + np.bincount(b, rows["n"][a], len(raw))
        root = rows["c"].copy()
        while True:
            low = np.minimum(root[a], root[b])
            if (low == root[a]).all() and (low == root[b]).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        hit = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(rows["h1"][hit]), pa.array(rows["h2"][hit]), pa.array(links[hit].astype(np.int64)), pa.array(rows["c"][hit]), pa.array(root[hit])], ["h1", "h2", "links", "c", "root"])

    def _first_shared(a, b, rows, raw):
        """Of the pairs, those whose first shared cell is the one at hand."""
        ends = np.unique(np.concatenate([a, b]))
        own = np.zeros((len(ends), p.tables * p.probes), np.uint64)
        sizes = np.array([len(raw[i]) for i in ends])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            own[at] = cells(_matrix([raw[i] for i in ends[at]], kind), rows["lab"][ends[at]], p).reshape(len(at), -1)
        keep = np.zeros(len(a), bool)
        of = np.zeros(len(raw), int)
        of[ends] = np.arange(len(ends))
        for i in range(0, len(a), 50_000):
            ka, kb = own[of[a[i : i + 50_000]]], own[of[b[i : i + 50_000]]]
            shared = (ka[:, :, None] == kb[:, None, :]).any(2)
            first = np.where(shared, ka, ~np.uint64(0)).min(1)  # the same from either end
            keep[i : i + 50_000] = first == rows["key"][a[i : i + 50_000]].view(np.uint64)
        return a[keep], b[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, raw = {c: np.empty(0, np.int64) for c in columns}, []
        for b in batches:
            rows = {c: np.concatenate([rows[c], b.column(c).to_numpy(zero_copy_only=False)]) for c in columns}
            raw += b.column("e").to_pylist()
            if len(raw) < 20_000:
                continue
            other = np.flatnonzero((rows["key"] != rows["key"][-1]) | (rows["lo"] != rows["lo"][-1]) | (rows["hi"] != rows["hi"][-1]))
            if whole := int(other[-1]) + 1 if len(other) else 0:
                yield solve({c: v[:whole] for c, v in rows.items()}, raw[:whole])
                rows, raw = {c: v[whole:] for c, v in rows.items()}, raw[whole:]
        if raw:
            yield solve(rows, raw)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, lattice: Lattice | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Rows are compared where labels are equal and not null. n_links counts the other rows linked
    directly at cosine ``least`` or more, copies included; component_id is the smallest vec_id
    reachable by links; kept is vec_id = component_id. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null label or a null vec_id, link with nothing:
    their component is their own vec_id (null if that is null, then kept is false). Vectors of
    different lengths are never compared. Rows that share a vec_id are one node of the components
    and each keep a row. Other columns are not read; an empty table gives no rows. Without a
    lattice, it is SETTING whatever the input, so a pair is found or not by its own two vectors.
    """
    kind = "<f8" if "double" in vectors.schema[embedding].dataType.simpleString() else "<f4"
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("e"), F.col(f"`{label}`").alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("e", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))
    keyed = named.withColumn("h1", F.when(sound, F.xxhash64("label", "e"))).withColumn("h2", F.when(sound, F.hash("e", "label")))
    classes = cut(keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.first(F.xxhash64("label")).alias("lab"), F.min("vec_id").alias("c"), F.count("*").alias("n"), F.first("e").alias("e")))
    lattice = lattice or SETTING
    filed = classes.mapInArrow(_file(kind, lattice), "key long, h1 long, h2 int, lab long, c long, n long, e binary")
    full = cut(classes.mapInArrow(_keys_only(kind, lattice), "key long").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > lattice.cell_rows))
    whole = filed.select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("part"))
    if not small(full, 0):
        chunks = cut(full.select("key", "rows", F.ceil(F.col("rows") / lattice.cell_rows).cast("int").alias("m")))
        dealt = bounded_join(filed, chunks, "key", "left", 100_000, counted="rows").withColumn("part", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("h1", "h2"), "m")).cast("int"))
        dealt = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("m") - 1, F.lit(0)))))
        whole = dealt.select("key", "h1", "h2", "lab", "c", "n", "e", F.least("part", "i").alias("lo"), F.greatest("part", "i").alias("hi"), "part")
    whole = whole.withColumns({c: F.col(c).cast("long") for c in ("lo", "hi", "part", "h2")})
    met = whole.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_verify(kind, lattice, least), "h1 long, h2 long, links long, c long, root long")
    met = cut(met)
    joined = components(met.select("c", "root").distinct(), "c", "root")
    links = met.groupBy("h1", F.col("h2").cast("int").alias("h2")).agg(F.sum("links").alias("links"))
    of_class = classes.select("h1", "h2", "c", "n").join(links, ["h1", "h2"], "left").join(joined, F.col("c") == F.col("node"), "left")
    of_class = cut(of_class.select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "c").alias("component_id")))
    out = spread_join(cut(keyed.select("vec_id", "h1", "h2")), of_class, ["h1", "h2"], "left", counted="n")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _keys_only(kind: str, p: Lattice):
    filed = _file(kind, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filed(batches):
            yield b.select(["key"])

    return run
