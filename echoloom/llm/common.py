"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle

#: White space of the word contracts: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of whole texts: ten thousand long texts in one batch would fill a worker.
ARROW = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW) -> Iterator[None]:
    """Bounds the session's Arrow batches to ``most`` bytes, where they were larger, while the block runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    now = str(before).rstrip("b")
    lower = not now.isdigit() or int(now) <= 0 or int(now) > most
    if lower:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if lower:
            spark.conf.set(key, before)


def cut(df: DataFrame, texts: bool = False) -> DataFrame:
    """df written to a table in the shared checkpoint folder and read again, without lineage. texts: df hands texts to Python, in batches bounded by bytes.

    The folder is the cluster's ``spark.checkpoint.dir``; a temporary one only where that is unset
    on a single machine.
    """
    if texts:
        with small_batches(df.sparkSession):
            return settle(df)
    return settle(df)


def small(df: DataFrame, rows: int, size: int | None = None) -> bool:
    """True if df has at most that many rows and, if asked, bytes (as JSON); reads no more than one row beyond."""
    some = df.limit(rows + 1)
    if size is None:
        return some.count() <= rows
    got = some.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= size


#: What may be broadcast at most, as JSON; rows that any one task can hold, so that their keys need no spreading.
BROADCAST, PLAIN = 48 << 20, 2000


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", counted: str | None = None, total: int | None = None) -> DataFrame:
    """Join of rows with a table of one row (or a few) for each key, such that no key gathers its rows in one task.

    Keys that hold more than an eighth of a partition's fair share of left's rows are fewer than
    eight times the shuffle partitions, whatever the data: right's rows of those are broadcast and left's
    rows stay where they lie. Rows with a null key match nothing and are not shuffled either.
    All others meet in a shuffle. how: inner, left, left_semi or left_anti. left is read several
    times, so it should be a written table. counted: a column of right that holds how many rows of
    left have its key, total: left's rows, where the caller knows them; else they are counted.
    """
    keys = [on] if isinstance(on, str) else list(on)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    some, total = left.where(~no_key), left.count() if total is None else total
    fair = max(16, total // (8 * parts))
    rows = right.select(*keys, F.col(counted).alias("_rows")) if counted else some.groupBy(*keys).agg(F.count("*").alias("_rows"))
    right = right.drop(counted) if counted else right
    heavy = rows.where(F.col("_rows") > fair).select(*keys)
    if total > PLAIN and not small(heavy, 0):
        heavy = cut(heavy.coalesce(1))  # fewer than eight times the partitions
        of_heavy = right.join(F.broadcast(heavy), keys, "left_semi")
    else:
        heavy = None
    if heavy is None or not small(of_heavy, 8 * parts * 16, BROADCAST):
        out = some.join(right, keys, how)
    else:
        marked = some.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left").select(*[F.col(f"`{c}`") for c in left.columns], "_heavy")
        out = marked.where("_heavy").drop("_heavy").join(F.broadcast(of_heavy), keys, how)
        out = out.unionByName(marked.where("_heavy is null").drop("_heavy").join(right, keys, how))
    if how in ("left", "left_anti"):
        out = out.unionByName(left.where(no_key), allowMissingColumns=True)
    return out


#: Marks that keys fall on, where rows that can't meet are held back from a shuffle.
MARKS = 1 << 20


def bounded_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int, counted: str | None = None, wide: bool = False) -> DataFrame:
    """Join that broadcasts ``right`` only after measuring at most ``rows`` rows and BROADCAST bytes in it, else spreads both.

    counted: as for spread_join. wide: left holds texts; of those only rows whose key falls on a
    mark of right's keys move, and the marks broadcast for that are MARKS numbers at most.
    """
    if small(right, rows, BROADCAST):
        return left.join(F.broadcast(right.drop(counted) if counted else right), on, how)
    if not wide:
        return spread_join(left, right, on, how, counted)
    mark = F.pmod(F.xxhash64(*([on] if isinstance(on, str) else on)), F.lit(MARKS)).alias("_mark")
    marks, marked = F.broadcast(right.select(mark).distinct()), left.select("*", mark)
    out = spread_join(marked.join(marks, "_mark", "left_semi").drop("_mark"), right, on, how, counted)
    if how in ("left", "left_anti"):
        out = out.unionByName(marked.join(marks, "_mark", "left_anti").drop("_mark"), allowMissingColumns=True)
    return out


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """The whole row as one struct column ``_row`` beside the named columns, so no names of df can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in named.items()])


def row_key(doc_id: Column, text: Column) -> Column:
    """Non-null key of 16 bytes of a row's content: two hashes of 64 bits from different seeds. Rows that share it have equal results, so joins on it lose nothing."""
    halves = (F.xxhash64(doc_id, text), F.xxhash64(F.lit(0x2545F4914F6CDD1D).cast("long"), text, doc_id))
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of the string column, one row at least."""
    for batch in batches:
        lens = batch.column(column).cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(lens), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """A vocabulary file's tokenizer, loaded once in each worker."""
    if path not in _TOKENIZERS:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


SIGNS = string.punctuation


class Pieces:
    """What a vocabulary makes of pieces of text that it encodes apart from each other.

    The unseen pieces of a batch are joined by the end-of-text token and encoded in a few calls.
    Short pieces are remembered in two generations of at most GENERATION each; long ones only for
    their batch. ``before`` is put before every piece. Values are lengths or little-endian ids.
    """

    GENERATION, SHORT, CALL = 400_000, 48, 1 << 16

    def __init__(self, path: str, lengths: bool, before: str = ""):
        self.t, self.lengths, self.before = tokenizer(path), lengths, before
        self.generation = self.GENERATION
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.mark = "<|endoftext|>"
        self.mark_id = self.t.token_to_id(self.mark)

    def __call__(self, flat: list[str]) -> list:
        """The value of each piece."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, flat))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            new = self._found({flat[i] for i in missing})
            for i in missing:
                out[i] = new[flat[i]]
        return out

    def _found(self, pieces: set[str]) -> dict[str, object]:
        """Values of unseen pieces. A letter and the signs after it are apart, so "word," is "word" and ",".

        That holds for letters that stay letters in lower case and normal form, as those of the
        Latin blocks do but for the dotted capital I; pieces with other letters before signs are encoded whole.
        """
        new, joint = {}, []
        listed: set[str] = set()
        for piece in pieces:
            if piece in self.old:
                new[piece] = self.old[piece]
            elif not self.before and (stem := piece.rstrip(SIGNS)) and len(stem) < len(piece) and stem[-1] < "\u0250" and stem[-1] != "\u0130" and stem[-1].isalpha() and "<|" not in piece:
                tail = piece[len(stem) :]
                joint.append((piece, stem, tail))
                listed.update(p for p in (stem, tail) if p not in self.young)
            else:
                listed.add(piece)
        call, held = [], 0
        for piece in listed.difference(new):
            if piece in self.old:
                new[piece] = self.old[piece]
            elif "<|" in piece or len(piece) > 4096 or not piece:
                ids = self.t.encode(self.before + piece, add_special_tokens=False).ids
                new[piece] = len(ids) if self.lengths else np.array(ids, "<u4").tobytes()
            else:
                call.append(piece)
                held += len(piece)
                if held > self.CALL:
                    new.update(self._many(call))
                    call, held = [], 0
        if call:
            new.update(self._many(call))
        young = self.young
        for piece, stem, tail in joint:
            new[piece] = (new[stem] if stem in new else young[stem]) + (new[tail] if tail in new else young[tail])
        young.update((p, v) for p, v in new.items() if len(p) <= self.SHORT)
        return new

    def _many(self, listed: list[str]) -> Iterator[tuple[str, object]]:
        text = self.before + (self.mark + self.before).join(listed)
        ids = np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.concatenate(([-1], np.flatnonzero(ids == self.mark_id), [len(ids)]))
        if len(at) != len(listed) + 1:
            raise RuntimeError("pieces and marks do not match")
        if self.lengths:
            yield from zip(listed, (np.diff(at) - 1).tolist(), strict=True)
        else:
            data, ends = ids.tobytes(), (4 * at).tolist()
            for piece, s, e in zip(listed, ends, ends[1:], strict=False):
                yield piece, data[s + 4 : e]


_PIECES: dict[tuple[str, bool, str], Pieces] = {}


def pieces_of(path: str, lengths: bool, before: str = "", generation: int | None = None) -> Pieces:
    """The worker's own memory of pieces, shared by its tasks; generation bounds it otherwise than by default."""
    key = (path, lengths, before)
    if key not in _PIECES:
        _PIECES[key] = Pieces(*key)
    _PIECES[key].generation = generation or Pieces.GENERATION
    return _PIECES[key]
