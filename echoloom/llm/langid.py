"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword; one linear n-gram classifier per bit, fitted by ridge regression
on a bounded sample of labelled texts, predicts that bit's sign and margin. A text goes to the
codeword with the least loss, each bit weighted by how well it was told apart in training. The
share of the nearest codeword against all is the score; a small lead over the second is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_join, cut, packed, row_key, slices, small_batches

#: Hashed features; documents of each language in the fitting sample, and in all of it; the most languages there may be.
BUCKETS, PER_LANGUAGE, SAMPLE, LANGUAGES = 8192, 240, 6000, 512
#: A text is foreign from this loss of its nearest codeword on, if it is ambiguous too and has letters enough to tell.
FOREIGN, LETTERS = 0.7, 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of signs. Up to six: the exhaustive code (all ways to part the languages); else random columns without repeats."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 6:
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for i in range(n)], np.int8)
    rng, want, seen = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n))), {}
    while len(seen) < want:
        col = rng.permutation(np.where(np.arange(n) % 2, 1, -1)).astype(np.int8)
        col = col * col[0]
        seen.setdefault(col.tobytes(), col)
    return np.stack(list(seen.values()), axis=1)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of the whole text's byte bigrams and trigrams in lower case: square roots of counts, length 1."""
    raw = f" {text.lower()} ".encode("utf-8", "replace")
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(x) - 1, 1 << 20):
        y = x[i : i + (1 << 20) + 2]
        two = y[:-1] * _MIX[0] + y[1:] * _MIX[1]
        three = two[:-1] ^ (y[2:] * _MIX[2])
        counts += np.bincount((three ^ (three >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        counts += np.bincount((two ^ (two >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    v = np.sqrt(counts[at])
    return at, v / np.linalg.norm(v)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    bit_weight: np.ndarray

    def predict(self, text: str | None, sharpness: float = 6.0, lead: float = 0.15) -> tuple[str, float, bool, bool]:
        """(language, score, ambiguous, foreign); und and 0 for null or a text without any letter. Foreign: no codeword is near."""
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0, False, False
        at, v = features(text)
        margin = np.clip(v @ self.weights[at] + self.intercept, -2, 2)
        loss = (np.maximum(0, 1 - self.code * margin) * self.bit_weight).sum(1)
        p = np.exp(-sharpness * (loss - loss.min()))
        p /= p.sum()
        best = int(np.argmin(loss))
        rest = np.sort(loss)
        ambiguous = bool(len(rest) > 1 and rest[1] - rest[0] < lead)
        foreign = ambiguous and rest[0] >= FOREIGN and sum(map(str.isalpha, text)) >= LETTERS
        return self.languages[best], float(p[best]), ambiguous, bool(foreign)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE, penalty: float = 0.3) -> Model:
    """A model from at most per_language texts of each language, those of least content hash.

    rows: the labelled texts allowed for learning; null texts or labels are passed over. Where
    languages are so many that this would pass sample_rows in all, each gives an equal part of those,
    8 at least; that bounds the driver's memory (a row of BUCKETS numbers for each text, and a square matrix). More than LANGUAGES
    labels are an error.
    """
    named = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{doc_id}`").alias("doc_id"))
    named = named.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    most = max(8, min(per_language, sample_rows // len(sizes)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * (most + 8) / n)))])
    # the content's hash thins out rows; ranks are then taken among few
    h = F.xxhash64("doc_id", "text")
    thin = named.where(F.abs(h % 1_000_000) < share[F.col("lang")] * 1_000_000)
    first = Window.partitionBy("lang").orderBy(h)
    sample = thin.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([a.astype("<u2").tobytes() for a, _ in got]), pa.array([v.astype("<f4").tobytes() for _, v in got])], ["lang", "at", "v"])

    with small_batches(rows.sparkSession):
        got = sorted(sample.mapInArrow(run, "lang string, at binary, v binary").collect(), key=lambda r: (r["lang"], r["at"], r["v"]))
    languages = sorted({r["lang"] for r in got})
    code = codewords(len(languages))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["v"], "<f4")
    y = code[[languages.index(r["lang"]) for r in got]].astype(np.float64)
    n = np.array([sum(r["lang"] == k for r in got) for k in languages], np.float64)
    w = np.sqrt(len(got) / len(n) / n)[[languages.index(r["lang"]) for r in got]][:, None]  # languages weigh the same
    xw = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32) * w.astype(np.float32)
    gram = (xw @ xw.T).astype(np.float64)
    dual = np.linalg.solve(gram + penalty * np.eye(len(gram)), y * w)
    solved = xw.T @ dual
    told = np.clip(((gram @ dual) * np.sign(y)).mean(0), 0.05, 1.0)
    return Model(languages, code, solved[:-1].astype(np.float32), solved[-1], told / told.sum())


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rk, lang_pred, score (0 to 1), ambiguous, foreign) for each row of docs; rk is its content key.

    lang_pred is und with score 0 for null texts, texts without a letter, and where the model has
    no language. Each row gets a row, so repeats and null ids stay; an empty table gives no rows;
    other columns are not read, and texts do not come back from Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("rk"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text"):
            got = [m.predict(t) if m.languages else ("und", 0.0, False, False) for t in b.column("text").to_pylist()]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), *cols], ["doc_id", "rk", "lang_pred", "score", "ambiguous", "foreign"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"doc_id {kind}, rk binary, lang_pred string, score double, ambiguous boolean, foreign boolean"), texts=True)


def accepted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 300_000) -> DataFrame:
    """The rows of docs in a learned language: those without any letter, or far from every codeword, go. All columns are kept; texts stay where they are."""
    rejected = cut(identify(docs, model, doc_id, text).where("lang_pred = 'und' OR foreign").select("rk").distinct())
    rows = packed(docs, rk=row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    return bounded_join(rows, rejected, "rk", "left_anti", broadcast_rows, wide=True).select("_row.*")


def may_learn(doc_id: str = "doc_id"):
    """True for documents whose crc32 of the id as text leaves no remainder 2 by 4."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 != 2
