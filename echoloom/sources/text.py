"""Fingerprints of texts: hashed word shingles, a stand-in for audio that SQL can check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = bytes.maketrans(b"\n\t\r", b"   ")


def shingles(lowered: bytes, width: int = 3) -> np.ndarray:
    """Words of 32 bits, the first of the md5 of each run of ``width`` words of the whole text; empty for fewer words."""
    words = [w for w in lowered.translate(_SPACE).split(b" ") if w]
    md5, join = hashlib.md5, b" ".join
    runs = map(join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.frombuffer(b"".join([md5(r, usedforsecurity=False).digest()[:4] for r in runs]), ">u4").astype(np.int64)


def fingerprints(docs: DataFrame, file_id: str = "doc_id", text: str = "text", rate: int = 11025) -> DataFrame:
    """Fingerprint rows of the texts that have any word; one second stands for each twelve words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                made = [shingles(x) for x in b.column("t").to_pylist()]
                ends = np.cumsum([0, *map(len, made)])
                yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made)))], ["file_id", "data"])

    given = docs.where(F.col(text).isNotNull()).select(F.col(file_id).cast("bigint").alias("file_id"), F.lower(F.col(text)).cast("binary").alias("t"))
    out = given.mapInArrow(run, "file_id bigint, data array<bigint>").where(F.size("data") > 0)
    path = F.concat(F.lit("doc:"), F.col("file_id").cast("string"))
    return out.select("file_id", path.alias("file_path"), "data", F.lit(rate).alias("sample_rate"), (F.size("data") / 12.0).alias("duration"), F.lit(None).cast("string").alias("error"))
