"""Token counts: texts are split where the pre-tokenizer always splits, and only lengths come back.

A byte-level pre-tokenizer ends a piece before every space that a non-space follows, whatever
stands around it, so a text's count is the sum over its pieces. Batches are cut by bytes, the
distinct unseen pieces of a batch go to the library in one call, and lengths of short pieces are
remembered within bounds; ids never leave the worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces_of, slices

#: A space before anything but white space. Python's \s has all that the vocabularies' patterns call white space.
SAFE = re.compile(r" (?=[^\s᠎])")
#: Longer texts are encoded part by part.
PART = 1 << 16


def parts(text: str, most: int = PART) -> Iterator[str]:
    """Cut a long text before safe spaces, about ``most`` characters apart; they join to the text."""
    start = 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def count(path: str, texts: list[str | None]) -> list[int]:
    """Token counts as the library gives them without added special tokens; special strings as its default has them.

    Where every white space is one space or one line feed between other characters, a text falls
    into words with the space before them, words that open a line, and line feeds. Other texts
    fall into pieces at safe spaces.
    """
    spaced, bare = pieces_of(path, True, " "), pieces_of(path, True)
    feed = bare(["\n"])[0]
    total, words, opens, w_of, o_of = [0] * len(texts), [], [], [0], [0]
    for i, text in enumerate(texts):
        for part in parts(text) if text else ():
            feeds, own = part.count("\n"), part.split()
            seps = part.count(" ") + feeds
            plain = len(part) - sum(map(len, own)) == seps and "᠎" not in part  # no white space but spaces and feeds
            if plain and len(own) == seps + 1:
                total[i] += feeds * feed
                for line in part.split("\n"):
                    first, *rest = line.split(" ")
                    opens.append(first)
                    words += rest
            elif plain and part[0] == " " and len(own) == seps and not feeds:
                words += part[1:].split(" ")
            else:
                first, *rest = SAFE.split(part)
                opens += [first] if first else []
                words += rest
        w_of.append(len(words))
        o_of.append(len(opens))
    w, o = spaced(words), bare(opens)
    return [n + sum(w[w_of[i] : w_of[i + 1]]) + sum(o[o_of[i] : o_of[i + 1]]) for i, n in enumerate(total)]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    path: a vocabulary file of the tokenizers library whose pre-tokenizer is byte-level, readable
    at the same place on every executor. Null and empty texts count 0 bytes and 0 tokens. Ids are
    passed through, null or repeated; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            n = count(path, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(np.array(n, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sized = named.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return cut(sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long"), texts=True).withColumn("over_limit", F.col("n_tokens") > limit)
