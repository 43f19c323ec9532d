"""From raw documents to packed sequences: identify, deduplicate, redact, mix, pack.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which the caller writes and reads again as the next one's docs. All but the last keep the columns
of documents. run() writes its own intermediate tables to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoloom.llm import langid, mixing, packing, pii, simhash
from echoloom.llm.common import cut, table
from echoloom.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without any letter, or far from every codeword, go. Texts of few letters stay."""
    model = langid.fit(docs.where(langid.may_learn()))
    return langid.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word shingles at 0.8 or more: the one of smallest doc_id."""
    return simhash.one_of_similar(docs, width=5, least=0.8)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs, (3, 1, 2), 1.5, 2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of at most 2048 tokens."""
    # workers also hold what earlier stages left, so this stage remembers less than the query alone
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2048, remember=220_000, slice_bytes=1 << 20)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("redact_pii", redact_pii), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Language models, SimHash and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
