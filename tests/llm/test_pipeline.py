"""The pipeline's stages against plain versions."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from echoloom.llm import pii

DATA = "/root/testdata/sf0.001"


def brute_stay(rows):
    """Ids that stay: the smallest of each group of texts at Jaccard similarity 0.8 of five-word shingles or more."""
    sets = []
    for _, t in rows:
        w = re.sub(r"[A-Z]", lambda m: m.group().lower(), t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    groups = {}
    for g, (i, _) in zip(of, rows, strict=True):
        groups.setdefault(g, []).append((i is None, i or 0))
    return Counter(None if g[0] else g[1] for g in map(min, groups.values()))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("_row", F.lit(1)).unionAll(spark.createDataFrame([(9000, None, None, None, None, 1), (9001, "123 456", "en", "src1", 7, 1), (None, "der und die", "de", None, 11, 1)], "doc_id long, text string, lang string, source string, n_chars long, _row int"))
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "redact_pii", "mix_sources", "pack_sequences"]
    steps = dict(corpus_pipeline.STAGES)
    one = steps["language_id"](spark, docs, DATA).cache()
    assert one.columns == columns and one.count() == docs.count() - 2
    two = steps["near_dedup"](spark, one, DATA).cache()
    stay = brute_stay([(r["doc_id"], r["text"]) for r in one.select("doc_id", "text").collect()])
    assert two.columns == columns and Counter(r["doc_id"] for r in two.collect()) == stay
    three = steps["redact_pii"](spark, two, DATA).cache()
    assert three.columns == columns and three.count() == two.count()
    assert pii.find(three).where(F.size("base") > 0).count() == 0
    assert three.where(F.length("text") != F.col("n_chars")).count() == 0
    untouched = two.join(pii.find(two).where(F.size("base") + F.size("more") == 0).select("doc_id"), "doc_id")
    assert Counter(r["text"] for r in untouched.collect()) <= Counter(r["text"] for r in three.collect())
    four = steps["mix_sources"](spark, three, DATA).cache()
    assert four.columns == columns and max(Counter(map(tuple, four.collect())).values()) <= 2
    five = steps["pack_sequences"](spark, four, DATA)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0 and (name == "pack_sequences" or out.columns == docs.columns)


def test_stages_on_repeated_rows(spark):
    """Rows equal in every column: stages after the near-duplicates keep or mix each of them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    twice = docs.unionAll(docs)
    steps = dict(corpus_pipeline.STAGES)
    assert steps["redact_pii"](spark, twice, DATA).count() == 40 and steps["near_dedup"](spark, twice, DATA).count() <= 20
    mixed = steps["mix_sources"](spark, twice, DATA)
    assert max(Counter(map(tuple, mixed.collect())).values()) <= 4
    assert {r["doc_id"] for r in steps["pack_sequences"](spark, mixed, DATA).select("doc_id").distinct().collect()} == {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50


def test_language_decisions_take_effect(spark):
    """Letters in no learned language go by the decoder's result; labelled documents and short texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(1)
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(200)) for _ in range(5)]
    odd = spark.createDataFrame([*[(9000 + i, t, None, "src1", len(t)) for i, t in enumerate([*junk, "Это русский текст о погоде и природе. " * 3])], (9100, "qwx zzk", None, "src1", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs.unionByName(odd), DATA).select("doc_id").collect()}
    assert got == {x["doc_id"] for x in docs.select("doc_id").collect()} | {9100}
