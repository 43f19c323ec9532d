"""The fingerprint engine against plain versions and, for registered queries, against their SQL."""

import io
import json
import random
import time
import wave
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from echoloom import api
from echoloom.config import CompareConfig, PreprocessConfig, silence_handling
from echoloom.functions import align, modify, signal
from echoloom.operators import cluster, compare, index, product, robustness, similar
from echoloom.plans.queries import ORACLE, QUERIES
from echoloom.runtime import numbered, settle, shared_folder
from echoloom.sources import audio, text
from echoloom.streaming.ingest import append_postings

DATA = "/root/testdata/sf0.001"
C = CompareConfig()
RNG = np.random.default_rng(8)


def words(n):
    return RNG.integers(0, 2**32, n, dtype=np.uint32)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "events", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows, columns):
    return sorted((repr(tuple(round(float(v), 6) if isinstance(v, float) else v for v in (r[c] for c in columns))) for r in rows))


@pytest.mark.parametrize("name", ["fp_words", "fp_limited", "best_alignment", "correlation_alignment", "filter_candidates", "normalize_volume", "normalize_peak", "level_decibels", "candidate_pairs", "candidates_for_file", "jaccard_filter", "histogram_peak", "compare_pairs", "sliding_compare", "segment_matches", "groups_csv", "silence_bounds", "trim_silence", "resample_linear", "doubling_decision", "multi_source_scan"])
def test_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("name", ["scan_audio", "fingerprint_audio", "preprocess_report", "robustness_rates", "robustness_buckets"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_identity_and_shift():
    a = words(900)
    assert align.compare(a, a, C)[:3] == (1.0, 0, 900) and align.compare(a, a, C)[4]
    assert len(align.compare_sliding(a, a, C)[6]) == 1 and not align.compare_sliding(a, a, C)[4]
    for k in (1, 20, 200):
        assert align.compare(a[:300], np.concatenate([words(k), a[:300]]), C)[:2] == (1.0, k)
    short = words(9)
    assert align.compare(short, short, C) == align.NOTHING and align.compare(a[:10], a[:10], C)[4]
    assert align.compare(a[:50], np.concatenate([words(200), a[:50], words(200)]), C) == align.NOTHING


def test_thresholds_at_once(spark):
    """One pass over all thresholds gives what each gives alone, and clips are spread over more tasks than their few bytes would get."""
    from dataclasses import replace

    from echoloom.plans.queries import _wavs

    a = words(300)
    for b in (a, np.concatenate([words(40), a]), np.where(RNG.random(300) < 0.3, words(300), a), words(300), a[:9]):
        assert align.compare_at(a, b, C, modify.THRESHOLDS) == [align.compare(a, b, replace(C, similarity_threshold=t)) for t in modify.THRESHOLDS]
    assert _wavs(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_offsets_at_once():
    for n, m in ((1, 1), (5, 900), (900, 5), (400, 410), (9000, 8500), (3, 3)):
        a, b = words(n), words(m)
        s, k = align.similarities(a, b, align.steps(C))
        assert [(x, y) for x, y in zip(s.tolist(), k.tolist(), strict=True)] == [(x, y) for x, _, y in (align.similarity_at(a, b, o) for o in align.steps(C))]


def test_similar_sets_against_all_pairs(spark):
    """Sets of 1 to 400 hashes, near copies of all degrees, copies, repeated words and one very common word, against all pairs."""
    rng, made = random.Random(5), []
    for _ in range(60):
        base = [rng.randrange(2**32) for _ in range(rng.choice((1, 3, 8, 40, 150, 400)))]
        for _ in range(rng.randrange(1, 6)):
            made.append([7] * rng.randrange(3) + [w if rng.random() < rng.choice((1, 0.9, 0.7)) else rng.randrange(2**32) for w in base])
    made += made[:20]
    made = [x for x in made if x]
    got = {(r["a"], r["b"]): (round(r["overlap"], 9), r["hits"]) for r in index.filter_candidates(spark.createDataFrame(list(enumerate(made)), "file_id long, data array<bigint>")).collect()}
    count = [{h: [w & 0xFFFF for w in x].count(h) for h in {w & 0xFFFF for w in x}} for x in made]
    want = {}
    for j, y in enumerate(count):
        for i, x in enumerate(count[:j]):
            both = x.keys() & y.keys()
            hits = sum(x[h] * y[h] for h in both)
            if hits >= 5 and len(both) / (len(x) + len(y) - len(both)) >= C.quick_threshold:
                want[i, j] = (round(len(both) / (len(x) + len(y) - len(both)), 9), hits)
    assert got == want and len(want) > 100


@pytest.fixture(scope="module")
def alike(spark):
    """30 near copies of 2,000 words, three copies (of two of them) and two unlike files, as fingerprints with their pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, 2000, dtype=np.int64)
    made = [np.where(rng.random(2000) < 0.004 * k, rng.integers(0, 2**32, 2000, dtype=np.int64), base) for k in range(30)]
    made = [np.roll(x, k % 3) for k, x in enumerate(made)]
    made += [made[0], made[0], made[7]] + [rng.integers(0, 2**32, 500, dtype=np.int64) for _ in range(2)]
    f = settle(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(made)], "file_id long, data array<bigint>"))
    return made, f, settle(index.similar_sets(f, C))


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    each = sc.statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_words_of_near_copies_move_once(spark, alike):
    """528 pairs of files of 8 KB: their words are 0.3 MB, and 4 MB (1.5 MB compressed) if they move with each pair."""
    made, f, pairs = alike
    before, key = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    try:
        assert len(compare.at_offset(pairs, f).collect()) == 33 * 32 // 2
    finally:
        spark.conf.unset(key)
    assert shuffled(spark) - before < 1_000_000


@pytest.mark.parametrize("marks", [1 << 20, 2])
def test_rows_without_ids(spark, alike, monkeypatch, marks):
    """More ids than are broadcast, and fewer."""
    monkeypatch.setattr(similar, "MARKS", marks)
    ids = spark.createDataFrame([(3,), (30,), (99,)], "file_id long")
    assert sorted(r[0] for r in similar.without(alike[1].select("file_id"), ids).collect()) == [i for i in range(len(alike[0])) if i not in (3, 30)]


def test_filter_candidates_stores_no_words(spark, tmp_path):
    """Sets of hashes take 1 to 1.5 bytes a word, words 4.2; files with the same words in another order are pairs too."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 3000))) for k in range(100)]
    rows += [(100, "a b c " * 40), (101, "b c a " * 39 + "b c a b c"), (102, None), (103, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    got = QUERIES["filter_candidates"](spark, str(tmp_path)).collect()
    assert 0 < size() - before < 2 * 100 * 3000
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLE["filter_candidates"])
    assert plain([r.asDict() for r in got], want.columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns) != []


def test_waves_of_blocks(spark, monkeypatch):
    """Blocks in several waves and in one give the same pairs, and what a wave shuffled is gone after it."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**32, 3000, dtype=np.int64)
    made = [np.where(rng.random(m) < 0.05, rng.integers(0, 2**32, m, dtype=np.int64), base[:m]).tolist() for m in range(1000, 3000, 20)]
    f = settle(spark.createDataFrame(list(enumerate(made)), "file_id long, data array<bigint>"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    listed = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())
    kept = lambda: {x.getName().split("_")[1] for x in listed() if x.getName().startswith("shuffle_")}
    got = []
    for wave in (2, 10**6):
        monkeypatch.setattr(similar, "WAVE", wave)
        before = kept()
        got.append(sorted(map(tuple, similar.similar_classes(similar.hash_sets(f), C).collect())))
        for _ in range(50):
            if len(kept() - before) <= 1:
                break
            time.sleep(0.2)
        assert len(kept() - before) <= 1  # that of the counts of hashes
    assert got[0] == got[1] and len(got[0]) > 1000


def test_blocks_are_dealt_in_bounded_waves():
    """Every block is in one wave; a wave takes at most WAVE times all hashes, however many blocks each set goes to."""
    sizes = np.zeros(similar.HASHES + 1, np.int64)
    sizes[200:4000] = 200
    _, ranges, lower = similar._blocks(sizes, C.quick_threshold)
    waves = similar._waves(sizes, ranges, lower)
    held = [int((sizes * np.arange(len(sizes)))[low : high + 1].sum()) for low, high, _ in ranges]
    dealt = [sum(held[p] for p, qs in enumerate(lower) if q in qs) for q, (_, _, parts) in enumerate(ranges) for _ in range(parts)]
    assert sum(dealt) > 3 * similar.WAVE * sum(held)
    assert [k for first, end in waves for k in range(first, end)] == list(range(len(dealt)))
    assert len(waves) < sum(dealt) / (similar.WAVE * sum(held)) * 1.5 + 1
    assert all(sum(dealt[first:end]) <= similar.WAVE * sum(held) for first, end in waves)


@pytest.mark.parametrize("words, most, of_links", [(8_000_000, 50_000, False), (20_000, 7, False), (8_000_000, 50_000, True), (20_000, 7, True), (8_000_000, 2, True)])
def test_pairs_in_cells_against_loops(spark, alike, monkeypatch, words, most, of_links):
    """Copies, cells cut by files and by pairs, several rows for a pair and pairs without rows."""
    monkeypatch.setattr(compare, "CELL_WORDS", words)
    monkeypatch.setattr(compare, "CELL_PAIRS", most)
    made, f, pairs = alike
    ids = sorted((r["a"], r["b"]) for r in pairs.collect())
    u = [x.astype(np.uint32) for x in made]
    assert len(ids) == 33 * 32 // 2
    if of_links:
        pairs = similar.linked(f, C)
    assert sorted((r["a"], r["b"], r["best_offset"]) for r in compare.best_alignment(pairs, f, C).collect()) == [(a, b, align.best_offset(u[a], u[b], C)) for a, b in ids]
    hist = {(a, b): align.offset_histogram(u[a], u[b], C.max_alignment_offset) for a, b in ids}
    assert sorted(compare.offset_histogram(pairs, f, C).collect()) == [(a, b, int(o) - 360, int(h[o])) for (a, b), h in sorted(hist.items()) for o in np.flatnonzero(h)]
    assert sorted((r["a"], r["b"], r["overlap"]) for r in compare.at_offset(pairs, f, 1999).collect()) == [(a, b, 1) for a, b in ids]
    assert compare.at_offset(pairs, f, 2000).collect() == []
    some = spark.createDataFrame([(0, 33), (33, 34), (32, 5), (5, 32)], "a long, b long")
    assert sorted((r["a"], r["b"], r["best_offset"]) for r in compare.best_alignment(some, f, C).collect()) == sorted((a, b, align.best_offset(u[a], u[b], C)) for a, b in [(0, 33), (33, 34), (32, 5), (5, 32)])


def test_candidates_against_all_pairs(spark):
    """Products of repeated postings, within and across blocks, for all pairs and for searches."""
    rng = random.Random(6)
    made = [[rng.choice((rng.randrange(40), rng.randrange(2**32))) for _ in range(rng.choice((1, 5, 30, 300)))] + [3] * rng.choice((0, 0, 2, 300)) for _ in range(80)]
    fps = spark.createDataFrame(list(enumerate(made)), "file_id long, data array<bigint>")
    count = [{h: [w & 0xFFFF for w in x].count(h) for h in {w & 0xFFFF for w in x}} for x in made]
    hits = {(i, j): sum(x[h] * y.get(h, 0) for h in x) for i, x in enumerate(count) for j, y in enumerate(count)}
    assert {(r["a"], r["b"]): r["hits"] for r in index.candidates(fps).collect()} == {k: n for k, n in hits.items() if n >= 5 and k[0] < k[1]}
    assert {(r["a"], r["b"]): r["hits"] for r in index.candidates(fps, C, fps.where("file_id % 20 = 0")).collect()} == {k: n for k, n in hits.items() if n >= 5 and k[0] % 20 == 0}
    plan = index.candidates(fps)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan  # no row of two files is shuffled


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_candidates_shuffle_no_sets(spark, monkeypatch, block):
    """Few or many chunks, one file in several rows, searches; what is stored does not grow with the number of chunks and nothing is shuffled."""
    monkeypatch.setattr(product, "BLOCK", block)
    rng = random.Random(7)
    made = [(k // 2 if k > 76 else k, [rng.randrange(400) for _ in range(rng.choice((0, 4, 60, 200)))] + [9] * rng.choice((0, 300))) for k in range(80)]
    fps = spark.createDataFrame(made, "file_id long, data array<bigint>")
    count = [(i, Counter(w & 0xFFFF for w in x)) for i, x in made]
    hits = Counter((i, j, sum(x[h] * y[h] for h in x)) for i, x in count for j, y in count)
    pairs, found = index.candidates(fps), index.candidates(fps, C, fps.where("file_id % 20 = 0"))
    assert Counter(map(tuple, pairs.collect())) == Counter({k: n for k, n in hits.items() if k[2] >= 5 and k[0] < k[1]})
    assert Counter(map(tuple, found.collect())) == Counter({k: n for k, n in hits.items() if k[2] >= 5 and k[0] % 20 == 0})
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    chunks = product._chunks(fps)
    assert chunks.agg(F.sum(F.length("counts")), F.sum(F.length("ids"))).first()[:] == (sum(len(x) * (4 if max(x.values()) > 255 else 1) for _, x in count if x), 8 * sum(bool(x) for _, x in count))


def test_three_offsets():
    blocks = [words(120) for _ in range(3)]
    a = np.concatenate(blocks)
    b = np.concatenate([blocks[0], words(30), blocks[1], words(30), blocks[2]])
    offsets = [o for o, _ in align.segments(a, b, CompareConfig(suppress=False))]
    assert {0, 30, 60} <= set(offsets)


def test_histogram_against_loops():
    a, b = RNG.integers(0, 50, 80, dtype=np.uint32), RNG.integers(0, 50, 90, dtype=np.uint32)
    want = np.zeros(41, int)
    for i in range(80):
        for j in range(90):
            if a[i] == b[j] and abs(j - i) <= 20:
                want[j - i + 20] += 1
    assert (align.offset_histogram(a, b, 20) == want).all()
    f = align.smoothed(want, 2.0, 6)
    for i in range(41):
        w = {j: np.exp(-((j - i) ** 2) / 8) for j in range(max(0, i - 6), min(41, i + 7))}
        assert abs(f[i] - sum(want[j] * x for j, x in w.items()) / sum(w.values())) < 1e-9


def greedy(nodes, edges):
    near, done, groups = {n: set() for n in nodes}, set(), {}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(nodes):
        if i not in done:
            own = {i} | {x for x in near[i] if x not in done}
            done |= own
            if len(own) > 1:
                groups[i] = own
    return groups


def test_pivots(spark):
    rng = random.Random(3)
    chain = {(i, i + 1) for i in range(30)}
    for edges in ({(0, 1), (1, 2)}, {(1, 3), (2, 3)}, chain, *({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} for n, m in ((40, 60), (60, 60)))):
        for in_one_task in (1_000_000, 4):
            got = {}
            for r in cluster.pivots(spark.createDataFrame(sorted(edges), "a long, b long"), in_one_task).collect():
                got.setdefault(r["pivot"], set()).add(r["member"])
            assert got == greedy({x for e in edges for x in e}, edges)


def test_a_pivot_that_no_file_joins_is_no_group(spark, tmp_path):
    """Texts 1 and 2 are both near text 3 and not near each other: text 3 joins 1, and 2 is alone."""
    base = [f"w{i}" for i in range(203)]
    edit = lambda first: " ".join("x" + w if i % 13 == first else w for i, w in enumerate(base))
    rows = [(1, edit(0)), (2, edit(6)), (3, " ".join(base)), (4, "some other text that stands by itself and is long enough to count for something here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("duplicate_edges", "duplicate_groups", "group_summary", "groups_csv"):
        got, want = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE[name])
        columns = sorted(got.columns)
        assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)
    assert [r["file_ids"] for r in QUERIES["duplicate_groups"](spark, str(tmp_path)).collect()] == ["1,3"]
    assert QUERIES["duplicate_edges"](spark, str(tmp_path)).count() == 2


def test_signal():
    rate = 1000
    x = np.concatenate([np.zeros(500), np.full(1000, 0.5), np.zeros(505)])
    assert signal.silence_bounds(x, rate, -55) == (500, 1504) and len(signal.trim(x, rate, -55, 100)) == 1205
    assert signal.silence_bounds(np.zeros(5), rate, -55) == (-1, -1) and len(signal.trim(np.zeros(50), rate, -55, 100)) == 50
    assert signal.resample(np.array([0.0, 1.0]), 1, 2).tolist() == [0, 0.5, 1, 1]
    y, r = signal.prepare(x, rate, silence_handling(target_sample_rate=2000, silence_threshold_db=-55.0))
    assert r == 2000 and len(y) == 2410 and abs(np.sqrt(np.mean(y**2)) - 0.1) < 1e-6
    assert signal.to_int16(np.array([2.0, -0.99999, 0.5])).tolist() == [32767, -32766, 16383]
    assert signal.doubles(2, 2, None) and not signal.doubles(3, 3, None) and not signal.doubles(0.5, 1.4, PreprocessConfig()) and signal.doubles(0.5, 1.5, PreprocessConfig())
    with pytest.raises(ValueError):
        CompareConfig(similarity_threshold=1.2)
    assert PreprocessConfig.from_dict({"trim_silence": False, "other": 1}) == silence_handling(trim_silence=False)


def test_audio(spark, tmp_path):
    t = np.arange(11025 * 8) / 11025
    tone = 0.4 * np.sin(2 * np.pi * (400 + 60 * np.sin(3 * t)) * t) + 0.05 * RNG.normal(size=len(t))
    other = 0.4 * np.sin(2 * np.pi * (900 + 90 * np.sin(7 * t)) * t) + 0.05 * RNG.normal(size=len(t))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.wav").write_bytes(audio.encode(tone, 11025))
    (tmp_path / "sub" / "b.WAV").write_bytes(audio.encode(np.repeat(tone * 0.5, 2), 11025, channels=2))
    (tmp_path / "c.wav").write_bytes(audio.encode(other, 11025))
    (tmp_path / "d.wav").write_bytes(b"not audio at all")
    (tmp_path / "e.txt").write_bytes(b"x")
    files = audio.scan(spark, str(tmp_path))
    assert {r["supported"] for r in audio.metadata(files).collect()} == {True, False} and files.count() == 4
    prints = audio.fingerprints(files)
    assert prints.where("error is not null").count() == 1
    loose = CompareConfig(similarity_threshold=0.7, bit_error_threshold=0.3)
    groups = api.scan_for_duplicates(spark, str(tmp_path), loose).collect()
    assert [[p.split("/")[-1] for p in g["file_paths"]] for g in groups] == [["a.wav", "b.WAV"]]
    found = {r["file_path"].split("/")[-1]: r for r in audio.metadata(files).collect()}
    assert (found["b.WAV"]["channels"], found["b.WAV"]["frames"], found["a.wav"]["duration"]) == (2, len(tone), 8.0)
    cluster.write_csv(api.scan_for_duplicates(spark, str(tmp_path), loose), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["Group", "Similarity", "File"]


@pytest.fixture
def clips(tmp_path):
    """a.wav, aa.wav (the same, softer), c.wav (another) and d.wav (no audio)."""
    t = np.arange(11025 * 6) / 11025
    tone = 0.4 * np.sin(2 * np.pi * (400 + 60 * np.sin(3 * t)) * t) + 0.05 * RNG.normal(size=len(t))
    other = 0.4 * np.sin(2 * np.pi * (900 + 90 * np.sin(7 * t)) * t) + 0.05 * RNG.normal(size=len(t))
    for name, x in (("a", tone), ("aa", tone * 0.5), ("c", other)):
        (tmp_path / f"{name}.wav").write_bytes(audio.encode(x, 11025))
    (tmp_path / "d.wav").write_bytes(b"not audio at all")
    return tmp_path


def test_compare_files(spark, clips):
    loose = CompareConfig(similarity_threshold=0.7, bit_error_threshold=0.3)
    got = api.compare_files(spark, str(clips / "a.wav"), str(clips / "aa.wav"), loose).collect()
    assert len(got) == 1 and got[0]["is_duplicate"] and got[0]["error"] is None  # not a.wav with itself
    assert not api.compare_files(spark, str(clips / "a.wav"), str(clips / "c.wav"), loose).first()["is_duplicate"]
    assert api.compare_files(spark, str(clips / "a.wav"), str(clips / "a.wav")).first()["similarity_score"] == 1
    bad = api.compare_files(spark, str(clips / "a.wav"), str(clips / "d.wav")).collect()
    assert len(bad) == 1 and "d.wav: not decodable" in bad[0]["error"] and bad[0]["similarity_score"] is None
    with pytest.raises(FileNotFoundError, match="nowhere.wav"):
        api.compare_files(spark, str(clips / "a.wav"), str(clips / "nowhere.wav"))


def test_index(spark, clips):
    """Two scans that both number files from 0 stay apart in one index."""
    prints = lambda name: audio.fingerprints(audio.scan(spark, str(clips / name)))
    held = api.FingerprintIndex(prints("a.wav")).add(prints("aa.wav")).add(prints("c.wav"))
    assert held.count() == 3 and held.stats().first()["file_count"] == 3
    assert [held.file(i).first()["file_path"].split("/")[-1] for i in range(3)] == ["a.wav", "aa.wav", "c.wav"]
    hits = held.candidates_of(0).collect()
    assert hits[0]["b"] == 0 and [r["hits"] for r in hits] == sorted((r["hits"] for r in hits), reverse=True)
    assert held.clear().count() == 0 and held.clear().next_id == 0 and held.clear().config == held.config
    loose = api.FingerprintIndex(held.fps, CompareConfig(similarity_threshold=0.7, bit_error_threshold=0.3))
    assert [g["file_ids"] for g in loose.groups().collect()] == [[0, 1]]


def test_command_line(spark, clips, tmp_path, capsys):
    from echoloom.__main__ import main

    out = tmp_path / "out.json"
    assert main(["scan", str(clips), "--threshold", "0.7", "--extensions", "WAV", "--format", "json", "--output", str(out)]) == 0
    groups = json.loads(out.read_text())
    assert isinstance(groups, list) and all([p.split("/")[-1] for p in g["filePaths"]] == ["a.wav", "aa.wav"] for g in groups)
    assert main(["scan", str(clips), "--threshold", "0.7", "--format", "csv", "--max-duration", "4"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "Group,Similarity,File"
    assert main(["compare", str(clips / "a.wav"), str(clips / "aa.wav"), "--sliding"]) == 0
    assert json.loads(capsys.readouterr().out)["error"] is None
    assert main(["compare", str(clips / "a.wav"), str(clips / "d.wav")]) == 1 and main(["fingerprint", str(clips / "d.wav")]) == 1 and main(["fingerprint", str(clips / "no.wav")]) == 1
    assert main(["fingerprint", str(clips / "a.wav"), "--output", str(out), "--max-duration", "2"]) == 0
    made = json.loads(out.read_text())
    assert set(made) == {"data", "sampleRate", "duration", "filePath"} and made["duration"] == 2


def test_reports(spark):
    groups = spark.createDataFrame([(5, [5, 9], 0.9, ["a", 'say "b"']), (1, [1, 2, 3], 0.95, ["x", "y", "z"])], "group_id long, file_ids array<long>, avg_similarity double, file_paths array<string>")
    assert list(cluster.report(groups, "text")) == ["Group 1 (95.00% similar):", "  ├─ x", "  ├─ y", "  └─ z", "Group 2 (90.00% similar):", "  ├─ a", '  └─ say "b"']
    assert list(cluster.report(groups, "csv"))[-1] == '2,90.00%,"say ""b"""'
    assert [g["fileIds"] for g in json.loads("\n".join(cluster.report(groups, "json")))] == [[1, 2, 3], [5, 9]]
    assert json.loads("".join(cluster.report(groups.limit(0), "json"))) == [] and list(cluster.report(groups.limit(0), "text")) == []
    assert {(r["group_no"], r["file"]) for r in cluster.csv_rows(groups).collect()} == {(1, "x"), (1, "y"), (1, "z"), (2, "a"), (2, 'say "b"')}


def test_numbered(spark):
    rows = [(i * 7919 % 500, f"k{i}") for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a long, b string").repartition(9), [F.desc("a")], "no").collect()
    assert sorted((r["no"], -r["a"]) for r in got) == [(k, -(499 - k)) for k in range(500)]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_decoding_in_chunks(width):
    raw, out = RNG.integers(0, 256, 2 * 997 * width, dtype=np.uint8).tobytes(), io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, width, 8000, 0, "NONE", ""))
        w.writeframes(raw)
    whole, rate, channels = audio.decode(out.getvalue())
    assert (len(whole), rate, channels) == (997, 8000, 2) and audio.header(out.getvalue())[1:] == (width, 8000, 2, 997)
    for chunk in (1, 50, 4096):
        assert (audio.decode(out.getvalue(), chunk=chunk)[0] == whole).all()
    assert (audio.decode(out.getvalue(), 0.1)[0] == whole[:800]).all()
    if width == 2:
        assert np.allclose(whole, np.frombuffer(raw, "<i2").reshape(-1, 2).mean(1) / 2**15, atol=1e-6)
    with pytest.raises(ValueError):
        audio.decode(out.getvalue()[:-5])


def test_changes_of_recordings():
    x = RNG.normal(size=11025).astype(np.float32) * 0.2
    of = {(c, v): (y, r) for c, v, y, r in modify.sweep(x, 11025)}
    assert len(of) == 1 + sum(map(len, modify.GRID.values()))
    assert (of["silence_start", 0.5][0][5512:] == x).all() and not of["silence_start", 0.5][0][:5512].any() and (of["silence_end", 1.0][0][:11025] == x).all()
    middle = of["silence_middle", 0.1][0]
    assert (np.concatenate([middle[:5512], middle[5512 + 1102 :]]) == x).all()
    assert np.allclose(of["volume_decrease", 0.25][0], x / 4) and np.abs(of["volume_increase", 2.0][0]).max() <= 1
    assert of["sample_rate", 22050.0][1] == 22050 and len(of["sample_rate", 22050.0][0]) == 22050 and len(of["speed_faster", 1.1][0]) == 11025 * 11025 // round(11025 * 1.1)


def test_robustness(spark, clips):
    got = robustness.comparisons(spark.read.format("binaryFile").load(f"{clips}/*.wav")).collect()
    assert len(got) == 3 * len(modify.THRESHOLDS) * (1 + sum(map(len, modify.GRID.values())))  # d.wav can't be decoded
    assert all(r["detected"] and r["similarity"] == 1 for r in got if r["category"] == "original")
    hit = {t: sum(r["detected"] for r in got if r["threshold"] == t) for t in modify.THRESHOLDS}
    assert all(hit[a] <= hit[b] for a, b in zip(modify.THRESHOLDS, modify.THRESHOLDS[1:], strict=False))
    rates = robustness.detection(spark.createDataFrame(got))
    for r in rates.collect():
        own = [x["detected"] for x in got if (x["category"], x["threshold"]) == (r["category"], r["threshold"])]
        assert (r["total"], r["detected"]) == (len(own), sum(own)) and abs(r["rate"] - 100 * np.mean(own)) < 1e-9
    best = {r["category"]: r for r in robustness.by_category(rates).collect()}
    assert best["original"]["min_rate"] == 100 and best["original"]["best_threshold"] == 0.95


@pytest.mark.parametrize("n, loud", [(0, 0.1), (3000, 0.1), (4607, 0.3), (4608, 0.3), (9000, 0.6), (20000, 0.02), (20000, 0.0), (30011, 0.3)])
def test_changes_share_frames(monkeypatch, n, loud):
    """hk32's words of a clip's changes, with frames in common transformed once, are those of each change made and transformed by itself."""
    rng = np.random.default_rng(n)
    x = audio.decode(audio.encode(np.concatenate([rng.normal(size=n // 2) * loud, np.sin(np.arange(n - n // 2) / 7) * loud]), 11025))[0]
    want, done, bands = list(robustness._changed(x, 11025, audio.band_differences)), [0], audio.bands
    monkeypatch.setattr(audio, "bands", lambda f, rate: (done.__setitem__(0, done[0] + len(f)), bands(f, rate))[1])
    got = list(robustness._hk32(x))
    assert [(c, v, w.tolist()) for c, v, w in got] == [(c, v, w.tolist()) for c, v, w in want] and len(got) == 32
    assert n < 9000 or done[0] < 0.7 * sum(len(w) + 1 for _, _, w in want)
    once = [(v, signal.there_and_back(x, 11025, v).tolist()) for v in (8000, 11025, 22050, 48000)]
    assert once == [(v, signal.resample(signal.resample(x, 11025, v), v, 11025).tolist()) for v, _ in once]


def test_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(30)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    append_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = index.postings(text.fingerprints(spark.read.parquet(str(tmp_path / "in")))).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
