"""Registered queries of the fingerprint engine: each callable with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MOST_WORDS, CompareConfig
from ..functions.bits import differing_bits, is_valid, low16
from ..operators import clips, cluster, index, robustness, similar
from ..operators import compare as cmp
from ..runtime import settle
from ..sources import audio, text

C = CompareConfig()
#: Clips are the values of one user in order of time, in thousandths; four samples are 10 ms.
RATE, SILENCE_DB, PADDING_MS = 400, -30.0, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(text.fingerprints(read(spark, sf_dir, "documents")), wide=True)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), place.cast("bigint").alias("idx"), (F.col("value") / 1000).alias("v"))


def fp_words(spark, d):
    return index.words(text.fingerprints(read(spark, d, "documents"))).select("file_id", F.col("pos").cast("bigint").alias("pos"), "w")


def fp_valid(spark, d):
    valid = is_valid(F.col("data"), F.col("sample_rate"), F.col("duration"), MOST_WORDS)
    return text.fingerprints(read(spark, d, "documents")).select("file_id", F.size("data").cast("bigint").alias("n_words"), valid.alias("valid"))


def fp_limited(spark, d):
    """At most 100 words of each fingerprint."""
    f = index.limited(text.fingerprints(read(spark, d, "documents")), 100)
    return index.words(f).select("file_id", F.col("pos").cast("bigint").alias("pos"), "w")


def hash_extract(spark, d):
    return fp_words(spark, d).select("file_id", "pos", low16(F.col("w")).cast("bigint").alias("hash"))


def index_stats(spark, d):
    return index.stats(fps(spark, d)).select("file_count", "index_size", F.round("mean_postings", 6).alias("mean_postings"))


def candidate_pairs(spark, d):
    return index.candidates(text.fingerprints(read(spark, d, "documents")), C)


def candidates_for_file(spark, d):
    """Searches of the files whose id is divisible by 20, against all files."""
    f = fps(spark, d)
    return index.candidates(f, C, f.where("file_id % 20 = 0"))


def multi_source_scan(spark, d):
    both = read(spark, d, "documents").select("doc_id", "text").unionByName(read(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text"))
    return index.counted(text.fingerprints(both)).groupBy((F.col("file_id") < 0).alias("from_benchmark")).agg(F.countDistinct("file_id").alias("files"), F.sum("n").alias("postings"))


def jaccard_filter(spark, d):
    return index.similar_sets(fps(spark, d), C).select("a", "b", F.round("overlap", 9).alias("overlap"))


def _similar(spark, d) -> tuple[similar.Links, DataFrame]:
    f = fps(spark, d)
    return similar.linked(f, C), f


def similarity_offset0(spark, d):
    pairs, f = _similar(spark, d)
    return cmp.at_offset(pairs, f, 0).select("a", "b", F.round("similarity", 9).alias("similarity"), F.round("bit_error_rate", 9).alias("bit_error_rate"), "overlap")


def offset_histogram(spark, d):
    pairs, f = _similar(spark, d)
    return cmp.offset_histogram(pairs, f, C)


def gaussian_histogram(spark, d):
    pairs, f = _similar(spark, d)
    return cmp.gaussian_histogram(pairs, f, C).select("a", "b", "off", F.round("f", 6).alias("f"))


def histogram_peak(spark, d):
    pairs, f = _similar(spark, d)
    return cmp.histogram_peak(pairs, f, C).select("a", "b", "peak_offset", F.round("height", 6).alias("height"))


def correlation_alignment(spark, d):
    pairs, f = _similar(spark, d)
    return cmp.correlation_alignment(pairs, f, C).select("a", "b", F.col("offset").cast("bigint").alias("offset"), F.round("similarity", 9).alias("similarity"))


def best_alignment(spark, d):
    pairs, f = _similar(spark, d)
    return cmp.best_alignment(pairs, f, C).select("a", "b", "best_offset", F.round("similarity", 9).alias("similarity"))


def filter_candidates(spark, d):
    return index.filter_candidates(text.fingerprints(read(spark, d, "documents")), C).select("a", "b", "hits", F.round("overlap", 9).alias("overlap"))


def _matches(spark, d, sliding: bool = False) -> DataFrame:
    pairs, f = _similar(spark, d)
    return cmp.compare(pairs, f, C, sliding)


def _shown(m: DataFrame, *more: str) -> DataFrame:
    r = lambda c: F.round(c, 9).alias(c)
    return m.select("a", "b", r("similarity_score"), F.col("best_offset").cast("bigint").alias("best_offset"), "matched_segments", r("bit_error_rate"), "is_duplicate", *map(r, more))


def compare_pairs(spark, d):
    return _shown(_matches(spark, d))


def duplicate_edges(spark, d):
    return _shown(_matches(spark, d)).where("is_duplicate")


def sliding_compare(spark, d):
    return _shown(_matches(spark, d, sliding=True), "coverage_ratio")


def segment_matches(spark, d):
    m = _matches(spark, d, sliding=True)
    return m.select("a", "b", F.posexplode("segment_matches").alias("rank", "s")).select("a", "b", F.col("rank").cast("bigint").alias("rank"), F.col("s.offset").cast("bigint").alias("offset"), F.round("s.similarity", 9).alias("similarity"))


def _groups(spark, d) -> DataFrame:
    return cluster.duplicate_groups(fps(spark, d), C)


def duplicate_groups(spark, d):
    return _groups(spark, d).select("group_id", F.concat_ws(",", F.transform("file_ids", lambda x: x.cast("string"))).alias("file_ids"), F.round("avg_similarity", 9).alias("avg_similarity"))


def group_summary(spark, d):
    return cluster.summary(_groups(spark, d))


def groups_csv(spark, d):
    g = settle(_groups(spark, d).withColumn("avg_similarity", F.round("avg_similarity", 9)))
    return cluster.csv_rows(g).select(F.col("group_no").cast("bigint").alias("group_no"), "similarity", "file")


def hamming_embedding_pairs(spark, d):
    """Pairs of embeddings whose 64 sign bits differ in at most 3: one of four bands of 16 bits is then equal."""
    sign = lambda lo, hi: F.aggregate(F.slice("embedding", lo + 1, hi - lo), F.lit(0).cast("bigint"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0).cast("bigint"))
    e = read(spark, d, "embeddings").select("vec_id", sign(0, 32).alias("w0"), sign(32, 64).alias("w1"))
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate((F.shiftright("w0", 16), F.col("w0").bitwiseAND(65535), F.shiftright("w1", 16), F.col("w1").bitwiseAND(65535)))]))
    x = settle(e.select("vec_id", "w0", "w1", bands.alias("k")).select("vec_id", "w0", "w1", "k.i", "k.v"))
    a, b = (x.select(F.col("vec_id").alias(n), F.col("w0").alias(f"w0{n}"), F.col("w1").alias(f"w1{n}"), "i", "v") for n in "ab")
    far = differing_bits(F.col("w0a"), F.col("w0b")) + differing_bits(F.col("w1a"), F.col("w1b"))
    return a.join(b, ["i", "v"]).where("a < b").withColumn("distance", far).where("distance <= 3").select("a", "b", "distance").distinct()


def chunk_energy(spark, d):
    return clips.chunk_energy(samples(spark, d), RATE).select("clip_id", "chunk", F.round("energy", 9).alias("energy"))


def silence_bounds(spark, d):
    return clips.silence_bounds(samples(spark, d), RATE, SILENCE_DB)


def trim_silence(spark, d):
    return clips.trim_silence(samples(spark, d), RATE, SILENCE_DB, PADDING_MS)


def rms_peak(spark, d):
    return clips.rms_peak(samples(spark, d)).select("clip_id", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"))


def normalize_volume(spark, d):
    return clips.normalize_volume(samples(spark, d), -20.0).select("clip_id", "idx", F.round("v", 9).alias("v"))


def normalize_peak(spark, d):
    return clips.normalize_volume(samples(spark, d), -3.0, use_rms=False).select("clip_id", "idx", F.round("v", 9).alias("v"))


def level_decibels(spark, d):
    return clips.levels(samples(spark, d)).select("clip_id", F.round("rms_db", 6).alias("rms_db"), F.round("peak_db", 6).alias("peak_db"))


def resample_linear(spark, d):
    return clips.resample_linear(samples(spark, d), 400, 500).select("clip_id", "idx", F.round("v", 9).alias("v"))


def quantize_int16(spark, d):
    return clips.quantize(samples(spark, d)).withColumn("q", F.col("q").cast("bigint"))


def doubling_decision(spark, d):
    return clips.doubling_decision(samples(spark, d), RATE, SILENCE_DB, PADDING_MS)


def robustness_rates(spark, d):
    """Clips against the same clips with silence, other volume, rate or speed, compared by the engine."""
    return robustness.detection(robustness.comparisons(_wavs(spark, d))).select("category", "threshold", "total", "detected", F.round("rate", 6).alias("rate"))


def robustness_buckets(spark, d):
    r = robustness.by_category(settle(robustness.detection(robustness.comparisons(_wavs(spark, d)))))
    return r.select("category", *[F.round(c, 6).alias(c) for c in ("max_rate", "min_rate", "avg_rate")], "best_threshold", robustness.bucket(F.round("avg_rate", 6)).alias("bucket"))


def memory_trend_slope(spark, d):
    return robustness.trend(samples(spark, d), "clip_id", "idx", "v").select("clip_id", F.round("slope", 9).alias("slope"))


def _wavs(spark, d) -> DataFrame:
    """Each clip as a WAV file's bytes, as a scan of files gives them; made on the executors."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    each = samples(spark, d).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("s"))
    each = each.repartition(parts, "clip_id")  # a number, so that few bytes of samples are not put together in one task of much work

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            made = [audio.encode(np.interp(np.arange(0, len(s), 1 / 256), np.arange(len(s)), [x["v"] for x in s]) * np.sin(np.arange(256 * len(s)) / 7), 11025) for s in pdf["s"]]
            yield pd.DataFrame({"path": [f"clip-{i:08d}.wav" for i in pdf["clip_id"]], "content": made})

    return each.mapInPandas(run, "path string, content binary")


def scan_audio(spark, d):
    return audio.metadata(_wavs(spark, d))


def fingerprint_audio(spark, d):
    f = audio.fingerprints(_wavs(spark, d))
    return f.select("file_id", "file_path", F.size("data").alias("n_words"), "sample_rate", F.round("duration", 6).alias("duration"), "error")


def preprocess_report(spark, d):
    from ..config import PreprocessConfig

    before, after = audio.clips(_wavs(spark, d)), audio.clips(_wavs(spark, d), PreprocessConfig())
    sel = lambda x, n: x.select("file_path", F.col("sample_rate").alias(f"{n}_rate"), F.round("duration", 6).alias(f"{n}_duration"), F.col("frames").alias(f"{n}_samples"))
    return sel(before, "original").join(sel(after, "processed"), "file_path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fp_words, fp_valid, fp_limited, hash_extract, index_stats, candidate_pairs, candidates_for_file, multi_source_scan, jaccard_filter, similarity_offset0, offset_histogram, gaussian_histogram, histogram_peak,
        correlation_alignment, best_alignment, filter_candidates, compare_pairs, duplicate_edges, duplicate_groups, group_summary, groups_csv, sliding_compare, segment_matches, hamming_embedding_pairs, chunk_energy, silence_bounds,
        trim_silence, rms_peak, normalize_volume, normalize_peak, level_decibels, resample_linear, quantize_int16, doubling_decision, robustness_rates, robustness_buckets, memory_trend_slope, scan_audio, fingerprint_audio, preprocess_report,
    )
}

# --- the same in SQL -------------------------------------------------------------------------

_FP = """toks AS (SELECT doc_id AS file_id, list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '') AS t FROM documents),
fp AS (SELECT file_id, list_transform(generate_series(1, len(t) - 2), lambda i: CAST(('0x' || substr(md5(t[i] || ' ' || t[i+1] || ' ' || t[i+2]), 1, 8)) AS BIGINT)) AS data FROM toks WHERE len(t) >= 3),
words AS (SELECT file_id, unnest(data) AS w, CAST(generate_subscripts(data, 1) - 1 AS BIGINT) AS pos FROM fp),
post AS (SELECT file_id, pos, w & 65535 AS hash, w FROM words)"""
_SIM = _FP + """, sets AS (SELECT file_id, hash, count(*) AS n FROM post GROUP BY ALL), sz AS (SELECT file_id, count(*) AS s FROM sets GROUP BY 1),
cand AS (SELECT a.file_id AS a, b.file_id AS b, CAST(sum(a.n * b.n) AS BIGINT) AS hits, count(*) AS shared FROM sets a JOIN sets b ON a.hash = b.hash AND a.file_id < b.file_id GROUP BY ALL HAVING sum(a.n * b.n) >= 5),
sim AS (SELECT a, b, CAST(shared AS DOUBLE) / (x.s + y.s - shared) AS overlap FROM cand JOIN sz x ON x.file_id = a JOIN sz y ON y.file_id = b WHERE CAST(shared AS DOUBLE) / (x.s + y.s - shared) >= CAST(0.51 AS DOUBLE))"""
_HIST = _SIM + """, hist AS (SELECT a, b, y.pos - x.pos AS off, count(*) AS n FROM sim JOIN post x ON x.file_id = a JOIN post y ON y.file_id = b AND y.hash = x.hash AND abs(y.pos - x.pos) <= 360 GROUP BY ALL)"""
_KERNEL = ", ".join(f"({d}, CAST({w!r} AS DOUBLE))" for d, w in cmp.kernel(C))
_GAUSS = _HIST + f""", kernel(d, w) AS (VALUES {_KERNEL}),
g AS (SELECT a, b, off + d AS off, sum(n * w) AS x FROM hist, kernel WHERE abs(off + d) <= 360 GROUP BY ALL),
norm AS (SELECT o AS off, sum(w) AS w FROM generate_series(-360, 360) r(o), kernel WHERE abs(o + d) <= 360 GROUP BY 1),
gauss AS (SELECT a, b, g.off, x / norm.w AS f FROM g JOIN norm USING (off))"""
_PEAK = _GAUSS + """, r9 AS (SELECT a, b, off, round(f, 9) AS f FROM gauss),
near AS (SELECT c.a, c.b, c.off, c.f, coalesce(l.f, 0) AS l, coalesce(r.f, 0) AS r FROM r9 c LEFT JOIN r9 l ON l.a = c.a AND l.b = c.b AND l.off = c.off - 1 LEFT JOIN r9 r ON r.a = c.a AND r.b = c.b AND r.off = c.off + 1),
peaks AS (SELECT a, b, off, f, row_number() OVER (PARTITION BY a, b ORDER BY f DESC, off) AS k FROM near WHERE f > l AND f > r AND f > 0.1 AND abs(off) < 360),
peak AS (SELECT a, b, off AS peak_offset, f AS height FROM peaks WHERE k = 1)"""
_SIMS = """, offs AS (SELECT CAST(o AS BIGINT) AS off FROM generate_series(-360, 360) r(o)),
laid AS (SELECT a, b, off, greatest(0, -off) AS lo, least(len(x.data), len(y.data) - off) AS hi, x.data AS da, y.data AS db FROM sim JOIN fp x ON x.file_id = a JOIN fp y ON y.file_id = b CROSS JOIN offs),
wrong AS (SELECT a, b, off, hi - lo AS n, CAST(list_sum(list_transform(list_zip(da[lo + 1 : hi], db[lo + off + 1 : hi + off]), lambda z: bit_count(xor(z[1], z[2])))) AS BIGINT) AS bad FROM laid WHERE hi > lo),
sims AS (SELECT a, b, off, n, (32 * n - bad) / (32.0::DOUBLE * n) AS s, bad / (32.0::DOUBLE * n) AS ber FROM wrong),
corr AS (SELECT a, b, off, s FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, off) AS k FROM sims WHERE (off + 360) % 6 = 0) WHERE k = 1)"""
_MATCH = _PEAK + _SIMS + """, start AS (SELECT sim.a, sim.b, coalesce(peak_offset, 0) AS h, coalesce(hs.s, 0) AS sh, coalesce(corr.off, 0) AS k, coalesce(corr.s, 0) AS sk
  FROM sim LEFT JOIN peak USING (a, b) LEFT JOIN corr USING (a, b) LEFT JOIN sims hs ON hs.a = sim.a AND hs.b = sim.b AND hs.off = coalesce(peak_offset, 0)),
base AS (SELECT a, b, CASE WHEN sh >= sk THEN h ELSE k END AS off, greatest(sh, sk) AS s FROM start),
tune(a, b, o, best, score) AS (SELECT a, b, greatest(-360, off - 2), off, s FROM base
  UNION ALL SELECT t.a, t.b, t.o + 1, CASE WHEN coalesce(s.s, 0) > score THEN t.o ELSE best END, greatest(score, coalesce(s.s, 0)) FROM tune t LEFT JOIN sims s ON s.a = t.a AND s.b = t.b AND s.off = t.o WHERE t.o <= least(360, best + 2)),
tuned AS (SELECT a, b, arg_max(best, o) AS best FROM tune GROUP BY 1, 2),
len AS (SELECT file_id, len(data) AS m FROM fp),
scored AS (SELECT t.a, t.b, coalesce(s.s, 0) AS s, t.best, coalesce(s.n, 0) AS n, coalesce(s.ber, 1) AS ber, la.m >= 10 AND lb.m >= 10 AS enough FROM tuned t LEFT JOIN sims s ON s.a = t.a AND s.b = t.b AND s.off = t.best JOIN len la ON la.file_id = t.a JOIN len lb ON lb.file_id = t.b),
match AS (SELECT a, b, CASE WHEN enough THEN s ELSE 0 END AS similarity_score, CASE WHEN enough THEN best ELSE 0 END AS best_offset, CASE WHEN enough THEN n ELSE 0 END AS matched_segments,
  CASE WHEN enough THEN ber ELSE 1 END AS bit_error_rate, enough AND s >= 0.85::DOUBLE AND ber <= 0.15::DOUBLE AND n >= 10 AS is_duplicate FROM scored)"""
_GROUP = _MATCH + """, e AS (SELECT a, b FROM match WHERE is_duplicate), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM e UNION SELECT b FROM e)),
low AS (SELECT ids.id, ids.k, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS low FROM ids LEFT JOIN e ON e.b = ids.id GROUP BY ALL),
greedy(k, pivots) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT low.k, CASE WHEN list_has_any(pivots, low.low) THEN pivots ELSE list_append(pivots, low.id) END FROM greedy JOIN low ON low.k = greedy.k + 1),
piv AS (SELECT unnest(arg_max(pivots, k)) AS p FROM greedy),
mem AS (SELECT e.b AS m, min(e.a) AS p FROM e JOIN piv ON piv.p = e.a WHERE e.b NOT IN (SELECT p FROM piv) GROUP BY 1 UNION ALL SELECT p, p FROM piv),
grp AS (SELECT p, list(m ORDER BY m) AS ids, count(*) AS n FROM mem GROUP BY 1 HAVING count(*) > 1),
tot AS (SELECT x.p, sum(similarity_score) AS t FROM match JOIN mem x ON x.m = a JOIN mem y ON y.m = b AND x.p = y.p GROUP BY 1),
groups AS (SELECT grp.p AS group_id, ids, n, round(coalesce(t, 0) / (n * (n - 1) / 2.0::DOUBLE), 9) AS avg_similarity FROM grp LEFT JOIN tot USING (p))"""
_CLIP = """s AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value / 1000 AS v FROM events),
z AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM s)"""
_LEVEL = f"CAST({10 ** (SILENCE_DB / 20)!r} AS DOUBLE)"
_BOUNDS = _CLIP + f""", f AS (SELECT clip_id, n, min(k * 4) FILTER (e >= {_LEVEL}) AS first FROM (SELECT clip_id, n, idx // 4 AS k, avg(v * v) AS e FROM z GROUP BY ALL) GROUP BY ALL),
l AS (SELECT clip_id, max(n - 1 - k * 4) FILTER (e >= {_LEVEL} AND c = 4) AS last FROM (SELECT clip_id, n, (n - 1 - idx) // 4 AS k, avg(v * v) AS e, count(*) AS c FROM z GROUP BY ALL) GROUP BY ALL),
bounds AS (SELECT clip_id, n, CASE WHEN last IS NOT NULL THEN first END AS first, CASE WHEN first IS NOT NULL THEN last END AS last FROM f JOIN l USING (clip_id))"""
_TRIM = _BOUNDS + """, trimmed AS (SELECT s.clip_id, idx - CASE WHEN first IS NULL THEN 0 ELSE greatest(0, first - 4) END AS idx, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE v END AS v
  FROM s JOIN bounds USING (clip_id) WHERE CASE WHEN first IS NULL THEN idx < least(4, n) ELSE idx >= greatest(0, first - 4) AND idx <= least(n - 1, last + 4) END)"""
_WINDOWS = _SIM + """, duo AS (SELECT a, b, x.data AS da, y.data AS db, len(x.data) AS n, len(y.data) AS m FROM sim JOIN fp x ON x.file_id = a JOIN fp y ON y.file_id = b WHERE len(x.data) >= 10 AND len(y.data) >= 10),
starts AS (SELECT a, b, i, da, db, m FROM duo, unnest(generate_series(0, n - 60, 30)) u(i) WHERE n >= 60 AND m >= 60),
tried AS (SELECT a, b, i, j, CAST(list_sum(list_transform(list_zip(da[i + 1 : i + 60], db[j + 1 : j + 60]), lambda z: bit_count(xor(z[1], z[2])))) AS BIGINT) AS bad FROM starts, unnest(generate_series(0, m - 60, 6)) w(j)),
chosen AS (SELECT a, b, i, min(bad) AS bad, arg_min(j, bad * 1000000 + j) AS j FROM tried GROUP BY a, b, i),
listed AS (SELECT a, b, CAST(j - i AS BIGINT) AS off, (1920 - bad) / 1920.0::DOUBLE AS s, row_number() OVER (PARTITION BY a, b ORDER BY bad, j - i) AS k FROM chosen WHERE (1920 - bad) / 1920.0::DOUBLE >= CAST(0.8 AS DOUBLE) * CAST(0.85 AS DOUBLE)),
greedy(a, b, k, kept, last) AS (SELECT a, b, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM (SELECT DISTINCT a, b FROM listed)
  UNION ALL SELECT g.a, g.b, l.k, CASE WHEN len(list_filter(kept, lambda o: abs(o - l.off) <= 30)) = 0 THEN list_append(kept, l.off) ELSE kept END, len(list_filter(kept, lambda o: abs(o - l.off) <= 30)) = 0 FROM greedy g JOIN listed l ON l.a = g.a AND l.b = g.b AND l.k = g.k + 1),
segs AS (SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY k) - 1 AS rank, off, s FROM listed JOIN greedy USING (a, b, k) WHERE last)"""
_SLIDE = _WINDOWS + """, score AS (SELECT a, b, sum(s * s) / sum(s) AS similarity_score, arg_min(off, rank) AS best_offset, count(*) AS matched_segments FROM segs GROUP BY 1, 2),
top AS (SELECT a, b, similarity_score, best_offset, matched_segments, da, db, n, m, greatest(0, -best_offset) AS lo, least(n, m - best_offset) AS hi, least(60 * matched_segments, greatest(n, m)) / greatest(n, m)::DOUBLE AS coverage_ratio FROM score JOIN duo USING (a, b)),
slid AS (SELECT *, CAST(list_sum(list_transform(list_zip(da[lo + 1 : hi], db[lo + best_offset + 1 : hi + best_offset]), lambda z: bit_count(xor(z[1], z[2])))) AS BIGINT) / (32.0::DOUBLE * (hi - lo)) AS ber FROM top)"""

ORACLE: dict[str, str] = {
    "fp_words": f"WITH {_FP} SELECT file_id, pos, w FROM words",
    "fp_valid": f"WITH {_FP} SELECT file_id, len(data) AS n_words, len(data) < 100000 AS valid FROM fp",
    "fp_limited": f"WITH {_FP} SELECT file_id, pos, w FROM words WHERE pos < 100",
    "hash_extract": f"WITH {_FP} SELECT file_id, pos, hash FROM post",
    "index_stats": f"WITH {_FP} SELECT count(DISTINCT file_id) AS file_count, count(DISTINCT hash) AS index_size, round(count(*) / count(DISTINCT hash)::DOUBLE, 6) AS mean_postings FROM post",
    "candidate_pairs": f"WITH {_SIM} SELECT a, b, hits FROM cand",
    "candidates_for_file": f"WITH {_SIM} SELECT a.file_id AS a, b.file_id AS b, CAST(sum(a.n * b.n) AS BIGINT) AS hits FROM sets a JOIN sets b USING (hash) WHERE a.file_id % 20 = 0 GROUP BY ALL HAVING sum(a.n * b.n) >= 5",
    "multi_source_scan": f"WITH {_FP.replace('FROM documents', 'FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark)')} SELECT file_id < 0 AS from_benchmark, count(DISTINCT file_id) AS files, count(*) AS postings FROM post GROUP BY 1",
    "jaccard_filter": f"WITH {_SIM} SELECT a, b, round(overlap, 9) AS overlap FROM sim",
    "similarity_offset0": f"WITH {_SIM} SELECT a, b, round((32 * count(*) - sum(bit_count(xor(x.w, y.w)))) / (32.0::DOUBLE * count(*)), 9) AS similarity, round(sum(bit_count(xor(x.w, y.w))) / (32.0::DOUBLE * count(*)), 9) AS bit_error_rate, count(*) AS overlap FROM sim JOIN words x ON x.file_id = a JOIN words y ON y.file_id = b AND y.pos = x.pos GROUP BY a, b",
    "offset_histogram": f"WITH {_HIST} SELECT a, b, off, n FROM hist",
    "gaussian_histogram": f"WITH {_GAUSS} SELECT a, b, off, round(f, 6) AS f FROM gauss",
    "histogram_peak": f"WITH {_PEAK} SELECT a, b, peak_offset, round(height, 6) AS height FROM peak",
    "correlation_alignment": f"WITH {_SIM}{_SIMS} SELECT a, b, off AS offset, round(s, 9) AS similarity FROM corr",
    "best_alignment": f"WITH RECURSIVE {_MATCH} SELECT a, b, CAST(best AS BIGINT) AS best_offset, round(s, 9) AS similarity FROM scored",
    "filter_candidates": f"WITH {_SIM} SELECT a, b, hits, round(overlap, 9) AS overlap FROM (SELECT a, b, hits, CAST(shared AS DOUBLE) / (x.s + y.s - shared) AS overlap FROM cand JOIN sz x ON x.file_id = a JOIN sz y ON y.file_id = b) WHERE overlap >= CAST(0.51 AS DOUBLE)",
    "compare_pairs": f"WITH RECURSIVE {_MATCH} SELECT a, b, round(similarity_score, 9) AS similarity_score, best_offset, matched_segments, round(bit_error_rate, 9) AS bit_error_rate, is_duplicate FROM match",
    "duplicate_edges": f"WITH RECURSIVE {_MATCH} SELECT a, b, round(similarity_score, 9) AS similarity_score, best_offset, matched_segments, round(bit_error_rate, 9) AS bit_error_rate, is_duplicate FROM match WHERE is_duplicate",
    "duplicate_groups": f"WITH RECURSIVE {_GROUP} SELECT group_id, array_to_string(ids, ',') AS file_ids, avg_similarity FROM groups",
    "group_summary": f"WITH RECURSIVE {_GROUP} SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_files, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS savings FROM groups",
    "groups_csv": f"WITH RECURSIVE {_GROUP} SELECT row_number() OVER (ORDER BY avg_similarity DESC, group_id) AS group_no, printf('%.2f%%', floor(10000 * avg_similarity + 0.5) / 100) AS similarity, ids FROM groups",
    "hamming_embedding_pairs": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) AS distance FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) <= 3",
    "chunk_energy": f"WITH {_CLIP} SELECT clip_id, idx // 4 AS chunk, round(avg(v * v), 9) AS energy FROM s GROUP BY ALL",
    "silence_bounds": f"WITH {_BOUNDS} SELECT * FROM bounds",
    "trim_silence": f"WITH {_TRIM} SELECT * FROM trimmed",
    "rms_peak": f"WITH {_CLIP} SELECT clip_id, round(sqrt(avg(v * v)), 9) AS rms, round(max(abs(v)), 9) AS peak FROM s GROUP BY 1",
    "normalize_volume": f"WITH {_CLIP}, r AS (SELECT clip_id, sqrt(avg(v * v)) AS rms FROM s GROUP BY 1) SELECT clip_id, idx, round(greatest(-1.0, least(1.0, v * CASE WHEN rms < 0.001 THEN 0.1 ELSE least(10.0, greatest(0.1, 0.1 / rms)) END)), 9) AS v FROM s JOIN r USING (clip_id)",
    "normalize_peak": f"WITH {_CLIP}, r AS (SELECT clip_id, max(abs(v)) AS peak FROM s GROUP BY 1) SELECT clip_id, idx, round(greatest(-1.0, least(1.0, v * CASE WHEN peak < 0.001 THEN 0.1 ELSE least(10.0, greatest(0.1, CAST({10 ** (-3 / 20)!r} AS DOUBLE) / peak)) END)), 9) AS v FROM s JOIN r USING (clip_id)",
    "level_decibels": f"WITH {_CLIP}, r AS (SELECT clip_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM s GROUP BY 1) SELECT clip_id, round(CASE WHEN rms <= 0 THEN -100.0 ELSE 20 * log10(rms) END, 6) AS rms_db, round(CASE WHEN peak <= 0 THEN -100.0 ELSE 20 * log10(peak) END, 6) AS peak_db FROM r",
    "resample_linear": f"WITH {_CLIP}, o AS (SELECT clip_id, n, unnest(generate_series(0, CAST(floor(n * 1.25) AS BIGINT) - 1)) AS idx FROM (SELECT DISTINCT clip_id, n FROM z)) SELECT o.clip_id, o.idx, round(a.v + (coalesce(b.v, a.v) - a.v) * (o.idx * 0.8 - floor(o.idx * 0.8 + 1e-9)), 9) AS v FROM o JOIN s a ON a.clip_id = o.clip_id AND a.idx = CAST(floor(o.idx * 0.8 + 1e-9) AS BIGINT) LEFT JOIN s b ON b.clip_id = o.clip_id AND b.idx = a.idx + 1",
    "quantize_int16": f"WITH {_CLIP} SELECT clip_id, idx, CAST(trunc(greatest(-1.0, least(1.0, v)) * 32767) AS BIGINT) AS q FROM s",
    "doubling_decision": f"WITH {_TRIM}, m AS (SELECT clip_id, count(*) AS m FROM trimmed GROUP BY 1), x AS (SELECT b.clip_id, n / 400.0::DOUBLE AS original, coalesce(m, 0) / 400.0::DOUBLE AS trimmed FROM bounds b LEFT JOIN m USING (clip_id)) SELECT *, CASE WHEN trimmed >= 3 THEN false WHEN trimmed / original >= 0.5 THEN true ELSE original >= 1.5 END AS doubled FROM x",
    "segment_matches": f"WITH RECURSIVE {_WINDOWS} SELECT a, b, rank, off AS offset, round(s, 9) AS similarity FROM segs",
    "sliding_compare": f"WITH RECURSIVE {_SLIDE} SELECT sim.a, sim.b, round(coalesce(similarity_score, 0), 9) AS similarity_score, coalesce(best_offset, 0) AS best_offset, coalesce(matched_segments, 0) AS matched_segments, round(coalesce(ber, 1), 9) AS bit_error_rate, coalesce(similarity_score >= 0.85::DOUBLE AND ber <= 0.15::DOUBLE AND coverage_ratio >= 0.5 AND matched_segments >= 3, false) AS is_duplicate, round(coalesce(coverage_ratio, 0), 9) AS coverage_ratio FROM sim LEFT JOIN slid ON slid.a = sim.a AND slid.b = sim.b",
    "memory_trend_slope": f"WITH {_CLIP} SELECT clip_id, round(regr_slope(v, idx), 9) AS slope FROM s GROUP BY 1",
}
ORACLE["groups_csv"] = f"SELECT group_no, similarity, unnest(ids) AS file FROM ({ORACLE['groups_csv']})"
