"""Signal operators on clips in long form: (clip_id, idx, v), one row for each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import db_to_linear, decibels, doubling, gain, quantized


def clip_window():
    return Window.partitionBy("clip_id")


def sized(samples: DataFrame) -> DataFrame:
    return samples.withColumn("n", F.count("*").over(clip_window()))


def chunk_energy(samples: DataFrame, rate: int) -> DataFrame:
    """(clip_id, chunk, energy): mean square of chunks of 10 ms from the start, the last one maybe shorter."""
    chunk = max(1, rate // 100)
    return samples.groupBy("clip_id", F.floor(F.col("idx") / chunk).alias("chunk")).agg(F.avg(F.col("v") * F.col("v")).alias("energy"))


def _bounded(samples: DataFrame, rate: int, threshold_db: float) -> DataFrame:
    """samples with n, first and last of their clip: windows over one dealing by clip, no join."""
    chunk, level = max(1, rate // 100), db_to_linear(threshold_db)
    fore, back = F.floor(F.col("idx") / chunk), F.floor((F.col("n") - 1 - F.col("idx")) / chunk)
    x = sized(samples).withColumn("_fore", fore).withColumn("_back", back)
    energy = lambda k: F.avg(F.col("v") * F.col("v")).over(Window.partitionBy("clip_id", k))
    x = x.withColumn("_e", energy("_fore")).withColumn("_f", energy("_back")).withColumn("_c", F.count("*").over(Window.partitionBy("clip_id", "_back")))
    first = F.min(F.when(F.col("_e") >= level, F.col("_fore") * chunk)).over(clip_window())
    last = F.max(F.when((F.col("_f") >= level) & (F.col("_c") == chunk), F.col("n") - 1 - F.col("_back") * chunk)).over(clip_window())
    x = x.withColumn("_first", first).withColumn("_last", last)
    none = F.col("_first").isNull() | F.col("_last").isNull()
    return x.select("clip_id", "idx", "v", "n", F.when(~none, F.col("_first")).alias("first"), F.when(~none, F.col("_last")).alias("last"))


def silence_bounds(samples: DataFrame, rate: int, threshold_db: float) -> DataFrame:
    """(clip_id, n, first, last): bounds of what isn't silent, null where all is; the search for the end has its grid at the end."""
    return _bounded(samples, rate, threshold_db).where("idx = 0").select("clip_id", "n", "first", "last")


def trim_silence(samples: DataFrame, rate: int, threshold_db: float, padding_ms: int) -> DataFrame:
    """(clip_id, idx, v) of what remains, numbered from 0; a silent clip becomes zeros of the padding's length."""
    pad = padding_ms * rate // 1000
    x = _bounded(samples, rate, threshold_db)
    start, end = F.greatest(F.lit(0), F.col("first") - pad), F.least(F.col("n") - 1, F.col("last") + pad)
    silent = F.col("first").isNull()
    kept = x.where(F.when(silent, F.col("idx") < F.least(F.lit(pad), F.col("n"))).otherwise((F.col("idx") >= start) & (F.col("idx") <= end)))
    return kept.select("clip_id", (F.col("idx") - F.when(silent, 0).otherwise(start)).alias("idx"), F.when(silent, 0.0).otherwise(F.col("v")).alias("v"))


def rms_peak(samples: DataFrame) -> DataFrame:
    return samples.groupBy("clip_id").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.max(F.abs("v")).alias("peak"))


def levels(samples: DataFrame) -> DataFrame:
    """(clip_id, rms_db, peak_db) in decibels, -100 for silence."""
    return rms_peak(samples).select("clip_id", decibels(F.col("rms")).alias("rms_db"), decibels(F.col("peak")).alias("peak_db"))


def normalize_volume(samples: DataFrame, target_db: float, use_rms: bool = True) -> DataFrame:
    level = F.sqrt(F.avg(F.col("v") * F.col("v")).over(clip_window())) if use_rms else F.max(F.abs("v")).over(clip_window())
    return samples.withColumn("_level", level).select("clip_id", "idx", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") * gain(F.col("_level"), target_db))).alias("v"))


def resample_linear(samples: DataFrame, rate: int, target: int) -> DataFrame:
    """Linear interpolation: each sample and its next meet by index, not by a join over ranges."""
    step = rate / target
    x = sized(samples).withColumn("next", F.coalesce(F.lead("v").over(clip_window().orderBy("idx")), F.col("v")))
    n_out = F.floor(F.col("n") * (target / rate))
    # the outputs whose place falls between this sample and the next
    lo, hi = F.ceil(F.col("idx") / step - 1e-9), F.ceil((F.col("idx") + 1) / step - 1e-9) - 1
    out = x.withColumn("o", F.explode(F.when(lo <= F.least(hi, n_out - 1), F.sequence(lo, F.least(hi, n_out - 1))).otherwise(F.array().cast("array<bigint>"))))
    part = F.col("o") * step - F.col("idx")
    return out.select("clip_id", F.col("o").alias("idx"), (F.col("v") + (F.col("next") - F.col("v")) * part).alias("v"))


def quantize(samples: DataFrame) -> DataFrame:
    return samples.select("clip_id", "idx", quantized(F.col("v")).alias("q"))


def doubling_decision(samples: DataFrame, rate: int, threshold_db: float, padding_ms: int) -> DataFrame:
    """(clip_id, original, trimmed, doubled) with durations in seconds."""
    cut = trim_silence(samples, rate, threshold_db, padding_ms).groupBy("clip_id").agg(F.count("*").alias("m"))
    x = samples.groupBy("clip_id").agg(F.count("*").alias("n")).join(cut, "clip_id", "left").withColumns({"original": F.col("n") / rate, "trimmed": F.coalesce("m", F.lit(0)) / rate})
    return x.select("clip_id", "original", "trimmed", doubling(F.col("trimmed"), F.col("original")).alias("doubled"))
