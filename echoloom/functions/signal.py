"""Signal preparation of one clip (numpy) and its column forms for samples in long form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SHORT_SECONDS, PreprocessConfig


def db_to_linear(db: float) -> float:
    return 10 ** (db / 20)


def linear_to_db(x: float) -> float:
    return -100.0 if x <= 0 else 20 * np.log10(x)


def to_mono(interleaved: np.ndarray, channels: int) -> np.ndarray:
    return interleaved if channels == 1 else interleaved[: len(interleaved) // channels * channels].reshape(-1, channels).mean(1)


def resample(x: np.ndarray, rate: int, target: int, hold_last: bool = True) -> np.ndarray:
    """Linear interpolation to floor(n * ratio) samples; past the last sample it is held, or zero."""
    if rate == target or not len(x):
        return x
    ratio = target / rate
    return _between(lambda i: x[i], len(x) - 1, np.arange(int(len(x) * ratio)) / ratio, hold_last)


def there_and_back(x: np.ndarray, rate: int, via: int) -> np.ndarray:
    """``resample`` to another rate and back; of the samples at the other rate only those are made that the way back reads."""
    if rate == via or not len(x) or not int(len(x) * (via / rate)):
        return resample(resample(x, rate, via), via, rate)
    ratio, back = via / rate, rate / via
    n = int(len(x) * ratio)
    return _between(lambda i: _between(lambda j: x[j], len(x) - 1, i / ratio, True), n - 1, np.arange(int(n * back)) / back, True)


def _between(samples: Callable[[np.ndarray], np.ndarray], last: int, at: np.ndarray, hold_last: bool) -> np.ndarray:
    """Samples interpolated at places that rise; the last is at ``last``."""
    i = at.astype(int)  # no place is negative
    if not len(i) or i[-1] < last:
        a, b = samples(i), samples(i + 1)
        return a + (b - a) * (at - i)
    a, b = samples(np.minimum(i, last)), samples(np.minimum(i + 1, last))
    return np.where(i > last, a[-1] if hold_last else 0.0, a + (b - a) * (at - i))


def silence_bounds(x: np.ndarray, rate: int, threshold_db: float) -> tuple[int, int]:
    """Start of the first and end of the last chunk of 10 ms that isn't silent; (-1, -1) if there is none.

    Decibels are taken of the mean square, as if it were an amplitude. The grid of the search
    from the end is anchored at the end.
    """
    chunk, level = max(1, rate // 100), db_to_linear(threshold_db)
    loud = lambda s: float(np.mean(np.square(s, dtype=np.float64))) >= level
    first = next((s for s in range(0, len(x), chunk) if loud(x[s : s + chunk])), -1)
    last = next((s + chunk - 1 for s in range(len(x) - chunk, -1, -chunk) if loud(x[s : s + chunk])), -1)
    return (first, last) if first >= 0 and last >= 0 else (-1, -1)


def trim(x: np.ndarray, rate: int, threshold_db: float, padding_ms: int) -> np.ndarray:
    pad = padding_ms * rate // 1000
    first, last = silence_bounds(x, rate, threshold_db)
    if first < 0:
        return np.zeros(min(pad, len(x)), x.dtype)
    return x[max(0, first - pad) : min(len(x) - 1, last + pad) + 1]


def normalize_volume(x: np.ndarray, c: PreprocessConfig) -> np.ndarray:
    if not len(x):
        return x
    level = float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if c.use_rms_normalization else float(np.abs(x).max())
    target = db_to_linear(c.target_rms_db if c.use_rms_normalization else c.target_peak_db)
    gain = db_to_linear(-20) if level < db_to_linear(c.noise_floor_db) else min(10.0, max(0.1, target / level))
    return np.clip(x * gain, -1, 1)


def prepare(x: np.ndarray, rate: int, c: PreprocessConfig) -> tuple[np.ndarray, int]:
    """Trim, then rate, then volume; a clip that fails in any step is returned as it came."""
    try:
        y = trim(x, rate, c.silence_threshold_db, c.preserve_padding_ms) if c.trim_silence else x
        if c.normalize_sample_rate:
            y, rate_now = resample(y, rate, c.target_sample_rate), c.target_sample_rate
        else:
            rate_now = rate
        return (normalize_volume(y, c) if c.normalize_volume else y), rate_now
    except (ValueError, IndexError, FloatingPointError):
        return x, rate


def doubles(duration: float, original: float, c: PreprocessConfig | None) -> bool:
    """Whether a short clip is doubled; clips cut short by trimming only if enough of them is left, or they were long."""
    if duration >= SHORT_SECONDS:
        return False
    if c is None or not c.disable_doubling_after_trim:
        return True
    return (original > 0 and duration / original >= c.doubling_ratio_threshold) or original >= c.min_duration_for_doubling


def to_int16(x: np.ndarray) -> np.ndarray:
    return np.trunc(np.clip(x, -1, 1) * 32767).astype(np.int16)


# columns
def decibels(x: Column) -> Column:
    return F.when(x <= 0, -100.0).otherwise(20 * F.log10(x))


def quantized(v: Column) -> Column:
    """Clamped to [-1, 1], times 32767, cut toward zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) * 32767).cast("int")


def gain(level: Column, target_db: float, noise_floor_db: float = -60.0) -> Column:
    quiet = level < db_to_linear(noise_floor_db)
    return F.when(quiet, F.lit(db_to_linear(-20))).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.lit(db_to_linear(target_db)) / level)))


def doubling(duration: Column, original: Column, ratio: float = 0.5, least: float = 1.5) -> Column:
    return F.when(duration >= SHORT_SECONDS, False).when((original > 0) & (duration / original >= ratio), True).otherwise(original >= least)
