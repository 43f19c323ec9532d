"""Robustness: recordings are changed, fingerprinted and compared with what they were; detection rates by category and threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FINGERPRINT_RATE, CompareConfig
from ..functions import align, modify, signal
from ..sources import audio


Changed = Iterator[tuple[str, float, np.ndarray]]


def _changed(x: np.ndarray, rate: int, words_of: Callable[[np.ndarray, int], np.ndarray]) -> Changed:
    """(category, value, words) of a clip, unchanged first, and of its changes."""
    for category, value, y, r in modify.sweep(x, rate):
        yield category, value, words_of(signal.resample(y, r, FINGERPRINT_RATE), FINGERPRINT_RATE).astype(np.uint32)


def _hk32(x: np.ndarray) -> Changed:
    """The same words as ``_changed`` for hk32 and a clip at its rate, with every frame transformed once that changes have in common.

    Frames beside a silence are those of the clip at other places, and frames of silence have no energy. To twice or four times
    the rate and back gives the same samples, and volumes of powers of two scale all energies alike; for other volumes see ``_Louder``.
    """
    clip, rate, peak = _Frames(x), FINGERPRINT_RATE, float(np.abs(x).max(initial=0))
    base = clip.words(0, 0)
    yield "original", 1.0, base
    louder = None
    for category, values in modify.GRID.items():
        for value in map(float, values):
            if category.startswith("silence"):
                words = clip.words(*modify.silence(len(x), rate, category, value))
            elif category == "sample_rate" and value in (2 * rate, 4 * rate) or category.startswith("volume") and np.frexp(value)[0] == 0.5 and peak * value <= 1:
                words = base
            elif category == "sample_rate":
                words = audio.band_differences(signal.there_and_back(x, rate, int(value)), rate)
            else:
                y, r = modify.modified(x, rate, category, value)
                if category.startswith("volume") and peak * value <= 1 and len(base):
                    louder = louder or _Louder(x, clip.energies(0, 0), base)
                    words = louder.words(y)
                else:
                    words = audio.band_differences(signal.resample(y, r, rate), rate)
            yield category, value, words


class _Frames:
    """Band energies of a clip's frames with silence put in, each different frame once."""

    def __init__(self, x: np.ndarray):
        self.x, self.known = x, {None: np.zeros(33)}

    def energies(self, at: int, gap: int) -> np.ndarray:
        keys = [self._key(s, at, gap) for s in range(0, len(self.x) + gap - audio.SIZE + 1, audio.HOP)]
        if new := [k for k in dict.fromkeys(keys) if k not in self.known]:
            frames = np.zeros((len(new), audio.SIZE), self.x.dtype)
            for f, parts in zip(frames, new, strict=True):
                for to, begin, end in parts:
                    f[to : to + end - begin] = self.x[begin:end]
            self.known |= zip(new, audio.bands(frames, FINGERPRINT_RATE), strict=True)
        return np.array([self.known[k] for k in keys])

    def words(self, at: int, gap: int) -> np.ndarray:
        return audio.signs(self.energies(at, gap)) if len(self.x) + gap >= audio.SIZE + audio.HOP else np.empty(0, np.uint32)

    @staticmethod
    def _key(s: int, at: int, gap: int) -> tuple[tuple[int, int, int], ...] | None:
        """What the frame from s on holds of the clip: (place in the frame, begin, end) of at most two runs; None for silence."""
        end = s + audio.SIZE
        if end <= at:
            return ((0, s, end),)
        if s >= at + gap:
            return ((0, s - gap, end - gap),)
        before, after = [(0, s, at)] * (s < at), [(at + gap - s, at, end - gap)] * (end > at + gap)
        return (*before, *after) or None


class _Louder:
    """Words of a clip at other volumes. Samples are rounded to 24 bits, which moves a band's energy by no more than a bound; where a
    difference of energies is above it, its sign is that of the clip, and the other frames are transformed."""

    def __init__(self, x: np.ndarray, energies: np.ndarray, words: np.ndarray):
        self.base = words
        frames = audio.frames_of(x)
        whole = np.square(frames * audio.window()).sum(1, keepdims=True) * audio.SIZE / 2  # energy of all bins
        noise = 1.01 * 2.0**-48 * whole
        moved = 2 * np.sqrt(energies * noise) + noise + 1e-12 * whole  # the last for sums in 64 bits
        moved = moved[:, :-1] + moved[:, 1:]
        change = np.abs(np.diff(energies[:, :-1] - energies[:, 1:], axis=0))
        self.open = np.flatnonzero((change <= moved[:-1] + moved[1:]).any(1))
        self.frames = np.unique([self.open, self.open + 1])

    def words(self, y: np.ndarray) -> np.ndarray:
        if not len(self.open):
            return self.base
        found = np.zeros((len(self.base) + 1, 33))
        found[self.frames] = audio.bands(audio.frames_of(y)[self.frames], FINGERPRINT_RATE)
        out = self.base.copy()
        out[self.open] = audio.signs(found)[self.open]
        return out


def comparisons(files: DataFrame, thresholds: tuple[float, ...] = modify.THRESHOLDS, algorithm: str = "hk32", c: CompareConfig = CompareConfig()) -> DataFrame:  # noqa: B008
    """(file_path, category, value, threshold, similarity, detected): each file against each change of it, at each similarity threshold.

    files: path, content. A clip and its changes meet where the clip is decoded, so nothing is
    shuffled. A threshold also sets the quick filter, as in a scan at that threshold. Files that
    can't be decoded give no rows.
    """
    words_of = audio.PROVIDERS[algorithm]
    names = ["file_path", "category", "value", "threshold", "similarity", "detected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    x, rate, _ = audio.decode(content)
                except ValueError:
                    continue
                base, rows, known = None, [], {}
                for category, value, words in _hk32(x) if algorithm == "hk32" and rate == FINGERPRINT_RATE else _changed(x, rate, words_of):
                    base = words if base is None else base
                    key = words.tobytes()
                    if key not in known:
                        known[key] = [(t, got[0], bool(got[4])) for t, got in zip(thresholds, align.compare_at(base, words, c, thresholds), strict=True)]
                    rows += [(path, category, value, *got) for got in known[key]]
                yield pa.RecordBatch.from_arrays([pa.array(col) for col in zip(*rows, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "file_path string, category string, value double, threshold double, similarity double, detected boolean")


def detection(pairs: DataFrame) -> DataFrame:
    """(category, threshold, total, detected, rate) of expected pairs: category, threshold, detected."""
    hit = F.col("detected").cast("int")
    return pairs.groupBy("category", "threshold").agg(F.count("*").alias("total"), F.sum(hit).cast("bigint").alias("detected"), (F.avg(hit) * 100).alias("rate"))


def by_category(rates: DataFrame) -> DataFrame:
    """(category, max_rate, min_rate, avg_rate, best_threshold): the highest threshold of the best rate."""
    best = F.max(F.struct("rate", "threshold"))
    return rates.groupBy("category").agg(F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate"), F.avg("rate").alias("avg_rate"), best.alias("b")).select("category", "max_rate", "min_rate", "avg_rate", F.col("b.threshold").alias("best_threshold"))


def bucket(rate):
    return F.when(rate >= 90, "excellent").when(rate >= 70, "good").when(rate >= 50, "moderate").when(rate >= 20, "poor").otherwise("very poor")


def trend(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares slope of y by x in each group."""
    return points.groupBy(group).agg(F.regr_slope(y, x).alias("slope"))
