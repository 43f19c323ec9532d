"""Audio files as rows: recursive scans, decoding of PCM WAV, and fingerprints of what was decoded."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FINGERPRINT_RATE, PreprocessConfig
from ..functions import signal
from ..runtime import numbered
from ..schemas import CLIP, FINGERPRINT

PROVIDERS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {}


def provider(name: str):
    def keep(f):
        PROVIDERS[name] = f
        return f

    return keep


def scan(spark: SparkSession, paths: str | list[str], extensions: tuple[str, ...] = (".wav",)) -> DataFrame:
    """(path, modificationTime, length, content) of files below the paths, of any of the extensions in either case."""
    wanted = [e.lower() for e in extensions]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*wanted))


def header(content: bytes) -> tuple[wave.Wave_read, int, int, int, int]:
    """(reader, sample width, rate, channels, frames) of a PCM WAV of 8, 16, 24 or 32 bits; ValueError for anything else. No sample is read."""
    try:
        w = wave.open(io.BytesIO(content))
    except (wave.Error, EOFError) as e:
        raise ValueError(f"not decodable: {e}") from None
    width, channels, rate, frames = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
    if width not in (1, 2, 3, 4):
        raise ValueError(f"{8 * width} bits")
    if frames * width * channels > len(content) or rate <= 0 or channels <= 0:
        raise ValueError("cut off")
    return w, width, rate, channels, frames


def _samples(raw: bytes, width: int) -> np.ndarray:
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width == 2:
        return np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 2**23
    return (np.frombuffer(raw, "<i4") / 2**31).astype(np.float32)


#: Bytes of samples decoded at a time.
CHUNK = 1 << 20


def decode(content: bytes, max_seconds: float | None = None, chunk: int = CHUNK) -> tuple[np.ndarray, int, int]:
    """(mono samples in [-1, 1), rate, channels of the file), decoded in chunks and no further than max_seconds.

    Each chunk holds whole frames and is mixed to mono at once, so the interleaved samples of a
    file are never held together.
    """
    w, width, rate, channels, frames = header(content)
    wanted = frames if max_seconds is None else min(frames, int(max_seconds * rate))
    out, at = np.empty(wanted, np.float32), 0
    step = max(1, chunk // (width * channels))
    while at < wanted:
        raw = w.readframes(min(step, wanted - at))
        n = len(raw) // (width * channels)
        if not n or len(raw) % (width * channels):
            raise ValueError("cut off")
        out[at : at + n] = signal.to_mono(_samples(raw, width), channels)
        at += n
    return out, rate, channels


def encode(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(signal.to_int16(samples).astype("<i2").tobytes())
    return out.getvalue()


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "array<bigint>": pa.list_(pa.int64())}


def _each(files: DataFrame, make: Callable[[str, bytes], dict], schema: str) -> DataFrame:
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8):  # decoded clips are large
                part = b.slice(at, 8)
                rows = [make(p, c) for p, c in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields], [n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, schema)


def clips(files: DataFrame, prepare: PreprocessConfig | None = None) -> DataFrame:
    """Clip rows, mixed to mono and prepared if asked; files that can't be decoded give a row with an error."""

    def make(path: str, content: bytes) -> dict:
        try:
            x, rate, _ = decode(content)
        except ValueError as e:
            return {"file_path": path, "error": str(e)}
        original = len(x) / rate
        if prepare is not None:
            x, rate = signal.prepare(x, rate, prepare)
        return {"file_path": path, "samples": x.astype(np.float32), "sample_rate": rate, "channels": 1, "frames": len(x), "duration": len(x) / rate, "original_duration": original}

    return _each(files, make, CLIP)


def metadata(files: DataFrame) -> DataFrame:
    """(file_path, sample_rate, channels, frames, duration, supported), from headers alone."""
    schema = "file_path string, sample_rate int, channels int, frames bigint, duration double, supported boolean"

    def make(path: str, content: bytes) -> dict:
        try:
            _, _, rate, channels, n = header(content)
        except ValueError:
            return {"file_path": path, "supported": False}
        return {"file_path": path, "sample_rate": rate, "channels": channels, "frames": n, "duration": n / rate, "supported": True}

    return _each(files, make, schema)


#: Samples of a frame of hk32 and from one frame to the next.
SIZE, HOP = 4096, 512
#: Frames transformed at a time.
FEW = 16


@cache
def window() -> np.ndarray:
    return np.hanning(SIZE)


@cache
def _edges(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, bin after the last) of the 33 bands."""
    bins = np.clip(np.round(np.geomspace(300, 2000, 34) * SIZE / rate).astype(int), 1, SIZE // 2)
    return bins[:-1], np.maximum(bins[1:], bins[:-1] + 1)


def frames_of(x: np.ndarray) -> np.ndarray:
    """The frames of at least SIZE samples, as a view."""
    x = np.ascontiguousarray(x)
    return np.ndarray(((len(x) - SIZE) // HOP + 1, SIZE), x.dtype, x, 0, (HOP * x.itemsize, x.itemsize))


def bands(frames: np.ndarray, rate: int) -> np.ndarray:
    """Energies of 33 bands in each frame of SIZE samples. A frame's don't depend on the others; bins above the bands are not added up."""
    first, after = _edges(rate)
    out, end, n = np.empty((len(frames), len(first))), int(after[-1]), min(len(frames), FEW)
    shaped, spectrum, power, total = np.empty((n, SIZE)), np.empty((n, SIZE // 2 + 1), complex), np.empty((n, end)), np.zeros((n, end + 1))
    for at in range(0, len(frames), FEW):  # in the same memory
        k = min(FEW, len(frames) - at)
        np.multiply(frames[at : at + k], window(), out=shaped[:k])
        np.fft.rfft(shaped[:k], axis=1, out=spectrum[:k])
        np.square(np.abs(spectrum[:k, :end], out=power[:k]), out=power[:k])
        np.cumsum(power[:k], axis=1, out=total[:k, 1:])
        out[at : at + k] = total[:k, after] - total[:k, first]
    return out


def signs(energies: np.ndarray) -> np.ndarray:
    """A word for each frame but the last: whether the next frame's differences of neighbouring bands are larger."""
    change = np.diff(energies[:, :-1] - energies[:, 1:], axis=0) > 0
    return np.packbits(change, axis=1, bitorder="little").view("<u4").ravel()


@provider("hk32")
def band_differences(x: np.ndarray, rate: int) -> np.ndarray:
    """32-bit sub-fingerprints from signs of differences of band energies in time and frequency (Haitsma and Kalker, 2002)."""
    if len(x) < SIZE + HOP:
        return np.empty(0, np.uint32)
    return signs(bands(frames_of(x), rate))


def fingerprints(files: DataFrame, algorithm: str = "hk32", prepare: PreprocessConfig | None = None, max_seconds: float | None = None, doubling: str = "none") -> DataFrame:
    """Fingerprint rows, ids by order of path; doubling: none, always (short clips) or smart. Errors give rows without words."""
    if max_seconds is not None and max_seconds <= 0:
        raise ValueError("max_seconds must be positive")
    make_words = PROVIDERS[algorithm]

    def make(path: str, content: bytes) -> dict:
        try:
            x, rate, _ = decode(content, max_seconds)
            original = len(x) / rate
            if prepare is not None:
                x, rate = signal.prepare(x, rate, prepare)
            x = signal.resample(x, rate, FINGERPRINT_RATE)
            seconds = len(x) / FINGERPRINT_RATE
            if (doubling == "always" and seconds < 3.0) or (doubling == "smart" and signal.doubles(seconds, original, prepare)):
                x = np.concatenate([x, x])
            words = make_words(x, FINGERPRINT_RATE)
            return {"file_path": path, "data": words.astype(np.int64), "sample_rate": FINGERPRINT_RATE, "duration": seconds, "error": None if len(words) else "too short"}
        except ValueError as e:
            return {"file_path": path, "error": str(e)}

    made = _each(files, make, FINGERPRINT.removeprefix("file_id bigint, "))
    # paths alone are put in order; fingerprints meet their numbers by path
    ids = numbered(files.select(F.col("path").alias("file_path")).distinct(), [F.col("file_path")], "file_id")
    return made.join(ids, "file_path").select("file_id", "file_path", "data", "sample_rate", "duration", "error")
