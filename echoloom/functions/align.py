"""Comparison of two fingerprints (numpy), as sequences of 32-bit words at an unknown offset."""

from __future__ import annotations

from dataclasses import replace
from functools import cache

import numpy as np

from ..config import CompareConfig

Words = np.ndarray


def similarity_at(a: Words, b: Words, offset: int) -> tuple[float, float, int]:
    """(similarity, bit error rate, words that overlap) where a[i] meets b[i + offset]."""
    start, end = max(0, -offset), min(len(a), len(b) - offset)
    n = end - start
    if n <= 0:
        return 0.0, 1.0, 0
    wrong = int(np.bitwise_count(a[start:end] ^ b[start + offset : end + offset]).sum())
    return (32 * n - wrong) / (32 * n), wrong / (32 * n), n


def similarities(a: Words, b: Words, offsets: range) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, words that overlap) at each offset, as ``similarity_at`` gives them; similarity 0 without overlap.

    b is laid into zeros, so that a meets it whole at every offset; what a's words then differ from zeros is taken off.
    """
    off = np.arange(offsets.start, offsets.stop, offsets.step)
    start = np.clip(-off, 0, len(a))
    end = np.clip(len(b) - off, start, len(a))
    n = end - start
    before = max(0, -int(off[0]))
    laid = np.zeros(before + max(len(b), len(a) + int(off[-1])), np.uint32)
    laid[before : before + len(b)] = b
    bits = np.concatenate(([0], np.cumsum(np.bitwise_count(a), dtype=np.int64)))
    wrong = bits[end] - bits[start] - bits[-1]
    for at in range(0, len(a), 8192):
        part = a[at : at + 8192]
        met = np.lib.stride_tricks.sliding_window_view(laid[at : len(laid) - len(a) + at + len(part)], len(part))[before + off]
        wrong += np.bitwise_count(met ^ part).sum(1, dtype=np.int64)
    return np.where(n > 0, (32 * n - wrong) / np.maximum(32 * n, 1), 0.0), n


def overlap(a: Words, b: Words) -> float:
    x, y = np.unique(a & 0xFFFF), np.unique(b & 0xFFFF)
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def offset_histogram(a: Words, b: Words, most: int) -> np.ndarray:
    """Pairs of positions with equal low 16 bits, counted by offset from -most to most."""
    out = np.zeros(2 * most + 1, np.int64)
    order = np.argsort(b & 0xFFFF, kind="stable")
    keys = (b & 0xFFFF)[order]
    lo, hi = np.searchsorted(keys, a & 0xFFFF, "left"), np.searchsorted(keys, a & 0xFFFF, "right")
    for at in range(0, len(a), 4096):
        n = (hi - lo)[at : at + 4096]
        i = np.repeat(np.arange(at, at + len(n)), n)
        j = order[np.repeat(lo[at : at + 4096], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        off = j - i
        out += np.bincount(off[np.abs(off) <= most] + most, minlength=len(out))
    return out


@cache
def _kernel(length: int, sigma: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return kernel, np.convolve(np.ones(length), kernel)[radius : radius + length]


def smoothed(h: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    kernel, weights = _kernel(len(h), sigma, radius)
    return np.convolve(h, kernel)[radius : radius + len(h)] / weights


def histogram_offset(a: Words, b: Words, c: CompareConfig) -> int:
    f = smoothed(offset_histogram(a, b, c.max_alignment_offset), c.gauss_sigma, c.gauss_radius)
    peak = np.flatnonzero((f[1:-1] > f[:-2]) & (f[1:-1] > f[2:]) & (f[1:-1] > c.peak_floor)) + 1
    return int(peak[np.argmax(f[peak])]) - c.max_alignment_offset if len(peak) else 0


def steps(c: CompareConfig) -> range:
    return range(-c.max_alignment_offset, c.max_alignment_offset + 1, c.alignment_step)


def correlation_offset(a: Words, b: Words, c: CompareConfig) -> int:
    s, n = similarities(a, b, steps(c))
    if c.enforce_overlap:
        s = np.where(n >= c.minimum_overlap, s, 0.0)
    k = int(np.argmax(s))  # the first of equals
    return steps(c)[k] if s[k] > 0 else 0


def best_offset(a: Words, b: Words, c: CompareConfig) -> int:
    h, k = histogram_offset(a, b, c), correlation_offset(a, b, c)
    sh, sk = similarity_at(a, b, h)[0], similarity_at(a, b, k)[0]
    best, score = (h, sh) if sh >= sk else (k, sk)
    off, most = max(-c.max_alignment_offset, best - c.fine_tune), c.max_alignment_offset
    while off <= min(most, best + c.fine_tune):  # the end moves along with a better offset
        if (s := similarity_at(a, b, off)[0]) > score:
            best, score = off, s
        off += 1
    return best


NOTHING = (0.0, 0, 0, 1.0, False, 0.0)


def passes_quick(a: Words, b: Words, c: CompareConfig) -> bool:
    return min(len(a), len(b)) >= c.minimum_overlap and overlap(a, b) >= c.quick_threshold


def compare(a: Words, b: Words, c: CompareConfig) -> tuple[float, int, int, float, bool, float]:
    """(similarity, offset, matched words, bit error rate, duplicate, coverage)."""
    if not passes_quick(a, b, c):
        return NOTHING
    off = best_offset(a, b, c)
    s, ber, n = similarity_at(a, b, off)
    return s, off, n, ber, s >= c.similarity_threshold and ber <= c.bit_error_threshold and n >= c.minimum_overlap, 0.0


@cache
def _at(c: CompareConfig, thresholds: tuple[float, ...]) -> list[CompareConfig]:
    return [replace(c, similarity_threshold=t) for t in thresholds]


def compare_at(a: Words, b: Words, c: CompareConfig, thresholds: tuple[float, ...]) -> list[tuple[float, int, int, float, bool, float]]:
    """``compare`` at each similarity threshold. The overlap and the offset don't depend on it, so they are found once."""
    each = _at(c, thresholds)
    both = overlap(a, b) if min(len(a), len(b)) >= c.minimum_overlap else None
    passed = [both is not None and both >= e.quick_threshold for e in each]
    if not any(passed):
        return [NOTHING] * len(each)
    off = best_offset(a, b, c)
    s, ber, n = similarity_at(a, b, off)
    return [(s, off, n, ber, s >= e.similarity_threshold and ber <= c.bit_error_threshold and n >= c.minimum_overlap, 0.0) if ok else NOTHING for ok, e in zip(passed, each, strict=True)]


def segments(a: Words, b: Words, c: CompareConfig) -> list[tuple[int, float]]:
    """(offset, similarity) of windows of a at their best place in b; of offsets within a hop the best stays."""
    found = []
    starts = np.arange(0, len(b) - c.window + 1, c.alignment_step)
    if not len(starts):
        return []
    windows = np.lib.stride_tricks.sliding_window_view(b, c.window)[starts]
    for i in range(0, len(a) - c.window + 1, c.hop):
        wrong = np.bitwise_count(windows ^ a[i : i + c.window]).sum(1, dtype=np.int64)
        k = int(np.argmin(wrong))
        s = (32 * c.window - int(wrong[k])) / (32 * c.window)
        if s >= c.segment_factor * c.similarity_threshold:
            found.append((int(starts[k]) - i, s))
    found.sort(key=lambda x: (-x[1], x[0]))
    if not c.suppress:
        return found
    kept: list[tuple[int, float]] = []
    for off, s in found:
        if all(abs(off - o) > c.hop for o, _ in kept):
            kept.append((off, s))
    return kept


def compare_sliding(a: Words, b: Words, c: CompareConfig) -> tuple[float, int, int, float, bool, float, list[tuple[int, float]]]:
    if not passes_quick(a, b, c) or not (found := segments(a, b, c)):
        return (*NOTHING, [])
    total = sum(s for _, s in found)
    score, off, longest = sum(s * s for _, s in found) / total, found[0][0], max(len(a), len(b))
    coverage = min(c.window * len(found), longest) / longest
    ber = similarity_at(a, b, off)[1]
    ok = score >= c.similarity_threshold and ber <= c.bit_error_threshold and coverage >= c.coverage_floor and len(found) >= c.min_segments
    return score, off, len(found), ber, ok, coverage, found
