"""Changes that recordings undergo (numpy): silence, volume, rate and speed. They define the robustness sweep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .signal import resample

#: Fixed values of the sweep: parameters of each category.
GRID: dict[str, tuple[float, ...]] = {
    "silence_start": (0.5, 1.0, 2.0, 5.0),
    "silence_end": (0.5, 1.0, 2.0, 5.0),
    "silence_middle": (0.1, 0.5, 1.0),
    "volume_increase": (1.1, 1.2, 1.5, 2.0),
    "volume_decrease": (0.9, 0.8, 0.5, 0.25),
    "sample_rate": (22050, 44100, 48000, 96000),
    "speed_faster": (1.01, 1.02, 1.05, 1.1),
    "speed_slower": (0.99, 0.98, 0.95, 0.9),
}
#: Similarity thresholds that the sweep tries.
THRESHOLDS = (0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60)


def silence(n: int, rate: int, category: str, value: float) -> tuple[int, int]:
    """(place, length) in samples of the silence put into a clip of n samples."""
    return {"silence_start": 0, "silence_end": n, "silence_middle": n // 2}[category], int(value * rate)


def modified(x: np.ndarray, rate: int, category: str, value: float) -> tuple[np.ndarray, int]:
    """(samples, rate) of a mono clip after one change. Speed changes length and pitch; a rate change keeps both."""
    if category.startswith("silence"):
        at, gap = silence(len(x), rate, category, value)
        return np.concatenate([x[:at], np.zeros(gap, x.dtype), x[at:]]), rate
    if category.startswith("volume"):
        return np.clip(x * value, -1, 1), rate
    if category == "sample_rate":
        return resample(x, rate, int(value)), int(value)
    if category.startswith("speed"):
        return resample(x, round(rate * value), rate), rate
    raise ValueError(f"no such change: {category}")


def sweep(x: np.ndarray, rate: int) -> Iterator[tuple[str, float, np.ndarray, int]]:
    """(category, value, samples, rate) of every change of the grid; the unchanged clip comes first, as ``original`` with value 1."""
    yield "original", 1.0, x, rate
    for category, values in GRID.items():
        for value in values:
            yield category, float(value), *modified(x, rate, category, value)
