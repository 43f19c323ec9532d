"""Settings of the comparison and of signal preparation, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


def _within(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie between 0 and 1")


@dataclass(frozen=True)
class CompareConfig:
    similarity_threshold: float = 0.85
    bit_error_threshold: float = 0.15
    minimum_overlap: int = 10
    max_alignment_offset: int = 360
    alignment_step: int = 6
    hash_threshold: int = 5
    quick_factor: float = 0.6
    gauss_sigma: float = 2.0
    gauss_radius: int = 6
    peak_floor: float = 0.1
    fine_tune: int = 2
    window: int = 60
    hop: int = 30
    segment_factor: float = 0.8
    coverage_floor: float = 0.5
    min_segments: int = 3
    #: Options beyond the defaults: correlation only over enough words; segments kept without suppression.
    enforce_overlap: bool = False
    suppress: bool = True

    def __post_init__(self) -> None:
        _within("similarity_threshold", self.similarity_threshold)
        _within("bit_error_threshold", self.bit_error_threshold)
        if self.max_alignment_offset < 0 or self.alignment_step < 1:
            raise ValueError("offsets must not be negative and the step must be 1 or more")

    @property
    def quick_threshold(self) -> float:
        return self.quick_factor * self.similarity_threshold


@dataclass(frozen=True)
class PreprocessConfig:
    trim_silence: bool = True
    silence_threshold_db: float = -55.0
    preserve_padding_ms: int = 100
    normalize_sample_rate: bool = True
    target_sample_rate: int = 44100
    normalize_volume: bool = True
    target_peak_db: float = -3.0
    use_rms_normalization: bool = True
    target_rms_db: float = -20.0
    noise_floor_db: float = -60.0
    disable_doubling_after_trim: bool = True
    doubling_ratio_threshold: float = 0.5
    min_duration_for_doubling: float = 1.5

    @classmethod
    def from_dict(cls, given: dict) -> PreprocessConfig:
        """Missing keys keep their defaults; keys that are no setting are passed over."""
        return cls(**{k: v for k, v in given.items() if k in {f.name for f in fields(cls)}})


def silence_handling(**overrides) -> PreprocessConfig:
    return replace(PreprocessConfig(), **overrides)


#: Fingerprints count as valid with at least one and fewer than so many words.
MOST_WORDS = 100_000
#: Clips under so many seconds are doubled.
SHORT_SECONDS = 3.0
FINGERPRINT_RATE = 11025
