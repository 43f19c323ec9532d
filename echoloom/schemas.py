"""Schemas of the tables that operators exchange. Unsigned 32-bit words are held as BIGINT."""

FINGERPRINT = "file_id bigint, file_path string, data array<bigint>, sample_rate int, duration double, error string"
CLIP = "file_path string, samples array<float>, sample_rate int, channels int, frames bigint, duration double, original_duration double, error string"
MATCH = "a bigint, b bigint, similarity_score double, best_offset int, matched_segments bigint, bit_error_rate double, is_duplicate boolean, coverage_ratio double"
SEGMENT_MATCH = MATCH + ", segment_matches array<struct<offset:int,similarity:double>>"
