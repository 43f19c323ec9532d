"""Bit agreement of 32-bit words as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_MASK = 0xFFFF


def low16(word: Column) -> Column:
    return word.bitwiseAND(WORD_MASK).cast("int")


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def matching_bits(a: Column, b: Column) -> Column:
    return F.lit(32) - differing_bits(a, b)


def hash_overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)).otherwise(0.0)


def is_valid(data: Column, sample_rate: Column, duration: Column, most: int) -> Column:
    return (F.size(data) > 0) & (F.size(data) < most) & (sample_rate > 0) & (duration > 0)
