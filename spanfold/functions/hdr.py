"""High-dynamic-range histogram buckets as integer arithmetic: two significant digits, values in microseconds.

A bucket holds 2^k consecutive values with k = max(0, bit length - 8); 256 values fill the first pair of
buckets, 128 each later one. Only buckets below COUNTS_LEN exist (values below 2^32).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUB_BUCKETS, HALF, MAGNITUDE, COUNTS_LEN, COUNT_SCALE = 256, 128, 7, 3328, 1000


def bit_length(value: Column) -> Column:
    """Bits of a positive long, without text: the exponent of its double, corrected by one comparison."""
    power = F.floor(F.log2(value.cast("double"))).cast("int")
    power = F.when(F.call_function("shiftleft", F.lit(1).cast("long"), power) > value, power - 1).otherwise(power)
    return F.when(F.call_function("shiftleft", F.lit(1).cast("long"), power + 1) <= value, power + 2).otherwise(power + 1)


def bucket_index(micros: Column) -> Column:
    """Index of the bucket of a value; null where no bucket takes it (negative, or 2^32 and more)."""
    shift = bit_length(micros.bitwiseOR(F.lit(SUB_BUCKETS - 1))) - 8
    index = F.call_function("shiftleft", shift + 1, F.lit(MAGNITUDE)) + F.call_function("shiftright", micros, shift) - HALF
    return F.when((micros >= 0) & (micros < (1 << 32)), index.cast("int"))


def highest_equivalent(index: Column) -> Column:
    """The largest value of a bucket."""
    shift = (F.floor(index / HALF) - 1).cast("int")
    sub = (index % HALF + HALF + 1).cast("long")
    return F.when(index < SUB_BUCKETS, index.cast("long")).otherwise(F.call_function("shiftleft", sub, shift) - 1)


def scaled_count(weight: Column) -> Column:
    """Counts are kept in thousandths."""
    return F.round(weight * F.lit(float(COUNT_SCALE))).cast("long")
