"""Combined keys as sortable bytes: 2 of the interval's seconds, 8 of the bucket's, 16 of the tenant, 2 of the partition, all big-endian.

Bytes sort by interval, bucket, tenant and partition in that order. A tenant's id has its UTF-8 bytes, filled up with zeros; one of
over 16 bytes or with a zero at its end, and a number that does not fit, have no key (null), rather than another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BYTES, ID_BYTES = 28, 16


def _fixed(number: Column, size: int) -> Column:
    """A number that is not negative, as hex digits."""
    return F.lpad(F.hex(number), 2 * size, "0")


def encoded(interval_s: Column | str = "interval_s", processing_time: Column | str = "processing_time", cm_id: Column | str = "cm_id", partition_id: Column | str = "partition_id") -> Column:
    """The key of the combined columns, as binary."""
    interval_s, processing_time, cm_id, partition_id = (F.col(c) if isinstance(c, str) else c for c in (interval_s, processing_time, cm_id, partition_id))
    seconds, name = F.unix_seconds(processing_time), cm_id.cast("binary")
    fits = interval_s.between(0, 0xFFFF) & partition_id.between(0, 0xFFFF) & (seconds >= 0) & (F.octet_length(name) <= ID_BYTES) & ~cm_id.endswith("\x00")
    digits = F.concat(_fixed(interval_s, 2), _fixed(seconds, 8), F.rpad(F.hex(name), 2 * ID_BYTES, "0"), _fixed(partition_id, 2))
    return F.when(fits, F.unhex(digits))


def without_partition(key: Column) -> Column:
    """The key with partition 0: equal for all partitions of a tenant's bucket."""
    return F.concat(F.substring(key, 1, KEY_BYTES - 2), F.lit(b"\x00\x00"))


def decoded(key: Column) -> dict[str, Column]:
    """The combined columns of a key."""
    def number(start: int, size: int) -> Column:
        return F.conv(F.hex(F.substring(key, start, size)), 16, 10).cast("bigint")

    name = F.unhex(F.regexp_replace(F.hex(F.substring(key, 11, ID_BYTES)), "(00)+$", ""))
    return {"interval_s": number(1, 2).cast("int"), "processing_time": F.timestamp_seconds(number(3, 8)), "cm_id": name.cast("string"), "partition_id": number(27, 2).cast("int")}


def in_key_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of the combined columns dealt and sorted by their key, so files hold ranges of keys, in order."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_key", encoded()).repartitionByRange(n, "_key").sortWithinPartitions("_key").drop("_key")
