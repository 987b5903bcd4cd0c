"""Sortable keys against Python's struct."""

import random
import struct
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from spanfold.functions import keys as q

SCHEMA = "interval_s int, processing_time timestamp, cm_id string, partition_id int"


def plain(interval_s, at, cm_id, partition_id):
    return struct.pack(">HQ16sH", interval_s, int(at.replace(tzinfo=timezone.utc).timestamp()), cm_id.encode(), partition_id)


def some(rng, n):
    names = ["", "a", "ab01", "é", "x" * 16, "a b", "日本"]
    return [(rng.choice([1, 60, 600, 3600, 64800, 65535]), datetime(1970, 1, 1) + timedelta(seconds=rng.choice([0, 1, 1 << 31, 1 << 33, rng.randrange(1 << 34)])), rng.choice(names), rng.choice([0, 1, 255, 256, 65535])) for _ in range(n)]


def test_keys_equal_the_fixed_form_and_come_back(spark):
    rows = some(random.Random(1), 500)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("key", q.encoded())
    got = frame.select("*", q.without_partition(F.col("key")).alias("whole"), *[c.alias(f"own_{n}") for n, c in q.decoded(F.col("key")).items()]).collect()
    for r in got:
        want = plain(*r[:4])
        assert bytes(r.key) == want and len(want) == q.KEY_BYTES
        assert bytes(r.whole) == plain(*r[:3], 0) and tuple(r[6:]) == tuple(r[:4])


def test_order(spark):
    """Bytes sort as the columns do: time before tenant before partition; files hold ranges."""
    rows = some(random.Random(2), 800)
    frame = spark.createDataFrame(rows, SCHEMA)
    ordered = [tuple(r) for r in q.in_key_order(frame, 3).collect()]
    assert ordered == sorted(rows, key=lambda r: (r[0], r[1], r[2].encode().ljust(16, b"\0"), r[3]))
    assert [bytes(r.k) for r in frame.select(q.encoded().alias("k")).orderBy("k").collect()] == sorted(plain(*r) for r in rows)


def test_what_does_not_fit_has_no_key(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, at, "x" * 17, 0), (70000, at, "a", 0), (1, at, "a", -1), (1, datetime(1969, 1, 1), "a", 0), (1, at, None, 0), (None, at, "a", 0), (1, at, "a\x00", 0)]
    assert [r.k for r in spark.createDataFrame(rows, SCHEMA).select(q.encoded().alias("k")).collect()] == [None] * len(rows)
