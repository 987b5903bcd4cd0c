import random

from pyspark.sql import functions as F

from spanfold.functions import hdr


def serial(v):
    """(index, highest value of the bucket) by the definition: halve until 8 bits are left."""
    shift = 0
    while v >> shift >= 256:
        shift += 1
    sub = v >> shift
    index = sub if shift == 0 else 256 + (shift - 1) * 128 + sub - 128
    return index, ((sub + 1) << shift) - 1


def test_spots_and_random_values(spark):
    rng = random.Random(1)
    values = [0, 1, 255, 256, 100000, 1000000, 60000000, 3600000000, 2**32 - 1, *[rng.randrange(2**32) for _ in range(3000)], *[2**k + d for k in range(1, 32) for d in (-1, 0, 1)]]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", hdr.bucket_index(F.col("v")).alias("i")).select("v", "i", hdr.highest_equivalent(F.col("i")).alias("h")).collect()
    for r in rows:
        assert (r.i, r.h) == serial(r.v)
    spots = {r.v: (r.i, r.h) for r in rows}
    assert spots[100000] == (1347, 100351) and spots[256] == (256, 257) and spots[2**32 - 1] == (3327, 2**32 - 1)


def test_rejected(spark):
    rows = spark.createDataFrame([(2**32,), (-1,), (None,)], "v long").select(hdr.bucket_index(F.col("v")).alias("i")).collect()
    assert [r.i for r in rows] == [None] * 3
