"""The ledger of an aggregator: what was taken in, by batch, interval, bucket and tenant, and what of it was handed on.

Entries are appended, each lot as one file, so a lot is there whole or not at all. What is held and not done is open; a
batch without entries was never taken in. `compact` writes the open entries as a new version and drops the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import Folder

ENTRY = "batch string, interval_s int, bucket_s long, cm_id string, events double, done boolean"
#: Where an entry belongs.
PLACE = ["batch", "interval_s", "bucket_s"]
MOST_FILES = 64


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Folder(spark, folder)
        whole = [int(p.rsplit("v=", 1)[1].split("/")[0]) for p in self.files.matching("v=*/whole")]
        self.version = max(whole, default=0)
        for p in self.files.matching("v=*"):
            if int(p.rsplit("v=", 1)[1]) != self.version:  # left by a compaction that was cut off
                self.files.remove(p)
        self.files.make(f"v={self.version}/entries", f"v={self.version}/whole")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/v={self.version}/entries")

    def append(self, entries: DataFrame) -> None:
        names = [part.split()[0] for part in ENTRY.split(", ")]
        entries.select(*names).coalesce(1).write.mode("append").parquet(f"{self.folder}/v={self.version}/entries")

    def open(self) -> DataFrame:
        """batch, interval_s, bucket_s, cm_id, events of what was taken in and not handed on."""
        entries = self.entries()
        return entries.filter("not done").join(entries.filter("done").select(*PLACE).distinct(), PLACE, "left_anti").drop("done")

    def places(self, condition: Column) -> list[tuple[str, int, int]]:
        """Batches, intervals and buckets that are open; compaction of batches bounds their number."""
        return [tuple(r) for r in self.open().filter(condition).select(*PLACE).distinct().collect()]

    def done(self, places: list[tuple[str, int, int]]) -> DataFrame:
        """Entries that close some places."""
        return self.spark.createDataFrame([(*p, None, None, True) for p in places], ENTRY)

    def compact(self) -> None:
        """Keeps the open entries only, once there are many files."""
        if len(self.files.matching(f"v={self.version}/entries/part-*")) < MOST_FILES:
            return
        old, new = self.version, self.version + 1
        self.open().withColumn("done", F.lit(False)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/v={new}/entries")
        self.files.make(f"v={new}/whole")  # from now on it counts
        self.version = new
        self.files.remove(f"{self.folder}/v={old}")
