"""Partial aggregates as long tables, and their merge.

`groups[metricset]` has a row for each group and histogram bucket (null: a duration that no bucket takes), so merging
is a union and one aggregation with map-side combination; it is associative, and partials written by one cluster
can be read and merged by another. `first` is the arrival order (seq x ORDER + pos) of a group's first observation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import COMBINED, GROUP, HISTOGRAM, ORDER, SERVICE, SUMS
from .metricsets import BRANCHES, fanned_out, presences

OVERFLOW = (*COMBINED, *SERVICE)


@dataclass
class Partials:
    """groups and overflow: by metricset; services: (combined, service, first); totals: (combined, events_total, youngest).

    overflow rows belong to a service, or to the whole combined key where the service columns are null. They and
    service_overflow carry a sketch of the keys they stand for.
    """

    groups: dict[str, DataFrame]
    services: DataFrame
    totals: DataFrame
    overflow: dict[str, DataFrame] | None = None
    service_overflow: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        out = {f"groups_{m}": d for m, d in self.groups.items()} | {"services": self.services, "totals": self.totals}
        if self.overflow is not None:
            out |= {f"overflow_{m}": d for m, d in self.overflow.items()} | {"service_overflow": self.service_overflow}
        return out

    def save(self, folder: str, mode: str = "overwrite", by: tuple[str, ...] = ("interval_s", "processing_time")) -> None:
        """Parquet tables, divided by interval and processing time, so that a harvest reads its own range only."""
        for name, table in self.tables().items():
            table.write.mode(mode).partitionBy(*by).parquet(f"{folder}/{name}")

    def settled(self, spark: SparkSession, folder: str, distinct=None) -> Partials:
        """The same partials, written and read back: what follows reads groups, not events, as often as it likes."""
        self.save(folder, by=())
        return Partials.load(spark, folder, self.overflow is not None, distinct)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, overflowed: bool = False, distinct=None, *more: str) -> Partials:
        """Saved tables; `more`: text columns that they are divided by besides."""
        kinds = _kinds(overflowed, distinct)

        def read(name):  # a table without rows has no files to tell its schema
            return spark.read.schema(reduce(lambda kind, c: kind.add(c, "string"), more, StructType.fromDDL(kinds[name]))).parquet(f"{folder}/{name}")

        groups = {m: read(f"groups_{m}") for m in GROUP}
        if not overflowed:
            return cls(groups, read("services"), read("totals"))
        return cls(groups, read("services"), read("totals"), {m: read(f"overflow_{m}") for m in GROUP}, read("service_overflow"))

    def filter(self, condition) -> Partials:
        """Rows of combined keys that meet a condition on the combined columns."""
        def cut(tables):
            return None if tables is None else {k: v.filter(condition) for k, v in tables.items()}

        return Partials(cut(self.groups), self.services.filter(condition), self.totals.filter(condition), cut(self.overflow), None if self.service_overflow is None else self.service_overflow.filter(condition))

    def without_partition(self) -> Partials:
        """The same partials with partitions merged into one combined key."""
        one = lambda d: None if d is None else d.withColumn("partition_id", F.lit(0))
        return merge([Partials({m: one(d) for m, d in self.groups.items()}, one(self.services), one(self.totals), None if self.overflow is None else {m: one(d) for m, d in self.overflow.items()}, one(self.service_overflow))])


def _kinds(overflowed: bool, distinct) -> dict[str, str]:
    """Columns of the saved tables, by name."""
    from .rows import columns  # which needs this module

    from .limits import Distinct

    kinds = columns(distinct or Distinct())
    own = lambda names: ", ".join(f"{c} {kinds[c]}" for c in names)
    hist = {m: ["bucket", "scaled"] if m in HISTOGRAM else [] for m in GROUP}
    out = {f"groups_{m}": own([*COMBINED, *SERVICE, *GROUP[m], *hist[m], *SUMS[m], "first"]) for m in GROUP}
    out |= {"services": own([*COMBINED, *SERVICE, "first"]), "totals": own(COMBINED) + ", events_total double, youngest timestamp"}
    if overflowed:
        out |= {f"overflow_{m}": own([*COMBINED, *SERVICE, *hist[m], *SUMS[m], "sketch"]) for m in GROUP} | {"service_overflow": own([*COMBINED, "sketch"])}
    return out


def _sums(metricset: str, first) -> list:
    hist = [F.sum("scaled").alias("scaled")] if metricset in HISTOGRAM else []
    return [*hist, *[F.sum(c).alias(c) for c in SUMS[metricset]], F.min(first).alias("first")]


def group_columns(metricset: str) -> list[str]:
    return [*COMBINED, *SERVICE, *GROUP[metricset], *(["bucket"] if metricset in HISTOGRAM else [])]


def aggregate(events: DataFrame, intervals: list[int], partitions: int = 1) -> Partials:
    """Partials of raw events."""
    fanned = fanned_out(events, intervals)
    order = F.col("seq") * ORDER + F.col("pos")
    groups = {m: branch(fanned, partitions).groupBy(*group_columns(m)).agg(*_sums(m, order)) for m, branch in BRANCHES.items()}
    seen = presences(fanned, partitions)
    services = seen.groupBy(*COMBINED, *SERVICE).agg(F.min(order).alias("first"))
    totals = seen.groupBy(*COMBINED).agg(F.sum("share").alias("events_total"), F.max("received").alias("youngest"))
    return Partials(groups, services, totals)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def merge(parts: list[Partials]) -> Partials:
    """One partial of many; overflow rows are kept side by side, the next admission folds them."""
    groups = {m: union_all([p.groups[m] for p in parts]).groupBy(*group_columns(m)).agg(*_sums(m, F.col("first"))) for m in GROUP}
    services = union_all([p.services for p in parts]).groupBy(*COMBINED, *SERVICE).agg(F.min("first").alias("first"))
    totals = union_all([p.totals for p in parts]).groupBy(*COMBINED).agg(F.sum("events_total").alias("events_total"), F.max("youngest").alias("youngest"))
    over = [p for p in parts if p.overflow is not None]
    overflow = {m: union_all([p.overflow[m] for p in over]) for m in GROUP} if over else None
    return Partials(groups, services, totals, overflow, union_all([p.service_overflow for p in over]) if over else None)
