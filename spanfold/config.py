"""Limits and settings of an aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame

from .sources.readers import console


#: A limit that is none.
UNLIMITED = 1 << 62


@dataclass(frozen=True)
class Limits:
    """Most services, and most groups of each metricset in total and per service, within one combined key."""

    max_services: int
    max_transaction_groups: int
    max_transaction_groups_per_service: int
    max_service_transaction_groups: int
    max_service_transaction_groups_per_service: int
    max_span_groups: int
    max_span_groups_per_service: int

    @classmethod
    def same(cls, n: int) -> Limits:
        return cls(*[n] * 7)

    @property
    def unlimited(self) -> bool:
        """Whether nothing can reach a limit: then no ranks are needed."""
        return min(getattr(self, f) for f in self.__dataclass_fields__) >= UNLIMITED

    def of(self, metricset: str) -> tuple[int, int]:
        """(total, per service) of a metricset."""
        name = {"transaction": "transaction", "service_transaction": "service_transaction", "service_destination": "span"}[metricset]
        return getattr(self, f"max_{name}_groups"), getattr(self, f"max_{name}_groups_per_service")


@dataclass(frozen=True)
class AggConfig:
    """Settings; limits must be given, as a limit of zero would let nothing through."""

    limits: Limits
    #: Takes the documents of a harvest and the interval in seconds.
    sink: Callable[[DataFrame, int], None] | None = console
    #: Holds partials between ingest and harvest; None: a folder under spark.checkpoint.dir that only this aggregator knows.
    data_dir: str | None = None
    partitions: int = 1
    intervals: tuple[timedelta, ...] = (timedelta(minutes=1),)
    harvest_delay: timedelta = timedelta(0)
    lookback: timedelta = timedelta(0)
    overflow_logging: bool = False
    overflow_count_mode: str = "sketch"  # or "exact": a distinct count, for tests on small data
    #: map<string,string> of the tenant, added to the attributes of every metric.
    metric_labels: Callable[[Column], Column] | None = None
    #: Takes a DataFrame of metrics (see spanfold.telemetry) after each harvest.
    metrics_sink: Callable[[DataFrame], None] | None = None

    def __post_init__(self) -> None:
        checks = [
            (self.data_dir == "", "data directory is required"),
            (self.sink is None, "processor is required"),
            (self.partitions < 1, "partitions must be greater than zero"),
            (not self.intervals, "at least one aggregation interval is required"),
            (list(self.intervals) != sorted(self.intervals), "aggregation intervals must be in ascending order"),
            (any(i % self.intervals[0] for i in self.intervals[1:] if self.intervals[0] > timedelta(0)), "aggregation intervals must be a factor of lowest interval"),
            (bool(self.intervals) and self.intervals[0] < timedelta(seconds=1), "aggregation interval less than one second is not supported"),
            (bool(self.intervals) and self.intervals[-1] > timedelta(hours=18), "aggregation interval greater than 18 hours is not supported"),
            (self.overflow_count_mode not in ("sketch", "exact"), "overflow count mode must be sketch or exact"),
        ]
        for failed, message in checks:
            if failed:
                raise ValueError(message)

    @property
    def interval_seconds(self) -> list[int]:
        return [int(i.total_seconds()) for i in self.intervals]
