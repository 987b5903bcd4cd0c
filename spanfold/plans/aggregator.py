"""The aggregator: raw events or partials in, documents out, by harvest.

Ingested data lands as long partial rows (operators/rows.py) in a folder of its batch, divided by interval and bucket; a batch
counts once the ledger names it. A harvest fixes the batches it reads and takes every bucket of one interval below its end that
was not handed on, so what a failed or skipped harvest left comes again (at least once). It applies the limits, hands the result
to the sink, notes that in the ledger and deletes the files. Ingest goes on meanwhile. Late partials within the lookback come out
as a second result of their bucket. Many small batches are merged into one. `run` harvests unattended.
"""

from __future__ import annotations

import logging
import math
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AggConfig
from ..functions.time import YEAR_ONE, truncate
from ..operators import limits as limiting
from ..operators.partials import Partials, aggregate, merge
from ..operators.rows import PRESENCE, TOTALS, columns, combined, observed, partials_of, rows_of
from ..schema import event_schema
from ..sources.work import Folder, work_dir
from ..telemetry import expired_metrics, harvest_metrics, log_overflow, taken_metrics
from .documents import documents
from .ledger import Ledger

LOG = logging.getLogger(__name__)


class AggregatorClosed(RuntimeError):
    pass


def events_to_partials(events: DataFrame, config: AggConfig) -> Partials:
    return aggregate(events, config.interval_seconds, config.partitions)


def merge_partials(config: AggConfig, *parts: Partials) -> Partials:
    """Partials merged under the limits."""
    return limited(merge(list(parts)), config)


def partials_to_documents(partials: Partials, config: AggConfig, received=None) -> DataFrame:
    return documents(partials, config.interval_seconds, distinct(config), received)


def limited(partials: Partials, config: AggConfig, folder: str | None = None) -> Partials:
    """The partials under the limits; without limits, and without overflow from before, they are what they are.

    They are written first, to the folder, as admission reads the groups several times and the events should be read once.
    """
    if config.limits.unlimited and partials.overflow is None:
        return partials
    return limiting.admit(partials, config.limits, distinct(config), folder)


def distinct(config: AggConfig) -> limiting.Distinct:
    return limiting.Distinct(config.overflow_count_mode == "exact")


def aggregate_documents(events: DataFrame, config: AggConfig, received=None) -> DataFrame:
    """The whole batch job: events to limited documents."""
    return partials_to_documents(limited(events_to_partials(events, config), config), config, received)


def moment(at: datetime):
    """A timestamp literal, whatever the session's time zone; a time without zone is UTC."""
    at = at.replace(tzinfo=at.tzinfo or timezone.utc)
    return F.timestamp_micros(F.lit(round(at.timestamp() * 1_000_000)))


def not_expired(config: AggConfig, now: datetime):
    """Condition on partials: their bucket is no older than the lookback allows."""
    start = truncate(moment(now), F.col("interval_s"))
    return F.col("processing_time") >= start - F.expr(f"interval {int(config.lookback.total_seconds())} seconds")


def harvest_range(interval_s: int, end: datetime, lookback: timedelta):
    """Condition on the combined columns: the interval's buckets from end - interval - lookback up to end."""
    low = end - timedelta(seconds=interval_s) - lookback
    return (F.col("interval_s") == interval_s) & (F.col("processing_time") >= moment(low)) & (F.col("processing_time") < moment(end))


def _since_year_one(at: datetime) -> int:
    return math.floor(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp()) + YEAR_ONE


def is_aligned(interval_s: int, end: datetime) -> bool:
    """Whether an interval ends at this time, counted from year one."""
    return _since_year_one(end) % interval_s == 0


def next_end(interval_s: int, at: datetime) -> datetime:
    """The first end of an interval after a time: that of the bucket which holds it."""
    return at.replace(microsecond=0) + timedelta(seconds=interval_s - _since_year_one(at) % interval_s)


#: Open batches from which on they are merged into one.
MOST_BATCHES = 32


class Aggregator:
    """Ingests, harvests and closes; one harvest runs at a time, beside any number of ingests."""

    def __init__(self, spark: SparkSession, config: AggConfig):
        self.spark, self.config = spark, config
        self.folder = f"{config.data_dir.rstrip('/')}/partials" if config.data_dir else work_dir(spark, "partials")
        self.files, self.lock, self.harvesting = Folder(spark, self.folder), threading.RLock(), threading.RLock()
        self.closed, self.running, self.stopping, self.expired = False, False, threading.Event(), 0.0
        self.files.make("data")
        self.ledger = Ledger(spark, f"{self.folder}/ledger")
        places = self.ledger.places(F.lit(True))
        self.live = {batch for batch, _, _ in places}
        held = {self._path(*p) for p in places}
        for path in self.files.matching("data/batch=*"):  # what an earlier run did not take in, or not forget
            if path.rsplit("batch=", 1)[1] not in self.live:
                self.files.remove(path)
        for path in self.files.matching("data/*/interval_s=*/bucket_s=*"):
            if not any(path.endswith(p) for p in held):
                self.files.remove(path)

    def _open(self) -> None:
        if self.closed:
            raise AggregatorClosed("aggregator is closed")

    def _path(self, batch: str, interval_s: int, bucket_s: int) -> str:
        return f"data/batch={batch}/interval_s={interval_s}/bucket_s={bucket_s}"

    @property
    def in_flight(self) -> dict[int, float]:
        """Events taken in but not yet handed on, by interval."""
        found = {r["interval_s"]: r["n"] for r in self.in_flight_events().groupBy("interval_s").agg(F.sum("events").alias("n")).collect()}
        return dict.fromkeys(self.config.interval_seconds, 0.0) | found

    def in_flight_events(self) -> DataFrame:
        """interval_s, cm_id, events: what was taken in and not yet handed on, by tenant."""
        with self.lock:
            return self.ledger.open().groupBy("interval_s", "cm_id").agg(F.sum("events").alias("events"))

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """(a new batch of rows, its entries for the ledger)."""
        batch = uuid.uuid4().hex
        rows.withColumn("bucket_s", F.unix_seconds("processing_time")).write.partitionBy("interval_s", "bucket_s").parquet(f"{self.folder}/data/batch={batch}")
        counted = self._rows([batch]).filter(F.col("code").isin(PRESENCE, TOTALS) & ~F.col("over"))
        return batch, counted.groupBy("batch", "interval_s", "bucket_s", "cm_id").agg(F.coalesce(F.sum("events"), F.lit(0.0)).alias("events")).withColumn("done", F.lit(False))

    def _rows(self, batches: list[str]) -> DataFrame:
        """The long rows of batches; a batch has no files where it has no rows."""
        kinds = ", ".join(f"{c} {k}" for c, k in columns(distinct(self.config)).items() if c != "interval_s")
        return self.spark.read.schema(f"{kinds}, batch string, interval_s int, bucket_s long").option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/batch={b}" for b in batches])

    def _take(self, rows: DataFrame, cm_id: str | None = None) -> float:
        batch, entries = self._write(rows)
        with self.lock:
            try:
                self._open()  # it may have been closed meanwhile
            except AggregatorClosed:
                self.files.remove(f"{self.folder}/data/batch={batch}")
                raise
            self.ledger.append(entries)
            self.live.add(batch)
            many = len(self.live) > MOST_BATCHES
        if self.config.metrics_sink:
            self.config.metrics_sink(taken_metrics(self.spark, cm_id, self.files.size(f"data/batch={batch}"), self.config))
        if many and self.harvesting.acquire(blocking=False):  # else the harvest under way forgets some
            try:
                self.compact()
            finally:
                self.harvesting.release()
        taken = self.ledger.entries().filter((F.col("batch") == batch) & ~F.col("done")).groupBy("interval_s").agg(F.sum("events").alias("n"))
        return taken.agg(F.max("n")).first()[0] or 0.0

    def aggregate_batch(self, cm_id: str, events: DataFrame) -> float:
        """Adds raw events of a tenant; events carry their processing time. Returns how many there were.

        The source is read once: its rows are written down before the metricsets are made of them.
        """
        self._open()
        work = work_dir(self.spark, "taken")
        events.withColumn("cm_id", F.lit(cm_id)).select(*[f.name for f in event_schema()]).write.parquet(work)
        try:
            own = self.spark.read.schema(event_schema()).parquet(work)
            return self._take(combined(observed(own, self.config.interval_seconds, self.config.partitions, distinct(self.config))), cm_id)
        finally:
            self.files.remove(work)

    def aggregate_partials(self, partials: Partials, now: datetime) -> float:
        """Adds partials made elsewhere; expired ones are dropped without an error, counted, and reported as failures."""
        self._open()
        fresh = not_expired(self.config, now)
        late = partials.totals.filter(~fresh).groupBy("interval_s", "cm_id").agg(F.sum("events_total").alias("events"))
        gone = {r["interval_s"]: r["n"] for r in late.groupBy("interval_s").agg(F.sum("events").alias("n")).collect()}
        for interval, n in gone.items():
            self.expired += n
            if self.config.metrics_sink:
                self.config.metrics_sink(expired_metrics(late.filter(F.col("interval_s") == interval), self.config, interval))
        return self._take(rows_of(partials.filter(fresh), distinct(self.config)))

    def events_expired(self) -> float:
        return self.expired

    def compact(self) -> None:
        """Merges the open batches into one, and drops closed entries of the ledger."""
        with self.harvesting:
            with self.lock:
                places = self.ledger.places(F.lit(True))
            old = sorted({p[0] for p in places})
            if len(old) > 1:
                batch, entries = self._write(combined(self._rows(old)))
                with self.lock:
                    self.ledger.append(entries.unionByName(self.ledger.done(places)))  # in one file: the batches change places
                    self.live = self.live - set(old) | {batch}
                for b in old:
                    self.files.remove(f"{self.folder}/data/batch={b}")
            with self.lock:
                self.ledger.compact()

    def _held(self, inside, batches: list[str] | None = None) -> Partials:
        """All open partials of some batches (all of them without a list) that meet a condition on the combined columns, merged."""
        batches = sorted(self.live) if batches is None else batches
        rows = self._rows(batches).filter(inside) if batches else self.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in columns(distinct(self.config)).items()))
        overflowed = bool(batches) and not rows.filter("over").isEmpty()
        return merge([partials_of(rows, overflowed)])

    def harvest(self, end: datetime, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        """Hands what every interval that ends at `end` holds from before it to the sink, as documents, and forgets it afterwards."""
        self._open()
        self._harvest({i: end for i in self.config.interval_seconds if is_aligned(i, end)}, sink)

    def _harvest(self, ends: dict[int, datetime | None], sink) -> None:
        """All intervals are tried; the first failure is raised at the end. Without an end, all that is left of the interval."""
        failed = None
        with self.harvesting:
            for interval, end in ends.items():
                inside = F.col("interval_s") == interval
                if end is not None:
                    inside = inside & (F.col("bucket_s") < math.floor(end.replace(tzinfo=end.tzinfo or timezone.utc).timestamp()))
                with self.lock:
                    places = self.ledger.places(inside)
                if not places:
                    continue
                work = work_dir(self.spark, "harvest")
                try:
                    buckets = sorted({p[2] for p in places})
                    cut = limited(self._held(inside & F.col("bucket_s").isin(buckets), sorted({p[0] for p in places})), self.config, work)
                    try:
                        (sink or self.config.sink)(partials_to_documents(cut, self.config), interval)
                    except Exception as e:
                        failed = failed or e
                        self._report(cut, interval, "failure")
                        continue
                    self._report(cut, interval, "success")
                    self._forget(places)
                finally:
                    self.files.remove(work)
        if failed:
            raise failed

    def _forget(self, places: list[tuple[str, int, int]]) -> None:
        """Notes that places were handed on, then deletes their files, and the folders of batches that have none left."""
        with self.lock:
            self.ledger.append(self.ledger.done(places))
            left = {p[0] for p in self.ledger.places(F.lit(True))}
            over = {p[0] for p in places} - left
            self.live -= over
            self.ledger.compact()
        for p in places:
            self.files.remove(f"{self.folder}/{self._path(*p)}")
        for batch in over:
            self.files.remove(f"{self.folder}/data/batch={batch}")

    def _report(self, cut: Partials, interval: int, outcome: str) -> None:
        if self.config.metrics_sink:
            self.config.metrics_sink(harvest_metrics(cut, self.config, interval, outcome, distinct(self.config)))
        if self.config.overflow_logging and cut.overflow is not None:
            log_overflow(cut, self.config.limits, distinct(self.config))

    def run(self, until: datetime | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), wait: Callable[[float], bool] | None = None) -> None:
        """Harvests whenever the lowest interval ends, harvest_delay later, until closed or beyond `until`; what fails is logged and comes with the next harvest of its interval."""
        with self.lock:
            self._open()
            if self.running:
                raise RuntimeError("aggregator is already running")
            self.running = True
        lowest, wait = self.config.interval_seconds[0], wait or self.stopping.wait
        try:
            end = next_end(lowest, clock())
            while not self.closed and (until is None or end <= until):
                pause = (end + self.config.harvest_delay - clock()).total_seconds()
                if pause > 0 and wait(pause):
                    break
                try:
                    self.harvest(end)
                except AggregatorClosed:
                    break
                except Exception:
                    LOG.exception("harvest until %s failed", end)
                end += timedelta(seconds=lowest)
        finally:
            self.running = False

    def close(self, now: datetime | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        """Stops `run`, takes nothing more in and hands on all that is left, whatever its bucket; closing again does nothing.

        If the sink fails, what it was given stays, and closing can be tried again. `now` is kept for callers that give the time.
        """
        self.stopping.set()
        with self.harvesting:
            with self.lock:
                if self.closed:
                    return
                self.closed = True
            try:
                self._harvest(dict.fromkeys(self.config.interval_seconds), sink)
            except Exception:
                self.closed = False
                raise
