"""The unattended form: Structured Streaming takes events and partials, closes harvests by the clock, applies the limits.

Each interval is a query of its own. All rows, raw or partial, come in one long form and belong to the harvest that takes them:
that of their own bucket, or, if they come after it, the next one of their interval, as a second result of their bucket. Rows
older than the lookback are not harvested but counted. Admission (see admission.py) marks rows as they arrive; one windowed
aggregation adds them up, and a finished window comes to foreachBatch as partial rows, which become documents or, for a further
level, stay partials.

The watermark is the harvest delay behind the clock, and the clock is not only the events': a source of ticks moves it while
nothing comes, so a silent stream closes its last window, too. `Streams.stop` closes open windows with a tick at their end. A
batch that fails is run again with the same rows: at least once.

State: with limits, a row for each key that got in and one for each admitted group, overflow bucket and histogram bucket,
however many keys come; RocksDB holds it off the heap. Without limits it holds all groups of open windows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import AggConfig
from ..functions.time import truncate, window_start
from ..operators.partials import Partials
from ..operators.rows import CODES, KEYS, MEASURES, PRESENCE, SERVICES, TOTALS, columns, observed, partials_of
from ..plans.aggregator import distinct, next_end, partials_to_documents
from ..sources.work import Folder, ship, work_dir
from ..telemetry import expired_metrics, harvest_metrics, log_overflow
from ..operators.limits import IN_GROUP, OF_ALL, OF_SERVICE
from .admission import admitted_rows

#: Rows of partials that came too late: counted by tenant, not harvested.
EXPIRED = 5
#: What queries start with: state off the heap; no deduction of filters, which takes ever longer with so many columns made by rule.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.constraintPropagation.enabled": "false"}


def _seconds(d: timedelta):
    return F.expr(f"interval {int(d.total_seconds())} seconds")


def raw_rows(events: DataFrame, interval_s: int, config: AggConfig) -> DataFrame:
    """The long form of events; their clock is their processing time."""
    return observed(events, [interval_s], config.partitions, distinct(config)).withColumnRenamed("raw_time", "clock")


def partial_rows(partials: DataFrame, interval_s: int, config: AggConfig) -> DataFrame:
    """Rows of the long table that belong to an interval, with the clock of their harvest; `arrived` says when they came (now, if absent)."""
    rows = partials.filter(F.col("interval_s") == interval_s)
    arrived = (F.col("arrived") if "arrived" in partials.columns else F.current_timestamp()) - _seconds(config.harvest_delay)
    late = F.col("processing_time") < truncate(arrived, F.lit(interval_s)) - _seconds(config.lookback)
    rows = rows.withColumns({"clock": F.greatest("processing_time", arrived), "late": late})
    # An expired bucket counts by its tenant, whatever its time; of a late totals row nothing but its events is kept.
    counted = F.col("code").isin(PRESENCE, TOTALS) & ~F.col("over")
    rows = rows.filter(~F.col("late") | counted)
    empty = {c: F.when(~F.col("late"), F.col(c)) for c in (*SERVICES, *KEYS, "bucket", *MEASURES, "first", "youngest", "processing_time")}
    return rows.withColumns(empty | {"code": F.when(F.col("late"), EXPIRED).otherwise(F.col("code"))}).select(*columns(distinct(config)), "clock")


def ticks_of(spark: SparkSession, folder: str, by_clock: bool, config: AggConfig) -> DataFrame:
    """Rows without content that move the clock: those in a folder, and one a second."""
    ticks = spark.readStream.schema("at timestamp").parquet(folder)
    if by_clock:
        ticks = ticks.union(spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("at")))
    return ticks.select(*[F.lit(None).cast(k).alias(c) for c, k in columns(distinct(config)).items()], F.col("at").alias("clock"))


def windowed(rows: DataFrame, interval_s: int, config: AggConfig) -> DataFrame:
    """Rows of closed harvests, marked and added up."""
    interval, kind = timedelta(seconds=interval_s), distinct(config)
    rows = rows.withWatermark("clock", f"{int(config.harvest_delay.total_seconds())} seconds")
    rows = rows.filter("code is not null or clock is null")  # ticks end here; the clock keeps the condition above the watermark
    if config.limits.unlimited:
        place = F.when(~F.col("over"), IN_GROUP).when(F.col("svc_name").isNull(), OF_ALL).otherwise(OF_SERVICE)
        rows = rows.withColumns({"place": place, "key1": F.lit(None).cast("long")})
    else:
        ends = F.unix_millis(truncate(F.col("clock"), F.lit(interval_s))) + 1000 * interval_s
        rows = admitted_rows(rows.withColumn("ends_ms", ends), config.limits, kind)
    grouped = F.col("place") == IN_GROUP
    rows = rows.withColumns({c: F.when(F.col("place") != OF_ALL, F.col(c)) for c in SERVICES} | {c: F.when(grouped, F.col(c)) for c in KEYS})
    sums = [F.sum(c).alias(c) for c in MEASURES]
    sketches = [kind.of(F.when(~grouped & ~F.col("over"), F.col("key1"))).alias("fresh"), F.count_if(~grouped & ~F.col("over")).alias("n_fresh"), kind.union(F.col("sketch")).alias("before"), F.count("sketch").alias("n_before")]
    window = F.window("clock", f"{interval_s} seconds", None, window_start(interval)).alias("w")
    keys = ["code", "interval_s", "processing_time", "cm_id", "partition_id", "place", *SERVICES, *KEYS, "bucket"]
    out = rows.groupBy(window, *keys).agg(*sums, F.min("first").alias("first"), F.sum("events").alias("events"), F.max("youngest").alias("youngest"), *sketches)
    return out.withColumn("sketch", kind.either("fresh", "n_fresh", "before", "n_before")).drop("w", "fresh", "before", "n_fresh", "n_before")


def closed_partials(rows: DataFrame, config: AggConfig) -> Partials:
    """The partials of closed harvests: groups, and overflow where something was turned away."""
    own = rows.filter(F.col("code") != EXPIRED)
    told = own.withColumn("over", F.col("place") != IN_GROUP).drop("place")
    out = partials_of(told, True)
    # Events of services that were turned away count, too.
    totals = own.filter(F.col("code").isin(PRESENCE, TOTALS) & F.col("events").isNotNull()).groupBy("interval_s", "processing_time", "cm_id", "partition_id").agg(F.sum("events").alias("events_total"), F.max("youngest").alias("youngest"))
    lost = out.service_overflow.filter("sketch is not null")
    if config.limits.unlimited and rows.filter(F.col("place") != IN_GROUP).isEmpty():
        return Partials(out.groups, out.services, totals)
    return Partials(out.groups, out.services, totals, out.overflow, lost)


@dataclass
class Streams:
    """Running queries, one for each interval."""

    spark: SparkSession
    config: AggConfig
    folder: str
    queries: dict[int, StreamingQuery] = field(default_factory=dict)

    def _tick(self, interval_s: int, at: datetime) -> None:
        micros = round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1_000_000)
        self.spark.range(1).select(F.timestamp_micros(F.lit(micros)).alias("at")).write.mode("append").parquet(f"{self.folder}/ticks/{interval_s}")

    def flush(self, now: datetime, most_seconds: float = 600) -> None:
        """Closes the harvests that are open at `now`, and waits until they are handed on."""
        ends = {i: next_end(i, now) for i in self.queries}
        for i in self.queries:
            self._tick(i, ends[i] + self.config.harvest_delay)
        for i, query in self.queries.items():
            end, until = f"{ends[i].astimezone(timezone.utc) if ends[i].tzinfo else ends[i]:%Y-%m-%dT%H:%M:%S}", time.monotonic() + most_seconds
            while not any((p["eventTime"] or {}).get("watermark", "") >= end for p in query.recentProgress):
                if query.exception():
                    raise query.exception()
                if time.monotonic() > until:
                    raise TimeoutError(f"the stream of {i} s has not closed its windows")
                time.sleep(0.2)

    def stop(self, now: datetime | None = None) -> None:
        """Closes what is open, once, and stops; a second call does nothing."""
        if self.queries:
            try:
                self.flush(now or datetime.now(timezone.utc))
            finally:
                for query in self.queries.values():
                    query.stop()
                self.queries = {}

    def state_rows(self) -> int:
        """Rows that the stateful operators hold."""
        return sum(op["numRowsTotal"] for q in self.queries.values() if q.lastProgress for op in q.lastProgress["stateOperators"])


@contextmanager
def settings(spark: SparkSession, given: dict[str, str]):
    """Settings for as long as the block lasts."""
    had = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def start(spark: SparkSession, config: AggConfig, checkpoint: str, events: DataFrame | None = None, partials: DataFrame | None = None, sink: Callable[[DataFrame, int], None] | None = None, partials_sink: Callable[[Partials, int], None] | None = None, by_clock: bool = True) -> Streams:
    """Starts a query for each interval over streams of raw events and of the long table of partials (operators/rows.py).

    Documents go to `sink` (config.sink without one), or partials to partials_sink. by_clock: ticks of the wall clock close
    windows; without, only events and `flush` do.
    """
    streams, files = Streams(spark, config, checkpoint), Folder(spark, checkpoint)
    if not config.limits.unlimited:
        ship(spark)

    def finish(interval_s: int):
        def run(batch: DataFrame, number: int) -> None:
            # Stored first: the plans below read the rows several times, and state should be read once.
            to = f"{checkpoint}/closed/{interval_s}/{number}"
            batch.write.mode("overwrite").parquet(to)
            rows = batch.sparkSession.read.schema(batch.schema).parquet(to)
            if not rows.isEmpty():
                closed = closed_partials(rows, config)
                if partials_sink:
                    partials_sink(closed, interval_s)
                else:
                    (sink or config.sink)(partials_to_documents(closed, config), interval_s)
                if config.metrics_sink:
                    config.metrics_sink(harvest_metrics(closed, config, interval_s, "success", distinct(config)))
                    late = rows.filter(F.col("code") == EXPIRED).groupBy("cm_id").agg(F.sum("events").alias("events"))
                    config.metrics_sink(expired_metrics(late, config, interval_s))
                if config.overflow_logging and closed.overflow is not None:
                    log_overflow(closed, config.limits, distinct(config))
            files.remove(to)

        return run

    with settings(spark, SETTINGS):  # a query keeps what it starts with
        for i in config.interval_seconds:
            files.make(f"ticks/{i}")
            rows = ticks_of(spark, f"{checkpoint}/ticks/{i}", by_clock, config)
            for more, form in ((events, raw_rows), (partials, partial_rows)):
                if more is not None:
                    rows = rows.unionByName(form(more, i, config))
            streams.queries[i] = windowed(rows, i, config).writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint}/{i}").foreachBatch(finish(i)).start()
    return streams


def replayed(spark: SparkSession, config: AggConfig, now: datetime, events: DataFrame | None = None, partials: DataFrame | None = None) -> DataFrame:
    """Documents of finite tables that go through as streams: written as files, read as streams, closed at `now`."""
    folder = work_dir(spark, "stream")

    def stream(frame: DataFrame | None, name: str):
        if frame is None:
            return None
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.readStream.schema(frame.schema).parquet(f"{folder}/{name}")

    def sink(documents: DataFrame, interval_s: int) -> None:
        documents.write.mode("append").parquet(f"{folder}/documents")

    streams = start(spark, config, f"{folder}/state", stream(events, "events"), stream(partials, "partials"), sink, by_clock=False)
    try:
        for query in streams.queries.values():
            query.processAllAvailable()
    finally:
        streams.stop(now)
    return spark.read.parquet(f"{folder}/documents")


def stream_to_documents(spark: SparkSession, events: DataFrame, config: AggConfig) -> DataFrame:
    """Events of a finite table as a stream that is stopped after the last of them."""
    last = events.agg(F.unix_micros(F.max("processing_time")).alias("t")).first()["t"] or 0
    return replayed(spark, config, datetime.fromtimestamp(last / 1_000_000, timezone.utc), events=events)
