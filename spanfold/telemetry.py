"""Overflow counts and warnings, and the metrics of a harvest."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AggConfig, Limits
from .functions.time import interval_label
from .operators.limits import Distinct
from .operators.partials import Partials
from .schema import COMBINED, GROUP, SERVICE

LOG, MOST_WARNINGS = logging.getLogger(__name__), 1000


def overflow_by_owner(partials: Partials, distinct: Distinct = Distinct()) -> DataFrame:
    """(combined, service, aggregation_type, overflowed): the estimate of each overflow bucket; null service: of the whole key."""
    parts = []
    for m in GROUP:
        rows = partials.overflow[m].groupBy(*COMBINED, *SERVICE).agg(distinct.union(F.col("sketch")).alias("sketch"))
        parts.append(rows.select(*COMBINED, *SERVICE, F.lit(m).alias("aggregation_type"), distinct.count(F.col("sketch")).alias("overflowed")))
    return reduce(DataFrame.unionByName, parts)


def overflow_counts(partials: Partials, distinct: Distinct = Distinct()) -> DataFrame:
    """(interval_s, cm_id, aggregation_type, overflowed): sums of the buckets' estimates, not an estimate of their union."""
    rows = overflow_by_owner(partials, distinct).select("interval_s", "cm_id", "aggregation_type", "overflowed")
    services = partials.service_overflow.select("interval_s", "cm_id", F.lit("service").alias("aggregation_type"), distinct.count(F.col("sketch")).alias("overflowed"))
    return rows.unionByName(services).groupBy("interval_s", "cm_id", "aggregation_type").agg(F.sum("overflowed").alias("overflowed"))


def overflow_log(partials: Partials, limits: Limits, distinct: Distinct = Distinct()) -> DataFrame:
    """Warnings: one for each service that filled its own limit, one a type and key where only the total was reached."""
    over = overflow_by_owner(partials, distinct).filter("svc_name is not null and overflowed > 0")
    parts = []
    for m in GROUP:
        total, per_service = limits.of(m)
        held = partials.groups[m].select(*COMBINED, *SERVICE, *GROUP[m]).distinct().groupBy(*COMBINED, *SERVICE).agg(F.count("*").alias("held"))
        rows = over.filter(F.col("aggregation_type") == m).join(held, [*COMBINED, *SERVICE], "left")
        own = F.coalesce("held", F.lit(0)) >= per_service
        parts.append(rows.filter(own).select(*COMBINED, "aggregation_type", "svc_name", F.lit(per_service).cast("long").alias("limit"), F.lit("per_service").alias("scope")))
        parts.append(rows.filter(~own).select(*COMBINED, "aggregation_type", F.lit(None).cast("string").alias("svc_name"), F.lit(total).cast("long").alias("limit"), F.lit("overall").alias("scope")).distinct())
    parts.append(partials.service_overflow.select(*COMBINED, F.lit("service").alias("aggregation_type"), F.lit(None).cast("string").alias("svc_name"), F.lit(limits.max_services).cast("long").alias("limit"), F.lit("overall").alias("scope")))
    return reduce(DataFrame.unionByName, parts)


def latencies(partials: Partials, emitted, harvest_delay_s: int = 0) -> DataFrame:
    """Seconds from a bucket's end (plus the delay) and from its youngest event to the emission."""
    end = F.unix_timestamp("processing_time") + F.col("interval_s") + harvest_delay_s
    at = F.unix_timestamp(emitted)
    return partials.totals.select(*COMBINED, "events_total", (at - end).alias("processed_latency_s"), (at - F.unix_timestamp("youngest")).alias("queued_latency_s"))


def harvest_metrics(partials: Partials, config: AggConfig, interval_s: int, outcome: str, distinct: Distinct = Distinct(), emitted=None) -> DataFrame:
    """(name, cm_id, value, attributes) of a harvest: events processed, latencies in seconds, overflow counts by type."""
    interval, emitted = interval_label(interval_s), F.current_timestamp() if emitted is None else emitted
    base = [F.lit("aggregation_interval"), F.lit(interval)]
    late = latencies(partials, emitted, int(config.harvest_delay.total_seconds()))
    sums = late.groupBy("cm_id").agg(F.sum("events_total").alias("events.processed.count"), F.max("processed_latency_s").cast("double").alias("events.processed.latency"), F.max("queued_latency_s").cast("double").alias("events.processed.queued-latency"))
    names = [c for c in sums.columns if c != "cm_id"]
    rows = sums.select("cm_id", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in names])).alias("m"))
    out = [rows.select("m.name", "cm_id", "m.value", F.create_map(*base, F.lit("outcome"), F.lit(outcome)).alias("attributes"))]
    if partials.overflow is not None:
        over = overflow_counts(partials, distinct).filter("overflowed > 0")
        out.append(over.select(F.lit("metrics.overflowed.count").alias("name"), "cm_id", F.col("overflowed").cast("double").alias("value"), F.create_map(*base, F.lit("aggregation_type"), F.col("aggregation_type")).alias("attributes")))
    rows = reduce(DataFrame.unionByName, out)
    return rows if config.metric_labels is None else rows.withColumn("attributes", F.map_concat("attributes", config.metric_labels(F.col("cm_id"))))


def expired_metrics(late: DataFrame, config: AggConfig, interval_s: int) -> DataFrame:
    """(name, cm_id, value, attributes) of events that no harvest takes: failures; late: cm_id, events."""
    told = F.create_map(F.lit("aggregation_interval"), F.lit(interval_label(interval_s)), F.lit("outcome"), F.lit("failure"))
    rows = late.filter("events > 0").select(F.lit("events.processed.count").alias("name"), "cm_id", F.col("events").cast("double").alias("value"), told.alias("attributes"))
    return rows if config.metric_labels is None else rows.withColumn("attributes", F.map_concat("attributes", config.metric_labels(F.col("cm_id"))))


def taken_metrics(spark: SparkSession, cm_id: str | None, size: int, config: AggConfig) -> DataFrame:
    """(name, cm_id, value, attributes) of a batch that was taken in: its bytes, of one tenant or (null) of several."""
    rows = spark.createDataFrame([("events.processed.bytes", cm_id, float(size), {"outcome": "success"})], "name string, cm_id string, value double, attributes map<string,string>")
    return rows if config.metric_labels is None or cm_id is None else rows.withColumn("attributes", F.map_concat("attributes", config.metric_labels(F.col("cm_id"))))


def log_overflow(partials: Partials, limits: Limits, distinct: Distinct = Distinct()) -> None:
    """Logs the warnings of overflow_log, MOST_WARNINGS of them and how many more there are; the table has all."""
    warnings = overflow_log(partials, limits, distinct)
    told = warnings.limit(MOST_WARNINGS + 1).collect()
    if len(told) > MOST_WARNINGS:
        LOG.warning("%d more limits were reached", warnings.count() - MOST_WARNINGS)
    for r in told[:MOST_WARNINGS]:
        LOG.warning("%s limit of %d reached: tenant %s, %s, interval %ss", r["scope"], r["limit"], r["cm_id"], r["aggregation_type"] + (f" of {r['svc_name']}" if r["svc_name"] else ""), r["interval_s"])
