"""Events to observations: routing, keys, weights and partitions, one branch for each metricset.

An observation is a row of the combined key, the service key, the group key and the measures of one event in one
metricset; `seq` and `pos` order observations by arrival. Branches read only the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hdr, labels
from ..functions.time import truncate
from ..schema import COMBINED, GROUP, MAX_DROPPED_SPANS, SERVICE, SPAN, TRANSACTION, TRANSACTION_FIELDS


def text(name: str) -> Column:
    """A string field; absent counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fanned_out(events: DataFrame, intervals: list[int]) -> DataFrame:
    """Every event once for each interval, with interval_s, the processing-time bucket and the service key."""
    out = events.withColumn("interval_s", F.explode(F.array(*[F.lit(i) for i in intervals]))) if len(intervals) > 1 else events.withColumn("interval_s", F.lit(intervals[0]))
    return out.withColumns(
        {
            "processing_time": truncate(F.col("processing_time"), F.col("interval_s")),
            "svc_timestamp": truncate(F.col("timestamp"), F.col("interval_s")),
            "svc_name": text("service.name"),
            "svc_environment": text("service.environment"),
            "svc_language": text("service.language.name"),
            "agent_name": text("agent.name"),
            "global_labels": labels.canonical(F.col("labels"), F.col("numeric_labels")),
        }
    )


def transaction_weight() -> Column:
    return F.coalesce(F.col("transaction.representative_count"), F.lit(0.0))


def span_weight() -> Column:
    return F.coalesce(F.col("span.representative_count"), F.lit(0.0))


def is_counted_transaction() -> Column:
    return F.coalesce((F.col("event_type") == "transaction") & (transaction_weight() > 0), F.lit(False))


def is_exit_span() -> Column:
    """A counted span with a target (even an empty one) or a destination resource."""
    place = F.col("service.target").isNotNull() | (text("span.destination_service.resource") != "")
    return F.coalesce((F.col("event_type") == "span") & (span_weight() > 0) & place, F.lit(False))


def partition_of(key: list, partitions: int) -> Column:
    """The partition of a group key (columns or their names) of the row's service."""
    return F.lit(0) if partitions == 1 else F.pmod(F.xxhash64(*SERVICE, *key), F.lit(partitions)).cast("int")


def _finish(rows: DataFrame, metricset: str, partitions: int, *measures: str, more: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.withColumn("partition_id", partition_of(list(GROUP[metricset]), partitions))
    return rows.select(*COMBINED, *SERVICE, *GROUP[metricset], *measures, "seq", "pos", *more)


def _duration() -> list[Column]:
    micros = F.expr("event.duration_ns div 1000")
    return [hdr.bucket_index(micros).alias("bucket"), hdr.scaled_count(transaction_weight()).alias("scaled")]


def _transaction_key() -> list[Column]:
    return [text("parent_id") == "", F.col("faas.cold_start"), *[text(field) for field in TRANSACTION_FIELDS.values()]]


def _span_key() -> list[Column]:
    return [text("span.name"), text("event.outcome"), text("service.target.type"), text("service.target.name"), text("span.destination_service.resource")]


def transactions(fanned: DataFrame, partitions: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    keys = [c.alias(name) for c, name in zip(_transaction_key(), TRANSACTION)]
    rows = fanned.filter(is_counted_transaction()).select(*[c for c in COMBINED if c != "partition_id"], *SERVICE, *keys, *_duration(), "seq", F.lit(0).alias("pos"), *more)
    return _finish(rows, "transaction", partitions, "bucket", "scaled", more=more)


def service_transactions(fanned: DataFrame, partitions: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    weight, outcome = transaction_weight(), text("event.outcome")
    rows = fanned.filter(is_counted_transaction()).select(*[c for c in COMBINED if c != "partition_id"], *SERVICE, text("transaction.type").alias("transaction_type"), *_duration(), F.when(outcome == "success", weight).otherwise(0.0).alias("success"), F.when(outcome == "failure", weight).otherwise(0.0).alias("failure"), "seq", F.lit(0).alias("pos"), *more)
    return _finish(rows, "service_transaction", partitions, "bucket", "scaled", "success", "failure", more=more)


def exit_spans(fanned: DataFrame, partitions: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """Exit spans; a composite span counts as often as it says, with its own duration."""
    weight, composite = span_weight(), F.col("span.composite")
    times = F.when(composite.isNotNull(), F.coalesce(F.col("span.composite.count"), F.lit(0))).otherwise(1)
    nanos = F.when(composite.isNotNull(), (F.coalesce(F.col("span.composite.sum_ms"), F.lit(0.0)) * 1e6).cast("long")).otherwise(F.coalesce(F.col("event.duration_ns"), F.lit(0)))
    rows = fanned.filter(is_exit_span()).select(*[c for c in COMBINED if c != "partition_id"], *SERVICE, *[c.alias(name) for c, name in zip(_span_key(), SPAN)], (times * weight).alias("count"), (nanos * weight).alias("total"), "seq", F.lit(0).alias("pos"), *more)
    return _finish(rows, "service_destination", partitions, "count", "total", more=more)


def _drop_key(d: Column) -> list[Column]:
    """The span key of a dropped-span statistic."""
    def part(name: str) -> Column:
        return F.coalesce(d[name], F.lit(""))

    return [F.lit(""), part("outcome"), part("service_target_type"), part("service_target_name"), part("destination_service_resource")]


def dropped_spans(fanned: DataFrame, partitions: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """Dropped-span statistics of counted transactions: the first MAX_DROPPED_SPANS of an event in each partition, numbered there."""
    own, stats = fanned.filter(is_counted_transaction()), F.col("transaction.dropped_spans_stats")
    if partitions == 1:
        found = F.posexplode(F.slice(stats, 1, MAX_DROPPED_SPANS)).alias("pos", "d")
    else:
        own = own.withColumn("held", kept_of_partitions(F.transform(stats, lambda d: partition_of(_drop_key(d), partitions))))
        found = F.inline(F.transform("held", lambda h: F.struct(h["pos"].alias("pos"), F.get(stats, h["at"]).alias("d")))).alias("pos", "d")
    rows = own.select(*[c for c in COMBINED if c != "partition_id"], *SERVICE, transaction_weight().alias("weight"), "seq", *more, found)
    keys = [c.alias(name) for c, name in zip(_drop_key(F.col("d")), SPAN)]
    measures = [(F.coalesce(f"d.duration.{c}", F.lit(0)) * F.col("weight")).alias(name) for c, name in (("count", "count"), ("sum_ns", "total"))]
    return _finish(rows.select(*[c for c in COMBINED if c != "partition_id"], *SERVICE, *keys, *measures, "seq", "pos", *more), "service_destination", partitions, "count", "total", more=more)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def kept_of_partitions(parts: Column) -> Column:
    """array<struct<at, pos>>: the first MAX_DROPPED_SPANS places of each partition, numbered within it; parts: the partition of each place."""

    def numbered(ordered):
        starts = F.filter(F.transform(ordered, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"))), lambda y: (y["i"] == 0) | (F.get(ordered, y["i"] - 1)["p"] != y["p"]))
        return let(F.map_from_entries(starts), lambda first: F.transform(ordered, lambda x, i: F.struct(x["at"].alias("at"), (i - first[x["p"]]).alias("pos"))))

    placed = F.array_sort(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("at"))))
    return F.filter(let(placed, numbered), lambda h: h["pos"] < MAX_DROPPED_SPANS)


def spans(fanned: DataFrame, partitions: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    return exit_spans(fanned, partitions, more).unionByName(dropped_spans(fanned, partitions, more))


BRANCHES = {"transaction": transactions, "service_transaction": service_transactions, "service_destination": spans}


def touched(partitions: int) -> Column:
    """The partitions that an event's observations fall into, each once; an event without observations has the one of its service."""
    nothing = F.array().cast("array<int>")
    transaction = F.array(partition_of(_transaction_key(), partitions), partition_of([text("transaction.type")], partitions))
    drops = F.coalesce(F.transform("transaction.dropped_spans_stats", lambda d: partition_of(_drop_key(d), partitions)), nothing)
    found = F.when(is_counted_transaction(), F.concat(transaction, drops)).when(is_exit_span(), F.array(partition_of(_span_key(), partitions))).otherwise(nothing)
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(F.array(partition_of([], partitions))))


def presences(fanned: DataFrame, partitions: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """(combined key, service key, seq, pos, received, share): each partition an event touches, each event at least once; an event's shares sum to 1."""
    common = ["interval_s", "processing_time", "cm_id", *SERVICE, "seq", F.lit(0).alias("pos"), F.col("event.received").alias("received"), *more]
    if partitions == 1:
        return fanned.select(*common, F.lit(1.0).alias("share"), F.lit(0).alias("partition_id"))
    rows = fanned.withColumn("parts", touched(partitions))
    return rows.select(*common, (1.0 / F.size("parts")).alias("share"), F.explode("parts").alias("partition_id"))
