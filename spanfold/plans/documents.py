"""Metric documents: one flat row for each group, service and overflow bucket, and the nested form of such rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hdr, labels
from ..functions.time import label_column
from ..operators.limits import Distinct
from ..operators.partials import Partials
from ..schema import COMBINED, GROUP, SERVICE, SPAN, SUMS, TRANSACTION

OTHER = "_other"
MEASURES = {
    "metricset_doc_count": "bigint",
    "overflow_count": "bigint",
    "event_success_count": "bigint",
    "event_success_sum": "double",
    "duration_count": "bigint",
    "duration_sum": "double",
    "histogram_counts": "array<bigint>",
    "histogram_values": "array<double>",
    "response_count": "bigint",
    "response_sum": "bigint",
}


def histogram(rows: DataFrame, keys: list[str], sums: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """Bucket rows to one row a key: count, sum and the arrays; every bucket's count is rounded by itself."""
    n = F.round(F.col("scaled") / hdr.COUNT_SCALE).cast("long")
    some = F.col("bucket").isNotNull() & (F.col("scaled") > 0)
    rows = rows.withColumns({"n": F.when(some, n), "value": F.when(some, hdr.highest_equivalent(F.col("bucket")).cast("double"))})
    pairs = F.array_sort(F.collect_list(F.when(some, F.struct("value", "n"))))
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duration_count"), F.coalesce(F.sum(F.col("n") * F.col("value")), F.lit(0.0)).alias("duration_sum"), pairs.alias("pairs"), *[F.sum(c).alias(c) for c in sums], *more)
    return out.withColumns({"histogram_counts": F.col("pairs.n"), "histogram_values": F.col("pairs.value")}).drop("pairs")


def _with_service(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"timestamp": F.col("svc_timestamp")})


def transaction_measures(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    out = histogram(rows, keys, (), *more)
    return out.withColumns({"metricset_doc_count": F.col("duration_count")})


def success_of_outcome(outcome: Column) -> dict[str, Column]:
    count = F.col("duration_count")
    return {"event_success_count": F.when(outcome.isin("success", "failure"), count).otherwise(0), "event_success_sum": F.when(outcome == "success", count.cast("double")).otherwise(0.0)}


def service_transaction_measures(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    out = histogram(rows, keys, SUMS["service_transaction"], *more)
    return out.withColumns({"metricset_doc_count": F.col("duration_count"), "event_success_count": F.round(F.col("success") + F.col("failure")).cast("long"), "event_success_sum": F.round("success")}).drop("success", "failure")


def span_measures(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.sum("count").alias("count"), F.sum("total").alias("total"), *more)
    count = F.round("count").cast("long")
    return out.withColumns({"metricset_doc_count": count, "response_count": count, "response_sum": F.round("total").cast("long")}).drop("count", "total")


def _complete(frame: DataFrame, metricset: str, intervals: list[int], *more: str) -> DataFrame:
    """All columns of a flat document, and some more."""
    have = set(frame.columns)
    kinds = {c: "string" for c in (*TRANSACTION, *SPAN)} | {"trace_root": "boolean", "faas_cold_start": "boolean"} | MEASURES | {"event_received": "timestamp", "timestamp": "timestamp"}
    columns = [F.lit(metricset).alias("metricset_name"), label_column(F.col("interval_s"), intervals).alias("metricset_interval"), *COMBINED, *SERVICE]
    columns += [F.col(c).cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return frame.select(*columns, *more)


def documents(partials: Partials, intervals: list[int], distinct: Distinct = Distinct(), received: Column | None = None) -> DataFrame:
    """Flat documents of admitted partials; `received` stands for the time of emission."""
    received = F.lit(None).cast("timestamp") if received is None else received
    t, s, d = "transaction", "service_transaction", "service_destination"
    keys = {m: [*COMBINED, *SERVICE, *GROUP[m]] for m in GROUP}
    now = {"event_received": received}
    txn = _with_service(transaction_measures(partials.groups[t], keys[t])).withColumns(now)
    out = [
        _complete(txn.withColumns(success_of_outcome(F.col("event_outcome"))), t, intervals),
        _complete(_with_service(service_transaction_measures(partials.groups[s], keys[s])).withColumns(now), s, intervals),
        _complete(_with_service(span_measures(partials.groups[d], keys[d])).withColumns(now), d, intervals),
        _complete(_with_service(partials.services).withColumns(now), "service_summary", intervals),
    ]
    if partials.overflow is not None:
        # A combined key without any admitted service yields nothing, not even overflow.
        youngest = partials.totals.select(*COMBINED, "youngest").join(partials.services.select(*COMBINED).distinct(), list(COMBINED), "left_semi")
        owner = [*COMBINED, *SERVICE]
        sketch = distinct.union(F.col("sketch")).alias("sketch")
        over = {
            t: transaction_measures(partials.overflow[t], owner, sketch).withColumns({"transaction_name": F.lit(OTHER), "trace_root": F.lit(False)} | {c: F.lit("") for c in TRANSACTION if c not in ("trace_root", "faas_cold_start", "transaction_name")} | {"event_success_count": F.lit(0), "event_success_sum": F.lit(0.0)}),
            s: service_transaction_measures(partials.overflow[s], owner, sketch).withColumns({"transaction_type": F.lit(OTHER)}),
            d: span_measures(partials.overflow[d], owner, sketch).withColumns({"target_name": F.lit(OTHER)} | {c: F.lit("") for c in SPAN if c != "target_name"}),
        }
        for m, frame in over.items():
            frame = frame.withColumn("overflow_count", distinct.count(F.col("sketch")))
            if m == d:
                frame = frame.withColumn("metricset_doc_count", F.col("overflow_count"))
            out.append(_complete(_overflowed(frame, received), m, intervals, "whole"))
        rows = partials.service_overflow.withColumn("overflow_count", distinct.count(F.col("sketch")))
        rows = rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in partials.services.dtypes if c in SERVICE])
        out.append(_complete(_overflowed(rows, received), "service_summary", intervals, "whole"))
        turned = reduce(DataFrame.unionByName, out[4:]).join(youngest, list(COMBINED))
        out[4:] = [turned.withColumn("event_received", F.when(F.col("whole"), F.col("youngest")).otherwise(F.col("event_received"))).select(*out[0].columns)]
    return reduce(DataFrame.unionByName, out)


def _overflowed(frame: DataFrame, received: Column) -> DataFrame:
    """Overflow rows: processing time for timestamp, no labels; those of no service are named `_other`."""
    whole = F.col("svc_name").isNull()
    frame = frame.withColumns({"event_received": received, "timestamp": F.col("processing_time"), "whole": whole})
    whole = F.col("whole")
    fill = {c: F.when(whole, F.lit(OTHER if c == "svc_name" else "")).otherwise(F.col(c)) for c in SERVICE if c not in ("svc_timestamp", "global_labels")}
    return frame.withColumns(fill | {"global_labels": F.lit(""), "svc_timestamp": F.lit(None).cast("timestamp")})


def _some(**fields: Column) -> Column:
    """A struct, or null if all its members are empty."""
    any_ = None
    for c in fields.values():
        any_ = c.isNotNull() if any_ is None else any_ | c.isNotNull()
    return F.when(any_, F.struct(*[v.alias(k) for k, v in fields.items()]))


def _text(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def nested(flat: DataFrame) -> DataFrame:
    """Documents as nested structs; a struct is null when all its members are empty."""
    t = F.col("metricset_name")
    is_txn, is_span = t.isin("transaction", "service_transaction"), t == "service_destination"
    parsed = labels.parse(F.col("global_labels"))
    sample = F.when(F.col("overflow_count").isNotNull(), F.array(F.struct(F.concat(t, F.lit(".aggregation.overflow_count")).alias("name"), F.col("overflow_count").cast("double").alias("value"))))
    c = _text
    return flat.select(
        *COMBINED,
        F.struct(t.alias("name"), F.col("metricset_interval").alias("interval"), F.col("metricset_doc_count").alias("doc_count"), sample.alias("samples")).alias("metricset"),
        "timestamp",
        F.struct(F.col("event_received").alias("received"), F.when(is_txn, c("event_outcome")).when(is_span, c("span_outcome")).alias("outcome"), F.when(is_txn, F.struct(F.col("event_success_count").alias("count"), F.col("event_success_sum").alias("sum"))).alias("success_count")).alias("event"),
        _some(name=c("agent_name")).alias("agent"),
        F.struct(F.col("svc_name").alias("name"), c("svc_environment").alias("environment"), c("service_version").alias("version"), _some(name=c("svc_language"), version=c("service_language_version")).alias("language"), _some(name=c("service_runtime_name"), version=c("service_runtime_version")).alias("runtime"), _some(name=c("service_node_name")).alias("node"), _some(type=c("target_type"), name=c("target_name")).alias("target")).alias("service"),
        F.when(is_txn, F.struct(c("transaction_name").alias("name"), F.col("transaction_type").alias("type"), c("transaction_result").alias("result"), F.col("trace_root").alias("root"), F.struct(F.col("duration_count").alias("count"), F.col("duration_sum").alias("sum")).alias("duration_summary"), F.struct(F.col("histogram_counts").alias("counts"), F.col("histogram_values").alias("values")).alias("duration_histogram"))).alias("transaction"),
        F.when(is_span, F.struct(c("span_name").alias("name"), F.struct(F.col("resource"), F.struct(F.col("response_count").alias("count"), F.col("response_sum").alias("sum")).alias("response_time")).alias("destination_service"))).alias("span"),
        _some(id=c("container_id")).alias("container"),
        _some(pod_name=c("kubernetes_pod_name")).alias("kubernetes"),
        _some(hostname=c("host_hostname"), name=c("host_name"), os=_some(platform=c("host_os_platform"))).alias("host"),
        _some(cold_start=F.col("faas_cold_start"), id=c("faas_id"), name=c("faas_name"), version=c("faas_version"), trigger_type=c("faas_trigger_type")).alias("faas"),
        _some(**{k: c(f"cloud_{k}") for k in ("provider", "region", "availability_zone", "service_name", "account_id", "account_name", "machine_type", "project_id", "project_name")}).alias("cloud"),
        parsed["labels"].alias("labels"),
        parsed["numeric_labels"].alias("numeric_labels"),
    )
