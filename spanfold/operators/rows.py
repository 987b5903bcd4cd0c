"""Partials in one long table: what the aggregator keeps, what streams aggregate, what one level hands to the next.

A row is an observation of an event, or a row of a partial table; `code` says of which metricset, `over` that it stands for
overflowed keys and carries their sketch. Columns that a row has no use for are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMBINED, GROUP, HISTOGRAM, ORDER, SERVICE, SPAN, SUMS, TRANSACTION
from .limits import Distinct, ids
from .metricsets import BRANCHES, fanned_out, presences
from .partials import Partials

#: A service seen, the metricsets, totals without a service.
PRESENCE, TOTALS = 0, 4
CODES = {"transaction": 1, "service_transaction": 2, "service_destination": 3}
KEYS = {c: "string" for c in (*TRANSACTION, *SPAN)} | {"trace_root": "boolean", "faas_cold_start": "boolean"}
MEASURES = {"scaled": "bigint", "success": "double", "failure": "double", "count": "double", "total": "double"}
SERVICES = {c: "timestamp" if c == "svc_timestamp" else "string" for c in SERVICE}
COMBINEDS = {"interval_s": "int", "processing_time": "timestamp", "cm_id": "string", "partition_id": "int"}


def columns(distinct: Distinct = Distinct()) -> dict[str, str]:
    """Names and kinds of the long table's columns."""
    return {"code": "int", "over": "boolean"} | COMBINEDS | SERVICES | KEYS | {"bucket": "int"} | MEASURES | {"first": "bigint", "events": "double", "youngest": "timestamp", "sketch": distinct.kind}


def shaped(frame: DataFrame, code: int, over: bool, distinct: Distinct) -> DataFrame:
    """The frame with all columns of the long table, and those that are no part of it."""
    have, kinds = set(frame.columns), columns(distinct)
    given = {"code": F.lit(code), "over": F.lit(over)}
    own = [given[c].alias(c) if c in given else (F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
    return frame.select(*own, *[c for c in frame.columns if c not in kinds])


def observed(events: DataFrame, intervals: list[int], partitions: int, distinct: Distinct = Distinct()) -> DataFrame:
    """A row for each observation of raw events, with `raw_time`, the processing time before it was cut to its bucket."""
    fanned = fanned_out(events.withColumn("raw_time", F.col("processing_time")), intervals)
    first = (F.col("seq") * ORDER + F.col("pos")).alias("first")
    frames = []
    for m, branch in BRANCHES.items():
        rows = branch(fanned, partitions, more=("raw_time",)).select("*", first).drop("seq", "pos")
        frames.append(shaped(rows, CODES[m], False, distinct))
    seen = presences(fanned, partitions, more=("raw_time",)).select("*", first, F.col("share").alias("events"), F.col("received").alias("youngest"))
    frames.append(shaped(seen.drop("seq", "pos", "share", "received"), PRESENCE, False, distinct))
    return reduce(DataFrame.unionByName, frames)


def combined(rows: DataFrame, *more: Column | str) -> DataFrame:
    """Rows of one key added up; overflow rows keep a sketch each."""
    keys = [c for c in columns() if c not in MEASURES and c not in ("first", "events", "youngest", "sketch")]
    own = rows.filter("not over").groupBy(*keys, *more).agg(*[F.sum(c).alias(c) for c in MEASURES], F.min("first").alias("first"), F.sum("events").alias("events"), F.max("youngest").alias("youngest"))
    names = [*own.columns, "sketch"]
    return own.withColumn("sketch", F.lit(None).cast(rows.schema["sketch"].dataType)).unionByName(rows.filter("over").select(*names))


def rows_of(partials: Partials, distinct: Distinct = Distinct()) -> DataFrame:
    """The long table of partial tables."""
    frames = [shaped(d, CODES[m], False, distinct) for m, d in partials.groups.items()]
    frames.append(shaped(partials.services, PRESENCE, False, distinct))
    frames.append(shaped(partials.totals.withColumnRenamed("events_total", "events"), TOTALS, False, distinct))
    if partials.overflow is not None:
        frames += [shaped(d, CODES[m], True, distinct) for m, d in partials.overflow.items()]
        frames.append(shaped(partials.service_overflow, PRESENCE, True, distinct))
    return reduce(DataFrame.unionByName, frames)


def partials_of(rows: DataFrame, overflowed: bool = True) -> Partials:
    """Partial tables of a long table; rows of one key may come more than once, `merge` adds them up."""
    groups, overflow = {}, {}
    for m, code in CODES.items():
        own, hist = rows.filter(F.col("code") == code), ["bucket", "scaled"] if m in HISTOGRAM else []
        groups[m] = own.filter("not over").select(*COMBINED, *SERVICE, *GROUP[m], *hist, *SUMS[m], "first")
        overflow[m] = own.filter("over").select(*COMBINED, *SERVICE, *hist, *SUMS[m], "sketch")
    seen = rows.filter(F.col("code") == PRESENCE)
    services = seen.filter("not over").select(*COMBINED, *SERVICE, "first")
    totals = rows.filter(F.col("code").isin(PRESENCE, TOTALS) & ~F.col("over")).groupBy(*COMBINED).agg(F.sum("events").alias("events_total"), F.max("youngest").alias("youngest"))
    lost = seen.filter("over").select(*COMBINED, "sketch")
    return Partials(groups, services, totals, overflow, lost) if overflowed else Partials(groups, services, totals)


def with_ids(rows: DataFrame) -> DataFrame:
    """Ids of the service, of the group, and of the group without its span's name, the same as the batch job's."""
    rows = ids(rows, [*COMBINED, *SERVICE], ["sid1", "sid2"])
    pick = {}
    for k, more in ((1, []), (2, [F.lit("second")])):
        own = F.lit(0).cast("bigint")
        for m, code in CODES.items():
            own = F.when(F.col("code") == code, F.xxhash64(*more, *COMBINED, *SERVICE, *GROUP[m])).otherwise(own)
        nameless = [F.lit("") if c == "span_name" else F.col(c) for c in (*COMBINED, *SERVICE, *SPAN)]
        pick |= {f"gid{k}": own, f"cgid{k}": F.when(F.col("code") == CODES["service_destination"], F.xxhash64(*more, *nameless)).otherwise(F.lit(0).cast("bigint"))}
    return rows.withColumns(pick)
