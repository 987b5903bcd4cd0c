"""Cardinality limits: which services and groups are admitted, and what the others fold into.

Within one combined key services are admitted in order of arrival; so are the groups of an admitted service, up to the limit per
service and then the total. All partial rows are written once, in the long form, and so are their distinct keys (128-bit ids
with their first arrival). One look at the numbers of keys tells which limits are reached at all; only those are ranked, over
keys, and the ranks end in one table of routes: what became of each key. Rows meet it in one join. Spark's window group limit cuts
the ranks within a service before they are shuffled, and so does the rank within the combined key, which sees the candidates only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Limits
from ..schema import COMBINED, GROUP, HISTOGRAM, SERVICE, SUMS
from ..sources.work import work_dir
from .partials import Partials

SKETCH_PRECISION = 14
_SID, _GID, _CGID = ["sid1", "sid2"], ["gid1", "gid2"], ["cgid1", "cgid2"]
#: Where a row goes: its group, the overflow of its service, that of the combined key.
IN_GROUP, OF_SERVICE, OF_ALL = 1, 2, 3


@dataclass(frozen=True)
class Distinct:
    """How overflowed keys are counted: sketches, or (for tests on small data) sets."""

    exact: bool = False

    @property
    def kind(self) -> str:
        return "array<bigint>" if self.exact else "binary"

    def of(self, key: Column) -> Column:
        return F.collect_set(key) if self.exact else F.hll_sketch_agg(key, F.lit(SKETCH_PRECISION))

    def union(self, sketch: Column) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(sketch))) if self.exact else F.hll_union_agg(sketch)

    def both(self, a: Column, b: Column) -> Column:
        return F.array_union(a, b) if self.exact else F.hll_union(a, b)

    def either(self, fresh: str, n_fresh: str, before: str, n_before: str) -> Column:
        """The union of two sketches of which one may stand for nothing."""
        both = F.when((F.col(n_fresh) > 0) & (F.col(n_before) > 0), self.both(F.col(fresh), F.col(before)))
        return F.coalesce(both, F.when(F.col(n_fresh) > 0, F.col(fresh)), F.when(F.col(n_before) > 0, F.col(before)))

    def count(self, sketch: Column) -> Column:
        return (F.coalesce(F.size(sketch), F.lit(0)) if self.exact else F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))).cast("long")


def ids(frame: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Two independent hashes of the columns: an id to join and to count by."""
    return frame.withColumns({names[0]: F.xxhash64(*columns), names[1]: F.xxhash64(F.lit("second"), *columns)})


def first_within(keys: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first keys of each part, in order of arrival."""
    return keys.withColumn("r", F.row_number().over(W.partitionBy(*COMBINED, *by).orderBy("first", *_GID))).filter(F.col("r") <= limit).drop("r")


def admitted_spans(keys: DataFrame, total: int, per_service: int) -> tuple[DataFrame, DataFrame]:
    """(admitted keys with their final id, services whose new span names are blanked).

    keys carry cgid1 and cgid2, their ids without the span's name. Up to half of the limit per service full keys
    are taken as they are; the rest of the room goes to keys without name, once all of those are in.
    """
    half = per_service // 2
    placed = keys.withColumn("r", F.row_number().over(W.partitionBy(*COMBINED, *_SID).orderBy("first", *_GID)))
    # A key without name that is among the first has gid = cgid; those that share its cgid have no place of their own.
    verbatim = F.col("r") <= half
    both = placed.groupBy(*COMBINED, *_SID, F.when(verbatim, F.col("gid1")).otherwise(F.col("cgid1")).alias("gid1"), F.when(verbatim, F.col("gid2")).otherwise(F.col("cgid2")).alias("gid2")).agg(F.max(verbatim).alias("verbatim"), F.min("first").alias("first"), F.min(F.when(verbatim, F.col("first"))).alias("own"))
    both = both.withColumn("first", F.coalesce("own", "first")).drop("own")
    room = F.row_number().over(W.partitionBy(*COMBINED, *_SID, "verbatim").orderBy("first", *_GID))
    both = both.withColumn("r", room).filter(F.col("verbatim") | (F.col("r") <= per_service - half)).drop("r")
    won = first_within(both, [], total)
    if half == 0:
        return won.select(*_GID), keys.select(*_SID).distinct()
    return won.select(*_GID), won.filter("verbatim").groupBy(*_SID).count().filter(F.col("count") == half).select(*_SID)


def reached(keys: DataFrame, limits: Limits) -> set[int]:
    """Codes of the metricsets (0: services) of which some combined key has more than a limit lets in as it is."""
    from .rows import CODES, PRESENCE

    per = keys.groupBy("code", *COMBINED, *_SID).agg(F.count("*").alias("n")).groupBy("code", *COMBINED).agg(F.sum("n").alias("total"), F.max("n").alias("per"))
    found = {r["code"]: (r["total"], r["per"]) for r in per.groupBy("code").agg(F.max("total").alias("total"), F.max("per").alias("per")).collect()}
    out = {PRESENCE} if found.get(PRESENCE, (0,))[0] > limits.max_services else set()
    for m, code in CODES.items():
        total, per_service = limits.of(m)
        n, own = found.get(code, (0, 0))
        if n > total or own > (per_service // 2 if m == "service_destination" else per_service):  # from half on names are blanked
            out.add(code)
    return out


def routes(keys: DataFrame, limits: Limits, over: set[int]) -> DataFrame | None:
    """(code, gid1, gid2, place, blanked) of the keys that a reached limit concerns; code 0: of services, by their ids."""
    from .rows import CODES, PRESENCE

    if not over:
        return None
    inside, parts, known = F.lit(IN_GROUP), [], None
    if PRESENCE in over:
        services = keys.filter(F.col("code") == PRESENCE)
        known = services.withColumn("r", F.row_number().over(W.partitionBy(*COMBINED).orderBy("first", *_SID))).filter(F.col("r") <= limits.max_services).select(*_SID, F.lit(True).alias("known"))
        parts.append(services.join(known, _SID, "left").select("code", F.col("sid1").alias("gid1"), F.col("sid2").alias("gid2"), F.when(F.col("known"), inside).otherwise(OF_ALL).alias("place"), F.lit(False).alias("blanked")))
    for m, code in CODES.items():
        if code not in over and known is None:
            continue
        own, (total, per_service) = keys.filter(F.col("code") == code), limits.of(m)
        own = own.withColumn("known", F.lit(True)) if known is None else own.join(known, _SID, "left")
        fits, blanked = F.lit(True), F.lit(False)
        if code in over:
            candidates = own.filter("known").drop("known")
            if m == "service_destination":
                won, blanking = admitted_spans(candidates, total, per_service)
                own = own.join(won.withColumn("won", F.lit(True)), _GID, "left").join(won.select(F.col("gid1").alias("cgid1"), F.col("gid2").alias("cgid2"), F.lit(True).alias("won_blank")), _CGID, "left").join(blanking.withColumn("blanks", F.lit(True)), _SID, "left")
                blanked = F.col("won").isNull() & F.coalesce(F.col("blanks") & F.col("won_blank"), F.lit(False))
            else:
                won = first_within(first_within(candidates, _SID, per_service), [], total).select(*_GID)
                own = own.join(won.withColumn("won", F.lit(True)), _GID, "left")
            fits = F.col("won").isNotNull() | blanked
        place = F.when(F.col("known").isNull(), OF_ALL).when(fits, inside).otherwise(OF_SERVICE)
        parts.append(own.select("code", *_GID, place.alias("place"), (blanked & F.col("known").isNotNull()).alias("blanked")))
    return reduce(DataFrame.unionByName, parts)


def admit(partials: Partials, limits: Limits, distinct: Distinct = Distinct(), folder: str | None = None) -> Partials:
    """The partials within the limits, with everything else in overflow rows; written to the folder (a work folder without one)."""
    from .rows import CODES, MEASURES, PRESENCE, SERVICES, partials_of, rows_of, with_ids

    spark = partials.totals.sparkSession
    folder = folder or work_dir(spark, "limits")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    rows = stored(with_ids(rows_of(partials, distinct)), "rows")
    whole = partials_of(rows)
    own = rows.filter(F.col("code").isin(PRESENCE, *CODES.values()) & ~F.col("over"))
    keys = stored(own.groupBy("code", *COMBINED, *_SID, *_GID, *_CGID).agg(F.min("first").alias("first")), "keys")
    over = reached(keys, limits)
    told = routes(keys, limits, over)
    if told is None and partials.overflow is None:
        return whole  # all is let in; the overflow tables have no rows
    # Overflow rows from before go where their service goes.
    of_service = F.col("over") | (F.col("code") == PRESENCE)
    rows = rows.withColumns({"route": F.when(of_service, PRESENCE).otherwise(F.col("code")), "id1": F.when(of_service, F.col("sid1")).otherwise(F.col("gid1")), "id2": F.when(of_service, F.col("sid2")).otherwise(F.col("gid2"))})
    if told is None:
        rows = rows.withColumns({"told": F.lit(None).cast("int"), "blanked": F.lit(False)})
    else:
        told = stored(told, "routes").select(F.col("code").alias("route"), F.col("gid1").alias("id1"), F.col("gid2").alias("id2"), F.col("place").alias("told"), "blanked")
        rows = rows.join(told, ["route", "id1", "id2"], "left")
    named, told_all = F.col("svc_name").isNotNull(), F.col("told") == OF_ALL
    place = F.when(F.col("over"), F.when(~named | told_all, OF_ALL).otherwise(OF_SERVICE)).otherwise(F.coalesce("told", F.lit(IN_GROUP)))
    rows = rows.withColumns({"place": place, "span_name": F.when(F.col("blanked"), F.lit("")).otherwise(F.col("span_name"))})
    sums = [F.sum(c).alias(c) for c in MEASURES]
    inside, groups = rows.filter(F.col("place") == IN_GROUP), {}
    for m, code in CODES.items():
        own = inside.filter((F.col("code") == code) & ~F.col("over")).select(*COMBINED, *SERVICE, *GROUP[m], *(["bucket", "scaled"] if m in HISTOGRAM else []), *SUMS[m], "first")
        if m == "service_destination":  # keys whose names were blanked meet here; all others have a row each
            own = own.groupBy(*COMBINED, *SERVICE, *GROUP[m]).agg(*[F.sum(c).alias(c) for c in SUMS[m]], F.min("first").alias("first"))
        groups[m] = own
    # A group's id covers its service, so equal keys of two services stay two.
    turned = rows.filter(F.col("place") != IN_GROUP).withColumns({c: F.when(F.col("place") == OF_SERVICE, F.col(c)) for c in SERVICES} | {"id": F.when(~F.col("over"), F.col("id1"))})
    turned = turned.groupBy("code", *COMBINED, *SERVICES, "bucket").agg(*sums, distinct.of(F.col("id")).alias("fresh"), F.count("id").alias("n_fresh"), distinct.union(F.col("sketch")).alias("before"), F.count("sketch").alias("n_before"))
    turned = stored(turned.withColumn("sketch", distinct.either("fresh", "n_fresh", "before", "n_before")).drop("fresh", "n_fresh", "before", "n_before"), "turned")
    overflow = {m: turned.filter(F.col("code") == code).select(*COMBINED, *SERVICE, *(["bucket", "scaled"] if m in HISTOGRAM else []), *SUMS[m], "sketch") for m, code in CODES.items()}
    lost = turned.filter(F.col("code") == PRESENCE).select(*COMBINED, "sketch")
    services = inside.filter((F.col("code") == PRESENCE) & ~F.col("over")).select(*COMBINED, *SERVICE, "first")
    return Partials(groups, services, whole.totals, overflow, lost)
