"""The aggregation queries by name, and SQL that computes the same from the same tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import UNLIMITED, AggConfig, Limits
from .functions import keys
from .operators import limits as limiting
from .operators.partials import Partials, aggregate, merge
from .operators.rows import rows_of
from .plans.aggregator import Aggregator, aggregate_documents, harvest_range, is_aligned, not_expired
from .plans.documents import documents
from .sources import adapters
from .sources.work import work_dir
from .streaming.windows import replayed, stream_to_documents
from .telemetry import overflow_by_owner, overflow_counts

PLENTY = UNLIMITED
FREE = Limits.same(PLENTY)
HOUR = 3600


def config(limits: Limits = FREE, *seconds: int, partitions: int = 1) -> AggConfig:
    return AggConfig(limits, intervals=tuple(timedelta(seconds=s) for s in seconds or (HOUR,)), partitions=partitions, overflow_count_mode="exact")


def limited(**given: int) -> Limits:
    return Limits(**{f: given.get(f, PLENTY) for f in Limits.__dataclass_fields__})


def stamp(name: str) -> str:
    """An expression; modules must import before there is a session."""
    return f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') as ts"


def docs_of(events: DataFrame, cfg: AggConfig, *metricsets: str) -> DataFrame:
    out = aggregate_documents(events, cfg)
    return out.filter(F.col("metricset_name").isin(*metricsets)) if metricsets else out


SVC = ["svc_name", "svc_environment", "agent_name", "global_labels"]
TXN_OUT = ["cm_id", stamp("timestamp"), *SVC, "transaction_name", "transaction_type", "event_outcome", "trace_root", "faas_cold_start"]
NUMBERS = ["metricset_doc_count", "duration_sum", "event_success_count", "event_success_sum"]

# ---------------------------------------------------------------- SQL that queries share

#: Transactions: `x` has a row for each event, with its hour as bts.
X = """x as (
  select event_id as seq, 't' || (user_id % 2) as cm_id, ts, event_type as ttype, user_id as u, cast(json_extract_string(props, '$.k') as int) as k,
    'svc' || (user_id % 20) as svc_name, case user_id % 3 when 0 then 'dev' when 1 then 'qa' else 'prod' end as svc_environment, 'agent' || (user_id % 4) as agent_name,
    '{"labels":[{"key":"tier","value":"' || (cast(json_extract_string(props, '$.k') as int) % 3) || '","values":[]}],"numeric_labels":[]}' as global_labels,
    event_type || '/' || (cast(json_extract_string(props, '$.k') as int) % 25) as tname,
    case event_type when 'error' then 'failure' when 'view' then 'unknown' else 'success' end as outcome,
    cast(json_extract_string(props, '$.k') as int) % 5 = 0 as trace_root,
    case cast(json_extract_string(props, '$.k') as int) % 3 when 0 then true when 1 then false end as cold,
    1.0 + (cast(json_extract_string(props, '$.k') as int) % 4) * 0.5 as rep, cast(trunc(value * 1e6) as bigint) as ns
  from events),
"""


def b_sql(seconds: int = HOUR, where: str = "true", ns: str = "ns", rep: str = "rep") -> str:
    """`b`: transactions with interval start, histogram bucket (null if none takes it), its highest value and the scaled count."""
    us = f"(({ns}) // 1000)"
    fits = f"({ns}) >= 0 and {us} < 4294967296"
    return X + f"""v as (select *, case when {fits} then {us} end as us, {rep} as weight,
    to_timestamp(0)::timestamp + to_seconds(cast(floor(epoch(ts)) as bigint) - (cast(floor(epoch(ts)) as bigint) + 62135596800) % {seconds}) as bts from x where {where}),
  w as (select *, cast(length(bin(us | 255)) - 8 as int) as sh from v),
  b as (select *, ((sh + 1) << 7) + (us >> sh) - 128 as idx, (((us >> sh) + 1) << sh) - 1 as hi, cast(round(weight * 1000) as bigint) as scaled from w)"""


SVC_SQL = "cm_id, bts, svc_name, svc_environment, agent_name, global_labels"
TS_SQL = "strftime(bts, '%Y-%m-%d %H:%M:%S') as ts"
TKEY = "tname, ttype, outcome, trace_root, cold"


def hist_sql(keys: str, more: str = "") -> str:
    """`h`: (keys, n, dsum) from b; counts are rounded bucket by bucket."""
    return f""", q as (select {keys}, idx, hi, case when idx is not null and sum(scaled) > 0 then cast(round(sum(scaled) / 1000.0) as bigint) end as n{more} from b group by {keys}, idx, hi),
  h as (select {keys}, cast(coalesce(sum(n), 0) as bigint) as n, cast(coalesce(sum(n * hi), 0) as double) as dsum"""


def txn_sql(base: str) -> str:
    return "with " + base + hist_sql(f"{SVC_SQL}, {TKEY}") + f""" from q group by {SVC_SQL}, {TKEY})
  select cm_id, {TS_SQL}, svc_name, svc_environment, agent_name, global_labels, tname as transaction_name, ttype as transaction_type, outcome as event_outcome, trace_root, cold as faas_cold_start,
    n as metricset_doc_count, dsum as duration_sum, case when outcome in ('success', 'failure') then n else 0 end as event_success_count, cast(case when outcome = 'success' then n else 0 end as double) as event_success_sum from h"""


def svc_txn_sql(base: str) -> str:
    keys = f"{SVC_SQL}, ttype"
    return "with " + base + hist_sql(keys, ", sum(case when outcome = 'success' then weight else 0 end) as s, sum(case when outcome = 'failure' then weight else 0 end) as f") + f""", sum(s) as s, sum(f) as f from q group by {keys})
  select cm_id, {TS_SQL}, svc_name, svc_environment, agent_name, global_labels, ttype as transaction_type, n as metricset_doc_count, dsum as duration_sum,
    cast(round(s + f) as bigint) as event_success_count, cast(round(s) as double) as event_success_sum from h"""


SVC_TXN_OUT = ["cm_id", stamp("timestamp"), *SVC, "transaction_type", *NUMBERS]

#: Exit spans: `s` has a row for each line that is one, `a` a row for every line; bts is the start of the interval.
S = """a as (
  select (l_orderkey * 10 + l_linenumber) * 1000003 + (l_partkey * 31 + l_suppkey * 17 + cast(l_quantity as bigint) * 7 + cast(round(l_extendedprice * 100) as bigint) * 13) % 1000003 as seq,
    't0' as cm_id, 'supp' || (l_suppkey % 50) as svc_name, 'part' || (l_partkey % 40) as span_name,
    case l_returnflag when 'R' then 'failure' when 'A' then 'success' else 'unknown' end as span_outcome,
    case when l_linenumber % 3 = 0 then 'db' else '' end as target_type, case when l_linenumber % 3 = 0 then 't' || l_linenumber else '' end as target_name,
    case when l_linestatus = 'O' then 'res' || l_returnflag else '' end as resource,
    case when l_linenumber = 7 then 0.0 else 1.0 + l_partkey % 2 end as rep,
    case when l_partkey % 2 = 0 then cast(l_quantity as bigint) else 1 end as times,
    case when l_partkey % 2 = 0 then cast(trunc(l_quantity * 2.0 * 1e6) as bigint) else cast(trunc(l_extendedprice * 1000) as bigint) end as ns,
    to_timestamp(0)::timestamp + to_seconds(cast(epoch(l_shipdate::timestamp) as bigint) - (cast(epoch(l_shipdate::timestamp) as bigint) + 62135596800) % {seconds}) as bts
  from lineitem),
s as (select * from a where rep > 0 and (target_type <> '' or resource <> ''))"""
DAY = 64800  # eighteen hours, the longest interval
SPAN_KEY = "span_name, span_outcome, target_type, target_name, resource"
SPAN_OUT = ["svc_name", stamp("timestamp"), "span_name", "span_outcome", "target_type", "target_name", "resource", "metricset_doc_count", "response_count", "response_sum"]


def span_sql(extra: str = "") -> str:
    return "with " + S.format(seconds=DAY) + f"""
  select svc_name, {TS_SQL}, {SPAN_KEY}, cast(round(sum(times * rep)) as bigint) as metricset_doc_count, cast(round(sum(times * rep)) as bigint) as response_count, cast(round(sum(ns * rep)) as bigint) as response_sum
  from s group by svc_name, bts, {SPAN_KEY}{extra}"""


def txn(spark: SparkSession, d: str) -> DataFrame:
    return adapters.transactions(spark, d)


def spans(spark: SparkSession, d: str) -> DataFrame:
    return adapters.exit_spans(spark, d)


# ---------------------------------------------------------------- queries


def q01(spark, d):
    return docs_of(txn(spark, d), config(), "transaction").selectExpr(*TXN_OUT, *NUMBERS)


def q02(spark, d):
    rows = docs_of(txn(spark, d), config(), "service_transaction")
    pairs = F.explode(F.arrays_zip("histogram_values", "histogram_counts")).alias("p")
    return rows.select("cm_id", F.expr(stamp("timestamp")), *SVC, "transaction_type", pairs).select("*", F.col("p.histogram_values").alias("value"), F.col("p.histogram_counts").alias("n")).drop("p")


def q03(spark, d):
    return docs_of(txn(spark, d), config(), "service_transaction").selectExpr(*SVC_TXN_OUT)


def q04(spark, d):
    return docs_of(spans(spark, d), config(FREE, DAY), "service_destination").selectExpr(*SPAN_OUT)


def q05(spark, d):
    return docs_of(txn(spark, d), config(), "service_summary").selectExpr("cm_id", stamp("timestamp"), *SVC)


def q06(spark, d):
    return docs_of(txn(spark, d), config(), "service_destination").selectExpr("cm_id", stamp("timestamp"), *SVC, "span_outcome", "resource", "metricset_doc_count", "response_sum")


def q07(spark, d):
    rows = docs_of(txn(spark, d), config())
    return rows.groupBy("metricset_name", "metricset_interval", "cm_id").agg(F.count("*").alias("documents"), F.sum(F.coalesce("metricset_doc_count", F.lit(0))).alias("events"), F.sum(F.coalesce("duration_sum", F.lit(0.0))).alias("micros"))


def with_weight(events: DataFrame, weight) -> DataFrame:
    return events.withColumn("transaction", F.col("transaction").withField("representative_count", weight))


def q08(spark, d):
    odd = with_weight(txn(spark, d), (F.col("seq") % 7 + 1) * 0.1004)
    return docs_of(odd, config(), "service_transaction").selectExpr("cm_id", stamp("timestamp"), *SVC, "transaction_type", "metricset_doc_count", "duration_sum")


def q09(spark, d):
    e = txn(spark, d)
    ns = F.when(F.col("seq") % 10 == 0, F.lit(2**32 * 1000)).when(F.col("seq") % 10 == 1, F.lit(-5000)).when(F.col("seq") % 10 == 2, F.lit(2**32 * 1000 - 1)).otherwise(F.col("event.duration_ns"))
    return docs_of(e.withColumn("event", F.col("event").withField("duration_ns", ns)), config(), "service_transaction").selectExpr(*SVC_TXN_OUT)


def q10(spark, d):
    """Zero weights and spans that are no exit: documents of each kind by service name."""
    e = with_weight(txn(spark, d), F.when(F.col("seq") % 3 == 0, 0.0).when(F.col("seq") % 3 == 1, -1.0).otherwise(1.0))
    both = e.unionByName(spans(spark, d))
    return docs_of(both, config(FREE, DAY)).groupBy("metricset_name", "svc_name").agg(F.count("*").alias("documents"), F.sum(F.coalesce("metricset_doc_count", F.lit(0))).alias("events"))


def q11(spark, d):
    rows = docs_of(txn(spark, d), config(FREE, DAY), "transaction")
    return rows.groupBy("event_outcome").agg(F.sum("metricset_doc_count").alias("events"), F.sum("event_success_count").alias("success_count"), F.sum("event_success_sum").alias("success_sum"))


def q12(spark, d):
    rows = docs_of(txn(spark, d), config(FREE, 60, 600, 3600), "service_transaction")
    return rows.selectExpr("metricset_interval", *SVC_TXN_OUT)


def q13(spark, d):
    return docs_of(txn(spark, d), config(FREE, 420), "service_transaction").selectExpr(*SVC_TXN_OUT)


def q14(spark, d):
    """Labels in the service key; the values' order counts."""
    e = txn(spark, d)
    values = F.when(F.col("seq") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    labels = F.map_concat(F.col("labels"), F.create_map(F.lit("multi"), F.struct(F.lit(None).cast("string").alias("value"), values.alias("values"), F.lit(True).alias("global"))))
    rows = docs_of(e.withColumn("labels", labels), config(FREE, DAY), "service_summary")
    return rows.groupBy("global_labels").agg(F.count("*").alias("services"))


def q15(spark, d):
    rows = docs_of(txn(spark, d), config(FREE, DAY), "transaction")
    return rows.groupBy(F.coalesce(F.col("faas_cold_start").cast("string"), F.lit("absent")).alias("cold")).agg(F.count("*").alias("groups"), F.sum("metricset_doc_count").alias("events"))


def q16(spark, d):
    rows = docs_of(adapters.wide_transactions(spark, d), config(FREE, DAY), "transaction")
    return rows.selectExpr(stamp("timestamp"), "svc_name", "svc_language", "service_language_version", "service_version", "event_outcome", "transaction_name", "host_hostname", "cloud_provider", "cloud_region", "cloud_availability_zone", "metricset_doc_count", "duration_sum")


def limits_query(make=aggregate_documents, **given):
    def run(spark, d):
        rows = make(txn(spark, d), config(limited(**given))).filter(F.col("metricset_name").isin("transaction", "service_transaction", "service_summary"))
        named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("transaction_name", "transaction_type")]
        return rows.select("metricset_name", "cm_id", "svc_name", *named, F.coalesce("overflow_count", F.lit(0)).cast("long").alias("overflow_count"), F.coalesce("metricset_doc_count", F.lit(0)).alias("n"), F.coalesce("duration_sum", F.lit(0.0)).alias("dsum")).groupBy("metricset_name", "cm_id", "svc_name", "transaction_name", "transaction_type").agg(F.count("*").alias("documents"), F.sum("overflow_count").alias("overflowed"), F.sum("n").alias("events"), F.sum("dsum").alias("micros"))

    return run


def limits_sql(max_services=PLENTY, max_transaction_groups=PLENTY, max_transaction_groups_per_service=PLENTY, max_service_transaction_groups=PLENTY, max_service_transaction_groups_per_service=PLENTY) -> str:
    def part(name: str, key: str, per: int, total: int, show: str, other: str) -> str:
        return f""", {name}_g as (select {SVC_SQL}, {key}, min(seq) as f from b join ok using ({SVC_SQL}) group by {SVC_SQL}, {key}),
  {name}_c as (select * from (select *, row_number() over (partition by {SVC_SQL} order by f) as r from {name}_g) where r <= {per}),
  {name}_a as (select {SVC_SQL}, {key}, coalesce(cold, false) as c0, cold is null as c1 from (select *, row_number() over (partition by cm_id order by f) as r2 from {name}_c) where r2 <= {total}),
  {name}_r as (select b.*, case when a.svc_name is not null then 'group' when ok.svc_name is not null then 'service' else 'all' end as place from b
    left join ok on ({on("ok", SVC_SQL)}) left join {name}_a a on ({on("a", SVC_SQL + ", " + key)} and coalesce(b.cold, false) = a.c0 and (b.cold is null) = a.c1)),
  {name}_q as (select place, cm_id, case when place = 'all' then null else bts end as bts, case when place = 'all' then '_other' else svc_name end as svc_name, case when place = 'all' then '' else svc_environment end as e, case when place = 'all' then '' else agent_name end as ag, case when place = 'all' then '' else global_labels end as gl,
      {", ".join(f"case when place = 'group' then {c} end as {c}" for c in key.split(", "))}, idx, hi, cast(round(sum(scaled) / 1000.0) as bigint) as n, list(distinct ({SVC_SQL}, {key})) as held from {name}_r group by all),
  {name}_d as (select place, cm_id, bts, svc_name, e, ag, gl, {key}, sum(n) as n, sum(n * hi) as dsum, len(list_distinct(flatten(list(held)))) as o from {name}_q group by place, cm_id, bts, svc_name, e, ag, gl, {key}),
  {name}_o as (select '{show}' as metricset_name, cm_id, svc_name, {other}, case when place = 'group' then 0 else o end as o, n, dsum from {name}_d)"""

    def on(alias: str, columns: str) -> str:
        return " and ".join(f"b.{c} = {alias}.{c}" for c in columns.split(", ") if c != "cold")

    b = b_sql()
    txn_part = part("t", TKEY, max_transaction_groups_per_service, max_transaction_groups, "transaction", "case when place = 'group' then tname else '_other' end as transaction_name, coalesce(ttype, '') as transaction_type")
    svc_part = part("s", "ttype", max_service_transaction_groups_per_service, max_service_transaction_groups, "service_transaction", "'' as transaction_name, case when place = 'group' then ttype else '_other' end as transaction_type")
    svc_part = svc_part.replace(", coalesce(cold, false) as c0, cold is null as c1", "").replace(" and coalesce(b.cold, false) = a.c0 and (b.cold is null) = a.c1", "")
    return f"""with {b},
  sv as (select {SVC_SQL}, row_number() over (partition by cm_id order by min(seq)) as r from b group by {SVC_SQL}),
  ok as (select {SVC_SQL} from sv where r <= {max_services}){txn_part}{svc_part},
  u as (select * from t_o union all select * from s_o
    union all select 'service_summary', cm_id, svc_name, '', '', 0, 0, 0 from ok
    union all select 'service_summary', cm_id, '_other', '', '', count(*), 0, 0 from sv where r > {max_services} group by cm_id)
  select metricset_name, cm_id, svc_name, transaction_name, transaction_type, count(*) as documents, cast(sum(o) as bigint) as overflowed, cast(sum(n) as bigint) as events, cast(sum(dsum) as double) as micros from u group by 1, 2, 3, 4, 5"""


SPAN_LIMITS = {"max_span_groups": 1500, "max_span_groups_per_service": 6}


def q21(spark, d):
    rows = docs_of(spans(spark, d), config(limited(**SPAN_LIMITS), DAY), "service_destination")
    return rows.select("svc_name", F.expr(stamp("timestamp")), "span_name", "span_outcome", "target_type", "target_name", "resource", F.coalesce("overflow_count", F.lit(0)).cast("long").alias("overflow_count"), "metricset_doc_count", "response_count", "response_sum")


def q21_sql(total: int = SPAN_LIMITS["max_span_groups"], per: int = SPAN_LIMITS["max_span_groups_per_service"]) -> str:
    half = per // 2
    ckey = "span_outcome, target_type, target_name, resource"
    own = "svc_name, bts"

    def same(a: str, b: str, columns: str) -> str:
        return " and ".join(f"{a}.{c} = {b}.{c}" for c in columns.split(", "))

    return "with " + S.format(seconds=DAY) + f""",
  k as (select {own}, {SPAN_KEY}, min(seq) as f from s group by {own}, {SPAN_KEY}),
  p as (select *, row_number() over (partition by {own} order by f) as r from k),
  vb as (select {own}, {SPAN_KEY}, f, true as v from p where r <= {half}),
  re as (select {own}, '' as span_name, {ckey}, min(f) as f from p where r > {half} group by {own}, {ckey}),
  rf as (select re.* from re anti join vb using ({own}, {SPAN_KEY})),
  cl as (select {own}, {SPAN_KEY}, f, false as v from (select *, row_number() over (partition by {own} order by f) as r from rf) where r <= {per - half}),
  ad as (select * from (select *, row_number() over (order by f) as r from (select * from vb union all select * from cl)) where r <= {total}),
  bl as (select {own} from ad where v group by {own} having count(*) = {half}),
  ro as (select s.*, a.svc_name is not null as won, a.svc_name is null and c.svc_name is not null and bl.svc_name is not null as blanked from s
    left join ad a on ({same("s", "a", f"{own}, {SPAN_KEY}")}) left join ad c on ({same("s", "c", f"{own}, {ckey}")} and c.span_name = '') left join bl on ({same("s", "bl", own)})),
  gr as (select {own}, case when won then span_name else '' end as span_name, {ckey}, 0 as o, sum(times * rep) as n, sum(ns * rep) as t from ro where won or blanked group by all),
  ov as (select svc_name, bts, count(distinct ({SPAN_KEY})) as o, sum(times * rep) as n, sum(ns * rep) as t from ro where not won and not blanked group by svc_name, bts)
  select svc_name, {TS_SQL}, {SPAN_KEY}, cast(o as bigint) as overflow_count, cast(round(n) as bigint) as metricset_doc_count, cast(round(n) as bigint) as response_count, cast(round(t) as bigint) as response_sum from gr
  union all select svc_name, '2024-05-31 12:00:00', '', '', '', '_other', '', o, o, cast(round(n) as bigint), cast(round(t) as bigint) from ov"""


def q22(spark, d):
    """Overflow estimates by sketch, at the limits of q21."""
    cfg = AggConfig(limited(**SPAN_LIMITS), intervals=(timedelta(seconds=DAY),))
    rows = aggregate_documents(spans(spark, d), cfg).filter("overflow_count is not null")
    return rows.groupBy("metricset_name").agg(F.count("*").alias("documents"), F.sum("overflow_count").alias("overflowed"))


def q23(spark, d):
    """Four shards aggregated apart and merged."""
    events = txn(spark, d)
    whole = merge([aggregate(events.filter(F.col("seq") % 4 == i), [HOUR]) for i in range(4)])
    return documents(whole, [HOUR]).filter("metricset_name = 'service_transaction'").selectExpr(*SVC_TXN_OUT)


def q24(spark, d):
    """Two halves limited apart, then merged under the same limits; events are neither lost nor doubled."""
    limits, exact, folder = limited(max_transaction_groups_per_service=2), limiting.Distinct(True), work_dir(spark, "halves")
    halves = []
    for i in range(2):  # each half as another cluster would leave it
        limiting.admit(aggregate(txn(spark, d).filter(F.col("seq") % 2 == i), [HOUR]), limits, exact).save(f"{folder}/{i}")
        halves.append(Partials.load(spark, f"{folder}/{i}", overflowed=True, distinct=exact))
    rows = documents(limiting.admit(merge(halves), limits, exact), [HOUR], exact).filter("metricset_name = 'transaction'")
    return rows.groupBy("cm_id", "svc_name").agg(F.count_if(F.col("overflow_count").isNull()).alias("groups"), F.count_if(F.col("overflow_count").isNotNull()).alias("overflows"), F.sum("metricset_doc_count").alias("events"))


NOW = datetime(2024, 6, 1, 2, 0, 0)


def _spread_in_time(events: DataFrame) -> DataFrame:
    """Processing time 0 to 3 hours before the batch time's second hour, by seq."""
    return events.withColumn("processing_time", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-06-01 02:30:00").cast("timestamp")) - (F.col("seq") % 4) * HOUR))


def q25(spark, d):
    """Partials within a lookback of one hour at 02:00."""
    cfg = AggConfig(FREE, intervals=(timedelta(hours=1),), lookback=timedelta(hours=1))
    parts = aggregate(_spread_in_time(txn(spark, d)), cfg.interval_seconds).filter(not_expired(cfg, NOW))
    return parts.totals.select(F.date_format("processing_time", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "cm_id", "events_total")


def q26(spark, d):
    """The buckets that a harvest at 02:00 reads, for each aligned interval of 1 h and 2 h, with a lookback of one hour."""
    parts = aggregate(_spread_in_time(txn(spark, d)), [HOUR, 2 * HOUR, 3 * HOUR])
    cut = [parts.totals.filter(harvest_range(i, NOW, timedelta(hours=1))) for i in (HOUR, 2 * HOUR, 3 * HOUR) if is_aligned(i, NOW)]
    return cut[0].unionByName(cut[1]).select("interval_s", F.date_format("processing_time", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "cm_id", "events_total") if len(cut) == 2 else cut[0]


def q27(spark, d):
    """Eight partitions: totals still sum to the events, and partitions merge into what one partition gives."""
    parts = aggregate(txn(spark, d), [HOUR], 8)
    merged = parts.without_partition()
    rows = documents(merged, [HOUR]).filter("metricset_name = 'service_transaction'").selectExpr(*SVC_TXN_OUT)
    return rows


def q28(spark, d):
    totals = aggregate(txn(spark, d), [HOUR]).totals
    return totals.select("interval_s", "cm_id", "events_total", F.date_format("youngest", "yyyy-MM-dd HH:mm:ss").alias("youngest"))


TELEMETRY_LIMITS = {"max_services": 60, "max_transaction_groups_per_service": 3, "max_service_transaction_groups": 100}


def q29(spark, d):
    exact = limiting.Distinct(True)
    cut = limiting.admit(aggregate(txn(spark, d), [HOUR]).settled(spark, work_dir(spark, "groups")), limited(**TELEMETRY_LIMITS), exact)
    return overflow_counts(cut, exact)


def q30(spark, d):
    """The transactions as a stream: windows close, documents equal those of the batch job."""
    rows = stream_to_documents(spark, txn(spark, d), config()).filter("metricset_name = 'service_transaction'")
    return rows.selectExpr(*SVC_TXN_OUT)


def q32(spark, d):
    """Hour-old partials that come as a stream at 02:30, with a lookback of one hour: what is harvested, by bucket."""
    cfg = AggConfig(FREE, intervals=(timedelta(hours=1),), lookback=timedelta(hours=1))
    partials = rows_of(aggregate(_spread_in_time(txn(spark, d)), cfg.interval_seconds)).withColumn("arrived", F.lit("2024-06-01 02:30:00").cast("timestamp"))
    rows = replayed(spark, cfg, datetime(2024, 6, 1, 2, 30), partials=partials).filter("metricset_name = 'service_transaction'")
    return rows.groupBy(F.date_format("processing_time", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "cm_id").agg(F.count("*").alias("documents"), F.sum("metricset_doc_count").alias("events"))


def q33(spark, d):
    """Partials of two halves, as streams of their own would leave them, merged by a stream of the next level."""
    cfg = config()
    halves = [rows_of(aggregate(txn(spark, d).filter(F.col("seq") % 2 == i), [HOUR]), limiting.Distinct(True)) for i in range(2)]
    arrived = F.lit(adapters.BATCH_TIME).cast("timestamp")
    rows = replayed(spark, cfg, datetime(2024, 6, 1), partials=halves[0].unionByName(halves[1]).withColumn("arrived", arrived))
    return rows.filter("metricset_name = 'service_transaction'").selectExpr(*SVC_TXN_OUT)


def q34(spark, d):
    """The aggregator itself: four batches of each tenant taken in, one harvest, the rest at the end."""
    folder, cfg = work_dir(spark, "facade"), config(FREE, HOUR, 2 * HOUR)

    def sink(rows, interval_s):
        rows.withColumn("seconds", F.lit(interval_s)).write.mode("append").parquet(f"{folder}/documents")

    agg, events = Aggregator(spark, cfg), txn(spark, d)
    for i in range(4):
        agg.aggregate_batch(f"t{i % 2}", events.filter((F.col("seq") % 2 == i // 2) & (F.col("cm_id") == f"t{i % 2}")))
    agg.harvest(datetime(2024, 6, 1, 1), sink)
    agg.close(datetime(2024, 6, 1, 1), sink)
    return spark.read.parquet(f"{folder}/documents").filter(f"metricset_name = 'service_transaction' and seconds = {HOUR}").selectExpr(*SVC_TXN_OUT)


def q35(spark, d):
    """Sortable keys of the buckets, and what they are decoded to."""
    totals = aggregate(_spread_in_time(txn(spark, d)), [HOUR, 2 * HOUR]).totals.withColumn("key", keys.encoded())
    back = keys.decoded(F.col("key"))
    return totals.select(F.hex("key").alias("key"), back["interval_s"].alias("interval_s"), F.date_format(back["processing_time"], "yyyy-MM-dd HH:mm:ss").alias("bucket"), back["cm_id"].alias("cm_id"), back["partition_id"].alias("partition_id"), "events_total")


def q36(spark, d):
    """Overflow estimates at the limits of q21 beside exact counts: how many buckets, the exact sum, whether each estimate is within 5 per cent (or 2)."""
    whole = aggregate(spans(spark, d), [DAY]).settled(spark, work_dir(spark, "groups"))
    counted = []
    for name, kind in (("exact", limiting.Distinct(True)), ("sketch", limiting.Distinct())):
        rows = overflow_by_owner(limiting.admit(whole, limited(**SPAN_LIMITS), kind), kind).filter("overflowed > 0")
        counted.append(rows.withColumnRenamed("overflowed", name))
    both = counted[0].join(counted[1], [c for c in counted[0].columns if c != "exact"])
    close = F.abs(F.col("sketch") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.05 * F.col("exact"))
    return both.groupBy(F.col("aggregation_type").alias("metricset_name")).agg(F.count("*").alias("documents"), F.sum("exact").alias("overflowed"), F.min(close).alias("all_close"))


Q17 = {"max_services": 60}
Q18 = {"max_transaction_groups_per_service": 2}
Q19 = {"max_transaction_groups": 500}
Q20 = {"max_service_transaction_groups_per_service": 1, "max_service_transaction_groups": 300}

QUERIES = {
    "q01_txn_hourly": q01,
    "q02_txn_histogram_rows": q02,
    "q03_service_transaction": q03,
    "q04_span_destination": q04,
    "q05_service_summary": q05,
    "q06_dropped_span_stats": q06,
    "q07_all_metricsets": q07,
    "q08_weights_and_rounding": q08,
    "q09_unrecordable_durations": q09,
    "q10_zero_weight_no_exit": q10,
    "q11_outcome_matrix": q11,
    "q12_multi_interval": q12,
    "q13_seven_minutes": q13,
    "q14_global_labels": q14,
    "q15_cold_start": q15,
    "q16_wide_key": q16,
    "q17_service_limit": limits_query(**Q17),
    "q18_txn_per_service_limit": limits_query(**Q18),
    "q19_txn_total_limit": limits_query(**Q19),
    "q20_service_txn_limits": limits_query(**Q20),
    "q21_span_limits": q21,
    "q22_overflow_estimates": q22,
    "q23_merge_of_shards": q23,
    "q24_merge_with_overflow": q24,
    "q25_lookback": q25,
    "q26_harvest_range": q26,
    "q27_partitions": q27,
    "q28_totals": q28,
    "q29_overflow_counts": q29,
    "q30_stream_equals_batch": q30,
    "q31_stream_admission": limits_query(lambda events, cfg: stream_to_documents(events.sparkSession, events, cfg), **Q18),
    "q32_stream_lookback": q32,
    "q33_stream_of_partials": q33,
    "q34_aggregator": q34,
    "q35_sortable_keys": q35,
    "q36_estimate_bounds": q36,
}

_SVC_TXN = svc_txn_sql(b_sql())


def _shift_sql(select: str) -> str:
    return "with " + X + f"""y as (select cm_id, timestamp '2024-06-01 02:30:00' - to_seconds(cast(seq % 4 as bigint) * 3600) as pt from x) {select}"""


def _floor(seconds: int) -> str:
    return f"to_timestamp(0)::timestamp + to_seconds(cast(floor(epoch(pt)) as bigint) - (cast(floor(epoch(pt)) as bigint) + 62135596800) % {seconds})"


def drops_sql(base: str) -> str:
    """Dropped-span groups of transactions."""
    return "with " + base + f""", z as (select *, unnest(generate_series(1, k % 4)) as i from b where k % 4 > 0)
  select cm_id, bts, svc_name, svc_environment, agent_name, global_labels, (k + i) % 7 as drop, cast(round(sum((i + 1) * rep)) as bigint) as metricset_doc_count, cast(round(sum(i * 1000000 * rep)) as bigint) as response_sum
  from z group by {SVC_SQL}, (k + i) % 7"""


def all_metricsets_sql() -> str:
    parts = {
        "transaction": f"select cm_id, metricset_doc_count as n, duration_sum as us from ({txn_sql(b_sql())})",
        "service_transaction": f"select cm_id, metricset_doc_count as n, duration_sum as us from ({_SVC_TXN})",
        "service_destination": f"select cm_id, metricset_doc_count as n, 0.0 as us from ({drops_sql(b_sql())})",
        "service_summary": f"select cm_id, 0 as n, 0.0 as us from (with {b_sql()} select distinct {SVC_SQL} from b)",
    }
    return " union all ".join(f"select '{m}' as metricset_name, '60m' as metricset_interval, cm_id, count(*) as documents, cast(sum(n) as bigint) as events, cast(sum(us) as double) as micros from ({q}) group by cm_id" for m, q in parts.items())


def zero_weight_sql() -> str:
    some = b_sql(DAY, "seq % 3 = 2", rep="1.0")
    drops = drops_sql(some).replace("* rep", "* 1.0")
    parts = {
        "transaction": f"select svc_name, metricset_doc_count as n from ({txn_sql(some)})",
        "service_transaction": f"select svc_name, metricset_doc_count as n from ({svc_txn_sql(some)})",
        "service_destination": f"select svc_name, metricset_doc_count as n from ({drops}) union all select svc_name, metricset_doc_count as n from ({span_sql()})",
        "service_summary": f"select svc_name, 0 as n from (with {b_sql(DAY)} select distinct {SVC_SQL} from b) union all select svc_name, 0 as n from (with {S.format(seconds=DAY)} select distinct svc_name, bts from a)",
    }
    return " union all ".join(f"select '{m}' as metricset_name, svc_name, count(*) as documents, cast(sum(n) as bigint) as events from ({q}) group by svc_name" for m, q in parts.items())


def wide_sql() -> str:
    keys = "svc_name, service_version, event_outcome, transaction_name, region, nation"
    return f"""with o as (
    select c_mktsegment as svc_name, o_orderstatus as service_version, case o_orderstatus when 'F' then 'failure' else 'success' end as event_outcome, o_orderpriority as transaction_name, r_name as region, n_name as nation,
      o_custkey % 1000 * 1000 as us, to_timestamp(0)::timestamp + to_seconds(cast(floor(epoch(o_orderdate::timestamp)) as bigint) - (cast(floor(epoch(o_orderdate::timestamp)) as bigint) + 62135596800) % {DAY}) as bts
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  h as (select *, cast(length(bin(us | 255)) - 8 as int) as sh from o)
  select {TS_SQL}, svc_name, 'go' as svc_language, '1' as service_language_version, service_version, event_outcome, transaction_name, region as host_hostname, 'aws' as cloud_provider, region as cloud_region, nation as cloud_availability_zone,
    count(*) as metricset_doc_count, cast(sum((((us >> sh) + 1) << sh) - 1) as double) as duration_sum from h group by bts, {keys}"""


def same_sql(a: str, b: str, columns: str) -> str:
    return " and ".join(f"{a}.{c} is not distinct from {b}.{c}" for c in columns.split(", "))


def merge_with_overflow_sql(per: int = 2) -> str:
    key = f"{SVC_SQL}, {TKEY}"
    return "with " + b_sql() + f""",
  g as (select seq % 2 as half, {key}, min(seq) as f from b group by all),
  c as (select * from (select *, row_number() over (partition by half, {SVC_SQL} order by f) as r from g) where r <= {per}),
  m as (select {key}, min(f) as f from c group by {key}),
  e as (select * from (select *, row_number() over (partition by {SVC_SQL} order by f) as r from m) where r <= {per}),
  p as (select b.*, c.f is not null and e.f is not null as won from b left join c on (c.half = b.seq % 2 and {same_sql("b", "c", key)}) left join e on ({same_sql("b", "e", key)})),
  n as (select won, {SVC_SQL}, {", ".join(f"case when won then {c} end as {c}" for c in TKEY.split(", "))}, idx, cast(round(sum(scaled) / 1000.0) as bigint) as n from p group by all),
  d as (select won, {key}, sum(n) as n from n group by all)
  select cm_id, svc_name, count(*) filter (won) as groups, count(*) filter (not won) as overflows, cast(sum(n) as bigint) as events from d group by 1, 2"""


def overflow_counts_sql(max_services: int, max_transaction_groups_per_service: int, max_service_transaction_groups: int) -> str:
    return "with " + b_sql() + f""",
  sv as (select {SVC_SQL}, row_number() over (partition by cm_id order by min(seq)) <= {max_services} as known from b group by {SVC_SQL}),
  k as (select b.*, sv.known from b join sv using ({SVC_SQL})),
  t as (select cm_id, known, row_number() over (partition by {SVC_SQL} order by min(seq)) as r from k group by {SVC_SQL}, known, {TKEY}),
  s as (select cm_id, known, row_number() over (partition by cm_id, known order by min(seq)) as r from k group by {SVC_SQL}, known, ttype),
  d as (select distinct {SVC_SQL}, (k + i) % 7 as resource from (select *, unnest(generate_series(1, k % 4)) as i from k where k % 4 > 0 and not known)),
  u as (select cm_id, 'service' as aggregation_type from sv where not known
    union all select cm_id, 'transaction' from t where not known or r > {max_transaction_groups_per_service}
    union all select cm_id, 'service_transaction' from s where not known or r > {max_service_transaction_groups}
    union all select cm_id, 'service_destination' from d)
  select {HOUR} as interval_s, cm_id, aggregation_type, count(*) as overflowed from u group by 1, 2, 3"""


def harvest_range_sql() -> str:
    parts = [f"select {s} as interval_s, strftime({_floor(s)}, '%Y-%m-%d %H:%M:%S') as bucket, cm_id, cast(count(*) as double) as events_total from y where {_floor(s)} >= timestamp '2024-06-01 02:00:00' - to_seconds({s + HOUR}) and {_floor(s)} < timestamp '2024-06-01 02:00:00' group by 1, 2, 3" for s in (HOUR, 2 * HOUR)]
    return _shift_sql(" union all ".join(parts))


def stream_lookback_sql() -> str:
    parts = [f"select '2024-06-01 0{2 - shift}:00:00' as bucket, cm_id, count(*) as documents, cast(sum(metricset_doc_count) as bigint) as events from ({svc_txn_sql(b_sql(HOUR, f'seq % 4 = {shift}'))}) group by cm_id" for shift in (0, 1)]
    return " union all ".join(parts)


def sortable_keys_sql() -> str:
    parts = [f"select {s} as interval_s, {_floor(s)} as bt, cm_id, cast(count(*) as double) as events_total from y group by 1, 2, 3" for s in (HOUR, 2 * HOUR)]
    return _shift_sql("select upper(printf('%04x%016x', interval_s, cast(epoch(bt) as bigint)) || rpad(hex(cm_id), 32, '0') || '0000') as key, interval_s, strftime(bt, '%Y-%m-%d %H:%M:%S') as bucket, cm_id, 0 as partition_id, events_total from (" + " union all ".join(parts) + ")")


ORACLE_SQL = {
    "q31_stream_admission": limits_sql(**Q18),
    "q32_stream_lookback": stream_lookback_sql(),
    "q33_stream_of_partials": _SVC_TXN,
    "q34_aggregator": _SVC_TXN,
    "q35_sortable_keys": sortable_keys_sql(),
    "q36_estimate_bounds": f"select 'service_destination' as metricset_name, count(*) as documents, cast(sum(overflow_count) as bigint) as overflowed, true as all_close from ({q21_sql()}) where overflow_count > 0 having count(*) > 0",
    "q07_all_metricsets": all_metricsets_sql(),
    "q10_zero_weight_no_exit": zero_weight_sql(),
    "q16_wide_key": wide_sql(),
    "q24_merge_with_overflow": merge_with_overflow_sql(),
    "q26_harvest_range": harvest_range_sql(),
    "q29_overflow_counts": overflow_counts_sql(**TELEMETRY_LIMITS),
    "q30_stream_equals_batch": _SVC_TXN,
    "q01_txn_hourly": txn_sql(b_sql()),
    "q02_txn_histogram_rows": "with " + b_sql() + f"""
  select cm_id, {TS_SQL}, svc_name, svc_environment, agent_name, global_labels, ttype as transaction_type, cast(hi as double) as value, cast(round(sum(scaled) / 1000.0) as bigint) as n from b where idx is not null group by {SVC_SQL}, ttype, hi having sum(scaled) > 0""",
    "q03_service_transaction": _SVC_TXN,
    "q04_span_destination": span_sql(),
    "q05_service_summary": "with " + b_sql() + f" select distinct cm_id, {TS_SQL}, svc_name, svc_environment, agent_name, global_labels from b",
    "q06_dropped_span_stats": "with " + b_sql() + f""", z as (select *, unnest(generate_series(1, k % 4)) as i from b where k % 4 > 0)
  select cm_id, {TS_SQL}, svc_name, svc_environment, agent_name, global_labels, 'success' as span_outcome, 'drop' || ((k + i) % 7) as resource, cast(round(sum((i + 1) * rep)) as bigint) as metricset_doc_count, cast(round(sum(i * 1000000 * rep)) as bigint) as response_sum
  from z group by {SVC_SQL}, (k + i) % 7""",
    "q08_weights_and_rounding": f"select cm_id, ts, svc_name, svc_environment, agent_name, global_labels, transaction_type, metricset_doc_count, duration_sum from ({svc_txn_sql(b_sql(rep='(seq % 7 + 1) * 0.1004'))})",
    "q09_unrecordable_durations": svc_txn_sql(b_sql(ns="case seq % 10 when 0 then 4294967296000 when 1 then -5000 when 2 then 4294967295999 else ns end")),
    "q11_outcome_matrix": f"select event_outcome, cast(sum(metricset_doc_count) as bigint) as events, cast(sum(event_success_count) as bigint) as success_count, sum(event_success_sum) as success_sum from ({txn_sql(b_sql(DAY))}) group by 1",
    "q12_multi_interval": " union all ".join(f"select '{name}' as metricset_interval, * from ({svc_txn_sql(b_sql(s))})" for s, name in ((60, "1m"), (600, "10m"), (3600, "60m"))),
    "q13_seven_minutes": svc_txn_sql(b_sql(420)),
    "q14_global_labels": "with " + b_sql(DAY) + """, l as (select *, replace(global_labels, '"labels":[', '"labels":[{"key":"multi","value":"","values":' || case when seq % 2 = 0 then '["a","b"]' else '["b","a"]' end || '},') as gl from b)
  select gl as global_labels, count(*) as services from (select distinct cm_id, bts, svc_name, svc_environment, agent_name, gl from l) group by 1""",
    "q15_cold_start": f"select coalesce(cast(faas_cold_start as varchar), 'absent') as cold, count(*) as groups, cast(sum(metricset_doc_count) as bigint) as events from ({txn_sql(b_sql(DAY))}) group by 1",
    "q17_service_limit": limits_sql(**Q17),
    "q18_txn_per_service_limit": limits_sql(**Q18),
    "q19_txn_total_limit": limits_sql(**Q19),
    "q20_service_txn_limits": limits_sql(**Q20),
    "q21_span_limits": q21_sql(),
    "q23_merge_of_shards": _SVC_TXN,
    "q25_lookback": _shift_sql(f"select strftime({_floor(3600)}, '%Y-%m-%d %H:%M:%S') as bucket, cm_id, cast(count(*) as double) as events_total from y where {_floor(3600)} >= timestamp '2024-06-01 01:00:00' group by 1, 2"),
    "q27_partitions": _SVC_TXN,
    "q28_totals": "with " + b_sql() + " select 3600 as interval_s, cm_id, cast(count(*) as double) as events_total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as youngest from b group by cm_id",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
