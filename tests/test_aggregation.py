from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanfold.config import UNLIMITED, AggConfig, Limits
from spanfold.operators.partials import aggregate, merge
from spanfold.plans.aggregator import Aggregator, AggregatorClosed, aggregate_documents, is_aligned
from spanfold.plans.documents import documents, nested
from spanfold.schema import event_schema
from spanfold.sources.readers import MemorySink

T0 = datetime(1970, 1, 1)
FREE = Limits.same(UNLIMITED)


def event(seq, kind="transaction", **given):
    base = {"seq": seq, "cm_id": "t", "processing_time": T0, "event_type": kind, "timestamp": T0}
    return base | given


def txn(seq, name="foo", type="txtype", ms=100, outcome="success", rep=1.0, service="svc", **more):
    return event(seq, event={"duration_ns": ms * 1000000, "outcome": outcome, "received": T0}, service={"name": service}, transaction={"name": name, "type": type, "result": "", "representative_count": rep, "dropped_spans_stats": more.pop("drops", None)}, **more)


def span(seq, resource="db", outcome="success", rep=1.0, ms=100, service="svc", agent="java", **more):
    return event(seq, "span", event={"duration_ns": ms * 1000000, "outcome": outcome, "received": T0}, service={"name": service, "target": more.pop("target", None)}, agent={"name": agent}, span={"name": more.pop("name", ""), "representative_count": rep, "destination_service": {"resource": resource}, "composite": more.pop("composite", None)}, **more)


def frame(spark, rows):
    def fit(value, kind):
        if value is None or kind.typeName() not in ("struct",):
            return value
        return tuple(fit(value.get(f.name), f.dataType) for f in kind)

    schema = event_schema()
    return spark.createDataFrame([tuple(fit(r.get(f.name), f.dataType) for f in schema) for r in rows], schema)


def docs(spark, rows, seconds=(1,), limits=FREE, **more):
    return aggregate_documents(frame(spark, rows), AggConfig(limits, intervals=tuple(timedelta(seconds=s) for s in seconds), overflow_count_mode="exact", **more))


def test_success_case(spark):
    label = lambda v, g: Row(value=v, values=[], **{"global": g})
    rows = [txn(1, labels={"a": label("1", True), "b": label("2", False)}, numeric_labels={"n": label(2.5, True)})]
    out = {r.metricset.name: r for r in nested(docs(spark, rows)).collect()}
    assert set(out) == {"transaction", "service_transaction", "service_summary"}
    t = out["transaction"]
    assert t.metricset.doc_count == 1 and t.metricset.interval == "1s" and t.transaction.root
    assert (t.transaction.duration_summary["count"], t.transaction.duration_summary.sum) == (1, 100351)
    assert (t.transaction.duration_histogram["values"], t.transaction.duration_histogram.counts) == ([100351], [1])
    assert (t.event.success_count["count"], t.event.success_count.sum, t.event.outcome) == (1, 1, "success")
    assert set(t.labels) == {"a"} and set(t.numeric_labels) == {"n"} and t.host is None and t.cloud is None
    assert out["service_transaction"].event.outcome is None and out["service_summary"].metricset.doc_count is None


def test_routing(spark):
    rows = [txn(1, rep=0.0), event(2, "log", service={"name": "svc"}), span(3, resource=""), span(4, rep=0.0), span(5, resource="", target={"type": "", "name": ""}), span(6, composite={"count": 3, "sum_ms": 1.5}, rep=2.0)]
    got = docs(spark, rows).select("metricset_name", "agent_name", "resource", "response_count", "response_sum").collect()
    spans = {(r.resource, r.response_count, r.response_sum) for r in got if r.metricset_name == "service_destination"}
    assert spans == {("", 1, 100000000), ("db", 6, 3000000)}
    assert not [r for r in got if "transaction" in r.metricset_name]
    assert aggregate(frame(spark, rows), [1]).totals.first().events_total == 6


def test_outcomes_and_unrecordable(spark):
    rows = [txn(1, outcome="success", rep=1.5), txn(2, outcome="failure", rep=2.0), txn(3, outcome="unknown"), txn(4, ms=2**32 // 1000 + 1, outcome="success"), txn(5, ms=-1, outcome="failure")]
    out = docs(spark, rows)
    svc = out.filter("metricset_name = 'service_transaction'").first()
    # weights 1.5 + 2 + 1 in one bucket round to 5 together; the oversize and the negative one count for success only
    assert (svc.metricset_doc_count, svc.event_success_count, svc.event_success_sum) == (5, 6, 3)
    by = {r.event_outcome: (r.metricset_doc_count, r.event_success_count, r.event_success_sum) for r in out.filter("metricset_name = 'transaction'").collect()}
    assert by == {"success": (2, 2, 2), "failure": (2, 2, 0), "unknown": (1, 0, 0)}


def test_dropped_spans_are_capped(spark):
    drop = lambda i: Row(destination_service_resource=f"r{i % 3}", service_target_type=None, service_target_name=None, outcome="success", duration=Row(count=1, sum_ns=10))
    rows = [txn(1, drops=[drop(i) for i in range(200)])]
    assert docs(spark, rows).filter("metricset_name = 'service_destination'").agg(F.sum("response_count")).first()[0] == 128


def test_batch_of_a_thousand(spark):
    rows = []
    for i in range(500):
        drop = [Row(destination_service_resource=f"dropped_dest_resource{i % 100}", service_target_type="", service_target_name="", outcome="success", duration=Row(count=1, sum_ns=10000000))]
        rows += [txn(2 * i, f"foo{i % 100}", f"txtype{i % 100}", service=f"svc{i % 10}", drops=drop), span(2 * i + 1, "test_dest", name=f"bar{i % 100}", service=f"svc{i % 10}", agent=None)]
    got = docs(spark, rows).groupBy("metricset_name").agg(F.count("*").alias("n"), F.min("metricset_doc_count").alias("low"), F.max("metricset_doc_count").alias("high")).collect()
    assert {(r.metricset_name, r.n, r.low, r.high) for r in got} == {("transaction", 100, 5, 5), ("service_transaction", 100, 5, 5), ("service_destination", 200, 5, 5), ("service_summary", 10, None, None)}


def test_merge_equals_one_pass_and_partitions(spark):
    rows = [txn(i, f"n{i % 5}", f"t{i % 3}", ms=i * 7 % 90, service=f"s{i % 4}") for i in range(120)]
    events = frame(spark, rows)
    key = ["metricset_name", "svc_name", "transaction_name", "transaction_type", "metricset_doc_count", "duration_sum"]
    whole = sorted(map(str, documents(aggregate(events, [1]), [1]).select(*key).collect()))
    merged = merge([aggregate(events.filter(F.col("seq") % 3 == i), [1]) for i in range(3)])
    assert sorted(map(str, documents(merged, [1]).select(*key).collect())) == whole
    parts = aggregate(events, [1], 7)
    assert parts.totals.agg(F.round(F.sum("events_total"), 6)).first()[0] == 120
    assert sorted(map(str, documents(parts.without_partition(), [1]).select(*key).collect())) == whole


def test_save_and_load(spark, tmp_path):
    from spanfold.operators.partials import Partials

    parts = aggregate(frame(spark, [txn(i, f"n{i}") for i in range(5)]), [1])
    parts.save(str(tmp_path))
    assert documents(Partials.load(spark, str(tmp_path)), [1]).count() == documents(parts, [1]).count() == 7


def test_lifecycle(spark):
    now = datetime(1970, 1, 1, 0, 0, 2)
    agg = Aggregator(spark, AggConfig(FREE, intervals=(timedelta(seconds=1), timedelta(seconds=4)), lookback=timedelta(hours=2)))
    agg.aggregate_batch("t", frame(spark, [txn(1)]))
    sink = MemorySink()
    agg.harvest(now, sink)
    assert {r.metricset_interval for r in sink.rows} == {"1s"}
    agg.close(now, sink)
    assert {r.metricset_interval for r in sink.rows} == {"1s", "4s"} and len(sink.rows) == 6
    agg.close(now, sink)
    with pytest.raises(AggregatorClosed):
        agg.aggregate_batch("t", frame(spark, [txn(1)]))
    assert is_aligned(3600, datetime(2024, 1, 1, 5)) and not is_aligned(7200, datetime(2024, 1, 1, 5))


def test_expired_partials(spark):
    agg = Aggregator(spark, AggConfig(FREE, intervals=(timedelta(seconds=1),)))
    agg.aggregate_partials(aggregate(frame(spark, [txn(1)]), [1]), datetime(1970, 1, 1, 1))
    sink = MemorySink()
    agg.harvest(datetime(1970, 1, 1, 1), sink)
    assert not sink.rows and agg.events_expired() == 1
