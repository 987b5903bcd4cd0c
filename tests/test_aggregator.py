"""Storage, harvest, close, the run loop and streams."""

import io
import logging
from contextlib import redirect_stdout
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spanfold.config import AggConfig, Limits
from spanfold.operators.limits import admit
from spanfold.operators.metricsets import fanned_out, presences
from spanfold.operators.partials import Partials, aggregate
from spanfold.plans.aggregator import Aggregator, aggregate_documents, next_end
from spanfold.plans.documents import documents
from spanfold.sources import readers
from spanfold.streaming.windows import stream_to_documents
from tests.test_aggregation import FREE, T0, event, frame, span, txn

AT = datetime(2024, 6, 1, tzinfo=timezone.utc)
SECOND, MINUTE = timedelta(seconds=1), timedelta(minutes=1)


def at(rows, when):
    return [r | {"processing_time": when} for r in rows]


def count(sink):
    return sum(r.metricset_doc_count or 0 for r in sink.rows if r.metricset_name == "transaction")


@pytest.mark.parametrize("now", [AT, AT + timedelta(seconds=20)])
def test_close_emits_every_event_once(spark, now):
    agg, sink = Aggregator(spark, AggConfig(FREE, intervals=(MINUTE,))), readers.MemorySink()
    assert agg.aggregate_batch("t", frame(spark, at([txn(i) for i in range(50)], AT))) == 50
    agg.close(now, sink)
    agg.close(now, sink)
    assert count(sink) == 50 and agg.in_flight == {60: 0}


def test_a_failing_sink_leaves_its_range(spark):
    metrics = []
    config = AggConfig(FREE, intervals=(SECOND, MINUTE), metrics_sink=lambda m: metrics.extend(m.collect()), metric_labels=lambda cm_id: F.create_map(F.lit("project"), cm_id))
    agg, sink = Aggregator(spark, config), readers.MemorySink()
    agg.aggregate_batch("t", frame(spark, at([txn(1), txn(2)], AT)))

    def fail(docs, interval):
        raise OSError("no room")

    with pytest.raises(OSError):
        agg.harvest(AT + SECOND, fail)
    assert agg.in_flight == {1: 2, 60: 2}
    agg.harvest(AT + SECOND, sink)
    assert count(sink) == 2 and agg.in_flight == {1: 0, 60: 2}
    agg.harvest(AT + SECOND, sink)  # nothing is left
    assert count(sink) == 2
    found = [(m.value, m.attributes["outcome"], m.attributes["aggregation_interval"], m.attributes["project"]) for m in metrics if m.name == "events.processed.count"]
    assert found == [(2, "failure", "1s", "t"), (2, "success", "1s", "t")]
    assert [m.cm_id for m in metrics if m.name == "events.processed.bytes" and m.value > 0] == ["t"]
    assert {m.name for m in metrics} == {"events.processed.bytes", "events.processed.count", "events.processed.latency", "events.processed.queued-latency"}


def test_late_partials_come_out_again_and_plans_stay_small(spark):
    agg, sink = Aggregator(spark, AggConfig(FREE, intervals=(SECOND,), lookback=timedelta(hours=2))), readers.MemorySink()
    plans = []
    for i in range(3):
        agg.aggregate_batch("t", frame(spark, at([txn(i)], AT)))
        plans.append(len(agg._held(F.lit(True)).totals._jdf.queryExecution().optimizedPlan().toString()))
    assert max(plans) < 1.1 * min(plans)
    agg.harvest(AT + SECOND, sink)
    assert count(sink) == 3
    agg.aggregate_partials(aggregate(frame(spark, at([txn(9)], AT)), [1]), AT + timedelta(hours=1))
    agg.aggregate_partials(aggregate(frame(spark, at([txn(10)], AT - timedelta(hours=9))), [1]), AT + timedelta(hours=1))
    agg.harvest(AT + timedelta(hours=1), sink)
    assert count(sink) == 4 and agg.events_expired() == 1


def test_reopened_storage_holds_what_was_taken_in(spark, tmp_path):
    config = AggConfig(Limits.same(1), intervals=(MINUTE,), data_dir=f"file://{tmp_path}", overflow_count_mode="exact")
    limited = admit(aggregate(frame(spark, at([txn(1, "a"), txn(2, "b")], AT)), [60]), config.limits, config and __import__("spanfold.plans.aggregator", fromlist=["distinct"]).distinct(config))
    Aggregator(spark, config).aggregate_partials(limited, AT)
    agg, sink = Aggregator(spark, config), readers.MemorySink()
    assert agg.in_flight == {60: 2}
    agg.aggregate_batch("t", frame(spark, at([txn(3, "c")], AT)))
    agg.close(AT, sink)
    assert {(r.transaction_name, r.overflow_count): r.metricset_doc_count for r in sink.rows if r.metricset_name == "transaction"} == {("a", None): 1, ("_other", 2): 2}


def test_run(spark):
    sink = readers.MemorySink()
    agg = Aggregator(spark, AggConfig(FREE, sink=sink, intervals=(MINUTE,), harvest_delay=timedelta(seconds=5)))
    agg.aggregate_batch("t", frame(spark, at([txn(1)], AT) + at([txn(2)], AT + MINUTE)))
    clock, pauses = [AT + timedelta(seconds=50)], []

    def wait(seconds):
        pauses.append(seconds)
        clock[0] += timedelta(seconds=seconds)
        if len(pauses) == 1:
            with pytest.raises(RuntimeError):
                agg.run()
        return False

    agg.run(AT + 2 * MINUTE, lambda: clock[0], wait)
    assert count(sink) == 2 and pauses == [15, 60] and not agg.running
    agg.close(clock[0])
    assert next_end(60, AT) == AT + MINUTE and next_end(60, AT + timedelta(seconds=59.5)) == AT + MINUTE


def test_overflow_warnings(spark, caplog):
    agg = Aggregator(spark, AggConfig(Limits(9, 1, 9, 9, 9, 9, 9), intervals=(MINUTE,), overflow_logging=True))
    agg.aggregate_batch("t", frame(spark, at([txn(1, "a"), txn(2, "b")], AT)))
    with caplog.at_level(logging.WARNING):
        agg.close(AT, readers.noop_sink)
    assert [r.getMessage() for r in caplog.records if "limit of 1" in r.getMessage()] == ["overall limit of 1 reached: tenant t, transaction, interval 60s"]


def test_sinks_and_readers(spark, tmp_path):
    rows = [txn(1), span(2)]
    frame(spark, rows).write.json(f"{tmp_path}/in")
    events = readers.events_json(spark, f"{tmp_path}/in")
    config = AggConfig(FREE, intervals=(SECOND,))
    assert config.sink is readers.console
    docs = aggregate_documents(events, config)
    with redirect_stdout(out := io.StringIO()):
        readers.console(docs, 1)
    assert "service_destination" in out.getvalue()
    readers.parquet_sink(f"{tmp_path}/p")(docs, 1)
    readers.json_sink(f"{tmp_path}/j")(docs, 1)
    readers.noop_sink(docs, 1)
    assert spark.read.parquet(f"{tmp_path}/p").count() == spark.read.json(f"{tmp_path}/j").count() == docs.count() == 5


def test_stream_equals_batch_under_limits(spark):
    rows = [txn(i, f"n{i % 7}", f"t{i % 3}", service=f"s{i % 4}", ms=i) for i in range(60)] + [span(100 + i, f"r{i % 5}", name=f"x{i % 6}", service=f"s{i % 4}") for i in range(40)] + [event(300, "log", service={"name": "s9"})]
    rows = [r | {"processing_time": AT + timedelta(seconds=r["seq"] % 2 * 60)} for r in rows]
    config = AggConfig(Limits(3, 9, 4, 9, 2, 9, 4), intervals=(MINUTE, 2 * MINUTE), overflow_count_mode="exact")
    events = frame(spark, rows)
    key = ["metricset_name", "metricset_interval", "processing_time", "svc_name", "transaction_name", "transaction_type", "faas_cold_start", "trace_root", "span_name", "resource", "target_name", "metricset_doc_count", "overflow_count", "duration_sum", "response_sum"]
    want = sorted(map(str, aggregate_documents(events, config).select(*key).collect()))
    assert sorted(map(str, stream_to_documents(spark, events, config).select(*key).collect())) == want and len(want) > 40


def test_partitions_by_event(spark):
    drop = lambda i: (f"r{i}", None, None, "success", (1, 10))
    rows = [txn(1, drops=[drop(i % 9) for i in range(300)]), txn(2), span(3), event(4, "log", service={"name": "svc"})]
    events, parts = frame(spark, rows), aggregate(frame(spark, rows), [1], 5)
    held = {m: {r.partition_id for r in d.select("partition_id").distinct().collect()} for m, d in parts.groups.items()}
    seen = presences(fanned_out(events, [1]), 5).groupBy("seq").agg(F.sum("share").alias("n"), F.count("*").alias("parts"), F.collect_set("partition_id").alias("ids")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in seen) and set().union(*held.values()) <= {p for r in seen for p in r.ids}
    assert parts.groups["service_destination"].filter("span_outcome = 'success' and resource like 'r%'").groupBy("partition_id").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] <= 128
    assert abs(parts.totals.agg(F.sum("events_total")).first()[0] - 4) < 1e-9


def test_raw_events_aggregate_by_hash_and_are_read_once_under_limits(spark):
    from spanfold import catalog

    plan = aggregate(catalog.spans(spark, "/root/testdata/sf0.001"), [60]).groups["service_destination"]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    limited = catalog.QUERIES["q21_span_limits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in limited


def test_sketches_survive_storage_and_overflow_carries_the_youngest_time(spark, tmp_path):
    rows = [txn(i, f"n{i}", service=f"s{i % 3}") | {"event": {"duration_ns": 1000, "outcome": "success", "received": T0 + timedelta(seconds=i)}} for i in range(600)]
    cut = admit(aggregate(frame(spark, rows), [1]), Limits(2, 9, 9, 9, 9, 9, 9))
    cut.save(str(tmp_path))
    back = documents(Partials.load(spark, str(tmp_path), True), [1], received=F.lit(T0 + timedelta(hours=1)).cast("timestamp"))
    over = {(r.metricset_name, r.svc_name): r for r in back.filter("overflow_count is not null").collect()}
    assert abs(over["transaction", "_other"].overflow_count - 200) <= 4 and over["service_summary", "_other"].overflow_count == 1
    assert over["transaction", "_other"].event_received == T0 + timedelta(seconds=599) and over["transaction", "s0"].event_received == T0 + timedelta(hours=1)
    assert abs(over["transaction", "s0"].overflow_count - 195) <= 6
