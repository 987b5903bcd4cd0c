"""What was taken in is handed on once: failing and blocked sinks, skipped harvests, closing, many small batches, disk."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spanfold.config import AggConfig, Limits
from spanfold.operators.partials import aggregate
from spanfold.plans import aggregator as q
from spanfold.sources import readers
from tests.test_aggregation import FREE, frame, txn

AT = datetime(2024, 6, 1, tzinfo=timezone.utc)
MINUTE = timedelta(minutes=1)


def batch(spark, n, minute):
    return frame(spark, [txn(1000 * minute + i) | {"processing_time": AT + minute * MINUTE} for i in range(n)])


def counts(sink):
    out = {}
    for r in sink.rows:
        if r.metricset_name == "transaction":
            minute = r.processing_time.minute
            out[minute] = out.get(minute, 0) + r.metricset_doc_count
    return out


def test_run_hands_on_what_a_failing_sink_left(spark):
    """With a lookback of zero the failed range lies below the next harvest's own bucket, and comes with it."""
    taken, failures = readers.MemorySink(), []

    def sink(docs, interval):
        if not failures:
            failures.append(interval)
            raise OSError("no room")
        taken(docs, interval)

    agg, clock = q.Aggregator(spark, AggConfig(FREE, sink=sink, intervals=(MINUTE,))), [AT]
    agg.aggregate_batch("t", batch(spark, 10, 0))
    agg.aggregate_batch("t", batch(spark, 20, 1))

    def wait(seconds):
        clock[0] += timedelta(seconds=seconds)
        return False

    agg.run(AT + 2 * MINUTE, lambda: clock[0], wait)
    assert failures == [60] and counts(taken) == {0: 10, 1: 20} and agg.in_flight == {60: 0}


def test_close_leaves_nothing(spark):
    agg, sink = q.Aggregator(spark, AggConfig(FREE, intervals=(MINUTE, 2 * MINUTE))), readers.MemorySink()
    for minute, n in enumerate((10, 20, 30)):
        agg.aggregate_batch("t", batch(spark, n, minute))
    assert agg.in_flight == {60: 60, 120: 60}
    agg.close(AT + 2 * MINUTE, sink)
    agg.close(AT + 2 * MINUTE, sink)
    assert sum(r.metricset_doc_count for r in sink.rows if r.metricset_name == "transaction" and r.metricset_interval == "1m") == 60
    assert agg.in_flight == {60: 0, 120: 0}
    with pytest.raises(q.AggregatorClosed):
        agg.aggregate_batch("t", batch(spark, 1, 0))


def test_close_can_be_tried_again(spark):
    agg, sink = q.Aggregator(spark, AggConfig(FREE, intervals=(MINUTE,))), readers.MemorySink()
    agg.aggregate_batch("t", batch(spark, 3, 0))

    def fail(docs, interval):
        raise OSError("no room")

    with pytest.raises(OSError):
        agg.close(AT, fail)
    agg.close(AT, sink)
    assert counts(sink) == {0: 3} and agg.closed


def test_disk_stays_small(spark, tmp_path, monkeypatch):
    """Harvests under limits leave no folder; many ingests leave a bounded number of batches and files."""
    monkeypatch.setattr(q, "MOST_BATCHES", 4)
    made = []
    monkeypatch.setattr(q, "work_dir", lambda spark, tag: made.append(f"file://{tmp_path}/shared/{tag}{len(made)}") or made[-1])
    agg, sink = q.Aggregator(spark, AggConfig(Limits.same(5), intervals=(MINUTE,), data_dir=f"file://{tmp_path}/data")), readers.MemorySink()
    for k in range(7):
        agg.aggregate_batch("t", batch(spark, 2, k // 4))
        assert len(list((tmp_path / "data/partials/data").iterdir())) <= 5
    agg.harvest(AT + MINUTE, sink)
    agg.harvest(AT + 2 * MINUTE, sink)
    assert counts(sink) == {0: 8, 1: 6} and agg.in_flight == {60: 0}
    left = [p for p in tmp_path.rglob("*.parquet") if "/ledger/" not in str(p)]
    assert not left and not list((tmp_path / "data/partials/data").iterdir())
    assert len(made) == 9 and not [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]


def test_ledger_forgets(spark, tmp_path, monkeypatch):
    from spanfold.plans import ledger

    monkeypatch.setattr(ledger, "MOST_FILES", 3)
    held = ledger.Ledger(spark, f"file://{tmp_path}")
    for k in range(5):
        held.append(spark.createDataFrame([(f"b{k}", 60, k, "t", 1.0, False)], ledger.ENTRY))
        if k < 4:
            held.append(held.done([(f"b{k}", 60, k)]))
        held.compact()
    assert held.places(F.lit(True)) == [("b4", 60, 4)] and len(list(tmp_path.rglob("part-*.parquet"))) <= 3
    (tmp_path / "v=99" / "entries").mkdir(parents=True)  # a compaction that was cut off
    again = ledger.Ledger(spark, f"file://{tmp_path}")
    assert again.places(F.lit(True)) == [("b4", 60, 4)] and not (tmp_path / "v=99").exists()


def test_ingest_while_a_sink_blocks(spark):
    agg, sink = q.Aggregator(spark, AggConfig(FREE, intervals=(MINUTE,))), readers.MemorySink()
    agg.aggregate_batch("t", batch(spark, 5, 0))
    begun, go = threading.Event(), threading.Event()

    def blocking(docs, interval):
        begun.set()
        assert go.wait(120)
        sink(docs, interval)

    harvest = threading.Thread(target=lambda: agg.harvest(AT + MINUTE, blocking))
    harvest.start()
    assert begun.wait(120)
    assert agg.aggregate_batch("t", batch(spark, 7, 0)) == 7  # the harvest holds its own batches
    go.set()
    harvest.join(120)
    assert counts(sink) == {0: 5} and agg.in_flight == {60: 7}
    agg.close(AT, sink)
    assert counts(sink) == {0: 12}


def test_failures_and_in_flight_by_tenant(spark):
    metrics = []
    config = AggConfig(FREE, intervals=(MINUTE,), partitions=3, metrics_sink=lambda m: metrics.extend(m.collect()))
    agg, sink = q.Aggregator(spark, config), readers.MemorySink()
    agg.aggregate_batch("a", batch(spark, 4, 0))
    agg.aggregate_batch("b", batch(spark, 6, 0))
    late = aggregate(batch(spark, 8, 0).withColumn("cm_id", F.when(F.col("seq") < 3, "a").otherwise("c")), [60])
    agg.aggregate_partials(late, AT + timedelta(hours=1))
    assert {r.cm_id: r.events for r in agg.in_flight_events().collect()} == pytest.approx({"a": 4, "b": 6})
    agg.close(AT, sink)
    found = {}
    for m in metrics:
        if m.name == "events.processed.count":
            key = m.cm_id, m.attributes["outcome"]
            found[key] = found.get(key, 0) + m.value
    assert found == pytest.approx({("a", "success"): 4, ("b", "success"): 6, ("a", "failure"): 3, ("c", "failure"): 5})
    assert agg.events_expired() == 8


def test_an_ingest_that_was_cut_off_counts_nothing(spark, tmp_path):
    config = AggConfig(FREE, intervals=(MINUTE,), data_dir=f"file://{tmp_path}")
    agg = q.Aggregator(spark, config)
    agg.aggregate_batch("t", batch(spark, 2, 0))
    agg._write(q.combined(q.observed(batch(spark, 9, 0), [60], 1)))  # written, but not noted
    again, sink = q.Aggregator(spark, config), readers.MemorySink()
    again.close(AT, sink)
    assert counts(sink) == {0: 2}
