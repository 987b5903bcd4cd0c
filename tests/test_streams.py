"""Streams: the batch job's documents under limits, state that the limits bound, closing by the clock, late partials, levels."""

import random
import time
import weakref
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanfold.config import AggConfig, Limits
from spanfold.operators.rows import rows_of
from spanfold.operators.limits import IN_GROUP
from spanfold.plans.aggregator import aggregate_documents, events_to_partials
from spanfold.streaming import windows
from spanfold.streaming.admission import Admission
from tests.test_aggregation import FREE, frame, span, txn

AT = datetime(2024, 6, 1, tzinfo=timezone.utc)
SECOND, MINUTE = timedelta(seconds=1), timedelta(minutes=1)


def at(rows, when):
    return [r | {"processing_time": when, "timestamp": when} for r in rows]


def random_events(rng, n, tenants=6):
    drops = [{"destination_service_resource": f"r{k}", "duration": {"count": 1, "sum_ns": 5}} for k in range(3)]
    rows = []
    for seq in range(n):
        service = f"s{rng.randrange(4)}"
        row = txn(seq, f"n{rng.randrange(5)}", f"t{rng.randrange(3)}", service=service, ms=rng.randrange(1, 900), outcome=rng.choice(["success", "failure", "unknown"])) if rng.random() < 0.5 else span(seq, f"r{rng.randrange(3)}", name=rng.choice(["", "a", "b", "c"]), service=service, agent=None)
        rows.append(row | {"cm_id": f"c{rng.randrange(tenants)}", "processing_time": AT + timedelta(seconds=rng.randrange(20)), "timestamp": AT})
    return sorted(rows, key=lambda r: r["processing_time"])


def listed(docs):
    return sorted(str(r.asDict() | {"histogram_counts": r.histogram_counts, "event_received": r.svc_name == "_other" and r.event_received}) for r in docs.collect())


@pytest.mark.parametrize("limits, partitions", [(Limits(3, 4, 3, 3, 2, 5, 4), 1), (Limits(2, 9, 2, 9, 1, 4, 3), 3), (FREE, 3)])
def test_documents_equal_the_batch_job(spark, limits, partitions):
    events = frame(spark, random_events(random.Random(partitions), 400))
    config = AggConfig(limits, intervals=(timedelta(seconds=10),), partitions=partitions, overflow_count_mode="exact")
    want = listed(aggregate_documents(events, config))
    got = listed(windows.stream_to_documents(spark, events.coalesce(1), config))
    assert got == want and len(want) > 100


def test_state_stays_at_the_limits(spark, tmp_path):
    """Ten times as many distinct keys, the same number of rows in the state; sketches tell how many there were."""
    limits, held, told = Limits(2, 3, 3, 3, 3, 3, 3), [], []
    for k, n in enumerate((30, 300)):
        rows = at([txn(i, f"n{i}", f"t{i % 7}", service=f"s{i}" if i > 200 else f"s{i % 2}", ms=100) for i in range(n)], AT)
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/{k}/events")
        docs = []
        streams = windows.start(spark, AggConfig(limits, intervals=(MINUTE,)), f"{tmp_path}/{k}/state", spark.readStream.schema(frame(spark, []).schema).parquet(f"{tmp_path}/{k}/events"), sink=lambda d, i: docs.extend(d.collect()), by_clock=False)
        try:
            streams.queries[60].processAllAvailable()
            held.append(streams.state_rows())
        finally:
            streams.stop(AT)
        told.append({(r.metricset_name, r.svc_name): r.overflow_count for r in docs if r.overflow_count})
        assert sum(r.metricset_doc_count for r in docs if r.metricset_name == "transaction") == n
    # Services beyond the limit come with the larger input only: a row for each of their buckets, and for their totals.
    assert held[0] <= held[1] <= held[0] + 5
    assert sum(n for (m, _), n in told[0].items() if m == "transaction") == 27
    assert abs(told[1]["service_summary", "_other"] - 99) < 5


def test_a_silent_stream_closes_by_the_clock(spark, tmp_path):
    now, docs = datetime.now(timezone.utc).replace(microsecond=0), []
    frame(spark, at([txn(i) for i in range(5)], now)).coalesce(1).write.parquet(f"{tmp_path}/events")
    config = AggConfig(FREE, intervals=(SECOND,), harvest_delay=SECOND, sink=lambda d, i: docs.extend(d.collect()))
    streams = windows.start(spark, config, f"{tmp_path}/state", spark.readStream.schema(frame(spark, []).schema).parquet(f"{tmp_path}/events"))
    try:
        until = time.monotonic() + 120
        while not docs and time.monotonic() < until:
            time.sleep(0.5)
        assert [r.metricset_doc_count for r in docs if r.metricset_name == "transaction"] == [5]
        later = at([txn(10 + i) for i in range(3)], datetime.now(timezone.utc) + timedelta(hours=1))
        frame(spark, later).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        time.sleep(3)
    finally:
        streams.stop(datetime.now(timezone.utc) + timedelta(hours=1, minutes=1))
    streams.stop()
    assert sorted(r.metricset_doc_count for r in docs if r.metricset_name == "transaction") == [3, 5]
    assert not list((tmp_path / "state" / "closed" / "1").iterdir())


def long_rows(spark, events, config, arrived):
    return rows_of(events_to_partials(frame(spark, events), config)).withColumn("arrived", F.lit(arrived).cast("timestamp"))


@pytest.mark.parametrize("lookback, outcome", [(timedelta(0), "failure"), (timedelta(hours=2), "success")])
def test_late_partials(spark, lookback, outcome):
    """An hour-old bucket comes out by itself with a lookback of two hours; without, its events are counted as failures."""
    metrics = []
    config = AggConfig(Limits.same(100), intervals=(SECOND,), lookback=lookback, metrics_sink=lambda m: metrics.extend(m.collect()))
    old, new = AT - timedelta(hours=1), AT
    rows = long_rows(spark, at([txn(1, "txntest", "txntype")], old) + at([txn(2, "fresh")], new), config, AT)
    got = {(r.processing_time.hour, r.transaction_name) for r in windows.replayed(spark, config, AT, partials=rows).filter("metricset_name = 'transaction'").collect()}
    assert got == ({(23, "txntest"), (0, "fresh")} if lookback else {(0, "fresh")})
    counted = {}
    for m in metrics:
        if m.name == "events.processed.count":
            counted[m.attributes["outcome"]] = counted.get(m.attributes["outcome"], 0) + m.value
    assert counted == ({"success": 2} if lookback else {"success": 1, "failure": 1})


def test_partials_of_a_closed_bucket_are_a_second_result(spark, tmp_path):
    docs, config = [], AggConfig(FREE, intervals=(MINUTE,), lookback=timedelta(minutes=5))
    first, late = (long_rows(spark, at([txn(k)], AT), config, AT + timedelta(seconds=s)) for k, s in ((1, 1), (2, 70)))
    first.coalesce(1).write.parquet(f"{tmp_path}/partials")
    streams = windows.start(spark, config, f"{tmp_path}/state", partials=spark.readStream.schema(first.schema).parquet(f"{tmp_path}/partials"), sink=lambda d, i: docs.append(d.filter("metricset_name = 'transaction'").collect()), by_clock=False)
    try:
        streams.queries[60].processAllAvailable()
        streams.flush(AT)
        late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/partials")
        streams.queries[60].processAllAvailable()
    finally:
        streams.stop(AT + timedelta(seconds=70))
    found = [[(r.processing_time.minute, r.metricset_doc_count) for r in d] for d in docs if d]
    assert found == [[(0, 1)], [(0, 1)]]


def test_two_levels_equal_one_batch(spark, tmp_path):
    """Two streams of events emit partials under limits; a third merges them, sketches of what they turned away included."""
    limits = Limits(3, 6, 4, 9, 2, 9, 4)
    config = AggConfig(limits, intervals=(timedelta(seconds=10),), overflow_count_mode="exact")
    rows = random_events(random.Random(9), 300)
    for half in range(2):
        frame(spark, rows[half::2]).coalesce(1).write.parquet(f"{tmp_path}/in{half}")
        kind = windows.distinct(config)

        def ship(partials, interval_s):
            rows_of(partials, kind).withColumn("arrived", F.col("processing_time")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/level1")

        streams = windows.start(spark, config, f"{tmp_path}/state{half}", spark.readStream.schema(frame(spark, []).schema).parquet(f"{tmp_path}/in{half}"), partials_sink=ship, by_clock=False)
        try:
            streams.queries[10].processAllAvailable()
        finally:
            streams.stop(AT + timedelta(seconds=19))
    from spanfold.operators.limits import admit
    from spanfold.operators.partials import merge
    from spanfold.plans.documents import documents

    halves = [admit(events_to_partials(frame(spark, rows[half::2]), config), limits, kind).settled(spark, f"{tmp_path}/half{half}", kind) for half in range(2)]
    want = listed(documents(admit(merge(halves), limits, kind), [10], kind))
    got = windows.replayed(spark, config, AT + timedelta(seconds=19), partials=spark.read.parquet(f"{tmp_path}/level1"))
    assert listed(got) == want and len(want) > 40


@pytest.mark.parametrize("given", [{"max_transaction_groups_per_service": 2}, {"max_span_groups": 5, "max_span_groups_per_service": 4}, {"max_service_transaction_groups": 2}])
def test_what_no_limit_turns_away_passes_by(spark, given):
    """Some metricsets with limits, others and services without."""
    events = frame(spark, random_events(random.Random(7), 300))
    config = AggConfig(replace(FREE, **given), intervals=(timedelta(seconds=10),), overflow_count_mode="exact")
    want = listed(aggregate_documents(events, config))
    assert listed(windows.stream_to_documents(spark, events.coalesce(1), config)) == want and any("_other" in r for r in want)


class Remembered(dict):
    """State and handle of a processor."""

    getMapState = lambda self, *_: self
    iterator = lambda self: iter(list(self.items()))
    updateValue = dict.__setitem__
    registerTimer = lambda self, at: None


def test_admission_holds_keys_not_rows():
    """Of a trigger's frames no more than a few are held at once; places go by the first arrival of all frames."""
    alive, most = [], 0

    def held():
        return sum(f() is not None for f in alive)

    def frames():
        nonlocal most
        for k in range(50):
            n = np.arange(1000)
            ids = {c: n % 7 for c in ("sid1", "sid2", "gid1", "gid2", "cgid1", "cgid2")}
            yield (f := pd.DataFrame({"clock": pd.Timestamp(AT.replace(tzinfo=None)), "code": 1, "over": False, "named": True, "first": 100_000 - 1000 * k + n, **ids, "row": "x"}))
            alive.append(weakref.ref(f))
            most = max(most, held())
            del f

    admission, state = Admission(replace(FREE, max_transaction_groups=3)), Remembered()
    admission.init(state)
    rows = 0
    for out in admission.handleInputRows((0, 0, "c", 0), frames(), None):
        most, rows = max(most, held()), rows + len(out)
        assert set(out["key1"][out["place"] == IN_GROUP]) == {0, 1, 2} and len(out) == 1000
    assert rows == 50_000 and most <= 3 and {key[1] for key in state} == {0, 1, 2}
