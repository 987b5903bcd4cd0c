"""Limits against a serial model that admits observation by observation; every random case is a tenant of its own."""

import random
from datetime import datetime, timedelta

import pytest

from spanfold.config import AggConfig, Limits
from spanfold.plans.aggregator import aggregate_documents
from tests.test_aggregation import T0, frame, span, txn


def serial(cases, limits):
    """{(tenant, metricset, service, key): [events, overflowed keys]}"""
    out = {}

    def add(place, n, key=None):
        entry = out.setdefault(place, [0, set()])
        entry[0] += n
        if key is not None:
            entry[1].add(key)

    for tenant, events in cases.items():
        services, total = {}, {"transaction": 0, "service_destination": 0}
        lost = set()
        for kind, service, key in events:
            metricset = "transaction" if kind == "t" else "service_destination"
            most, per = limits.of(metricset)
            if service not in services:
                if len(services) >= limits.max_services:
                    lost.add(service)
                    add((tenant, metricset, "_other", "_other"), 1, (service, key))
                    continue
                services[service] = {"transaction": set(), "service_destination": set()}
            groups = services[service][metricset]
            name = key
            if name not in groups:
                if kind == "s" and len(groups) >= per // 2:
                    name = ("", key[1])
                if name not in groups:
                    if len(groups) >= per or total[metricset] >= most:
                        add((tenant, metricset, service, "_other"), 1, (service, key))
                        continue
                    groups.add(name)
                    total[metricset] += 1
            add((tenant, metricset, service, name), 1)
        for service in services:
            add((tenant, "service_summary", service, None), 0)
        if lost:
            add((tenant, "service_summary", "_other", None), 0)
            out[(tenant, "service_summary", "_other", None)][1] = lost
    return {k: (n, len(keys)) for k, (n, keys) in out.items()}


@pytest.mark.parametrize("limits", [Limits(2, 5, 2, 9, 9, 6, 3), Limits(3, 4, 3, 9, 9, 5, 4), Limits(2, 99, 1, 9, 9, 99, 1), Limits(9, 3, 9, 9, 9, 3, 6)])
def test_against_serial_model(spark, limits):
    rng = random.Random(str(limits))
    cases, rows, seq = {}, [], 0
    for c in range(40):
        tenant = f"c{c}"
        cases[tenant] = []
        for _ in range(rng.randrange(1, 40)):
            service, seq = f"s{rng.randrange(4)}", seq + 1
            if rng.random() < 0.4:
                name = f"n{rng.randrange(4)}"
                cases[tenant].append(("t", service, name))
                rows.append(txn(seq, name, "t", service=service) | {"cm_id": tenant})
            else:
                key = (rng.choice(["", "a", "b", "c"]), f"r{rng.randrange(3)}")
                cases[tenant].append(("s", service, key))
                rows.append(span(seq, key[1], name=key[0], service=service, agent=None) | {"cm_id": tenant})
    out = {}
    for r in aggregate_documents(frame(spark, rows), AggConfig(limits, intervals=(timedelta(seconds=1),), overflow_count_mode="exact")).collect():
        if r.metricset_name == "service_transaction":
            continue
        over = r.overflow_count is not None
        key = None if r.metricset_name == "service_summary" else "_other" if over else r.transaction_name if r.metricset_name == "transaction" else (r.span_name, r.resource)
        n = r.response_count if r.metricset_name == "service_destination" else r.metricset_doc_count
        out[(r.cm_id, r.metricset_name, r.svc_name, key)] = (n or 0, r.overflow_count or 0)
        if over and r.metricset_name == "service_destination":
            assert r.metricset_doc_count == r.overflow_count and r.timestamp == T0
    assert out == serial(cases, limits)


def test_equal_keys_of_two_services_stay_two(spark):
    rows = [txn(1, service="a"), txn(2, service="b"), txn(3, service="c")]
    cfg = AggConfig(Limits(1, 9, 9, 9, 9, 9, 9), intervals=(timedelta(seconds=1),))
    got = {r.metricset_name: r.overflow_count for r in aggregate_documents(frame(spark, rows), cfg).filter("svc_name = '_other'").collect()}
    assert got == {"transaction": 2, "service_transaction": 2, "service_summary": 2}


def test_no_service_no_documents(spark):
    cfg = AggConfig(Limits.same(0), intervals=(timedelta(seconds=1),))
    assert aggregate_documents(frame(spark, [txn(1), txn(2, service="b")]), cfg).count() == 0


def test_log(spark):
    from spanfold.operators.limits import admit
    from spanfold.operators.partials import aggregate
    from spanfold.telemetry import latencies, overflow_log

    limits = Limits(9, 1, 9, 9, 1, 9, 9)
    cut = admit(aggregate(frame(spark, [txn(1, "a", "x"), txn(2, "b", "y")]), [1]), limits)
    assert {(r.aggregation_type, r.scope, r.limit) for r in overflow_log(cut, limits).collect()} == {("transaction", "overall", 1), ("service_transaction", "per_service", 1)}
    from pyspark.sql import functions as F

    assert latencies(cut, F.lit(datetime(1970, 1, 1, 0, 0, 5)).cast("timestamp")).first().processed_latency_s == 4
