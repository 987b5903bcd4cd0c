"""q29 against counts made event by event, for all four types that the reference reports."""

import json
from collections import Counter

import pyarrow.parquet as pq

from spanfold import catalog

SF = "/root/testdata/sf0.001"


def brute(limits):
    services, kinds, spans = {}, {}, {}
    rows = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "ts", "user_id", "event_type", "props"]).to_pylist()
    assert len({r["event_id"] for r in rows}) == len(rows)
    for r in sorted(rows, key=lambda r: r["event_id"]):
        k, u, kind = int(json.loads(r["props"])["k"]), r["user_id"], r["event_type"]
        tenant = f"t{u % 2}"
        service = (r["ts"].replace(minute=0, second=0, microsecond=0), u % 20, u % 3, u % 4, k % 3)
        services.setdefault(tenant, {}).setdefault(service)
        outcome = {"error": "failure", "view": "unknown"}.get(kind, "success")
        kinds.setdefault(tenant, {}).setdefault(("transaction", service, kind, k % 25, outcome, k % 5 == 0, {0: True, 1: False}.get(k % 3)))
        kinds[tenant].setdefault(("service_transaction", service, kind))
        spans.setdefault(tenant, set()).update((service, (k + i) % 7) for i in range(1, k % 4 + 1))
    out = Counter()
    for tenant, seen in services.items():
        known = set(list(seen)[: limits["max_services"]])
        out[tenant, "service"] = len(seen) - len(known)
        held, total = Counter(), 0
        for metricset, service, *_ in kinds[tenant]:
            if metricset == "transaction":
                held[service] += 1
                out[tenant, metricset] += service not in known or held[service] > limits["max_transaction_groups_per_service"]
            else:
                total += service in known
                out[tenant, metricset] += service not in known or total > limits["max_service_transaction_groups"]
        out[tenant, "service_destination"] = sum(service not in known for service, _ in spans[tenant])
    return {k: n for k, n in out.items() if n}


def test_all_types(spark):
    got = catalog.QUERIES["q29_overflow_counts"](spark, SF).collect()
    want = brute(catalog.TELEMETRY_LIMITS)
    assert {t for _, t in want} == {"service", "transaction", "service_transaction", "service_destination"}
    assert {(r.cm_id, r.aggregation_type): r.overflowed for r in got if r.overflowed} == want
