"""The cap on dropped spans, and their order, with several partitions against a plain loop."""

import random

from spanfold.config import AggConfig, Limits
from spanfold.operators.metricsets import dropped_spans, fanned_out
from spanfold.plans.aggregator import aggregate_documents
from spanfold.schema import MAX_DROPPED_SPANS, ORDER
from tests.test_aggregation import frame, txn


def drop(resource):
    return (resource, None, None, "success", (1, 10))


def test_kept_and_numbered_within_each_partition(spark):
    rng = random.Random(7)
    stats = {seq: [f"r{rng.randrange(40)}" for _ in range(n)] for seq, n in ((1, 700), (2, 700), (3, 5), (4, 0))}
    events = frame(spark, [txn(seq, drops=[drop(r) for r in own]) for seq, own in stats.items()])
    rows = dropped_spans(fanned_out(events, [1]), 3).collect()
    partition = {r.resource: r.partition_id for r in rows}
    want = set()
    for seq, own in stats.items():
        taken = {}
        for resource in own:
            p = partition[resource]
            if taken.get(p, 0) < MAX_DROPPED_SPANS:
                want.add((seq, p, taken.get(p, 0), resource))
                taken[p] = taken.get(p, 0) + 1
    assert {(r.seq, r.partition_id, r.pos, r.resource) for r in rows} == want and len(rows) == len(want) > 5 * MAX_DROPPED_SPANS
    first = {seq: [r.seq * ORDER + r.pos for r in rows if r.seq == seq] for seq in (1, 2)}
    assert max(first[1]) < min(first[2])


def test_limits_with_partitions_admit_in_order_of_arrival(spark):
    """Whatever partition a group is in, the first event's groups come before the second's."""
    stats = {1: [f"a{k % 30}" for k in range(700)], 2: [f"b{k % 30}" for k in range(700)]}
    events = frame(spark, [txn(seq, drops=[drop(r) for r in own]) for seq, own in stats.items()])
    parts = {r.resource: r.partition_id for r in dropped_spans(fanned_out(events, [1]), 3).collect()}
    limits = Limits(9, 99, 99, 99, 99, 12, 99)
    docs = aggregate_documents(events, AggConfig(limits, partitions=3, overflow_count_mode="exact")).filter("metricset_name = 'service_destination' and overflow_count is null").collect()
    for p in range(3):
        order = [r for own in stats.values() for r in dict.fromkeys(own) if parts[r] == p]
        assert {r.resource for r in docs if r.partition_id == p} == set(order[:12])
