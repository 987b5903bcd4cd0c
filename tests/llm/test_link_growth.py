"""Rows that joins make while fingerprints are linked and components are found, from Spark's own counters."""

import random

import pytest

from spanfold.llm import simhash as q


def joined_rows(spark, act):
    """What act returns, and how many rows the joins of its queries made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in each(store.executionsList())}
    out, rows = act(), 0
    for e in each(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in each(store.planGraph(e.executionId()).allNodes()):
                for m in each(node.metrics()) if "Join" in node.name() else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return out, rows


def each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def fps_of(spark, numbers):
    return spark.createDataFrame([(q.signed(f),) for f in numbers], "fp long")


def roots_of(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_joins_of_links_grow_with_the_fingerprints(spark):
    """Fingerprints at random share 16-bit keys by chance: twice the fingerprints, not four times the rows."""
    rng, rows = random.Random(21), []
    for n in (8000, 16000):
        fps, folder = fps_of(spark, {rng.getrandbits(64) for _ in range(n)}), q.shared_dir(spark, "test")
        rows.append(joined_rows(spark, lambda: q.links(fps, folder, 9, 1 << 15, q.halved_masks(9)))[1])
    assert rows[1] <= 3 * rows[0]


def test_joins_of_components_make_few_rows_for_an_edge(spark):
    """A family whose members all have edges to many hubs, as masks give them."""
    rng = random.Random(22)
    edges = sorted({(rng.randrange(40), rng.randrange(40, 2000)) for _ in range(28_000)})
    found, rows = joined_rows(spark, lambda: q.components(spark.createDataFrame(edges, "a long, b long"), q.shared_dir(spark, "test")).collect())
    assert {r.node: r.root for r in found} == roots_of(edges)
    assert 0 < rows < 3 * len(edges)


@pytest.mark.parametrize("kind", ["chain", "shuffled chain", "star of the largest", "random", "none"])
def test_components(spark, kind):
    rng, n = random.Random(23), 300
    names = rng.sample(range(-(1 << 40), 1 << 40), n)
    edges = {
        "chain": [(i, i + 1) for i in range(n)],
        "shuffled chain": list(zip(names, names[1:])),
        "star of the largest": [(max(names) + 1, x) for x in names],
        "random": [e for e in ((rng.choice(names), rng.choice(names)) for _ in range(n // 2)) if e[0] != e[1]] * 2,
        "none": [],
    }[kind]
    found = q.components(spark.createDataFrame(edges, "a long, b long"), q.shared_dir(spark, "test"))
    assert {r.node: r.root for r in found.collect()} == roots_of(edges) and found.count() == len(roots_of(edges))


@pytest.mark.parametrize("held, wide, split_at", [(1, 256, 1 << 15), (1 << 16, 8, 1 << 15), (700, 8, 64)])
def test_links_whatever_a_task_gathers(spark, monkeypatch, held, wide, split_at):
    monkeypatch.setattr(q, "HELD", held)
    monkeypatch.setattr(q, "WIDE", wide)
    rng, fps = random.Random(24), []
    for family in range(4):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for _ in range(60 * family + 1)]
    fps = sorted({*fps, 0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(300))})
    near = [(q.signed(a), q.signed(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 9]
    folder = q.shared_dir(spark, "test")
    found = [(r.a, r.b) for r in q.links(fps_of(spark, fps), folder, 9, split_at, q.halved_masks(9)).collect()]
    assert roots_of(found) == roots_of(near)
