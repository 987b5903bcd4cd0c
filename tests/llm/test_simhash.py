import random

import xxhash
from pyspark.sql import functions as F

from spanfold.llm import simhash as q


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids, fps = [i for i, _ in rows], [f for _, f in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i is not None, i or 0), f, least.get(find(k))) for k, (i, f) in enumerate(rows))


def test_fingerprints():
    for text in (None, "", " \t", "one", "One two", "a b c", "A  b\nC d", "é à " * 50, "x" * 5000, "w " * 70000):
        assert q.fingerprint(text) == brute_fingerprint(text)


def test_masks_cover_every_triple():
    masks = q.covering_masks()
    assert len(masks) == 15
    rng = random.Random(3)
    for _ in range(5000):
        change = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
        assert any(not m & change for m in masks)
    for m in masks:
        assert all(any(not f & c for f in q.quarters(m)) for c in [sum(1 << b for b in rng.sample([i for i in range(64) if not m >> i & 1], 3)) for _ in range(50)])


def components(spark, rows, split_at):
    df = spark.createDataFrame([(i, q.signed(f)) for i, f in rows], "doc_id long, fp long")
    folder = q.shared_dir(spark, "test")
    classes = df.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = q.links(classes.select("fp"), folder, split_at=split_at)
    roots = {r.node: r.root for r in q.components(edges, folder).collect()}
    return roots


def test_links_near_and_hot(spark):
    rng = random.Random(5)
    rows, centre = [], rng.getrandbits(64)
    for i in range(400):  # one dense family: all within a few bits of a centre
        rows.append((i, centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))))
    for i in range(400, 700):
        rows.append((i, rng.getrandbits(64)))
    for i in range(700, 760):
        rows.append((i, rows[i - 400][1] ^ (1 << rng.randrange(64))))
    for split_at in (16, 2048):
        roots = components(spark, rows, split_at)
        groups, want = {}, {}
        for i, f in rows:
            groups.setdefault(roots.get(q.signed(f), f"alone{f}"), set()).add(i)
        for _, f, c in brute_components(rows):
            want.setdefault(c, set()).add(f)
        assert sorted(map(len, groups.values())) == sorted(len([1 for _, f in rows if f in s]) for s in want.values())


def test_documents(spark):
    texts = [(4, "a b c d e"), (2, "A B C D E"), (9, None), (8, ""), (None, "a b c d e"), (2, "A B C D E"), (5, "something else altogether here"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in q.near_duplicates(docs).collect()]
    assert sorted(((i is not None, i or 0), f, c) for i, f, c in got) == brute_components([(i, brute_fingerprint(t)) for i, t in texts])
    kept = q.one_of_each(docs.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 8] and kept.columns == ["doc_id", "text"]
    assert q.near_duplicates(docs.limit(0)).count() == 0 and q.one_of_each(docs.limit(0)).count() == 0
