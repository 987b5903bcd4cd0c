import random

from spanfold.llm import near_copies as q


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """doc_ids that stay: the smallest of each component, null last."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append((i is None, i or 0))
    return sorted(min(g) for g in groups.values())


def key(ids):
    return sorted((i is None, i or 0) for i in ids)


def planted(rng, n=60):
    """Texts and near copies of them with a few changed words, on both sides of the similarity 0.8; chains, equal texts, texts without words."""
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            words = list(words)
            for _ in range(max(1, len(words) * rng.randrange(1, 5) // 150)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append((10 * k + c, " ".join(words)))
    rows += [(1001, "One two"), (1000, "one  TWO"), (1002, "one two three"), (1003, None), (1004, " \n"), (None, "one two"), (None, "alone at last with no id"), (0, rows[0][1])]
    return rows


def test_stage_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline as c

    rows = planted(random.Random(11))
    docs = spark.createDataFrame([(t, i, 1.0) for i, t in rows], "text string, doc_id long, other double")
    kept = c.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert key(r.doc_id for r in kept.collect()) == brute(rows)


def test_groups_in_blocks_lose_no_link(spark):
    """Star-shaped families, chains of steps and texts that only share a key, with blocks of a few texts."""
    rng, rows = random.Random(13), planted(random.Random(14), 12)
    for family in range(3):
        base = [f"b{family}_{k}" for k in range(80)]
        for c in range(50):
            words = list(base)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(80)] = f"y{rng.randrange(5000)}"
            rows.append((2000 + 100 * family + c, " ".join(words)))
    shared, words = [f"p{k}" for k in range(60)], [f"c{k}" for k in range(150)]
    rows += [(3000 + c, " ".join(shared + [f"z{rng.randrange(5000)}" for _ in range(50)])) for c in range(60)]
    for c in range(40):
        words = [f"d{c}_{k}" if k == 3 * c else w for k, w in enumerate(words)]
        rows.append((4000 + c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rows_at_most, shingles_at_most in ((4, 1 << 22), (2048, 700)):
        assert key(r.doc_id for r in q.one_of_each(docs, rows_at_most, shingles_at_most).collect()) == brute(rows)


def test_no_pair_is_missed(spark):
    rng, near, found = random.Random(12), 0, 0
    texts = [t for _, t in planted(rng, 200)]
    keys = [set(q.band_keys(q.shingles(q.words_of(t)))) for t in texts]
    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(max(0, i - 4), i):
            if keys[i] and keys[j] and alike(sets[i], sets[j]):
                near, found = near + 1, found + bool(keys[i] & keys[j])
    assert near > 200 and found == near


def test_empty(spark):
    assert q.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_groups_are_those_of_brute_force(spark):
    """What SimHash links, over planted near copies; and that it, not the check after it, has linked most of them."""
    from spanfold.llm import simhash

    rows = [(i, t) for i, t in planted(random.Random(15)) if i is not None and t and t.strip()]
    prints = {n: simhash.majority(q.shingles(q.words_of(t))) for n, (_, t) in enumerate(rows)}
    root = {f: f for f in prints.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in root:
        for b in root:
            if bin(a ^ b).count("1") <= q.RADIUS:
                root[find(a)] = find(b)
    want = {}
    for n, f in prints.items():
        want.setdefault(find(f), set()).add(n)
    texts = q.prints(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "number long, text string"))
    assert {r.number: r.fp % (1 << 64) for r in texts.collect()} == prints
    got = {}
    for r in q.fingerprint_groups(texts, simhash.shared_dir(spark, "test"), q.blocks_of(2048, 1 << 22)).collect():
        got.setdefault(r.key, set()).add(r.number)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
    sets = {n: shingle_set(t) for n, (_, t) in enumerate(rows)}
    near = [find(prints[a]) == find(prints[b]) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert len(near) > 60 and sum(near) > 0.6 * len(near)


def test_masks_of_halves_cover_the_radius():
    from spanfold.llm import simhash

    rng, masks = random.Random(16), simhash.halved_masks(q.RADIUS)
    assert len(masks) == 62 and all(14 <= m.bit_count() <= 18 for m in masks)
    for _ in range(5000):
        change = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, q.RADIUS + 1)))
        assert any(not m & change for m in masks)
