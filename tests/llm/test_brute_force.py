"""Operators that SQL cannot express against plain versions written here: media, mixing, mixtures, label model, forest."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanfold.llm import language_id, media, mixing, quality_rules, weak_quality

# ------------------------------------------------------------------------------------------------ media


def plain_png(payload):
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    lines = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
    head = struct.pack(">II5B", 64, len(payload) // 64, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def test_media_query(spark, tmp_path):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 65, "same text", "same text", "long " * 50_000]
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, math.ceil(len(raw) / 64) * 64) - len(raw))
        png, n, counts = plain_png(payload), len(payload), Counter(payload)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        feature = f"64x{n // 64} mean={sum(payload) / n:.4f} entropy={abs(entropy):.4f}"
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((i if i != 7 else None, len(raw), n, sha(payload), zlib.crc32(payload[-64:]), len(png), sha(png), feature))
    got = media.query(spark, str(tmp_path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ------------------------------------------------------------------------------------------------ mixing


def plain_permutation(k, n, key):
    """Four Feistel rounds over just enough bits, walked until back inside."""
    half, mask = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2)), (1 << 64) - 1
    low = (1 << half) - 1
    while True:
        left, right = k >> half, k & low
        for r in range(4):
            h = (right + ((key * 4 + r) * 0x9E3779B97F4A7C15 & mask)) * 0xBF58476D1CE4E5B9 & mask
            left, right = right, left ^ ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 32 & low
        k = left << half | right
        if k < n:
            return k


def test_taken_by_document_equals_a_serial_slot_map(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 63, 64, 65, 200, 900]))), rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000, None, "a"), (20_001, "", None), (20_002, "w " * 9000, "b")]
    by = defaultdict(list)
    for i, text, source in rows:
        by[source].append((i, len((text or "").split())))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, n in by[s]) for s in names]
    targets = mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    want = {}
    for number, (source, size, target) in enumerate(zip(names, sizes, targets)):
        stream = [i for i, n in sorted(by[source]) for _ in range(n)]  # the document of each word
        blocks = [stream[k : k + 64] for k in range(0, size, 64)]
        for i, n in by[source]:
            want[i] = [n, size, target, 0]
        for k in range(min(2 * len(blocks), round(target * len(blocks) / size)) if size else 0):
            turn, at = divmod(k, len(blocks))
            for i in blocks[plain_permutation(at, len(blocks), (6 * 1_000_003 + number) * 64 + turn)]:
                want[i][3] += 1
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: [r["size"], r.source_size, pytest.approx(r.target), r.taken] for r in got} == want
    assert any(n and t % n for n, _, _, t in want.values())


# ------------------------------------------------------------------------------------------------ mixtures of languages


def best_shares(likely, chosen, steps=2000):
    """(log-likelihood, shares) of the best mixture of some languages."""
    p = np.exp(likely[:, chosen])
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(steps):
        post = p * share
        share = (post / post.sum(1, keepdims=True)).mean(0)
    return float(np.log((p * share).sum(1)).sum()), share


@pytest.mark.parametrize("seed", range(4))
def test_mixture_equals_the_best_of_all_language_sets(seed):
    rng = np.random.default_rng(seed)
    width, texts = 4, []
    for _ in range(12):
        parts = rng.choice(width, rng.integers(1, 4), replace=False)
        owner = rng.choice(parts, rng.integers(40, 160))
        likely = rng.normal(-9.0, 0.7, (len(owner), width))
        likely[np.arange(len(owner)), owner] += 5
        texts.append(likely)
    starts = np.append(0, np.cumsum([len(t) for t in texts])[:-1])
    got = language_id.mixture(np.concatenate(texts).astype(np.float32), starts)
    for own, likely in zip(got, texts):
        penalty = language_id.PENALTY * math.log(len(likely) + 1)
        found = {s: best_shares(likely, list(s)) for k in range(1, width + 1) for s in itertools.combinations(range(width), k)}
        best = max(found, key=lambda s: found[s][0] - penalty * (len(s) - 1))
        assert tuple(np.flatnonzero(own)) == best and own[list(best)] == pytest.approx(found[best][1], abs=0.02)


# ------------------------------------------------------------------------------------------------ label model


def test_posteriors_by_enumeration_and_planted_accuracies():
    rng, n = np.random.default_rng(5), len(weak_quality.LABELLERS)
    good = rng.random(60_000) < 0.7
    planted = np.where(weak_quality.SIDE > 0, [[0.25] * n, [0.85] * n], [[0.45] * n, [0.03] * n])
    cast = rng.random((len(good), n)) < planted[good.astype(int)]
    patterns, counts = np.unique((cast << np.arange(n)).sum(1), return_counts=True)
    by_pattern, rates, accuracy, prior = weak_quality.label_model(patterns, counts)
    assert prior == pytest.approx(0.7, abs=0.02) and rates == pytest.approx(planted, abs=0.03)
    for pattern in [0, 1, 2**n - 1, *patterns[:40].tolist()]:
        weight = [prior if c else 1 - prior for c in (0, 1)]
        for k in range(n):
            for c in (0, 1):
                weight[c] *= rates[c, k] if pattern >> k & 1 else 1 - rates[c, k]
        assert by_pattern[pattern] == pytest.approx(weight[1] / sum(weight), rel=1e-6, abs=1e-12)
    right = [(cast[:, k] & (good if weak_quality.SIDE[k] > 0 else ~good)).sum() / cast[:, k].sum() for k in range(n)]
    assert accuracy == pytest.approx(right, abs=0.03)


def test_threshold_and_verdicts_by_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = weak_quality.classify(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    bins = Counter(math.floor(r.score * 1000) for r in rows if r.posterior >= weak_quality.CONFIDENT)
    left, threshold = (1 - weak_quality.KEEP_CONFIDENT) * sum(bins.values()), 0.0
    for b in sorted(bins):
        left -= bins[b]
        if left < 0:
            threshold = min(0.5, b / 1000)
            break
    assert {r.threshold for r in rows} == {threshold} and all(r.kept == (r.score >= threshold) for r in rows)
    patterns, counts = np.unique([weak_quality.votes(t) for t in texts.values()], return_counts=True)
    by_pattern = weak_quality.label_model(patterns, counts)[0]
    assert all(r.posterior == pytest.approx(by_pattern[weak_quality.votes(texts[r.doc_id])]) for r in rows)


# ------------------------------------------------------------------------------------------------ isolation forest


def walk(tree, row):
    feature, cut, left, depth = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] + (1 if row[feature[at]] > cut[at] else 0)
    return depth[at]


def test_kept_by_a_plain_forest_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality_rules.rule_statistics(docs)
    forest = quality_rules.fit_forest(stats)
    harmonic = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    marks, want, bins = {r.doc_id: r.quality for r in labels.collect()}, {}, defaultdict(Counter)
    for r in stats.collect():
        row = [max(r[f] - o, 0.0) for f, o in zip(quality_rules.FEATURES, quality_rules.ORDINARY.tolist())]
        anomaly = 2 ** (-np.mean([walk(t, row) for t in forest.trees]) / harmonic(forest.psi))
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        want[r.doc_id] = (failed, anomaly)
        if not failed and marks.get(r.doc_id) is not None:
            bins[marks[r.doc_id]][math.floor(anomaly * 1000)] += 1
    value = lambda t: sum(n for b, n in bins[0].items() if b >= t) / sum(bins[0].values()) - 8 * sum(n for b, n in bins[1].items() if b >= t) / sum(bins[1].values())
    threshold = max(range(1002), key=lambda t: (value(t), -t)) / 1000
    got = quality_rules.judge(docs, labels).collect()
    assert {r.threshold for r in got} == {threshold} and 0 < sum(not r.kept for r in got) < len(got)
    for r in got:
        failed, anomaly = want[r.doc_id]
        assert r.base_failed == failed and r.anomaly == pytest.approx(anomaly) and r.kept == (not failed and anomaly < threshold)
