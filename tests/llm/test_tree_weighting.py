import math
import zlib
from collections import Counter

import pytest

from spanfold.llm import tree_weighting as q

D = q.DEPTH
ROWS = [(0, "the cat sat on the mat"), (1, "The dog ate the Cat"), (2, None), (3, ""), (4, "éa bé the catty"), (5, "zebra catalog the the the"), (6, "x" * 50 + " mat"), (3, ""), (None, "the mat"), (9, " \n ")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows):
    """[(id, n_tokens, n_known, train_tokens, base, score)] by recursion over a dictionary of nodes; contexts run over the whole text."""
    trained, ends = Counter(w for i, t in rows if not held(i) for w in words_of(t)), sum(not held(i) for i, _ in rows)

    def symbols(text):
        x = bytes([255] * D) + b"".join(w + b" " for w in words_of(text)) + bytes([255])
        return [(x[k - D : k], x[k]) for k in range(D, len(x))]

    counts, nodes = Counter(g for i, t in rows if not held(i) for g in symbols(t)), {}
    for (context, s), c in counts.items():
        for k in range(8):
            for d in range(D + 1):
                nodes.setdefault((context[D - d :], (1 << k) | (s >> (8 - k))), [0, 0])[s >> (7 - k) & 1] += c
    own = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for n, (a, b) in nodes.items()}
    below, weighted = Counter(), {}
    for d in range(D, -1, -1):
        for n in [n for n in nodes if len(n[0]) == d]:
            high = max(own[n], below[n])
            weighted[n] = own[n] if d == D else high + math.log(math.exp(own[n] - high) + math.exp(below[n] - high)) - math.log(2)
            if d:
                below[(n[0][1:], n[1])] += weighted[n]

    def one(context, h, d=0):
        a, b = nodes.get((context[D - d :], h), (0, 0))
        if d == D or sum(nodes.get((context[D - d - 1 :], h), (0, 0))) == 0:
            return (b + 0.5) / (a + b + 1)
        w = 1 / (1 + math.exp(min(700, below[(context[D - d :], h)] - own[(context[D - d :], h)])))
        return w * (b + 0.5) / (a + b + 1) + (1 - w) * one(context, h, d + 1)

    def lp(context, s):
        return sum(math.log10(p if s >> (7 - k) & 1 else 1 - p) for k in range(8) for p in [one(context, (1 << k) | (s >> (8 - k)))])

    whole, out = sum(trained.values()) + ends, []
    scale = whole + len(trained) + (ends > 0) + 1
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10((trained[w] + 1) / scale) for w in words) + math.log10((ends + 1) / scale)
        out.append((i, len(words) + 1, sum(trained[w] > 0 for w in words) + (ends > 0), whole, base, sum(lp(*g) for g in symbols(t))))
    return out


@pytest.mark.parametrize("limits", [None, (7, 3)])
@pytest.mark.parametrize("rows", [ROWS, [(1, "held out only")], [(5, "one")]])
def test_against_brute_force(spark, monkeypatch, rows, limits):
    if limits:
        monkeypatch.setattr(q, "PIECE_BYTES", limits[0])
        monkeypatch.setattr(q, "BRANCH_GRAMS", limits[1])
    got = q.score(spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r, w in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.held_out == held(r.doc_id)
        assert r.base_score == pytest.approx(w[4], abs=1e-9) and r.score == pytest.approx(w[5], abs=1e-6)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (sum(len(x) + 1 for x in words_of(dict(rows)[r.doc_id])) + 1))


def test_chunks_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.score for r in q.query(spark, "/root/testdata/sf0.001").collect()}
    parts = {r.doc_id: r.score for r in q.score(docs.repartition(7)).collect()}
    assert len(whole) == 200 and all(parts[i] == pytest.approx(s, abs=1e-6) for i, s in whole.items())


def test_held_out_text_is_better_than_the_base(spark):
    rows = [r for r in q.query(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty(spark):
    assert q.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
