"""The divergence audit against whole-number loops over all terms and groups, and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from spanfold.llm import divergence as q

SCHEMA = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, top = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], top[t])) for t in kept if counts[lang, s][t] and p[s][t] > top[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def some(rng, n, sources=9):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)] + ["Été", "ÀB", "日本語", "THE"]
    rows = []
    for i in range(n):
        own = rng.choices(words, k=rng.choice([0, 1, 30, 200]))
        text = rng.choice([None, "", " 12 . "]) if rng.random() < 0.1 else rng.choice([" ", "-", "9", "\n"]).join(own)
        rows.append((i, text, rng.choice(["en"] * 5 + ["fr", None, ""]), rng.choice([f"s{k}" for k in range(sources)] + ["s0"] * 4 + [None])))
    rows += [(n, None, "empty", "a"), (n + 1, "", "empty", "b"), (n + 2, "alone", "single", "z")] + rows[:3]
    return rows


def found(spark, rows, tiling=q.Tiling()):
    out = q.audit(spark.createDataFrame(rows, SCHEMA), tiling)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("tiling", [q.Tiling(), q.Tiling(2, 16, 2)])
def test_equals_loops_over_all_terms(spark, tiling):
    rows = some(random.Random(5), 300)
    want = brute(rows)
    assert found(spark, rows, tiling) == want
    assert len([r for r in want if r[2] == "pair" and r[0] == "empty" and r[4] == 0]) == 2


def test_ranks_end_at_two_hundred(spark):
    rng = random.Random(2)
    terms = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(700)]
    rows = [(i, " ".join(terms[350 * (i % 2) : 350 * (i % 2) + 350]), "en", f"s{i % 2}") for i in range(8)]
    got = found(spark, rows)
    assert got == brute(rows) and max(r[5] for r in got) == 200


def test_equals_sql(spark):
    rows = some(random.Random(8), 120)
    with duckdb.connect() as c:
        c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
        c.executemany("insert into documents values (?, ?, ?, ?)", rows)
        assert sorted(c.execute(q.ORACLE_SQL).fetchall()) == found(spark, rows)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    for text in ("ab cde  f" * 50, "é" * 300, "", "x 9" * 40):
        monkeypatch.setattr(q, "PIECE_BYTES", 7)
        raw = text.encode()
        assert b"".join(q.pieces(raw)) == raw and [t for p in q.pieces(raw) for t in q.TERM.findall(p)] == q.TERM.findall(raw)


def test_large_counts_stay_exact(spark):
    rng, counts, wholes = random.Random(1), [], []
    for _ in range(200):
        whole = rng.randrange(1, 9 * 10**15)
        wholes.append(whole)
        counts.append(rng.choice([0, whole - 1, rng.randrange(whole)]))
    want = [1 + 10**9 * (c + 1) // w for c, w in zip(counts, wholes)]
    assert q.shares(np.array(counts), np.array(wholes)).tolist() == want
    rows = spark.createDataFrame(list(zip(counts, wholes)), "c long, w long").selectExpr(f"{q.share_sql('c', 'w')} as p")
    assert [r.p for r in rows.collect()] == want


def test_no_rows(spark):
    assert found(spark, []) == []
