"""License scans against a plain count over all blocks and templates."""

import random
import re

import pytest

from spanfold.llm import license_scan as q

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_met(text, templates):
    """(first word, template, label, share) of all blocks."""
    own, out, start = words(text), [], 0
    while start == 0 or start + 16 < len(own):
        block = set(own[start : start + 32])
        for k, (label, template) in enumerate(templates):
            t = set(words(template))
            if len(block & t) >= 0.85 * len(t) - 1e-9:
                out.append((start, k, label, len(block & t) / len(t)))
        start += 16
    return out


def brute(doc_id, text, templates):
    own, places, base = words(text), [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    met = brute_met(text, templates)
    score = 1.0 if base else max((m[3] for m in met), default=0.0)
    return doc_id, len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m[2] for m in met})), score


def some(rng, n):
    filler = [f"w{k}" for k in range(300)] + "the of to and in is under a license software terms or public by version file".split() * 8
    rows = []
    for i in range(n):
        text = rng.choices(filler, k=rng.randrange(0, 150))
        for _ in range(rng.randrange(0, 3)):
            notice = words(rng.choice(q.TEMPLATES)[1]) if rng.random() < 0.8 else rng.choice(["All Rights RESERVED", "cc by cc by", "general  public-license"]).split()
            for _ in range(rng.randrange(0, 4)):
                notice[rng.randrange(len(notice))] = rng.choice(filler)
            at = rng.randrange(len(text) + 1)
            text[at:at] = notice
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "\n", ", "]).join(text)))
    return rows + [(1, None), (2, ""), (3, " .,;"), (4, "é1 Ünder"), *rows[:4]]


def check(spark, rows, templates=q.TEMPLATES):
    out, met = q.scan(spark.createDataFrame(rows, SCHEMA), templates)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((brute(*r, templates) for r in rows), key=str)
    want = [(i, *m) for i, text in rows for m in brute_met(text, templates)]
    assert sorted(map(tuple, met.collect()), key=str) == sorted(want, key=str)
    return want


def test_equals_a_count_over_all_blocks(spark):
    assert len({w[3] for w in check(spark, some(random.Random(3), 300))}) > 8


@pytest.mark.parametrize("seed", range(3))
def test_random_templates(spark, seed):
    """Few words in all, so that sets overlap in every way."""
    rng = random.Random(seed)
    pool = [f"t{k}" for k in range(25)]
    templates = [(f"l{k % 5}", " ".join(rng.choices(pool, k=rng.randrange(1, 17)))) for k in range(12)]
    rows = [(i, " ".join(rng.choices(pool + [f"w{k}" for k in range(40)], k=rng.randrange(0, 120)))) for i in range(150)]
    assert check(spark, rows, templates)


def test_a_notice_is_found_wherever_it_stands(spark):
    notice = q.TEMPLATES[1][1]
    rows = [(i, " ".join(["w"] * i + [notice] + ["v"] * 40)) for i in range(70)]
    out, _ = q.scan(spark.createDataFrame(rows, SCHEMA))
    assert [(r.labels, r.score) for r in out.collect()] == [("mit", 1.0)] * 70


def test_long_texts_and_clashing_names(spark):
    text = "w " * 700_000 + "cc by " + "v" * 3_000_000 + " Released under the MIT License"
    docs = spark.createDataFrame([(5, text, 1, "x"), (6, "plain", 2, "y")], "doc_id long, text string, row int, labels string")
    out, _ = q.scan(docs)
    assert sorted(map(tuple, out.collect())) == sorted([brute(5, text, q.TEMPLATES), brute(6, "plain", q.TEMPLATES)])


def test_no_rows_and_bounds(spark):
    assert q.scan(spark.createDataFrame([], SCHEMA))[0].collect() == []
    for bad in ([("x", "")], [("x", "w " * 30)]):
        with pytest.raises(ValueError):
            q.Templates(bad)
