import zlib
from collections import Counter

import numpy as np

from spanfold.llm import language_id, quality_rules, weak_quality

TEXTS = [None, "", " \n\t ", "one", "a b c a b c d", "x\nx\n y\n y\n\n", "The The The The The", "#a *b $c | d <e>", "word " * 200, "é à ü \x1c z", "q" * 4000, " ".join(f"w{i}" for i in range(300)) + "\nend\nend"]


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def documents(spark, texts, more="n_words string, kept int"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[-1], "x", 1)], f"doc_id long, text string, {more}")


def test_counts(spark):
    for t in TEXTS:
        assert quality_rules.text_stats(t)[:5] == brute(t)
    out = quality_rules.judge(documents(spark, TEXTS), None).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        n, _, _, _, again = brute(TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[-1])
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and (r.kept is False or not r.base_failed)
    empty = documents(spark, TEXTS).limit(0)
    assert quality_rules.judge(empty, None).count() == 0 and quality_rules.accepted(empty, None).count() == 0


def test_forest_finds_the_odd_rows():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 0.01, (2000, 4))
    rows[:20] += 3
    score = quality_rules.Forest(rows).score(rows)
    assert score[:20].min() > score[20:].max() and (0 < score).all() and (score < 1).all()
    assert (quality_rules.Forest(np.zeros((50, 3))).score(np.zeros((5, 3))) > 0).all()


def test_judges_and_stage_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in quality_rules.accepted(docs, labels).collect()} == kept and 100 < len(kept) < 200


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_mixture_and_edges(spark):
    fr, en = "le chat est dans la maison avec une pomme ", "the cat is in the house with an apple "
    rows = [(i, (fr if i % 2 else en) * 3, "fr" if i % 2 else "en") for i in range(40)] + [(100, None, "en"), (101, "1234 !!", "fr"), (102, en * 2, None), (103, fr * 5 + en * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert [got[i].lang_pred for i in (0, 1, 100, 101, 102, 103)] == ["en", "fr", "und", "und", "en", "fr"]
    assert got[100].score == 0 and 0.5 < got[103].score < 0.8 < got[102].score
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    assert language_id.accepted(docs.limit(0)).count() == 0 and language_id.accepted(unlabelled).count() == 42


def test_weak_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = weak_quality.classify(docs)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_weak_edges(spark):
    out = weak_quality.classify(documents(spark, TEXTS, "posterior string, kept int")).collect()
    assert len(out) == len(TEXTS) + 1 and all(0 <= r.posterior <= 1 and 0 <= r.score <= 1 for r in out)
    assert weak_quality.classify(documents(spark, TEXTS).limit(0)).count() == 0
