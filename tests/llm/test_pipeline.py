"""The pipeline's rows against stages worked out apart: rules and languages by their reports, near copies by brute force."""

import hashlib
from collections import Counter

from spanfold.llm import language_id, mixing, quality_rules

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_ids(rows):
    """Smallest id of each component of texts whose five-word shingles have a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in ids})


def test_run_and_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in c.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    seen = []
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or out.columns == docs.columns
        seen.append((docs, out))
        docs = out
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(seen[0][1]) == ids(quality_rules.judge(seen[0][0], spark.read.parquet(f"{SF}/labels.parquet")).filter("kept"))
    assert ids(seen[1][1]) == ids(language_id.identify(seen[1][0]).filter(f"lang_pred <> 'und' and score >= {language_id.MIN_SHARE}"))
    assert ids(seen[2][1]) == kept_ids([(r.doc_id, r.text) for r in seen[2][0].collect()])
    assert sum(len(r.text.encode().split()) for r in seen[3][1].collect()) == sum(r.taken for r in mixing.mix_report(seen[3][0]).collect())
    mixed = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in seen[3][1].collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in seen[4][1].collect()) == mixed
    assert Counter(map(tuple, c.run(spark, SF).collect())) == Counter(map(tuple, seen[4][1].collect()))
