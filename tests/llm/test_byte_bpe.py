import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanfold.llm import byte_bpe as q

PATH = public_tokenizers.path(q.VOCABULARY)
RANKS = q.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", None, "a", "  a  b", "x\n \ny", "x \n y\n  z", "a\n ", "\x1c \x1d a\x1f", "don't we'll ''s", "²½ 12³ Ⅷ", "   x", "é" * 300, "ab" * 500, " " * 100 + "x", "\U0001f600 hi　 you", "a\x85 b", "0" * 200, "the quick_brown fox---", "<|endoftext|>", " lead", "trail ", "zqxjkvbw" * 400]


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sab1é\x85　\x1c\xa0-²"), st.characters(exclude_categories=["Cs"]))), max_size=4))
@settings(max_examples=400, deadline=None)
def test_cuts(texts):
    cutter = q.Cutter(RANKS, public_tokenizers.PATTERN)
    new, places, ends = cutter.cut(texts)
    tokens = q.pieces(RANKS)
    for t, lo, hi in zip(texts, ends[:-1], ends[1:]):
        words = [new[p] if p >= 0 else tokens[~p] for p in places[lo:hi]]
        assert b"".join(words) == t.encode()
        assert [i for w in words for i in LIBRARY.encode_ordinary(w.decode())] == LIBRARY.encode_ordinary(t)


@pytest.mark.parametrize("limits", [(200, 20), (50, 1), (1 << 20, 1 << 20)])
def test_fold(spark, limits):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)] + [(3, ODD[3], 5), (None, "nobody here", 5)], "doc_id long, text string, ids int")
    coded = q.encode(docs, RANKS, public_tokenizers.PATTERN, *limits)
    rows = coded.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r.ids == LIBRARY.encode_ordinary("nobody here" if r.doc_id is None else ODD[r.doc_id] or "")
    for r in q.decode(coded, RANKS).collect():
        assert r.decoded.decode() == ("nobody here" if r.doc_id is None else ODD[r.doc_id] or "")


def test_random_words(spark):
    import random

    rng = random.Random(9)
    texts = ["".join(rng.choices("aeinrstlo", k=rng.randrange(1, 60))) for _ in range(2000)] + ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in q.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == LIBRARY.encode_ordinary(texts[r.doc_id])


def test_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.digest(docs, PATH).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert q.digest(docs.limit(0), PATH).count() == 0


@given(st.lists(st.sampled_from(["ab", "a", "the", "q", "é", "zz", "ing", "0"]), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_long_words_merge_in_the_same_order(parts):
    word = "".join(parts).encode()
    assert q.merged_ids(word, RANKS) == LIBRARY._core_bpe.encode_single_piece(word)


def test_very_long_words(spark):
    import random
    import time

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(rng.choices(letters, k=50_000)), "ab" * 600, "x" * 1025, "é" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in q.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == LIBRARY.encode_ordinary(texts[r.doc_id])
    word, start = "".join(rng.choices(letters, k=1 << 20)).encode(), time.monotonic()
    ids = q.merged_ids(word, RANKS)
    assert b"".join(map(q.pieces(RANKS).__getitem__, ids)) == word and time.monotonic() - start < 60


def test_plan_does_not_spell_out_the_rank_map(spark):
    docs = spark.createDataFrame([(0, "zqxjkvbw")], "doc_id long, text string")
    coded = q.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert len(coded._jdf.queryExecution().toString()) < 200_000
    assert coded.first().ids == LIBRARY.encode_ordinary("zqxjkvbw")
