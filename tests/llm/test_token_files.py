import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanfold.llm import token_files as q

PATH = public_tokenizers.path(q.VOCABULARY)
ODD = ["", "Á éx ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "\x1c a\x1fb\x85c d", "it's 1234 !!'s _a_b don'T I'LL", "\t\r\n x", "İstanbul İ ß ŉ", "ﬁ Å", "a　b", "ÀÖØ öøÿ×÷ª"]


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([1, 7, 64, 4096]))
@settings(max_examples=150, deadline=None)
def test_round_trip(ids, block):
    words, escapes, first = q.pack(np.array(ids, np.uint64), block)
    assert q.unpack(words, escapes, first, len(ids), block).tolist() == ids


def test_small_ids_share_words():
    words, escapes, _ = q.pack(np.zeros(10000, np.uint64))
    assert len(words) < 60 and not len(escapes)
    assert len(q.pack(np.full(9, 2**63, np.uint64))[1]) == 9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@given(st.lists(st.text(max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_words_as_the_library(library, texts):
    for text, ids in zip(texts + ODD, q.WordEncoder(PATH).encode(texts + ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_files(spark, library, tmp_path):
    rows = [(7, "one two"), (3, None), (5, ""), (None, "nobody"), (7, "again"), (1, "word " * 3000), *[(100 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    got = q.read_files(q.write_files(docs, f"file://{tmp_path}", PATH, file_bytes=4000)).toPandas()
    assert len(list(tmp_path.glob("tokens-*.s8b"))) > 1
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    have = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.sort_values("start").itertuples()]
    assert sorted(have, key=key) == sorted(want, key=key)
    for r in got.sort_values("start").itertuples():
        assert r.start == start
        start += r.n_tokens


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.read_files(q.write_files(docs, f"file://{tmp_path}", PATH)).count() == 0
