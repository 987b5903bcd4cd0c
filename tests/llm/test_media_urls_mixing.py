import hashlib
import io
import tarfile
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanfold.llm import media, mixing, url_filter

TEXTS = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (4, "abc"), (None, "é" * 1000), (6, "x" * 100000), (7, "abc\0")]


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(raw):
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    image = media.to_png(payload)
    assert media.from_png(image) == payload and media.header_of(image[: media.HEADER_BYTES]) == (64, len(payload) // 64, 8, 0)


def test_media(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, digest string").coalesce(1)
    rows = media.write_shards(docs, f"file://{tmp_path}", shard_bytes=1500)
    places = media.addresses(rows)
    assert places.count() == 4 and rows.count() == len(TEXTS)
    found = {r.payload_sha256: r for r in media.read_back(places).collect()}
    for _, t in TEXTS:
        n, payload = media.payload_of(t)
        r = found[hashlib.sha256(payload).hexdigest()]
        assert r.digest == r.payload_sha256 and r.payload_bytes == len(payload) and r.tail_crc32 == zlib.crc32(payload[-64:])
    shards = list(tmp_path.glob("*.tar"))
    assert len(shards) > 1
    for r in places.collect():
        with open(r.shard.removeprefix("file://"), "rb") as f:
            data = f.read()
        image = data[r.offset : r.offset + r.length]
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            assert tar.extractfile(f"{r.digest}.png").read() == image
    assert {(m.width, m.height) for m in media.metadata(places).collect()} == {(64, len(media.payload_of(t)[1]) // 64) for _, t in TEXTS}
    empty = media.write_shards(docs.limit(0), f"file://{tmp_path}/none")
    assert media.read_back(media.addresses(empty)).count() == 0


URLS = ["http://a.com", "http://A.com/x?q=1#f", "https://www.example.com/en/a", "https://x.www.example.com/en/", "http://example.com/en/b", "http://notexample.com/en/b", "http://b.example.com/en", "ftp://q.net/es/1", "q.net/fr/1", None, "", "://", "http://c.org/p?utm_source=x", "http://www.c.org/p/", "http://c.org:80/p.html?b=2&a=1", "http://c.org/p?a=1&ref=9&b=2#z", "http://h.org/a\nb?x\ny", "http://net/fr/", "a?x=http://e.org/p"]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, "http://c.org/p", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge(pages, url_filter.repeated_urls(pages)).toPandas()
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("raw", frame)
    con.sql("create view pages as select cast(page_id as bigint) as page_id, url, '' as html from raw")
    want = con.sql(url_filter.ORACLE_SQL).df()
    text = lambda d: sorted(str([None if pd.isna(v) else str(v).removesuffix('.0') for v in r]) for r in d[["page_id", "host", "path", "rule", "verdict"]].astype(object).values.tolist())
    assert text(got) == text(want)
    by = {r.page_id: r for r in got.itertuples()}
    assert by[0].host == "a.com" and by[0].path == "" and pd.isna(by[0].rule)
    assert by[2].rule == "www.example.com/en/" and by[4].verdict == "block" and by[5].rule == "com/" and by[12].verdict == by[13].verdict == "block"
    assert url_filter.judge(pages.limit(0), url_filter.repeated_urls(pages)).count() == 0
    assert url_filter.judge(pages, url_filter.repeated_urls(pages.limit(0))).filter("rule is null and verdict = 'block'").count() == 0


@pytest.mark.parametrize("most_bytes", [url_filter.MOST_BLOCK_BYTES, 0])
def test_bloom(spark, tmp_path, most_bytes):
    """No false negatives, few false positives, whether blocks are broadcast or joined; frequent urls keep their rows."""
    listed = url_filter.stored(spark.range(3000).selectExpr("concat('u', id) canonical"), f"file://{tmp_path}", "list")
    rows = spark.range(40000).selectExpr("id row", "case when id % 3 = 0 then 'u7' when id % 7 = 0 then 'v7' when id % 11 > 0 then concat('u', id) end canonical")
    _, asked = url_filter.with_possible(rows, listed, f"file://{tmp_path}/a", most_bytes)
    held = {r.canonical for r in asked.filter("maybe").collect()}
    want = {r.canonical for r in rows.filter("canonical like 'u%'").collect() if int(r.canonical[1:]) < 3000}
    assert want <= held and len(held - want) < 0.005 * 20000
    for most_frequent in (10_000, 4):
        got = url_filter.with_listed(rows, listed, f"file://{tmp_path}/b{most_frequent}", most_bytes, most_frequent).collect()
        assert len(got) == 40000 and len({r.row for r in got}) == 40000 and all(r.listed == (r.canonical in want) for r in got)


def test_long_url(spark):
    long = "http://h.net/" + "a/" * 500_000
    pages = spark.createDataFrame([(1, long), (2, long), (3, long + "b")], "page_id long, url string")
    got = {r.page_id: (len(r.path), r.verdict) for r in url_filter.judge(pages, url_filter.repeated_urls(pages)).collect()}
    assert got == {1: (1_000_001, "block"), 2: (1_000_001, "block"), 3: (1_000_002, "allow")}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097])
def test_permutation(n):
    out = [mixing.permute(np.arange(n), n, key) for key in (1, 2)]
    assert all(sorted(x.tolist()) == list(range(n)) for x in out) and (n < 17 or (out[0] != out[1]).any())


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([10, 1000], [5, 2])[0] == 20 and mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert mixing.weigh(["b", None, "a", "c"]) == [2, 5, 5, 1]


def test_draws_meet_the_slots():
    counts = mixing.draw_counts([5000, 20, 0, 313], 64)
    assert counts.sum(0).tolist() == [5000, 20, 0, 313] and (counts >= 0).all() and set(counts.sum(1)[:-1]) == {64}


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("n_chars", "taken").select("doc_id", "text", "source", "taken")
    first = mixing.mix_report(docs).toPandas()
    again = mixing.mix_report(docs.repartition(5)).toPandas()
    key = lambda d: sorted(map(tuple, d.values.tolist()))
    assert key(first) == key(again) and (first.taken <= 2 * first["size"]).all()
    by = first.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), size=("size", "sum")).reset_index()
    assert ((by.taken - by.target).abs() <= 0.03 * by.target + 64).all() and (by["size"] == by.source_size).all()
    mixed = mixing.mixed_documents(docs)
    words = sum(len(r.text.encode().split()) for r in mixed.collect())
    assert words == first.taken.sum() and mixed.columns == docs.columns


def test_mix_edges(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "s"), (4, None, "s"), (5, "", "z"), (6, "w " * 5000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_report(docs).collect()
    assert len(out) == 6 and {(r.doc_id, r.size) for r in out} == {(1, 2), (None, 1), (4, 0), (5, 0), (6, 5000)}
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_slots_are_not_broadcast(spark):
    """A few drawn counts make megabytes of slots: they are merged with the blocks, not sent to the driver to broadcast them."""
    docs = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "repeat('w ', 2000 + cast(id as int)) as text", "concat('s', id % 3) as source")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        rows = mixing.sized(docs, mixing.shared_dir(spark, "slots"))
        plan = mixing.plan_of(rows)
        mix = mixing.mixed_blocks(rows, plan)
        held = mix.agg({"words": "sum"})
        words = held.collect()[0][0]  # of this very frame, whose plan is looked at
        ran = held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert abs(words - sum(plan.targets)) <= 0.01 * words and sum(plan.slots) > 15_000
    joined = [line.split("+- ")[-1] for line in ran.split("\n") if "Join [source_no" in line and "block#" in line]
    assert joined and not any("Broadcast" in line for line in joined)
