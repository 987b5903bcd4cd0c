"""Operator 11, audit of how sources of a language diverge: group-block tiling of all pairs of sources.

A group is a source of a language. Terms are runs of letters (A-Z in lower case); a language keeps those in at least MIN_DOCS of
its documents. A group's share of a kept term is 1 + floor(10^9 (count + 1) / (N + V)), in whole numbers throughout.

Counts: tasks count terms of their documents, cut to pieces at the ends of terms, and Spark adds the counts up. Kept terms are
dealt to vocabulary chunks of about CHUNK terms by their hash, and numbered within their chunk. A group's counts within a chunk
are one packed row of numbers and counts. Groups are dealt to blocks of TILE; a tile is a pair of blocks and a stripe of STRIPE
chunks. Packed rows are sent to all tiles of their block, sorted by chunk, so a tile holds one chunk at a time and its square of
sums; the sums of stripes are added by Spark. Both directions of a pair come from the same tile. Terms that no group of a tile
has are alike, so they count once, times their number.

Terms that set a group apart need the group's and the language's counts only; the first TOP of each group are kept before the
shuffle and after it.

Defined cases: null text, lang and source count as empty; so does the text without terms, whose group is there with count 0 of
every term; a language without kept terms has pairs of value 0; a language with one source has no pairs; repeated rows count
as often as they come; ids are not read; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, lean, read_table, shared_dir, small_batches, stored

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
MIN_DOCS, TOP, SCALE = 3, 200, 10**9
#: Bytes of text looked at at once; different terms that a task counts before it hands them on.
PIECE_BYTES, MOST_TERMS = 1 << 20, 1 << 18
COUNTS = "lang string, source string, term string, n long, docs long"
GROUP = ["lang", "source"]
PAIRS = "lang string, source string, item string, value long"


@dataclass(frozen=True)
class Tiling:
    """Groups of a block; terms of a chunk, about; chunks of a stripe."""

    tile: int = 32
    chunk: int = 4096
    stripe: int = 4


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE_BYTES that end where a term ends."""
    lo = 0
    while lo < len(raw):
        end = NO_TERM.search(raw, lo + PIECE_BYTES)
        hi = end.start() if end else len(raw)
        yield raw[lo:hi]
        lo = hi


def counted_terms(docs: DataFrame) -> DataFrame:
    """COUNTS added up: occurrences of each term in each group, and documents of the group that have it."""
    schema = arrow_schema(COUNTS)

    def run(batches):
        n, had = defaultdict(Counter), defaultdict(Counter)

        def told():
            for (lang, source), own in n.items():
                k, docs_of = len(own), had[lang, source]
                columns = [[lang] * k, [source] * k, [t.decode() for t in own], list(own.values()), [docs_of[t] for t in own]]
                for lo in range(0, k, 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 14)], f.type) for c, f in zip(columns, schema)], schema=schema)
            n.clear()
            had.clear()

        for batch in small_batches(batches, "text"):
            for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                seen: set[bytes] = set()
                for piece in pieces(text.encode().lower()):
                    terms = TERM.findall(piece)
                    n[lang, source].update(terms)
                    seen.update(terms)
                had[lang, source].update(seen)
            if sum(map(len, n.values())) > MOST_TERMS:
                yield from told()
        yield from told()

    rows = docs.select(*GROUP, "text").mapInArrow(lean(run), COUNTS)
    return rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_sql(count: str, whole: str) -> str:
    """1 + floor(SCALE (count + 1) / whole), by long division three digits at a time, as the product may not fit."""
    rest, digits = f"({count} + 1)", []
    for _ in range(3):
        digits.append(f"({rest} * 1000 div {whole})")
        rest = f"({rest} * 1000 % {whole})"
    return f"({digits[0]} * 1000000 + {digits[1]} * 1000 + {digits[2]} + 1)"


def shares(counts: np.ndarray, wholes: np.ndarray) -> np.ndarray:
    """share_sql of arrays."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, wholes).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, wholes)
        out = out * 1000 + digit
    return out + 1


class Tile:
    """Sums of one pair of blocks over the chunks of a stripe; a block paired with itself has only left groups."""

    def __init__(self, same: bool):
        self.same, self.names, self.wholes = same, ([], []), ([], [])
        self.size, self.vectors, self.begun = 0, ([], []), False

    def roster(self, side: int, source: str, whole: int) -> None:
        self.names[side].append(source)
        self.wholes[side].append(whole)

    def begin(self) -> None:
        """The roster is whole."""
        if self.begun:
            return
        self.begun = True
        if self.same:
            self.names, self.wholes = (self.names[0],) * 2, (self.wholes[0],) * 2
        self.number = [{s: k for k, s in enumerate(names)} for names in self.names]
        self.whole = [np.array(w, np.int64)[:, None] for w in self.wholes]
        shape = len(self.names[0]), len(self.names[1])
        self.there, self.back = np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def vector(self, side: int, source: str, at: np.ndarray, n: np.ndarray) -> None:
        self.vectors[side].append((self.number[side][source], at, n))

    def chunk(self) -> None:
        """Adds the chunk whose vectors have come."""
        if not self.size:
            return
        vectors = (self.vectors[0],) * 2 if self.same else self.vectors
        some = [at for side in self.vectors for _, at, _ in side]
        terms = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
        p = []
        for own, whole in zip(vectors, self.whole):
            counts = np.zeros((len(whole), len(terms) + 1), np.int64)  # the last stands for a term that no group has
            for k, at, n in own:
                counts[k, np.searchsorted(terms, at)] = n
            p.append(shares(counts, whole))
        times = np.append(np.ones(len(terms), np.int64), self.size - len(terms))
        for k, row in enumerate(p[0]):
            square = (row - p[1]) ** 2
            self.there[k] += (square // p[1]) @ times
            if not self.same:
                self.back[k] += (square // row) @ times
        self.size, self.vectors = 0, ([], [])

    def done(self) -> Tile:
        self.begin()
        self.chunk()
        return self

    def told(self, lang: str) -> Iterator[tuple]:
        left, right = self.names
        for a, source in enumerate(left):
            for b, item in enumerate(right):
                if not self.same:
                    yield lang, source, item, int(self.there[a, b])
                    yield lang, item, source, int(self.back[a, b])
                elif a != b:
                    yield lang, source, item, int(self.there[a, b])


def tiled(rows: DataFrame) -> DataFrame:
    """PAIRS of the rows of all tiles: roster rows (kind 0), sizes of chunks (1), packed rows (2)."""
    schema = arrow_schema(PAIRS)

    def run(batches):
        def told():
            for key, tile in tiles():
                found = list(tile.told(key[0]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        def tiles():
            key, tile, chunk = None, None, -1
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for k, (lang, i, j, stripe, own, kind, side, source, whole) in enumerate(zip(*[c.to_pylist() for c in columns[:9]])):
                    if (lang, i, j, stripe) != key:
                        if tile is not None:
                            yield key, tile.done()
                        key, tile, chunk = (lang, i, j, stripe), Tile(i == j), -1
                    if kind == 0:
                        tile.roster(side, source, whole)
                        continue
                    tile.begin()
                    if own != chunk:
                        tile.chunk()
                        chunk = own
                    if kind == 1:
                        tile.size = whole
                    else:
                        tile.vector(side, source, *[np.asarray(c[k].values.to_numpy(), np.int64) for c in columns[9:11]])
            if tile is not None:
                yield key, tile.done()

        yield from told()

    return rows.mapInArrow(lean(run), PAIRS)


def tile_rows(groups: DataFrame, cells: DataFrame, sizes: DataFrame, tiling: Tiling) -> DataFrame:
    """All rows of all tiles, those of a tile together, by chunk."""
    none = lambda kind: F.lit(None).cast(kind)
    packed = cells.groupBy(*GROUP, "chunk").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("own"))
    packed = packed.join(groups.select(*GROUP, "block", "blocks"), GROUP)
    empty = {"number": none("array<int>"), "n": none("array<long>")}
    roster = groups.select(*GROUP, "block", "blocks", F.lit(-1).alias("chunk"), F.lit(0).alias("kind"), (F.col("words") + F.col("v")).alias("whole"), F.explode(F.expr(f"sequence(0, (chunks - 1) div {tiling.stripe})")).alias("stripe")).withColumns(empty)
    vectors = packed.select(*GROUP, "block", "blocks", "chunk", F.lit(2).alias("kind"), none("long").alias("whole"), F.expr(f"chunk div {tiling.stripe}").alias("stripe"), F.col("own.number").alias("number"), F.col("own.n").alias("n"))
    rows = roster.unionByName(vectors).withColumns({"stripe": F.col("stripe").cast("int")})
    left = rows.select("*", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), F.lit(0).alias("side"))
    right = rows.filter("block > 0").select("*", F.explode(F.expr("sequence(0, block - 1)")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    whole = groups.filter("block = 0").groupBy("lang").agg(F.first("blocks").alias("blocks"))
    heads = sizes.join(whole, "lang").select("lang", "chunk", "size", "blocks", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"))
    heads = heads.select("lang", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"), F.expr(f"cast(chunk div {tiling.stripe} as int)").alias("stripe"), "chunk", F.lit(1).alias("kind"), F.lit(0).alias("side"), none("string").alias("source"), F.col("size").alias("whole")).withColumns(empty)
    key = ["lang", "i", "j", "stripe"]
    columns = [*key, "chunk", "kind", "side", "source", "whole", "number", "n"]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = left.select(*columns).unionByName(right.select(*columns)).unionByName(heads.select(*columns))
    return out.repartition(n, *key).sortWithinPartitions(*key, "chunk", "kind", "side", "source")


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """RESULT of rows of (lang, source, item, value), the first `most` of each group."""
    place = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", place)
    out = out if most is None else out.filter(F.col("rank") <= most)
    return out.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def audit(docs: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of each group, and the terms that set it apart."""
    folder = shared_dir(docs.sparkSession, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    counts = stored(counted_terms(docs), folder, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    kept = stored(kept.select("lang", "term", "lang_n"), folder, "kept")
    names = stored(docs.select(*GROUP).distinct(), folder, "names")
    langs = names.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_words")), "lang", "left").fillna(0, ["v", "lang_words"])
    langs = stored(langs.withColumn("chunks", F.expr(f"cast(greatest(1, (v + {tiling.chunk} - 1) div {tiling.chunk}) as int)")), folder, "langs")
    numbered = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    numbered = stored(numbered.withColumn("number", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks"), folder, "numbered")
    cells = stored(counts.select(*GROUP, "term", "n").join(numbered, ["lang", "term"]), folder, "cells")
    groups = names.join(cells.groupBy(*GROUP).agg(F.sum("n").alias("words")), GROUP, "left").fillna(0, ["words"]).join(langs, "lang")
    # Every pair of a language's groups is a row of the result, so a task may well number its groups.
    place = F.row_number().over(W.partitionBy("lang").orderBy("source"))
    groups = groups.withColumn("place", place).withColumn("block", F.expr(f"cast((place - 1) div {tiling.tile} as int)"))
    groups = stored(groups.withColumn("blocks", F.max("block").over(W.partitionBy("lang")) + 1).drop("place"), folder, "groups")
    pairs = tiled(tile_rows(groups, cells, numbered.groupBy("lang", "chunk").agg(F.count("*").alias("size")), tiling))
    pairs = pairs.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    shared = cells.join(groups.select(*GROUP, "words", "lang_words", "v"), GROUP)
    shared = shared.select(*GROUP, F.col("term").alias("item"), F.expr(share_sql("n", "(words + v)")).alias("p"), F.expr(share_sql("lang_n", "(lang_words + v)")).alias("q")).filter("p > q")
    terms = shared.withColumn("value", F.expr("(p - q) * (p - q) div q"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term", TOP))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents),
  t as (select id, lang, source, unnest(terms) as term from d),
  k as (select lang, term, count(*) as lang_n from t group by 1, 2 having count(distinct id) >= 3),
  l as (select lang, count(*) as v, sum(lang_n) as lang_words from k group by 1),
  c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by 1, 2, 3),
  g as (select d.lang, d.source, coalesce(w.words, 0) as words from (select distinct lang, source from d) d left join (select lang, source, sum(n) as words from c group by 1, 2) w using (lang, source)),
  f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 1) // (g.words + l.v) as p, 1 + cast(1000000000 as hugeint) * (k.lang_n + 1) // (l.lang_words + l.v) as q
    from g join k using (lang) join l using (lang) left join c on (c.lang = g.lang and c.source = g.source and c.term = k.term)),
  v as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from f a join f b on (a.lang = b.lang and a.term = b.term and a.source <> b.source) group by 1, 2, 3),
  p as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v.value, 0) as value from g a join g b on (a.lang = b.lang and a.source <> b.source) left join v on (v.lang = a.lang and v.source = a.source and v.item = b.source)),
  s as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from f where n > 0 and p > q),
  r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from p union all select * from s))
  select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 200"""
