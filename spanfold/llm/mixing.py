"""Operator 6, mixing sources to target weights.

Each source's words form one stream, packed into blocks of BLOCK words. Every output shard draws how many
slots each source gets (multinomial), the draws are then moved by the few slots that separate their sums
from the exact slot counts, and slot k of a source maps to block perm(k mod blocks) of pass k div blocks,
where perm is a keyed Feistel permutation of that source and pass. Slots and blocks join by (source, block),
a key that is even however uneven the sources are.

A document's place in its source's stream comes from a two-level prefix sum (hash buckets, then inside a
bucket), so no task sees a whole source. At most MAX_SHARDS x sources counts are drawn on the driver; the
table of sources (a row each) is the only thing collected.

Defined cases: a null or text without words has size 0 and taken 0; a null source is a source of its own and
the last; repeated rows are documents of their own; equal ids are ordered by size and text hash; an empty
table gives an empty result; further columns are carried by mixed_documents and ignored elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, lean, n_words, read_table, shared_dir, stored

BLOCK, SHARD_SLOTS, MAX_SHARDS, BUCKET_ROWS, SEED = 64, 4096, 8192, 2048, 6
WEIGHTS, GROWTH, MOST_USES = (5, 2, 1), 1.5, 2
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def weigh(names: list) -> list[int]:
    """Weights of sources in code point order, null last, as positions in `names`."""
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    out = [0] * len(names)
    for place, i in enumerate(order):
        out[i] = WEIGHTS[place % len(WEIGHTS)]
    return out


def targets(sizes: list[int], weights: list[int], growth: float = GROWTH, most: int = MOST_USES) -> list[float]:
    """Shares of growth x all sizes by weight; none above most x its size, the excess shared again by weight."""
    found, left, open_ = [0.0] * len(sizes), growth * sum(sizes), list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                found[i] = left * weights[i] / whole
            break
        for i in over:
            found[i] = float(most * sizes[i])
        left -= sum(found[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return found


def spread_evenly(amount: int, over: np.ndarray) -> np.ndarray:
    """`amount` units over cells in proportion to `over`, never more than a cell holds."""
    total = int(over.sum())
    if not total:
        return np.zeros_like(over)
    steps = np.append(0, over.cumsum()).astype(object) * amount // total
    return np.diff(steps).astype(np.int64)


def draw_counts(slots: list[int], shard_slots: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source (columns) in each shard (rows): multinomial draws whose column sums are exactly `slots`."""
    total = sum(slots)
    if not total:
        return np.zeros((0, len(slots)), np.int64)
    shards = -(-total // shard_slots)
    sizes = [shard_slots] * (shards - 1) + [total - shard_slots * (shards - 1)]
    p = np.array(slots, float) / total
    rng = np.random.default_rng(seed)
    counts = np.array([rng.multinomial(n, p) for n in sizes], np.int64)
    off = counts.sum(0) - np.array(slots)
    freed = np.zeros(shards, np.int64)
    for s in np.flatnonzero(off > 0):
        moved = spread_evenly(int(off[s]), counts[:, s])
        counts[:, s] -= moved
        freed += moved
    for s in np.flatnonzero(off < 0):
        moved = spread_evenly(int(-off[s]), freed)
        counts[:, s] += moved
        freed -= moved
    return counts


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1, at the given indices: four Feistel rounds, walked until back inside."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def rounds(x):
        left, right = x >> shift, x & low
        for r in range(4):
            h = (right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _MIX
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(32) & low)
        return left << shift | right

    x = rounds(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = rounds(x[out])
    return x.astype(np.int64)


class Plan:
    """What the driver knows of the sources: names, sizes, targets, blocks, slots."""

    def __init__(self, found: list, block: int = BLOCK):
        found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        self.names, self.sizes = [r["source"] for r in found], [r["size"] for r in found]
        self.rows = sum(r["docs"] for r in found)
        self.targets = targets(self.sizes, weigh(self.names))
        self.blocks = [-(-s // block) for s in self.sizes]
        self.slots = [min(MOST_USES * b, round(t * b / s)) if s else 0 for t, b, s in zip(self.targets, self.blocks, self.sizes)]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, *x) for k, x in enumerate(zip(self.names, self.sizes, self.targets))]
        return spark.createDataFrame(rows, "source_no int, source string, source_size long, target double")


def sized(docs: DataFrame, folder: str, carry: bool = False) -> DataFrame:
    """Stored rows: row (unique), doc_id, source, size, text_hash and, if carried, all columns in `doc`."""
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), *more)
    return stored(own.select(F.monotonically_increasing_id().alias("row"), "*"), folder, "sizes")


def plan_of(rows: DataFrame, block: int = BLOCK) -> Plan:
    return Plan(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect(), block)


def segments(rows: DataFrame, plan: Plan, block: int = BLOCK) -> DataFrame:
    """(source_no, block, row, at, words): the part of each document in each block of its source's stream."""
    spark = rows.sparkSession
    names = plan.table(spark).select("source_no", F.col("source").alias("name"))
    buckets = max(1, -(-plan.rows // BUCKET_ROWS))
    own = rows.filter("size > 0").select("row", "doc_id", "source", "size", "text_hash", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    own = own.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    sums = own.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "text_hash", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = own.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_no", "bucket"])
    placed = placed.select("row", "source_no", "size", (F.col("base") + F.col("inner")).alias("start"))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    at = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    return cut.select("source_no", "block", "row", at.alias("at"), (F.least((F.col("block") + 1) * block - F.col("start"), "size") - at).alias("words"))


def slots(spark: SparkSession, plan: Plan, seed: int = SEED) -> DataFrame:
    """(shard, source_no, slot, pass, block): every slot of the mix and the block it takes."""
    size = max(SHARD_SLOTS, -(-sum(plan.slots) // MAX_SHARDS))
    counts = draw_counts(plan.slots, size, seed)
    first = counts.cumsum(0) - counts
    shard, source = np.nonzero(counts)
    table = list(zip(shard.tolist(), source.tolist(), first[shard, source].tolist(), counts[shard, source].tolist()))
    drawn = spark.createDataFrame(table, "shard int, source_no int, first long, n long").repartition(max(1, min(len(table), -(-sum(plan.slots) // (1 << 20)))), "shard", "source_no")
    ddl, blocks = "shard int, source_no int, slot long, pass int, block long", list(plan.blocks)
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for s, source_no, start, n in zip(*[c.to_pylist() for c in batch.columns]):
                for lo in range(start, start + n, 1 << 16):
                    k = np.arange(lo, min(start + n, lo + (1 << 16)))
                    turn, out = k // blocks[source_no], np.empty(len(k), np.int64)
                    for t in np.unique(turn):
                        here = turn == t
                        out[here] = permute(k[here] % blocks[source_no], blocks[source_no], (seed * 1_000_003 + source_no) * 64 + int(t))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s, np.int32)), pa.array(np.full(len(k), source_no, np.int32)), pa.array(k), pa.array(turn.astype(np.int32)), pa.array(out)], schema=schema)

    return drawn.mapInArrow(lean(run), ddl)


def mixed_blocks(rows: DataFrame, plan: Plan, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix: (shard, source_no, slot, pass, block, row, at, words), one row for each document part in each slot.

    Spark takes the slots to be as few bytes as the drawn counts they come from, and would send them all to the driver to
    broadcast them; the hint has them sorted and merged, whatever spark.sql.autoBroadcastJoinThreshold is.
    """
    return slots(rows.sparkSession, plan, seed).hint("merge").join(segments(rows, plan, block), ["source_no", "block"])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs."""
    rows = sized(docs, shared_dir(docs.sparkSession, "mix"))
    plan = plan_of(rows)
    taken = mixed_blocks(rows, plan).groupBy("row").agg(F.sum("words").alias("taken"))
    table = plan.table(docs.sparkSession).withColumnRenamed("source", "name")
    out = rows.join(taken, "row", "left").join(table, F.col("source").eqNullSafe(F.col("name")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs' own columns, one for each pass that takes words of a document.

    A pass that takes a whole document returns its text as it is; else the words it takes, joined by spaces
    (and n_chars, where there is such a column, counts the new text).
    """
    rows = sized(docs, shared_dir(docs.sparkSession, "mix"), carry=True)
    plan = plan_of(rows)
    parts = mixed_blocks(rows.select("row", "doc_id", "source", "size", "text_hash"), plan).groupBy("row", "pass").agg(F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts"))
    out = rows.join(parts, "row")
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, (p["at"] + 1).cast("int"), p["words"].cast("int")))), " "))[0]
    text = F.when(F.col("n") == F.col("size"), F.col("doc.text")).otherwise(some)
    out = out.select("doc", text.alias("mixed"))
    kinds = dict(docs.dtypes)
    return out.select(*[F.col("mixed").alias("text") if c == "text" else F.length("mixed").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))
