"""Near copies of the corpus pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts that are equal word for word (A-Z in lower case) collapse to one row first. Then operator 3's method draws the
candidates: 64-bit SimHash fingerprints of the shingles, covering masks over either half of the bits that miss no pair
of RADIUS differing bits, spanning edges, components. The exact similarity decides within each component of fingerprints.

Fingerprints of texts at similarity 0.8 differ in 10 bits on average, in over 20 at times, which no covering family of
practical size reaches, so a check of what they left apart follows: each text gets BANDS keys, a key from ROWS minima of its
shingles' hashes; two texts of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, so a pair at 0.8 is
missed once in 20 million. Groups whose texts SimHash has all linked are done, those with the same members under several
keys count once. Again the exact similarity decides; groups yield the edges of a spanning forest of their links, never all pairs.

A group of over SPLIT_ROWS texts or SPLIT_SHINGLES shingles is dealt in blocks, so a task holds one block at most. Its
blocks are held against the group's first text, what that leaves against HEADS of the texts linked to it, and what is
still left against all blocks, block by block. What is settled belongs to one component, so no link is lost. A large
group costs its size times what it leaves: little where texts are near copies, up to the square where they only share a key.

Defined cases: a text of fewer than five words is one shingle; texts without words (null, empty, white space) are equal
to each other; null ids and repeated rows are kept as rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_schema, chosen, free_name, gathered, lean, shared_dir, small_batches, stored, texts_of
from .simhash import components

SHINGLE, BANDS, ROWS, SEED, STEP = 5, 32, 4, 42, 4096
#: Differing bits of linked fingerprints; fingerprints of one key that a task holds at most (they are bare numbers).
RADIUS, SPLIT_PRINTS = 9, 1 << 15
SPLIT_ROWS, SPLIT_SHINGLES, HEADS = 2048, 1 << 22, 64
_RANDOM = np.random.default_rng(SEED)
ADD = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes.lower() touches A-Z only


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_of = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.append(0, ends[:-1] + 1)[: max(1, len(words) - SHINGLE + 1)]
    spans = zip(starts.tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())
    return np.unique(np.array([hash_of(joined[a:b], SEED) for a, b in spans], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed key for each band; no shingles, no keys."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), STEP):
        low = np.minimum(low, ((found[at : at + STEP] ^ ADD) * TIMES).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(low.reshape(BANDS, ROWS))]


def prints(rows: DataFrame) -> DataFrame:
    """number, t1 and t2 (the words' 128-bit hash), number of shingles, fingerprint and band keys of each row of (number, text)."""
    ddl = "number long, t1 long, t2 long, size long, fp long, keys array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in small_batches(batches, "text"):
            words = [words_of(t) for t in texts_of(batch)]
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in words), np.int64).reshape(-1, 2)
            found = [shingles(w) for w in words]
            fps = np.array([simhash.majority(x) for x in found], np.uint64).view(np.int64)
            columns = [batch.column(0), whole[:, 0], whole[:, 1], [len(x) for x in found], fps, [band_keys(x) for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(lean(run), ddl)


def spanning_edges(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (root, member) of the components under links of similarity 0.8 or more."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, edges = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front and left.any():
            own = sets[k := front.pop()]
            open_ = left[owner]
            flat, owner = flat[open_], owner[open_]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.bincount(owner, own[at] == flat, len(sets)).astype(np.int64)
            near = np.flatnonzero(left & (9 * shared >= 4 * (sizes + sizes[k])))  # shared / union >= 4 / 5
            left[near] = False
            front.extend(near.tolist())
            edges += [(ids[root], ids[i]) for i in near.tolist()]
    return edges


def links(members: DataFrame) -> DataFrame:
    """Edges (a, b) between texts; members: key, number, text."""
    ddl = "a long, b long"
    schema = arrow_schema(ddl)

    def run(batches):
        key, ids, sets = None, [], []

        def emit():
            pairs = np.array(spanning_edges(ids, sets), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            for k, number, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != key:
                    if ids:
                        yield emit()
                    key, ids, sets = k, [], []
                ids.append(number)
                sets.append(shingles(words_of(text)))
        if ids:
            yield emit()

    return members.select("key", "number", "text").repartition("key").sortWithinPartitions("key", "number").mapInArrow(lean(run), ddl)


class Front:
    """Texts that others are held against. A text found near joins their components, so edges make a forest."""

    def __init__(self):
        self.ids, self.sets, self.values, self.above = [], [], None, {}

    def add(self, number: int, found: np.ndarray) -> None:
        self.ids.append(number)
        self.sets.append(found)

    def top(self, number: int) -> int:
        while (up := self.above.get(number, number)) != number:
            self.above[number] = number = self.above.get(up, up)
        return number

    def links(self, number: int, found: np.ndarray) -> list[int]:
        """Texts of the front that this text has similarity 0.8 or more to, one of each component so far."""
        if not self.ids:
            return []
        if self.values is None:
            flat, self.sizes = np.concatenate(self.sets), np.array([len(s) for s in self.sets])
            order = np.argsort(flat, kind="stable")
            self.values, self.owner = flat[order], np.repeat(np.arange(len(self.sets), dtype=np.int32), self.sizes)[order]
            self.sets = []
        lo, hi = np.searchsorted(self.values, found), np.searchsorted(self.values, found, "right")
        shared = np.bincount(gathered(self.owner, lo, hi - lo), minlength=len(self.ids))
        out = []
        for k in np.flatnonzero(9 * shared >= 4 * (self.sizes + len(found))).tolist():
            if self.ids[k] != number and (a := self.top(self.ids[k])) != (b := self.top(number)):
                self.above[b] = a
                out.append(self.ids[k])
        return out


def across(front: DataFrame, others: DataFrame) -> DataFrame:
    """(key, a, b): edges between fronts and others, both (key, part, block, number, text), wherever part and block are the same."""
    ddl = "key long, a long, b long"
    schema = arrow_schema(ddl)

    def run(batches):
        at, held = None, Front()
        for batch in batches:
            edges = []
            for key, part, block, late, number, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part, block) != at:
                    at, held = (key, part, block), Front()
                if late:
                    edges += [(key, a, number) for a in held.links(number, shingles(words_of(text)))]
                else:
                    held.add(number, shingles(words_of(text)))
            found = np.array(edges, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], schema=schema)

    columns = lambda rows, late: rows.select("key", "part", "block", F.lit(late).alias("late"), "number", "text")
    dealt = columns(front, False).unionByName(columns(others, True)).repartition("key", "part", "block")
    return dealt.sortWithinPartitions("key", "part", "block", "late", "number").mapInArrow(lean(run), ddl)


def blocks_of(split_rows: int, split_shingles: int) -> Column:
    """Number of blocks of a group, as an aggregate over its members."""
    return F.ceil(F.greatest(F.count("*") / split_rows, F.sum("size") / split_shingles)).cast("int")


def each_of(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def links_across(members: DataFrame, texts: DataFrame, folder: str, split_rows: int, split_shingles: int) -> DataFrame:
    """Edges (a, b) of groups of several blocks; members: key, number, size, blocks."""
    members = members.withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    heads = members.groupBy("key").agg(F.min("number").alias("number"), F.max("blocks").alias("blocks"))
    left, edges = stored(members.join(heads.select("key", "number"), ["key", "number"], "left_anti"), folder, "left0"), []
    for step in (1, 2):
        front = heads.join(texts, "number").select("key", F.lit(0).alias("part"), each_of("blocks").alias("block"), "number", "text")
        others = left.join(texts, "number").select("key", F.lit(0).alias("part"), "block", "number", "text")
        near = stored(across(front, others), folder, f"near{step}")
        edges.append(near.select("a", "b"))
        settled = near.select("key", F.col("b").alias("number")).distinct()
        order = Window.partitionBy("key").orderBy(F.xxhash64("number"), "number")
        heads = members.join(settled, ["key", "number"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEADS).select("key", "number", "blocks")
        left = stored(left.join(settled, ["key", "number"], "left_anti"), folder, f"left{step}")
    parts = stored(left.groupBy("key").agg(blocks_of(split_rows, split_shingles).alias("parts")), folder, "parts")
    part = F.pmod(F.xxhash64("number", F.lit("part")), F.col("parts")).cast("int")
    front = left.join(parts, "key").join(texts, "number").select("key", part.alias("part"), each_of("blocks").alias("block"), "number", "text")
    others = members.join(parts, "key").join(texts, "number").select("key", each_of("parts").alias("part"), "block", "number", "text")
    return edges[0].unionByName(edges[1]).unionByName(across(front, others).select("a", "b"))


def fingerprint_groups(texts: DataFrame, folder: str, blocks: Column) -> DataFrame:
    """(key, number, size, blocks) of the texts (number, size, fp) whose fingerprints hang together over links of RADIUS bits."""
    fps = stored(texts.select("fp").distinct(), folder, "fps")
    roots = components(simhash.links(fps, folder, RADIUS, SPLIT_PRINTS, simhash.halved_masks(RADIUS)), folder)
    named = texts.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("key"), "number", "size")
    groups = named.groupBy("key").agg(F.count("*").alias("n"), blocks.alias("blocks")).filter("n > 1")
    return named.join(groups.select("key", "blocks"), "key")


def band_groups(texts: DataFrame, settled: DataFrame, blocks: Column) -> DataFrame:
    """(key, number, size, blocks) of the texts (number, size, keys) that share a key, unless all of a key are settled (node, root) in one component."""
    owned = texts.join(settled, F.col("number") == F.col("node"), "left")
    spread = owned.select("number", "size", F.coalesce("root", "number").alias("own"), F.explode("keys").alias("key"))
    same = ["n", "x", "y"]  # of groups with the same members
    found = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("number")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "number")).alias("y"), blocks.alias("blocks")]
    groups = spread.groupBy("key").agg(*found, F.min("own").alias("low"), F.max("own").alias("high")).filter("low < high")
    groups = groups.groupBy(*same).agg(F.min("key").alias("key"), F.max("blocks").alias("blocks")).select("key", "blocks")
    return spread.select("key", "number", "size").join(groups, "key")


def compared(members: DataFrame, texts: DataFrame, folder: str, split_rows: int, split_shingles: int) -> DataFrame:
    """Distinct edges (a, b) by the exact similarity within groups; members: key, number, size, blocks."""
    members = stored(members, folder, "members")
    texts = stored(chosen(texts, "number", members.select("number").distinct(), folder, "grouped"), folder, "grouped")  # the others need no comparison
    near, large = links(members.filter("blocks = 1").join(texts, "number")), members.filter("blocks > 1")
    if not large.isEmpty():
        near = near.unionByName(links_across(large, texts, folder, split_rows, split_shingles))
    return stored(near.distinct(), folder, "edges")


def one_of_each(docs: DataFrame, split_rows: int = SPLIT_ROWS, split_shingles: int = SPLIT_SHINGLES) -> DataFrame:
    """The rows of docs, with their own columns, less all but one of each component: the smallest doc_id stays, null last."""
    folder, number = shared_dir(docs.sparkSession, "near"), free_name(docs, "_row_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), folder, "rows")
    texts = rows.select(F.col(number).alias("number"), F.col("text").cast("string").alias("text"))
    found, limits = stored(prints(texts), folder, "prints"), (split_rows, split_shingles)
    classes = stored(found.groupBy("t1", "t2").agg(F.min("number").alias("class")), folder, "classes")
    distinct = found.join(classes.select(F.col("class").alias("number")), "number", "left_semi").filter("size > 0")
    distinct = stored(distinct.select("number", "size", "fp", "keys"), folder, "distinct")
    near = compared(fingerprint_groups(distinct, f"{folder}/simhash", blocks_of(*limits)), texts, f"{folder}/linked", *limits)
    rest = band_groups(distinct, components(near, f"{folder}/settled"), blocks_of(*limits))
    near = near.unionByName(compared(rest, texts, f"{folder}/rest", *limits))
    roots = components(near, folder)
    named = found.select("number", "t1", "t2").join(classes, ["t1", "t2"]).join(roots, F.col("class") == F.col("node"), "left")
    named = named.select(F.col("number").alias(number), F.coalesce("root", "class").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("row"))
    kept = named.join(rows.select(number, "doc_id"), number).groupBy("component").agg(F.min(order).alias("first"))
    kept = stored(kept.select(F.col("first.row").alias(number)), folder, "kept")
    return chosen(rows, number, kept, folder, "kept").select(*[F.col(f"`{c}`") for c in docs.columns])
