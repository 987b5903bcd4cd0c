"""Operator 3, SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint has one bit for each bit that over half of a text's shingle hashes set. Two
fingerprints link at RADIUS or fewer differing bits. Every bit position gets a fixed non-zero vector of
RADIUS + 1 bits; for each non-zero vector v there is a mask of the positions whose own vector has an odd
product with v. Whatever RADIUS positions differ, some v is orthogonal to all of their vectors, so the pair
agrees under that mask: 2^(RADIUS+1) - 1 tables miss no pair.

Equal fingerprints collapse to one row before any table is built, so exact copies cost nothing. A table's
group with more than SPLIT_AT fingerprints is dealt again by a quarter of its free bits, four ways (three
differing bits leave one quarter alone), until it is small; fingerprints in a group are distinct, so f free
bits bound a group at 2^f rows. Groups yield the edges of a spanning forest of their links, never all pairs;
components come from edges that move to ever smaller nodes, each round stored in the shared folder.

Defined cases: a text without words (null, empty, white space) has fingerprint zero, linked like any other;
null ids are kept as rows and count as the largest id, so a component gets the smallest known one; repeated
rows stay and share their class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, lean, read_table, shared_dir, small_batches, stored, texts_of

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
SPLIT_AT = 2048
#: Fingerprints of a group that is searched for links together with others; rows that a task gathers before it looks.
WIDE, HELD = 256, 1 << 16
MAX_ROUNDS = 60


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    hash_of = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return majority(np.array([hash_of(joined[a:b], SEED) for a, b in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set, as an unsigned number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    ddl = "doc_id long, fp long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in small_batches(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ddl)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; position i carries the vector i mod (2^(radius+1) - 1) + 1."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin(v & (i % size + 1)).count("1") % 2) for v in range(1, size + 1)]


def halved_masks(radius: int) -> list[int]:
    """Covering masks of either half of the bits: whatever `radius` positions differ, one half has radius // 2 of them or fewer."""
    half = covering_masks(radius // 2, BITS // 2)
    return [m << shift for shift in (0, BITS // 2) for m in half]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def quarters(mask: int, radius: int = RADIUS) -> list[int]:
    """The free bits of a mask in radius + 1 parts, each joined to the mask."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): each fingerprint under each mask."""
    return fps.select(F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def spanning_edges(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (root, member) of the components under links at `radius` bits or fewer, over distinct fingerprints."""
    left = np.sort(fps.view(np.uint64))
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                found = left[near]
                front.extend(found)
                edges += [(root, x) for x in found]
                left = left[~near]
    return edges


def linked_groups(fps: np.ndarray, group: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> list[int]:
    """The groups with any link; group: ascending number of each fingerprint's group. Large ones count as linked unseen."""
    sizes = np.diff(starts)
    found = sizes > WIDE
    at, step = np.flatnonzero((sizes[group] > 1) & ~found[group]), 0
    while len(at):  # neighbours first, then those two apart, ...; groups that are found need no further look
        step += 1
        at = at[at + step < len(fps)]
        at = at[group[at + step] == group[at]]
        found[group[at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]]] = True
        at = at[~found[group[at]]]
    return np.flatnonzero(found).tolist()


def edges_within(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning edges of each group of equal mask and masked fingerprint; members: mask, fp, at most `split_at` rows a group.

    Each row is shuffled once, alone in its group or not. Most groups of many fingerprints meet by chance alone, so a
    look at whole batches picks the groups with links.
    """
    ddl = "a long, b long"
    schema = arrow_schema(ddl)

    def run(batches):
        held: list[list[np.ndarray]] = []

        def solve(last):
            mask, fp = (np.concatenate(x).view(np.uint64) for x in zip(*held))
            key = mask & fp
            starts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1, [len(fp)]])
            stop = len(starts) - 1 if last else len(starts) - 2  # the last group may go on
            held[:] = [[mask[starts[stop] :].view(np.int64), fp[starts[stop] :].view(np.int64)]]
            starts, fp = starts[: stop + 1], fp[: starts[stop]]
            group = np.repeat(np.arange(stop), np.diff(starts))
            found = [e for g in linked_groups(fp, group, starts, radius) for e in spanning_edges(fp[starts[g] : starts[g + 1]], radius)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                if sum(len(x[0]) for x in held[1:]) >= HELD:
                    yield solve(last=False)
        if held:
            yield solve(last=True)

    key = F.col("fp").bitwiseAND(F.col("mask"))
    return members.select("mask", "fp").repartition("mask", key).sortWithinPartitions("mask", key).mapInArrow(lean(run), ddl)


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hot_groups(spread: DataFrame, rows: int, split_at: int, folder: str) -> DataFrame | None:
    """(mask, key) of the groups of over split_at rows, or None; rows: how many spread has.

    Rows are counted by a hash of their group first, which sends no row anywhere; only what falls into a full bucket is
    counted by its group. A group that is too large fills its bucket, so none is missed.
    """
    if rows <= split_at:
        return None
    bucket = F.pmod(F.xxhash64("mask", "key"), F.lit(1 << max(12, (8 * rows // split_at).bit_length())))
    full = stored(spread.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > split_at).select("bucket"), folder, "full")
    if full.isEmpty():
        return None
    counted = spread.withColumn("bucket", bucket).join(full, "bucket").groupBy("mask", "key").agg(F.count("*").alias("n"))
    hot = stored(counted.filter(F.col("n") > split_at).select("mask", "key"), folder, "hot")
    return None if hot.isEmpty() else hot


def links(fps: DataFrame, folder: str, radius: int = RADIUS, split_at: int = SPLIT_AT, masks: list[int] | None = None) -> DataFrame:
    """Distinct edges (a, b) that connect just what is linked; fps: distinct fingerprints. The masks must cover the radius."""
    masks = masks or covering_masks(radius)
    parts, level = [], 0
    spread, n = dealt(fps, masks), fps.count()
    rows = 0 if n <= split_at else n * len(masks)  # no group has more rows than there are fingerprints
    while True:
        hot = hot_groups(spread, rows, split_at, f"{folder}/level{level}")
        parts.append(edges_within(spread if hot is None else spread.join(hot, ["mask", "key"], "left_anti"), radius))
        if hot is None:
            break
        at = {r["mask"]: quarters(r["mask"] & (2**64 - 1), radius) for r in hot.select("mask").distinct().collect()}  # as many as there are masks
        finer = F.create_map(*[x for m, q in at.items() for x in (F.lit(m), F.array(*[F.lit(signed(v)) for v in q]))])
        inside = spread.join(hot, ["mask", "key"]).select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        level += 1
        spread = stored(inside.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct(), folder, f"dealt{level}")
        rows = spread.count()
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return stored(edges.distinct(), folder, "edges")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b), a and b different; root: the smallest node of its component.

    Rounds of two moves: a node's larger neighbours go over to its smallest neighbour (or to itself, if that is
    smaller), then its smaller ones and the node itself do. Each move leaves what hangs together together, and edges that say the same
    become one, so the rows of a round fall towards one a node. It ends when every component is a star around its smallest node.
    """
    edges = stored(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(), folder, "edges0")
    for step in range(1, MAX_ROUNDS):
        ends = edges.select(F.col("low").alias("node"), F.col("low").alias("root"), F.lit(0).alias("down"), F.lit(1).alias("up"))
        ends = ends.unionAll(edges.select("high", "low", F.lit(1), F.lit(0)))
        nodes = stored(ends.groupBy("node").agg(F.min("root").alias("root"), F.sum("down").alias("down"), F.sum("up").alias("up")), folder, f"nodes{step}")
        if nodes.filter("down > 1 or (down > 0 and up > 0)").isEmpty():
            return nodes.select("node", "root")
        over = edges.join(nodes.select(F.col("node").alias("low"), "root"), "low")
        edges = stored(over.select(F.col("root").alias("low"), "high").distinct(), folder, f"larger{step}")
        least = edges.groupBy("high").agg(F.min("low").alias("root"))
        over = edges.filter("low < high").join(least, "high").select(F.col("root").alias("low"), F.explode(F.array("low", "high")).alias("high"))
        edges = stored(over.filter("low < high").distinct(), folder, f"smaller{step}")
    raise RuntimeError("labels did not settle")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, split_at: int = SPLIT_AT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    folder = shared_dir(docs.sparkSession, "simhash")
    all_fps = stored(fingerprints(docs, shingle), folder, "fps")
    classes = stored(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "classes")
    roots = components(links(classes.select("fp"), folder, radius, split_at), folder)
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "root")
    linked, alone = named.filter("root is not null"), named.filter("root is null").select("fp", F.col("least").alias("component_id"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(linked.select("fp", "root").join(least, "root").select("fp", "component_id").unionByName(alone), folder, "named")
    return all_fps.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, less all but one of each component: the smallest doc_id stays, null last.

    Rows get a number of their own first, so repeated rows and null ids count as what they are.
    """
    folder, number = shared_dir(docs.sparkSession, "dedup"), free_name(docs, "_row_number")
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), folder, "rows")
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias(number), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("row"))
    kept = found.join(rows.select(number, "doc_id"), number).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = stored(kept.select(F.col("first.row").alias(number)), folder, "kept")
    return rows.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
