"""Operator 12, Merkle manifest of a data set: fractal traversal of aligned blocks, upper proofs from blocks above.

A row's leaf is the hash of its fields; the leaves of a language, by doc_id, are the leaves of a tree in which every `arity`
consecutive nodes become one, until one is left; the roots of the languages are the leaves of one more tree. All trees are
built and walked by the same code, which knows a tree only by its key, a node by its place.

Places come from a range shuffle and counts of its parts, so no task ranks a language. Nodes are made bottom-up, the levels of
a subtree at a time, by grouping. Proofs are made top-down, from the top tree to the leaves, two subtrees at a time: an aligned
block of nodes is one group, and its rows come as its own proof from above, the nodes in its middle, its nodes. The walk keeps one
existing subtree above the middle and one below it, and a desired subtree that takes in one node for each proof given out; when
the existing one is used up, the desired one takes its place. So a task holds three subtrees, however long the block is.

Defined cases: null fields count as `-`; rows without doc_id come first; rows of one doc_id are ordered by their leaves, rows
alike in all fields in any order (their positions, and so their proofs, differ, their leaves do not); a null id counts as the
empty text when rows are chosen for the tampering; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, read_table, shared_dir, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings on the left and on the right of a node, joined, a pair for each level from the node to the root.
PATH = "array<struct<left:string,right:string>>"
#: What a walk reads: of a block its proof from above (kind 0), the nodes in its middle (1), its nodes (2).
WALKED = f"tree string, block long, kind int, at long, height int, digest string, subroot string, above {PATH}, doc_id long, tampered string"
PATHS = f"tree string, at long, height int, subroot string, path {PATH}"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class Shape:
    """Nodes that become one, and levels of a subtree; a block has two subtrees' levels."""

    arity: int = 8
    stacked: int = 2

    @property
    def subtree(self) -> int:
        """Nodes below each node in the middle of a block."""
        return self.arity**self.stacked

    @property
    def block(self) -> int:
        return self.subtree**2


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def counted(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 length, `:`, itself; `-` if null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*[counted(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language's key), doc_id, digest, and the leaf of rows that the tampering touches."""
    text = F.col("text").cast("string")
    touched = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tree = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))  # a null one comes first
    tampered = F.when(touched, leaf_of(F.translate(text, upper, upper.lower())))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(text).alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, order: list[str], shape: Shape, folder: str, name: str) -> DataFrame:
    """rows with `at`, their place in their tree, and `height`, the levels of that tree above them.

    A range shuffle sorts all rows; a row's place is its number in its part, less the first of its tree there, plus what
    earlier parts hold of the tree.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = ["tree", *order]
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("number", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumns({"part": F.shiftright("number", 33), "number": F.col("number").bitwiseAND(F.lit((1 << 33) - 1))}), folder, f"{name}-ranged")
    parts = ranged.groupBy("tree", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))  # as many rows as parts and trees
    whole = W.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("first")
    parts = parts.select("tree", "part", before.alias("shift"), F.sum("n").over(whole).alias("whole"))
    height = sum((F.when(F.col("whole") > shape.arity**k, 1).otherwise(0) for k in range(63) if shape.arity**k < 1 << 62), F.lit(0))
    out = ranged.join(parts, ["tree", "part"]).withColumns({"at": F.col("number") + F.col("shift"), "height": height.cast("int")})
    return stored(out.drop("number", "part", "shift", "whole", "row"), folder, f"{name}-placed")


def risen(nodes: DataFrame, level: int, shape: Shape) -> DataFrame:
    """The nodes a subtree above those of a level, or as far as their tree goes; nodes: tree, at, height, digest."""
    rows = nodes.filter(F.col("height") > level).groupBy("tree", F.expr(f"at div {shape.subtree}").alias("up")).agg(F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("own"))

    def runs(digests):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / shape.arity).cast("int")), lambda i: F.sha2(F.array_join(F.slice(digests, i * shape.arity + 1, F.lit(shape.arity)), "").cast("binary"), 256))

    rows = rows.withColumn("own", runs(F.col("own.digest")))
    for k in range(1, shape.stacked):
        rows = rows.withColumn("own", F.when(F.col("height") > level + k, runs(F.col("own"))).otherwise(F.col("own")))
    return rows.select("tree", F.col("up").alias("at"), "height", F.col("own")[0].alias("digest"))


@dataclass
class Subtree:
    """An aligned subtree, of whose levels there are `height` above the lowest; a node comes into being when its run is whole."""

    height: int
    arity: int
    rows: list[list[str]] = field(default_factory=list)
    held: list = field(default_factory=list)  # what belongs to its lowest nodes

    def __post_init__(self):
        self.rows = [[] for _ in range(self.height + 1)]

    def add(self, digest: str, what=None) -> None:
        self.held.append(what)
        self.rows[0].append(digest)
        for k in range(self.height):
            if len(self.rows[k]) % self.arity:
                break
            self.rows[k + 1].append(sha(*self.rows[k][-self.arity:]))

    def close(self) -> Subtree:
        """Makes the nodes of runs that end early."""
        for k in range(self.height):
            done = len(self.rows[k + 1]) * self.arity
            if done < len(self.rows[k]):
                self.rows[k + 1].append(sha(*self.rows[k][done:]))
        return self

    def path(self, i: int) -> list[tuple[str, str]]:
        out = []
        for row in self.rows[:-1]:
            lo = i // self.arity * self.arity
            out.append(("".join(row[lo:i]), "".join(row[i + 1 : lo + self.arity])))
            i //= self.arity
        return out


def walked(nodes: Iterator[tuple], middle: list[str], levels: int, shape: Shape) -> Iterator[tuple]:
    """(node, its path within the block) for a block's nodes in order; levels: of the tree, from the nodes to the block's root.

    A node is (digest, what belongs to it). The existing subtree gives out proofs; for each the desired one takes a node in.
    """
    low = min(shape.stacked, levels)
    top = Subtree(max(0, levels - shape.stacked), shape.arity)
    for digest in middle:
        top.add(digest)
    top.close()
    existing, number, more = Subtree(low, shape.arity), 0, True
    for node in nodes:
        existing.add(*node)
        if len(existing.held) == shape.subtree:
            break
    while existing.held:
        existing.close()
        above, desired = top.path(number) if top.height else [], Subtree(low, shape.arity)
        for i, (digest, what) in enumerate(zip(existing.rows[0], existing.held)):
            yield digest, what, existing.path(i) + above
            if more:
                node = next(nodes, None)
                if node is None:
                    more = False
                else:
                    desired.add(*node)
        existing, number = desired, number + 1


def rows_of(batches, columns: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(columns)])


def blocks_walked(batches, level: int, shape: Shape) -> Iterator[tuple]:
    """(tree, at, height, subroot, digest, doc_id, tampered, path from the node to the root) of all nodes of a task's blocks."""
    rows = rows_of(batches, 10)
    row = next(rows, None)
    while row is not None:
        tree, block, height, subroot, above, middle = row[0], row[1], row[4], row[6], [(x["left"], x["right"]) for x in row[7]], []
        row = next(rows, None)
        while row is not None and row[:3] == (tree, block, 1):
            middle.append(row[5])
            row = next(rows, None)

        def own():
            nonlocal row
            while row is not None and row[:2] == (tree, block):
                node = row
                row = next(rows, None)
                yield node[5], (node[3], node[8], node[9])

        for digest, (at, doc_id, tampered), path in walked(own(), middle, min(2 * shape.stacked, height - level), shape):
            yield tree, at, height, subroot, digest, doc_id, tampered, path + above


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = sha(left, digest, right)
    return digest


def walk_rows(nodes: DataFrame, middle: DataFrame | None, above: DataFrame, shape: Shape) -> DataFrame:
    """WALKED, a block's rows together and in order; above: tree, at (the block), height, subroot, path."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = above.select("tree", F.col("at").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "height", none("string").alias("digest"), "subroot", F.col("path").alias("above"), none("long").alias("doc_id"), none("string").alias("tampered"))
    for kind, frame, size in ((1, middle, shape.subtree), (2, nodes, shape.block)):
        if frame is not None:
            more = [F.col(c) if c in frame.columns else none(k).alias(c) for c, k in (("doc_id", "long"), ("tampered", "string"))]
            rows = rows.unionByName(frame.select("tree", F.expr(f"at div {size}").alias("block"), F.lit(kind).alias("kind"), "at", "height", "digest", none("string").alias("subroot"), none(PATH).alias("above"), *more))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [part.split()[0] for part in WALKED.split(", ")]
    return rows.select(*names).repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "kind", "at")


def paths_of(rows: DataFrame, level: int, shape: Shape, lowest: bool = False) -> DataFrame:
    """PATHS of the nodes of walked blocks; lowest: the nodes are subroots themselves."""

    schema = arrow_schema(PATHS)

    def run(batches):
        walk = blocks_walked(batches, level, shape)
        return batched(((tree, at, height, digest if lowest else subroot, [{"left": a, "right": b} for a, b in path]) for tree, at, height, subroot, digest, _, _, path in walk), schema)

    return rows.mapInArrow(run, PATHS)


@dataclass
class Forest:
    """Nodes of all trees, at levels a subtree apart, and how many levels the highest tree has."""

    levels: list[DataFrame]  # tree, at, height, digest; the lowest with doc_id and tampered
    height: int
    shape: Shape

    @classmethod
    def grown(cls, lowest: DataFrame, shape: Shape, folder: str, name: str) -> Forest:
        height = lowest.agg(F.max("height")).first()[0] or 0
        levels, level = [lowest], 0
        while level < height:
            levels.append(stored(risen(levels[-1].select("tree", "at", "height", "digest"), level, shape), folder, f"{name}-{level + shape.stacked}"))
            level += shape.stacked
        return cls(levels, height, shape)

    def roots(self) -> DataFrame:
        """tree, height, digest of the one node that is left of each tree."""
        out = None
        for k, nodes in enumerate(self.levels):
            ends = (F.col("height") <= k * self.shape.stacked) & ((F.col("height") > (k - 1) * self.shape.stacked) if k else F.lit(True))
            rows = nodes.filter(ends).select("tree", "height", "digest")
            out = rows if out is None else out.unionByName(rows)
        return out

    def walk(self, tops: DataFrame, folder: str, name: str) -> DataFrame:
        """WALKED of the lowest nodes, with the proofs of their blocks; tops: tree, height, subroot, path of every tree's root."""
        span, above = 2 * self.shape.stacked, None
        tiers = max(1, -(-self.height // span))
        for tier in range(tiers - 1, -1, -1):
            level = tier * span
            fits = (F.col("height") <= level + span) & ((F.col("height") > level) if tier else F.lit(True))
            own = tops.filter(fits).select("tree", F.lit(0).cast("long").alias("at"), "height", "subroot", "path")
            above = own if above is None else own.unionByName(above)
            nodes = self.levels[2 * tier].filter(F.col("height") > level) if tier else self.levels[0]
            middle = self.levels[2 * tier + 1].filter(F.col("height") > level + self.shape.stacked) if 2 * tier + 1 < len(self.levels) else None
            rows = walk_rows(nodes, middle, above, self.shape)
            if tier == 0:
                return rows
            above = stored(paths_of(rows, level, self.shape), folder, f"{name}-paths{tier}")
        raise AssertionError("there is a lowest tier")


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """RESULT for every row of docs."""
    spark, schema = docs.sparkSession, arrow_schema(RESULT)
    folder = shared_dir(spark, "merkle")
    lowest = placed(stored(leaves(docs), folder, "leaves"), ["doc_id", "digest", "row"], shape, folder, "leaves")
    trees = Forest.grown(lowest, shape, folder, "trees")
    subroots = stored(trees.roots().select("tree", "height", "digest"), folder, "subroots")
    upper = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest", F.lit(0).cast("long").alias("row")), ["own"], shape, folder, "upper")
    top = Forest.grown(upper, shape, folder, "top")
    last = top.roots().first()
    if last is None:
        return spark.createDataFrame([], RESULT)
    root = last["digest"]
    tops = spark.createDataFrame([("", last["height"], None, [])], f"tree string, height int, subroot string, path {PATH}")

    above = paths_of(top.walk(tops, folder, "top"), 0, shape, True).select("at", "subroot", "path")
    ways = upper.select("at", F.col("own").alias("tree")).join(above, "at").join(subroots.select("tree", "height"), "tree")
    ways = stored(ways.select("tree", "height", "subroot", "path"), folder, "ways")

    def proofs(batches):
        def told():
            for _, _, _, subroot, digest, doc_id, tampered, path in blocks_walked(batches, 0, shape):
                folded = fold(tampered or digest, path)
                yield doc_id, digest, subroot, root, sha(*(x for pair in path for x in pair)), folded, folded == root

        return batched(told(), schema)

    return trees.walk(ways, folder, "trees").mapInArrow(proofs, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


def _oracle_sql(levels: int = 8, top_levels: int = 5) -> str:
    """DuckDB SQL of the manifest for trees of so many levels at most: 8 to the power of it leaves."""
    told = lambda c: f"(case when {c} is null then '-' else strlen({c}) || ':' || {c} end)"
    text = lambda t: "sha256(" + " || ".join(told(c) for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", t)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "(case when i % 8 = 0 then xor(c, ascii(substr(digits, cast(i // 8 + 1 as int), 1))) else c end)"
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), range(8 * length(digits))), lambda c, i: xor({bit} >> 1, case when {bit} % 2 = 1 then 3988292384 else 0 end)), 4294967295)"
    out = [
        f"a as (select doc_id, case when lang is null then '0' else '1' || lang end as tree, coalesce(cast(doc_id as varchar), '') as digits, {text('text')} as leaf, {text(lower)} as low from documents)",
        f"b as (select doc_id, tree, leaf, case when {crc} % 3 = 0 then low else leaf end as v from a)",
        "d0 as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, '' as proof from b)",
        "l0 as (select tree, place, leaf as h, count(*) over (partition by tree) as m from d0)",
    ]

    def climb(k: int, nodes: str, docs: str) -> None:
        out.append(f"{nodes}r{k} as (select tree, place // 8 as run, list(h order by place) as hs, any_value(m) as m from {nodes}{k} group by 1, 2)")
        out.append(f"{nodes}{k + 1} as (select tree, run as place, case when m = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h, (m + 7) // 8 as m from {nodes}r{k})")
        left, right = "array_to_string(hs[1:cast(place % 8 as int)], '')", "array_to_string(hs[cast(place % 8 as int) + 2:], '')"
        out.append(f"{docs}{k + 1} as (select d.* exclude (v, place, proof), case when m = 1 then v else sha256({left} || v || {right}) end as v, place // 8 as place, case when m = 1 then proof else proof || {left} || {right} end as proof from {docs}{k} d join {nodes}r{k} r on (d.tree = r.tree and d.place // 8 = r.run))")

    for k in range(levels):
        climb(k, "l", "d")
    out.append(f"s as (select tree, h as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as m from l{levels})")
    out.append("t0 as (select '' as tree, place, subroot as h, m from s)")
    out.append(f"e0 as (select d.doc_id, d.leaf, s.subroot, d.v, s.place, d.proof, '' as tree from d{levels} d join s on d.tree = s.tree)")
    for k in range(top_levels):
        climb(k, "t", "e")
    return "with " + ",\n  ".join(out) + f"\n  select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, v as folded_root, v = h as verified from e{top_levels}, (select h from t{top_levels})"


ORACLE_SQL = _oracle_sql()
