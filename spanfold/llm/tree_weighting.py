"""Operator 8, language-model scoring by context-tree weighting over bytes.

The text scored is the sequence of its tokens: each word (A-Z in lower case) and a space, then an end symbol. A byte is
eight binary decisions; the context of a decision is the bits already known of its byte and the DEPTH bytes before it in the
text, spaces and earlier words included; only before the text's start there is padding. Every node (context, bits known) holds
counts of zeros and ones; its Krichevsky-Trofimov block probability Pe and the product of its children's weighted probabilities
mix as Pw = (Pe + product) / 2. A score walks from the root to the deepest context seen in training: at each node the estimate
(n1 + 1/2) / (n + 1) weighs Pe / (Pe + product), what is deeper weighs the rest; a context not seen takes over its parent's
value, so every distribution sums to one.

A gram is DEPTH bytes and the symbol after them, as one integer. A chunk of documents (CHUNK_BYTES of text, or one longer
document) sends its distinct grams and words with their counts in training, packed, to buckets: grams by the SPLIT bytes
nearest to the symbol, so that a bucket holds all of the tree below such contexts. Buckets add counts up and work the tree out
from the leaves to SPLIT bytes; the few shorter contexts are tables, aggregated and joined; then buckets go down to the leaves
and answer each chunk its own grams and words, in the order asked. The chunk's texts meanwhile wait, as numbers of words, in a
file of the shared folder. What is asked is stored with the names of those files before it is answered, so a task that runs
again cannot mix two versions. The number of buckets grows with the input; nothing is broadcast.

Defined cases: a null or empty text is the end symbol alone; null ids (they count as the empty text when rows are held out)
and repeated rows are kept; without training rows every bit has probability 1/2 and every base term is log10(1); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbers, arrow_schema, from_planes, grouped, held_out, lean, packed, planes, read_file, read_table, shared_dir, small_batches, smallest, stored, texts_of, unpacked, write_file

DEPTH, SPLIT, START, END = 6, 3, 0xFF, 0xFF
#: Text of a chunk; positions whose grams a task holds at once; text for each bucket of grams; grams whose nodes a task holds at once.
CHUNK_BYTES, PIECE_BYTES, BUCKET_BYTES, BRANCH_GRAMS = 12 << 20, 1 << 20, 8 << 20, 100_000
#: What a chunk asks of a bucket, packed; bucket -1 names the file of the chunk's documents.
ASKED = "chunk long, bucket int, blob binary"
UPPER = "context long, node int, n0 long, n1 long, below double"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
HASH, FINE = 0x9E3779B1, 1 << 25
#: How hard what is asked is compressed: it is stored once and shuffled twice.
LEVEL = 7
#: Bits that tell the texts of a piece apart; beside the 56 of a gram.
TEXT_BITS = 7


def streams(words: list[bytes], sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, end of each): of a text DEPTH times START, its words, each with a space, and END."""
    pad, end, spaced, out, at = bytes([START] * DEPTH), bytes([END]), [w + b" " for w in words], [], 0
    for n in sizes.tolist():
        out.append(b"".join([pad, *map(spaced.__getitem__, flat[at : at + n].tolist()), end]))
        at += n
    lengths = np.fromiter(map(len, out), np.int64, len(out))
    return np.frombuffer(b"".join(out), np.uint8), lengths.cumsum()


def gram_pieces(raw: np.ndarray, ends: np.ndarray, most_texts: int = 1 << 30):
    """(gram at each symbol, its text, counted from the piece's first, that text) of pieces of the streams, of some texts at most."""
    starts = np.append(0, ends[:-1])
    first = 0
    while first < len(ends):
        last = max(first + 1, min(first + most_texts, int(np.searchsorted(ends, starts[first] + PIECE_BYTES, "right"))))
        for lo in range(int(starts[first]) + DEPTH, int(ends[last - 1]), PIECE_BYTES):  # of one text, if it is longer
            hi = min(int(ends[last - 1]), lo + PIECE_BYTES)
            owner = np.repeat(np.arange(last - first), np.clip(ends[first:last], lo, hi) - np.clip(starts[first:last], lo, hi))
            code = np.zeros(hi - lo, np.int64)
            for j in range(DEPTH + 1):
                code = (code << 8) | raw[lo - DEPTH + j : hi - DEPTH + j]
            real = np.arange(lo, hi) - starts[first + owner] >= DEPTH
            yield code[real], owner[real], first
        first = last


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def counted_grams(raw: np.ndarray, ends: np.ndarray, teaches: np.ndarray):
    """(distinct grams in order, how often texts that teach have each) of pieces of the streams; a sort brings equal ones together."""
    for code, owner, first in gram_pieces(raw, ends):
        marked = np.sort(code << 1 | teaches[first + owner])
        grams = marked >> 1
        at = runs(grams)
        yield grams[at], np.add.reduceat(marked & 1, at).astype(np.int32) if len(at) else np.zeros(0, np.int32)


def text_sums(raw: np.ndarray, ends: np.ndarray, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum over each text of the values of its grams; grams: all of them, in order. A symbol's text is the low bits of what is sorted."""
    total = np.zeros(len(ends))
    for code, owner, first in gram_pieces(raw, ends, 1 << TEXT_BITS):
        marked = np.sort(code << TEXT_BITS | owner)
        own = marked >> TEXT_BITS
        at = runs(own)
        found = np.repeat(values[np.searchsorted(grams, own[at])], np.diff(np.append(at, len(own))))
        sums = np.bincount(marked & (1 << TEXT_BITS) - 1, found)
        total[first : first + len(sums)] += sums
    return total


def added(grams: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and the sum of n of each; a stable sort merges what comes in order fast."""
    grams, n = np.concatenate(grams), np.concatenate(n)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = runs(grams)
    return grams[first], np.add.reduceat(n[order], first) if len(first) else n


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams >> 8 & (1 << 8 * SPLIT) - 1) * HASH >> 15) % buckets


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int]]:
    """(order of the buckets, where each begins in it and the last ends)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()


def asked_grams(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Rows of ASKED; docs: doc_id, held_out, text. A blob has grams (as differences), words, and how often training texts have them.

    A waiting file holds the documents, the numbers of their words, the words and the grams in the order asked.
    """
    schema = arrow_schema(ASKED)

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, group in enumerate(grouped(small_batches(batches, "text", PIECE_BYTES), "text", CHUNK_BYTES)):
            number, ids, held, at = Numbers(), [], [], []
            for batch in group:
                ids += batch.column(0).to_pylist()
                held += batch.column(1).to_pylist()
                for text in texts_of(batch):
                    words = (text or "").encode().lower().split()  # A-Z only
                    at.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            words, teaches = list(number), ~np.array(held, bool)
            sizes, flat = np.fromiter(map(len, at), np.int64, len(at)), np.concatenate(at)
            trained = np.bincount(flat[np.repeat(teaches, sizes)], minlength=len(words))
            order, word_edges = by_bucket(np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words)), buckets)
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            words, trained, flat, found = [words[i] for i in order.tolist()], trained[order], place[flat], []
            raw, ends = streams(words, sizes, flat)
            for piece in counted_grams(raw, ends, teaches):
                found.append(piece)
                if sum(len(x) for x, _ in found[1:]) > max(len(found[0][0]), PIECE_BYTES):
                    found = [added(*zip(*found))]
            grams, n = added(*zip(*found))
            del raw, found, at, number
            order, edges = by_bucket(bucket_of(grams, buckets), buckets)
            grams, n, lengths = grams[order], n[order], np.fromiter(map(len, words), np.int64, len(words))
            path = f"{folder}/waiting/{task}-{k}-{uuid.uuid4().hex}"
            write_file(path, [packed((ids, held, sizes, planes(flat), b"".join(words), smallest(lengths), planes(np.diff(grams, prepend=0))))])
            rows = [(-1, packed((path, int(teaches.sum()))))]
            for b in range(buckets):
                (lo, hi), (wlo, whi) = edges[b : b + 2], word_edges[b : b + 2]
                if hi > lo or whi > wlo:
                    rows.append((b, packed((planes(np.diff(grams[lo:hi], prepend=0)), smallest(n[lo:hi]), b"".join(words[wlo:whi]), smallest(lengths[wlo:whi]), smallest(trained[wlo:whi])), LEVEL)))
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k] * len(rows)), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=schema)

    return docs.mapInArrow(lean(run), ASKED)


def cut(raw: bytes, lengths: np.ndarray) -> list[bytes]:
    stops = lengths.astype(np.int64).cumsum().tolist()
    return [raw[lo:hi] for lo, hi in zip([0, *stops], stops)]


class Bucket:
    """What all chunks asked of one bucket: distinct grams in order, distinct words, and their counts."""

    def __init__(self):
        self.grams, self.n, self.words, self.c = [], [], Numbers(), np.zeros(0, np.int64)
        self.waiting = 0

    def add(self, blob: bytes) -> None:
        steps, n, raw, lengths, trained = unpacked(blob)
        self.grams.append(from_planes(steps, np.int64).cumsum())
        self.n.append(n.astype(np.int64))
        at = np.fromiter(map(self.words.__getitem__, cut(raw, lengths)), np.int64, len(lengths))
        self.c = np.append(self.c, np.zeros(len(self.words) - len(self.c), np.int64))
        self.c[at] += trained
        self.waiting += len(n)
        if self.waiting > max(4 * PIECE_BYTES, 2 * len(self.grams[0])):
            self.settle()

    def settle(self) -> None:
        if len(self.grams) > 1:
            self.grams, self.n = ([x] for x in added(self.grams, self.n))
        self.waiting = len(self.grams[0])

    def answer(self, blob: bytes, lp: np.ndarray) -> bytes:
        """For what one chunk asked, in its order: log10 probabilities of grams (in steps of 1 / FINE, as none is below -76), counts of words."""
        steps, _, raw, lengths, _ = unpacked(blob)
        at = np.searchsorted(self.grams[0], from_planes(steps, np.int64).cumsum())
        words = np.fromiter(map(self.words.__getitem__, cut(raw, lengths)), np.int64, len(lengths))
        return packed((planes(np.rint(lp[at] * -FINE).astype(np.uint32)), smallest(self.c[words])))


def ln_gamma(x):
    """ln of the gamma function for x >= 1/2, of a column or an array: Stirling's series, eight steps up."""
    log = F.log if isinstance(x, Column) else np.log
    y = x + 8.0
    steps = log(x)
    for i in range(1, 8):
        steps = steps + log(x + float(i))
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - steps


#: ln_gamma of n + 1/2 and of n + 1 for small counts.
_HALVES, _WHOLES = (ln_gamma(np.arange(1 << 16) + shift) for shift in (0.5, 1.0))


def ln_gammas(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    if (large := n >= len(table)).any():
        out[large] = ln_gamma(n[large] + shift)
    return out


def ln_block(n0, n1):
    """ln of the Krichevsky-Trofimov probability of a block with n0 zeros and n1 ones, of columns or arrays."""
    if isinstance(n0, Column):
        return F.when(n0 + n1 == 0, F.lit(0.0)).otherwise(ln_gamma(n0 + 0.5) + ln_gamma(n1 + 0.5) - ln_gamma(n0 + n1 + 1.0) - math.log(math.pi))
    return ln_gammas(n0, _HALVES, 0.5) + ln_gammas(n1, _HALVES, 0.5) - ln_gammas(n0 + n1, _WHOLES, 1.0) - math.log(math.pi)


class Branch:
    """The tree below some contexts of `split` bytes, from distinct grams in order.

    A level has the grams cut to fewer bytes, in order, with counts, and each one's place on the level above. The nodes of k
    known bits are runs of such grams, as those sort by context and then by symbol.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int = DEPTH, split: int = SPLIT):
        self.levels = [(grams, n, np.zeros(0, np.int64))]
        for d in range(depth - 1, split - 1, -1):
            short, above = np.unique(self.levels[-1][0] & (1 << 8 * (d + 1)) - 1, return_inverse=True)
            self.levels[-1] = (*self.levels[-1][:2], above)
            self.levels.append((short, np.bincount(above, self.levels[-1][1], len(short)).astype(np.int64), np.zeros(0, np.int64)))

    def nodes(self, k: int):
        """(n0, n1, own, below, first gram, run of each gram, parent node) of each level, from the leaves up."""
        out, weighted, links = [], None, None
        for grams, n, above in self.levels:
            key = grams >> (8 - k)
            new = np.append(True, key[1:] != key[:-1])
            first, run = np.flatnonzero(new), new.cumsum() - 1
            n1 = np.add.reduceat(n * (grams >> (7 - k) & 1), first)
            n0 = np.add.reduceat(n, first) - n1
            own = ln_block(n0, n1)
            if out:
                links = run[out[-1][-1]]  # the runs of the children's first grams
                out[-1] = (*out[-1][:-1], links)
                below = np.bincount(links, weighted, len(first))
                weighted = np.logaddexp(own, below) - math.log(2.0)
            else:
                below, weighted = np.zeros(len(first)), own
            out.append((n0, n1, own, below, first, run, above[first] if len(above) else None))
        return out

    def top(self, k: int):
        """Context, node, n0, n1 and below of the nodes at `split` bytes."""
        n0, n1, _, below, first, _, _ = self.nodes(k)[-1]
        grams = self.levels[-1][0][first]
        return grams >> 8, (grams & 255 | 256) >> (8 - k), n0, n1, below

    def scores(self, values) -> np.ndarray:
        """log10 probability of each gram; values(context, node): (sure, rest, p) of nodes at `split` bytes."""
        grams, total = self.levels[0][0], np.zeros(len(self.levels[0][0]))
        for k in range(8):
            levels = self.nodes(k)
            short = self.levels[-1][0][levels[-1][4]]
            sure, rest, p = values(short >> 8, (short & 255 | 256) >> (8 - k))
            for i in range(len(levels) - 1, -1, -1):
                n0, n1, own, below, _, run, _ = levels[i]
                n, estimate = n0 + n1, (n1 + 0.5) / (n0 + n1 + 1.0)
                p = np.where(n > 0, sure + rest * estimate, p)
                if i:
                    stays = np.where(n > 0, 1 / (1 + np.exp(np.minimum(below - own, 700))), 0.0)
                    sure, rest = sure + rest * stays * estimate, rest * (1 - stays)
                    up = levels[i - 1][6]
                    sure, rest, p = sure[up], rest[up], p[up]
            found = p[run]
            total += np.log10(np.where(grams >> (7 - k) & 1 == 1, found, 1 - found))
        return total


def branches(grams: np.ndarray, n: np.ndarray):
    """(places, Branch) of lots of some BRANCH_GRAMS grams; contexts of SPLIT bytes stay whole."""
    part = grams >> 8 & (1 << 8 * SPLIT) - 1
    order = np.argsort(part, kind="stable")
    edges = np.append(0, np.flatnonzero(np.diff(part[order])) + 1)
    start = 0
    for stop in [*edges[1:].tolist(), len(part)]:
        if stop - start >= BRANCH_GRAMS or stop == len(part) > start:
            own = np.sort(order[start:stop])
            yield own, Branch(grams[own], n[own])
            start = stop


def upwards(asked: DataFrame, buckets: int) -> DataFrame:
    """UPPER of the contexts of SPLIT bytes; context -1 has training tokens (less the ends) and distinct training words as n0 and n1."""
    schema = arrow_schema(UPPER)

    def run(batches):
        def emit(bucket):
            bucket.settle()
            totals = [[-1], [0], [int(bucket.c.sum())], [int((bucket.c > 0).sum())], [0.0]]
            parts = [branch.top(k) for _, branch in branches(bucket.grams[0], bucket.n[0]) for k in range(8)]
            columns = [np.concatenate(x) for x in zip(totals, *parts)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, schema)], schema=schema)

        last, bucket = None, None
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != last:
                    if bucket is not None:
                        yield emit(bucket)
                    last, bucket = number, Bucket()
                bucket.add(blob.as_py())
        if bucket is not None:
            yield emit(bucket)

    return asked.filter("bucket >= 0").select("bucket", "blob").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), UPPER)


def short_contexts(upper: DataFrame, folder: str) -> DataFrame:
    """(context, node, sure, rest, p) of contexts of SPLIT bytes, by way of all shorter ones.

    `sure` is what the contexts passed have added, `rest` the weight left, `p` the value if the path ended there.
    """

    def weighted(level: DataFrame) -> DataFrame:
        level = level.withColumn("own", ln_block(F.col("n0"), F.col("n1")))
        high = F.greatest("own", "below")
        return level.withColumn("weighted", high + F.log(F.exp(F.col("own") - high) + F.exp(F.col("below") - high)) - math.log(2.0))

    def shorter(depth: int) -> Column:
        return F.col("context").bitwiseAND(F.lit((1 << 8 * depth) - 1))

    levels = {SPLIT: weighted(upper.filter("context >= 0"))}
    for d in range(SPLIT - 1, -1, -1):
        up = levels[d + 1].groupBy(shorter(d).alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        levels[d] = stored(weighted(up), folder, f"up{d}")
    n, estimate = F.col("n0") + F.col("n1"), (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    stays = F.when(n == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(F.col("below") - F.col("own"))))
    start = {"sure": F.lit(0.0), "rest": F.lit(1.0), "p": F.lit(0.5)}
    value = levels[0].withColumns(start)
    for d in range(1, SPLIT + 1):
        ended = F.when(n > 0, F.col("sure") + F.col("rest") * estimate).otherwise(F.col("p"))
        above = value.select(F.col("context").alias("up"), "node", (F.col("sure") + F.col("rest") * stays * estimate).alias("sure"), (F.col("rest") * (1 - stays)).alias("rest"), ended.alias("p"))
        value = levels[d].withColumn("up", shorter(d - 1)).join(above, ["up", "node"])
    return stored(value.select("context", "node", "sure", "rest", "p"), folder, "down")


def told_grams(asked: DataFrame, top: DataFrame, buckets: int) -> DataFrame:
    """Rows of ASKED with the answers to what each chunk asked of each bucket."""
    schema = arrow_schema(ASKED)
    bucket = (F.shiftright(F.col("context") * F.lit(HASH).cast("long"), 15) % buckets).cast("int")
    known = top.select(bucket.alias("bucket"), F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("blob"), (F.col("context") * 256 + F.col("node")).alias("key"), "sure", "rest", "p")
    none = [F.lit(0).cast("long").alias("key"), *[F.lit(0.0).alias(c) for c in ("sure", "rest", "p")]]
    rows = known.unionByName(asked.filter("bucket >= 0").select("bucket", "chunk", "blob", *none))

    def run(batches):
        def emit(bucket, told, blobs):
            held = Bucket()
            for _, blob in blobs:
                held.add(blob)
            held.settle()
            key, *values = map(np.concatenate, zip(*told)) if told else [np.zeros(0, np.int64)] * 4
            order = np.argsort(key)
            key = key[order]

            def of(context, node):
                at = order[np.searchsorted(key, context * 256 + node)]
                return [v[at] for v in values]

            lp = np.zeros(len(held.grams[0]))
            for own, branch in branches(held.grams[0], held.n[0]):
                lp[own] = branch.scores(of)
            for chunk, blob in blobs:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((chunk, bucket, held.answer(blob, lp)), schema)], schema=schema)

        last, told, blobs = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(chunk) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if numbers[lo] != last:
                    if blobs:
                        yield from emit(last, told, blobs)
                    last, told, blobs = int(numbers[lo]), [], []
                if chunk[lo] < 0:
                    told.append([batch.column(i).to_numpy()[lo:hi].copy() for i in range(3, 7)])
                else:
                    blobs += [(int(chunk[i]), batch.column(2)[i].as_py()) for i in range(lo, hi)]
        if blobs:
            yield from emit(last, told, blobs)

    return rows.select("bucket", "chunk", "blob", "key", "sure", "rest", "p").repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(run), ASKED)


def answered_texts(told: DataFrame, chunks: int, totals: dict) -> DataFrame:
    """RESULT for every document of the waiting files, from the answers."""
    schema, t = arrow_schema(RESULT), totals

    def finish(path, parts):
        ids, held, sizes, rows, joined, lengths, steps = unpacked(read_file(path))
        words, flat, k = cut(joined, lengths), from_planes(rows, np.int32), len(sizes)
        raw, ends = streams(words, sizes, flat)
        fine, c = map(np.concatenate, zip(*((from_planes(rows, np.uint32), n) for rows, n in parts)))
        owner, c = np.repeat(np.arange(k), sizes), c.astype(np.int64)
        total = lambda values: np.bincount(owner, weights=values[flat], minlength=k)
        whole = t["tokens"] + t["distinct"] + 1
        base = total(np.log10((c + 1) / whole)) + math.log10((t["ends"] + 1) / whole)
        known = total((c > 0).astype(float)) + (t["ends"] > 0)
        grams = from_planes(steps, np.int64).cumsum()
        order = np.argsort(grams, kind="stable")
        score = text_sums(raw, ends, grams[order], fine[order] / -FINE)
        coded = np.diff(ends, prepend=0) - DEPTH
        columns = [ids, held, sizes + 1, known.astype(np.int64), np.full(k, t["tokens"]), base, score, -score * math.log2(10) / coded]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    def run(batches):
        path, parts = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                if bucket < 0:
                    if path is not None:
                        yield finish(path, parts)
                    (path, _), parts = unpacked(blob.as_py()), []
                else:
                    parts.append(unpacked(blob.as_py()))
        if path is not None:
            yield finish(path, parts)

    return told.repartition(chunks, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(lean(run), RESULT)


def score(docs: DataFrame) -> DataFrame:
    """RESULT for every row of docs; rows that are not held out teach."""
    folder = shared_dir(docs.sparkSession, "weighting")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7).alias("held_out"), text.alias("text"))
    told = docs.select(F.sum(F.octet_length(text)).alias("size"), F.count_if(~held_out(F.col("doc_id"), 7)).alias("ends")).first()
    buckets, ends = max(64, min((told["size"] or 0) // BUCKET_BYTES, 1 << 20)), told["ends"]
    asked = stored(asked_grams(own, folder, buckets), folder, "asked")
    upper = stored(upwards(asked, buckets), folder, "upper")
    found = upper.filter("context < 0").select(F.sum("n0").alias("tokens"), F.sum("n1").alias("distinct")).first()
    totals = {"tokens": (found["tokens"] or 0) + ends, "distinct": (found["distinct"] or 0) + (ends > 0), "ends": ends}
    waiting = asked.filter("bucket < 0")
    told = told_grams(asked, short_contexts(upper, folder), buckets)
    return answered_texts(waiting.unionByName(told), max(1, waiting.count()), totals)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
