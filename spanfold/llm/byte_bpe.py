"""Operator 9, byte-level BPE: Spark higher-order functions fold ranked merges over distinct words.

A chunk of documents (CHUNK_BYTES of text, or one longer document) is cut by the pattern; its distinct words that are no
token as a whole are asked for, in buckets by their hash, and the places of all its words wait in a file of the shared
folder. A bucket folds each distinct word of the whole table once, a word a row: every step merges the adjacent pair of
lowest rank, the leftmost of equals. Ranks come from a map of pairs of ids (every way to cut a token into two tokens), laid
out as a hash map in two arrays, as Spark searches its own maps from their front. The arrays are one row of a file that a
scalar subquery reads: as literals they would be spelt out in every text of the plan that the driver keeps. The buckets answer
the chunks, which gather their documents' ids. Decoding concatenates the binary pieces of the ids.

What is asked is stored with the names of the waiting files before it is answered, so a task that runs again cannot mix two
cuts. A bucket that has met MOST_WORDS words forgets them and begins anew, so memory is bounded; results do not depend on
that, nor on chunks. The fold's cost grows with the square of a word's length, so words of over LONG bytes are merged where they are
told apart instead, by a heap of their pairs: the same steps in the same order, near to the length in cost.

Defined cases: a null text counts as empty and has no ids; ids may be null; repeated rows are kept;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import uuid
import zlib
from collections.abc import Callable
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbers, arrow_schema, from_planes, gathered, grouped, lean, packed, planes, read_file, read_table, shared_dir, small_batches, smallest, stored, texts_of, unpacked, write_file

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_BYTES, PIECE_BYTES, MOST_WORDS, NO_RANK, LONG = 12 << 20, 2 << 20, 1 << 19, 2**17 - 1, 1024
SLOTS, MOVES = 262_147, 65_537
#: Bits of a packed piece: its place in the word, its id.
PLACE_BITS, ID_BITS = 29, 17
#: What a chunk asks of a bucket, packed; bucket -1 names the file of the chunk's documents.
ASKED = "chunk long, bucket int, blob binary"
#: A row is a word to fold, a long word's ids, or what a chunk asked, as places among the words; a new generation begins with no words.
CUT = "generation int, word array<tinyint>, known array<int>, chunk long, bucket int, places binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space after which a space may belong to a longer match than a cut at that space would give.
OTHER_SPACE = tuple(f"{chr(c)} " for c in range(0x3001) if chr(c).isspace())


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def cut_at_spaces(text: str) -> bool:
    """Whether cutting before every space cannot divide a match of the pattern."""
    return text[-1:] != " " and not any(s in text for s in OTHER_SPACE)


class Places(dict):
    """Place of each word: ~id of a word that is a token, else its number among the words to fold."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.count, self.new = ranks, 0, []

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        rank = self.ranks.get(raw)
        if rank is None:
            place, self.count = self.count, self.count + 1
            self.new.append(raw)
        else:
            place = ~rank
        self[word] = place
        return place


class Cutter:
    """Cuts texts into places of words. What lies between two spaces is cut by the pattern once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.whole_words = pattern == public_tokenizers.PATTERN  # there a space and ASCII letters are one match
        self.parts = Numbers()  # a part that follows a space is a string; others, in a tuple of one, stand for themselves
        self.places = Places(ranks)
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.parts) + len(self.places)

    def numbers_of(self, text: str) -> np.ndarray:
        if cut_at_spaces(text):
            head, *rest = text.split(" ")
            out = np.empty(len(rest) + 1, np.int64)
            out[0] = self.parts[(head,)]
            out[1:] = np.fromiter(map(self.parts.__getitem__, rest), np.int64, len(rest))
            return out
        return np.array([self.parts[(m,)] for m in self.find(text)], np.int64)  # a match alone is matched as itself

    def cut(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(new words to fold, places of all texts' words, where each text's begin and the last end)."""
        numbers = [self.numbers_of(t) for t in texts]
        flat, lengths, place = [], [], self.places.__getitem__
        for part in islice(self.parts, len(self.starts), None):
            if self.whole_words and isinstance(part, str) and part.isascii() and part.isalpha():
                flat.append(place(" " + part))
                lengths.append(1)
            else:
                found = self.find(" " + part if isinstance(part, str) else part[0])
                flat.extend(map(place, found))
                lengths.append(len(found))
        lengths = np.array(lengths, np.int64)
        self.starts = np.append(self.starts, len(self.flat) + lengths.cumsum() - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, np.array(flat, np.int32))
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        n = self.lengths[at]
        ends = np.append(0, n.cumsum())
        texts_end = np.fromiter(map(len, numbers), np.int64, len(numbers)).cumsum()
        new, self.places.new = self.places.new, []
        return new, gathered(self.flat, self.starts[at], n), ends[np.append(0, texts_end)]


def asked_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, folder: str, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ASKED. A waiting file holds ids of documents, places of all words and where each document's end."""
    schema = arrow_schema(ASKED)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as many entries as the vocabulary has

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, group in enumerate(grouped(small_batches(batches, "text", PIECE_BYTES), "text", chunk_bytes)):
            cutter, words, ids, places, ends = Cutter(shared.value, pattern), [], [], [], [np.zeros(1, np.int64)]
            for batch in group:
                new, at, stops = cutter.cut([t or "" for t in texts_of(batch)])
                words += new
                ids += batch.column(0).to_pylist()
                places.append(at)
                ends.append(stops[1:] + ends[-1][-1])
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            edges, number = np.searchsorted(bucket[order], np.arange(buckets + 1)), np.empty(len(words), np.int32)
            number[order] = np.arange(len(words), dtype=np.int32)
            at = np.concatenate(places)
            at[at >= 0] = number[at[at >= 0]]
            chunk, path = task << 32 | k, f"{folder}/waiting/{task}-{k}-{uuid.uuid4().hex}"
            write_file(path, [packed((ids, planes(at.astype(np.int32)), np.concatenate(ends)))])
            rows = [(-1, path.encode())]
            for b in range(buckets):
                own = [words[i] for i in order[edges[b] : edges[b + 1]].tolist()]
                if own:
                    rows.append((b, packed((b"".join(own), smallest(np.fromiter(map(len, own), np.int64, len(own)))))))
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows)), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ASKED)


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the pair of lowest rank first, the leftmost of equals, by a heap."""
    n = len(word)
    end, before, there = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(start: int, stop: int) -> None:
        if (rank := ranks.get(word[start:stop])) is not None:
            heapq.heappush(heap, (rank, start, stop))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not there[i] or (j := end[i]) >= n or end[j] != stop:
            continue  # one of the two was merged since
        end[i], there[j] = stop, 0
        if before[i] >= 0:
            offer(before[i], stop)
        if stop < n:
            before[stop] = i
            offer(i, end[stop])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def distinct_words(asked: DataFrame, ranks: dict[bytes, int], buckets: int, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows of CUT: what is new of a chunk's words, then their places."""
    schema = arrow_schema(CUT)
    shared = asked.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        generation, last, known = 0, None, Numbers()
        for batch in batches:
            for chunk, bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != last or len(known) > most_words:
                    generation, last, known = generation + 1, bucket, Numbers()
                raw, sizes = unpacked(blob.as_py())
                stops, had = sizes.astype(np.int64).cumsum().tolist(), len(known)
                words = [raw[lo:hi] for lo, hi in zip([0, *stops], stops)]
                at = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                new = list(islice(known, had, None))
                if new:
                    n = len(new)
                    ids = pa.array([merged_ids(w, shared.value) if len(w) > LONG else None for w in new], schema.field("known").type)
                    new = [b"" if len(w) > LONG else w for w in new]
                    ends = np.fromiter(map(len, new), np.int64, n).cumsum()
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(b"".join(new), np.int8)), type=schema.field("word").type)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, generation, np.int32)), lists, ids, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
                row = [generation, None, None, chunk, bucket, at.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return asked.filter("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), CUT)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(entries, moves): a hash map without collisions from a pair of ids, as one number, to the rank of the token they make.

    A key's place is key mod SLOTS plus moves[key mod MOVES]; the entry there has the key and, in its low bits, the rank.
    Both moduli are primes whose product exceeds any key, so no two keys share both remainders.
    """
    groups: dict[int, list[int]] = {}
    rank_of_key: dict[int, int] = {}
    width = max(ranks.values()) + 1
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rank_of_key[key := a * width + b] = rank
                groups.setdefault(key % MOVES, []).append(key)
    if width >= NO_RANK or width * width > SLOTS * MOVES or len(rank_of_key) > 0.8 * SLOTS:
        raise ValueError("the vocabulary is too large for packed pieces and this map")
    entries, moves, rng = [-1] * SLOTS, [0] * MOVES, random.Random(SLOTS)
    for group, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        while any(entries[(k + moves[group]) % SLOTS] >= 0 for k in keys):
            moves[group] = rng.randrange(SLOTS)
        for k in keys:
            entries[(k + moves[group]) % SLOTS] = k << ID_BITS | rank_of_key[k]
    return entries, moves


def stored_map(spark: SparkSession, ranks: dict[bytes, int], folder: str) -> Column:
    """A struct of the rank map's arrays and the ids of single bytes."""
    entries, moves = rank_map(ranks)
    row = pa.table({"entries": [entries], "moves": [moves], "singles": pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int32()))})
    pq.write_table(row, out := pa.BufferOutputStream())
    write_file(f"{folder}/ranks/map.parquet", [out.getvalue()])
    return spark.read.parquet(f"{folder}/ranks").select(F.struct("entries", "moves", "singles")).scalar()


class RankMap:
    """The rank map inside an expression."""

    def __init__(self, entries: Column, moves: Column, width: int):
        self.entries, self.moves, self.width = entries, moves, F.lit(width).cast("long")

    def rank_of(self, a: Column, b: Column) -> Column:
        """Rank of the token that two ids make side by side, NO_RANK if none (or where b is null)."""
        key = a.cast("long") * self.width + b
        place = (key + F.get(self.moves, (key % MOVES).cast("int"))) % SLOTS
        return bound(F.get(self.entries, place.cast("int")), lambda e: F.when(F.shiftright(e, ID_BITS) == key, e.bitwiseAND(F.lit(NO_RANK))).otherwise(F.lit(NO_RANK).cast("long")))


def piece_of(rank: Column, place: Column, token: Column) -> Column:
    """One long of a piece: the rank of its merge with the next piece, where it starts, its id."""
    return F.call_function("shiftleft", rank.cast("long"), F.lit(PLACE_BITS + ID_BITS)) + F.call_function("shiftleft", place.cast("long"), F.lit(ID_BITS)) + token


def id_in(piece: Column) -> Column:
    return piece.bitwiseAND(F.lit((1 << ID_BITS) - 1))


def place_in(piece: Column) -> Column:
    return F.shiftright(piece, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def fold_word(table: RankMap, singles: Column, word: Column) -> Column:
    """array<int> of the ids of one word, from its bytes.

    The state is an array of packed pieces, so its minimum is the leftmost merge of lowest rank.
    """

    def merged(acc, low, at):
        """acc with the piece at `at` (from 1) and the next one made into one, and the ranks on both its sides renewed."""
        token = F.shiftright(low, PLACE_BITS + ID_BITS)
        joined = piece_of(table.rank_of(token, id_in(F.get(acc, at + 1))), place_in(low), token)
        rest = F.slice(acc, at + 2, F.size(acc))
        before = bound(F.get(acc, at - 2), lambda x: piece_of(table.rank_of(id_in(x), token), place_in(x), id_in(x)))
        return F.when(at == 1, F.concat(F.array(joined), rest)).otherwise(F.concat(F.slice(acc, F.lit(1), at - 2), F.array(before, joined), rest))

    def step(acc, _):
        return bound(F.array_min(acc), lambda low: F.when(low >= NO_RANK << (PLACE_BITS + ID_BITS), acc).otherwise(bound(F.array_position(acc, low).cast("int"), lambda at: merged(acc, low, at))))

    ids = F.transform(word, lambda b: singles[b.cast("int").bitwiseAND(F.lit(255))])
    start = bound(ids, lambda x: F.transform(x, lambda a, i: piece_of(table.rank_of(a, F.get(x, i + 1)), i, a)))
    folded = F.aggregate(F.slice(word, 2, F.greatest(F.size(word) - 1, F.lit(0))), start, step)
    return F.transform(folded, lambda x: id_in(x).cast("int"))


def folded_words(rows: DataFrame, ranks: dict[bytes, int], folder: str) -> DataFrame:
    """Rows of CUT with `ids` of the words in the words' stead."""
    width = max(ranks.values()) + 1
    opened = lambda t: bound(t["entries"], lambda e: bound(t["moves"], lambda m: bound(t["singles"], lambda own: fold_word(RankMap(e, m, width), own, F.col("word")))))
    ids = bound(F.col("map"), opened)  # the only use of the column, so Spark puts the subquery in its place
    return rows.withColumn("map", stored_map(rows.sparkSession, ranks, folder)).select("generation", F.when(F.col("known").isNotNull(), F.col("known")).when(F.col("word").isNotNull(), ids).alias("ids"), "chunk", "bucket", "places")


def answers(folded: DataFrame) -> DataFrame:
    """Rows of ASKED: ids of the words that a chunk asked of a bucket, and how many each word has."""
    schema = arrow_schema(ASKED)

    def run(batches):
        generation, ids, sizes, new = -1, np.zeros(0, np.int32), np.zeros(0, np.int64), []
        for batch in batches:
            numbers, is_word = batch.column(0).to_numpy(), batch.column(4).is_null().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(is_word.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if numbers[lo] != generation:
                    generation, ids, sizes, new = numbers[lo], np.zeros(0, np.int32), np.zeros(0, np.int64), []
                part = batch.slice(lo, hi - lo)
                if is_word[lo]:
                    new.append((part.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(part.column(1).offsets.to_numpy())))
                    continue
                if new:
                    ids, sizes = (np.concatenate([have, *more]) for have, more in zip((ids, sizes), zip(*new)))
                    starts, new = sizes.cumsum() - sizes, []
                out = []
                for raw in part.column(4):
                    at = np.frombuffer(raw.as_py(), np.int32)
                    out.append(packed((smallest(gathered(ids, starts[at], sizes[at])), smallest(sizes[at]))))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(out, pa.binary())], schema=schema)

    return folded.mapInArrow(lean(run), ASKED)


def ids_of(places: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words at some places, how many each has); flat, starts, sizes: ids of the folded words."""
    lengths, out, some = np.ones(len(places), np.int64), ~places, places >= 0
    if some.any():
        at = places[some]
        lengths[some] = sizes[at]
        folded = np.repeat(some, lengths)
        whole, out = out[~some], np.empty(int(lengths.sum()), np.int32)
        out[~folded], out[folded] = whole, gathered(flat, starts[at], sizes[at])
    return out, lengths


def gather(told: DataFrame, chunks: int, ddl: str, use: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """doc_id and the columns that `use` makes of (some documents' ids, where each one's begin and the last end)."""
    schema = arrow_schema(ddl)

    def run(batches):
        def finish(path, parts):
            doc_ids, rows, ends = unpacked(read_file(path))
            places = from_planes(rows, np.int32)
            flat, sizes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            sizes = sizes.astype(np.int64)
            starts, lo = sizes.cumsum() - sizes, 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE_BYTES // 4, "right")) - 1)
                ids, lengths = ids_of(places[ends[lo] : ends[hi]], flat, starts, sizes)
                stops = np.append(0, lengths.cumsum())[ends[lo : hi + 1] - ends[lo]]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], pa.int64()), *use(ids, stops)], schema=schema)
                lo = hi

        path, parts = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                if bucket < 0:
                    if path is not None:
                        yield from finish(path, parts)
                    path, parts = blob.as_py().decode(), []
                else:
                    parts.append(unpacked(blob.as_py()))
        if path is not None:
            yield from finish(path, parts)

    return told.repartition(chunks, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(lean(run), ddl)


def coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ddl: str, use, chunk_bytes: int, most_words: int) -> DataFrame:
    """All steps: cut and ask, fold and answer, gather."""
    folder = shared_dir(docs.sparkSession, "bpe")
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(64, int(4 * (size >> 20) ** 0.5))
    asked = stored(asked_words(docs, ranks, pattern, folder, buckets, chunk_bytes), folder, "asked")
    waiting = asked.filter("bucket < 0")
    told = answers(folded_words(distinct_words(asked, ranks, buckets, most_words), ranks, folder))
    return gather(waiting.unionByName(told), max(1, waiting.count()), ddl, use)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk_bytes: int = CHUNK_BYTES, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs."""

    def lists(ids, ends):
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    return coded(docs, ranks, pattern, "doc_id long, ids array<int>", lists, chunk_bytes, most_words)


def pieces(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and decoded (binary) of rows of (doc_id, ids)."""
    ddl = "doc_id long, decoded binary"
    schema = arrow_schema(ddl)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = pieces(shared.value).__getitem__
        for batch in batches:
            found = [b"".join(map(table, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), ddl)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    ranks = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept: list = []

    def digests(ids, ends):
        if not kept:  # once a task
            kept[:] = pieces(shared.value), list(map(str, range(max(shared.value.values()) + 1)))
        piece, name = (x.__getitem__ for x in kept)
        names, decoded = [], []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = ids[lo:hi].tolist()
            names.append(hashlib.sha256(" ".join(map(name, own)).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(piece, own))).hexdigest())
        return [pa.array(np.diff(ends)), pa.array(names, pa.string()), pa.array(decoded, pa.string())]

    return coded(docs, ranks, public_tokenizers.PATTERN, DIGEST, digests, CHUNK_BYTES, MOST_WORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
