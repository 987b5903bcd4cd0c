"""Operator 1, token-id output: Simple-8b word-aligned coding in shard files.

Documents are range-partitioned by doc_id; each partition encodes its texts in id order and writes one file,
so files in name order hold the ids of all documents in ascending doc_id order. A file's totals give the
offsets of the next ones (one row a file). Reading decodes all blocks of a file at once.

File format, little-endian:
  header   8 bytes  magic "SF8BTOK1"
  words    64-bit words of all blocks. The top four bits select the layout of the other 60 (SELECTORS: how many
           ids of how many bits, the first id lowest); selector 0 is an escape: the 60 bits are the position of a
           raw value in the file's table of escapes. A block holds BLOCK_IDS ids (the last one fewer) and starts a word;
           the last word of a block may have room to spare, which is zero.
  escapes  raw 64-bit values, for ids of more than 60 bits
  blocks   for each block the position of its first word (64 bits)
  index    for each document its doc_id (64 bits; a missing id is the smallest long) and its number of ids (64 bits)
  footer   6 x 64 bits: ids, words, escapes, blocks, documents, BLOCK_IDS, then the magic again
The block offsets let a reader decode any block alone, and all of them side by side: every word's selector is read
at once, words are sorted by selector, and each selector's words are unpacked as one array.

Defined cases: a null or empty text has the end id alone; null ids come first; equal ids keep no fixed order among
themselves; an empty table gives an empty result and no file; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, lean, open_fs, read_table, shared_dir, small_batches, stored, texts_of, write_file

VOCABULARY, END_ID, BLOCK_IDS, MAGIC, NO_ID = "word_bpe_49k.json", 2, 4096, b"SF8BTOK1", -(2**63)
#: Fixed values of the format: (ids, bits of each) for selectors 1 to 15.
SELECTORS = ((240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
FILE_BYTES, SLAB_BLOCKS = 32 << 20, 256
CACHE_WORDS = 400_000


#: Bits of each value below 2^16.
_BITS16 = np.zeros(1 << 16, np.int8)
for _b in range(16):
    _BITS16[1 << _b :] += 1


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned id."""
    out, rest = _BITS16[(ids & np.uint64(0xFFFF)).astype(np.int64)], ids >> np.uint64(16)
    for shift in (16, 32, 48):
        if not rest.any():
            break
        part = _BITS16[(rest & np.uint64(0xFFFF)).astype(np.int64)]
        out, rest = np.where(part > 0, part + np.int8(shift), out).astype(np.int8), rest >> np.uint64(16)
    return out


def widest(bits: np.ndarray, count: int) -> np.ndarray:
    """Largest of each `count` neighbours along the rows; the rows get shorter by count - 1."""
    out, span = bits, 1
    while span < count:
        step = min(span, count - span)
        out, span = np.maximum(out[:, :-step], out[:, step:]), span + step
    return out


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, first word of each block) of unsigned ids; SLAB_BLOCKS blocks at a time, to bound memory."""
    words, escapes, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    n_words = n_escapes = 0
    for at in range(0, len(ids), SLAB_BLOCKS * block_ids):
        w, e, f = pack_slab(ids[at : at + SLAB_BLOCKS * block_ids].astype(np.uint64), block_ids, n_escapes)
        words.append(w), escapes.append(e), first.append(f + n_words)
        n_words, n_escapes = n_words + len(w), n_escapes + len(e)
    return np.concatenate(words), np.concatenate(escapes), np.concatenate(first)


def pack_slab(ids: np.ndarray, block_ids: int, escapes_before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // block_ids)
    # A block to a row, with room of no bits behind it: the last word of a block then fits what is left.
    bits = np.zeros((blocks, block_ids + SELECTORS[0][0]), np.int8)
    flat = np.zeros(blocks * block_ids, np.int8)
    flat[:n] = bit_lengths(ids)
    bits[:, :block_ids] = flat.reshape(blocks, block_ids)
    choice = np.zeros((blocks, block_ids), np.int8)  # selector 0: an escape
    for s in range(len(SELECTORS), 0, -1):  # later ones take more ids and win
        count, width = SELECTORS[s - 1]
        np.copyto(choice, np.int8(s), where=widest(bits[:, : block_ids + count - 1], count) <= width)
    # All blocks advance together, a word at a time.
    room, rows, sizes = np.array([1, *(c for c, _ in SELECTORS)]), np.arange(blocks), np.minimum(n - np.arange(blocks) * block_ids, block_ids)
    at, steps = np.zeros(blocks, np.int64), []
    while (live := at < sizes).any():
        here = np.minimum(at, block_ids - 1)
        steps.append(np.where(live, here, -1))
        at = at + np.where(live, room[choice[rows, here]], 0)
    grid = np.array(steps).T
    owner, step = np.nonzero(grid >= 0)
    inside = grid[owner, step]
    head = owner * block_ids + inside
    choice = choice.reshape(-1)
    taken = np.minimum(room[choice[head]], sizes[owner] - inside)
    chosen, size = choice[head], taken
    words = chosen.astype(np.uint64) << np.uint64(60)
    raw = np.flatnonzero(chosen == 0)
    words[raw] |= np.arange(escapes_before, escapes_before + len(raw), dtype=np.uint64)
    for s in np.unique(chosen[chosen > 1]):
        width, mine = SELECTORS[s - 1][1], np.flatnonzero(chosen == s)
        for k in range(int(size[mine].max())):
            some = mine[size[mine] > k]
            words[some] |= ids[head[some] + k] << np.uint64(k * width)
    first = np.searchsorted(owner, np.arange(blocks))
    return words, ids[head[raw]], first


def unpack(words: np.ndarray, escapes: np.ndarray, first: np.ndarray, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The n ids of packed blocks; the block offsets let SLAB_BLOCKS blocks be decoded at a time, to bound memory."""
    kind = np.uint64 if len(escapes) else np.uint32 if not len(words) or int((words >> np.uint64(60)).max()) < 14 else np.uint64
    out, ends = np.empty(n, kind), np.append(first, len(words))
    for b in range(0, len(first), SLAB_BLOCKS):
        stop = min(b + SLAB_BLOCKS, len(first))
        lo, hi = b * block_ids, min(stop * block_ids, n)
        out[lo:hi] = unpack_slab(words[ends[b] : ends[stop]], escapes, first[b:stop] - ends[b], hi - lo, block_ids)
    return out


def unpack_slab(words: np.ndarray, escapes: np.ndarray, first: np.ndarray, n: int, block_ids: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    payload = words & np.uint64((1 << 60) - 1)
    room = np.array([1, *(c for c, _ in SELECTORS)])[chosen]
    # Where each word's ids go: a block's start plus the ids of the block's words before it; the last word of a block is cut short.
    before = room.cumsum() - room
    sizes = np.diff(np.append(first, len(words)))
    start = np.repeat(np.arange(len(first)) * block_ids - before[first], sizes) + before
    stop = np.repeat(np.minimum(np.arange(1, len(first) + 1) * block_ids, n), sizes)
    out = np.zeros(n, np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            out[start[mine]] = escapes[payload[mine].astype(np.int64)]
            continue
        count, width = SELECTORS[s - 1]
        if not width:
            continue
        for k in range(count):
            to = start[mine] + k
            some = to < stop[mine]
            out[to[some]] = payload[mine[some]] >> np.uint64(k * width) & np.uint64((1 << width) - 1)
    return out


def file_pieces(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS):
    words, escapes, first = pack(ids, block_ids)
    yield MAGIC
    for part in (words, escapes, first):
        yield part.astype("<u8").tobytes()
    yield np.column_stack([doc_ids, counts]).astype("<i8").tobytes()
    yield np.array([len(ids), len(words), len(escapes), len(first), len(doc_ids), block_ids], "<u8").tobytes()
    yield MAGIC


def read_ids(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids) of one file."""
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        data = f.read()
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError(f"{uri} is not a whole token file")
    n, words, escapes, blocks, docs, block_ids = np.frombuffer(data[-56:-8], "<u8").astype(np.int64).tolist()
    body = np.frombuffer(data, "<u8", offset=8, count=words + escapes + blocks)
    index = np.frombuffer(data, "<i8", offset=8 + body.nbytes, count=2 * docs).reshape(-1, 2)
    ids = unpack(body[:words], body[words : words + escapes], body[words + escapes :].astype(np.int64), n, block_ids)
    return index[:, 0], index[:, 1], ids


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Ids of words, as bytes of unsigned 32-bit integers; looked up or else found and remembered.

    Exact for tokenizers that drop white space and never look across it, as this vocabulary's does: its
    pre-tokenizer keeps no white space and its normalizer changes nothing across a space. Words of printable ASCII
    and the letters of Latin-1, which the normalizer only puts in lower case, take the model's merges at once; all
    others, and those that may hold a special token, go through the library's whole encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+").findall
        self.letters = {chr(b): letter for b, letter in enumerate(byte_letters())}
        self.letters = str.maketrans(self.letters)
        self.parts: dict = {}

    def __missing__(self, word: str) -> bytes:
        if self.plain(word) and "<|" not in word:
            out = b""
            for part in self.cut(word.lower()):
                ids = self.parts.get(part)
                if ids is None:
                    raw = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                    ids = self.parts[part] = np.array([t.id for t in self.merge(raw)], "<u4").tobytes()
                out += ids
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = out
        return out


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.known, self.most = Words(path), cache_words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        if len(self.known) > self.most:
            self.known.clear()
            self.known.parts.clear()
        look = self.known.__getitem__
        return [b"".join(map(look, t.replace("\n", " ").split(" "))) for t in texts]


_ENCODERS: dict = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps it between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and returns the stored manifest: file_no, path, docs, ids, start, in file order."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = own.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // file_bytes))
    ddl = "file_no int, path string, docs long, ids long"
    schema = arrow_schema(ddl)

    def run(batches):
        number, ids, counts, names, coder = TaskContext.get().partitionId(), [], [], [], encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text", 4 << 20):
            coded = coder.encode(texts_of(batch))
            counts.append(np.array([len(c) // 4 + 1 for c in coded], np.int64))
            ids.append(np.frombuffer(b"".join(x for c in coded for x in (c, end)), "<u4"))
            names.append(batch.column(0).fill_null(NO_ID).to_numpy())
        if names:
            n = np.concatenate(counts)
            path = f"{folder}/tokens-{number:010d}.s8b"
            write_file(path, file_pieces(np.concatenate(names), n, np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], schema=schema)

    found = stored(own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(lean(run), ddl), folder, "written")
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    return found.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, counts, ids = read_ids(path)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = counts.cumsum()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                keys = pa.array(names, mask=names == NO_ID)
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files, "path").mapInArrow(lean(run), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    return read_files(write_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY)))
