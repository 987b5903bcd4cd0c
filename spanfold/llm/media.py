"""Operator 5, media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become an 8-bit grey PNG image 64 samples
wide (lossless). Each task appends its payloads to tar shards under the shared folder, once a shard for each
digest; rows carry digest, shard, offset and length. The smallest place of a digest over all shards is its
address, so equal payloads have one address however many shards hold them; only digests and places are shuffled,
never payloads. Metadata columns come from reads of HEADER_BYTES bytes at each address; features come from whole
ranges, decoded and checked.

Defined cases: a null or empty text is a payload of 64 zero bytes with n_bytes 0; null ids and repeated rows are
kept; equal texts share one address and all values; an empty table gives an empty result and no shard; a shard
holds one payload at least, so a very long text may exceed SHARD_BYTES; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, lean, open_fs, read_table, shared_dir, small_batches, stored, texts_of, write_file

WIDTH, UNIT, SHARD_BYTES, LEVEL = 64, 64, 32 << 20, 1
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
METADATA = "width int, height int, bit_depth int, colour_type int"
READ = f"digest string, {METADATA}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each line begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png wrote."""
    width, height, depth, colour = header_of(media)
    at, body = 8, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        part = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("samples of another kind")
    return rows[:, 1:].tobytes()


def tar_entry(name: str, body: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(body)
    return info.tobuf(tarfile.USTAR_FORMAT) + body + bytes(-len(body) % 512)


class Shard:
    def __init__(self, path: str):
        self.path, self.pieces, self.size, self.places = path, [], 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[int, int]:
        """(offset, length) of a payload's media; appended unless the shard has it."""
        if digest not in self.places:
            media = to_png(payload)
            entry = tar_entry(f"{digest}.png", media)
            self.places[digest] = (self.size + 512, len(media))
            self.pieces.append(entry)
            self.size += len(entry)
        return self.places[digest]

    def close(self) -> None:
        write_file(self.path, [*self.pieces, bytes(1024)])


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stored rows of ROWS, one for each row of docs."""
    schema = arrow_schema(ROWS)

    def run(batches):
        task, number, shard = TaskContext.get().partitionId(), 0, None
        for batch in small_batches(batches, "text"):
            out = []
            for text in texts_of(batch):
                if shard is None:
                    shard, number = Shard(f"{folder}/media-{task:010d}-{number:06d}.tar"), number + 1
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                out.append((n, digest, shard.path, *shard.put(digest, payload)))
                if shard.size >= shard_bytes:
                    shard.close()
                    shard = None
            columns = [batch.column(0), *zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if shard is not None:
            shard.close()

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), ROWS), folder, "rows")


def addresses(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one address for each digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.shard", "place.offset", "place.length")


def _ranged(places: DataFrame, ddl: str, use) -> DataFrame:
    """use(file, digest, offset, length) -> values of ddl, with each shard opened once a task."""
    schema = arrow_schema(ddl)

    def run(batches):
        path, file = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != path:
                    if file is not None:
                        file.close()
                    files, local = open_fs(shard)
                    path, file = shard, files.open_input_file(local)
                out.append((digest, *use(file, offset, length)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if file is not None:
            file.close()

    return places.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(lean(run), ddl)


def metadata(places: DataFrame) -> DataFrame:
    """digest and METADATA, from header-only range reads."""
    return _ranged(places, f"digest string, {METADATA}", lambda file, offset, length: header_of(file.read_at(HEADER_BYTES, offset)))


def feature_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean and entropy (bits a sample) of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    return f"{width}x{height} mean={(counts * np.arange(256)).sum() / len(payload):.4f} entropy={abs(float((p * np.log2(p)).sum())):.4f}"


def read_back(places: DataFrame) -> DataFrame:
    """READ for each address: the header first, then the whole range, decoded."""

    def use(file, offset, length):
        head = header_of(file.read_at(HEADER_BYTES, offset))
        media = file.read_at(length, offset)
        payload = from_png(media)
        return (*head, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, *head[:2]))

    return _ranged(places, READ, use)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "media")
    rows = write_shards(read_table(spark, sf_dir, "documents"), folder)
    found = stored(read_back(addresses(rows)), folder, "read")
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
