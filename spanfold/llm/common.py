"""What the training-data operators share: the shared work folder, eager tables, file access, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import pathlib
import pickle
import posixpath
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that Spark hands to Python at once, unless the session says otherwise.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, so that Python workers can import it from anywhere."""
    if getattr(spark.sparkContext, "_spanfold_shipped", False):
        return
    root, own = pathlib.Path(__file__).resolve().parent.parent, tempfile.mkdtemp(prefix="spanfold-ship-")
    atexit.register(shutil.rmtree, own, True)
    to = pathlib.Path(own) / "spanfold_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(to))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":  # the default suits short rows, not whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.sparkContext._spanfold_shipped = True


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see; ships the package, too.

    Only in local mode a folder of this machine takes the place of an absent setting. `release` removes such folders.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = getattr(spark, "_spanfold_dir", None)
        if base is None:
            own = tempfile.mkdtemp(prefix="spanfold-")
            atexit.register(shutil.rmtree, own, True)
            base = f"file://{own}"
            spark._spanfold_dir = base
    made = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    spark._spanfold_made = [*getattr(spark, "_spanfold_made", []), made]
    return made


def release(spark: SparkSession) -> None:
    """Deletes the work folders of this session so far; results that still read from them must have been written before."""
    for made in getattr(spark, "_spanfold_made", []):
        files, path = open_fs(made)
        with contextlib.suppress(FileNotFoundError):
            files.delete_dir(path)
    spark._spanfold_made = []


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and lost executors cost nothing."""
    to = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def chosen(rows: DataFrame, number: str, numbers: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows whose number is among `numbers`; numbers are of monotonically_increasing_id, and rows are not shuffled for it.

    What is asked of each part of the numbering (its upper bits) goes to a file of the shared folder, never more than
    the part has rows; tasks that read rows look their parts up.
    """
    to, schema = f"{folder}/{name}-chosen", arrow_schema("part long, n long")

    def note(batches):
        part, held = None, []

        def told():
            write_file(f"{to}/{part}", [packed(np.concatenate(held))])
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sum(map(len, held))])], schema=schema)

        for batch in batches:
            own, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(own).tolist():
                if p != part:
                    if held:
                        yield told()
                    part, held = p, []
                held.append(asked[own == p].copy())
        if held:
            yield told()

    asked = numbers.select(F.shiftright(F.col(number), 33).alias("part"), F.col(number).alias("number")).repartition("part").sortWithinPartitions("part", "number")
    stored(asked.mapInArrow(lean(note), "part long, n long"), folder, f"{name}-noted")
    at = rows.columns.index(number)

    def pick(batches):
        part, held = None, np.zeros(0, np.int64)
        files, path = open_fs(to)
        for batch in batches:
            own = batch.column(at).to_numpy()
            keep = np.zeros(len(own), bool)
            for p in np.unique(own >> 33).tolist():
                if p != part:
                    there = files.get_file_info(f"{path}/{p}").is_file
                    part, held = p, unpacked(read_file(f"{to}/{p}")) if there else np.zeros(0, np.int64)
                keep |= (own >> 33 == p) & np.isin(own, held)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return rows.mapInArrow(lean(pick), rows.schema)


def open_fs(uri: str):
    """(file system, path) of a folder or file in any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, pieces) -> None:
    """Writes a file whole or not at all: under a name of this attempt first, then moved to its own name.

    A repeated task writes the same bytes again, so it does not matter which attempt comes last.
    """
    files, path = open_fs(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(attempt) as out:
        for piece in pieces:
            out.write(piece)
    files.move(attempt, path)


def read_file(uri: str) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        return f.read()


def packed(value, level: int = 1) -> bytes:
    """A value of arrays, bytes and lists, compressed; `unpacked` gives it back."""
    raw = pickle.dumps(value, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpacked(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def lean(run):
    """A function for mapInArrow that gives memory back once its input ends: Spark keeps idle Python workers for a minute."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only in the GNU C library
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def planes(numbers: np.ndarray) -> np.ndarray:
    """First, second, ... bytes of all numbers, a row each; they compress better apart."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)


def from_planes(rows: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(rows.T).view(kind).reshape(-1)


class Numbers(dict):
    """Number of each key, in the order in which they were first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def smallest(numbers: np.ndarray) -> np.ndarray:
    """Numbers, none below zero, in the narrowest unsigned type."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()))) if len(numbers) else numbers.astype(np.uint8)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at starts, one after the other."""
    shift = np.repeat(starts - (lengths.cumsum() - lengths), lengths)
    return flat[np.arange(len(shift)) + shift]


def grouped(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches that hold about most_bytes of `column` together."""
    group, size = [], 0
    for batch in batches:
        n = batch.column(batch.schema.get_field_index(column)).nbytes
        if group and size + n > most_bytes:
            yield group
            group, size = [], 0
        group.append(batch)
        size += n
    if group:
        yield group


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about most_bytes of `column` at most (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = col.nbytes
        step = n if size <= most_bytes else max(1, int(n * most_bytes / size))
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def n_words(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the decimal id leaves 2; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == 2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
