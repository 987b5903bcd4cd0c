"""Folders for tables between jobs, and the file system they are in."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the engine to the executors, once a session, for the Python that admission in streams runs there."""
    if getattr(spark.sparkContext, "_spanfold_engine_shipped", False):
        return
    root, own = pathlib.Path(__file__).resolve().parent.parent, tempfile.mkdtemp(prefix="spanfold-ship-")
    atexit.register(shutil.rmtree, own, True)
    to = pathlib.Path(own) / "spanfold_engine.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._spanfold_engine_shipped = True


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in local mode without it, of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        own = tempfile.mkdtemp(prefix="spanfold-")
        atexit.register(shutil.rmtree, own, True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


class Folder:
    """A folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.files = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def make(self, *names: str) -> None:
        for name in names:
            self.files.mkdirs(self._of(f"{self.path}/{name}"))

    def matching(self, pattern: str) -> list[str]:
        """Paths under the folder that fit a pattern."""
        return [str(x.getPath()) for x in self.files.globStatus(self._of(f"{self.path}/{pattern}")) or []]

    def size(self, name: str) -> int:
        """Bytes of the files in a folder of this one."""
        return self.files.getContentSummary(self._of(f"{self.path}/{name}")).getLength()

    def remove(self, path: str) -> None:
        self.files.delete(self._of(path), True)
