"""Versions of a master that several runs may write at once.

A version is a numbered manifest that names a folder of data; the highest number is the current
one. A writer merges into the version it read, writes the data beside it and a manifest under a
name of its own, and then moves the manifest to the next number, which fails if another run was
there first. It then reads that version and merges again, so no run's rows are lost. A manifest
has its content before it has its number, so a reader never sees half a version; nothing is
overwritten or deleted.

The file system has to refuse a move onto a file, as HDFS does in one step; object stores that
cannot need one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "manifests", "data"
TRIES = 20


class _Folder:
    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.make, self.spark, self.folder = jvm.org.apache.hadoop.fs.Path, spark, folder.rstrip("/")
        self.system = self.make(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.hadoop.io.IOUtils
        self.out = jvm.java.io.ByteArrayOutputStream
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self.keep = spark.sparkContext._gateway.new_array(kind, 1)
        self.keep[0] = kind.NONE
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), configuration)

    def manifest(self, number: int):
        return self.make(f"{self.folder}/{MANIFESTS}/{number:012d}")

    def numbers(self) -> list[int]:
        top = self.make(f"{self.folder}/{MANIFESTS}")
        if not self.system.exists(top):
            return []
        names = [status.getPath().getName() for status in self.system.listStatus(top)]
        return sorted(int(name) for name in names if name.isdigit())

    def read(self, number: int) -> str:
        """The data folder of a version."""
        stream, held = self.system.open(self.manifest(number)), self.out()
        try:
            self.io.copyBytes(stream, held, 4096, False)
        finally:
            stream.close()
        return held.toString("UTF-8")

    def create(self, number: int, data: str) -> bool:
        """Whether the number was this run's to take."""
        prepared = self.make(f"{self.folder}/{MANIFESTS}/{data}")
        stream = self.system.create(prepared, False)
        stream.write(bytearray(data.encode()))
        stream.close()
        try:
            self.context.rename(prepared, self.manifest(number), self.keep)
        except Py4JJavaError as error:
            self.system.delete(prepared, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True


def current_version(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """Number and rows of the newest version."""
    place = _Folder(spark, folder)
    numbers = place.numbers()
    if not numbers:
        return None
    return numbers[-1], spark.read.parquet(f"{place.folder}/{DATA}/{place.read(numbers[-1])}")


def update_master(spark: SparkSession, folder: str, merge: Callable[[DataFrame | None], DataFrame]) -> int:
    """Write what ``merge`` makes of the current version (None when there is none) as the next
    one, and return its number (W3, K10). ``merge`` runs again when another run was first."""
    place = _Folder(spark, folder)
    for _ in range(TRIES):
        number, rows = current_version(spark, folder) or (0, None)
        data = uuid.uuid4().hex
        merge(rows).write.parquet(f"{place.folder}/{DATA}/{data}")
        if place.create(number + 1, data):
            return number + 1
    raise RuntimeError(f"{folder}: {TRIES} other runs were first")
