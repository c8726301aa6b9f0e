"""Tables in a folder that driver and executors share, written to cut lineage; they survive lost executors."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its written size is at most so many bytes.
BROADCAST_BYTES = 8 << 20

_own_dir: list[str] = []
_open: list["Scratch"] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not _own_dir:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir.append(tempfile.mkdtemp(prefix="sluice-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path, on whatever store it lies."""
    where, fs = _path(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file from the driver, on whatever store the path lies."""
    where, fs = _path(spark, path)
    out = fs.create(where)
    out.write(bytearray(text, "utf-8"))
    out.close()


def join_text(spark: SparkSession, folder: str, path: str | os.PathLike) -> None:
    """The part files of a folder, in their order, as one file on the driver's disk; bytes pass through a small buffer."""
    where, fs = _path(spark, folder)
    jvm = spark.sparkContext._jvm
    parts = sorted((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = jvm.java.io.FileOutputStream(os.path.abspath(path))
    try:
        for part in parts:
            lines = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 16, False)
            finally:
                lines.close()
    finally:
        out.close()


class Scratch:
    """Tables of one run. They stay until ``drop`` or the end of the driver, since a lazy result may still read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
        self.count = 0
        _open.append(self)

    def drop(self) -> None:
        """Removes all tables; for callers that have taken what they need."""
        if self in _open:
            _open.remove(self)
        try:
            remove(self.spark, self.root)
        except Exception:  # the session may have ended before the interpreter
            pass

    def new_path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def save_rows(self, rows: Iterable[Sequence], schema: str, name: str) -> Table:
        """A table of numbers and plain names from the driver."""
        path = self.new_path(name)
        names = [f.split()[0] for f in schema.split(", ")]
        write_text(self.spark, f"{path}/part.json", "".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        return self.save(self.spark.read.schema(schema).json(path), f"{name}-table")

    def put(self, path: str | os.PathLike, name: str) -> str:
        """A copy of a file on the driver's disk, where executors can read it."""
        to = self.new_path(name)
        where, fs = _path(self.spark, to)
        fs.copyFromLocalFile(_path(self.spark, f"file://{os.path.abspath(path)}")[0], where)
        return to

    def save(self, df: DataFrame, name: str) -> Table:
        path = self.new_path(name)
        df.write.parquet(path)
        return Table(self.spark, path, df.schema)


@contextmanager
def passing() -> Iterator[None]:
    """Removes, at its end, the scratch tables that were made within: for work whose result is written by then."""
    before = list(_open)
    try:
        yield
    finally:
        for made in [s for s in _open if s not in before]:
            made.drop()


@atexit.register
def _drop_all() -> None:
    for made in list(_open):
        made.drop()


class Table:
    """A written table."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def bytes(self) -> int:
        return path_bytes(self.spark, self.path)

    def fitting(self, most: int = BROADCAST_BYTES) -> DataFrame:
        """The table, marked for broadcast if its written size allows; otherwise Spark shuffles it."""
        return F.broadcast(self.read()) if self.bytes() <= most else self.read()

    def drop(self) -> None:
        remove(self.spark, self.path)
