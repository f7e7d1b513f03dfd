"""Folders that every executor reads: the checkpoint folder, tables kept there, and small files through Hadoop's file systems."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or ``setCheckpointDir`` names; a temporary one serves local sessions, anything else is an error."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its members share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="arbitra-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its partitions and their order as they are.

    Needed where two branches must see the very same rows and partitions, as range bounds are sampled anew for every plan.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a record batch on its way to Python; a batch of so many rows would grow with the rows.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of a table at a time, however long its rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def package_on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package."""
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


class Store:
    """Small documents and whole folders on any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def is_folder(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where) and system.getFileStatus(where).isDirectory()

    def size(self, path: str) -> int:
        system, where = self._at(path)
        return system.getFileStatus(where).getLen()

    def names(self, folder: str) -> list[str]:
        system, where = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def files(self, folder: str, within: str = "") -> dict[str, int]:
        """Bytes of every file below ``folder`` by its relative name; hidden ones and Spark's markers don't count."""
        system, where = self._at(f"{folder}/{within}" if within else folder)
        out: dict[str, int] = {}
        for status in system.listStatus(where):
            name = status.getPath().getName()
            if name[0] not in "._":
                own = f"{within}/{name}" if within else name
                out |= self.files(folder, own) if status.isDirectory() else {own: status.getLen()}
        return out

    def read_json(self, path: str):
        system, where = self._at(path)
        stream = system.open(where)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, value) -> None:
        """Readers see the old document or the new one; NaN and infinities are errors."""
        said = json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
        system, where = self._at(path)
        _, aside = self._at(f"{path}._new")
        stream = system.create(aside, True)
        try:
            stream.write(bytearray(said.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else system.getUri(), self.conf)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(kinds.OVERWRITE.getClass(), 1)
        array[0] = kinds.OVERWRITE
        options.rename(system.makeQualified(aside), system.makeQualified(where), array)

    def move(self, source: str, destination: str) -> None:
        """A whole folder in one step; a destination that exists is refused."""
        system, where = self._at(destination)
        if system.exists(where):
            raise FileExistsError(destination)
        if not system.rename(self._at(source)[1], where):
            raise OSError(f"{source} can't be moved to {destination}")

    def delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)

    def join(self, parts: list[str], destination: str) -> None:
        """Files one after the other as one, streamed by the driver."""
        system, where = self._at(destination)
        target = system.create(where, True)
        try:
            for part in parts:
                own, place = self._at(part)
                source = own.open(place)
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 20, False)
                finally:
                    source.close()
        finally:
            target.close()
