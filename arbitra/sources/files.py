"""JSON Lines, JSON documents, native splits and file checksums."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbitra.schema import SPLITS
from arbitra.sources.shared import Store, materialise, package_on_workers

#: Tasks that number lines at most; beyond it a task has several ranges.
MOST_TASKS = 100_000


def read_rows(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON Lines with a fixed schema. Blank lines are skipped; a bad line fails the job, or stands in ``_corrupt_record`` if not strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("allowNonNumericNumbers", "false")
    if not strict:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.schema(schema).json(path)


def scan(spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """One native split. A limit needs a stable order: the first rows by it, by a distributed top-k."""
    reader = spark.read.format(file_format)
    rows = (reader.schema(schema) if schema else reader).load(path)
    if limit is None:
        return rows
    if not order:
        raise ValueError("a prefix needs an order")
    return rows.orderBy(*order).limit(limit)


def discover_configs(available: Iterable[str], chosen: list[str] | None = None) -> list[str]:
    """Sorted configuration names, or the chosen ones; unknown or no names are errors."""
    names = sorted(available)
    if chosen is not None and (not isinstance(chosen, list) or not chosen or set(chosen) - set(names)):
        raise ValueError(f"unknown or no configurations; available: {names}")
    found = sorted(chosen) if chosen is not None else names
    if not found:
        raise ValueError("no configuration was found")
    return found


def load_config(path: str | Path) -> dict:
    """A JSON object, which is also YAML."""
    with open(path, encoding="utf-8") as source:
        found = json.load(source)
    if type(found) is not dict:
        raise ValueError(f"{path} doesn't hold a JSON object")
    return found


def write_json(path: str | Path, value) -> None:
    """Readers see the old document or the new one: it is written under a name of its own, flushed, then renamed. NaN and infinities are errors."""
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, prefix=".json-", delete=False) as target:
        try:
            json.dump(value, target, indent=2, ensure_ascii=False, allow_nan=False)
            target.write("\n")
            target.flush()
            os.fsync(target.fileno())
            os.replace(target.name, path)
        except BaseException:
            os.unlink(target.name)
            raise


def write_splits(rows: DataFrame, folder: str) -> None:
    """One JSON Lines folder for each split, written in parallel by Spark's commit protocol."""
    rows.write.mode("errorifexists").partitionBy("split").option("ignoreNullFields", "false").json(folder)


def merge_splits(spark: SparkSession, folder: str) -> None:
    """Each split's part files in ``folder`` as one file ``<split>.jsonl``, for readers that want exactly one."""
    store = Store(spark)
    for split in SPLITS:
        parts = sorted(n for n in store.files(folder) if n.startswith(f"split={split}/"))
        store.join([f"{folder}/{n}" for n in parts], f"{folder}/.{split}.jsonl")
        store.move(f"{folder}/.{split}.jsonl", f"{folder}/{split}.jsonl")
        store.delete(f"{folder}/split={split}")


#: Bytes of a file that a task reads at a time.
BLOCK = 1 << 22
#: Bytes of a file whose lines one task numbers.
SPLIT = 64 << 20


def _open(path: str):
    """A seekable stream of any file that Arrow's file systems reach: local, HDFS, object stores."""
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _sized(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and bytes of files, or of all files in folders; hidden ones don't count."""
    store = Store(spark)
    found = []
    for path in paths:
        found += [(f"{path.rstrip('/')}/{name}", size) for name, size in store.files(path).items()] if store.is_folder(path) else [(path, store.size(path))]
    return spark.createDataFrame(found, "path string, bytes long")


def stream_info(path: str) -> tuple[str, int, int]:
    """sha256, bytes, lines of a file of any size, block by block."""
    sha, size, lines = hashlib.sha256(), 0, 0
    with _open(path) as source:
        while block := source.read(BLOCK):
            sha.update(block)
            size, lines = size + len(block), lines + block.count(b"\n")
    return sha.hexdigest(), size, lines


INFO = "path string, sha256 string, bytes long, lines long"


def file_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """INFO of whole files, or of all files in folders: one file a task, each read in blocks on the executors, so no file is ever held as one value."""
    package_on_workers(spark)

    def run(batches):
        for batch in batches:
            found = [(path, *stream_info(path)) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "sha256", "bytes", "lines"), row, strict=True)) for row in found], schema=pa.schema([("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("lines", pa.int64())]))

    near = [p for p in paths if _reached(p)]
    files = _sized(spark, near).select("path")
    found = files.repartition(max(1, files.count())).mapInArrow(run, INFO)
    far = _sized(spark, [p for p in paths if p not in near]).collect()
    return found.unionByName(_values_info(spark, {r.path: r.bytes for r in far})) if far else found


def _reached(path: str) -> bool:
    """Whether Arrow has a file system for a path's scheme; Spark's may have more."""
    try:
        return fs.FileSystem.from_uri(path) is not None
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _values_info(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """INFO of files that only Spark's readers reach, each as one value (2 GB at most); empty ones, which its reader passes over, are known without it."""
    known = spark.createDataFrame([(p, hashlib.sha256().hexdigest(), 0, 0) for p, size in sizes.items() if not size], INFO)
    paths = [p for p, size in sizes.items() if size]
    if not paths:
        return known
    text = F.decode("content", "ISO-8859-1")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines")
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), lines).unionByName(known)


def _lines(path: str, start: int, stop: int, before: int) -> Iterator[tuple[int, str]]:
    """(number, text) of the lines that begin in bytes ``start`` to ``stop``; ``before`` newlines stand before ``start``."""
    with _open(path) as source:
        at, number, rest, inside = start, before + 1, b"", True
        if start:
            source.seek(start - 1)
            inside = source.read(1) == b"\n"
            number += not inside
        while at < stop:
            block = source.read(BLOCK)
            if not block:
                break
            if not inside:
                head, newline, block = block.partition(b"\n")
                at += len(head) + len(newline)
                inside = bool(newline)
                if not inside:
                    continue
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            for part in parts:
                if at >= stop:
                    return
                yield number, part.decode("utf-8", "replace")
                number += 1
                at += len(part) + 1
        if rest and at < stop:
            yield number, rest.decode("utf-8", "replace")


def lines_of(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """file, line (from 1) and raw of every line of one or more files, or all files in folders, of any size.

    Files are cut into ranges of ``split`` bytes. Newlines are counted by range, then summed up over the ranges before; then each range
    gives the lines that begin in it. A task holds a block and its longest line.
    """
    package_on_workers(spark)
    sized = _sized(spark, [path] if isinstance(path, str) else list(path)).where("bytes > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")
    ranges = sized.select("path", "bytes", starts).withColumn("stop", F.least(F.col("start") + split, "bytes")).drop("bytes")
    tasks = max(1, min(MOST_TASKS, ranges.count()))

    def count(batches):
        for batch in batches:
            found = []
            for name, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                newlines, at = 0, start
                with _open(name) as source:
                    source.seek(start)
                    while at < stop and (block := source.read(min(BLOCK, stop - at))):
                        newlines, at = newlines + block.count(b"\n"), at + len(block)
                found.append(newlines)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["path", "start", "stop", "newlines"])

    counted = materialise(ranges.repartition(tasks).mapInArrow(count, "path string, start long, stop long, newlines long"))
    earlier = F.sum("newlines").over(Window.partitionBy("path").orderBy("start")) - F.col("newlines")

    def read(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "line", "raw"])

        for batch in batches:
            for name, start, stop, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size = [], 0
                for number, raw in _lines(name, start, stop, before):
                    held.append((name, number, raw))
                    size += len(raw)
                    if len(held) == 4096 or size > BLOCK:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    placed = counted.select("path", "start", "stop", earlier.alias("before")).repartition(tasks)
    return placed.mapInArrow(read, "file string, line long, raw string")


def numbered_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, split: int = SPLIT) -> DataFrame:
    """file, line (from 1) and raw of each line of JSON Lines files that isn't blank and doesn't parse."""
    parsed = F.from_json("raw", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"})
    bad = (F.trim("raw") != "") & (parsed["_bad"].isNotNull() | parsed.isNull())
    return lines_of(spark, path, split).where(bad)
