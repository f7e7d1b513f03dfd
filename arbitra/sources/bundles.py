"""Prepared data sets as a whole: rules that a manifest must meet, recorded facts of its files, and their publication.

A data set is a folder with ``manifest.json`` and, for each split, one file ``<split>.jsonl`` or Spark's part files in ``split=<split>``.
What makes it valid is a table of named rules over the manifest (a variant) and its files' sizes; all that are broken are told at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.schema import SPLITS
from arbitra.sources.files import file_info
from arbitra.sources.shared import Store

FORMAT_VERSION = 1
MODEL_FIELDS = ("model_name_or_path", "model_revision", "max_length", "max_candidates")
FACTS = "name string, sha256 string, bytes long, lines long"


def split_of(name: Column) -> Column:
    """The split that a payload file belongs to, or null."""
    return F.nullif(F.regexp_extract(name, r"^(?:split=)?([a-z]+)(?:\.jsonl$|/)", 1), F.lit(""))


def _rules(config: dict | None) -> dict[str, Column]:
    """What a data set must meet, by name; ``manifest`` is a variant and ``sizes`` maps splits to the bytes of their files."""
    at = lambda path, kind="variant": F.try_variant_get("manifest", path, kind)
    known = lambda path: F.schema_of_variant(at(path))
    rules = {
        "status is complete": at("$.status", "string") == "complete",
        "format version": at("$.format_version").isNull() | ((known("$.format_version") == "BIGINT") & (at("$.format_version", "long") == FORMAT_VERSION)),
    }
    for field in MODEL_FIELDS:
        own = at(f"$.config.{field}")
        wanted = F.lit(True) if config is None else F.to_json(own).eqNullSafe(F.lit(json.dumps(config.get(field), ensure_ascii=False)))
        rules[f"setting {field}"] = own.isNotNull() & wanted
    for split in SPLITS:
        rules[f"count of {split}"] = (known(f"$.counts.{split}") == "BIGINT") & (at(f"$.counts.{split}", "long") > 0)
        rules[f"files of {split}"] = F.coalesce(F.try_element_at("sizes", F.lit(split)), F.lit(0)) > 0
    return rules


def payload(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of the manifest and the splits' files by relative name."""
    return {n: size for n, size in Store(spark).files(folder).items() if n == "manifest.json" or re.match(rf"(split=)?({'|'.join(SPLITS)})(\.jsonl$|/)", n)}


def _links(folder: str, names) -> list[str]:
    """Payload files of a local folder that are links to elsewhere."""
    import os

    return [n for n in names if os.path.islink(f"{folder}/{n}")]


def check(spark: SparkSession, folder: str, config: dict | None = None) -> dict:
    """The manifest of a complete data set whose settings match ``config``; an error names every rule that is broken."""
    folder = str(folder)
    manifest, found = Store(spark).read_json(f"{folder}/manifest.json"), payload(spark, folder)
    sizes = spark.createDataFrame(list(found.items()), "name string, size long").groupBy(split_of(F.col("name")).alias("split")).agg(F.sum("size").alias("size")).where("split is not null")
    held = sizes.agg(F.map_from_entries(F.collect_list(F.struct("split", "size"))).alias("sizes")).withColumn("manifest", F.parse_json(F.lit(json.dumps(manifest))))
    broken = held.select(F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in _rules(config).items()))).alias("broken")).first().broken
    broken += [f"{n} is a link" for n in _links(folder, found)]
    if broken:
        raise ValueError(f"not a valid data set: {', '.join(broken)}")
    return manifest


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """FACTS of every payload file."""
    names = sorted(payload(spark, folder))
    told = file_info(spark, [f"{folder}/{n}" for n in names])
    return told.withColumn("name", F.regexp_extract("path", rf"({'|'.join(map(re.escape, names))})$", 1)).select("name", "sha256", "bytes", "lines")


def miscounted(told: DataFrame, manifest: dict) -> list[str]:
    """Splits whose files don't hold as many lines as the manifest counts."""
    counts = told.sparkSession.createDataFrame(list(manifest["counts"].items()), "split string, n long")
    lines = told.groupBy(split_of(F.col("name")).alias("split")).agg(F.sum("lines").alias("lines"))
    return [r.split for r in counts.join(lines, "split", "left").where("not n <=> lines").orderBy("split").collect()]


def differences(actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """Names of files whose facts differ, or that only one side has."""
    both = actual.unionByName(recorded).groupBy("name", "sha256", "bytes", "lines").agg(F.count(F.lit(1)).alias("sides"))
    return both.where("sides != 2").select("name").distinct()


def build(spark: SparkSession, folder: str) -> dict:
    """Writes bundle.json: the facts of each payload file, once lines agree with the manifest's counts."""
    folder = str(folder)
    manifest, told = check(spark, folder), facts(spark, folder).persist()
    if wrong := miscounted(told, manifest):
        raise ValueError(f"row counts differ from the manifest: {wrong}")
    bundle = {"format_version": FORMAT_VERSION, "files": {r.name: {"sha256": r.sha256, "bytes": r.bytes, "lines": r.lines} for r in told.collect()}}
    told.unpersist()
    Store(spark).write_json(f"{folder}/bundle.json", bundle)
    return bundle


def verify(spark: SparkSession, folder: str) -> dict:
    """The manifest of a data set whose files are exactly those of its bundle."""
    folder = str(folder)
    manifest, bundle = check(spark, folder), Store(spark).read_json(f"{folder}/bundle.json")
    recorded = spark.createDataFrame([(n, f["sha256"], f["bytes"], f["lines"]) for n, f in bundle["files"].items()], FACTS)
    told = facts(spark, folder).persist()
    try:
        wrong = sorted(r.name for r in differences(told, recorded).collect()) + miscounted(told, manifest)
    except Exception as error:
        # the file system's own checksums may tell first
        if spoiled := re.search(r"ChecksumException: .*?([^/\s]+) at", str(error)):
            raise ValueError(f"modified or incomplete: {spoiled[1]}") from error
        raise
    finally:
        told.unpersist()
    if bundle["format_version"] != FORMAT_VERSION or wrong:
        raise ValueError(f"modified or incomplete: {wrong}")
    return manifest


class Staging:
    """A folder beside ``destination`` that becomes it when the block ends well, and goes when it doesn't; a destination that exists is refused."""

    def __init__(self, spark: SparkSession, destination: str):
        self.store, self.destination = Store(spark), str(destination).rstrip("/")
        parent, _, name = self.destination.rpartition("/")
        self.folder = f"{parent}/.{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        if self.store.exists(self.destination):
            raise FileExistsError(self.destination)
        system, where = self.store._at(self.folder)
        system.mkdirs(where)
        return self.folder

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.store.move(self.folder, self.destination)
        else:
            self.store.delete(self.folder)


def promote(spark: SparkSession, fetch: Callable[[str], None], folder: str, repository: str, revision: str) -> str:
    """A snapshot that ``fetch(folder)`` brings, verified and published; asking again for what is there changes nothing.

    What arrives waits in a folder named by its repository and revision, so an interrupted fetch goes on where it stopped; another
    snapshot that waits for the same place, or stands there, is refused.
    """
    if not re.fullmatch(r"[0-9a-f]{40}", revision):
        raise ValueError("a revision has 40 hexadecimal digits")
    store, folder = Store(spark), str(folder).rstrip("/")
    own = {"repo_id": repository, "revision": revision}
    parent, _, name = folder.rpartition("/")
    waiting = f".{name}.incoming-"
    incoming = waiting + hashlib.sha256(json.dumps(own).encode()).hexdigest()[:16]
    if store.exists(folder):
        if not store.exists(f"{folder}/snapshot.json") or store.read_json(f"{folder}/snapshot.json") != own:
            raise FileExistsError(folder)
        verify(spark, folder)
        return folder
    if others := [n for n in store.names(parent) if n.startswith(waiting) and n != incoming]:
        raise FileExistsError(f"{others} wait for {folder}")
    system, where = store._at(f"{parent}/{incoming}")
    system.mkdirs(where)
    fetch(f"{parent}/{incoming}")
    verify(spark, f"{parent}/{incoming}")
    store.write_json(f"{parent}/{incoming}/snapshot.json", own)
    store.move(f"{parent}/{incoming}", folder)
    return folder
