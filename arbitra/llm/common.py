"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a record batch on its way to Python, which exists outside the JVM's heap on either side, and twice while it is handed over.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, keep record batches small, and make checkpoint() usable.

    A cluster names its shared folder in ``spark.checkpoint.dir``, or the caller by ``setCheckpointDir``; without either
    a temporary folder serves local sessions, and anything else is an error.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    path = context.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all its members share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="arbitra-checkpoint-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, which all executors share."""
    return ready(spark).sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so lost executors never recompute what lies before."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def trimmed(run):
    """``run`` for mapInArrow or mapInPandas, giving memory back to the system when a task ends: workers live on from stage to stage.

    Cycles are collected then, and not while the task goes through what it keeps again and again.
    """

    def whole(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


#: Ids up to which a join by id sends the ids to the rows (a hash table of some 32 MB) and not the rows to the ids.
SENT_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, condition, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined with ``ids``, a materialised table of one narrow column; few ids are broadcast, more are shuffled."""
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return rows.join(F.broadcast(ids) if few else ids, condition, how)


def text_of(column: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
