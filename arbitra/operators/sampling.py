"""Deterministic samples, prefixes and chunks: by hash or by a stable ordinal, never by arrival."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions.text import seeded_hash
from arbitra.sources.shared import materialise


def hash_sample(rows: DataFrame, groups: list[str], limit: Column | int, seed: int = 42, id_column: str = "id") -> DataFrame:
    """The ``limit`` rows of lowest seeded hash in each group, one for each id; adds ``prio`` and ``place``.

    Only groups and ids are ranked, and the rank filter becomes a group limit below the shuffle, so a group of any size sends at most ``limit`` keys from each task.
    Whole rows meet the picked keys once, by a broadcast where these are few.
    """
    keys = [*groups, id_column]
    ranked = rows.select(*keys).distinct().withColumn("prio", seeded_hash(seed, F.col(id_column)))
    order = Window.partitionBy(*groups).orderBy("prio", id_column)
    picked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    named = picked.select(*(F.col(k).alias(f"_{k}") for k in keys), "prio", "place")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"_{k}" for k in keys)).dropDuplicates(keys)


def stratified_sample(rows: DataFrame, per_source: int, seed: int = 42, id_column: str = "id") -> DataFrame:
    """``per_source`` rows of each source (0: all), in a global order by hash that mixes the sources; adds ``shuffle_key``."""
    picked = hash_sample(rows, ["source"], per_source, seed, id_column).drop("prio", "place") if per_source else rows
    return picked.withColumn("shuffle_key", seeded_hash(f"{seed}:order", F.col(id_column)))


def prefix(rows: DataFrame, groups: list[str], order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of each group in a stable order (None: all)."""
    if limit is None:
        return rows
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_place") <= limit).drop("_place")


def chunk(ordinal: Column, size: int) -> Column:
    """Chunk number of a row from its ordinal (from 0)."""
    return F.floor(ordinal / size).cast("long")


def ordinals(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of each row (from 0) in a global order: range-partitioned rows are numbered where they lie, after the rows of the partitions before.

    A row's number within its partition is what follows the partition's in ``monotonically_increasing_id``. What travels besides are the partitions' sizes.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialise(laid.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = sorted((r.part, r.n) for r in laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    if not before:
        return laid.drop("_mid").withColumn(name, F.lit(0).cast("long"))
    # one entry a partition, looked up by its number
    starts = F.array(*(F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1)))
    return laid.withColumn(name, F.get(starts, part.cast("int")) + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid")


def length_extremes(rows: DataFrame, count_column: str, length_column: str, order: list[str]) -> DataFrame:
    """For each candidate count the longest row, the first in order on ties."""
    best = Window.partitionBy(count_column).orderBy(F.col(length_column).desc(), *order)
    return rows.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def cycle_fill(rows: DataFrame, ordinal: str, capacity: int) -> DataFrame:
    """``capacity`` rows that go round and round ``rows`` (ordinals from 0): adds ``slot``."""
    n = rows.count()
    if not n:
        raise ValueError("nothing to cycle through")
    slots = rows.sparkSession.range(capacity).withColumnRenamed("id", "slot").withColumn("_at", F.col("slot") % n)
    return slots.join(rows, F.col("_at") == F.col(ordinal)).drop("_at")
