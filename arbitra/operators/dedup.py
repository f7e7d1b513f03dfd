"""Which rows of which split are kept: holdout reservation, partition conflicts, first-wins duplicates, task caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions.text import normalize
from arbitra.schema import SPLIT_PRIORITY
from arbitra.sources.shared import materialise

WRITTEN = "written"


def split_priority(split: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SPLIT_PRIORITY.items():
        out = F.when(split == name, rank).otherwise(out)
    return out


def group_owners(holdouts: DataFrame) -> DataFrame:
    """group_id, priority: the highest split that holds a group."""
    return holdouts.groupBy("group_id").agg(F.max(split_priority(F.col("split"))).alias("priority"))


def drop_holdout_overlap(train: DataFrame, holdouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) train rows: dropped where a holdout row has their group or their content.

    The keys that both sides have are found first, from the keys alone; whole rows only meet those.
    """
    shared = lambda key, mark: train.select(key).distinct().join(holdouts.select(key), key, "left_semi").withColumn(mark, F.lit(True))
    marked = train.join(shared("group_id", "_g"), "group_id", "left").join(shared("content_key", "_c"), "content_key", "left")
    hit = F.coalesce(F.col("_g"), F.lit(False)) | F.coalesce(F.col("_c"), F.lit(False))
    return marked.where(~hit).drop("_g", "_c"), marked.where(hit).drop("_g", "_c")


def group_conflicts(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds ``conflict``: whether a strictly higher split owns the row's group."""
    own = owners.select("group_id", F.col("priority").alias("_owner"))
    return rows.join(own, "group_id", "left").withColumn("conflict", F.coalesce(F.col("_owner") > split_priority(F.col("split")), F.lit(False))).drop("_owner")


def first_wins(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``disposition``: the first row of a content that fits is written; what follows it is a duplicate; overlength rows before it are overlength.

    ``rows`` has content_key and overlength, without conflicts; ``order`` tells all rows apart. The first is a minimum with partial
    aggregates, joined back: a content of any frequency is never sorted in one task.
    """
    place = F.struct(*order)
    firsts = rows.where("NOT overlength").groupBy("content_key").agg(F.min(place).alias("_first"))
    joined = rows.join(firsts, "content_key", "left")
    later = F.coalesce(place > F.col("_first"), F.lit(False))
    return joined.withColumn("disposition", F.when(later, "duplicate_content").when(F.col("overlength"), "overlength").otherwise(WRITTEN)).drop("_first")


#: Words of a passage by which documents are looked up.
ANCHOR = 5


def held_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id: which of ``docs(doc_id, text)`` hold the whole words of which of ``passages(item_id, passage)``, case and blanks aside.

    A passage's first ANCHOR words (all, if it has fewer) are looked up among all runs of as many words of the documents, then the whole passage
    is compared where they stand. Blank passages are held by none. Long runs of equal words are one candidate.
    """
    said = lambda c: F.trim(normalize(F.col(c)))
    wanted = passages.select("item_id", said("passage").alias("passage")).where("passage != ''").withColumn("_words", F.split("passage", " "))
    wanted = materialise(wanted.select("item_id", "passage", F.least(F.size("_words"), F.lit(ANCHOR)).alias("n"), F.array_join(F.slice("_words", 1, ANCHOR), " ").alias("anchor")))
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())
    texts = docs.select("doc_id", said("text").alias("_said")).withColumn("_words", F.split("_said", " "))
    runs = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - (n - 1)), lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    anchors = F.array_distinct(F.concat(*(runs(n) for n in sizes))) if sizes else F.array().cast("array<string>")
    met = texts.select("doc_id", F.explode(anchors).alias("anchor")).join(wanted.select("item_id", "anchor"), "anchor").select("doc_id", "item_id").distinct()
    whole = met.join(texts.select("doc_id", "_said"), "doc_id").join(wanted.select("item_id", "passage"), "item_id")
    inside = F.contains(F.concat(F.lit(" "), "_said", F.lit(" ")), F.concat(F.lit(" "), "passage", F.lit(" ")))
    return whole.where(inside).select("doc_id", "item_id").distinct()


def task_cap(rows: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """The first ``cap`` rows of each (source, task): exact where contents don't repeat."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy("source", "task").orderBy(*order)))
    return ranked.where(F.col("_place") <= cap).drop("_place")


def _cap_reached(rows: DataFrame, cap: int, name: str) -> DataFrame:
    """task, ``name``: where the ``cap``-th of ``rows(task, pos)`` of a task stands. The rank filter becomes a group limit below the shuffle."""
    ranked = rows.where("task is not null").withColumn("_n", F.row_number().over(Window.partitionBy("task").orderBy("pos")))
    return ranked.where((F.col("_n") <= cap) & (F.col("_n") == cap)).select(F.col("task").alias("_task"), F.col("pos").alias(name))


def _bounded(rows: DataFrame, written: DataFrame, cap: int) -> DataFrame:
    """``rows(content, task, pos)`` with ``first`` (of the written rows of its content) and ``full`` (the last that its task has room for), both places."""
    first = written.groupBy(F.col("content").alias("_content")).agg(F.min("pos").alias("first"))
    met = rows.join(first, F.col("content") == F.col("_content"), "left").drop("_content")
    return met.join(_cap_reached(written, cap, "full"), F.col("task") == F.col("_task"), "left").drop("_task")


def capped_first_wins(rows: DataFrame, cap: int) -> DataFrame:
    """row_key, disposition when only written rows count towards contents and caps, in the order of src_ord, prio, row_key.

    ``rows(row_key, content_key, source, task, src_ord, prio, aggregate, overlength)``; row_key tells rows apart. A row is written if no earlier row of its content is
    and, where its source is aggregate, fewer than ``cap`` earlier rows of its task are. So two bounds close in on what is written: rows that are written for sure, and those
    that may be. A row that may-be rows can't keep out is written; one that written rows keep out isn't. Each round takes the first
    written and the first possible row of every content, and the ``cap``-th of either kind of every task, all by aggregates;
    rows that depend on one another never meet in one task. The earliest open row has only decided rows before it, so every round
    decides some; mostly a few rounds decide all.
    """
    task = F.when(F.col("aggregate"), F.concat_ws("\x1f", F.coalesce("source", F.lit("")), F.coalesce("task", F.lit(""))))
    narrow = rows.select("row_key", F.coalesce("content_key", F.lit("")).alias("content"), task.alias("task"), F.struct("src_ord", "prio", "row_key").alias("pos"), "overlength")
    narrow = materialise(narrow)
    open_rows = narrow.where("NOT overlength").select("content", "task", "pos")
    written = None
    while True:
        known = open_rows.limit(0) if written is None else written
        possible = known.unionByName(open_rows)
        ahead = possible.groupBy(F.col("content").alias("_content")).agg(F.min("pos").alias("_ahead"))
        met = _bounded(open_rows, known, cap).join(ahead, F.col("content") == F.col("_content")).drop("_content")
        met = met.join(_cap_reached(possible, cap, "_room"), F.col("task") == F.col("_task"), "left").drop("_task")
        kept_out = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)) | F.coalesce(F.col("pos") > F.col("full"), F.lit(False))
        goes_in = (F.col("pos") == F.col("_ahead")) & F.coalesce(F.col("pos") <= F.col("_room"), F.lit(True))
        decided = materialise(met.select("content", "task", "pos", F.when(kept_out, False).when(goes_in, True).alias("in")))
        added = decided.where("in").drop("in")
        written = added if written is None else written.unionByName(added)
        open_rows = decided.where("in is null").drop("in")
        if open_rows.isEmpty():
            break
    final = _bounded(narrow, written, cap)
    fate = F.when(F.col("pos") > F.col("first"), "duplicate_content").when(F.col("pos") > F.col("full"), "task_cap").when(F.col("overlength"), "overlength").otherwise(WRITTEN)
    return final.select("row_key", fate.alias("disposition"))
