"""What filters of a corpus do alone, together and in every order, from counts by the set of filters that a document fails.

1. Every document becomes one narrow row: its part, the mask of filters that it fails and a hash of its text, which tells
   copies of smaller ids. Rows of equal masks are summed up before they are shuffled, so what is left of a part is one
   count for each mask, of documents and of good and toxic ones.
2. The subset-zeta transform turns a part's counts by mask into the survivors of every subset of the filters, one filter at a time.
3. A step of an order is the difference between neighbouring subsets: the filters before it, and those with its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, text_of, trimmed

#: What words are made of: anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"

#: By letter: whether a document fails, from its text and words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that copies of a smaller id's text fail.
COPIES = "E"


def failures(docs: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit i: fails the i-th filter) and key (a hash that equal texts share) of every row."""
    text, words = F.col("_text"), F.col("_words")
    # one column for the words, so that every filter reads the same split
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("_text"))
    split = split.withColumn("_words", F.array_remove(F.split(text, BLANKS), ""))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(text, words), 1 << i).otherwise(0)
    return split.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just the filters of ``mask``, whose bit above all ``filters`` is for copies.

    A document is a copy if a smaller doc_id has the same text anywhere in the table. Null ids aren't compared, and have no labels.
    A doc_id with several labels is good, or toxic, if one of them says so. Texts of any number of copies meet as one
    row for each part, mask and label, never one by one.
    """
    copy = 1 << len(filters)
    rows = failures(docs, filters, part).groupBy("doc_id", "part", "mask", "key").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(f"is_{name}")
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    of = lambda name: F.coalesce(f"is_{name}", F.lit(0)).alias(f"is_{name}")
    marked = rows.join(said, "doc_id", "left").select("doc_id", "part", "mask", "key", "n", of("quality"), of("toxic"))
    known = F.col("doc_id").isNotNull()
    groups = cut(marked.groupBy("key", "mask", "part", "is_quality", "is_toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
    ))
    # the first of a text over all parts; its rows alone aren't copies
    firsts = groups.groupBy("key").agg(F.min("first.doc_id").alias("least"))
    firsts = firsts.withColumnRenamed("key", "_key")
    met = groups.join(firsts, groups["key"] == firsts["_key"])
    copies = F.col("known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + copy).alias("mask"), copies.alias("n")))
    rows = met.select("part", "is_quality", "is_toxic", F.explode(both).alias("b")).where("b.n > 0")
    n = F.col("b.n")
    return rows.groupBy("part", F.col("b.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("is_quality")).alias("good"), F.sum(n * F.col("is_toxic")).alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """By subset of the filters (last axis): how many are left when those have been applied, from counts by the set that fails.

    The zeta transform sums over all sets within a set, one filter at a time; what survives a subset failed only filters outside it.
    """
    out = counts.copy()
    for bit in range(out.shape[-1].bit_length() - 1):
        pairs = out.reshape(*out.shape[:-1], -1, 2, 1 << bit)
        pairs[..., 1, :] += pairs[..., 0, :]
    return out[..., ::-1]


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """STEPS of every part of ``counts(part, mask, n, good, toxic)``: each order of ``letters`` and each of its steps, zeros included."""
    ready(counts.sparkSession)
    size, full = len(letters), (1 << len(letters)) - 1
    orders = list(itertools.permutations(range(size)))
    before = np.array([[sum(1 << f for f in order[:i]) for i in range(size)] for order in orders]).ravel()
    own = np.array(orders).ravel()
    after = before | 1 << own
    names = pa.array(np.repeat(["".join(letters[f] for f in order) for order in orders], size))
    steps = pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders)))
    subsets = np.arange(full + 1)
    held = np.array([x.bit_count() for x in range(full + 1)])
    weight = np.array([factorial(k) * factorial(size - 1 - k) for k in range(size)])

    def run(batches):
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = np.zeros((3, full + 1), np.int64)
                for cell in cells:
                    table[:, cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
                left = survivors(table)
                gone = left[:, before] - left[:, after]
                fails = np.array([left[0, 0] - left[0, 1 << f] for f in range(size)])
                alone = np.array([left[0, full ^ 1 << f] - left[0, full] for f in range(size)])
                shares = []
                for f in range(size):
                    others = subsets[subsets >> f & 1 == 0]
                    shares.append(int((weight[held[others]] * (left[0, others] - left[0, others | 1 << f])).sum()))
                columns = [left[0, after], gone[0], fails[own] - gone[0], alone[own], gone[1], gone[2], np.array(shares)[own]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.string()), names, steps, *(pa.array(c, pa.int64()) for c in columns)], names=[x.split()[0] for x in STEPS.split(", ")])

    # at most one cell for each mask
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(trimmed(run), STEPS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """STEPS of the filters A to E over whole ``docs(doc_id, text, lang, ...)`` and ``labels(doc_id, quality, toxic)``.

    Null text is empty text, null lang the part ''. Repeated rows each count; none is smaller than a row of its own doc_id. A null doc_id
    is no copy and makes none. No rows: no rows. Columns besides these are ignored, whatever their names.
    """
    return interactions(mask_counts(docs, labels), "".join(FILTERS) + COPIES)


ORACLE = r"""
WITH RECURSIVE l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
 s AS (SELECT o AS filter_order, i::INT AS step, ascii(substr(o, i::INT, 1)) - 64 AS f, left(o, i::INT - 1) AS before FROM p, (SELECT unnest(range(1, 6)) AS i) WHERE length(o) = 5),
 e AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS fails_it, len(list_filter(fails, lambda x: x)) AS many, len(list_filter(range(1, 6), lambda j: fails[j] AND contains(before, chr(64 + j::INT)))) > 0 AS gone FROM s, g),
 r AS (SELECT part, filter_order, step, f,
   coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_it), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_it), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE gone AND fails_it), 0)::BIGINT AS redundant,
   coalesce(sum(n) FILTER (WHERE fails_it AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND fails_it), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_it), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
