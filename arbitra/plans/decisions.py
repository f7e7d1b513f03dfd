"""Decision sets over the generic tables: the same kinds of rows that the sources would give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.probability import hash_logits, one_hot, soft_target, softmax
from arbitra.functions.text import content_key

LANGUAGES = ["de", "en", "es", "fr"]
BLANKS = " \t\n\r"
EVENT_TYPES_SQL = "(SELECT list_sort(list(DISTINCT event_type)) FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role() -> Column:
    """Two tenths test, three validation, the rest train; sources of even number have a native test split."""
    digit = F.col("doc_id") % 10
    return F.when(digit < 2, "test").when(digit < 5, "validation").otherwise("train")


def has_test() -> Column:
    return F.right("source", F.lit(1)).isin("0", "2", "4", "6", "8")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """noul: is a labelled document good?"""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("state"), F.lit("Is the text good?").alias("instructions"), F.array(F.lit("No"), F.lit("Yes")).alias("candidates"),
        one_hot(F.col("quality"), F.lit(2)).alias("target"), F.lit("noul").alias("kind"), "source", F.concat(F.lit("quality/"), "lang").alias("task"), "quality", "toxic",
    )


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """choice: which language?"""
    langs = F.array(*map(F.lit, LANGUAGES))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("state"), F.lit("Which language is this?").alias("instructions"), langs.alias("candidates"),
        one_hot(F.array_position(langs, F.col("lang")) - 1, F.lit(4)).alias("target"), F.lit("choice").alias("kind"), "source", F.concat(F.lit("language/"), "lang").alias("task"),
    )


def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: how urgent is an order? Priorities begin with their number."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("score").alias("kind"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("task"),
        one_hot(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(5)).alias("target"),
    )


def event_mix(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    """choice with soft targets: each user's shares of event types; null where uninformative."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array(*(F.count_if(F.col("event_type") == t).cast("double") for t in types)).alias("scores"))
    return counts.withColumn("target", soft_target(F.col("scores")))


def dialogues(spark: SparkSession, sf_dir: str, span: int = 32) -> DataFrame:
    """conv_id, n, state: a conversation's turns in order. Turns meet first in spans of turn numbers, so a long conversation never meets row by row."""
    turns = table(spark, sf_dir, "conversations")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    spans = turns.groupBy("conv_id", F.floor(F.col("turn") / span).alias("span")).agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("part"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("span", "part"))), lambda s: s["part"])
    return spans.groupBy("conv_id").agg(F.sum("n").alias("n"), F.array_join(whole, "\n").alias("state"))


def scored(rows: DataFrame, size: int, temperature: float = 1.0) -> DataFrame:
    """With stand-in logits and their probabilities."""
    return rows.withColumn("logits", hash_logits(F.col("id"), F.lit(size))).withColumn("probabilities", softmax(F.col("logits"), temperature))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their role and identities, the input of splitting and deduplication. Documents that begin with the same line are one group."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", F.concat(F.lit("t/"), "lang").alias("task"), "text", role().alias("role"), has_test().alias("has_test"), content_key(F.col("text")).alias("content_key"), content_key(F.split_part(F.ltrim("text", F.lit(BLANKS)), F.lit("\n"), F.lit(1))).alias("group_id"))


# --- the same sets in DuckDB SQL

NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def sql_key(text: str) -> str:
    return f"sha256({NORM.format(text)})"


def sql_logits(key: str, size: int) -> str:
    return f"list_transform(range(0, {size}), lambda i: ('0x' || substr(sha256('logit:' || {key} || ':' || i), 1, 8))::BIGINT::DOUBLE / 4294967296 * 8 - 4)"


def sql_softmax(logits: str, temperature: float = 1.0) -> str:
    e = f"list_transform({logits}, lambda x: exp((x - list_max({logits})) / {temperature}))"
    return f"list_transform({e}, lambda y: y / list_sum({e}))"


SPLIT = """CASE WHEN role <> 'validation' THEN role WHEN substr(sha256('42:' || group_id), 1, 1) < '8' THEN 'validation'
 WHEN has_test OR substr(sha256('42:' || group_id), 1, 1) < 'c' THEN 'calibration' ELSE 'test' END"""
SPLIT_ROWS = f"""
 s0 AS (SELECT doc_id, doc_id::VARCHAR AS id, source, 't/' || lang AS task, text,
  CASE WHEN doc_id % 10 < 2 THEN 'test' WHEN doc_id % 10 < 5 THEN 'validation' ELSE 'train' END AS role,
  right(source, 1) IN ('0', '2', '4', '6', '8') AS has_test, {sql_key("text")} AS content_key, {sql_key("split_part(ltrim(text, E' \\t\\n\\r'), chr(10), 1)")} AS group_id FROM documents),
 s AS (SELECT *, {SPLIT} AS split, sha256('42:' || id) AS prio FROM s0),
 r AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'calibration' THEN 2 ELSE 3 END AS rank FROM s)"""

LANGUAGE = f"""
 l0 AS (SELECT doc_id, 'l' || doc_id AS id, source, 'language/' || lang AS task, text, 'choice' AS kind,
  list_transform(['de', 'en', 'es', 'fr'], lambda c: (c = lang)::INT::DOUBLE) AS target FROM documents),
 l1 AS (SELECT *, {sql_logits("id", 4)} AS logits FROM l0),
 l AS (SELECT *, {sql_softmax("logits")} AS p FROM l1)"""
QUALITY = f"""
 q0 AS (SELECT doc_id, d.doc_id::VARCHAR AS id, source, 'quality/' || lang AS task, text, 'noul' AS kind, quality, toxic, [1.0 - quality, quality]::DOUBLE[] AS target FROM documents d JOIN labels USING (doc_id)),
 q1 AS (SELECT *, {sql_logits("id", 2)} AS logits FROM q0),
 q AS (SELECT *, {sql_softmax("logits")} AS p FROM q1)"""
PRIORITY = f"""
 o0 AS (SELECT o_orderkey, 'o' || o_orderkey AS id, 'score' AS kind, o_orderstatus AS source, o_orderpriority AS task,
  list_transform(range(0, 5), lambda i: (i = substr(o_orderpriority, 1, 1)::INT - 1)::INT::DOUBLE) AS target FROM orders),
 o1 AS (SELECT *, {sql_logits("id", 5)} AS logits FROM o0),
 o AS (SELECT *, {sql_softmax("logits")} AS p FROM o1)"""

#: One row's scores from p and target, and metrics over them.
EACH = """*, list_position(p, list_max(p)) AS top, list_max(p) AS conf, target[list_position(p, list_max(p))] AS gold,
 -list_sum(list_transform(range(1, len(p) + 1), lambda i: target[i] * ln(greatest(p[i], 1e-300)))) AS nll,
 list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - target[i]) * (p[i] - target[i]))) AS brier,
 CASE WHEN kind = 'score' THEN abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: (i - 1) * (p[i] - target[i])))) END AS ordinal,
 least(14, floor(list_max(p) * 15)::INT) AS bin"""


def sql_metrics(source: str, keys: list[str]) -> str:
    """Metrics of a CTE with p, target and kind by keys."""
    by = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {by}sum(n)::BIGINT AS count, round(sum(correct) / sum(n), 6) AS accuracy, round(sum(nll) / sum(n), 6) AS log_loss, round(sum(brier) / sum(n), 6) AS brier_score,
 round(sum(abs(conf - gold)) / sum(n), 6) AS ece_15, round(sum(ordinal) / nullif(sum(scores), 0), 6) AS ordinal_mae, sum(scores)::BIGINT AS ordinal_count
 FROM (SELECT {by}bin, count(*) AS n, sum((gold > 0)::INT) AS correct, sum(nll) AS nll, sum(brier) AS brier, sum(conf) AS conf, sum(gold) AS gold, sum(ordinal) AS ordinal, count(ordinal) AS scores
 FROM (SELECT {EACH} FROM {source}) GROUP BY {by}bin) {group}"""
