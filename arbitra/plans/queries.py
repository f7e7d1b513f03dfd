"""Registered queries of the decision engine, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbitra.functions import probability as P
from arbitra.functions import text as X
from arbitra.operators import adapters, batching, calibration, compare, dedup, metrics, requests, sampling, scoring, validate
from arbitra.plans import decisions as D
from arbitra.plans import prepare as prep
from arbitra.sources import files
from arbitra.sources.shared import Store, materialise, shared_folder
from arbitra.streaming import serve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles at six places: sums come in another order in every engine."""
    return frame.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))


def long_form(frame: DataFrame, keys: list[str], values: str) -> DataFrame:
    return frame.select(*keys, F.posexplode(values).alias("idx", "value")).withColumn("value", F.round("value", 6))


# --- identity, splits


@query(f"SELECT doc_id, {D.sql_key('text')} AS content_key FROM documents")
def q_normalize_content_key(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.content_key(F.col("text")).alias("content_key"))


@query(f"SELECT doc_id, {D.sql_key('text')} AS content_key FROM documents")
def q_normalize_exact(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.content_key(F.col("text"), exact=True).alias("content_key"))


@query(f"WITH {D.SPLIT_ROWS} SELECT doc_id, split FROM s")
def q_split_assign(spark, d):
    return D.split_rows(spark, d).select("doc_id", X.split_for(F.col("role"), F.col("group_id"), F.col("has_test")).alias("split"))


TASKS = ["glue/mnli", "anli/a1", "super_glue/boolq", "HELLASWAG", "tweet_eval/sentiment", "tweet_eval/emotion", "robust_nli_is_sd", "breaking_nli", "boolq_natural_perturbations/x", "yelp_review_full/yelp_review_full", "doc_nli", "bigbench/x", "mnli_like/other"]


def _strings(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'{}'".format(v.replace("'", "''")) for v in values) + "]"


def by_id(values: list, key: str = "doc_id"):
    """One of ``values`` for each row, in turn by its id."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


_NAME = "replace(lower(task), '_', '-')"


@query(f"""SELECT doc_id, task, len(list_intersect(string_split({_NAME}, '/'), {_strings(X.FAMILIES)})) > 0 OR {_NAME} = 'tweet-eval/sentiment' OR {" OR ".join(f"starts_with({_NAME}, '{p}')" for p in X.PREFIXES)} AS excluded
 FROM (SELECT doc_id, {_strings(TASKS)}[doc_id % {len(TASKS)} + 1] || CASE WHEN doc_id % 5 = 0 THEN '/' || lang ELSE '' END AS task FROM documents)""")
def q_excluded_task(spark, d):
    """Each document as a row of some task; every fifth of a task below it."""
    task = F.concat(by_id(TASKS), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/"), F.col("lang"))).otherwise(""))
    return D.table(spark, d, "documents").select("doc_id", task.alias("task")).withColumn("excluded", X.excluded_task(F.col("task")))


# --- targets


@query("SELECT doc_id, 1.0 - quality::DOUBLE AS p_no, quality::DOUBLE AS p_yes FROM documents JOIN labels USING (doc_id)")
def q_one_hot_noul(spark, d):
    return D.quality(spark, d).select("doc_id", F.get("target", F.lit(0)).alias("p_no"), F.get("target", F.lit(1)).alias("p_yes"))


@query("SELECT doc_id, i::INT AS idx, (['de','en','es','fr'][i + 1] = lang)::INT::DOUBLE AS value FROM documents, (SELECT unnest(range(0, 4)) AS i)")
def q_one_hot_choice(spark, d):
    return long_form(D.language(spark, d), ["doc_id"], "target")


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT - 1 AS gold, (substr(o_orderpriority, 1, 1)::INT - 1)::DOUBLE AS expected FROM orders")
def q_score_ordinal(spark, d):
    return D.priority(spark, d).select("o_orderkey", P.argmax(F.col("target")).alias("gold"), P.expectation(F.col("target")).alias("expected"))


def _event_types(spark, d) -> list[str]:
    return sorted(r[0] for r in D.table(spark, d, "events").select("event_type").distinct().collect())


@query("""WITH t AS (SELECT unnest(list_sort(list(DISTINCT event_type))) AS event_type FROM events), u AS (SELECT DISTINCT user_id FROM events),
 c AS (SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM u CROSS JOIN t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, min(n) OVER (PARTITION BY user_id) AS lo, max(n) OVER (PARTITION BY user_id) AS hi FROM c)
 SELECT user_id, event_type, round(n / total, 6) AS share FROM w WHERE hi > lo""")
def q_soft_targets(spark, d):
    types = _event_types(spark, d)
    mix = D.event_mix(spark, d, types).where("target is not null")
    return mix.select("user_id", F.posexplode("target").alias("i", "share")).select("user_id", F.get(F.array(*map(F.lit, types)), F.col("i")).alias("event_type"), F.round("share", 6).alias("share"))


# --- adapters, validation


def _nli_rows(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.col("text").alias("premise"), F.when(F.col("doc_id") % 7 == 0, " \t ").otherwise(F.col("lang")).alias("hypothesis"), (F.col("doc_id") % 4).cast("int").alias("label"))


@query("""SELECT skip_reason, count(*) AS n FROM (SELECT CASE WHEN trim(text, E' \t\n\r') = '' THEN 'blank_or_invalid_premise' WHEN doc_id % 7 = 0 THEN 'blank_or_invalid_hypothesis' WHEN doc_id % 4 = 3 THEN 'invalid_label' ELSE 'kept' END AS skip_reason FROM documents) GROUP BY ALL""")
def q_skip_reasons(spark, d):
    rows = adapters.adapt(_nli_rows(spark, d), "docs", "nli", "default", "train", 16, exact=False)
    return rows.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, sha256('Premise: ' || trim(text, E' \t\n\r') || chr(10) || 'Hypothesis: ' || lang) AS state_sha, {D.sql_key("trim(text, E' \t\n\r')")} AS group_id, (doc_id % 4)::INT AS gold
 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 4 <> 3 AND trim(text, E' \t\n\r') <> ''""")
def q_adapt_nli(spark, d):
    rows = adapters.adapt(_nli_rows(spark, d), "docs", "nli", "default", "train", 16, exact=False, keep=("doc_id",)).where("skip_reason is null")
    return rows.select("doc_id", X.digest(F.col("state")).alias("state_sha"), "group_id", P.argmax(F.col("target")).alias("gold"))


#: By doc_id: task, header and target of a row whose body is a document.
INSTRUCT_CASES = [
    ("yelp_review_full/yelp_review_full", 'With no explanation, label the following with either "3 stars", "2 star", "5 stars" or "1 star".', "3 stars."),
    ("tweet_eval/sentiment", 'With no explanation, label the following with either "negative", "positive".', "positive."),
    ("other/task", 'With no explanation, label the following with either "a", "b".', "a."),
    ("tweet_eval/sentiment", "Label this.", "positive."),
    ("tweet_eval/sentiment", 'With no explanation, label the following with either "negative", "positive".', "positive"),
    ("tweet_eval/sentiment", 'With no explanation, label the following with either "negative", "negative".', "negative."),
    ("tweet_eval/sentiment", 'With no explanation, label the following with either "negative", "neutral".', "positive."),
    ("tweet_eval/sentiment", None, "positive."),
]
_CASE = f"doc_id % {len(INSTRUCT_CASES)} + 1"


@query(f"""WITH a AS (SELECT doc_id, {_strings([c[0] for c in INSTRUCT_CASES])}[{_CASE}] AS task, coalesce({_strings([c[1] for c in INSTRUCT_CASES])}[{_CASE}] || chr(10) || rtrim(text, E' \t\n\r'), '') AS whole, {_strings([c[2] for c in INSTRUCT_CASES])}[{_CASE}] AS targets FROM documents),
 b AS (SELECT *, trim(whole, E' \t\n\r') AS inputs FROM a),
 c AS (SELECT *, split_part(inputs, chr(10), 1) AS header, CASE WHEN contains(inputs, chr(10)) THEN trim(substr(inputs, instr(inputs, chr(10)) + 1), E' \t\n\r') END AS body FROM b),
 e AS (SELECT *, regexp_extract_all(substr(header, 53), '"([^"\n]+)"', 1) AS options, CASE WHEN task LIKE 'yelp%' THEN ['1 star','2 star','3 stars','4 stars','5 stars'] ELSE ['negative','neutral','positive'] END AS scale, left(targets, length(targets) - 1) AS answer FROM c),
 f AS (SELECT *, CASE WHEN task NOT IN ('yelp_review_full/yelp_review_full', 'tweet_eval/sentiment') THEN 'outside_instruct_allowlist' WHEN inputs = '' THEN 'blank_or_invalid_inputs'
  WHEN body IS NULL OR NOT starts_with(header, 'With no explanation, label the following with either ') OR NOT ends_with(header, '.') THEN 'unsupported_instruct_format'
  WHEN NOT ends_with(targets, '.') THEN 'unsupported_instruct_target'
  WHEN len(options) < 2 OR len(list_distinct(options)) <> len(options) OR len(list_filter(options, lambda o: NOT list_contains(scale, o))) > 0 OR NOT list_contains(options, answer) THEN 'invalid_instruct_options' END AS skip_reason FROM e)
 SELECT doc_id, skip_reason, CASE WHEN skip_reason IS NULL THEN sha256(body) END AS state_sha, CASE WHEN skip_reason IS NULL THEN (list_position(scale, answer) - 1)::INT END AS gold FROM f""")
def q_instruct_parse(spark, d):
    whole = F.coalesce(F.concat(by_id([c[1] for c in INSTRUCT_CASES]), F.lit("\n"), F.col("text")), F.lit(""))
    raw = D.table(spark, d, "documents").select("doc_id", by_id([c[0] for c in INSTRUCT_CASES]).alias("task"), whole.alias("inputs"), by_id([c[2] for c in INSTRUCT_CASES]).alias("targets"))
    rows = adapters.adapt(raw, "instruct", "instruct", "default", "train", 16, keep=("doc_id",))
    kept = F.col("skip_reason").isNull()
    return rows.select("doc_id", "skip_reason", F.when(kept, X.digest(F.col("state"))).alias("state_sha"), F.when(kept, P.argmax(F.col("target"))).alias("gold"))


#: By doc_id: whether the state is the document, and the rest of a row.
VALIDATE_CASES = [
    (True, "i", ["a", "b"], [0.5, 0.5], "choice"), (False, "i", ["a", "b"], [0.5, 0.5], "choice"), (True, "", ["a", "b"], [0.5, 0.5], "choice"), (True, "i", ["a"], [1.0], "choice"),
    (True, "i", ["a", " "], [0.5, 0.5], "choice"), (True, "i", ["a", "a "], [0.5, 0.5], "choice"), (True, "i", ["a", "b"], [0.5, 0.5], "other"), (True, "i", ["a", "b", "c"], [0.5, 0.5, 0.0], "noul"),
    (True, "i", ["a", "b"], [1.0], "choice"), (True, "i", ["a", "b"], [-0.5, 1.5], "choice"), (True, "i", ["a", "b"], [0.2, 0.2], "choice"), (True, "i", ["a", "b"], [0.5, 0.5000005], None),
]


def _arr(values):
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in values) + "]"


@query("WITH v(k, whole, instructions, c, t, kind) AS (VALUES " + ", ".join(f"({k}, {str(r[0]).lower()}, '{r[1]}', {_arr(r[2])}, {_arr(r[3])}, {repr(r[4]) if r[4] else 'NULL'})" for k, r in enumerate(VALIDATE_CASES)) + f"""),
 r AS (SELECT doc_id, CASE WHEN whole THEN text ELSE '  ' END AS state, v.* FROM documents JOIN v ON doc_id % {len(VALIDATE_CASES)} = k)
 SELECT doc_id, CASE WHEN trim(state, E' \t\n\r') = '' THEN 'blank_state' WHEN trim(instructions) = '' THEN 'blank_instructions' WHEN NOT len(c) BETWEEN 2 AND 16 THEN 'candidate_count'
  WHEN len(list_filter(c, lambda x: trim(x) = '')) > 0 THEN 'blank_candidate' WHEN len(list_distinct(list_transform(c, lambda x: trim(x)))) <> len(c) THEN 'repeated_candidate'
  WHEN coalesce(kind, 'choice') NOT IN ('choice', 'noul', 'score') THEN 'unknown_kind' WHEN kind = 'noul' AND len(c) <> 2 THEN 'noul_candidates'
  WHEN len(t) <> len(c) THEN 'target_length' WHEN len(list_filter(t, lambda x: x < 0 OR NOT isfinite(x))) > 0 THEN 'target_value' WHEN abs(list_sum(t) - 1) > 1e-6 THEN 'target_sum' END AS invalid_reason FROM r""")
def q_validate_row(spark, d):
    cases = spark.createDataFrame([(k, *r) for k, r in enumerate(VALIDATE_CASES)], "k int, whole boolean, instructions string, candidates array<string>, target array<double>, kind string")
    docs = D.table(spark, d, "documents")
    rows = docs.join(cases, docs["doc_id"] % len(VALIDATE_CASES) == cases["k"]).withColumn("state", F.when(F.col("whole"), F.col("text")).otherwise("  "))
    return rows.select("doc_id", validate.invalid_reason().alias("invalid_reason"))


@query("SELECT doc_id, sha256('Decision type: choice' || chr(10) || 'Instructions: Which language is this?' || chr(10) || 'State:' || chr(10) || text || chr(10) || 'Criteria:' || chr(10) || '0: de' || chr(10) || '1: en' || chr(10) || '2: es' || chr(10) || '3: fr') AS prompt_sha FROM documents")
def q_prompt_render(spark, d):
    return D.language(spark, d).select("doc_id", X.digest(X.format_prompt(F.col("state"), F.col("instructions"), F.col("candidates"), F.col("kind"))).alias("prompt_sha"))


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, (10 + {_WORDS.format('text')} + 8 + 1 + 3)::INT AS longest, (10 + {_WORDS.format('text')} + 8 + 1 + 3) > 256 AS overlength FROM documents")
def q_encode_overlength(spark, d):
    rows = scoring.native_lengths(D.language(spark, d))
    return rows.select("doc_id", F.array_max("pair_lengths").alias("longest"), (F.array_max("pair_lengths") > 256).alias("overlength"))


@query(ORACLES["q_encode_overlength"])
def q_encode_tokenizer(spark, d):
    rows = scoring.encode(D.language(spark, d), 256)
    return rows.select("doc_id", F.array_max(F.transform("input_ids", F.size)).alias("longest"), "overlength")


def _mean_token(ids, mask):
    """A stand-in model of dense batches: the mean of a pair's own tokens."""
    return (ids * mask).sum(1) / mask.sum(1)


@query(f"SELECT doc_id, i::INT AS idx, round((1 + 3 * (10 + {_WORDS.format('text')} + 8) + 2 + 4 + 2) / (10 + {_WORDS.format('text')} + 8 + 1 + 3), 6) AS value FROM documents, (SELECT unnest(range(0, 4)) AS i)")
def q_dense_scores(spark, d):
    """All pairs of all documents through padded batches, put back by row and candidate."""
    rows = scoring.encode(D.language(spark, d), scoring.LONGEST).select("doc_id", "input_ids")
    return long_form(scoring.score_dense(rows, lambda: _mean_token, 32, 65536, scoring.LONGEST, 64), ["doc_id"], "logits")


# --- sampling


@query(f"WITH {D.SPLIT_ROWS} SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY prio, id)::INT AS place FROM (SELECT DISTINCT source, id, prio FROM s) QUALIFY row_number() OVER (PARTITION BY source ORDER BY prio, id) <= 7")
def q_hash_sample_topk(spark, d):
    return sampling.hash_sample(D.split_rows(spark, d), ["source"], 7).select("source", "id", "place")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def q_prefix_scan(spark, d):
    return sampling.prefix(D.table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("SELECT source, doc_id, sha256('42:order:' || doc_id) AS shuffle_key FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id::VARCHAR) <= 3")
def q_stratified_sample(spark, d):
    rows = D.table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("id"))
    return sampling.stratified_sample(rows, 3).select("source", "doc_id", "shuffle_key")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 5)::BIGINT AS chunk FROM documents")
def q_workload_chunks(spark, d):
    rows = sampling.ordinals(D.table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return rows.select("doc_id", sampling.chunk(F.col("ordinal"), 5).alias("chunk"))


@query(f"""WITH t AS (SELECT o_orderkey, 2 + o_orderkey % 4 AS n_candidates, length(o_orderpriority) + o_custkey % 13 AS longest FROM orders)
 SELECT n_candidates, o_orderkey, longest FROM t QUALIFY row_number() OVER (PARTITION BY n_candidates ORDER BY longest DESC, o_orderkey) = 1""")
def q_length_extremes(spark, d):
    rows = D.table(spark, d, "orders").select("o_orderkey", (2 + F.col("o_orderkey") % 4).alias("n_candidates"), (F.length("o_orderpriority") + F.col("o_custkey") % 13).alias("longest"))
    return sampling.length_extremes(rows, "n_candidates", "longest", ["o_orderkey"]).select("n_candidates", "o_orderkey", "longest")


@query("SELECT slot, r_regionkey FROM (SELECT unnest(range(0, 23)) AS slot) JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS place FROM region) ON slot % (SELECT count(*) FROM region) = place")
def q_cycle_fill(spark, d):
    rows = sampling.ordinals(D.table(spark, d, "region").select("r_regionkey"), ["r_regionkey"])
    return sampling.cycle_fill(rows, "ordinal", 23).select("slot", "r_regionkey")


# --- holdouts, duplicates, caps


def _split(spark, d):
    return D.split_rows(spark, d).withColumn("split", X.split_for(F.col("role"), F.col("group_id"), F.col("has_test"))).drop("text")


@query(f"WITH {D.SPLIT_ROWS} SELECT group_id, max(rank)::INT AS priority FROM r WHERE role <> 'train' GROUP BY group_id")
def q_holdout_groups(spark, d):
    return dedup.group_owners(_split(spark, d).where("role != 'train'"))


_OVERLAP = "role = 'train' AND (group_id IN (SELECT group_id FROM r WHERE role <> 'train') OR content_key IN (SELECT content_key FROM r WHERE role <> 'train'))"


@query(f"WITH {D.SPLIT_ROWS} SELECT source, doc_id FROM r WHERE {_OVERLAP}")
def q_holdout_overlap(spark, d):
    rows = _split(spark, d)
    return dedup.drop_holdout_overlap(rows.where("role = 'train'"), rows.where("role != 'train'"))[1].select("source", "doc_id")


_AS_WORDS = "' ' || " + D.NORM + " || ' '"


@query(f"""SELECT doc_id, item_id FROM documents JOIN (SELECT item_id, {_AS_WORDS.format('text')} AS said FROM benchmark WHERE trim(text, E' \t\n\r') <> '') b ON contains({_AS_WORDS.format('documents.text')}, said)""")
def q_benchmark_overlap(spark, d):
    """Documents that hold the whole words of a benchmark passage."""
    return dedup.held_passages(D.table(spark, d, "documents").select("doc_id", "text"), D.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))


@query(f"""WITH {D.SPLIT_ROWS}, g AS (SELECT group_id, max(rank) AS owner FROM r WHERE role <> 'train' GROUP BY ALL)
 SELECT doc_id, coalesce(owner > rank, false) AS conflict FROM r LEFT JOIN g USING (group_id) WHERE role <> 'train'""")
def q_group_conflict(spark, d):
    held = _split(spark, d).where("role != 'train'")
    return dedup.group_conflicts(held, dedup.group_owners(held)).select("doc_id", "conflict")


@query(f"""WITH {D.SPLIT_ROWS}, f AS (SELECT doc_id, length(text) > 3000 AS overlength, row_number() OVER w AS n, min(CASE WHEN length(text) <= 3000 THEN pos END) OVER (PARTITION BY content_key) AS first, pos
  FROM (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY rank DESC, prio, id) AS pos FROM r) WINDOW w AS (PARTITION BY content_key ORDER BY pos))
 SELECT doc_id, CASE WHEN pos > first THEN 'duplicate_content' WHEN overlength THEN 'overlength' ELSE 'written' END AS disposition FROM f""")
def q_dedup_first_wins(spark, d):
    rows = D.split_rows(spark, d).withColumn("split", X.split_for(F.col("role"), F.col("group_id"), F.col("has_test")))
    rows = rows.select("doc_id", "id", "content_key", (F.length("text") > 3000).alias("overlength"), X.seeded_hash(42, F.col("id")).alias("prio"), (-dedup.split_priority(F.col("split"))).alias("rank"))
    return dedup.first_wins(rows, ["rank", "prio", "id"]).select("doc_id", "disposition")


@query(f"WITH {D.SPLIT_ROWS} SELECT source, task, doc_id FROM r QUALIFY row_number() OVER (PARTITION BY source, task ORDER BY prio, id) <= 3")
def q_task_cap(spark, d):
    rows = _split(spark, d).withColumn("prio", X.seeded_hash(42, F.col("id")))
    return dedup.task_cap(rows, 3, ["prio", "id"]).select("source", "task", "doc_id")


# --- the whole preparation

#: The full profile: rows of a source and split, of a task of an aggregate source, and tokens.
MAX_TRAIN, MAX_EVAL, MAX_TASK, MAX_WORDS = 50_000, 2_000, 5_000, 1024


def _prepared(spark, d):
    rows = D.split_rows(spark, d)
    rows = rows.select(
        F.lit(None).cast("string").alias("skip_reason"), "id", F.col("text").alias("state"), F.lit("Which language is this?").alias("instructions"), F.array(*map(F.lit, D.LANGUAGES)).alias("candidates"),
        P.one_hot(F.array_position(F.array(*map(F.lit, D.LANGUAGES)), F.right("task", F.lit(2))) - 1, F.lit(4)).alias("target"), F.lit("choice").alias("kind"), "source", "task", F.col("role").alias("original_split"), "group_id",
        "role", "has_test", F.right("source", F.lit(1)).isin("1", "5").alias("aggregate"), F.expr("cast(substr(source, 4) as int)").alias("src_ord"),
    )
    settings = prep.Settings(max_train_per_source=MAX_TRAIN, max_eval_per_source=MAX_EVAL, max_train_per_task=MAX_TASK, max_length=MAX_WORDS, exact=False)
    return prep.prepare(rows, settings)


#: No task up to sf0.1 reaches its cap (q_capped_documents has caps that bind), so places by content decide. Where one does, as over 1 GB of different texts,
#: this SQL, which has no cap, isn't what the queries give (README, Open).
_PREPARED = f"""WITH {D.SPLIT_ROWS}, e AS (SELECT *, substr(source, 4)::INT AS src_ord, 10 + {_WORDS.format('text')} + 8 + 1 + 3 > {MAX_WORDS} AS overlength FROM r),
 pool AS (SELECT * FROM e WHERE NOT ({_OVERLAP})),
 sample AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY source, split ORDER BY prio, id) <= CASE WHEN split = 'train' THEN {MAX_TRAIN} ELSE {MAX_EVAL} END),
 g AS (SELECT group_id, max(rank) AS owner FROM e WHERE role <> 'train' GROUP BY ALL),
 c AS (SELECT sample.*, coalesce(owner > rank, false) AS conflict FROM sample LEFT JOIN g USING (group_id)),
 f AS (SELECT *, row_number() OVER (PARTITION BY conflict, content_key ORDER BY rank DESC, src_ord, prio, id) AS pos FROM c),
 h AS (SELECT *, min(CASE WHEN NOT overlength THEN pos END) OVER (PARTITION BY conflict, content_key) AS first FROM f),
 z AS (SELECT *, CASE WHEN conflict THEN 'group_partition_conflict' WHEN pos > first THEN 'duplicate_content' WHEN overlength THEN 'overlength' ELSE 'written' END AS disposition FROM h)"""


@query(f"{_PREPARED} SELECT id, source, split, disposition FROM z")
def q_prepare_pipeline(spark, d):
    return _prepared(spark, d).dispositions.select("id", "source", "split", "disposition")


@query(f"""{_PREPARED} SELECT * FROM (
 SELECT source, 'raw_scanned' AS disposition, count(*) AS n FROM e GROUP BY ALL
 UNION ALL SELECT source, 'dropped:holdout_overlap', count(*) FROM e WHERE {_OVERLAP} GROUP BY ALL
 UNION ALL SELECT source, 'eligible:' || split, count(*) FROM pool GROUP BY ALL
 UNION ALL SELECT source, 'sampled:' || split, count(*) FROM sample GROUP BY ALL
 UNION ALL SELECT p.source, 'dropped:sampling_or_repetition:' || p.split, p.n - s.n FROM (SELECT source, split, count(*) AS n FROM pool GROUP BY ALL) p JOIN (SELECT source, split, count(*) AS n FROM sample GROUP BY ALL) s USING (source, split) WHERE p.n > s.n
 UNION ALL SELECT source, CASE disposition WHEN 'written' THEN 'written:' || split WHEN 'overlength' THEN 'dropped:overlength:' || split ELSE 'dropped:' || disposition END, count(*) FROM z GROUP BY ALL)""")
def q_prepare_audit(spark, d):
    return _prepared(spark, d).audit.select("source", "disposition", "n")


@query(f"{_PREPARED} SELECT source, split, task, count(*) AS n FROM z WHERE disposition = 'written' GROUP BY ALL")
def q_retained_tasks(spark, d):
    return _prepared(spark, d).retained


@query(f"WITH {D.SPLIT_ROWS} SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM r WHERE split = 'calibration')")
def q_sources_without_split(spark, d):
    rows = _split(spark, d)
    return D.table(spark, d, "documents").select("source").distinct().join(rows.where("split = 'calibration'").select("source").distinct(), "source", "left_anti")


_CUSTOMER_ROWS = """SELECT c_custkey::VARCHAR AS row_key, c_nationkey || '/' || c_mktsegment || '/' || c_custkey % 7 AS content_key, 's' || c_nationkey % 3 AS source, c_mktsegment AS task, (c_nationkey % 2)::INT AS src_ord, sha256('42:' || c_custkey) AS prio, c_nationkey % 5 <> 0 AS aggregate, c_acctbal < 0 AS overlength FROM customer"""


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY src_ord, prio, row_key) AS i FROM ({_CUSTOMER_ROWS})),
 w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS used, '' AS row_key, '' AS disposition
  UNION ALL SELECT i, CASE WHEN d = 'written' THEN list_append(seen, content_key) ELSE seen END, CASE WHEN d = 'written' AND aggregate THEN list_append(used, source || task) ELSE used END, row_key, d
  FROM (SELECT o.*, w.seen, w.used, CASE WHEN list_contains(w.seen, content_key) THEN 'duplicate_content' WHEN aggregate AND len(list_filter(w.used, lambda t: t = source || task)) >= 20 THEN 'task_cap' WHEN overlength THEN 'overlength' ELSE 'written' END AS d
   FROM w JOIN o ON o.i = w.i + 1))
 SELECT row_key, disposition FROM w WHERE i > 0""")
def q_capped_first_wins(spark, d):
    """Customers that share contents and capped segments."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    rows = D.table(spark, d, "customer").select(
        key.cast("string").alias("row_key"), F.concat_ws("/", nation, "c_mktsegment", key % 7).alias("content_key"), F.concat(F.lit("s"), (nation % 3).cast("string")).alias("source"), F.col("c_mktsegment").alias("task"),
        (nation % 2).cast("int").alias("src_ord"), X.seeded_hash(42, key.cast("string")).alias("prio"), (nation % 5 != 0).alias("aggregate"), (F.col("c_acctbal") < 0).alias("overlength"),
    )
    return dedup.capped_first_wins(rows, 20)


#: A cap that binds on the smallest tables.
TASK_CAP = 5


@query(f"""WITH RECURSIVE {D.SPLIT_ROWS}, o AS MATERIALIZED (SELECT id AS row_key, content_key, source || chr(31) || task AS task, length(text) > 3000 AS overlength,
  row_number() OVER (ORDER BY substr(source, 4)::INT, prio, id) AS i FROM r),
 w AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS used, '' AS row_key, '' AS disposition
  UNION ALL SELECT i, CASE WHEN d = 'written' THEN list_append(seen, content_key) ELSE seen END, CASE WHEN d = 'written' THEN list_append(used, task) ELSE used END, row_key, d
  FROM (SELECT o.*, w.seen, w.used, CASE WHEN list_contains(w.seen, o.content_key) THEN 'duplicate_content' WHEN len(list_filter(w.used, lambda t: t = o.task)) >= {TASK_CAP} THEN 'task_cap' WHEN o.overlength THEN 'overlength' ELSE 'written' END AS d
   FROM w JOIN o ON o.i = w.i + 1))
 SELECT row_key, disposition FROM w WHERE i > 0""")
def q_capped_documents(spark, d):
    """Contents and caps that depend on one another, over all documents."""
    rows = D.split_rows(spark, d).select(F.col("id").alias("row_key"), "content_key", "source", "task", F.expr("cast(substr(source, 4) as int)").alias("src_ord"), X.seeded_hash(42, F.col("id")).alias("prio"), F.lit(True).alias("aggregate"), (F.length("text") > 3000).alias("overlength"))
    return dedup.capped_first_wins(rows, TASK_CAP)


# --- probabilities, answers


@query(f"WITH {D.LANGUAGE} SELECT doc_id, (i - 1)::INT AS idx, round(p[i], 6) AS value FROM l, (SELECT unnest(range(1, 5)) AS i)")
def q_softmax(spark, d):
    return long_form(D.scored(D.language(spark, d), 4), ["doc_id"], "probabilities")


@query(f"WITH {D.LANGUAGE} SELECT doc_id, (list_position(p, list_max(p)) - 1)::INT AS choice, round(greatest(0.0, least(1.0, (4 * list_max(p) - 1) / 3)), 6) AS confidence FROM l")
def q_argmax_confidence(spark, d):
    p = F.col("probabilities")
    return D.scored(D.language(spark, d), 4).select("doc_id", P.argmax(p).alias("choice"), F.round(P.confidence(p), 6).alias("confidence"))


@query(f"WITH {D.PRIORITY} SELECT o_orderkey, round(list_sum(list_transform(range(1, 6), lambda i: (i - 1) * p[i])), 6) AS score FROM o")
def q_expected_score(spark, d):
    return D.scored(D.priority(spark, d), 5).select("o_orderkey", F.round(P.expectation(F.col("probabilities")), 6).alias("score"))


@query(f"WITH {D.LANGUAGE} SELECT doc_id, 'choice' AS type, ['de','en','es','fr'][list_position(p, list_max(p))] AS choice, round(greatest(0.0, least(1.0, (4 * list_max(p) - 1) / 3)), 6) AS confidence, round(p[2], 6) AS p_en FROM l")
def q_answer(spark, d):
    rows = D.scored(D.language(spark, d), 4)
    a = requests.answer(F.col("kind"), F.col("candidates"), F.col("candidates"), F.col("probabilities"))
    return rows.withColumn("a", a).select("doc_id", "a.type", "a.choice", F.round("a.confidence", 6).alias("confidence"), F.round(F.element_at("a.probabilities", F.lit("en")), 6).alias("p_en"))


@query(f"WITH {D.LANGUAGE} SELECT doc_id, (i - 1)::INT AS idx, round(logits[i], 6) AS value FROM l, (SELECT unnest(range(1, 5)) AS i)")
def q_pairs_roundtrip(spark, d):
    rows = D.scored(D.language(spark, d), 4).select("doc_id", "candidates", "logits")
    pairs = batching.to_pairs(rows, "doc_id").select("doc_id", "candidate_index", F.get("logits", F.col("candidate_index")).alias("logit"))
    return long_form(batching.to_rows(pairs, "doc_id"), ["doc_id"], "logits")


@query("""SELECT 'l' || doc_id AS id, i::INT AS idx, CASE WHEN i < 4 THEN (['de','en','es','fr'][i + 1] = lang)::INT::DOUBLE ELSE 0.0 END AS value, i < 4 AS real FROM documents, (SELECT unnest(range(0, 5)) AS i)
 UNION ALL SELECT 'o' || o_orderkey, i::INT, (i = substr(o_orderpriority, 1, 1)::INT - 1)::INT::DOUBLE, true FROM orders, (SELECT unnest(range(0, 5)) AS i)""")
def q_pad_targets(spark, d):
    rows = D.language(spark, d).select("id", "target").unionByName(D.priority(spark, d).select("id", "target"))
    padded = rows.select("id", F.arrays_zip(P.pad(F.col("target"), F.lit(5)).alias("value"), P.pad_mask(F.col("target"), F.lit(5)).alias("real")).alias("z"))
    return padded.select("id", F.posexplode("z").alias("idx", "z")).select("id", "idx", "z.value", "z.real")


@query("""WITH t AS (SELECT unnest(list_sort(list(DISTINCT event_type))) AS event_type FROM events), u AS (SELECT DISTINCT user_id FROM events),
 c AS (SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM u CROSS JOIN t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL),
 w AS (SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 2) AS p FROM c),
 v AS (SELECT user_id, list(p ORDER BY event_type) AS v, list_sum(list(p ORDER BY event_type)) AS s FROM w GROUP BY user_id)
 SELECT user_id, CASE WHEN abs(s - 1) <= 0.002 THEN round(v[1] / s, 6) END AS first FROM v""")
def q_external_probabilities(spark, d):
    """Shares of event types rounded to two places, as another model might give them: many no longer sum to one."""
    mix = D.event_mix(spark, d, _event_types(spark, d))
    shares = F.transform("scores", lambda n: F.round(n / P.total(F.col("scores")), 2))
    return mix.select("user_id", F.round(F.get(requests.external_probabilities(shares), F.lit(0)), 6).alias("first"))


#: Numbers of centroids that are sent to every vector at a time.
CENTROIDS = 1 << 18


@query("""WITH m AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
 s AS (SELECT e.vec_id, m.label, sum(e.embedding[m.i]::DOUBLE * m.c) AS dot FROM embeddings e, m GROUP BY ALL)
 SELECT vec_id, arg_max(label, dot)::INT AS best, round(max(dot), 6) AS dot FROM s GROUP BY vec_id""")
def q_vector_choice(spark, d):
    """Every vector meets all label centroids, in blocks of a bounded size; each block leaves its best."""
    rows = D.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("c"))
    centroids = materialise(means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("c")))
    n, width = centroids.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("c")), F.lit(1))).first()
    blocks = -(-n * max(1, width) // CENTROIDS)
    found = None
    for block in range(max(1, blocks)):
        packed = centroids.where(F.pmod(F.xxhash64("label"), F.lit(max(1, blocks))) == block).agg(F.collect_list(F.struct("label", "c")).alias("all"))
        dots = F.transform("all", lambda x: F.struct(P.total(F.zip_with(F.col("v"), x["c"], lambda a, b: a * b)).alias("dot"), (-x["label"]).alias("minus")))
        own = rows.join(F.broadcast(packed)).select("vec_id", F.array_max(dots).alias("best"))
        found = own if found is None else found.unionByName(own)
    best = found.groupBy("vec_id").agg(F.max("best").alias("best")) if blocks > 1 else found
    return best.select("vec_id", (-F.col("best.minus")).cast("int").alias("best"), F.round("best.dot", 6).alias("dot"))


@query("""SELECT conv_id, count(*) AS n, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS state_sha FROM conversations GROUP BY conv_id""")
def q_dialogue_states(spark, d):
    return D.dialogues(spark, d).select("conv_id", "n", X.digest(F.col("state")).alias("state_sha"))


# --- metrics


@query(f"WITH {D.LANGUAGE} {D.sql_metrics('l', [])}")
def q_metrics_overall(spark, d):
    return rounded(metrics.metrics(D.scored(D.language(spark, d), 4)))


def _union_sql() -> str:
    return f"{D.LANGUAGE}, {D.QUALITY}, {D.PRIORITY}, u AS (SELECT source, kind, task, target, p FROM l UNION ALL SELECT source, kind, task, target, p FROM q UNION ALL SELECT source, kind, task, target, p FROM o)"


def _union(spark, d):
    columns = ["source", "kind", "task", "target", "probabilities"]
    parts = [D.scored(D.language(spark, d), 4), D.scored(D.quality(spark, d), 2), D.scored(D.priority(spark, d), 5)]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))


SETS = [[], ["source"], ["kind"], ["source", "task"]]
_REPORT = " UNION ALL ".join(f"SELECT '{'/'.join(s) or 'overall'}' AS report_key, {', '.join(c if c in s else 'NULL::VARCHAR AS ' + c for c in ('kind', 'source', 'task'))}, count, accuracy, log_loss, brier_score, ece_15, ordinal_mae, ordinal_count FROM ({D.sql_metrics('u', s)})" for s in SETS)


@query(f"WITH {_union_sql()} {_REPORT}")
def q_metrics_grouping_sets(spark, d):
    return rounded(metrics.report(_union(spark, d), SETS))


@query(f"WITH {D.LANGUAGE} SELECT source, ece_15 FROM ({D.sql_metrics('l', ['source'])})")
def q_ece15(spark, d):
    return rounded(metrics.metrics(D.scored(D.language(spark, d), 4), ["source"]).select("source", "ece_15"))


@query(f"WITH {D.PRIORITY} SELECT source, ordinal_mae, ordinal_count FROM ({D.sql_metrics('o', ['source'])})")
def q_ordinal_mae(spark, d):
    return rounded(metrics.metrics(D.scored(D.priority(spark, d), 5), ["source"]).select("source", "ordinal_mae", "ordinal_count"))


@query(f"WITH {D.LANGUAGE}, c AS (SELECT * FROM l WHERE length(text) <= 1500) SELECT 'all' AS part, count, accuracy, brier_score FROM ({D.sql_metrics('l', [])}) UNION ALL SELECT 'shared_untruncated', count, accuracy, brier_score FROM ({D.sql_metrics('c', [])})")
def q_summarize_subset(spark, d):
    rows = D.scored(D.language(spark, d), 4)
    all_rows = rows.withColumn("part", F.explode(F.when(F.length("state") <= 1500, F.array(F.lit("all"), F.lit("shared_untruncated"))).otherwise(F.array(F.lit("all")))))
    return rounded(metrics.metrics(all_rows, ["part"]).select("part", "count", "accuracy", "brier_score"))


# --- calibration

_LOSS = "ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / t)))) - list_sum(list_transform(range(1, 5), lambda i: target[i] * (logits[i] - list_max(logits)) / t))"


@query(f"WITH {D.LANGUAGE}, g AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS t) SELECT t AS temperature, round(avg({_LOSS}), 6) AS log_loss, count(*) AS count FROM l, g GROUP BY t")
def q_calibration_nll(spark, d):
    return rounded(calibration.log_losses(D.scored(D.language(spark, d), 4), [0.5, 1.0, 2.0]))


def _fitted(spark, d):
    """Logits that lean to the target, so that a finite temperature is best."""
    rows = D.scored(D.language(spark, d), 4)
    return rows.withColumn("logits", F.zip_with("logits", "target", lambda l, y: l + 3 * y))


@query()
def q_fit_temperature(spark, d):
    return spark.createDataFrame([(round(calibration.fit_temperature(_fitted(spark, d)), 4),)], "temperature double")


@query(f"WITH {D.LANGUAGE}, h AS (SELECT source, kind, target, {D.sql_softmax('logits', 2.5)} AS p FROM l) SELECT 'uncalibrated' AS stage, source, log_loss, ece_15 FROM ({D.sql_metrics('l', ['source'])}) UNION ALL SELECT 'calibrated', source, log_loss, ece_15 FROM ({D.sql_metrics('h', ['source'])})")
def q_metrics_calibrated_vs_raw(spark, d):
    rows = D.scored(D.language(spark, d), 4).withColumn("calibrated", P.softmax(F.col("logits"), 2.5))
    stages = F.explode(F.array(F.struct(F.lit("uncalibrated").alias("stage"), F.col("probabilities").alias("p")), F.struct(F.lit("calibrated").alias("stage"), F.col("calibrated").alias("p"))))
    both = rows.select("source", "kind", "target", stages.alias("s")).select("source", "kind", "target", "s.stage", F.col("s.p").alias("probabilities"))
    return rounded(metrics.metrics(both, ["stage", "source"]).select("stage", "source", "log_loss", "ece_15"))


@query(f"WITH {D.LANGUAGE}, h AS (SELECT kind, target, {D.sql_softmax('logits', 2.5)} AS p FROM l) SELECT round(b.log_loss - a.log_loss, 5) AS log_loss_delta, round(b.brier_score - a.brier_score, 5) AS brier_delta FROM ({D.sql_metrics('l', [])}) a, ({D.sql_metrics('h', [])}) b")
def q_calibration_delta(spark, d):
    rows = D.scored(D.language(spark, d), 4).withColumn("calibrated", P.softmax(F.col("logits"), 2.5))
    before = metrics.row_scores(rows)
    after = metrics.row_scores(rows.withColumn("probabilities", F.col("calibrated")))
    a = before.agg(F.avg("log_loss").alias("la"), F.avg("brier").alias("ba"))
    b = after.agg(F.avg("log_loss").alias("lb"), F.avg("brier").alias("bb"))
    return a.join(F.broadcast(b)).select(F.round(F.round("lb", 6) - F.round("la", 6), 5).alias("log_loss_delta"), F.round(F.round("bb", 6) - F.round("ba", 6), 5).alias("brier_delta"))


# --- comparison


@query(f"""WITH {D.LANGUAGE}, h AS (SELECT p AS a, {D.sql_softmax("list_transform(range(1, 5), lambda i: logits[i] + (i = doc_id % 4)::INT)")} AS b FROM l),
 e AS (SELECT a, b, list_transform(range(1, 5), lambda i: abs(a[i] - b[i])) AS d FROM h)
 SELECT round(max(list_max(d)), 6) AS max_abs, round(sum(list_sum(d)) / (4 * count(*)), 6) AS mean_abs, round(avg(list_sum(d) / 2), 6) AS mean_total_variation,
  sum((list_position(a, list_max(a)) <> list_position(b, list_max(b)))::INT)::BIGINT AS argmax_changes, round(avg((list_position(a, list_max(a)) <> list_position(b, list_max(b)))::INT), 6) AS argmax_change_rate FROM e""")
def q_probability_delta(spark, d):
    rows = D.scored(D.language(spark, d), 4)
    moved = F.transform("logits", lambda x, i: x + (i + 1 == F.col("doc_id") % 4).cast("int"))
    return rounded(metrics.probability_delta(rows.select(F.col("probabilities").alias("before"), P.softmax(moved).alias("after"))))


@query(f"""WITH {D.QUALITY}, c AS (SELECT (p[2] >= 0.5) = (quality = 1) AS a, (length(text) > 1000) = (quality = 1) AS b FROM q)
 SELECT count_if(a AND b)::BIGINT AS both, count_if(a AND NOT b)::BIGINT AS only_a, count_if(NOT a AND b)::BIGINT AS only_b, count_if(NOT a AND NOT b)::BIGINT AS neither FROM c""")
def q_paired_correctness(spark, d):
    left = D.scored(D.quality(spark, d), 2).select("doc_id", ((F.get("probabilities", F.lit(1)) >= 0.5) == (F.col("quality") == 1)).alias("correct_a"))
    right = D.quality(spark, d).select("doc_id", ((F.length("state") > 1000) == (F.col("quality") == 1)).alias("correct_b"))
    return metrics.paired_correctness(metrics.pair_strictly(left, right, "doc_id"))


def _binary(spark, d):
    rows = D.scored(D.quality(spark, d), 2)
    return rows.select(F.round(F.get("probabilities", F.lit(1)), 2).alias("score"), F.col("quality").alias("label"))


_BINARY = f"{D.QUALITY}, b AS (SELECT round(p[2], 2) AS score, quality AS label FROM q)"


@query(f"WITH {_BINARY}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM b), n AS (SELECT sum(label) AS pos, count(*) - sum(label) AS neg FROM b) SELECT round((sum(rk) FILTER (WHERE label = 1) - any_value(pos) * (any_value(pos) + 1) / 2.0) / (any_value(pos) * any_value(neg)), 6) AS auroc FROM r, n")
def q_auroc(spark, d):
    return rounded(metrics.auroc(_binary(spark, d)))


@query(f"""WITH {_BINARY}, c AS (SELECT count_if(score >= 0.5 AND label = 1)::BIGINT AS tp, count_if(score >= 0.5 AND label = 0)::BIGINT AS fp, count_if(score < 0.5 AND label = 1)::BIGINT AS fn, count_if(score < 0.5 AND label = 0)::BIGINT AS tn, avg((score - label) * (score - label)) AS brier FROM b)
 SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(brier, 6) AS brier FROM c""")
def q_confusion(spark, d):
    return rounded(metrics.confusion(_binary(spark, d)))


@query(f"""WITH {D.PRIORITY}, e AS (SELECT list_position(p, list_max(p)) AS top, list_position(target, 1.0) AS gold, list_max(p) AS conf, least(14, floor(list_max(p) * 15)::INT) AS bin,
  list_sum(list_transform(range(1, 6), lambda i: (i - 1) * p[i])) AS expected, list_sum(list_transform(range(1, 6), lambda i: abs(p[i] - target[i]))) / 2 AS tv FROM o),
 h AS (SELECT bin, count(*) AS n, sum((abs(top - gold) <= 1)::INT) AS w, sum(abs(expected - (gold - 1))) AS m, sum((top = gold)::INT) AS hit, sum(tv) AS tv, sum(conf) AS conf FROM e GROUP BY bin)
 SELECT round(sum(w) / sum(n), 6) AS within_one, round(sum(m) / sum(n), 6) AS numeric_mae, round(sum(hit) / sum(n), 6) AS soft_accuracy, round(sum(tv) / sum(n), 6) AS total_variation, round(sum(abs(conf - hit)) / sum(n), 6) AS hard_ece FROM h""")
def q_within_one(spark, d):
    return rounded(metrics.ordinal_report(D.scored(D.priority(spark, d), 5)))


@query("SELECT event_type, count(value) AS count, round(quantile_cont(value, 0.5) * 1000, 6) AS median_ms, round(quantile_disc(value, 0.95) * 1000, 6) AS p95_ms, round(count(value) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def q_latency_summary(spark, d):
    return rounded(metrics.latency_summary(D.table(spark, d, "events"), "value", ["event_type"]))


_CLIP = f"""SELECT doc_id, {_WORDS.format('text')} AS state, (doc_id % 200)::INT AS head, [(doc_id % 60)::INT, 3, (doc_id % 7)::INT, 50] AS options FROM documents"""


@query(f"""WITH t AS ({_CLIP}), a AS (SELECT *, list_transform(options, lambda n: 1 + least(48, n)) AS capped FROM t),
 b AS (SELECT *, CASE WHEN 192 - list_sum(capped) < 16 THEN list_transform(capped, lambda n: least(n, 44)) ELSE capped END AS kept FROM a),
 c AS (SELECT *, least(head, greatest(8, 192 - list_sum(kept))) AS kept_head FROM b)
 SELECT doc_id, head > kept_head OR len(list_filter(range(1, 5), lambda i: options[i] + 1 > kept[i])) > 0 OR state > greatest(0, 512 - kept_head - list_sum(kept) - 4) AS clipped FROM c""")
def q_clip_predicate(spark, d):
    i = F.col("doc_id")
    options = F.array((i % 60).cast("int"), F.lit(3), (i % 7).cast("int"), F.lit(50))
    return D.table(spark, d, "documents").select("doc_id", compare.clips((i % 200).cast("int"), options, scoring.word_count(F.col("text")), F.lit(False)).alias("clipped"))


def sql_batches(pairs: int, tokens: int | None, name: str = "") -> str:
    """CTEs: the batches (g, batch, start, pairs, width) of ``p(g, pos, w)``, pairs of group g at place pos with a padded width."""
    fits = f"(k + 1) * m > {tokens}" if tokens else "false"
    return f"""e{name} AS (SELECT a.g, a.pos, k, max(b.w) OVER (PARTITION BY a.g, a.pos ORDER BY k) AS m, b.pos IS NULL AS behind FROM p a CROSS JOIN (SELECT unnest(range(0, {pairs + 1})) AS k) LEFT JOIN p b ON b.g = a.g AND b.pos = a.pos + k),
 z{name} AS (SELECT g, pos, min(k) FILTER (WHERE behind OR k >= {pairs} OR {fits}) AS size FROM e{name} GROUP BY ALL),
 j{name} AS MATERIALIZED (SELECT z{name}.g, z{name}.pos, size, m FROM z{name} JOIN e{name} ON e{name}.g = z{name}.g AND e{name}.pos = z{name}.pos AND k = size - 1),
 c{name} AS (SELECT g, pos, 0 AS batch FROM p WHERE pos = 0 UNION ALL SELECT j{name}.g, c{name}.pos + size, batch + 1 FROM c{name} JOIN j{name} USING (g, pos) WHERE EXISTS (SELECT 1 FROM j{name} AS n WHERE n.g = c{name}.g AND n.pos = c{name}.pos + j{name}.size)),
 batches{name} AS (SELECT g, batch, pos, size AS pairs, m AS width FROM c{name} JOIN j{name} USING (g, pos))"""


def _pairs_sql(group: str) -> str:
    return f"p AS (SELECT {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY 10 + {_WORDS.format('text')} + 8 + 1 + 3, doc_id, c) - 1 AS pos, least(7999, ceil((10 + {_WORDS.format('text')} + 8 + 1 + 3) / 64) * 64)::BIGINT AS w FROM documents, (SELECT unnest(range(0, 4)) AS c))"


def _document_pairs(spark, d):
    return scoring.native_lengths(D.language(spark, d)).select("source", "doc_id", F.posexplode("pair_lengths").alias("c", "length"))


_SWEEPS = {"a": (8, None), "b": (8, 8192), "c": (16, 8192), "d": (32, 8192)}


@query(f"WITH RECURSIVE {_pairs_sql('0')}, " + ", ".join(sql_batches(n, t, k) for k, (n, t) in _SWEEPS.items()) + """,
 m AS (""" + " UNION ALL ".join(f"SELECT {n} AS pair_batch_size, {t or 'NULL::INT'} AS max_batch_tokens, count(*) AS batches, sum(pairs * width)::BIGINT AS padded_tokens FROM batches{k}" for k, (n, t) in _SWEEPS.items()) + """),
 g AS (SELECT 'baseline' AS name, 8 AS pair_batch_size, NULL::INT AS max_batch_tokens, 1 AS requests_per_batch UNION ALL
 SELECT 'pairs' || s || '-' || t || '-sdpa-requests' || r, s, 8192, r FROM (SELECT unnest([8, 16, 32]) AS s), (SELECT unnest(['float32', 'bfloat16']) AS t), (SELECT unnest([1, 4]) AS r))
 SELECT g.*, batches, padded_tokens FROM g JOIN m ON g.pair_batch_size = m.pair_batch_size AND g.max_batch_tokens IS NOT DISTINCT FROM m.max_batch_tokens""")
def q_sweep_grid(spark, d):
    """The settings of a sweep with the batches and padded tokens that each needs for all pairs of all documents."""
    grid = compare.sweep_grid(spark).select("name", "pair_batch_size", "max_batch_tokens", "requests_per_batch")
    pairs = materialise(_document_pairs(spark, d))
    return compare.planned_sweep(grid, lambda n, tokens: batching.plan_rows(pairs, [], ["doc_id", "c"], n, tokens, scoring.LONGEST, 64))


# --- requests, batches, files, streams

def _bodies(spark, d):
    """A request for each document; by its id, every other one is malformed in some way."""
    lit = F.lit
    questions = F.struct(
        F.struct(lit("choice").alias("type"), lit("Which team?").alias("instructions"), F.create_map(lit("tech"), lit("Broken features"), F.col("lang"), lit(None).cast("string")).alias("criteria")).alias("route"),
        F.struct(lit("noul").alias("type"), lit("A human?").alias("instructions")).alias("human"),
        F.struct(lit("score").alias("type"), lit("Rate.").alias("instructions"), F.array(lit("Calm"), F.col("source"), lit("Furious")).alias("criteria")).alias("mood"),
    )
    whole = F.to_json(F.struct(F.col("text").alias("state"), questions.alias("questions")), {"ignoreNullFields": "false"})
    asked = F.concat(lit('", "questions": {"q": {"type": "'), F.col("lang"), lit('", "instructions": "i"}}}'))
    bad = F.when(F.col("doc_id") % 10 == 1, F.concat(lit('{"state": "'), F.col("lang"), asked)).when(F.col("doc_id") % 10 == 3, F.concat(lit('{"state": NaN, "questions": '), F.to_json(questions), lit("}"))).when(F.col("doc_id") % 10 == 5, F.concat(lit('{"state": '), F.col("doc_id").cast("string"), lit(', "questions": {}}'))).when(F.col("doc_id") % 10 == 7, F.col("text")).otherwise(F.concat(F.substr(whole, lit(1), F.length(whole) - 1), lit(', "model": "m"}')))
    return D.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.when(F.col("doc_id") % 2 == 0, whole).otherwise(bad).alias("body"))


_GOOD = "doc_id % 2 = 0 AND trim(text, E' \t\n\r') <> ''"


@query(f"""SELECT doc_id AS request_id, q.question_id, q.q_ord, q.kind, q.keys, q.candidates, sha256(text) AS state_sha FROM documents, LATERAL (SELECT * FROM (VALUES ('route', 0, 'choice', 'tech|' || lang, 'tech: Broken features|' || lang), ('human', 1, 'noul', 'false|true', 'No|Yes'), ('mood', 2, 'score', '0|1|2', 'Calm|' || source || '|Furious')) AS v(question_id, q_ord, kind, keys, candidates)) AS q WHERE {_GOOD}""")
def q_question_explode(spark, d):
    rows, _ = requests.explode_requests(_bodies(spark, d))
    return rows.select("request_id", "question_id", "q_ord", "kind", F.array_join("keys", "|").alias("keys"), F.array_join("candidates", "|").alias("candidates"), X.digest(F.col("state")).alias("state_sha"))


@query(f"SELECT doc_id AS request_id, CASE WHEN {_GOOD} THEN 200 ELSE 422 END AS status FROM documents")
def q_decode_request(spark, d):
    return serve.respond(_bodies(spark, d)).select("request_id", "status")


_TURNS = f"p AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, least(64, ceil(({_WORDS.format('text')} + 1) / 8) * 8)::BIGINT AS w FROM conversations)"


@query(f"WITH RECURSIVE {_TURNS}, {sql_batches(3, 128)} SELECT g AS conv_id, batch, pairs::INT AS pairs, width::INT AS width FROM batches")
def q_batch_plan(spark, d):
    """The turns of every conversation in their order, under a token budget."""
    turns = D.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", (scoring.word_count(F.col("text")) + 1).alias("length"))
    return _batches(batching.plan_rows(turns, ["conv_id"], ["turn", "role", "text"], 3, 128, 64, 8, by_length=False), "conv_id")


def _batches(planned, group: str):
    return planned.where("place = 0").select(group, F.col("batch").cast("int").alias("batch"), "pairs", "width")


@query(f"WITH RECURSIVE {_pairs_sql('source')}, {sql_batches(32, 65536)} SELECT g AS source, batch, pairs::INT AS pairs, width::INT AS width FROM batches")
def q_batch_plan_documents(spark, d):
    """All pairs of all of a source's documents, planned by length under a token budget."""
    return _batches(batching.plan_rows(_document_pairs(spark, d), ["source"], ["doc_id", "c"], 32, 65536, scoring.LONGEST, 64), "source")


@query()
def q_row_ids(spark, d):
    rows = D.language(spark, d).select("doc_id", "state", "instructions", "candidates", "target", "kind", "source", "task")
    return rows.select("doc_id", X.row_id(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias("row_id"))


@query("SELECT doc_id, sha256(line) AS sha256, strlen(line)::BIGINT AS bytes FROM (SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' || chr(10) AS line FROM documents)")
def q_line_checksums(spark, d):
    """Checksums of rendered lines; whole files are hashed where they lie (sources.files.file_info)."""
    line = F.concat(F.to_json(F.struct("doc_id", "lang")), F.lit("\n"))
    return D.table(spark, d, "documents").select("doc_id", F.sha2(line, 256).alias("sha256"), F.octet_length(line).cast("long").alias("bytes"))


@query("SELECT source, count(*) AS lines, sum(strlen('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') + 1)::BIGINT AS bytes FROM documents GROUP BY source")
def q_bundle_sizes(spark, d):
    line = F.to_json(F.struct("doc_id", "lang"))
    return D.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(line) + 1).cast("long").alias("bytes"))


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'count' WHEN 2 THEN CASE WHEN {_WORDS.format('text')} % 5 > 2 THEN 'length' END WHEN 3 THEN CASE WHEN {_WORDS.format('text')} % 60 > 49 THEN 'token' END WHEN 4 THEN 'mask_length' WHEN 5 THEN 'mask' END AS reason FROM documents")
def q_collate_checks(spark, d):
    """Encoded rows whose ids, lengths and masks come from each document's words; by doc_id, some don't fit together."""
    n, case = scoring.word_count(F.col("text")), F.col("doc_id") % 6
    one = lambda k: F.array_repeat(F.lit(1), k)
    size = F.when(case == 2, n % 5 + 1).otherwise(2)
    ids = F.array(F.array_repeat(F.when(case == 3, n % 60).otherwise(n % 50), size), one(1))
    mask = F.when(case == 4, F.array(one(1), one(1))).when(case == 5, F.array(F.array_repeat(F.lit(0), size), one(1))).otherwise(F.array(one(size), one(1)))
    labels = F.when(case == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return D.table(spark, d, "documents").select("doc_id", ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels")).select("doc_id", scoring.bad_pair(3, 50).alias("reason"))


#: Lines of a written file.
FILE_LINES = 500


def _written_lines(spark, d, line):
    """The folder of a file for each FILE_LINES documents, whose lines are in the order of doc_id."""
    import uuid

    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = sampling.ordinals(D.table(spark, d, "documents").select("doc_id", line.alias("value")), ["doc_id"])
    rows = rows.select("value", "ordinal", sampling.chunk(F.col("ordinal"), FILE_LINES).alias("chunk"))
    rows.repartition("chunk").sortWithinPartitions("chunk", "ordinal").select("value", "chunk").write.partitionBy("chunk").text(folder)
    return folder


def _chunk_of(path: str):
    return F.regexp_extract(path, "chunk=([0-9]+)/", 1).cast("long").alias("chunk")


_LINES = f"(SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {FILE_LINES} AS chunk, doc_id, lang, text FROM documents)"


@query(f"""SELECT chunk::BIGINT AS chunk, sha256(string_agg(line, '' ORDER BY doc_id)) AS sha256, sum(strlen(line))::BIGINT AS bytes, count(*) AS lines
 FROM (SELECT chunk, doc_id, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '"}}' || chr(10) AS line FROM {_LINES}) GROUP BY chunk""")
def q_file_checksums(spark, d):
    """Whole files as they were written, read back in blocks."""
    folder = _written_lines(spark, d, F.to_json(F.struct("doc_id", "lang")))
    return files.file_info(spark, [folder]).select(_chunk_of("path"), "sha256", "bytes", "lines")


@query(f"SELECT chunk::BIGINT AS chunk, line, sha256(raw) AS raw_sha FROM (SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY doc_id) AS line, doc_id, lang || ' ' || doc_id AS raw FROM {_LINES}) WHERE doc_id % 7 = 3")
def q_bad_lines(spark, d):
    """Which lines of which files aren't JSON; ranges of 4 KiB, so files are cut within lines."""
    line = F.when(F.col("doc_id") % 7 == 3, F.concat_ws(" ", "lang", "doc_id")).when(F.col("doc_id") % 7 == 4, "").otherwise(F.to_json(F.struct("doc_id", "lang")))
    found = files.numbered_lines(spark, _written_lines(spark, d, line), T.StructType().add("doc_id", "long").add("lang", "string"), split=4096)
    return found.select(_chunk_of("file"), "line", F.sha2("raw", 256).alias("raw_sha"))


_STREAM = f"WITH e AS (SELECT event_id, 'e' || event_id AS id, {D.sql_logits('(' + chr(39) + 'e' + chr(39) + ' || event_id)', 3)} AS logits FROM events), p AS (SELECT event_id, {D.sql_softmax('logits')} AS p FROM e) SELECT event_id, (list_position(p, list_max(p)) - 1)::INT AS choice, round(list_max(p), 6) AS top FROM p"


@query(_STREAM)
def q_stream_microbatch_scores(spark, d):
    """The events table as a file stream through the same scoring plan as a batch, into a table that is read back."""
    import uuid

    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parent, name = d, "events.parquet"
    stream = spark.readStream.schema(T.StructType(schema.fields)).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(source if Store(spark).is_folder(source) else f"{parent}/{name[:-8]}*.parquet")
    scored = serve.score_stream(stream.select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("candidates")))
    out = scored.select("event_id", P.argmax(F.col("probabilities")).alias("choice"), F.round(F.array_max("probabilities"), 6).alias("top"))
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("event_id long, choice int, top double").parquet(f"{folder}/out")
