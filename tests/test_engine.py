"""Numeric fixtures, adapters, preparation invariants and files of the decision engine."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arbitra.functions import probability as P
from arbitra.functions import text as X
from arbitra.operators import adapters, batching, calibration, compare, dedup, metrics, requests, sampling, scoring
from arbitra.plans import prepare as prep
from arbitra.schema import DECISION
from arbitra.sources import bundles, files
from arbitra.streaming import serve


def one(spark, column, **values):
    names = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], names).select(column.alias("x")).first().x


# --- probabilities and metrics


def test_softmax(spark):
    assert one(spark, P.softmax(F.col("l")), l=([10000.0, 10000.0], "array<double>")) == [0.5, 0.5]
    for t in (0.0, -1.0, float("nan")):
        assert one(spark, P.softmax(F.col("l"), t), l=([1.0, 2.0], "array<double>")) is None
    assert one(spark, P.softmax(F.col("l")), l=([1.0, float("nan")], "array<double>")) is None


def test_metrics_fixture(spark):
    rows = spark.createDataFrame([([0.25, 0.75], [0.0, 1.0], "score")], "probabilities array<double>, target array<double>, kind string")
    m = metrics.metrics(rows).first()
    assert (m["count"], m.accuracy, m.brier_score, m.ordinal_mae, m.ece_15) == (1, 1.0, 0.125, 0.25, 0.25) and math.isclose(m.log_loss, -math.log(0.75))


def test_several_targets_count_as_correct(spark):
    rows = spark.createDataFrame([([0.1, 0.9], [0.0, 1.0], "choice"), ([0.9, 0.1], [0.5, 0.5], "choice")], "probabilities array<double>, target array<double>, kind string")
    m = metrics.metrics(rows).first()
    assert m.accuracy == 1.0 and m.ordinal_mae is None


def test_probability_delta_fixture(spark):
    rows = spark.createDataFrame([([0.1, 0.9], [0.2, 0.8]), ([0.7, 0.3], [0.4, 0.6])], "before array<double>, after array<double>")
    d = metrics.probability_delta(rows).first()
    assert [round(x, 9) for x in d] == [0.3, 0.2, 0.2, 1, 0.5]


def test_strict_pairing_refuses_gaps(spark):
    left, right = spark.range(3).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k")
    assert metrics.pair_strictly(left, left, "k").count() == 3
    with pytest.raises(Exception, match="one to one"):
        metrics.pair_strictly(left, right, "k").collect()


def test_temperature_improves_loss(spark):
    rows = spark.createDataFrame([([0.0, 8.0], [0.0, 1.0]), ([0.0, 8.0], [1.0, 0.0])], "logits array<double>, target array<double>")
    t = calibration.fit_temperature(rows)
    losses = {r.temperature: r.log_loss for r in calibration.log_losses(rows, [1.0, t]).collect()}
    assert t > 1 and losses[t] <= losses[1.0]
    with pytest.raises(Exception, match="normalised"):
        calibration.fit_temperature(spark.createDataFrame([([0.0, 8.0], [0.5, 1.0])], "logits array<double>, target array<double>"))
    with pytest.raises(ValueError, match="empty"):
        calibration.fit_temperature(rows.where("false"))


# --- batches


@pytest.mark.parametrize(
    ("lengths", "kwargs", "expected"),
    [
        ([29, 8, 17, 31, 9, 25, 6], {"pairs": 3, "tokens": None, "max_length": 32, "multiple": 8, "by_length": False}, [([0, 1, 2], 32, 3), ([3, 4, 5], 32, 3), ([6], 8, 1)]),
        ([5, 1, 3], {"pairs": 2, "tokens": None, "max_length": 8}, [([1, 2], 3, 2), ([0], 5, 1)]),
        ([4, 4, 4, 4, 4], {"pairs": 8, "tokens": 12, "max_length": 8}, [([0, 1, 2], 4, 3), ([3, 4], 4, 2)]),
        ([4, 4, 4], {"pairs": 8, "tokens": 16, "max_length": 8, "fixed_shapes": True}, [([0, 1, 2], 4, 4)]),
    ],
)
def test_batch_plan(spark, lengths, kwargs, expected):
    plan = one(spark, batching.plan_batches(F.col("l"), **kwargs), l=(lengths, "array<int>"))
    assert [(b.indices, b.width, b.padded) for b in plan] == expected


def test_batch_plan_that_cannot_fit(spark):
    with pytest.raises(Exception, match="cannot fit"):
        one(spark, batching.plan_batches(F.col("l"), 4, 5, 8), l=([6], "array<int>"))


def test_scores_come_back_in_order(spark):
    rows = spark.createDataFrame([(str(i), f"word {'x ' * (i % 5)}", "which?", [f"c{j}" for j in range(2 + i % 3)], None, "choice", "s", "t", "train", "g") for i in range(20)], DECISION)
    encoded = scoring.encode(rows)
    found = scoring.score(encoded, lambda: lambda batch: [[float(len(p)) for p in row] for row in batch]).select("id", "logits", "input_ids").collect()
    assert all(r.logits == [float(len(p)) for p in r.input_ids] for r in found) and len(found) == 20
    with pytest.raises(ValueError):
        scoring.encode(rows, 8000)


def test_native_lengths_equal_the_tokenizer(spark):
    rows = spark.createDataFrame([("1", " a\tb\n c ", "what is it?", ["x y", "z"], None, "choice", "s", "t", "train", "g")], DECISION)
    r = scoring.native_lengths(scoring.encode(rows)).first()
    assert [len(i) for i in r.input_ids] == r.pair_lengths and not r.overlength


# --- adapters


def adapted(spark, adapter, rows, schema, config="default"):
    return adapters.adapt(spark.createDataFrame(rows, schema), "src", adapter, config, "train", 16).collect()


def test_nli_labels(spark):
    for schema, label in (("premise string, hypothesis string, label int", 1), ("premise string, hypothesis string, label string", "neutral")):
        (r,) = adapted(spark, "nli", [("A child runs.", " A child sings. ", label)], schema)
        assert r.target == [0.0, 1.0, 0.0] and r.state == "Premise: A child runs.\nHypothesis: A child sings." and r.skip_reason is None
    (r,) = adapted(spark, "nli", [("p", "h", 3)], "premise string, hypothesis string, label int")
    assert r.skip_reason == "invalid_label"
    (r,) = adapted(spark, "nli", [("  ", "h", True)], "premise string, hypothesis string, label boolean")
    assert r.skip_reason == "blank_or_invalid_premise"
    with pytest.raises(Exception, match="hypothesis"):
        adapted(spark, "nli", [("p", 1)], "premise string, label int")
    with pytest.raises(ValueError, match="unknown adapter"):
        adapted(spark, "odd", [("p",)], "premise string")


def test_row_id_is_canonical_json(spark):
    import hashlib

    (r,) = adapted(spark, "nli", [("Straße", "ﬁ 😀", 0)], "premise string, hypothesis string, label int")
    row = {k: getattr(r, k) for k in adapters.FIELDS}
    assert r.id == hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert r.group_id == hashlib.sha256(b"strasse").hexdigest()


def test_other_adapters(spark):
    (r,) = adapted(spark, "zero_shot", [("p", "h", 1, "custom/sentiment")], "premise string, hypothesis string, labels int, task string")
    assert r.target == [0.0, 1.0, 0.0] and r.task == "custom/sentiment"
    (r,) = adapted(spark, "zero_shot", [("p", "h", 1, "glue/mnli")], "premise string, hypothesis string, labels int, task string")
    assert r.skip_reason == "overlapping_task_family"
    (r,) = adapted(spark, "doc_nli", [("p", "h", "not_entailment")], "premise string, hypothesis string, label string")
    assert r.target == [0.0, 1.0]
    a, b = adapted(spark, "defeasible", [("wet floor", "rained", "pipe burst", "weakener"), ("wet floor", "rained", "clouds", "strengthener")], "Premise string, Hypothesis string, Update string, UpdateType string")
    assert a.target == [0.0, 1.0] and a.group_id == b.group_id and a.state != b.state
    (r,) = adapted(spark, "defeasible", [("h", "u", "weakener")], "Hypothesis string, Update string, UpdateType string", "social")
    assert r.state == "Hypothesis: h\nUpdate: u"
    good, bad = adapted(spark, "boolq", [("p", "q", True), ("p", "q", None)], "passage string, question string, answer boolean")
    assert good.target == [0.0, 1.0] and good.kind == "noul" and bad.skip_reason == "invalid_boolq_answer"
    good, bad = adapted(spark, "hellaswag", [("c", ["a", "b", "c", "d"], "0", ""), ("c", ["a", "b", "c", "d"], "", "x")], "ctx string, endings array<string>, label string, source_id string")
    assert good.target == [1.0, 0.0, 0.0, 0.0] and bad.skip_reason == "unlabeled_or_invalid_hellaswag"
    schema = "inputs string, multiple_choice_targets array<string>, multiple_choice_scores array<double>"
    cases = [(["2", "3", "4"], [1.0, 0.0, 1.0], None), ([], [], "open_ended_bigbench"), (["a", "b"], [0.0, 0.0], "uninformative_bigbench_scores"), (["a", "b"], [1.0, 1.0], "uninformative_bigbench_scores"), (["a", "b"], [-1.0, 1.0], "invalid_bigbench_scores"), (["a", "b"], [float("nan"), 1.0], "invalid_bigbench_scores"), (["a", "b", "c"], [1.0, 0.0], "invalid_bigbench_scores"), (["a", "a "], [1.0, 0.0], "duplicate_candidates"), (["a", " "], [1.0, 0.0], "invalid_candidates")]
    found = adapted(spark, "bigbench", [("q", c, s) for c, s, _ in cases], schema)
    assert [r.skip_reason for r in found] == [r for _, _, r in cases] and found[0].target == [0.5, 0.0, 0.5]


# --- sampling and preparation


def test_hash_sample_ignores_order(spark):
    ids = [(f"id{i}", "s") for i in range(100)]
    picks = []
    for order in (ids, ids[::-1], random.Random(1).sample(ids, 100) + ids[:10]):
        frame = spark.createDataFrame(order, "id string, source string").repartition(7)
        picks.append(sorted(r.id for r in sampling.hash_sample(frame, ["source"], 7).collect()))
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 7


def reference_walk(rows, cap):
    seen, used, out = set(), {}, {}
    for key, content, source, task, src_ord, prio, aggregate, over in sorted(rows, key=lambda r: (r[4], r[5], r[0])):
        if content in seen:
            out[key] = "duplicate_content"
        elif aggregate and used.get((source, task), 0) >= cap:
            out[key] = "task_cap"
        elif over:
            out[key] = "overlength"
        else:
            seen.add(content)
            used[source, task] = used.get((source, task), 0) + 1
            out[key] = "written"
    return out


def test_caps_and_duplicates_together(spark):
    rng = random.Random(4)
    rows = [(f"k{i:03}", f"c{rng.randrange(60)}", f"s{i % 3}", f"t{rng.randrange(5)}", i % 3, f"{rng.random():.6f}", i % 3 < 2, rng.random() < 0.1) for i in range(200)]
    frame = spark.createDataFrame(rows, "row_key string, content_key string, source string, task string, src_ord int, prio string, aggregate boolean, overlength boolean")
    assert {r.row_key: r.disposition for r in dedup.capped_first_wins(frame, 4).collect()} == reference_walk(rows, 4)


SPECS = [
    {"dataset": "a/nli", "adapter": "nli", "configs": ["default"], "splits": {"train": "train", "dev": "validation"}},
    {"dataset": "b/boolq", "adapter": "boolq", "configs": ["default"], "splits": {"train": "train", "dev": "validation", "test": "test"}},
]


def loader(spark):
    def load(dataset, config, split):
        n = range(40)
        if dataset == "a/nli":
            return spark.createDataFrame([(i, f"premise {split} {i % 30}", f"hypothesis {split} {i}", i % 3) for i in n], "ord int, premise string, hypothesis string, label int")
        rows = [(i, f"passage {split} {i}", f"question {i}", i % 2 == 0) for i in n]
        rows[0] = (0, "passage dev 1", "question 1", True)
        return spark.createDataFrame(rows, "ord int, passage string, question string, answer boolean")

    return load


def test_prepare_writes_whole_data_sets(spark, tmp_path):
    config = {"max_train_per_source": 12, "max_train_per_task": 6, "max_eval_per_source": 8, "max_length": 200, "max_candidates": 4, "seed": 42, "scan_limit_per_split": 32, "model_name_or_path": "m", "model_revision": "r"}
    out = tmp_path / "data"
    manifest = prep.run(spark, SPECS, loader(spark), config, str(out), merged=True)
    assert manifest["status"] == "complete" and manifest["source_counts"]["b/boolq"]["dropped:holdout_overlap"] == 1
    rows = {s: [json.loads(x) for x in (out / f"{s}.jsonl").read_text().splitlines()] for s in manifest["counts"]}
    assert {s: len(r) for s, r in rows.items()} == manifest["counts"]
    every = [(s, r) for s, part in rows.items() for r in part]
    assert len({r["group_id"] for _, r in every}) == len({(s, r["group_id"]) for s, r in every})
    assert len({r["state"].casefold() for _, r in every}) == len(every) and all(r["target"] == r["labels"] for _, r in every)
    for part in rows.values():
        for source in {r["source"] for r in part}:
            assert len([r for r in part if r["source"] == source]) <= 12
    bundles.build(spark, out)
    assert bundles.verify(spark, out)["status"] == "complete"
    with pytest.raises(FileExistsError):
        prep.run(spark, SPECS, loader(spark), config, str(out))
    with (out / "test.jsonl").open("r+") as f:
        f.write("x")
    with pytest.raises(ValueError, match="modified.*test.jsonl"):
        bundles.verify(spark, out)
    parts = prep.run(spark, SPECS, loader(spark), config, str(tmp_path / "parts"))
    assert parts["counts"] == manifest["counts"] and len(bundles.build(spark, tmp_path / "parts")["files"]) > 4
    assert bundles.verify(spark, tmp_path / "parts")["status"] == "complete"
    assert spark.read.json(str(tmp_path / "parts/split=test")).count() == manifest["counts"]["test"]


def test_prepare_failure_is_recorded(spark, tmp_path):
    config = {"max_train_per_source": 5, "max_train_per_task": 5, "max_eval_per_source": 5, "max_length": 3, "max_candidates": 4}
    with pytest.raises(RuntimeError):
        prep.run(spark, SPECS, loader(spark), config, str(tmp_path / "d"))
    assert json.loads((tmp_path / "d/manifest.json").read_text())["status"] == "failed"
    with pytest.raises(ValueError):
        prep.Settings(max_length=True)


# --- files


def test_snapshot_promotion(spark, tmp_path):
    data = tmp_path / "made"
    data.mkdir()
    for s in ("train", "validation", "calibration", "test"):
        (data / f"{s}.jsonl").write_text('{"a": 1}\n')
    files.write_json(data / "manifest.json", {"status": "complete", "config": dict.fromkeys(bundles.MODEL_FIELDS, 1), "counts": dict.fromkeys(("train", "validation", "calibration", "test"), 1)})
    bundles.build(spark, data)
    import shutil

    calls = []

    def fetch(folder):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("interrupted")
        shutil.copytree(data, folder, dirs_exist_ok=True)

    root, revision = tmp_path / "got", "a" * 40
    with pytest.raises(OSError):
        bundles.promote(spark, fetch, root, "r", revision)
    assert not root.exists()
    with pytest.raises(FileExistsError):
        bundles.promote(spark, fetch, root, "other", revision)
    assert bundles.promote(spark, fetch, root, "r", revision) == str(root) == bundles.promote(spark, fetch, root, "r", revision)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        bundles.promote(spark, fetch, root, "r", "main")


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_rows(spark, str(path), schema).collect()
    rows = files.read_rows(spark, str(path), schema, strict=False).collect()
    assert sorted(r.a for r in rows if r.a) == [1, 2] and [r._corrupt_record for r in rows if r._corrupt_record] == ["not json"]


def test_staged_folder(spark, tmp_path):
    with bundles.Staging(spark, tmp_path / "x") as folder:
        Path(folder, "f").write_text("1")
        assert not (tmp_path / "x").exists()
    assert (tmp_path / "x/f").read_text() == "1"
    with pytest.raises(FileExistsError), bundles.Staging(spark, tmp_path / "x"):
        pass
    with pytest.raises(OSError), bundles.Staging(spark, tmp_path / "y") as folder:
        raise OSError
    assert not Path(folder).exists() and not (tmp_path / "y").exists()
    with pytest.raises(ValueError):
        files.write_json(tmp_path / "n.json", float("nan"))
    assert files.discover_configs(["b", "a"]) == ["a", "b"]
    with pytest.raises(ValueError):
        files.discover_configs(["a"], ["c"])


@pytest.mark.parametrize("change", ["status", "format_version", "config", "counts", "flag", "empty", "link"])
def test_rules_of_data_sets(spark, tmp_path, change):
    for s in ("train", "validation", "calibration", "test"):
        (tmp_path / f"{s}.jsonl").write_text('{"a": 1}\n')
    counts = dict.fromkeys(("train", "validation", "calibration", "test"), 1)
    manifest = {"status": "complete", "config": dict.fromkeys(bundles.MODEL_FIELDS, "é"), "counts": counts}
    files.write_json(tmp_path / "manifest.json", manifest)
    assert bundles.check(spark, tmp_path, manifest["config"]) == manifest
    bad = {"status": {"status": "failed"}, "format_version": {"format_version": 2}, "config": {"config": {"max_length": 1}}, "counts": {"counts": counts | {"test": 0}}, "flag": {"counts": counts | {"test": True}}}
    files.write_json(tmp_path / "manifest.json", manifest | bad.get(change, {}))
    if change in ("empty", "link"):
        (tmp_path / "test.jsonl").unlink()
    if change == "empty":
        (tmp_path / "test.jsonl").touch()
    if change == "link":
        (tmp_path / "test.jsonl").symlink_to(tmp_path / "train.jsonl")
    with pytest.raises(ValueError):
        bundles.check(spark, tmp_path)


def test_settings_must_match_and_lines_have_numbers(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nnot json\n{"a": NaN}\n')
    bad = files.numbered_lines(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.IntegerType())])).collect()
    assert [(r.line, r.raw) for r in bad] == [(4, "not json"), (5, '{"a": NaN}')] and bad[0].file.endswith("x.jsonl")


# --- requests and streams


def test_request_answers(spark):
    body = '{"state": {"b": 1, "a": "é"}, "questions": {"q": {"type": "choice", "instructions": "?", "criteria": {"x": null, "y": "why"}}, "n": {"type": "noul", "instructions": "?"}, "s": {"type": "score", "instructions": "?", "criteria": ["Calm", "Cross", "Furious"]}}}'
    rows, bad = requests.explode_requests(spark.createDataFrame([(1, body), (2, "{"), (3, None)], "request_id int, body string"))
    assert {r.request_id for r in bad.collect()} == {2, 3}
    uniform = P.softmax(F.array_repeat(F.lit(0.0), F.size("candidates")))
    got = {r.question_id: r.a for r in rows.withColumn("p", uniform).select("question_id", "state", requests.answer(F.col("kind"), F.col("candidates"), F.col("keys"), F.col("p")).alias("a")).collect()}
    assert got["q"].confidence == 0 and got["q"].choice == "x" and got["n"].noul == 0.5 and abs(got["s"].score - 1) < 1e-9 and got["s"].legend["2"] == "Furious"
    assert rows.first().state == '{"a": "é", "b": 1}'


@pytest.mark.parametrize(("instructions", "said"), [("0", "0"), ("[]", "[]"), ("{}", "{}"), ("false", "false"), ('" x "', " x "), ("null", None), ('" \\t"', None), ('""', None)])
def test_instructions_are_refused_only_if_null_or_blank(instructions, said):
    state, questions, error = requests.parse_request('{"state": [], "questions": {"q": {"type": "noul", "instructions": %s}}}' % instructions)
    assert (error is None, [q["instructions"] for q in questions]) == (said is not None, [said] if said is not None else [])


@pytest.mark.parametrize("question", ['{"type": "choice", "instructions": "i", "criteria": {" ": 1}}', '{"type": "choice", "instructions": "i", "criteria": ["a"]}', '{"type": "score", "instructions": "i", "criteria": {}}', '{"type": "noul", "instructions": "i", "criteria": {"true": 1}}', '{"type": ["noul"], "instructions": "i"}', "[]"])
def test_malformed_questions(question):
    assert requests.parse_request('{"state": "s", "questions": {"q": %s}}' % question)[2] and requests.parse_request('{"state": "s", "questions": {"": {"type": "noul", "instructions": "i"}}}')[2]


def test_stream_of_requests(spark, tmp_path):
    source = tmp_path / "in"
    body = '{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}'
    spark.createDataFrame([(i, body if i % 4 else "bad") for i in range(12)], "request_id int, body string").withColumn("arrived", F.current_timestamp()).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("request_id int, body string, arrived timestamp").parquet(str(source))
    got = []
    serve.serve(stream, lambda frame, n: got.extend(frame.collect()), str(tmp_path / "state"), capacity=10, timeout_ms=10_000_000).awaitTermination()
    status = {r.request_id: r.status for r in got}
    assert len(status) == 12 and sorted(status.values()).count(503) == 2 and [status[i] for i in (0, 4, 8)] == [422] * 3
    late = serve.admit(spark.createDataFrame([(1,)], "request_id int").withColumn("arrived", F.timestamp_millis(F.lit(0))), 5, 1000, F.current_timestamp()).first()
    assert (late.status, late.detail) == (503, serve.LATE)
    numbers = serve.batch_numbers(spark.range(5).withColumnRenamed("id", "request_id").withColumn("arrived", F.timestamp_millis(F.col("request_id"))), 2)
    assert [r.batch_no for r in numbers.orderBy("request_id").collect()] == [0, 0, 1, 1, 2]


def test_scorer_failure_costs_one_batch(spark):
    body = '{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}'
    batch = spark.createDataFrame([(i, body) for i in range(6)], "request_id int, body string").withColumn("arrived", F.timestamp_millis(F.col("request_id")))

    def scorer(rows):
        broken = F.when(F.col("request_id") == 3, F.raise_error(F.lit("out of memory")).cast("array<double>")).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
        return rows.withColumn("logits", broken)

    status = {r.request_id: r.status for r in serve.work_off(batch, 2, scorer).collect()}
    assert status == {0: 200, 1: 200, 2: 500, 3: 500, 4: 200, 5: 200}
    for bad in ({"capacity": 0}, {"most": True}, {"timeout_ms": float("nan")}):
        with pytest.raises(ValueError):
            serve.check_options(**({"capacity": 1, "timeout_ms": 1, "most": 1} | bad))


def test_latency_ranks(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.random(), 0.5, None])) for k in ["a"] * 41 + ["b"] * 20 + [None] * 3 + ["c"]]
    found = {r.k: r for r in metrics.latency_summary(spark.createDataFrame(rows, "k string, s double").repartition(5), "s", ["k"]).collect()}
    for key in {k for k, _ in rows}:
        own = sorted(s for k, s in rows if k == key and s is not None)
        assert found[key]["count"] == len(own)
        if own:
            middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
            assert abs(found[key].median_ms - 1000 * middle) < 1e-9 and found[key].p95_ms == 1000 * own[math.ceil(0.95 * len(own)) - 1]
    with pytest.raises(Exception, match="loss isn't finite"):
        metrics.require_finite(spark.createDataFrame([(1.0,), (float("nan"),)], "loss double"), "loss").collect()


def test_sweep_grid(spark):
    assert compare.sweep_grid(spark).count() == 13
    full = compare.sweep_grid(spark, compiled=True, flash=True)
    extras = full.where("name != 'baseline' AND (compile_model OR attn_implementation != 'sdpa')")
    assert extras.count() == 8 and extras.where("pair_batch_size != 32").count() == 0
    with pytest.raises(ValueError):
        compare.sweep_grid(spark, batch_sizes=())


def test_excluded_tasks(spark):
    names = ["glue/mnli", "tweet_eval/sentiment", "Robust_NLI_x", "tweet_eval/emotion"]
    assert [r.x for r in spark.createDataFrame([(n,) for n in names], "t string").select(X.excluded_task(F.col("t")).alias("x")).collect()] == [True, True, True, False]
