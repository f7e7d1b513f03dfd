"""Evaluation plans, the command line, the registry and the flagship query."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from arbitra import cli
from arbitra.functions.probability import softmax
from arbitra.plans import evaluate as ev
from arbitra.sources import files


def rows(n):
    out = []
    for i in range(n):
        kind, size = (("noul", 2), ("choice", 3), ("score", 5))[i % 3]
        out.append({"id": f"r{i}", "state": f"state {i}", "instructions": "?", "candidates": [f"c{j}" for j in range(size)], "target": [float(j == i % size) for j in range(size)], "kind": kind, "source": f"s{i % 2}", "task": "t", "original_split": "test", "group_id": f"g{i}", "input_ids": [[1, 2]] * size, "attention_mask": [[1, 1]] * size, "labels": [float(j == i % size) for j in range(size)]})
    return out


@pytest.fixture
def data(tmp_path):
    for name in ("calibration", "test"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows(30)))
    return tmp_path


def leaning(frame):
    return frame.withColumn("logits", F.transform("target", lambda y, i: 2 * y + i * 0.1))


def test_calibrate_and_evaluate(spark, data):
    with pytest.raises(ValueError):
        ev.calibrate(spark, str(data), str(data / "test.jsonl"))
    t = ev.calibrate(spark, str(data), str(data / "calibration.jsonl"), leaning)
    assert files.load_config(data / "model_config.json")["temperature"] == t < 1
    report = ev.evaluate(spark, str(data / "test.jsonl"), t, str(data / "report.json"), leaning)
    stages = report["stages"]
    assert set(stages["calibrated"]) == {"overall", "source/s0", "source/s1", "kind/choice", "kind/noul", "kind/score", "task/s0/t", "task/s1/t"}
    assert stages["calibrated"]["overall"]["log_loss"] <= stages["uncalibrated"]["overall"]["log_loss"] and stages["calibrated"]["overall"]["count"] == 30
    with pytest.raises(FileExistsError):
        ev.evaluate(spark, str(data / "test.jsonl"), t, str(data / "report.json"), leaning)


def test_compare(spark, data):
    report = ev.compare(spark, str(data / "test.jsonl"), {"a": leaning, "b": ev.hash_scored}, str(data / "out"), per_source=10, clipped=lambda f: f.withColumn("clipped", F.col("kind") == "score"))
    assert report["rows"] == 20 and report["models"]["a"]["overall"]["accuracy"] == 1.0
    paired = report["a:b"]["paired"]
    assert sum(paired.values()) == 20 and paired["only_b"] == paired["neither"] == 0
    assert report["models"]["a"]["shared_untruncated"]["count"] < 20
    logged = spark.read.json(str(data / "out/predictions-a"))
    assert logged.count() == 20 and {tuple(p.probabilities) for p in logged.limit(3).collect()}
    assert sorted(r["index"] for r in logged.collect()) == list(range(20)) and all(r.seconds > 0 for r in logged.collect())
    clipped = sum(report["altered"]["by_source"].values())
    assert report["altered"]["overall"] == clipped == 20 - report["models"]["a"]["shared_untruncated"]["count"]


def test_workload_keeps_order(spark, data):
    requests = {r.request: [x.id for x in r.decisions] for r in ev.workload(spark, str(data / "test.jsonl"), 4, 10).collect()}
    assert [x for k in sorted(requests) for x in requests[k]] == sorted(f"r{i}" for i in range(30))[:10] and [len(requests[k]) for k in sorted(requests)] == [4, 4, 2]


def test_more_verbs(spark, data, capsys):
    cli.main(["compare", "--data", str(data / "test.jsonl"), "--output", str(data / "cmp"), "--per-source", "5"])
    assert json.loads(capsys.readouterr().out)["rows"] == 10
    cli.main(["benchmark", "--data", str(data / "test.jsonl"), "--decisions-per-request", "4", "--repeats", "1"])
    assert json.loads(capsys.readouterr().out)["requests"] == 8
    (data / "in").mkdir()
    bodies = ['{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}', "bad"]
    (data / "in/a.json").write_text("".join(json.dumps({"request_id": str(i), "body": b}) + "\n" for i, b in enumerate(bodies)))
    cli.main(["serve", "--input", str(data / "in"), "--output", str(data / "answers"), "--checkpoint", str(data / "state")])
    assert json.loads(capsys.readouterr().out)["batches"] == 1
    assert sorted((r.request_id, r.status) for r in spark.read.json(str(data / "answers")).collect()) == [("0", 200), ("1", 422)]


def test_benchmark_clock():
    ticks = itertools.count()
    report = ev.benchmark(lambda: None, requests=3, decisions=6, warmups=1, repeats=2, clock=lambda: next(ticks))
    assert (report["median_ms"], report["p95_ms"], report["requests_per_second"]) == (1000, 1000, 3.0)
    with pytest.raises(ValueError):
        ev.benchmark(lambda: None, 1, 1, clock=lambda: 0)


def test_command_line(spark, tmp_path, capsys):
    request = tmp_path / "r.json"
    request.write_text('{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}')
    cli.main(["predict", "--input", str(request)])
    assert 0 <= json.loads(capsys.readouterr().out)["answers"]["q"]["noul"] <= 1
    request.write_text("{}")
    with pytest.raises(SystemExit):
        cli.main(["predict", "--input", str(request)])


def test_flagship_and_registry(spark):
    found = __spark_entry__.entry(spark)
    assert found.where("report_key = 'overall'").count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert spark.range(1).select(softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("p")).first().p == [0.5, 0.5]


@pytest.mark.parametrize("name", ["q_metrics_grouping_sets", "q_prepare_pipeline", "q_auroc", "q_stream_microbatch_scores", "q_clip_predicate"])
def test_queries_match_their_sql(spark, name):
    import math

    import duckdb

    folder = "/root/testdata/sf0.001"
    tables = duckdb.connect()
    for t in ("documents", "labels", "orders", "events"):
        tables.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = tables.sql(__spark_entry__.oracle_sql()[name])
    found = __spark_entry__.queries()[name](spark, folder)
    assert sorted(expected.columns) == sorted(found.columns)
    order = lambda r: repr([round(x, 4) if isinstance(x, float) else x for x in r])
    left, right = sorted(map(tuple, found.select(expected.columns).collect()), key=order), sorted(expected.fetchall(), key=order)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


def test_a_preparation_whose_cap_binds_is_the_plain_loop(spark, monkeypatch):
    """The SQL has no cap, so where one binds a loop over its sampled rows says what comes out."""
    from collections import Counter

    import duckdb

    from arbitra.plans import queries

    folder, cap = "/root/testdata/sf0.001", 1
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sampled = tables.sql(queries._PREPARED + " SELECT id, source, split, task, content_key, overlength, conflict FROM z ORDER BY rank DESC, src_ord, prio, id").fetchall()
    seen, used, want, kept = set(), Counter(), {}, Counter()
    for key, source, split, task, content, long, conflict in sampled:
        capped = split == "train" and source[-1] in "15"
        want[key] = "group_partition_conflict" if conflict else "duplicate_content" if content in seen else "task_cap" if capped and used[source, task] >= cap else "overlength" if long else "written"
        if want[key] == "written":
            seen.add(content)
            kept[source, split, task] += 1
            used[source, task] += capped
    monkeypatch.setattr(queries, "MAX_TASK", cap)
    prepared = queries._prepared(spark, folder)
    assert {r.id: r.disposition for r in prepared.dispositions.select("id", "disposition").collect()} == want and "task_cap" in want.values()
    assert {(r.source, r.split, r.task): r.n for r in prepared.retained.collect()} == kept
    assert sum(r.n for r in prepared.audit.where("disposition = 'dropped:task_cap'").collect()) == list(want.values()).count("task_cap")
