"""Operators that follow a chain through a whole table, against plain loops."""

import hashlib
import os
import random
import resource
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbitra.operators import batching, dedup, requests, scoring
from arbitra.sources import files


def fold(lengths, pairs, tokens, most, multiple, fixed):
    """Batches of (places, width, padded count), one pair after the other."""
    out, own, width, padded = [], [], 0, 0
    for i, n in enumerate(lengths):
        w = min(most, -(-n // multiple) * multiple)
        count = len(own) + 1
        shape = min(pairs, 1 << (count - 1).bit_length()) if fixed else count
        if own and (count > pairs or tokens is not None and shape * max(width, w) > tokens):
            out.append((own, width, padded))
            own, width, shape = [], 0, 1
        own, width, padded = [*own, i], max(width, w), shape
    return out + [(own, width, padded)] if own else out


def by_hand(rows, pairs, tokens, most, multiple, by_length, fixed):
    groups = {}
    for k, i, n in rows:
        groups.setdefault(k, []).append((n, i) if by_length else (i, n))
    out = {}
    for k, own in groups.items():
        own = [(n, i) for n, i in sorted(own)] if by_length else [(n, i) for i, n in sorted(own)]
        for number, (places, width, padded) in enumerate(fold([n for n, _ in own], pairs, tokens, most, multiple, fixed)):
            for at, p in enumerate(places):
                out[k, own[p][1]] = (number, at, len(places), width, padded)
    return out


@pytest.mark.parametrize(("pairs", "tokens", "by_length", "fixed"), [(7, None, False, False), (5, 900, True, False), (8, 1500, False, True), (64, 4000, True, True), (1, 300, True, False)])
def test_batches_of_a_table_equal_the_fold(spark, pairs, tokens, by_length, fixed):
    rnd = random.Random(pairs)
    # one group over many ranges, one of one pair, one that ends inside a range
    rows = [(g, i, rnd.choice([3, 40, 170, 290])) for g, n in (("big", 700), ("one", 1), ("some", 90), (None, 40)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, length int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = batching.plan_rows(frame, ["g"], ["i"], pairs, tokens, 300, 16, by_length, fixed).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.g, r.i): (r.batch, r.place, r.pairs, r.width, r.padded) for r in got} == by_hand(rows, pairs, tokens, 300, 16, by_length, fixed)
    assert len(got) == len(rows)


def test_batches_of_few_pairs_over_many_ranges(spark):
    """Ranges of one or two pairs: batches go over several of them."""
    rows = [("g", i, 5 + i % 3) for i in range(60)]
    frame = spark.createDataFrame(rows, "g string, i int, length int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = batching.plan_rows(frame, ["g"], ["i"], 9, None, 300, 4, False).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r.g, r.i): (r.batch, r.place, r.pairs, r.width, r.padded) for r in got} == by_hand(rows, 9, None, 300, 4, False, False)
    assert batching.plan_rows(frame.limit(0), ["g"], ["i"], 9, None, 300).collect() == []
    with pytest.raises(Exception, match="cannot fit one padded"):
        batching.plan_rows(frame, ["g"], ["i"], 9, 6, 300).collect()


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 8), st.none() | st.integers(64, 200), st.booleans(), st.integers(0, 7))
@settings(max_examples=200, deadline=None)
def test_ways_out_are_those_of_the_chain(widths, pairs, tokens, fixed, after):
    own = max(1, len(widths) - min(after, pairs - 1))
    chain = batching.Jumps(np.array(widths, np.int64), own, pairs, tokens, fixed)
    for entry, (left, count, size, width) in enumerate(chain.out(pairs)):
        starts = chain.starts(entry).tolist()
        last = starts[-1]
        assert (count, size, width, left) == (len(starts), chain.size[last], chain.width[last], last + chain.size[last] - own)
    if own == len(widths):
        assert [b[0][0] for b in fold(widths, pairs, tokens, 10**6, 1, fixed)] == chain.starts(0).tolist()


@pytest.mark.parametrize(("seed", "contents", "cap"), [(0, 120, 3), (1, 30, 7), (2, 400, 12), (3, 5, 1)])
def test_capped_duplicates_equal_the_walk(spark, seed, contents, cap):
    rnd = random.Random(seed)
    rows = [(f"r{i}", f"c{rnd.randint(0, contents)}" if i % 50 else None, f"s{rnd.randint(0, 1)}", f"t{rnd.randint(0, 6)}" if i % 31 else None, rnd.randint(0, 1), f"{rnd.random():.6f}", rnd.random() < 0.8, rnd.random() < 0.2) for i in range(400)]
    seen, used, want = set(), Counter(), {}
    for key, content, source, task, _, _, capped, long in sorted(rows, key=lambda r: (r[4], r[5], r[0])):
        fate = "duplicate_content" if content in seen else "task_cap" if capped and used[source, task] >= cap else "overlength" if long else "written"
        if fate == "written":
            seen.add(content)
            used[source, task] += capped
        want[key] = fate
    frame = spark.createDataFrame(rows, "row_key string, content_key string, source string, task string, src_ord int, prio string, aggregate boolean, overlength boolean")
    assert {r.row_key: r.disposition for r in dedup.capped_first_wins(frame, cap).collect()} == want
    assert dedup.capped_first_wins(frame.limit(0), cap).collect() == []


def test_lines_keep_their_numbers_however_files_are_cut(spark, tmp_path):
    rnd = random.Random(4)
    texts = {"a.jsonl": ["x" * rnd.choice([0, 1, 5, 300]) + "é" for _ in range(200)], "b.jsonl": ["one"], "long.jsonl": ["y" * 5000, "", "z" * 4000, "end"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.jsonl" else ""))
    (tmp_path / "empty.jsonl").write_text("")
    for split in (1 << 20, 700, 64):
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.raw) for r in files.lines_of(spark, str(tmp_path), split).collect())
        assert got == sorted((name, i + 1, line) for name, lines in texts.items() for i, line in enumerate(lines))


@given(st.lists(st.sampled_from(["", "a", "bb", "c" * 40]), max_size=30), st.booleans(), st.integers(1, 60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_every_line_begins_in_one_range(lines, closed, split, block):
    with tempfile.NamedTemporaryFile("wb") as file, pytest.MonkeyPatch.context() as patch:
        patch.setattr(files, "BLOCK", block)
        data = ("\n".join(lines) + ("\n" if closed and lines else "")).encode()
        file.write(data)
        file.flush()
        found = [x for start in range(0, len(data), split) for x in files._lines(file.name, start, min(start + split, len(data)), data[:start].count(b"\n"))]
    plain = data.decode().split("\n")
    assert found == [(i + 1, line) for i, line in enumerate(plain) if i < len(plain) - 1 or line]


def test_checksums_of_whole_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 1000)
    data = {f"f{i}": os.urandom(i * 1500) + b"\n" * i for i in range(4)}
    for name, own in data.items():
        (tmp_path / name).write_bytes(own)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.bytes, r.lines) for r in files.file_info(spark, [str(tmp_path / name) for name in data]).collect()}
    assert got == {name: (hashlib.sha256(own).hexdigest(), len(own), own.count(b"\n")) for name, own in data.items()}
    assert {(r.sha256, r.bytes, r.lines) for r in files._values_info(spark, {str(tmp_path / name): len(own) for name, own in data.items()}).collect()} == set(got.values())
    assert files._reached(str(tmp_path)) and not files._reached("viewfs://store/x")
    assert sorted(r.path for r in files.file_info(spark, [str(tmp_path)]).collect()) == sorted(f"{tmp_path}/{name}" for name in data)


def test_a_file_beyond_one_value_is_read_in_blocks(tmp_path):
    """A sparse file of 3 GiB, with little memory."""
    path = tmp_path / "large"
    with open(path, "wb") as file:
        file.write(b"a\n")
        file.truncate(3 << 30)
        file.seek(0, os.SEEK_END)
        file.write(b"\n")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert files.stream_info(str(path))[1:] == ((3 << 30) + 1, 2)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def by_mask(ids, mask):
    """A score of a pair's own tokens alone, wherever it stands and however it is filled up."""
    assert ids.shape == mask.shape and (mask.sum(1) > 0).all()
    return (np.where(mask == 1, ids, 0) * (1 + np.arange(ids.shape[1]) % 5)).sum(1) / mask.sum(1)


def clock_of():
    """Seconds that a call takes: a quarter."""
    ticks = iter(range(10**9))
    return lambda: next(ticks) * 0.25


@pytest.mark.parametrize(("pairs", "tokens", "multiple", "fixed"), [(4, None, 1, False), (8, 200, 8, True), (3, 90, 4, False)])
def test_dense_batches_give_every_pair_its_own_score(spark, pairs, tokens, multiple, fixed):
    rnd = random.Random(pairs)
    rows = [(f"r{i}", [[rnd.randint(1, 99) for _ in range(rnd.randint(1, 20))] for _ in range(rnd.choice([2, 3, 5]))]) for i in range(60)] + [("none", [])]
    frame = spark.createDataFrame(rows, "id string, input_ids array<array<int>>").repartition(3)
    got = {r.id: r for r in scoring.score_dense(frame, lambda: by_mask, pairs, tokens, 64, multiple, fixed, clock=clock_of()).collect()}
    assert len(got) == len(rows) and got["none"].logits is None
    for key, own in rows[:-1]:
        alone = [float(by_mask(np.array([p]), np.ones((1, len(p)), int))[0]) for p in own]
        assert np.allclose(got[key].logits, alone) and 0 < got[key].seconds <= 0.25 * len(own)
    # each call took a quarter of a second, shared by its pairs
    calls = len({(r.batch) for r in batching.plan_rows(spark.createDataFrame([(i, c, len(p)) for i, (_, ps) in enumerate(rows) for c, p in enumerate(ps)], "i int, c int, length int"), [], ["i", "c"], pairs, tokens, 64, multiple, True, fixed).collect()})
    assert abs(sum(r.seconds for r in got.values() if r.seconds) - 0.25 * calls) < 1e-6


def test_filled_up_batches():
    ids, mask = scoring.dense_batch([[5, 6], [7]], 4, 4, pad_id=9)
    assert ids.tolist() == [[5, 6, 9, 9], [7, 9, 9, 9], [7, 9, 9, 9], [7, 9, 9, 9]] and mask.tolist() == [[1, 1, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]]


@pytest.mark.parametrize("bad", [{"pairs": 0}, {"pairs": True}, {"tokens": 0}, {"tokens": 1.5}, {"multiple": -1}])
def test_limits_of_batches_are_checked(bad):
    with pytest.raises(ValueError, match="positive whole number"):
        batching.check_plan(**({"pairs": 1, "tokens": None, "multiple": 1} | bad))


def most_bytes(spark):
    """The largest record batch of texts that a worker gets of 400 rows of 100 kB."""

    @F.arrow_udf("long")
    def held(text: pa.Array) -> pa.Array:
        return pa.array([text.nbytes] * len(text), pa.int64())

    return spark.range(0, 400, 1, 1).select(held(F.repeat(F.lit("x"), 100_000)).alias("n")).agg(F.max("n")).first()[0]


def test_encode_bounds_the_bytes_of_a_batch(spark):
    rows = spark.createDataFrame([("x y", "i", ["a", "b c"], [1.0, 0.0], "choice"), (None, "i", ["a"], [1.0], "choice"), ("z", "i", [], [], "choice")], "state string, instructions string, candidates array<string>, target array<double>, kind string")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = [r.input_ids for r in scoring.encode(rows).collect()]
    prompt = "Decision type: choice\nInstructions: i\nState:\nx y\nCriteria:\n0: a\n1: b c"
    assert got == [[scoring.whitespace_tokenizer(prompt, c) for c in ("a", "b c")], None, []]
    assert most_bytes(spark) < 10_000_000


def test_parsing_bounds_the_bytes_of_a_batch(spark):
    bodies = ['{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}', None, "{", '{"state": "x", "questions": {"q": {"type": "score", "instructions": 0, "criteria": ["a", 1]}}}']
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows, refused = requests.explode_requests(spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string"))
    assert sorted((r.request_id, r.q_ord, r.instructions, r.candidates) for r in rows.collect()) == [(0, 0, "?", ["No", "Yes"]), (3, 0, "0", ["a", "1"])]
    assert sorted((r.request_id, bool(r.error)) for r in refused.collect()) == [(1, True), (2, True)]
    assert most_bytes(spark) < 10_000_000


def test_a_task_parses_a_body_once(spark):
    """One Python node below each of the two tables: a task never runs two parsers at a time."""
    frame = spark.createDataFrame([(0, '{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}'), (1, "{")], "request_id int, body string")
    for table in requests.explode_requests(frame):
        table = table.select("request_id")
        assert table._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and table.count() == 1


@pytest.mark.parametrize("tokens", [None, 40, 500])
def test_pairs_longer_than_any_width_are_scored_whole(spark, tokens):
    """Beyond max_length, and beyond what a batch may hold: nothing is cut, nothing fails."""
    rows = [("long", [[7] * 90 + [1], [3] * 64]), ("short", [[2, 4], [9]]), ("longer", [[5] * 133, [6]]), ("null", None)]
    frame = spark.createDataFrame(rows, "id string, input_ids array<array<int>>")
    got = {r.id: r.logits for r in scoring.score_dense(frame, lambda: by_mask, 3, tokens, 64, 8).collect()}
    assert len(got) == len(rows) and got["null"] is None
    for key, own in rows[:-1]:
        assert np.allclose(got[key], [float(by_mask(np.array([p]), np.ones((1, len(p)), int))[0]) for p in own])


def test_dense_scores_of_long_documents_match_their_sql(spark, tmp_path):
    import duckdb

    from arbitra.plans import queries

    text = {1: "w " * 9000, 2: "", 3: "one two\nthree", 4: "x " * 70_000}
    spark.createDataFrame([(i, t, "en", "src1") for i, t in text.items()], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(tables.sql(queries.ORACLES["q_dense_scores"]).fetchall())
    assert sorted((r.doc_id, r.idx, r.value) for r in queries.q_dense_scores(spark, str(tmp_path)).collect()) == want
