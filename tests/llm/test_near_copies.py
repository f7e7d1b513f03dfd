"""Near copies by five-word shingles at a similarity of 0.8 against brute force over all pairs."""

import itertools
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from arbitra.llm import simhash
from tests.conftest import MEDIUM


def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_copies_go_and_others_stay(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    texts = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(list)
    for doc_id, own in texts.items():
        for s in own:
            holders[s].append(doc_id)
    pairs = {(a, b) for ids in holders.values() if len(ids) < 200 for a in ids for b in ids if a < b}
    near = {(a, b) for a, b in pairs if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])}
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    gone = set(texts) - kept
    should = {b for _, b in near}
    assert len(gone & should) >= 0.9 * len(should)
    # a sketch of 256 hashes is within a few hundredths of the similarity
    close = {x for a, b in pairs if len(texts[a] & texts[b]) >= 0.72 * len(texts[a] | texts[b]) for x in (a, b)}
    assert gone <= close
    assert len(gone - {x for p in near for x in p}) <= 0.004 * len(texts)


def test_large_components_are_thinned(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 4)
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:60], f"new{i}", *base[61:]])) for i in range(30)] + [(100 + i, " ".join(f"other{i}x{j}" for j in range(50))) for i in range(5)] + [(200, " ".join(base))] * 2
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n_common=0)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100, 101, 102, 103, 104]


def test_long_texts_are_decided_by_all_their_shingles(spark):
    # one word said over and over gives all texts one fingerprint; of 1000 other words, 106 to 117 differ: similarity about 0.8
    said, rows = " zz" * 3000, []
    for k in range(24):
        base = [f"w{k}x{i}" for i in range(1000)]
        rows += [(10 * k, " ".join(base) + said), (10 * k + 1, " ".join([*(f"n{k}y{i}" for i in range(106 + k // 2)), *base[106 + k // 2 :]]) + said)]
    texts = {i: shingles(t) for i, t in rows}
    should = {b for a, b in ((10 * k, 10 * k + 1) for k in range(24)) if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])}
    assert 5 < len(should) < 20
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n_common=0).select("doc_id").collect()}
    assert set(texts) - kept == should


def test_large_groups_lose_only_what_is_alike(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 16)
    said = " ".join(f"said{i % 12}" for i in range(2000))
    # one repeated passage gives all texts one fingerprint, but their own words differ
    own = [(i, said + " " + " ".join(f"own{i}x{j}" for j in range(40))) for i in range(60)]
    # versions that drift: each is alike to the next only, and the smallest id is in the middle
    drift = [(1000 + (i + 20) % 40, said + " " + " ".join(f"step{j}" for j in range(12 * i, 12 * i + 200))) for i in range(40)]
    kept = simhash.keep_one(spark.createDataFrame(own + drift, "doc_id long, text string"), n_common=0)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 1000]


def test_copies_with_another_end_are_found(spark):
    # an added end of a tenth moves fingerprints by many bits, at a similarity of 0.91
    rows = []
    for k in range(100):
        base = [f"w{k}x{i}" for i in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base, *(f"end{k}y{i}" for i in range(20))]))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n_common=0)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [2 * k for k in range(100)]


def test_texts_that_share_an_id_stay_apart(spark):
    rows = [(1, "A a a"), (5, "A a a"), (5, "B b b"), (5, "B b b"), (7, "C c c"), (7, None), (8, ""), (None, "A a a"), (9, "B b b")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n_common=0)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "A a a"), (1, "A a a"), (5, "B b b"), (7, ""), (7, "C c c")]


def test_families_of_different_texts_stay_and_of_copies_go(spark):
    line = " ".join(f"repeated{i}" for i in range(30))
    family = lambda start, n: [(start + i, line + " " + " ".join(f"own{start + i}x{j}" for j in range(60))) for i in range(n)]
    copies = [(50_000 + i, " ".join([*(f"same{j}" for j in range(100)), f"but{i}"])) for i in range(5000)]
    rows = family(0, 200) + family(1000, 300) + family(10_000, 5000) + copies
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), n_common=0)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [*range(200), *range(1000, 1300), *range(10_000, 15_000), 50_000]


CLASHING = ["_gone", "_hash", "_again", "_own", "id", "hash", "row", "gone_id", "gone_hash", "own_id", "own_hash", "n", "key", "a", "b", "rep", "bands", "words", "size", "node", "root", "count", "a.b"]


def test_rows_of_any_names_stay_whole(spark, odd, empty):
    for docs in (odd, empty):
        wide = docs.select("*", *(F.monotonically_increasing_id().alias(c) for c in CLASHING))
        kept = simhash.keep_one(wide)
        assert kept.columns == wide.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())


def test_large_keys_are_split_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    # many codes share 40 bits, so they share keys; the others vary by up to five bits around some centres
    centres = rng.integers(0, 1 << 24, 12, np.uint64)
    codes = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 6), False))) | 5 << 50 for c in centres for _ in range(40)} | set(rng.integers(0, 1 << 63, 200, np.uint64).tolist())
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    for radius in (2, 3):
        whole = {(r.node, r.root) for r in simhash.connected(simhash.links(frame, radius)).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(simhash, "GROUP", 30)
            assert simhash._keyed(frame, radius, 6).where("key.again >= 0").count() > 0
            assert {(r.node, r.root) for r in simhash.connected(simhash.links(frame, radius)).collect()} == whole
        near = {(a, b) for a, b in itertools.combinations(sorted(codes), 2) if (a ^ b).bit_count() <= radius}
        root = {c: c for c in codes}
        for a, b in sorted(near) * 12:
            root[a] = root[b] = min(root[a], root[b])
        assert whole == {(c, r) for c, r in root.items() if c != r}
