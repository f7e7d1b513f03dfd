"""Filter audit, token shards and the Merkle manifest."""

import bisect
import hashlib
import io
import itertools
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbitra.llm import audit, merkle, queries, wavelet
from tests.conftest import SMALL

# --- filter audit


def audit_by_hand(docs, labels):
    """STEPS, one document, order and step after the other."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    said = {}
    for r in labels:
        good, toxic = said.get(r.doc_id, (0, 0))
        said[r.doc_id] = (good or int(r.quality == 1), toxic or int(r.toxic == 1))
    rows = {}
    for r in docs:
        t = r.text or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > least[t]}
        rows.setdefault(r.lang or "", []).append(({f for f, x in fails.items() if x}, *(said.get(r.doc_id, (0, 0)) if r.doc_id is not None else (0, 0))))
    out, total = {}, {}
    for part, own in rows.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for i, f in enumerate(order):
                here = [r for r in own if not r[0] & set(order[:i])]
                gone = [r for r in here if f in r[0]]
                out[part, order, i + 1] = [len(here) - len(gone), len(gone), sum(f in r[0] for r in own) - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_steps(rows):
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}


def test_audit_of_a_whole_table(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    assert as_steps(queries.op11_filter_audit(spark, SMALL).collect()) == audit_by_hand(docs.collect(), labels.collect())


def test_audit_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, None), (None, 1, 1), (5, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert as_steps(audit.audit(odd, labels).collect()) == audit_by_hand(odd.collect(), labels.collect())
    assert audit.audit(empty, labels).collect() == [] and len(audit.audit(odd, labels.limit(0)).collect()) == 3 * 600


def test_audit_of_many_copies(spark):
    docs = spark.range(3000).selectExpr("id % 2900 as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id % 7, ' *')) as text", "if(id % 5 = 0, null, concat('l', id % 4)) as lang", "id as key", "id as mask", "id as n", "id as part")
    labels = spark.range(0, 3000, 3).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "1 as toxic")
    assert as_steps(audit.audit(docs, labels).collect()) == audit_by_hand(docs.collect(), labels.collect())


def test_survivors_are_counts_outside_the_subset():
    counts = np.random.default_rng(0).integers(0, 9, (2, 32))
    assert audit.survivors(counts).tolist() == [[sum(int(c) for mask, c in enumerate(row) if not mask & subset) for subset in range(32)] for row in counts]


# --- token shards


def plain_documents(docs):
    """DOCUMENTS by one tokenizer call after the other."""
    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    out, start = [], 0
    for r in sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_shards_of_a_whole_table(spark):
    got = queries.op12_token_shards(spark, SMALL).collect()
    assert sorted(map(tuple, got)) == plain_documents(spark.read.parquet(f"{SMALL}/documents.parquet").collect())


def test_shards_of_odd_rows(spark, odd, empty, tmp_path):
    manifest = wavelet.write_documents(odd, queries.vocabulary("byte_bpe_50k.json"), f"file:{tmp_path}/odd", shard_tokens=40)
    got = sorted(map(tuple, wavelet.read_documents(manifest, f"file:{tmp_path}/odd").collect()), key=lambda r: r[1])
    plain = plain_documents(odd.collect())
    # rows of one doc_id come in the order of a hash
    assert sorted((r[0] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in plain)
    assert [r[0] for r in got] == [r[0] for r in plain] and [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert manifest.count() >= 3 and not [p for p in (tmp_path / "odd").iterdir() if p.name.startswith(".") and p.name != ".crc"]
    none = wavelet.write_documents(empty, queries.vocabulary("byte_bpe_50k.json"), f"{tmp_path}/empty")
    assert none.collect() == [] == wavelet.read_documents(none, f"{tmp_path}/empty").collect() and wavelet.find_token(none, f"{tmp_path}/empty", 0).collect() == []


def test_tokens_are_counted_and_found(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = f"{tmp_path}/tokens"
    manifest = wavelet.write_documents(docs, queries.vocabulary("byte_bpe_50k.json"), folder, shard_tokens=5000)
    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids, begin, owner = [], [], []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        begin.append(len(ids))
        ids += [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        owner += [r.doc_id] * (len(ids) - begin[-1])
    counts = Counter(ids)
    wanted = [0, 11, 13, 262, counts.most_common()[-1][0], 50256, 70000, -1]
    assert {r.token: r.n for r in wavelet.count_tokens(manifest, folder, wanted).collect()} == {t: counts[t] for t in wanted}
    for token in (0, counts.most_common()[-1][0], 70000):
        places = [i for i, t in enumerate(ids) if t == token]
        assert sorted(map(tuple, wavelet.find_token(manifest, folder, token).collect()), key=lambda r: r[2]) == [(owner[i], i - begin[bisect.bisect(begin, i) - 1], i) for i in places]


@given(st.lists(st.integers(0, 9) | st.integers(0, 70_000), max_size=300), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix_against_a_list(ids, token):
    file = io.BytesIO()
    assert wavelet.write_shard(file, np.array(ids, np.uint32), [None, 4], [0, len(ids)]) == len(file.getvalue())
    shard = wavelet.Shard(file)
    places = [i for i, t in enumerate(ids) if t == token]
    assert shard.ids().tolist() == ids == [shard.access(i) for i in range(len(ids))]
    assert [shard.rank(token, i) for i in range(len(ids) + 1)] == [ids[:i].count(token) for i in range(len(ids) + 1)]
    assert shard.occurrences(token).tolist() == places == [shard.select(token, k) for k in range(shard.count(token))]
    for wrong in (lambda: shard.access(len(ids)), lambda: shard.access(-1), lambda: shard.select(token, len(places)), lambda: shard.select(token, -1)):
        with pytest.raises(IndexError):
            wrong()


def test_wavelet_blocks_and_broken_files():
    ids = np.random.default_rng(3).integers(0, 50_257, 200_000).astype(np.uint16)
    ids[::3] = 7
    file = io.BytesIO()
    wavelet.write_shard(file, ids, [1], [len(ids)])
    shard = wavelet.Shard(file)
    at = np.flatnonzero(ids == 7)
    assert (shard.ids() == ids).all() and (shard.occurrences(7) == at).all()
    for k in (0, 1, 21_845, 65_535, len(at) - 1):
        assert shard.select(7, k) == at[k] and shard.access(int(at[k])) == 7 and shard.rank(7, int(at[k])) == k
    for i in (0, 65_535, 65_536, 199_999):
        assert shard.access(i) == ids[i]
    for data in (b"", b"x" * 40, file.getvalue()[:-9], file.getvalue()[8:]):
        with pytest.raises(ValueError):
            wavelet.Shard(io.BytesIO(data))


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves, fanout=2):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, place, fanout=2):
    out = []
    for level in levels[:-1]:
        first = place // fanout * fanout
        run = level[first : first + fanout]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= fanout
    return out


def plain_proofs(docs, fanout=2):
    """PROOFS by the definition, whole trees at once."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, more=0: h(*map(said, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))
    parts = {}
    for r in docs:
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        parts.setdefault((r.lang is not None, (r.lang or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r), leaf_of(r, 1) if tampered else leaf_of(r)))
    trees = {p: plain_levels([r[2] for r in sorted(rows)], fanout) for p, rows in parts.items()}
    top = plain_levels([trees[p][-1][0] for p in sorted(trees)], fanout) if trees else []
    out = []
    for at, p in enumerate(sorted(trees)):
        for i, (known, doc_id, leaf, claimed) in enumerate(sorted(parts[p])):
            path = plain_path(trees[p], i, fanout) + plain_path(top, at, fanout)
            folded = claimed
            for before, after in path:
                folded = h(before, folded, after)
            out.append((doc_id if known else None, leaf, trees[p][-1][0], top[-1][0], h(*(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_manifest_of_a_whole_table(spark):
    got = queries.op13_merkle_manifest(spark, SMALL).collect()
    assert in_order(got) == in_order(plain_proofs(spark.read.parquet(f"{SMALL}/documents.parquet").collect()))
    assert 0 < sum(not r.verified for r in got) < len(got) / 3


def claimed(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.leaves_of(docs, queries.LEAF, claims=[F.when(tampered, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in queries.LEAF])


def test_manifest_of_odd_rows(spark, odd, empty):
    assert in_order(merkle.prove(claimed(odd)).collect()) == in_order(plain_proofs(odd.collect()))
    assert merkle.prove(claimed(empty)).collect() == []
    one = odd.where("doc_id = 3")
    assert in_order(merkle.prove(claimed(one)).collect()) == in_order(plain_proofs(one.collect()))


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_over_many_ranges(spark, fanout, monkeypatch):
    """Parts that begin and end within ranges, go over many, fill one; repeated rows; a part of one row; merging in several rounds."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    monkeypatch.setattr(merkle, "SPAN", 2)
    docs = spark.range(1500).selectExpr(
        "if(id % 11 = 0, null, id % 700) as doc_id", "concat('t', id % 5) as text", "case when id < 900 then 'en' when id = 900 then 'ü' when id < 1000 then null when id < 1100 then '' else concat('p', id % 150) end as lang", "'s' as source",
        "if(id % 3 = 0, null, id) as n_chars", "id as part", "id as range", "id as place", "id as at", "id as leaf",
    )
    assert in_order(merkle.prove(claimed(docs), fanout).collect()) == in_order(plain_proofs(docs.collect(), fanout))
    tree = merkle.Tree(claimed(docs), ["doc_id", "leaf"], fanout)
    found = {r.part: r for r in merkle.manifest(tree).collect()}
    rows = docs.collect()
    assert {p: r.leaves for p, r in found.items()} == Counter(r.lang for r in rows) and len({r.root for r in found.values()}) == 1
    assert {r.subroot for r in found.values()} == {r[2] for r in plain_proofs(rows, fanout)}
