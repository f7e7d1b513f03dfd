"""Quality, language model, URL filters, top-k, chat and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arbitra.llm import chat, lm, mtree, quality, queries, urlfilter
from tests.conftest import MEDIUM, SMALL
from tests.llm.conftest import ROWS

# --- quality


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_quality_on_held_out_documents(spark):
    found = {r.doc_id: r for r in queries.op2_quality_classifier(spark, MEDIUM).collect()}
    assert len(found) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in found.items())
    labels = [(found[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert auc(*zip(*labels, strict=True)) > 0.9


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, sizes, y = rng.standard_normal((9, quality.FEATURES)).astype(np.float32), np.array([2, 1, 4, 2]), np.array([1, 0, 1, 0], np.float32)
    weight = np.ones(4, np.float32)
    model = quality.GatedAttention.fit(x, sizes, y, weight)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    grads = model._gradients(x.astype(np.float64), sizes, y, weight)

    def loss():
        p = model.score(x.astype(np.float64), sizes)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name in ("W", "b", "V", "U", "a", "c", "c0"):
        at = tuple(0 for _ in model.w[name].shape)
        kept = model.w[name][at]
        model.w[name][at] = kept + 1e-5
        up = loss()
        model.w[name][at] = kept - 1e-5
        down = loss()
        model.w[name][at] = kept
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def test_quality_sample_is_bounded_by_rows(spark, monkeypatch):
    """One labelled id with any number of texts counts once; what is collected keeps the bound."""
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 60)
    docs = spark.range(3100).selectExpr("if(id < 3000, 1, id) as doc_id", "concat('text number ', id) as text")
    labels = spark.range(3100).selectExpr("if(id < 3000, 1, id) as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    seen = []
    fit = quality.GatedAttention.fit
    monkeypatch.setattr(quality.GatedAttention, "fit", classmethod(lambda cls, x, *rest: seen.append(len(x)) or fit(x, *rest)))
    quality.fit_model(docs, labels)
    assert 0 < seen[0] <= 60


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (7, 1, None), (8, None, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_model(odd, labels)
    rows = quality.score_documents(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score_documents(empty, model).count() == 0
    assert quality.fit_model(empty, labels) is None and quality.fit_model(odd, labels.where("false")) is None
    assert {r.score for r in quality.score_documents(odd, None).collect()} == {0.5}
    kept = quality.keep_good(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) and quality.keep_good(odd, model, 1.1).count() == 0
    assert sum(len(p) for p in quality.passages_of("é" * 3000)) == 6000 and quality.passages_of("") == [b""]


# --- language model


def test_probabilities_are_normalised():
    net = lm.WindowNetwork(seed=3)
    context = np.repeat(np.array([[5, 9, 300, 7]]), lm.CLASSES * lm.MEMBERS, axis=0)
    assert np.isclose(np.exp(net.log_probabilities(context, np.arange(len(context))).astype(float)).sum(), 1, atol=1e-4)


def test_windows_never_cross_documents():
    context, target, row = lm.windows([np.array([7, 8, 9]), np.array([], np.int64), np.array([4])])
    assert target.tolist() == [7, 8, 9, 4] and row.tolist() == [0, 0, 0, 2]
    assert context.tolist() == [[0, 0, 8, 9], [0, 7, 9, 0], [7, 8, 0, 0], [0, 0, 0, 0]]


def test_training_step_lowers_loss():
    rng = np.random.default_rng(1)
    target = rng.integers(200, 210, 4000)
    context = np.stack([target, target, (target + 1) % 1000, rng.integers(0, 900, 4000)], axis=1)
    net = lm.WindowNetwork()
    before = net.log_probabilities(context, target).mean()
    for _ in range(30):
        net.log_probabilities(context, target, lm.RATE)
    assert net.log_probabilities(context, target).mean() > before + 3


def plain_words(text):
    return (text or "").encode().lower().split()


def plain_scores(texts, weights, known=lm.KNOWN):
    """n_tokens and log-probability of each text, token by token, from counts of all of them."""
    counts = Counter(w for t in texts for w in plain_words(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    ids = {w: lm.HASHED + 1 + i if i < lm.VOCABULARY else 1 + zlib.crc32(w) % lm.HASHED for i, w in enumerate(ranked)}
    spelled, tokens = Counter(c for w, n in counts.items() for c in w * n), sum(counts.values())
    every = sum(spelled.values()) + tokens + 1
    spelling = lambda w: sum(math.log(max(spelled[c], 1) / every) for c in w) + math.log((tokens + 1) / every)
    net = lm.WindowNetwork(weights)

    def log_softmax(x):
        x = x.astype(np.float64)
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    for text in texts:
        words = plain_words(text)
        line = [0, 0, *(ids[w] for w in words), 0, 0]
        own, total = Counter(words), 0.0
        for i, w in enumerate(words):
            around = [line[i], line[i + 1], line[i + 3], line[i + 4]]
            h = np.tanh(net.b + sum(net.E[p][c] for p, c in enumerate(around)))
            group, member = ids[w] % lm.CLASSES, ids[w] // lm.CLASSES
            total += log_softmax(net.C @ h + net.cb)[group] + log_softmax(net.W[group] @ h + net.wb[group])[member]
            if ids[w] <= lm.HASHED:
                peers = [x for x in ranked if ids[x] == ids[w]]
                a = max(1, sum(counts[x] == 1 for x in peers))
                rest = sum(counts[x] - own[x] for x in peers)
                total += math.log((counts[w] - own[w] + a * math.exp(spelling(w))) / (rest + a))
        yield len(words), total


@pytest.mark.parametrize("known", [lm.KNOWN, 1200])
def test_scores_equal_the_plain_sum(spark, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = [t[:1500] for t in texts] + [None, "", texts[3][:1500], "new words here here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    weights = lm.train(docs, lm.Lexicon.of(lm.word_counts(docs)))
    found = {r.doc_id: r for r in lm.score_corpus(docs).collect()}
    for i, (n, total) in enumerate(plain_scores(texts, weights)):
        assert found[i].n_tokens == n and np.isclose(found[i].log_probability, total, rtol=1e-4, atol=1e-3)
        assert (found[i].per_token is None) == (n == 0)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_PER_COPY", 10_000)
    monkeypatch.setattr(lm, "FAN", 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, other = ({r.doc_id: r.log_probability for r in lm.score_corpus(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one.keys() == other.keys() and all(np.isclose(one[d], other[d], rtol=1e-5) for d in one)


def test_what_occurs_twice_scores_higher(spark):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    seen = Counter(r.text for r in rows)
    found = {r.doc_id: r.per_token for r in lm.score_corpus(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()}
    once, twice = ([found[r.doc_id] for r in rows if len(r.text.split()) >= 50 and (seen[r.text] > 1) == repeated] for repeated in (False, True))
    assert len(twice) > 10 and np.mean(np.array(twice) > np.quantile(once, 0.9)) > 0.5


def test_language_model_odd_rows(spark, odd, empty):
    found = lm.score_corpus(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    assert all((r.per_token is None) == (r.n_tokens == 0) and r.log_probability <= 0 for r in found)
    assert lm.score_corpus(empty).count() == 0


def test_word_counts_cover_everything(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = Counter(w for r in docs.collect() for w in plain_words(r.text))
    counts = lm.word_counts(docs)
    assert {bytes(r.word): r.n for r in lm._words(counts).collect()} == expected
    assert lm.vocabulary(docs, 50) == sorted(expected, key=lambda w: (-expected[w], w))[:50]
    known = lm.known_words(counts, 3000)
    assert 1500 < len(known) <= 3000 and known == [(w, expected[w]) for w in sorted(expected, key=lambda w: (-expected[w], w))[: len(known)]]


# --- URL filters


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


URLS = ["http://A.example.COM/en/1", "https://www.example.com/en/x?q=/es/", "http://x.net/es/", "http://x.net/es", "http://net/fr/a#b", "http://xnet/fr/a", "nothing", "", None, "a://b://c/d", "http://é.net/fr/", "http://h.org", "http://h.org?x", "http://h.org/a//b/c/d/e", "http://h.org/a\nb/c", "//x.com/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (1, URLS[1], None, None)], "page_id long, url string, host string, template string")
    rows = urlfilter.filter_urls(pages).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r.page_id is not None:
            host, path, rule, verdict = plain_rule(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert urlfilter.filter_urls(pages.where("false")).count() == 0


def test_templates_learn_from_labels(spark):
    urls = [(i, f"http://s.test/{'bad' if i % 2 else 'good'}/{i}") for i in range(80)] + [(1000 + i, f"http://s.test/bad/x{i}") for i in range(5)]
    rules = [("block", "s.test", f"/bad/{i}") for i in range(1, 60, 2)] + [("allow", "s.test", "/good/")]
    found = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert found[1001].template == "/bad/*" and found[1001].verdict == "block" and found[0].template == "/good/*" and found[0].verdict == "allow"


def plain_templates(paths):
    """Level by level: (parent, template) of each (host, path), repeats counted."""
    rows = [[h, [x for x in p.split("/") if x], "", ""] for h, p in paths]
    for level in range(max(len(r[1]) for r in rows)):
        at = [r for r in rows if len(r[1]) > level]
        through, node = Counter((r[0], r[3], r[1][level]) for r in at), Counter((r[0], r[3]) for r in at)
        for r in at:
            n = through[r[0], r[3], r[1][level]]
            often = n >= urlfilter.SUPPORT and n >= urlfilter.SHARE * node[r[0], r[3]]
            r.append(r[1][level] if often else "*")
        for r in at:
            r[2:] = [r[3], f"{r[3]}/{r[4]}"]
    return {(h, p, r[2], r[3]) for (h, p), r in zip(paths, rows, strict=True)}


def test_templates_equal_the_plain_tree(spark):
    random.seed(8)
    paths = [(random.choice("ab"), "/" + "/".join(random.choice(["x", "y", "long", f"id{random.randint(0, 40)}"]) for _ in range(random.randint(0, 6)))) for _ in range(1500)]
    paths += [("c", "/deep" * 200 + f"/{i % 3}") for i in range(12)] + [("d", "/" + "/".join(map(str, range(300))))] + [("", "")]
    counted = [(h, p, n) for (h, p), n in Counter(paths).items()]
    found = urlfilter.templates(spark.createDataFrame(counted, "host string, path string, n long")).collect()
    assert {(r.host, r.path, r.parent, r.template) for r in found} == plain_templates(paths) and len(found) == len(counted)


def test_hosts_without_labels_follow_templates_elsewhere(spark):
    urls = [f"http://{h}/{kind}/{i}" for h in ("a.test", "b.test", "c.free") for kind in ("bad", "good") for i in range(20)]
    rules = [("block", "test", "/bad/"), ("allow", "test", "/good/")]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.filter_urls(frame, rules).where("host = 'c.free'").collect()
    assert {(r.template, r.verdict) for r in found} == {("/bad/*", "block"), ("/good/*", "allow")}
    assert urlfilter.filter_urls(frame, []).where("verdict = 'block'").count() == 0


# --- top-k


def plain_top(rows, k=20, every=20):
    clean = [(i, np.floor(np.array(v, np.float64) * 64).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {i: q for i, q in clean if i % every == 0}.items():
        best = sorted(((-int(q @ v), j) for j, v in clean if j != i))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k_over_many_trees(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 200)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 8))
    vectors = [centres[rng.integers(6)] + 0.2 * rng.standard_normal(8) for _ in range(1200)] + [centres[0]] * 500
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    found = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in found.collect()} == plain_top(rows)


def test_search_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    centres = 40 * rng.standard_normal((30, 16))
    vectors = np.floor(centres[rng.integers(30, size=4000)] + 4 * rng.standard_normal((4000, 16))).astype(np.int64)
    one = [np.array([1])] * 4000
    tree = mtree.MTree.from_bytes(mtree.MTree(vectors, [np.array([i]) for i in range(4000)], one).to_bytes())
    asks = np.arange(0, 4000, 100)
    row, name, _, score = tree.search(vectors[asks], np.full(40, mtree.NONE), np.full(40, mtree.LAST), 5)
    for q in range(40):
        products = vectors @ vectors[asks[q]]
        expected = sorted((-int(p), j) for j, p in enumerate(products))[:5]
        assert list(zip((-score[row == q]).tolist(), name[row == q].tolist(), strict=True)) == expected
    assert tree.count[0] < 4000 * 40 / 3


def test_top_k_with_repeated_ids_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 64)
    monkeypatch.setattr(mtree, "ROOTS", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in rng.integers(0, 300, 900)]
    own = {}
    for i, v in rows:
        own[i] = min(own.get(i, v), v)
    found = {tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()}
    expected = set()
    for i, q in own.items():
        if i % 20 == 0:
            best = sorted((-int(np.floor(np.array(q) * 64) @ np.floor(np.array(v) * 64)), j) for j, v in rows if j != i)[:20]
            expected |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert found == expected


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (40, None), (7, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, tree string, score int")
    assert {tuple(r) for r in mtree.top_k(frame).collect()} == plain_top(rows)
    assert mtree.top_k(frame.where("false")).count() == 0
    assert mtree.top_k(frame.where("vec_id = 0")).count() == 0


# --- chat


def plain_chat(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = Counter()
    for conv, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        out[conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()] += 1
    return out


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "<turn assistant>\nno</turn>\n\\l\\s\\"), (1, 2, "assistant", ""), (1, 70, "user", "late"), (1, 70, "user", "late"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, None, "a>b\nc\\<", "😀é"), (None, 0, "assistant", "who"), (3, 5, "assistant", "y" * 100_000)]
    frame = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, lines string")
    chats = chat.format_chat(frame.withColumn("parts", chat.text_parts(F.col("text"))))
    rows = chat.digests(chats).collect()
    assert Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows) == plain_chat(turns)
    assert chat.digests(chat.format_chat(frame.withColumn("parts", chat.text_parts(F.col("text"))).where("false"))).count() == 0


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <b> ", None, None), ("image", None, "i.png", 2), ("text", "and", None, None), ("audio", None, "a.wav", 3), ("document", None, "d.pdf", None), ("odd", "x", "y", 9), (None, None, None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:bigint>>")
    r = chat.format_chat(frame).first()
    assert r.formatted == "<turn user>\nsee \\lb> <image/>and<audio/><document/></turn>\n<turn assistant>\n</turn>\n"
    assert [tuple(a) for a in r.attachments] == [("image", "i.png", 512), ("audio", "a.wav", 75), ("document", "d.pdf", 600)] and r.attachment_tokens == 1187


def test_escapes_are_reversible(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choices("\\<lsgn>\nab</turn>", k=rng.randint(0, 25))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.where(chat.unescape(chat.escape(F.col("t"))) != F.col("t")).count() == 0
    assert frame.where(chat.unescape_role(chat.escape_role(F.col("t"))) != F.col("t")).count() == 0
    assert frame.where(F.contains(chat.escape(F.col("t")), F.lit("<"))).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and 0.8 * left <= out.count() <= left
            left, docs = out.count(), out
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in out.collect()}
    assert docs.where("text rlike '@mail[0-9]'").count() == 0
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in out.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    tables = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        tables.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    expected = tables.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, SMALL)
    assert sorted(expected.columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(expected.columns).collect())) == Counter(expected.fetchall())


CLASHING = ["_gone", "_hash", "_again", "hash", "row", "score", "size", "key", "value", "term", "span", "bin", "fill", "count", "a.b"]


def test_stages_keep_columns_of_any_name(spark, odd, empty, tmp_path):
    """Each stage over nulls, repeated rows, long and empty texts, no rows at all, and columns whose names are its own."""
    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        wide = docs.select("*", *(F.monotonically_increasing_id().alias(c) for c in CLASHING))
        rows = wide.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, wide, str(tmp_path))
            if name != "best_fit_packing":
                assert got.columns == wide.columns and got.count() <= rows, name
                if name == "pii":
                    assert got.count() == rows
            else:
                assert got.where("piece = 0").count() == rows


def test_quality_scores_are_a_plain_forward_pass(spark):
    """Every passage of a whole text on its own, one formula after the other."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_model(docs, labels)
    w = {k: np.asarray(v, np.float64) for k, v in model.w.items()}
    scores = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for doc_id in sorted(texts)[:60]:
        (x, sizes), = quality.encode_texts([texts[doc_id]])
        assert sizes.tolist() == [len(x)]
        total, mixed = 0.0, 0.0
        for row in np.asarray(x, np.float64):
            h = np.tanh(((row - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
            gate = np.exp(float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]))
            total, mixed = total + gate, mixed + gate * h
        plain = 1 / (1 + np.exp(-(float(mixed / total @ w["c"]) + float(w["c0"][0]))))
        assert abs(plain - scores[doc_id]) < 1e-4, doc_id


def test_words_are_split_as_python_does():
    """Blanks at either end, empty texts, and no text at all; empty runs aren't words."""
    for texts in ([], [""], ["", " a b  A ", "x", "  ", "é É\tb", "a"], ["b", "a b"]):
        words, place, sizes = lm.split_words(pa.array(texts, pa.string()))
        plain = [lm.words_of(t) for t in texts]
        assert [words[i].as_py() for i in place] == [w for own in plain for w in own] and sizes.tolist() == [len(own) for own in plain]
        assert len(set(words.to_pylist())) == len(words)
