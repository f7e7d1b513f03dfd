"""Packing, SimHash, media, PII and byte BPE against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbitra.llm import bytebpe, media, packing, pii, queries, simhash
from tests.conftest import MEDIUM, SMALL
from tests.llm.conftest import LONG_TEXT, ROWS

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts_of(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


# --- packing


def check_packing(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(JSON_VOCABULARY)
    expected = Counter()
    total = 0
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        at, size, piece = 0, (len(ids) - 1) % capacity + 1, 0
        while at < len(ids):
            expected[doc_id, piece, at, size, zlib.crc32(array("I", ids[at : at + size]).tobytes())] += 1
            at, size, piece = at + size, capacity, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing_is_whole_and_tight(spark):
    rows = queries.op1_best_fit_packing(spark, SMALL).collect()
    used, bound = check_packing(rows, texts_of(spark, SMALL), packing.CAPACITY)
    assert used <= bound * 1.02 + 1


def test_packing_merges_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(40, "doc_id")
    monkeypatch.setattr(packing, "BLOCK", 64)
    rows = packing.pack(docs, JSON_VOCABULARY, capacity=4096).collect()
    used, bound = check_packing(rows, texts_of(spark, SMALL), 4096)
    assert used <= bound * 1.05 + 2


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd, JSON_VOCABULARY).collect()
    check_packing(rows, [(r[0], r[1] or "") for r in ROWS], packing.CAPACITY)
    assert packing.pack(empty, JSON_VOCABULARY).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([7, 5, 3, 2, 1]), 10)
    assert fills.tolist() == [10, 8]
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 7, 5, 7]


def test_chunked_ids_equal_the_library():
    encoder = packing.ChunkEncoder(JSON_VOCABULARY)
    random.seed(3)
    alphabet = "aAzZ09 \t\n\r\x0b\x1c\x85  éß'sdtll've漢م😀​Ⅷ½\0<>|.,!?"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(3000)] + ["a <|endoftext|> b", LONG_TEXT, "x" * 5000, " " * 300]
    texts += ["<|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n z", "<|endoftext| >"]
    expected = [array("I", e.ids).tobytes() for e in Tokenizer.from_file(JSON_VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert expected[-3] == array("I", [50256]).tobytes()
    assert list(encoder.encode(texts)) == expected


# --- SimHash


def plain_fingerprint(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < shingle else [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius=2):
    """Smallest id by row position; codes: list of (doc_id, code)."""
    distinct = sorted({c for _, c in codes})
    parent = {c: c for c in distinct}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    array_ = np.array(distinct, np.uint64)
    for i, c in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(array_[i + 1 :] ^ np.uint64(c)) <= radius):
            a, b = root(c), root(distinct[i + 1 + j])
            parent[max(a, b)] = min(a, b)
    least = {}
    for doc_id, c in codes:
        if doc_id is not None:
            least[root(c)] = min(doc_id, least.get(root(c), doc_id))
    return Counter((d, f"{c:016x}", least.get(root(c))) for d, c in codes)


def test_simhash_components(spark):
    codes = [(d, plain_fingerprint(t)) for d, t in texts_of(spark, MEDIUM)]
    found = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op3_simhash_near_dedup(spark, MEDIUM).collect())
    assert found == plain_components(codes)


def test_simhash_odd_rows(odd, empty):
    codes = [(r[0], plain_fingerprint(r[1] or "")) for r in ROWS]
    assert Counter(map(tuple, simhash.components(odd).collect())) == plain_components(codes)
    assert simhash.components(empty).count() == 0


def test_chain_of_links_is_one_component(spark):
    chain = [0]
    for b in range(40):
        chain.append(chain[-1] ^ (3 << b if b < 62 else 1))
    random.seed(1)
    order = random.sample(range(len(chain)), len(chain))
    codes = spark.createDataFrame([(int(np.uint64(chain[i]).astype(np.int64)),) for i in order], "fp long")
    roots = simhash.connected(simhash.links(codes)).collect()
    assert len({r.root for r in roots}) == 1


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_gray_index_finds_all(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 14, (60, 2))]
    codes = np.unique(np.array(near, np.uint64))
    query, found = simhash.GrayIndex(codes).within(codes, radius)
    expected = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius)
    assert set(zip(query.tolist(), found.tolist(), strict=True)) == set(zip(*(x.tolist() for x in expected), strict=True))


def test_block_masks_bring_close_codes_together():
    for flips in itertools.combinations(range(0, 64, 3), 2):
        differ = sum(1 << b for b in flips)
        assert any(m % (1 << 64) & differ == 0 for m in simhash.block_masks(6, 2))


def test_keep_one_of_each_group(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({1: 1, 3: 1, 4: 1, 7: 1, 8: 1, None: 2})


# --- media


def test_image_formats_round_trip():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (13, 21, 3), dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all()
    assert (media.decode(media.encode_netpbm(image[:, :, 0])) == image[:, :, 0]).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[255, 0, 255], [0, 255, 0]] or media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    with pytest.raises(media.MediaError):
        media.decode(b"P6\n4 4\n255\nshort")


def test_area_resize_keeps_means():
    image = np.random.default_rng(1).random((10, 7))
    assert np.allclose(media.area_resize(image, 10, 7), image)
    assert np.isclose(media.area_resize(image, 3, 2).mean(), image.mean())
    assert np.isclose(media.area_resize(image, 2, 1)[0, 0], image[:5].mean())


def plain_media(text):
    data = text.encode()
    payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_media_of_texts(spark, odd, empty):
    for rows, docs in ((queries.op5_media_columns(spark, SMALL).collect(), texts_of(spark, SMALL)), (media.media_features(odd).collect(), [(r[0], r[1] or "") for r in ROWS])):
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == Counter((d, *plain_media(t)) for d, t in docs)
    assert media.media_features(empty).count() == 0


def test_bad_media_is_always_a_media_error():
    image = np.random.default_rng(2).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    whole = [media.encode_netpbm(image), media.encode_netpbm(image[:, :, 0]), media.encode_bmp(image), b"P1\n# c\n3 2\n1 0 1 # 1 1\n010\n", b"P3 1 1 255 1 2 3", b"P4 9 2 \xff\x80\x00\x00"]
    bad = [b"P5\n1 1\n255", b"P3\n1 1\n255\na b c", b"P1 2 1 12", b"P2 1 1 15 16", b"BM" + b"\0" * 60]
    with_palette = bytearray(media.encode_bmp(image))
    with_palette[28], with_palette[46:50] = 8, (300).to_bytes(4, "little")
    random.seed(6)
    for data in [*bad, bytes(with_palette), *(bytes(random.choice(w)[: random.randint(0, 90)]) for w in [whole] * 300)]:
        if data not in whole:
            with pytest.raises(media.MediaError):
                media.decode(data)
    for _ in range(2000):
        data = bytearray(random.choice(whole))
        for _ in range(random.randint(1, 4)):
            data[random.randrange(len(data))] = random.randrange(256)
        try:
            media.decode(bytes(data))
        except media.MediaError:
            pass
    assert media.decode(whole[3]).tolist() == [[0, 255, 0], [255, 0, 255]]


def test_tiles_name_bad_media(spark):
    image = np.zeros((5, 4, 3), np.uint8)
    found = media.tiles(spark.createDataFrame([(1, bytearray(media.encode_bmp(image))), (2, bytearray(b"nothing")), (3, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (found[0].height, found[0].width, found[0].error) == (5, 4, None) and np.load(__import__("io").BytesIO(found[0].tile)).shape == (32, 32, 3)
    assert [r.error for r in found[1:]] == ["neither Netpbm nor BMP", "null"]


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows, docs):
    expected = Counter()
    for doc_id, text in docs:
        spans = plain_spans(text)
        counts = Counter(k for k, _, _ in spans)
        expected[doc_id, *(counts[k] for k in PLAIN), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == expected


def test_pii_base_spans(spark, odd, empty):
    check_pii(queries.op9_pii(spark, MEDIUM).collect(), texts_of(spark, MEDIUM))
    check_pii(pii.digests(pii.find_spans(odd)).collect(), [(r[0], r[1] or "") for r in ROWS])
    assert pii.digests(pii.find_spans(empty)).count() == 0


def test_pii_patterns_on_random_runs(spark):
    random.seed(5)
    pieces = ["a", "b.c", "@", "@x", ".y", "-", "+", "_", " ", "1", "12", "255", "256", ".", "4539148803436467", "4539 1488-0343 6467", "+1 (555) 010-2030", "é", "😀", "(", ")"]
    docs = [(i, "".join(random.choices(pieces, k=random.randint(1, 14)))) for i in range(3000)]
    found = pii.digests(pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    check_pii(found, docs)


def plain_terms(texts, threshold=pii.DISCLOSURE, error=pii.ERROR):
    """Plain words, entities and statistics of distinct texts: {(term, kind): (n, near)} of the disclosing ones, and a function that finds their places."""

    def words(text):
        own = list(text)
        for _, a, b in plain_spans(text):
            own[a:b] = " " * (b - a)
        return [(m[0], *m.span()) for m in regex.finditer(r"[\p{L}\p{N}]{3,}", "".join(own))]

    def term(word):
        return word.lower() if not regex.search(r"\p{N}", word) else ("#x" if regex.search(r"\p{L}", word) else "#d") + str(len(word))

    units, kinds = defaultdict(set), defaultdict(set)
    for text in set(texts):
        found = sorted({(k, text[a:b]) for k, a, b in plain_spans(text)})
        unit = tuple(found) or text
        units[unit] |= {term(w) for w, _, _ in words(text)}
        kinds[unit] = {k for k, _ in found}
    n, near = Counter(), Counter()
    for unit, terms in units.items():
        n.update(terms)
        near.update((t, k) for t in terms for k in kinds[unit])
    share = {k: sum(k in held for held in kinds.values()) / len(units) for k in PLAIN} if units else {}
    proof = math.log(max(len(n), 1) * len(PLAIN) / error)
    out = {}
    for (t, k), together in near.items():
        a, p = together / n[t], share[k]
        if p < 1 and a > p and n[t] * (a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 else 0)) > proof and 1 - math.log(a) / math.log(p) >= threshold:
            out[t, k] = n[t], together
    known = {t for t, _ in out}
    return out, lambda text: [(w.lower(), a, b) for w, a, b in words(text) if term(w) in known]


def check_terms(frame, **settings):
    texts = [r.text or "" for r in frame.collect()]
    known, places = plain_terms(texts, **settings)
    assert {(r.term, r.kind): (r.n, r.near) for r in pii.disclosing_terms(frame, **settings).collect()} == known
    found = pii.find_spans(frame, **settings).join(frame.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all([(t.value, t.start, t.end) for t in r.terms] == places(r.text or "") for r in found)
    return known


def test_disclosing_terms_of_the_corpus(spark):
    known = check_terms(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert known


@pytest.mark.parametrize("at_once", [2000, 0])
def test_disclosing_terms_stand_anywhere(spark, monkeypatch, at_once):
    monkeypatch.setattr(pii, "LOOKED_UP", at_once)
    docs = [(i, f"write Zorgmail user{i}x@host{i}.org the day, id 77-{i % 10}{'ab12' * 5}") for i in range(20)] + [(100 + i, f"the day was long {i}") for i in range(300)]
    docs += [(500, "zorgmail@x.org said that zorgmail, ZORGMAIL and not zorgmailer are zorgmail"), (501, "nothing but 😀Zorgmail here"), (501, "nothing but 😀Zorgmail here"), (502, None)]
    # near copies hold one value, so they are one unit, and their own words prove nothing
    docs += [(600 + i, f"special offer {i} by anna@shop.org") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = check_terms(frame)
    assert {t for t, _ in known} == {"write", "zorgmail", "#x21"}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[501] == "nothing but 😀[TERM] here" and clean[0] == "[TERM] [TERM] [EMAIL] the day, id 77-[TERM]" and clean[100] == "the day was long 0" and clean[502] is None


def test_copies_change_no_disclosing_term(spark):
    docs = [(i, f"acmecorp user{i}x@host{i}.org") for i in range(12)] + [(100 + i, f"the day was long {i}") for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    copied = docs + [(1000 + i, docs[0][1]) for i in range(300)] + [(2000 + i, docs[20][1]) for i in range(300)]
    once, again = check_terms(frame(docs)), check_terms(frame(copied))
    assert once == again and {t for t, _ in once} == {"acmecorp"}


def test_pii_long_texts_and_clashing_names(spark):
    text = " ".join(f"Ü user{i}@a.org 10.0.0.{i % 256}" for i in range(30_000))
    names = ["doc_id", "text", "doc_key", "spans", "terms", "forms", "left", "row"]
    clean = pii.sanitise(spark.createDataFrame([(1, text, "k", "s", "t", "f", "l", "r")], names))
    assert clean.columns == names and [tuple(r) for r in clean.collect()] == [(1, " ".join(["Ü [EMAIL] [IP]"] * 30_000), "k", "s", "t", "f", "l", "r")]
    check_pii(pii.digests(pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect(), [(1, text)])


def test_spans_that_overlap_are_replaced_once(spark):
    spans = [("a", 1, 4), ("b", 2, 3), ("c", 3, 6), ("d", 6, 7), ("e", 8, 8)]
    frame = spark.createDataFrame([("é123456789", [(k, a, b, "") for k, a, b in spans])], f"text string, spans {pii.SPAN}")
    row = frame.select(pii._replaced(F.col("text"), F.col("spans"), lambda kind, size: F.concat(F.lit("<"), F.coalesce(kind, F.lit("")), size.cast("string"), F.lit(">"))).alias("t"), pii.blanked(F.col("text"), F.col("spans")).alias("b")).first()
    assert row.t == "é<a3><0><2><d1>7<e0>89" and row.b == "é      789"


def test_sanitise_odd_rows(odd):
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == len(ROWS)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[7] == "mail [EMAIL] or [PHONE] or [CARD] or [IP] now" and text[2] is None and text[3] == LONG_TEXT


# --- byte BPE


def test_byte_bpe_equals_the_rank_library(spark, odd, empty):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})

    def plain(text):
        ids = own.encode_ordinary(text)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    for frame, docs in ((queries.op10_byte_bpe(spark, SMALL), texts_of(spark, SMALL)), (bytebpe.round_trip_digests(odd, RANKS, public_tokenizers.PATTERN), [(r[0], r[1] or "") for r in ROWS])):
        assert Counter(map(tuple, frame.collect())) == Counter((d, *plain(t)) for d, t in docs)
    assert bytebpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_round_trip(odd):
    encoded = bytebpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    decoded = bytebpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.data)) for r in decoded) == Counter((r[0], (r[1] or "").encode()) for r in ROWS)
