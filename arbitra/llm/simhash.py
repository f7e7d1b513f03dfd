"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Fingerprints are reduced to distinct ones before anything is compared, so a group of exact copies of any
size costs one row. Two fingerprints within ``radius`` bits agree on all but ``radius`` of ``blocks``
bit blocks, so each is sent to every choice of ``blocks - radius`` block values; a pair meets at least
once. What a key has left to vary is ``radius`` blocks of bits, and keys of more than GROUP codes are split by these, so a group is bounded whatever the input.
Keys of one fingerprint never leave the JVM. Inside a group the index finds the pairs:

* the codes are sorted by Gray rank, so neighbours share long bit patterns;
* a node holds the bits that all its children share (mask and value); each child keeps only what its
  parent doesn't hold, so differences add up on the way down;
* a search carries the accumulated differences and drops a node with all below it once they exceed the radius.

Groups emit a spanning forest of their links, not all pairs. Components come from alternating
large-star and small-star rounds on distinct fingerprints.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, cut, ready, text_of, trimmed
from .lm import words_of

RADIUS, BLOCKS, SHINGLE = 2, 6, 3
SEED = 42
#: Children of an index node.
FAN = 8
BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats included. bytes.split() and lower() are the ASCII white space and A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def content_hashes(text: str, common: frozenset[bytes], seed: int = SEED) -> np.ndarray:
    """XXH64 of each word that isn't common, repeats included; of every word where all are common."""
    words = words_of(text)
    words = [w for w in words if w not in common] or words
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, seed) for w in words], np.uint64)


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED, common: frozenset[bytes] | None = None) -> np.ndarray:
    """64-bit SimHash of each text, of its shingles or (with ``common``) its content words; zero where it has no word. Works in slices of bounded size."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    first, rows = 0, 0
    for i, text in enumerate(texts):
        held.append(shingle_hashes(text, shingle, seed) if common is None else content_hashes(text, common, seed))
        rows += len(held[-1])
        if rows >= 50_000 or len(held) == 256 or i == len(texts) - 1:
            out[first : i + 1] = _majority(held)
            held, rows, first = [], 0, i + 1
    return out


def _majority(held: list[np.ndarray]) -> np.ndarray:
    """Bits set in over half of each array: one histogram of byte values by document and byte place, times the bits of a byte."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    place = np.repeat(np.arange(len(held), dtype=np.int64) * 8, sizes)
    seen = np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8)
    index = ((place[:, None] + np.arange(8)) << 8) + seen
    counts = np.bincount(index.ravel(), minlength=len(held) * 2048).reshape(len(held) * 8, 256) @ BIT_OF_BYTE
    set_bits = counts.reshape(len(held), 64) * 2 > sizes[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the inverse of i ^ (i >> 1)."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """The hierarchical index over distinct codes; levels[0] are the leaves, in Gray order."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.fan = fan
        self.order = np.argsort(gray_rank(codes), kind="stable")
        leaves = codes[self.order].astype(np.uint64)
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, values = [np.full(len(leaves), every)], [leaves]
        while len(values[-1]) > fan:
            starts = np.arange(0, len(values[-1]), fan)
            ones = np.bitwise_and.reduceat(values[-1], starts)
            some = np.bitwise_or.reduceat(values[-1], starts)
            shared = np.bitwise_and.reduceat(masks[-1], starts) & ~(ones ^ some)
            masks.append(shared)
            values.append(ones & shared)
        self.values = values
        #: Bits of a node that its parent doesn't hold.
        self.own = [m & ~np.repeat(up, fan)[: len(m)] for m, up in zip(masks[:-1], masks[1:], strict=True)] + [masks[-1]]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, code) positions at ``radius`` or fewer differing bits."""
        top = len(self.values[-1])
        query = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(query), np.uint8)
        for level in range(len(self.values) - 1, -1, -1):
            differ = (queries[query] ^ self.values[level][node]) & self.own[level][node]
            spent = spent + np.bitwise_count(differ)
            kept = spent <= radius
            query, node, spent = query[kept], node[kept], spent[kept]
            if level:
                width = len(self.values[level - 1])
                query, spent = np.repeat(query, self.fan), np.repeat(spent, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                inside = node < width
                query, node, spent = query[inside], node[inside], spent[inside]
        return query, self.order[node]


def forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected among ``codes``, at most one less than there are codes."""
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index, left, right = GrayIndex(codes), [], []
    for at in range(0, len(codes), 1024):
        query, found = index.within(codes[at : at + 1024], radius)
        query = query + at
        for a, b in zip(query[query < found].tolist(), found[query < found].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
    return codes[left], codes[right]


def fingerprint_rows(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", common: list[bytes] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row of ``docs``."""
    ready(docs.sparkSession)
    dropped = None if common is None else frozenset(common)

    def run(batches):
        for batch in batches:
            codes = fingerprints(batch.column(1).to_pylist(), shingle, seed, dropped)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(trimmed(run), "doc_id long, fp long")


def block_masks(blocks: int, radius: int, bits: list[int] | None = None) -> list[int]:
    """A signed 64-bit mask for each choice of blocks of ``bits`` (all 64) that stay fixed."""
    bits = list(range(64)) if bits is None else bits
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    single = [sum(1 << b for b in bits[a:z]) for a, z in itertools.pairwise(edges)]
    masks = [sum(chosen) for chosen in itertools.combinations(single, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: Codes that one key may gather; a key of more is split by the bits that it leaves free.
GROUP = 1 << 20


def _keyed(codes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """key and fp: every code with each of its keys. Keys that more than GROUP codes share are split: codes within ``radius`` bits agree on all but ``radius`` blocks of the bits left free, too.

    As no key holds more codes than there are, only tables of more are counted by key.
    """
    masks = block_masks(blocks, radius)
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))
    keyed = codes.select("fp", F.explode(keys).alias("key"))
    whole = keyed.select(F.struct("key.choice", "key.bits", F.lit(-1).alias("again"), F.lit(0).cast("long").alias("more")).alias("key"), "fp")
    if codes.limit(GROUP + 1).count() <= GROUP:
        return whole
    large = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("key"))
    free = F.array(*(F.array(*(F.lit(m) for m in block_masks(blocks, radius, [b for b in range(64) if not fixed >> b & 1]))) for fixed in masks))
    narrow = F.transform(F.get(free, F.col("key.choice")), lambda m, i: F.struct("key.choice", "key.bits", i.alias("again"), F.col("fp").bitwiseAND(m).alias("more")))
    split = by_ids(keyed, large, "key", "left_semi").select(F.explode(narrow).alias("key"), "fp")
    return by_ids(whole.withColumn("_own", F.struct("key.choice", "key.bits")), large.withColumnRenamed("key", "_own"), "_own", "left_anti").select("key", "fp").unionByName(split)


def links(codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """a < b: links between the distinct ``fp`` that join all that is connected at ``radius`` bits."""
    groups = _keyed(codes, radius, blocks).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("codes")).where(F.size("codes") > 1).select("codes")

    def run(batches):
        for batch in batches:
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for group in batch.column(0):
                a, b = forest(np.asarray(group.values, np.int64).view(np.uint64), radius)
                left.append(a.view(np.int64))
                right.append(b.view(np.int64))
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return groups.mapInArrow(trimmed(run), "a long, b long").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest (large-star,
    small-star). A node's neighbours are never gathered: its minimum is an aggregate, joined back to its edges.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            around = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(least, "u")
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("x"), "m") if large else joined.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        return out.where("x != m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()

    edges = cut(edges)
    mark = None
    for _ in range(rounds):
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, id_column: str = "doc_id", text_column: str = "text", common: list[bytes] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    component_id is the smallest doc_id among all that links of ``radius`` or fewer differing bits reach.
    Null text is empty text; texts without a word share fingerprint zero and are linked like any other. A row
    with null doc_id is fingerprinted and links others, but is never the smallest; a group of
    only such rows has a null component_id. Repeated rows each get a row. No rows: no rows. Other columns are ignored.
    """
    rows = cut(fingerprint_rows(docs, shingle, SEED, id_column, text_column, common))
    codes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected(links(codes.select("fp"), radius, blocks))
    of_code = codes.join(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of_code.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = of_code.join(least, "root").select("fp", "component_id")
    return rows.join(labelled, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


#: Near copies share five-word shingles at a similarity of 0.8: about one word in forty is changed, which moves a fingerprint
#: of content words by two or three bits, but one of shingles by ten.
COMMON, COPY_RADIUS, COPY_BLOCKS = 256, 3, 6
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Bands of so many minimum hashes: a pair at a similarity of 0.8 shares none with a probability of (1 - 0.8^4)^20, 3 in 100,000.
BANDS, BAND = 20, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND, 1), np.uint64)
FACTORS, MASKS = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1] * np.uint64(2)
#: Texts of one block; blocks of a larger group are compared pair by pair of blocks.
TOGETHER = 256


#: Words of a slice whose share of it is smaller aren't counted, so a word's share of the corpus is known to within this; the 256th has some 30 times as much.
SHARE, SLICE = 1 / 65_536, 1_000_000


def common_words(docs: DataFrame, size: int = COMMON, text_column: str = "text") -> list[bytes]:
    """The ``size`` most frequent words of all documents by lossy counting (SHARE), ties in order of the words."""
    ready(docs.sparkSession)

    def run(batches):
        counts: Counter[bytes] = Counter()
        seen = 0

        def out():
            often = {w: n for w, n in counts.items() if n >= seen * SHARE}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(often.keys(), pa.binary()), pa.array(often.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                counts.update(words)
                seen += len(words)
                if seen > SLICE:
                    yield out()
                    seen = 0
        yield out()

    counts = docs.select(text_of(text_column).alias("text")).mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counts.orderBy(F.col("n").desc(), "word").limit(size).collect()]


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of all five-word shingles of a text, in order."""
    return np.unique(shingle_hashes(text.lower(), COPY_SHINGLE).view(np.int64))


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band of minimum hashes of a set. Sets of any size, in slices of bounded size; empty sets share all bands."""
    least = np.full(BANDS * BAND, 0xFFFFFFFFFFFFFFFF, np.uint64)
    own = shingles.view(np.uint64)
    for at in range(0, len(own), 16_384):
        least = np.minimum(least, ((own[at : at + 16_384] ^ MASKS) * FACTORS).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, BAND))]


def _similar(shared, one, other):
    """Whether sets of these sizes are alike; two empty ones are. For numbers, arrays and columns."""
    return shared >= SIMILARITY * (one + other - shared)


def _block_links(frame: pd.DataFrame) -> pd.DataFrame:
    """a < b: checked links that join what is alike in one pair of blocks of a group and isn't joined (by ``root``) yet."""
    frame = frame.sort_values("rep", ignore_index=True)
    reps, side = frame["rep"].to_numpy(), frame["own"].to_numpy()
    crossed = len(np.unique(side)) > 1
    sets = [np.asarray(x, np.int64) for x in frame["shingles"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    held = np.bincount(ids) if len(ids) else np.empty(0, np.int64)
    first, at = np.cumsum(held) - held, np.cumsum(sizes) - sizes
    kind = np.unique(frame["root"].to_numpy(), return_inverse=True)[1]
    left, right = [], []
    for i in range(len(sets)):
        own = ids[at[i] : at[i] + sizes[i]]
        n = held[own]
        places = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[places], minlength=len(sets))
        near = _similar(shared, sizes[i], sizes) & (kind != kind[i])
        near[: i + 1] = False
        if crossed:
            near &= side != side[i]
        for j in np.flatnonzero(near).tolist():
            if kind[i] != kind[j]:
                kind[kind == kind[j]] = kind[i]
                left.append(reps[i])
                right.append(reps[j])
    return pd.DataFrame({"a": left, "b": right}, dtype="int64")


def _near(reps: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, root: every text that checked links join to one of smaller id, and the smallest that they reach.

    ``reps(rep, doc_id, hash, size, bands)`` are distinct texts, candidates by the bands they share; ``pairs(a, b)`` are single ones (a < b). First all of a group are compared with its smallest, which settles groups of
    copies of one text in as many steps as they have members. Groups that aren't joined then are compared pair by
    pair, in blocks of about TOGETHER. No text is joined to another without the similarity of two texts that was checked.
    """
    members = reps.select(F.explode(F.array_distinct("bands")).alias("bucket"), "rep", "size")
    groups = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("mark")).where("n > 1")
    # groups of the same members count once
    groups = cut(groups.groupBy("n", "least", "mark").agg(F.min("bucket").alias("bucket")).drop("mark"))
    placed = cut(by_ids(members, groups, "bucket", "inner"))

    def draw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["rep", "shingles"])

    sizes = lambda side: reps.select(F.col("rep").alias(side), F.col("size").alias(f"{side}_size"))
    pairs = placed.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).unionByName(pairs).distinct()
    # sets can't be alike whose sizes aren't
    possible = _similar(F.least("a_size", "b_size"), F.col("a_size"), F.col("b_size"))
    pairs = cut(pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(possible).select("a", "b"))
    candidates = placed.where("n > 2").select("rep").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("rep"))).distinct()
    candidates = cut(reps.join(candidates, "rep").select("rep", "doc_id", "hash"))
    wanted = by_ids(texts, candidates, ["doc_id", "hash"], "inner").select("rep", "text")
    sets = cut(wanted.mapInArrow(trimmed(draw), "rep long, shingles array<long>").dropDuplicates(["rep"]))
    of = lambda side: sets.select(F.col("rep").alias(side), F.col("shingles").alias(f"{side}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    checked = cut(pairs.join(of("b"), "b").join(of("a"), "a").where(_similar(shared, F.size("a_set"), F.size("b_set"))).select("a", "b").distinct())
    linked = cut(connected(checked))
    rooted = placed.join(linked, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("root"))
    # a group of two was compared in full
    open_groups = cut(rooted.where("n > 2").groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket"))
    parts = F.ceil(F.col("n") / TOGETHER)
    split = by_ids(rooted, open_groups, "bucket", "inner").withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    blocks = split.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "root").join(sets, "rep")
    more = cut(blocks.groupBy("bucket", "low", "high").applyInPandas(_block_links, "a long, b long").where("a != b").distinct())
    if more.isEmpty():
        return linked
    return connected(more.unionByName(linked.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def near_copies(docs: DataFrame, n_common: int = COMMON, radius: int = COPY_RADIUS, blocks: int = COPY_BLOCKS) -> DataFrame:
    """doc_id, hash (of the text): every row that another text, or the same text with a smaller doc_id, stands for: exact copies, and near ones by five-word shingles.

    Exact copies are found by a 128-bit hash and count once from there on; a text's place is its smallest doc_id, then its hash, so texts that
    share a doc_id stay apart. Candidates are all that share a band of minimum
    hashes of their shingles, and what the SimHash index links at ``radius`` bits: fingerprints of content words, all words but the
    ``n_common`` most frequent of the corpus. Links are checked by all shingles; what checked links join is one group.
    """
    common = frozenset(common_words(docs, n_common))
    ready(docs.sparkSession)
    texts = identified(docs.select("doc_id", text_of().alias("text"))).where("doc_id is not null")

    def mark(batches):
        for batch in batches:
            own = batch.column(2).to_pylist()
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in own]
            sizes, held = [], []
            for shingles in map(shingle_set, own):
                sizes.append(len(shingles))
                held.append(bands(shingles))
            words = pa.array(fingerprints(own, common=common).view(np.int64))
            columns = [batch.column(0), batch.column(1), words, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "words", "key", "size", "bands"])

    marked = cut(texts.mapInArrow(trimmed(mark), "doc_id long, hash long, words long, key binary, size long, bands array<long>"))
    held = marked.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("hash", "words", "size", "bands")))
    # numbers in the order of doc_id, whatever repeats
    reps = cut(held.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("rep", F.monotonically_increasing_id()))
    of_code = cut(reps.groupBy(F.col("words").alias("fp")).agg(F.min("rep").alias("first")))
    same = reps.join(of_code, F.col("words") == F.col("fp")).select(F.col("first").alias("x"), F.col("rep").alias("y"))
    code = lambda side, name: of_code.select(F.col("fp").alias(side), F.col("first").alias(name))
    linked = links(of_code.select("fp"), radius, blocks).join(code("a", "x"), "a").join(code("b", "y"), "b").select("x", "y")
    pairs = same.unionByName(linked).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = _near(reps.select("rep", "doc_id", "hash", "size", "bands"), texts, pairs)
    decided = reps.join(near, F.col("rep") == F.col("node"), "left").select("key", F.col("doc_id").alias("least"), F.col("node").isNotNull().alias("near"))
    return marked.select("doc_id", "hash", "key").join(decided, "key").where("near or doc_id != least").select("doc_id", "hash").distinct()


def identified(rows: DataFrame) -> DataFrame:
    """doc_id, hash and text of ``rows(doc_id, text)``."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")


def keep_one(docs: DataFrame, n_common: int = COMMON, radius: int = COPY_RADIUS, blocks: int = COPY_BLOCKS) -> DataFrame:
    """The rows of ``docs`` without near_copies(); all columns stay.

    Null text is empty text; all empty texts are copies of one another. Rows that repeat a doc_id with the same text stay once, and with
    another text are decided by their text; rows without doc_id can't be told apart and stay. Only ids and hashes travel to find
    what goes.
    """
    # the row is one column, so no name of its can meet one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("hash"), text_of().alias("text"))
    gone = cut(near_copies(docs, n_common, radius, blocks).select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")))
    is_gone = (F.col("id") == F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    kept = by_ids(rows, gone, is_gone, "left_anti")
    repeated = rows.where("id is not null").groupBy(F.col("id").alias("own_id"), F.col("hash").alias("own_hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti"))
    if not repeated.isEmpty():
        again = (F.col("id") == F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
        once = by_ids(kept, repeated, again, "left_semi").dropDuplicates(["id", "text"])
        kept = by_ids(kept, repeated, again, "left_anti").unionByName(once)
    return kept.select("row.*")
