"""Masked pseudo-likelihood of documents by a bidirectional window network trained in numpy.

1. Words are counted over all documents. The most frequent have network ids of their own, the others share hashed ones.
2. The network predicts every token from WINDOW tokens on both sides. Documents are dealt into shards by a hash of id and text; each shard
   trains a copy, in order of that hash, from one common start, so that weights don't depend on how the input is partitioned.
3. The copies are averaged, weighted by their tokens, in a tree of bounded groups.
4. A document's score is the sum of its tokens' conditional log-probabilities, over its whole text.

The network's output layer is a softmax over CLASSES classes, then one over a class's MEMBERS ids, so that a probability costs
CLASSES + MEMBERS products instead of one for each id, and is still normalised over all.

An id that words share leads to one level more, so every word of the corpus has a probability of its own:
``p(word | id) = (n(word) - own + a c(word)) / (n(id) - n_own(id) + a)``, where ``own`` is what the document itself
holds (a document isn't its own evidence), ``a`` is the number of the id's words that occur once, and ``c`` spells a word by
the corpus' byte frequencies. The counts of the KNOWN most frequent words travel to the workers; rarer words, of which there may be as many as
the corpus likes, meet their counts in a join.

Words are runs between ASCII white space with A-Z in lower case.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, text_of, trimmed

WINDOW, WIDTH = 2, 24
CLASSES, MEMBERS = 32, 32
#: Network ids: 0 pads, then HASHED buckets for words without an id of their own, then the most frequent words.
HASHED = 128
VOCABULARY = CLASSES * MEMBERS - HASHED - 1
#: Words whose counts the workers hold.
KNOWN = 200_000
BATCH, RATE = 8192, 0.08
#: Tokens that a copy trains on, about, and partitions that copies are trained in at most; beyond it a partition trains several.
TOKENS_PER_COPY, MOST_PARTS = 1_250_000, 20_000
#: Weights travel in so many parts, and so many copies meet in one group of the averaging tree.
PARTS, FAN = 16, 32
#: Bytes of text that are worked off together.
SLICE = 16_000_000
#: What stands before a byte's number among the counted words; no word holds a blank.
BYTE = " "


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, each token's place among them, and each text's number of tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    encoded = lists.flatten().dictionary_encode()
    words, place, sizes = encoded.dictionary.cast(pa.binary()), encoded.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # blanks at either end split off nothing
    nothing = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)
    if len(nothing):
        blank = place == nothing[0]
        sizes -= np.bincount(np.repeat(np.arange(len(lists)), sizes)[blank], minlength=len(lists))
        place = place[~blank]
        place -= place > nothing[0]
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, place, sizes


def slices(texts: pa.Array):
    """``texts`` in runs of about SLICE bytes; no text is cut."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy()) if len(texts) else np.empty(0, np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
        yield texts.slice(at, stop - at)
        at = stop


def bucket_of(word: bytes) -> int:
    return 1 + zlib.crc32(word) % HASHED


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """word (binary), n over every document; each slice sends a word once. Byte values are counted as words that begin with BYTE."""
    ready(docs.sparkSession)

    def run(batches):
        spelled = np.zeros(256, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                words, place, _ = split_words(texts)
                counts = np.bincount(place, minlength=len(words))
                lengths = pc.binary_length(words).to_numpy()
                letters = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
                spelled += np.bincount(letters, np.repeat(counts, lengths), 256).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], names=["word", "n"])
        seen = np.flatnonzero(spelled)
        yield pa.RecordBatch.from_arrays([pa.array([f"{BYTE}{i}".encode() for i in seen], pa.binary()), pa.array(spelled[seen], pa.int64())], names=["word", "n"])

    return docs.select(text_of(text_column).alias("text")).mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _words(counts: DataFrame) -> DataFrame:
    return counts.where(~F.startswith("word", F.lit(BYTE.encode())))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The ``size`` most frequent words with their counts, ties in order of the words."""
    return [(bytes(r.word), r.n) for r in _words(counts).orderBy(F.col("n").desc(), "word").limit(size).collect()]


def known_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words above the lowest count that no more than ``most`` reach, by frequency, then in order of the words.

    Counts are compared by the 64th parts of their logarithm to base two, so the search is one aggregate of a few thousand rows.
    """
    step = F.floor(F.log2("n") * 64)
    total, least = 0, None
    for r in _words(counts).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("step").desc()).collect():
        total += r.words
        if total > most:
            break
        least = r.step
    if least is None:
        return []
    return sorted(((bytes(r.word), r.n) for r in _words(counts).where(step >= least).collect()), key=lambda x: (-x[1], x[0]))


def vocabulary(docs: DataFrame, size: int = VOCABULARY, text_column: str = "text") -> list[bytes]:
    """The ``size`` most frequent words of all documents."""
    return [w for w, _ in most_frequent(word_counts(docs, text_column), size)]


class Lexicon:
    """What workers need of the corpus: the known words in order of frequency, each bucket's totals and the cost of a byte."""

    def __init__(self, known: list[tuple[bytes, int]], buckets: list[tuple[int, int, int]], spelled: dict[int, int], tokens: int):
        self.words = [w for w, _ in known]
        self.counts = np.array([n for _, n in known], np.int64)
        self.tokens = tokens
        #: By bucket: occurrences of its words, and how many of its words occur once.
        self.total, self.prior = np.zeros(HASHED + 1), np.ones(HASHED + 1)
        for bucket, n, once in buckets:
            self.total[bucket], self.prior[bucket] = n, max(once, 1)
        every = np.array([spelled.get(i, 0) for i in range(256)], np.float64)
        #: Natural logarithms of each byte's share, an unseen byte counting once, and of a word's end.
        self.byte_cost = np.log(np.maximum(every, 1) / (every.sum() + tokens + 1))
        self.end_cost = float(np.log((tokens + 1) / (every.sum() + tokens + 1)))
        #: Network ids and spellings of the known words.
        self.ids = np.array([HASHED + 1 + i if i < VOCABULARY else bucket_of(w) for i, w in enumerate(self.words)], np.int64)
        self.spelled = self.spellings(self.words)

    def spellings(self, words: list[bytes]) -> np.ndarray:
        """ln c(word) of each."""
        if not words:
            return np.empty(0)
        letters = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum([0, *map(len, words[:-1])])
        return np.add.reduceat(self.byte_cost[letters], starts) + self.end_cost

    @classmethod
    def of(cls, counts: DataFrame) -> Lexicon:
        known = known_words(counts, KNOWN)
        # words with network ids of their own belong to no bucket
        named = [F.lit(w) for w, _ in known[:VOCABULARY]]
        rest = _words(counts).where(~F.col("word").isin(named)) if named else _words(counts)
        bucket = (F.lit(1) + F.crc32("word") % HASHED).cast("int").alias("bucket")
        buckets = [(r.bucket, r.n, r.once) for r in rest.groupBy(bucket).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()]
        spelled = {int(bytes(r.word).decode()[1:]): r.n for r in counts.where(F.startswith("word", F.lit(BYTE.encode()))).collect()}
        tokens = _words(counts).agg(F.sum("n")).first()[0] or 0
        return cls(known, buckets, spelled, tokens)


class Words:
    """Network ids, and what words that share an id cost beside the network, for a slice of texts at a time."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.number = {w: i for i, w in enumerate(lexicon.words)}

    def read(self, texts: pa.Array) -> None:
        """Takes the next slice: its words' numbers (known ones in order of frequency, then its own new ones) and network ids."""
        words, place, self.sizes = split_words(texts)
        words, n_known = words.to_pylist(), len(self.number)
        number = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        self.new = [words[i] for i in new.tolist()]
        number[new] = n_known + np.arange(len(new))
        self.numbers = number[place]
        ids = np.empty(len(words), np.int64)
        ids[number < n_known] = self.lexicon.ids[number[number < n_known]]
        ids[new] = [bucket_of(w) for w in self.new]
        self.ids = ids[place]

    def rows(self) -> list[np.ndarray]:
        """Network ids of each text."""
        return np.split(self.ids, np.cumsum(self.sizes)[:-1])

    def cost(self) -> tuple[np.ndarray, pa.Array]:
        """For each text the sum over its words that share an id, and (word, own, cost as counted) of those that aren't known.

        A word that isn't known counts as if no other document held it; correction() mends that.
        """
        lex, n_known, n_rows = self.lexicon, len(self.number), len(self.sizes)
        shared = self.numbers >= VOCABULARY
        width = n_known + len(self.new) + 1
        row = np.repeat(np.arange(n_rows), self.sizes)[shared]
        pair, own = np.unique(row * width + self.numbers[shared], return_counts=True)
        row, number = pair // width, pair % width
        known = number < n_known
        bucket = np.empty(len(number), np.int64)
        spelled, others = np.empty(len(number)), np.zeros(len(number), np.int64)
        bucket[known], spelled[known] = lex.ids[number[known]], lex.spelled[number[known]]
        others[known] = lex.counts[number[known]] - own[known]
        new = number[~known] - n_known
        bucket[~known] = np.array([bucket_of(w) for w in self.new], np.int64)[new]
        spelled[~known] = lex.spellings(self.new)[new]
        unseen = np.log(lex.prior[bucket]) + spelled
        seen = np.log(others, out=np.full(len(others), -np.inf), where=others > 0)
        sums = np.bincount(row, own * np.logaddexp(seen, unseen), n_rows).astype(np.float64)
        held_by = np.bincount(row * (HASHED + 1) + bucket, own, n_rows * (HASHED + 1)).reshape(n_rows, HASHED + 1)
        sums -= (held_by * np.log(np.maximum(lex.total - held_by + lex.prior, 1e-300))).sum(1)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=n_rows))))
        fields = [pa.array(self.new, pa.binary()).take(pa.array(new)), pa.array(own[~known], pa.int64()), pa.array(unseen[~known])]
        return sums, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "own", "cost"]))


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """context (2 * WINDOW ids), target and row of every token; documents are padded, so windows never cross them."""
    gap = np.zeros(WINDOW, np.int64)
    flat = np.concatenate([gap, *(x for r in rows for x in (r, gap))])
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    first = WINDOW + np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1]))
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[row]
    around = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
    return np.stack([flat[at + d] for d in around], axis=1), flat[at], row


class WindowNetwork:
    SHAPES = {"E": (2 * WINDOW, CLASSES * MEMBERS, WIDTH), "b": (WIDTH,), "C": (CLASSES, WIDTH), "cb": (CLASSES,), "W": (CLASSES, MEMBERS, WIDTH), "wb": (CLASSES, MEMBERS)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0):
        total = sum(int(np.prod(s)) for s in self.SHAPES.values())
        if flat is None:
            flat = (np.random.default_rng(seed).standard_normal(total) * 0.1).astype(np.float32)
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size
        self.seen: dict[str, np.ndarray] = {}

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.b + self.E[0].take(context[:, 0], axis=0)
        for p in range(1, context.shape[1]):
            total += self.E[p].take(context[:, p], axis=0)
        return np.tanh(total, out=total)

    @staticmethod
    def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and the logarithm of each column's sum, both after subtracting the maximum (done in place). Classes are rows, so all steps run along the tokens."""
        logits -= logits.max(0)
        e = np.exp(logits)
        total = e.sum(0)
        e /= total
        return e, np.log(total)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, learn: float = 0.0) -> np.ndarray:
        """Conditional log-probability of each target. With ``learn``, also one step of AdaGrad at that rate."""
        group = target % CLASSES
        order = np.argsort(group.astype(np.uint8), kind="stable")
        context, group, member = context.take(order, axis=0), group.take(order), (target // CLASSES).take(order)
        h = self._hidden(context)
        line = np.arange(len(order))
        logits = self.C @ h.T
        logits += self.cb[:, None]
        p, total = self._softmax(logits)
        out = logits[group, line] - total
        if learn:
            p[group, line] -= 1
            dh = p.T @ self.C
            grads = {"C": p @ h, "cb": p.sum(1)}
            gW, gwb = np.zeros_like(self.W), np.zeros_like(self.wb)
        edges = np.searchsorted(group, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            logits = self.W[c] @ h[a:b].T
            logits += self.wb[c][:, None]
            q, total = self._softmax(logits)
            own = line[: b - a]
            out[a:b] += logits[member[a:b], own] - total
            if learn:
                q[member[a:b], own] -= 1
                gW[c], gwb[c] = q @ h[a:b], q.sum(1)
                dh[a:b] += q.T @ self.W[c]
        if learn:
            dh *= 1 - h * h
            grads |= {"W": gW, "wb": gwb, "b": dh.sum(0)}
            for place in range(context.shape[1]):
                self._learn_rows(place, context[:, place], dh, learn)
            for name, grad in grads.items():
                seen = self.seen.setdefault(name, np.full_like(grad, 1e-6))
                seen += grad * grad
                getattr(self, name)[...] -= learn * grad / np.sqrt(seen)
        back = np.empty_like(out)
        back[order] = out
        return back

    def _learn_rows(self, place: int, ids: np.ndarray, dh: np.ndarray, learn: float) -> None:
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        grad, rows = np.add.reduceat(dh.take(order, axis=0), starts, axis=0), ids[starts]
        if f"E{place}" not in self.seen:
            self.seen[f"E{place}"] = np.full(self.E[place].shape, 1e-6, np.float32)
        seen = self.seen[f"E{place}"]
        own = seen.take(rows, axis=0)
        own += grad * grad
        seen[rows] = own
        grad *= learn
        grad /= np.sqrt(own, out=own)
        self.E[place][rows] -= grad


def _batches(rows):
    """``rows`` in runs of about BATCH tokens; a long text is one run of its own, worked off in steps."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Weights of the network after every shard has trained a copy on all its documents and the copies are averaged.

    Rows that are equal in id and text go to the same shard.
    """
    spark = ready(docs.sparkSession).sparkContext
    shards = max(1, lexicon.tokens // TOKENS_PER_COPY)
    parts = min(shards, MOST_PARTS)
    place = F.xxhash64(F.col(id_column).cast("string"), "text")
    dealt = docs.select(text_of(text_column).alias("text"), F.col(id_column)).select("text", place.alias("place")).withColumn("shard", F.pmod("place", F.lit(shards)))
    dealt = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "place", "text").select("shard", "text")
    shared = spark.broadcast(lexicon)

    def run(batches):
        words = Words(shared.value)
        net, start, tokens, shard = WindowNetwork(), WindowNetwork().flat, 0, None

        held: list[np.ndarray] = []
        size = 0

        def learn():
            nonlocal tokens, size
            context, target, _ = windows(held)
            for at in range(0, len(target), BATCH):
                net.log_probabilities(context[at : at + BATCH], target[at : at + BATCH], RATE)
            tokens, size = tokens + len(target), 0
            held.clear()

        def out():
            moved = np.clip(net.flat - start, -60_000, 60_000).astype("<f2")
            pieces = [x.tobytes() for x in np.array_split(moved, PARTS)]
            return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([shard] * PARTS, pa.int64()), pa.array([float(tokens)] * PARTS), pa.array(pieces, pa.binary())], names=["part", "copy", "weight", "moved"])

        for batch in batches:
            owns = iter(batch.column(0).to_pylist())
            for texts in slices(batch.column(1)):
                words.read(texts)
                for row in words.rows():
                    own = next(owns)
                    if own != shard:
                        learn()
                        if tokens:
                            yield out()
                        net, tokens, shard = WindowNetwork(), 0, own
                    held.append(row)
                    size += len(row)
                    if size >= BATCH:
                        learn()
        learn()
        if tokens:
            yield out()

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("copy")
        weight = frame["weight"].to_numpy()
        total = sum(w * np.frombuffer(m, "<f2").astype(np.float64) for w, m in zip(weight, frame["moved"], strict=True))
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "copy": [frame["copy"].iloc[0] // FAN], "weight": [weight.sum()], "moved": [(total / weight.sum()).astype("<f2").tobytes()]})

    schema = "part int, copy long, weight double, moved binary"
    copies = dealt.mapInArrow(trimmed(run), schema)
    while shards > 1:
        copies = cut(copies.groupBy("part", F.floor(F.col("copy") / FAN)).applyInPandas(average, schema))
        shards = -(-shards // FAN)
    got = {r.part: np.frombuffer(bytes(r.moved), "<f2") for r in copies.collect()}
    start = WindowNetwork().flat
    return start + np.concatenate([got[i] for i in range(PARTS)]).astype(np.float32) if got else start


SCORED = "doc_id long, n_tokens long, log_probability double, rare array<struct<word:binary,own:bigint,cost:double>>"


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """SCORED of every row: the sum over all tokens of its text, with words that aren't known counted as the document's alone."""
    shared = ready(docs.sparkSession).sparkContext.broadcast((lexicon, weights.astype(np.float32)))

    def run(batches):
        words, net = Words(shared.value[0]), WindowNetwork(shared.value[1])
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                words.read(texts)
                sums, rare = words.cost()
                done = 0
                for held in _batches(words.rows()):
                    context, target, row = windows(held)
                    # runs of one size, so none is a small rest
                    found = [net.log_probabilities(c, t) for c, t in zip(*(np.array_split(x, max(1, round(len(target) / BATCH))) for x in (context, target)), strict=True) if len(t)]
                    if found:
                        sums[done : done + len(held)] += np.bincount(row, np.concatenate(found), len(held))
                    done += len(held)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(words.sizes, pa.int64()), pa.array(sums), rare], names=["doc_id", "n_tokens", "log_probability", "rare"])
                at += len(texts)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(trimmed(run), SCORED)


def correction(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """key, more: what the rare words of ``scored(key, rare)`` gain by the documents that hold them beside the own one."""
    pairs = scored.select("key", F.explode("rare").alias("_")).select("key", "_.*")
    met = pairs.join(counts.where("n > 1"), "word").where(F.col("n") > F.col("own"))
    gain = F.col("own") * (F.log(F.col("n") - F.col("own") + F.exp("cost")) - F.col("cost"))
    return met.groupBy("key").agg(F.sum(gain).alias("more"))


def score_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_probability, per_token of every row of ``docs``, by a network trained on all of them.

    Null text is empty text; without a token the sum is 0 and per_token null. Null doc_id stays null. Repeated rows each
    train, count and get a row, and are evidence for one another. No rows: no rows. Other columns are ignored. Texts are never cut short.
    Scores don't depend on partitions but for rounding in single precision.
    """
    counts = cut(word_counts(docs, text_column))
    lexicon = Lexicon.of(counts)
    weights = train(docs, lexicon, id_column, text_column)
    scored = cut(score(docs, lexicon, weights, id_column, text_column).withColumn("key", F.monotonically_increasing_id()))
    gained = correction(scored.where(F.size("rare") > 0).select("key", "rare"), counts)
    total = F.col("log_probability") + F.coalesce("more", F.lit(0.0))
    whole = scored.drop("rare").join(gained, "key", "left").select("doc_id", "n_tokens", total.alias("log_probability"))
    return whole.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))
