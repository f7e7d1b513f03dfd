"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of every document is encoded (shares of character classes, hashed
letter pairs, how far it compresses), a hidden layer embeds it, gated attention weighs the passages of
its document, and the weighted sum is scored. Only document labels are given; which passages matter is learned.
The fit runs in numpy on a bounded sample of labelled documents; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, text_of, trimmed

#: Bytes of a passage.
PASSAGE = 1024
PAIRS = 64
#: Labelled documents of each class, and passages in all, that a fit may use. This bound is the fit's only one: every document is scored.
PER_CLASS, SAMPLE_PASSAGES = 2500, 60_000
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 12, 60, 0.01, 1e-4
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """A class for each byte: every ASCII mark its own, and digits, small, capital, space, line end, other controls, bytes of longer characters."""
    table = np.zeros(256, np.uint8)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for n, b in enumerate(marks):
        table[b] = n
    base = len(marks)
    for b in range(256):
        c = chr(b)
        if b > 127:
            table[b] = base + 6
        elif c.isdigit():
            table[b] = base
        elif c.islower():
            table[b] = base + 1
        elif c.isupper():
            table[b] = base + 2
        elif c == " ":
            table[b] = base + 3
        elif c in "\n\r":
            table[b] = base + 4
        elif b < 33 or b == 127:
            table[b] = base + 5
    return table


CLASS_OF = _classes()
N_CLASSES = int(CLASS_OF.max()) + 1
FEATURES = N_CLASSES + PAIRS + 3


def encode_passages(passages: list[bytes]) -> np.ndarray:
    """FEATURES numbers for each passage of up to PASSAGE bytes."""
    n = len(passages)
    sizes = np.fromiter(map(len, passages), np.int64, n)
    data = np.frombuffer(b"".join(passages), np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(row * np.int32(N_CLASSES) + CLASS_OF[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    pair = ((data[:-1].astype(np.uint16) * np.uint16(31) + data[1:] * np.uint16(7)) >> np.uint16(2)) % np.uint16(PAIRS) if len(data) > 1 else np.empty(0, np.uint16)
    inside = row[:-1] == row[1:] if len(data) > 1 else np.empty(0, bool)
    pairs = np.bincount((row[:-1] * np.int32(PAIRS) + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS) if len(data) > 1 else np.zeros((n, PAIRS))
    length = np.maximum(sizes, 1)[:, None]
    packed = np.fromiter((len(zlib.compress(p, 1)) for p in passages), np.float64, n)
    extra = np.stack([packed / (sizes + 16), np.log1p(sizes), packed / 512], axis=1)
    return np.concatenate([np.sqrt(counts / length), np.sqrt(pairs / length), extra], axis=1).astype(np.float32)


def passages_of(text: str) -> list[bytes]:
    """The whole text in equal passages of at most PASSAGE bytes; an empty text is one empty passage."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // PASSAGE))
    edges = [len(data) * k // n for k in range(n + 1)]
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encode_texts(texts: list[str], slice_size: int = 1024):
    """(features, passages of each text) in slices of bounded size; a long text may span several slices' worth of encoding."""
    held, sizes = [], []
    for text in texts:
        own = passages_of(text)
        held += own
        sizes.append(len(own))
        if len(held) >= slice_size:
            yield _encode(held, slice_size), np.array(sizes)
            held, sizes = [], []
    if sizes:
        yield _encode(held, slice_size), np.array(sizes)


def _encode(passages: list[bytes], size: int) -> np.ndarray:
    return np.concatenate([encode_passages(passages[i : i + size]) for i in range(0, len(passages), size)])


class GatedAttention:
    """Weights of the network, with scoring and fitting."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        bag = np.repeat(np.arange(len(sizes)), sizes)
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return {"bag": bag, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "logit": z @ w["c"] + w["c0"]}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        logit = self._forward(x, starts, sizes)["logit"]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 0) -> GatedAttention:
        """Adam on the weighted log loss of whole bags; the same input gives the same weights."""
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        model = cls({
            "mean": x.mean(0), "scale": x.std(0) + 0.02,
            "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "a": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "c0": np.zeros(1, np.float32),
        })
        w = model.w
        trained = ("W", "b", "V", "U", "a", "c", "c0")
        moment = {k: (np.zeros_like(w[k]), np.zeros_like(w[k])) for k in trained}
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), 256):
                chosen = order[at : at + 256]
                rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in chosen])
                step += 1
                grads = model._gradients(x[rows], sizes[chosen], y[chosen], weight[chosen])
                for k in trained:
                    m, v = moment[k]
                    grad = grads[k] + DECAY * w[k]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    w[k] = (w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model

    def _gradients(self, x, sizes, y, weight) -> dict[str, np.ndarray]:
        w = self.w
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        f = self._forward(x, starts, sizes)
        delta = weight * (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / weight.sum()
        bag, h, t, g, alpha = f["bag"], f["h"], f["t"], f["g"], f["alpha"]
        dz = delta[:, None] * w["c"]
        pull = (h * dz[bag]).sum(1)
        de = alpha * (pull - np.add.reduceat(alpha * pull, starts)[bag])
        dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
        dh = alpha[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
        dp = dh * (1 - h * h)
        return {"W": ((x - w["mean"]) / w["scale"]).T @ dp, "b": dp.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": f["z"].T @ delta, "c0": delta.sum(keepdims=True)}


def fold(doc_id):
    """crc32 of the id as text, modulo 5; null ids fall in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> GatedAttention | None:
    """Fits on up to ``per_class`` documents of either label outside fold 0, those of smallest hash; None without both labels.

    Passages are encoded on the executors; the driver gets numbers of at most SAMPLE_PASSAGES passages. Classes
    are weighted back to their shares among all labels outside fold 0, so scores are probabilities. Null labels are ignored; of several labels for a document the mean decides,
    and of several texts the one of smallest hash is read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    known = known.withColumn("_h", F.xxhash64("doc_id"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("_h", "doc_id").limit(per_class).select("doc_id", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # of rows that repeat a doc_id one text stands for all, so there are as many rows as chosen ids at most
    sample = sample.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    ready(docs.sparkSession)

    def encode(batches):
        for batch in batches:
            ids, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for x, sizes in encode_texts(batch.column(2).to_pylist()):
                begin = 0
                for size in sizes.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at]]), pa.array([ys[at]], pa.int32()), pa.array([size], pa.int32()), pa.array([x[begin : begin + size].astype("<f4").tobytes()], pa.binary())], names=["doc_id", "y", "size", "x"])
                    begin, at = begin + size, at + 1

    # the running sum of passages, in hash order, bounds what is collected
    rows = cut(sample.select("doc_id", "y", "text").mapInArrow(trimmed(encode), "doc_id long, y int, size int, x binary"))
    order = sorted((r.doc_id, r.size) for r in rows.select("doc_id", "size").collect())
    kept, room = set(), SAMPLE_PASSAGES
    for doc_id, size in sorted(order, key=lambda r: zlib.crc32(b"%d" % r[0])):
        if size <= room:
            kept.add(doc_id)
            room -= size
    got = sorted((r for r in rows.where(F.col("doc_id").isin(sorted(kept))).collect() if r.doc_id in kept), key=lambda r: (r.doc_id, r.size, bytes(r.x)))
    if len({r.y for r in got}) < 2:
        return None
    x = np.concatenate([np.frombuffer(bytes(r.x), "<f4").reshape(r.size, -1) for r in got])
    y, sizes = np.array([r.y for r in got], np.float32), np.array([r.size for r in got])
    share = {c: totals[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([share[int(c)] for c in y], np.float32)
    return GatedAttention.fit(x, sizes, y, weight / weight.mean())


def score_documents(docs: DataFrame, model: GatedAttention | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; only the text is scored.

    Null text is empty text, scored like any other. Null doc_id: not held out. Repeated rows each get a row.
    Without a model (no labels of both classes) every score is 0.5. No rows: no rows. Other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            scores = [np.empty(0)]
            for x, sizes in encode_texts(batch.column(2).to_pylist()):
                scores.append(np.full(len(sizes), 0.5) if model is None else model.score(x, sizes))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), text_of().alias("text"))
    return found.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: GatedAttention | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns. Nulls as in score_documents."""
    if model is None or not docs.columns:
        return docs
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            text = batch.column(at).to_pylist()
            kept = [model.score(x, sizes) >= threshold for x, sizes in encode_texts([t or "" for t in text])]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.empty(0, bool)))

    # numbers for names: mapInArrow looks names up, and some (with dots) mean something else then
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(trimmed(run), plain.schema).toDF(*docs.columns)
