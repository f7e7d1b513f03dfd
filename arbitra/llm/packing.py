"""Best-fit packing of documents into token sequences by hierarchical residual packing.

1. Every document is tokenized once; what is kept of it is one small row per piece (length and
   checksum), never the ids. Documents longer than a sequence are cut; the first piece takes the remainder.
2. Each partition packs its pieces best-fit decreasing, in blocks of bounded size.
3. Bins that are not nearly full become items themselves: they meet other partitions' bins in groups of
   bounded size and are packed best-fit again, until one group holds them all or a round no longer helps.
   A bin only ever moves as a whole, so a round writes one small row per moved bin; the moves are
   composed and joined to the pieces once, at the end.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import UNSAFE_CUT, Kept, Values, chunked, runs, slices, text_in
from .common import cut, ready, text_of, trimmed

CAPACITY = 2048
#: Items that one best-fit call may see; beyond it a partition or group is packed in blocks.
BLOCK = 1 << 16
#: A bin with at most this share of its capacity free is emitted as nearly full.
SLACK = 1 / 128
ROUNDS = 8
#: Distinct chunks whose ids a Python worker keeps, and the longest chunk (in bytes) that is kept.
KEPT_CHUNKS, KEPT_LENGTH = 200_000, 48

#: How byte-level tokenizers split text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space, then letters, digits and marks that every regular expression library classes alike; other chunks go to the tokenizer itself.
COMMON = "\\A [\t\n\r\x21-\x7e\xa1-\xac\xae-\xff]+\\z"


class ChunkEncoder:
    """Token ids of a byte-level BPE tokenizer file as little-endian uint32 bytes.

    The tokenizer's pre-tokens never cross a space that is followed by a visible character, so a text
    is cut before such spaces and each distinct chunk is encoded once. Where the file's merges rank as its
    ids do, new chunks of common characters are merged together by the rank library, which gives the same ids
    several times faster; any others, and texts where the cut would be unsafe, go to the tokenizer itself. So do texts
    that spell one of its added tokens, which it recognises.
    """

    _made: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) if added else r"(?!)")
        self.known = Kept(KEPT_CHUNKS, KEPT_LENGTH)
        self.ranked, self.size_of = self._rank_library(path)

    @staticmethod
    def _rank_library(path: str):
        """The same vocabulary for the rank library with each token's length in bytes, or None where the ids aren't ranks."""
        import json

        import tiktoken

        from .bytebpe import byte_map

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        to_byte = {c: b for b, c in enumerate(byte_map())}
        if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or any(vocab.get(c, 256) > 255 for c in to_byte):
            return None, None
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}), sizes

    def _chunks(self, new: pa.Array) -> Values:
        """Ids of distinct chunks. Chunks that begin with a space and hold no other can stand one after the other without changing each other's tokens."""
        common = pc.match_substring_regex(new, COMMON).to_numpy(zero_copy_only=False) if self.ranked else np.zeros(len(new), bool)
        own = new.filter(pa.array(common))
        ids = np.asarray(self.ranked.encode_to_numpy(text_in(own)), "<u4") if len(own) else np.empty(0, "<u4")
        ends = np.searchsorted(np.cumsum(self.size_of[ids]), np.cumsum(pc.binary_length(own).to_numpy())) + 1 if len(own) else np.empty(0, np.int64)
        rest = Values.of(self._library(new.filter(pa.array(~common)).to_pylist()), "<u4")
        begin, sizes = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        sizes[common] = np.diff(ends, prepend=0)
        begin[common] = ends - sizes[common]
        begin[~common], sizes[~common] = rest.begin + len(ids), rest.sizes
        return Values(np.concatenate([ids, rest.flat]), begin, sizes)

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One encoder for each file in each Python worker."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; the batch is worked off in slices of bounded size."""
        for some in runs(texts):
            chunks, place, edges = chunked(some, lambda t: UNSAFE_CUT.search(t) or self.added.search(t))
            ids, ends = self.known.of(chunks, place, self._chunks).joined(place, edges)
            yield from (ids[a:b] for a, b in itertools.pairwise(ends.tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        return (ids.tobytes() for ids in self.arrays(texts))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Returns each item's bin number and offset, and each bin's fill.

    Free space is an integer below ``capacity``, so open bins are kept in one stack for each free
    space and a bit mask tells which stacks hold any: the tightest bin is the lowest set bit at or above the size.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            own = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            free, own = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = own, fills[own]
        fills[own] += size
        left = free - size
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(own)
    return bins, offsets, np.asarray(fills, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: PIECES. Null text counts as empty, whose only id is ``end_id``."""
    ready(docs.sparkSession)
    end = np.array([end_id], "<u4")

    def run(batches):
        encoder = ChunkEncoder.of(tokenizer)
        for batch in batches:
            out = ([], [], [], [], [])
            some = (zip(batch.column(0)[s].to_pylist(), encoder.arrays(batch.column(1)[s].to_pylist()), strict=True) for s in slices(batch.column(1)))
            for doc_id, ids in itertools.chain.from_iterable(some):
                ids = np.append(ids, end).astype("<u4")
                total = len(ids)
                first = (total - 1) % capacity + 1
                at, size, number = 0, first, 0
                while at < total:
                    for column, value in zip(out, (doc_id, number, at, size, zlib.crc32(ids[at : at + size])), strict=True):
                        column.append(value)
                    at, size, number = at + size, capacity, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(trimmed(run), PIECES)


def _pack_locally(items: DataFrame, capacity: int) -> DataFrame:
    """Adds bin, offset and the bin's fill; works on each partition in blocks of BLOCK rows. No shuffle."""

    def pack(frame: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        bins, offsets, fills = best_fit(frame["length"].to_numpy(), capacity)
        return frame.assign(bin=bins + first, offset=offsets, fill=fills[bins]), first + len(fills)

    def run(frames):
        first = TaskContext.get().partitionId() << 36
        held, rows = [], 0
        for frame in frames:
            while len(frame):
                part, frame = frame.iloc[: BLOCK - rows], frame.iloc[BLOCK - rows :]
                held.append(part)
                rows += len(part)
                if rows == BLOCK:
                    out, first = pack(pd.concat(held), first)
                    held, rows = [], 0
                    yield out
        if held:
            yield pack(pd.concat(held), first)[0]

    return items.mapInPandas(trimmed(run), PIECES + ", bin long, offset long, fill long")


def _merge_round(open_bins: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Packs the bins of each group as items: bin, new_bin, base, fill of the new bin."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ignore_index=True)
        out = []
        for at in range(0, len(frame), 2 * BLOCK):
            part = frame.iloc[at : at + 2 * BLOCK]
            bins, offsets, fills = best_fit(part["fill"].to_numpy(), capacity)
            ids = part["bin"].to_numpy()
            name = np.empty(len(fills), np.int64)
            name[bins[offsets == 0]] = ids[offsets == 0]
            out.append(pd.DataFrame({"bin": ids, "new_bin": name[bins], "base": offsets, "fill": fills[bins]}))
        return pd.concat(out)

    grouped = open_bins.withColumn("_group", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(lambda frame: pack(frame[["bin", "fill"]]), "bin long, new_bin long, base long, fill long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packs ``docs(doc_id, text, ...)`` into sequences of at most ``capacity`` tokens.

    Returns PIECES and sequence_id, offset. Other columns of ``docs`` are ignored, whatever their
    names. Null text is empty text: one piece holding ``end_id`` alone. Null or repeated doc_id: every
    row is packed for itself and keeps its doc_id. No rows: no rows.
    """
    local = cut(_pack_locally(cut(pieces(docs, tokenizer, capacity, end_id)), capacity))
    nearly = capacity - int(capacity * SLACK)
    open_bins = local.where((F.col("offset") == 0) & (F.col("fill") < nearly)).select("bin", "fill")
    moves = open_bins.select("bin", F.col("bin").alias("new_bin"), F.lit(0).cast("long").alias("base"))
    count, number = open_bins.count(), 0
    while count > 1 and number < ROUNDS:
        groups = -(-count // BLOCK)
        merged = cut(_merge_round(open_bins, groups, number, capacity))
        step = merged.select(F.col("bin").alias("new_bin"), F.col("new_bin").alias("_to"), F.col("base").alias("_add"))
        moves = cut(moves.join(step, "new_bin", "left").select("bin", F.coalesce("_to", "new_bin").alias("new_bin"), (F.col("base") + F.coalesce("_add", F.lit(0))).alias("base")))
        open_bins = merged.where((F.col("base") == 0) & (F.col("fill") < nearly)).select(F.col("new_bin").alias("bin"), "fill")
        left, number = open_bins.count(), number + 1
        if groups == 1 or left > 0.98 * count:
            break
        count = left
    moves = moves.where("bin != new_bin").withColumnRenamed("bin", "_from")
    return local.join(moves, local["bin"] == moves["_from"], "left").select(
        *(F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
        F.coalesce("new_bin", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
