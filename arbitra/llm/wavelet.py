"""Token ids as wavelet matrices: one compressed file for each shard, which answers access, counting and occurrence lookup.

A shard holds the ids of consecutive documents, one after the other. Plane by plane, from the highest bit, the ids' bits are stored
in the order that the planes before left; then zeros go before ones. Each plane is cut into blocks of BLOCK bits, compressed one by one, and the ones
before each block are in the file's directory. So a token is found by one block of each plane (access), how often an id stands before a place
by two (rank), and where an id stands for the k-th time by walking up again (select); a whole shard is decoded plane by plane.

File: MAGIC, the compressed blocks, a compressed directory, its size (8 bytes, little-endian), MAGIC. The directory is JSON, with the documents' ids
and lengths among the blocks.
"""

from __future__ import annotations

import io
import itertools
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import slices
from .common import ready, text_of, trimmed
from .packing import ChunkEncoder

MAGIC = b"WVMX0001"
#: Bits of a block: what a single access has to decompress of each plane.
BLOCK = 1 << 16
#: A shard is closed by the document that brings it to this many tokens.
SHARD_TOKENS = 1 << 22
#: Tasks that read files at most; beyond it a task reads several.
MOST_TASKS = 100_000


def write_shard(out, ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> int:
    """Writes one shard of ``ids`` (unsigned, any width) to the binary file ``out``; returns its bytes."""
    compress = zstandard.ZstdCompressor(level=1).compress
    at = out.write(MAGIC)

    def block(data: bytes) -> list[int]:
        nonlocal at
        packed = compress(data)
        out.write(packed)
        at += len(packed)
        return [at - len(packed), len(packed)]

    width = int(ids.max()).bit_length() if len(ids) else 0
    planes, current = [], np.asarray(ids, np.uint16 if width <= 16 else np.uint32)
    for bit in range(width - 1, -1, -1):
        ones = (current & current.dtype.type(1 << bit)) != 0
        packed = np.packbits(ones)
        blocks = [block(packed[i : i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        before = np.add.reduceat(np.bitwise_count(packed).astype(np.int64), np.arange(0, len(packed), BLOCK // 8))
        planes.append({"ones": [0, *np.cumsum(before).tolist()], "blocks": blocks})
        current = np.concatenate([np.compress(~ones, current), np.compress(ones, current)])
    known = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    docs = {"known": block(np.packbits(known).tobytes()), "doc_ids": block(np.diff(numbers, prepend=0).tobytes()), "lengths": block(np.asarray(lengths, "<i8").tobytes())}
    directory = compress(json.dumps({"tokens": len(ids), "documents": len(doc_ids), "block": BLOCK, "planes": planes, "docs": docs}).encode())
    out.write(directory + len(directory).to_bytes(8, "little") + MAGIC)
    return at + len(directory) + 16


class Shard:
    """Reads a shard from a seekable binary file; blocks are read when they are needed."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        tail = self._bytes(max(0, size - 16), min(16, size))
        if size < 24 or tail[8:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:8], "little")
        self.directory = json.loads(zstandard.decompress(self._bytes(size - 16 - length, length)))
        self.tokens, self.n_documents, self.block = (self.directory[k] for k in ("tokens", "documents", "block"))
        self.planes = self.directory["planes"]
        self.zeros = [self.tokens - p["ones"][-1] for p in self.planes]

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(size)
        if len(data) < size:
            raise ValueError("the shard ends early")
        return data

    def _block(self, place: list[int]) -> bytes:
        return zstandard.decompress(self._bytes(*place))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_id and number of tokens of each document, in the order of the file."""
        docs = self.directory["docs"]
        known = np.unpackbits(np.frombuffer(self._block(docs["known"]), np.uint8), count=self.n_documents)
        ids = np.cumsum(np.frombuffer(self._block(docs["doc_ids"]), "<i8")).tolist()
        return [i if k else None for i, k in zip(ids, known.tolist(), strict=True)], np.frombuffer(self._block(docs["lengths"]), "<i8")

    def _bits(self, plane: int) -> np.ndarray:
        """All bits of a plane."""
        packed = b"".join(map(self._block, self.planes[plane]["blocks"]))
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=self.tokens).view(bool)

    def _ones(self, plane: int, place: int) -> tuple[int, int]:
        """How many ones stand before ``place`` in a plane, and the bit there (0 at the end)."""
        number, rest = divmod(place, self.block)
        ones = self.planes[plane]["ones"][number]
        if place == self.tokens:
            return self.planes[plane]["ones"][-1], 0
        packed = np.frombuffer(self._block(self.planes[plane]["blocks"][number]), np.uint8)
        whole, bit = divmod(rest, 8)
        return ones + int(np.bitwise_count(packed[:whole]).sum()) + (int(packed[whole]) >> (8 - bit)).bit_count(), int(packed[whole]) >> (7 - bit) & 1

    def access(self, place: int) -> int:
        """The id at ``place``."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        found = 0
        for k in range(len(self.planes)):
            ones, bit = self._ones(k, place)
            found = found << 1 | bit
            place = self.zeros[k] + ones if bit else place - ones
        return found

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the ids before ``stop`` that equal ``token`` lie below the last plane."""
        first, last = 0, stop
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            low, high = self._ones(k, first)[0], self._ones(k, last)[0]
            one = token >> (len(self.planes) - 1 - k) & 1
            first, last = (self.zeros[k] + low, self.zeros[k] + high) if one else (first - low, last - high)
            if first == last:
                break
        return first, last

    def rank(self, token: int, stop: int) -> int:
        """How often ``token`` stands before ``stop``."""
        first, last = self._range(token, min(max(0, stop), self.tokens))
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.tokens)

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        """Where the k-th (from 0) one, or zero, of a plane stands."""
        edges = np.asarray(self.planes[plane]["ones"])
        if not one:
            edges = np.minimum(np.arange(len(edges)) * self.block, self.tokens) - edges
        number = int(np.searchsorted(edges, k, side="right")) - 1
        size = min(self.block, self.tokens - number * self.block)
        bits = np.unpackbits(np.frombuffer(self._block(self.planes[plane]["blocks"][number]), np.uint8), count=size)
        return number * self.block + int(np.flatnonzero(bits == one)[k - int(edges[number])])

    def select(self, token: int, k: int) -> int:
        """Where ``token`` stands for the k-th time (from 0)."""
        first, last = self._range(token, self.tokens)
        if not 0 <= k < last - first:
            raise IndexError(k)
        place = first + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - plane) & 1
            place = self._select_bit(plane, one, place - self.zeros[plane] if one else place)
        return place

    def occurrences(self, token: int) -> np.ndarray:
        """All places where ``token`` stands, in order."""
        first, last = self._range(token, self.tokens)
        places = np.arange(first, last)
        for plane in range(len(self.planes) - 1, -1, -1) if len(places) else ():
            one = token >> (len(self.planes) - 1 - plane) & 1
            places = np.flatnonzero(self._bits(plane) == bool(one))[places - self.zeros[plane] if one else places]
        return places

    def ids(self) -> np.ndarray:
        """All ids in order, put together from the last plane to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        current = np.zeros(self.tokens, kind)
        for plane in range(len(self.planes) - 1, -1, -1):
            ones = self._bits(plane)
            above = np.empty(self.tokens, kind)
            above[np.flatnonzero(~ones)] = current[: self.zeros[plane]]
            above[np.flatnonzero(ones)] = current[self.zeros[plane] :] | kind(1 << (len(self.planes) - 1 - plane))
            current = above
        return current


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path there; local, HDFS and object stores alike."""
    return fs.FileSystem.from_uri(folder)


MANIFEST = "part int, number int, file string, documents long, tokens long, bytes long"


def write_documents(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the ids of ``docs(doc_id, text, ...)``, each document closed by ``end_id``, as shards in ``folder`` (any shared place); returns MANIFEST.

    Files are in ascending order of doc_id (null first; rows of one doc_id by a hash of their text), part by part and number by number.
    Null text is empty text, whose only id is ``end_id``. Repeated rows are documents of their own; other columns are ignored; no
    rows give no files. No document is cut: a shard holds ``shard_tokens`` and what its last document has beyond. A task writes each file under a
    name of its own and then renames it, so a task that is tried again leaves the same files. The manifest is written as a table
    beside them, and counts what it names alone.
    """
    ready(docs.sparkSession)
    columns = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches):
        system, root = place_of(folder)
        encoder, part = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId()
        held, doc_ids, lengths, number = [], [], [], 0
        end = np.array([end_id], "<u4")

        def out():
            nonlocal number
            name = f"part-{part:06d}-{number:05d}.wvm"
            aside = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as target:
                size = write_shard(target, np.concatenate(held), doc_ids, lengths)
            system.move(aside, f"{root}/{name}")
            row = (part, number, name, len(doc_ids), sum(lengths), size)
            for kept in (held, doc_ids, lengths):
                kept.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=columns)

        tokens = 0
        for batch in batches:
            for some in slices(batch.column(1)):
                for doc_id, ids in zip(batch.column(0)[some].to_pylist(), encoder.arrays(batch.column(1)[some].to_pylist()), strict=True):
                    held += [ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, end.astype(np.uint16) if end_id < 1 << 16 else end]
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) + 1)
                    tokens += len(ids) + 1
                    if tokens >= shard_tokens:
                        yield out()
                        tokens = 0
        if doc_ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # the row's number deals out rows that repeat both; as they are alike, their order is free
    rows = rows.select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    laid = rows.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")
    system, root = place_of(folder)
    system.create_dir(root, recursive=True)
    laid.select("doc_id", "text").mapInArrow(trimmed(run), MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """``manifest`` and base: the tokens before each file in the whole. One total for each partition that was written meets in the driver, whatever it holds."""
    totals = sorted((r.part, r.tokens) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect())
    before = list(zip((p for p, _ in totals), itertools.accumulate((n for _, n in totals), initial=0), strict=False))
    parts = manifest.sparkSession.createDataFrame(before, "part int, _before long")
    earlier = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    return manifest.withColumn("_earlier", earlier).join(parts, "part").withColumn("base", F.col("_before") + F.col("_earlier")).drop("_before", "_earlier")


def _each(manifest: DataFrame, folder: str, work, schema: str) -> DataFrame:
    """``work(shard, base)``, a record batch, of every file of ``manifest`` with its base; about one file for each task."""
    ready(manifest.sparkSession)

    def run(batches):
        system, root = place_of(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{file}") as source:
                    yield work(Shard(source), base)

    files = placed(manifest).select("file", "base")
    return files.repartition(max(1, min(MOST_TASKS, manifest.count()))).mapInArrow(trimmed(run), schema)


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """DOCUMENTS of every document in the files of ``manifest``: the tokens before it, its tokens and the CRC-32 of its ids as little-endian 32-bit numbers."""

    def work(shard: Shard, base: int) -> pa.RecordBatch:
        doc_ids, lengths = shard.documents()
        data = memoryview(shard.ids().astype("<u4")).cast("B")
        ends = np.cumsum(lengths)
        begin = ends - lengths
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begin + base), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _each(manifest, folder, work, DOCUMENTS)


def count_tokens(manifest: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of ``tokens`` stands in the whole; a few blocks of each file are read."""

    def work(shard: Shard, base: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _each(manifest, folder, work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(manifest: DataFrame, folder: str, token: int) -> DataFrame:
    """doc_id, place (in its document, from 0), position (in the whole) of every occurrence of ``token``."""

    def work(shard: Shard, base: int) -> pa.RecordBatch:
        places = shard.occurrences(token)
        doc_ids, lengths = shard.documents() if len(places) else ([], np.empty(0, np.int64))
        ends = np.cumsum(lengths)
        own = np.searchsorted(ends, places, side="right")
        inside = places - (ends - lengths)[own] if len(places) else places
        return pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i in own.tolist()], pa.int64()), pa.array(inside, pa.int64()), pa.array(places + base, pa.int64())], names=["doc_id", "place", "position"])

    return _each(manifest, folder, work, "doc_id long, place long, position long")
