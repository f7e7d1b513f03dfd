"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each token becomes one BPE piece at the id of its rank: its bytes mapped to 256 printable characters, scored by
its negative rank, so that the lowest rank merges first, as in the rank file's own library. The model
has an identity normaliser and no dummy prefix. A text is cut into pre-tokens by the pattern of the
vocabulary; each distinct pre-token is encoded once, and decoded by the inverse of the byte map.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import UNSAFE_CUT, Kept, Values, chunked, runs, text_in
from .common import ready, text_of, trimmed

KEPT_PIECES, KEPT_LENGTH = 400_000, 48
#: Chunks that may stand one after the other without changing each other's pre-tokens: a space, a visible character, no other space.
SPACED = "\\A [\x21-\x7e\xa1-\xac\xae-\xff][^ ]*\\z"
#: Unicode's White_Space, which \s means to the library that the rank files belong to.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_map() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: varint, length-delimited or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """ModelProto: pieces (1), trainer_spec (2: model_type BPE), normalizer_spec (3: identity)."""
    to_char = byte_map()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n-1")
    pieces = b"".join(_field(1, _field(1, "".join(to_char[b] for b in token).encode()) + _field(2, float(-rank))) for rank, token in enumerate(by_rank))
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoding and decoding by one rank file and pre-token pattern."""

    _made: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.to_char = byte_map()
        self.table = {b: c for b, c in enumerate(self.to_char)}
        self.to_byte = {c: b for b, c in enumerate(self.to_char)}
        self.pieces = self.model.id_to_piece(list(range(len(self.ranks))))
        #: By id: decimals with a comma after them, and the bytes of its piece by the inverse map.
        self.decimals = Values.of([b"%d," % i for i in range(len(self.ranks))])
        self.decoded = Values.of([self.decode([i]) for i in range(len(self.ranks))])
        self.known = Kept(KEPT_PIECES, KEPT_LENGTH)

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """A pre-token that is a token itself is that token; any other is merged by the model."""
        raw = [x.encode() for x in pretokens]
        out = [[self.ranks[b]] if b in self.ranks else None for b in raw]
        rest = [i for i, ids in enumerate(out) if ids is None]
        mapped = [raw[i].decode("latin-1").translate(self.table) for i in rest]
        for i, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return bytes(map(self.to_byte.__getitem__, "".join(map(self.pieces.__getitem__, ids))))

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pretokens(self.pattern.findall(text)) for i in ids]

    def _entries(self, new: pa.Array) -> Values:
        """Ids of distinct chunks, from their pre-tokens; each distinct pre-token is encoded once.

        Chunks that begin with a space and a visible character are cut into pre-tokens together, which none of them crosses.
        """
        spaced = pc.match_substring_regex(new, SPACED).to_numpy(zero_copy_only=False)
        together = self.pattern.findall(text_in(new.filter(pa.array(spaced))))
        apart = [self.pattern.findall(c) for c in new.filter(pa.array(~spaced)).to_pylist()]
        pretokens = together + [p for cut in apart for p in cut]
        distinct = list(set(pretokens))
        entry = {p: array("I", ids).tobytes() for p, ids in zip(distinct, self.encode_pretokens(distinct), strict=True)}
        ids = Values.of([entry[p] for p in pretokens], "<u4")
        # how many pre-tokens end where each chunk does
        ends = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
        own = np.searchsorted(ends, np.cumsum(pc.utf8_length(new.filter(pa.array(spaced))).to_numpy())) + 1 if len(together) else np.empty(0, np.int64)
        last = np.empty(len(new), np.int64)
        last[spaced] = own
        last[~spaced] = len(together) + np.cumsum(np.fromiter(map(len, apart), np.int64, len(apart)))
        first = np.empty(len(new), np.int64)
        first[spaced] = np.concatenate(([0], own))[:-1]
        first[~spaced] = last[~spaced] - np.fromiter(map(len, apart), np.int64, len(apart))
        edges = np.concatenate(([0], np.cumsum(ids.sizes)))
        return Values(ids.flat, edges[first], edges[last] - edges[first])

    def arrays(self, texts: list[str]):
        """ids of some texts one after the other, and where each text's begin and end."""
        for some in runs(texts, 2_000_000):
            chunks, place, edges = chunked(some, UNSAFE_CUT.search)
            yield self.known.of(chunks, place, self._entries).joined(place, edges)

    def digests(self, texts: list[str]):
        """For each text: token count, SHA-256 of the joined decimal ids, SHA-256 of the bytes that the ids decode to."""
        for ids, edges in self.arrays(texts):
            said, said_ends = self.decimals.joined(ids, edges)
            data, data_ends = self.decoded.joined(ids, edges)
            for n, (a, b), (c, d) in zip(np.diff(edges).tolist(), itertools.pairwise(said_ends.tolist()), itertools.pairwise(data_ends.tolist()), strict=True):
                yield n, hashlib.sha256(said[a : max(a, b - 1)]).hexdigest(), hashlib.sha256(data[c:d]).hexdigest()


ENCODED = "doc_id long, ids array<int>"


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row. Null text is empty text, which has no ids; repeated rows each get a row."""
    ready(docs.sparkSession)

    def run(batches):
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            ids = [array("i", bpe.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(trimmed(run), ENCODED)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, data (bytes) of every row of ENCODED; null ids give null."""
    ready(encoded.sparkSession)

    def run(batches):
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            data = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(trimmed(run), "doc_id long, data binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """DIGESTS of every row of ``docs``: encoded, then decoded from the ids. One pass, no shuffle.

    Null text is empty text (no tokens). Null doc_id stays null; repeated rows each get a row; other columns
    are ignored. Texts are worked off in slices of bounded size, a long text as one slice.
    """
    ready(docs.sparkSession)

    def run(batches):
        bpe = ByteBpe.of(ranks, pattern)
        for batch in batches:
            counts, ids, data = zip(*bpe.digests(batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(trimmed(run), DIGESTS)
