"""Cutting texts before spaces that a visible character follows, so that each distinct chunk is worked off once.

Byte-level pre-tokens never cross such a space. Splitting, numbering and putting together run over arrays of a whole slice of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space after which a cut would change pre-tokens; texts that hold one are one chunk.
UNSAFE_CUT = re.compile(r" (?:\s|\Z)")
#: Characters of texts that are worked off together.
SLICE = 2_000_000
#: Rows and bytes of a record batch's texts that are Python strings at a time.
ROWS, BYTES = 1024, 4_000_000


def slices(texts: pa.Array) -> Iterator[slice]:
    """Runs of a column's texts of bounded number and size; no text is cut."""
    start, size = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, own in enumerate(sizes):
        if i > start and (i - start == ROWS or size + own > BYTES):
            yield slice(start, i)
            start, size = i, 0
        size += own
    if start < len(sizes):
        yield slice(start, len(sizes))


def runs(texts: list[str], most: int = SLICE) -> Iterator[list[str]]:
    """``texts`` in runs of about ``most`` characters; no text is cut."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < most):
            size += len(texts[stop])
            stop += 1
        yield texts[start:stop]
        start = stop


def chunked(texts: list[str], whole: Callable[[str], object]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct chunks of ``texts``, each chunk's place among them, and where each text's chunks begin and end.

    A text that ``whole`` says is so is one chunk.
    """
    uncut = np.fromiter((bool(whole(t)) for t in texts), bool, len(texts))
    lists = pc.split_pattern(pa.array([t for t, u in zip(texts, uncut, strict=True) if not u], pa.string()), " ")
    flat = lists.flatten()
    first = np.zeros(len(flat), bool)
    first[lists.offsets.to_numpy()[:-1]] = True
    heads, tails = (flat.filter(pa.array(x)).dictionary_encode() for x in (first, ~first))
    place = np.empty(len(flat), np.int64)
    place[first] = heads.indices.to_numpy()
    place[~first] = tails.indices.to_numpy().astype(np.int64) + len(heads.dictionary)
    n_cut = len(heads.dictionary) + len(tails.dictionary)
    spaced = pc.binary_join_element_wise("", tails.dictionary, " ")
    sizes = np.ones(len(texts), np.int64)
    sizes[~uncut] = pc.list_value_length(lists).to_numpy()
    edges = np.concatenate(([0], np.cumsum(sizes)))
    every = np.empty(edges[-1], np.int64)
    own = np.repeat(uncut, sizes)
    every[~own] = place
    every[own] = n_cut + np.arange(uncut.sum())
    return pa.concat_arrays([heads.dictionary, spaced, pa.array([t for t, u in zip(texts, uncut, strict=True) if u], pa.string())]), every, edges


def text_in(strings: pa.Array) -> str:
    """All of ``strings`` one after the other."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), "")[0].as_py() if len(strings) else ""


class Values:
    """Runs of numbers that are put together by their places."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
        self.flat, self.begin, self.sizes = flat, begin, sizes

    @classmethod
    def of(cls, values: list[bytes], unit: str = "u1") -> Values:
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(unit).itemsize
        return cls(np.frombuffer(b"".join(values), unit), np.cumsum(sizes) - sizes, sizes)

    def joined(self, place: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at ``place`` one after the other, and where each text's begin and end in them."""
        n = self.sizes[place]
        ends = np.cumsum(n)
        at = np.repeat(self.begin[place] - ends + n, n)
        at += np.arange(len(at))
        return self.flat[at], np.concatenate(([0], ends))[edges]


class Kept:
    """Ids of chunks that have occurred twice in a slice, as bytes, up to ``most``; most chunks are rare and worth no memory."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.known = most, longest, {}

    def of(self, chunks: pa.Array, place: np.ndarray, make: Callable[[pa.Array], Values]) -> Values:
        """The ids (uint32) of ``chunks``; those that aren't known come from ``make``."""
        names = chunks.to_pylist()
        got = list(map(self.known.get, names))
        new = np.fromiter((x is None for x in got), bool, len(got))
        known = Values.of([x for x in got if x is not None], "<u4")
        made = make(chunks.filter(pa.array(new)))
        begin, sizes = np.empty(len(got), np.int64), np.empty(len(got), np.int64)
        begin[~new], sizes[~new] = known.begin, known.sizes
        begin[new], sizes[new] = made.begin + len(known.flat), made.sizes
        flat = np.concatenate([known.flat, made.flat])
        again = new & (np.bincount(place, minlength=len(got)) > 1) & (pc.binary_length(chunks).to_numpy() <= self.longest)
        if len(self.known) + again.sum() > self.most:
            self.known.clear()
        for i in np.flatnonzero(again).tolist():
            self.known[names[i]] = flat[begin[i] : begin[i] + sizes[i]].tobytes()
        return Values(flat, begin, sizes)
