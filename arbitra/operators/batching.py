"""Batches of scored pairs: planning by padded size, pairs to rows and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.probability import next_power_of_two, round_up
from arbitra.sources.shared import materialise

BATCH = "array<struct<indices:array<int>,width:int,padded:int>>"


def check_plan(pairs: int, tokens: int | None, multiple: int) -> None:
    """Limits of batches are positive whole numbers; the tokens' may be missing."""
    for name, value in (("pairs", pairs), ("multiple", multiple), *([("tokens", tokens)] if tokens is not None else [])):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a positive whole number")


def plan_batches(lengths: Column, pairs: int, tokens: int | None, max_length: int, multiple: int = 1, by_length: bool = True, fixed_shapes: bool = False) -> Column:
    """BATCH: consecutive pairs until the next would exceed ``pairs`` rows or ``tokens`` padded tokens.

    A fold over (length, index) in order; widths round up to ``multiple``, counts to powers of two with
    ``fixed_shapes``. A pair that can't fit alone fails the job.
    """
    check_plan(pairs, tokens, multiple)
    each = F.transform(lengths, lambda n, i: F.struct(round_up(n, multiple, max_length).alias("width"), n.alias("length"), i.alias("index")))
    if by_length:
        each = F.transform(F.array_sort(F.transform(each, lambda e: F.struct(e["length"].alias("length"), e["index"].alias("index"), e["width"].alias("width")))), lambda e: F.struct(e["width"].alias("width"), e["length"].alias("length"), e["index"].alias("index")))
    start = F.struct(F.array().cast(BATCH).alias("done"), F.array().cast("array<int>").alias("indices"), F.lit(0).alias("width"), F.lit(0).alias("padded"))

    def padded(count: Column) -> Column:
        return F.least(F.lit(pairs), next_power_of_two(count)) if fixed_shapes else count

    def step(state: Column, e: Column) -> Column:
        width, count = F.greatest(state["width"], e["width"]), F.size(state["indices"]) + 1
        full = count > pairs if tokens is None else (count > pairs) | (padded(count) * width > tokens)
        close = (F.size(state["indices"]) > 0) & full
        closed = F.array(F.struct(state["indices"].alias("indices"), state["width"].alias("width"), state["padded"].alias("padded")))
        new_width = F.when(close, e["width"]).otherwise(width)
        new_padded = F.when(close, F.lit(1)).otherwise(padded(count))
        if tokens is not None:
            new_width = F.when(new_width * new_padded > tokens, F.raise_error(F.lit("max_batch_tokens cannot fit one padded candidate pair")).cast("int")).otherwise(new_width)
        return F.struct(
            F.when(close, F.concat(state["done"], closed)).otherwise(state["done"]).alias("done"),
            F.when(close, F.array(e["index"])).otherwise(F.concat(state["indices"], F.array(e["index"]))).alias("indices"),
            new_width.alias("width"),
            new_padded.alias("padded"),
        )

    last = lambda s: F.when(F.size(s["indices"]) > 0, F.concat(s["done"], F.array(F.struct(s["indices"].alias("indices"), s["width"].alias("width"), s["padded"].alias("padded"))))).otherwise(s["done"])
    return F.aggregate(each, start, step, last)


class Jumps:
    """Where batches may begin and end in a run of pairs, whichever pair begins one.

    ``widths`` are those of the run's pairs and of up to ``pairs`` - 1 after it. From pair i, the batch holds the ``size[i]`` pairs whose padded tokens fit, and is
    ``width[i]`` wide; so i jumps to i + size[i]. A jump is never longer than ``pairs``.
    """

    def __init__(self, widths: np.ndarray, own: int, pairs: int, tokens: int | None, fixed_shapes: bool):
        self.own = own
        self.size = np.zeros(own, np.int64)
        self.width = np.zeros(own, np.int64)
        wide, fits = np.zeros(own, np.int64), np.ones(own, bool)
        for count in range(1, pairs + 1):
            there = len(widths) - count + 1
            fits[max(0, there) :] = False
            inside = max(0, min(own, there))
            wide[:inside] = np.maximum(wide[:inside], widths[count - 1 : count - 1 + inside])
            if tokens is not None:
                fits &= wide * padded_count(count, pairs, fixed_shapes) <= tokens
            if not fits.any():
                break
            self.size[fits], self.width[fits] = count, wide[fits]
        if own and not self.size.all():
            raise ValueError("max_batch_tokens cannot fit one padded candidate pair")

    def out(self, entries: int) -> list[tuple[int, int, int, int]]:
        """For a batch that begins at each of the first pairs: how far behind the run's end the next one begins after all that begin in the run, how many do, and the last one's size and width.

        From the end to the beginning, a pair's way out is that of the pair it jumps to.
        """
        ways = np.zeros((self.own, 4), np.int64)
        target = np.arange(self.own) + self.size
        for i in range(self.own - 1, -1, -1):
            if target[i] >= self.own:
                ways[i] = target[i] - self.own, 1, self.size[i], self.width[i]
            else:
                ways[i] = ways[target[i]]
                ways[i, 1] += 1
        return [tuple(w) for w in ways[:entries].tolist()]

    def starts(self, entry: int) -> np.ndarray:
        """Where batches begin, if the first does at ``entry``."""
        found = []
        while entry < self.own:
            found.append(entry)
            entry += int(self.size[entry])
        return np.array(found, np.int64)


def padded_count(count: int, pairs: int, fixed_shapes: bool) -> int:
    return min(pairs, 1 << (count - 1).bit_length()) if fixed_shapes else count


PLANNED = "batch long, place int, pairs int, width int, padded int"


def plan_rows(rows: DataFrame, groups: list[str], order: list[str], pairs: int, tokens: int | None, max_length: int, multiple: int = 1, by_length: bool = True, fixed_shapes: bool = False, length: str = "length") -> DataFrame:
    """plan_batches() for groups of any size: ``rows(groups, order, length)``, one for each pair, with PLANNED: its batch (from 0, in its group) and place there, the batch's pairs, width and padded count.

    ``order`` tells a group's pairs apart. Pairs are laid out in ranges of (group, length, order). A batch begins where the one before ends, so
    which pairs begin one is a chain of jumps through the whole group. Every range first says where a chain leaves it, for each of the few pairs at
    which it may come in; these ways are put together over the ranges; then every range follows the chain from where it does come in.
    Each pass takes a range's pairs as arrays of numbers, whatever the group, and the driver holds ``pairs`` entries for each range at most.
    """
    check_plan(pairs, tokens, multiple)
    keys = [*groups, *([length] if by_length else []), *order]
    group = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    rows = rows.select("*", round_up(F.col(length), multiple, max_length).cast("long").alias("_planned_width"), F.to_json(group).alias("_planned_group"))
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_planned_at", F.monotonically_increasing_id())
    laid = materialise(laid)
    narrow = laid.select("_planned_group", "_planned_width", "_planned_at")

    def segments(batches):
        """A range's groups one after the other: (range, group, widths, id of the first pair)."""
        held: list[np.ndarray] = []
        current, first = None, 0
        for batch in batches:
            names, widths, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if names[a] != current:
                    if held:
                        yield first >> 33, current, np.concatenate(held), first
                    held, current, first = [], names[a], int(ids[a])
                held.append(widths[a:b])
        if held:
            yield first >> 33, current, np.concatenate(held), first

    def heads(batches):
        """The first widths of a range's first group, its pairs, and whether the range holds no other group; and its last group."""
        found = list(segments(batches))
        if found:
            (number, name, widths, _), last = found[0], found[-1]
            yield pa.RecordBatch.from_pylist([{"range": number, "first": name, "head": widths[: pairs - 1].tolist(), "n": len(widths), "last": last[1]}], schema=HEAD)

    HEAD = pa.schema([("range", pa.int64()), ("first", pa.string()), ("head", pa.list_(pa.int64())), ("n", pa.int64()), ("last", pa.string())])
    ranges = sorted(narrow.mapInArrow(heads, "range long, first string, head array<long>, n long, last string").collect(), key=lambda r: r["range"])
    # what follows a range's last pair in its group
    ahead: dict[int, list[int]] = {}
    follows: list[int] = []
    for this, after in zip(reversed(ranges), [None, *reversed(ranges)], strict=False):
        if after is None or after["first"] != this["last"]:
            follows = []
        else:
            whole = after["first"] == after["last"]
            follows = [*after["head"], *(follows if whole and after["n"] < pairs - 1 else [])][: pairs - 1]
        ahead[this["range"]] = follows

    def jumps(number: int, widths: np.ndarray, last: bool) -> Jumps:
        return Jumps(np.concatenate([widths, np.array(ahead[number] if last else [], np.int64)]), len(widths), pairs, tokens, fixed_shapes)

    def ways(batches):
        """For a range's first and last group: the ways out of each pair that may begin a batch there."""
        found = list(segments(batches))
        for i, (number, _, widths, _) in enumerate(found):
            if i in (0, len(found) - 1):
                way = jumps(number, widths, i == len(found) - 1).out(pairs if i == 0 else 1)
                yield pa.RecordBatch.from_pylist([{"range": number, "at": i, "n": len(widths), "ways": [list(w) for w in way]}], schema=WAY)

    WAY = pa.schema([("range", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ways", pa.list_(pa.list_(pa.int64())))])
    out_of = {}
    for r in narrow.mapInArrow(ways, "range long, at long, n long, ways array<array<long>>").collect():
        out_of.setdefault(r["range"], []).append((r["at"], r["n"], r["ways"]))
    # by range: where its first group's chain comes in, the batches before, and the batch that its first pairs belong to (place of the first, pairs, width)
    entry: dict[int, tuple[int, int, tuple[int, int, int]]] = {}
    name, state = None, (0, 0, (0, 0, 0))
    for r in ranges:
        comes_in = state if r["first"] == name else (0, 0, (0, 0, 0))
        entry[r["range"]] = comes_in
        own = sorted(out_of[r["range"]])
        at, n, way = own[-1]
        state = comes_in if at == 0 else (0, 0, (0, 0, 0))
        behind, before, (place, size, width) = state
        if behind >= n:
            state = (behind - n, before, (place + n, size, width))
        else:
            left, count, last_size, last_width = way[behind]
            state = (left, before + count, (last_size - left, last_size, last_width))
        name = r["last"]

    def plan(batches):
        found = list(segments(batches))
        for i, (number, _, widths, first) in enumerate(found):
            chain = jumps(number, widths, i == len(found) - 1)
            comes_in, before, (place, size, width) = entry[number] if i == 0 else (0, 0, (0, 0, 0))
            starts = chain.starts(comes_in)
            at = np.arange(len(widths))
            nth = np.searchsorted(starts, at, side="right") - 1
            old = nth < 0
            start = starts[np.maximum(nth, 0)] if len(starts) else np.zeros(len(at), np.int64)
            sizes = np.where(old, size, chain.size[start] if len(starts) else 0)
            padded = np.array([padded_count(int(s), pairs, fixed_shapes) for s in range(pairs + 1)])[sizes]
            columns = [first + at, before + nth, np.where(old, place + at, at - start), sizes, np.where(old, width, chain.width[start] if len(starts) else 0), padded]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], names=["_planned_of", "batch", "place", "pairs", "width", "padded"])

    planned = narrow.mapInArrow(plan, f"_planned_of long, {PLANNED}")
    return laid.join(planned, F.col("_planned_at") == F.col("_planned_of")).drop("_planned_at", "_planned_of", "_planned_width", "_planned_group")


def to_pairs(rows: DataFrame, key: str = "id", candidates: str = "candidates") -> DataFrame:
    """One row for each candidate: its position and text beside the row's other columns."""
    return rows.select("*", F.posexplode(candidates).alias("candidate_index", "candidate"))


def to_rows(pairs: DataFrame, key: str = "id", value: str = "logit") -> DataFrame:
    """key, logits: the candidates' values in their order, whatever order the pairs come in."""
    gathered = F.sort_array(F.collect_list(F.struct("candidate_index", value)))
    return pairs.groupBy(key).agg(F.transform(gathered, lambda p: p[value]).alias("logits"))
