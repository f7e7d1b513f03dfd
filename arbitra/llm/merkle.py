"""A Merkle tree for each part of a table and one over the parts, with every row's proof.

Nodes have a level and a place: the node at place i of level k stands for the leaves from i * f^k on, up to f^k of them, f being the
fan-out. A part of n leaves has ceil(n / f^k) nodes at level k, and the last run of a level may be short; nothing is padded.

1. Every row becomes its leaf, hashed where it lies. Narrow rows are ordered by part and key over ranges, and a row's place in its part
   follows from one count for each range.
2. A mountain-range stack goes over each range: a number in base f whose digits are waiting nodes. A full digit carries, as their parent. What can't carry,
   because its run begins or ends in another range, is a peak and leaves as a node record.
3. Peaks are merged by the nodes they have in common, some levels at a time, so that a group holds the peaks of some ranges only.
4. Each range gets the few nodes of its edges that others hold, and proves its rows: their siblings' hash, and the root that they fold to.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, trimmed

FANOUT = 2
#: Rows of a range, which a task holds with the tree above them.
RANGE_ROWS = 200_000
#: A round of merging brings together what lies below nodes of as many ranges.
SPAN = 32


def digest(said: bytes) -> bytes:
    """The hex text of the sha256 of ``said``; nodes are hex texts throughout."""
    return hashlib.sha256(said).hexdigest().encode()


def widths(leaves: int, fanout: int = FANOUT) -> list[int]:
    """Nodes at each level, from the leaves to the one that is left."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Mountains:
    """The stack over consecutive leaves of one part, wherever in it they begin."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        #: By level: the digits, (place, node) of the nodes whose run isn't over.
        self.digits: list[list[tuple[int, bytes]]] = []
        #: (level, place, node) of what couldn't carry.
        self.peaks: list[tuple[int, int, bytes]] = []

    def _digit(self, level: int) -> list[tuple[int, bytes]]:
        while len(self.digits) <= level:
            self.digits.append([])
        return self.digits[level]

    def _close(self, level: int) -> tuple[int, bytes] | None:
        """Ends the run of a level: its parent if the run was seen from its start, else its nodes are peaks."""
        digit = self._digit(level)
        parent = None
        if digit[0][0] % self.fanout:
            self.peaks += [(level, *node) for node in digit]
        else:
            parent = digit[0][0] // self.fanout, digest(b"".join(node for _, node in digit))
        digit.clear()
        return parent

    def push(self, place: int, node: bytes) -> None:
        level, carried = 0, (place, node)
        while carried:
            self._digit(level).append(carried)
            if carried[0] % self.fanout < self.fanout - 1:
                return
            level, carried = level + 1, self._close(level)

    def finish(self, leaves: int | None) -> list[tuple[int, int, bytes]]:
        """All peaks. ``leaves`` is the size of the part if its last leaf has been pushed: then short runs are over too, up to the root."""
        for level in range(len(widths(leaves, self.fanout)) - 1 if leaves else 0):
            if self._digit(level):
                parent = self._close(level)
                if parent:
                    self._digit(level + 1).append(parent)
        for level, digit in enumerate(self.digits):
            self.peaks += [(level, *node) for node in digit]
            digit.clear()
        return self.peaks


def leaf(fields: list[Column]) -> Column:
    """Binary sha256 of the fields: each `-` if null, else its bytes in UTF-8, a colon and the value."""
    said = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.unhex(F.sha2(F.concat(*said), 256))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Ranges:
    """``rows(part, leaf, ...)`` materialised in ranges of (part, order), with ``range`` and ``at`` (its place there).

    A row's place in its part follows from its range: only a range's first part can have begun in another, and only its
    last can go on. So the driver holds one entry for each range: ``start``, the rows of its first part before it, and ``leaves``, all rows of its last part.
    """

    def __init__(self, rows: DataFrame, order: list[str]):
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        self.rows = rows.count()
        n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.rows // RANGE_ROWS))
        keys = ["part", *order, "_row"]
        placed = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")
        laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*(c for c in rows.columns if c != "_row"), F.spark_partition_id().alias("range"), placed)
        self.laid = cut(laid)
        self.parts = self.laid.groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"))
        edge = F.struct("part", "n")
        found = self.parts.groupBy("range").agg(F.min(edge).alias("first"), F.max(edge).alias("last"), F.count(F.lit(1)).alias("many")).collect()
        self.edges = sorted(found, key=lambda e: e.range)
        self.start: dict[int, int] = {}
        self.leaves: dict[int, int] = {}
        part, reached = None, 0
        for e in self.edges:
            self.start[e.range] = reached if e.first.part == part else 0
            part, reached = e.last.part, e.last.n + (self.start[e.range] if e.many == 1 else 0)
            self.leaves[e.range] = reached
        part, whole = None, 0
        for e in reversed(self.edges):
            if e.last.part == part:
                self.leaves[e.range] = whole
            part, whole = e.first.part, self.leaves[e.range] if e.many == 1 else self.start[e.range] + e.first.n

    def unfinished(self) -> list[tuple[int, str, int, int, int]]:
        """(range, part, place of its first row there, rows there, rows of the part) where a part isn't whole in a range."""
        out = []
        for e in self.edges:
            if e.many > 1 and self.start[e.range]:
                out.append((e.range, e.first.part, self.start[e.range], e.first.n, self.start[e.range] + e.first.n))
            start = self.start[e.range] if e.many == 1 else 0
            if e.last.n < self.leaves[e.range]:
                out.append((e.range, e.last.part, start, e.last.n, self.leaves[e.range]))
        return out


NODE = "part string, leaves long, level int, place long, node string"
NODES = pa.schema([("part", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("node", pa.string())])


def _peaks(ranges: Ranges, fanout: int) -> DataFrame:
    """NODE of every range's peaks. The stack keeps a few nodes for each level, however many rows there are."""
    start, leaves = ranges.start, ranges.leaves

    def run(batches):
        stack, part, own, at = Mountains(fanout), None, None, 0

        def out(whole: int) -> pa.RecordBatch:
            """The peaks of a part of ``whole`` leaves, whose leaves before ``at`` have been seen."""
            found = stack.finish(whole if at == whole else None)
            return _batch([(part, whole, level, place, node.decode()) for level, place, node in found], NODES)

        for batch in batches:
            for key, node, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != part:
                    if part is not None:
                        yield out(at)
                    stack, at = Mountains(fanout), start[number] if part is None else 0
                    part, own = key, number
                stack.push(at, node.hex().encode())
                at += 1
        if part is not None:
            yield out(leaves[own])

    return ranges.laid.select("part", "leaf", "range").mapInArrow(trimmed(run), NODE)


def _merging(fanout: int, top: int):
    """A function of one group's nodes: all nodes that they make, up to level ``top`` or the root."""
    return lambda table: _merge(table, fanout, top)


def _merge(table: pa.Table, fanout: int, top: int) -> pa.Table:
    part, leaves = table.column("part")[0].as_py(), table.column("leaves")[0].as_py()
    sizes = widths(leaves, fanout)
    at: dict[int, dict[int, bytes]] = {}
    for level, place, node in zip(*(table.column(c).to_pylist() for c in ("level", "place", "node")), strict=True):
        at.setdefault(level, {})[place] = node.encode()
    made = []
    for level in range(min(at), min(top, len(sizes) - 1)):
        here = at.get(level, {})
        for parent in sorted({place // fanout for place in here}):
            run = range(parent * fanout, min((parent + 1) * fanout, sizes[level]))
            node = digest(b"".join(here[place] for place in run))
            at.setdefault(level + 1, {})[parent] = node
            made.append((part, leaves, level + 1, parent, node.decode()))
    return pa.Table.from_batches([_batch(made, NODES)])


def _records(ranges: Ranges, fanout: int) -> DataFrame:
    """NODE of all nodes that no single range could carry on: peaks, and what they were merged to, roots included."""
    peaks = cut(_peaks(ranges, fanout))
    if not ranges.edges:
        return peaks
    size = max(1, ranges.rows // len(ranges.edges))
    top = math.ceil(math.log(size * SPAN, fanout))
    highest = len(widths(max(ranges.leaves[e.range] for e in ranges.edges), fanout)) - 1
    records, current = peaks, peaks
    while True:
        below = F.floor(F.col("place") / F.pow(F.lit(float(fanout)), F.lit(top) - F.col("level"))).alias("group")
        made = cut(current.where(F.col("level") < top).select("*", below).groupBy("part", "group").applyInArrow(_merging(fanout, top), NODE))
        records = records.unionByName(made)
        if top >= highest:
            return cut(records)
        # a root below the level stays what it is
        current = current.where(F.col("level") >= top).unionByName(made.where(F.col("level") == top))
        top += max(1, round(math.log(SPAN, fanout)))


def _requests(ranges: Ranges, fanout: int) -> DataFrame:
    """range, part, level, place: the nodes that a range needs of a part that isn't whole in it: those over its edges, with their runs."""

    def run(batches):
        for batch in batches:
            for number, part, start, rows, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = set()
                for level, size in enumerate(widths(leaves, fanout)):
                    span = fanout**level
                    for edge in (start // span, (start + rows - 1) // span):
                        first = edge // fanout * fanout
                        for place in range(first, min(first + fanout, size)):
                            # what lies within the range is made there
                            if place * span < start or min((place + 1) * span, leaves) > start + rows:
                                wanted.add((number, part, level, place))
                yield _batch(sorted(wanted), asked)

    asked = pa.schema([("range", pa.int32()), ("part", pa.string()), ("level", pa.int32()), ("place", pa.int64())])
    session = ranges.laid.sparkSession
    edges = session.createDataFrame(ranges.unfinished(), "range int, part string, start long, rows long, leaves long")
    return edges.mapInArrow(trimmed(run), "range int, part string, level int, place long")


class Slope:
    """The tree over the leaves from ``start`` on, with the nodes ``known`` of others: each leaf's siblings at each level, as what stands before and after it."""

    def __init__(self, nodes: list[bytes], start: int, leaves: int, known: dict[tuple[int, int], bytes], fanout: int):
        self.start, self.fanout = start, fanout
        self.steps: list[tuple[int, list[tuple[bytes, bytes]]]] = []
        first = start
        for level, size in enumerate(widths(leaves, fanout)[:-1]):
            last = first + len(nodes) - 1
            here = lambda place: nodes[place - first] if first <= place <= last else known[level, place]  # noqa: B023, E731
            steps, above = [], []
            for parent in range(first // fanout, last // fanout + 1):
                run = range(parent * fanout, min((parent + 1) * fanout, size))
                if (level + 1, parent) in known and not (first <= run[0] and run[-1] <= last):
                    mine = [place for place in run if first <= place <= last]
                    texts = {place: here(place) for place in run}
                    above.append(known[level + 1, parent])
                else:
                    mine, texts = run, {place: here(place) for place in run}
                    above.append(digest(b"".join(texts.values())))
                for place in mine:
                    steps.append((b"".join(t for p, t in texts.items() if p < place), b"".join(t for p, t in texts.items() if p > place)))
            self.steps.append((first, steps))
            nodes, first = above, first // fanout
        self.root = nodes[0]

    def path(self, place: int) -> list[tuple[bytes, bytes]]:
        out = []
        for first, steps in self.steps:
            out.append(steps[place - first])
            place //= self.fanout
        return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf's hex text and its path give."""
    for before, after in path:
        node = digest(before + node + after)
    return node


PATH = "array<struct<before:string,after:string>>"
EDGE = f"range int, part string, level int, place long, node string, path {PATH}"


def _edges(ranges: Ranges, records: DataFrame, fanout: int) -> DataFrame:
    """EDGE: what each range needs of other ranges' nodes."""
    nodes = records.select(F.col("part").alias("_part"), F.col("level").alias("_level"), F.col("place").alias("_place"), "node")
    met = _requests(ranges, fanout).join(nodes, (F.col("part") == F.col("_part")) & (F.col("level") == F.col("_level")) & (F.col("place") == F.col("_place")))
    return met.select("range", "part", "level", "place", "node", F.lit(None).cast(PATH).alias("path"))


def _per_range(ranges: Ranges, edges: DataFrame, fanout: int, work, out: pa.Schema, schema: str) -> DataFrame:
    """``work(columns, slope, first place, top)`` for every part of every range: rows of ``out`` from its rows' columns, in order."""
    start, leaves = ranges.start, ranges.leaves

    def run(rows: pa.Table, near: pa.Table) -> pa.Table:
        known: dict[str, dict[tuple[int, int], bytes]] = {}
        tops: dict[str, tuple[bytes, list[tuple[bytes, bytes]]]] = {}
        for part, level, place, node, path in zip(*(near.column(c).to_pylist() for c in ("part", "level", "place", "node", "path")), strict=True):
            if path is None:
                known.setdefault(part, {})[level, place] = node.encode()
            else:
                tops[part] = node.encode(), [(step["before"].encode(), step["after"].encode()) for step in path]
        if not rows.num_rows:
            return out.empty_table()
        rows = rows.sort_by("at")
        columns = {c: rows.column(c).to_pylist() for c in rows.column_names}
        parts, own = columns["part"], columns["range"][0]
        bounds = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
        found = []
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            first = start[own] if i == 0 else 0
            whole = leaves[own] if b == len(parts) else first + b - a
            slope = Slope([d.hex().encode() for d in columns["leaf"][a:b]], first, whole, known.get(parts[a], {}), fanout)
            found.append(_batch(work({c: v[a:b] for c, v in columns.items()}, slope, first, tops.get(parts[a])), out))
        return pa.Table.from_batches(found)

    return ranges.laid.groupBy("range").cogroup(edges.groupBy("range")).applyInArrow(run, schema)


class Tree:
    """The trees over ``rows(part, leaf, ...)``, one for each part, in ``order``; ``roots(part, leaves, node)``."""

    def __init__(self, rows: DataFrame, order: list[str], fanout: int = FANOUT):
        ready(rows.sparkSession)
        self.fanout = fanout
        self.ranges = Ranges(cut(rows), order)
        self.records = _records(self.ranges, fanout)
        # what is highest at the first place
        self.roots = self.records.where("place = 0").groupBy("part", "leaves").agg(F.max_by("node", "level").alias("node"))

    def paths(self, name: str) -> DataFrame:
        """name, root, path of every row; small trees only need it, as a path has a row for each level."""
        out = pa.schema([(name, pa.string()), ("root", pa.string()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])

        def work(columns, slope, first, top):
            return [(key, slope.root.decode(), [{"before": a.decode(), "after": b.decode()} for a, b in slope.path(first + i)]) for i, key in enumerate(columns[name])]

        return _per_range(self.ranges, _edges(self.ranges, self.records, self.fanout), self.fanout, work, out, f"{name} string, root string, path {PATH}")


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaves_of(docs: DataFrame, fields: list[str], part: str = "lang", key: str = "doc_id", claims: list[Column] | None = None) -> DataFrame:
    """doc_id, part, leaf and claimed of every row: the digests of ``fields`` and, where they differ, of the ``claims`` that a holder makes of them.

    Parts order as text by bytes; null comes before all.
    """
    own = leaf([F.col(f) for f in fields])
    said = leaf(claims) if claims else F.lit(None).cast("binary")
    named = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), named.alias("part"), own.alias("leaf"), said.alias("claimed"))
    return rows.withColumn("claimed", F.when(F.col("claimed") != F.col("leaf"), F.col("claimed")))


def manifest(tree: Tree) -> DataFrame:
    """part (null as itself), leaves, subroot, root: what a holder of the data set publishes."""
    top = Tree(tree.roots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.unhex("node").alias("leaf")), ["name"], tree.fanout)
    named = F.when(F.col("part") != "", F.substring("part", 2, 1 << 30))
    return tree.roots.join(top.roots.select(F.col("node").alias("root")), F.lit(True)).select(named.alias("part"), "leaves", F.col("node").alias("subroot"), "root")


def prove(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """PROOFS of ``rows(doc_id, part, leaf, claimed)``, as leaves_of() gives them.

    A part's leaves ascend by doc_id (null first), then by digest; subroots, in order of their parts, are the leaves of the tree whose root is
    ``root``. proof_sha256 hashes the siblings' hex texts from the leaf up to the root. folded_root is folded anew from
    what is claimed of a leaf and its siblings; ``verified`` if it is the root. Repeated rows are leaves of their own. No rows: no rows.
    """
    tree = Tree(rows, ["doc_id", "leaf"], fanout)
    top = Tree(tree.roots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.unhex("node").alias("leaf")), ["name"], fanout)
    paths = top.paths("name").withColumnRenamed("name", "_part")
    above = tree.ranges.parts.join(paths, F.col("part") == F.col("_part"))
    edges = _edges(tree.ranges, tree.records, fanout).unionByName(above.select("range", "part", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("place"), F.col("root").alias("node"), "path"))

    def work(columns, slope, first, top):
        root, beyond = top
        found = []
        for i, (doc_id, own, claimed) in enumerate(zip(columns["doc_id"], columns["leaf"], columns["claimed"], strict=True)):
            path = slope.path(first + i) + beyond
            proof = digest(b"".join(a + b for a, b in path)).decode()
            folded = fold((own if claimed is None else claimed).hex().encode(), path)
            found.append((doc_id, own.hex(), slope.root.decode(), root.decode(), proof, folded.decode(), folded == root))
        return found

    out = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    return _per_range(tree.ranges, edges, fanout, work, out, PROOFS)


#: The same over whole trees: every level as a list, every leaf's way up as a recursion.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang,
   [CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END] AS said, n_chars,
   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(0, 8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 7 = 0 AS tampered FROM documents),
 e AS (SELECT *, sha256(said[1] || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || said[2]) AS leaf, CASE WHEN tampered AND n_chars IS NOT NULL THEN sha256(said[1] || strlen((n_chars + 1)::VARCHAR) || ':' || n_chars + 1 || said[2]) END AS claimed FROM d),
 l AS (SELECT doc_id, coalesce('=' || lang, '') AS part, leaf, coalesce(claimed, leaf) AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM e),
 t AS (SELECT part, 0 AS level, list(leaf ORDER BY place) AS nodes FROM l GROUP BY part
  UNION ALL SELECT part, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM t WHERE len(nodes) > 1),
 s AS (SELECT part, nodes[1] AS subroot, row_number() OVER (ORDER BY part) - 1 AS place FROM t WHERE len(nodes) = 1),
 u AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM u WHERE len(nodes) > 1),
 levels AS MATERIALIZED (SELECT part, level, nodes FROM t WHERE len(nodes) > 1 UNION ALL SELECT s.part, u.level + h.height, u.nodes FROM s, u, (SELECT part, max(level) AS height FROM t GROUP BY part) AS h WHERE h.part = s.part AND len(u.nodes) > 1),
 top AS (SELECT part, max(level) AS height FROM t GROUP BY part),
 w AS (SELECT l.part, doc_id, leaf, l.place AS leaf_place, 0 AS level, l.place AS place, claimed AS folded, '' AS proof FROM l
  UNION ALL SELECT w.part, doc_id, leaf, leaf_place, w.level + 1, spot // 2,
   CASE WHEN spot % 2 = 1 THEN sha256(nodes[spot] || folded) ELSE sha256(folded || coalesce(nodes[spot + 2], '')) END, proof || CASE WHEN spot % 2 = 1 THEN nodes[spot] ELSE coalesce(nodes[spot + 2], '') END
  FROM (SELECT w.*, CASE WHEN w.level = top.height THEN s.place ELSE w.place END AS spot FROM w JOIN top USING (part) JOIN s USING (part)) AS w JOIN levels ON levels.part = w.part AND levels.level = w.level),
 f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY part, leaf_place ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = nodes[1] AS verified FROM f JOIN s USING (part), (SELECT nodes FROM u WHERE len(nodes) = 1)"""
