"""Exact top-k inner products by best-first search of paged M-trees.

Vectors become integer vectors, ``floor(scale * x)``, so scores are exact. Equal vectors are one entry with their smallest ids, as no other id of
theirs can be among the best; equal query vectors are one question. Entries are routed to pivots (fitted on a bounded sample;
every vector is indexed) and range-partitioned by pivot and a hash, which splits a pivot of any frequency evenly.
Each run of up to TREE entries of a partition becomes one M-tree: pages of PAGE entries, each entry with its centre,
covering radius, distance to its page's centre and smallest id. No tree grows with the data, only their number does.

For a query q an entry with centre c and radius r holds no score above ``q.c + |q| r``. Where the parent's product is known, ``q.c <= q.p + |q| d(c, p)``
bounds it before q.c is computed, so an entry is dropped for a query by stored distances alone. Queries are searched in blocks:
a page is opened for the queries whose k-th score it may still beat, best bound first.

Queries are rows of the table themselves: each gets a first k-th score from the pivots' sample, whose vectors are entries too, and is answered
by its own tree while that is built. A query then goes only to trees whose root may beat that score, and each tree returns only what does. Ties
are kept by smaller id.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready

SCALE, TOP = 64, 20
PAGE, TREE = 64, 8192
#: Partitions that trees are built in; beyond it a partition builds several trees.
MOST_PARTS = 20_000
#: Rows that the pivots are fitted on, and how many there are.
SAMPLE, PIVOTS = 4096, 64
QUERY_BLOCK = 2048
#: Roots are compared with queries before these are sent out, so many trees at a time (a few MB).
ROOTS = 4096
#: Share of a page's products below which only those that the stored distances leave are computed.
FEW = 0.25
#: Room for rounding in bounds that are computed in floating point; scores themselves are integers.
ROOM = 1e-6
#: A place that no vector has taken: below every score, after every id.
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _split(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size`` that lie near each other: halved again and again along the widest direction."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = points[rows]
        far = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
        away = part[np.argmax(((part - far) ** 2).sum(1))]
        pages = -(-len(rows) // size)
        order = np.argsort(part @ (away - far), kind="stable")
        middle = pages // 2 * size
        todo += [rows[order[:middle]], rows[order[middle:]]]
    return done


class MTree:
    """levels[0] are the entries; entries of level n+1 are pages of level n, whose entries stand together.

    Entry i of the leaves holds ``ids[edges[i]:edges[i + 1]]`` in order, each ``times`` often.
    """

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], times: list[np.ndarray]):
        points, radius = vectors.astype(np.float64), np.zeros(len(vectors))
        least = np.array([own[0] for own in ids], np.int64)
        self.levels: list[dict[str, np.ndarray]] = []
        while True:
            pages = _split(points, PAGE)
            order = np.concatenate(pages)
            points, least, radius = points[order], least[order], radius[order]
            starts = np.concatenate(([0], np.cumsum([len(p) for p in pages])))
            centres = np.add.reduceat(points, starts[:-1], axis=0) / np.diff(starts)[:, None]
            page_of = np.repeat(np.arange(len(pages)), np.diff(starts))
            to_parent = np.sqrt(((points - centres[page_of]) ** 2).sum(1))
            self.levels.append({"points": points, "least": least, "radius": radius, "to_parent": to_parent, "starts": starts, "order": order, "centre": centres})
            if len(pages) == 1:
                break
            radius = np.maximum.reduceat(to_parent + radius, starts[:-1])
            points, least = centres, np.minimum.reduceat(least, starts[:-1])
        leaves = self.levels[0]["order"]
        self.edges = np.concatenate(([0], np.cumsum([len(ids[i]) for i in leaves])))
        self.ids = np.concatenate([ids[i] for i in leaves]).astype(np.int64)
        self.times = np.concatenate([times[i] for i in leaves]).astype(np.int64)
        self._finish()

    def _finish(self) -> None:
        # the page that each entry of an upper level stands for, after that level was put in order
        self.child = [None, *(level["order"] for level in self.levels[1:])]
        top = self.levels[-1]
        self.centre = top["centre"][0]
        self.radius = float((top["to_parent"] + top["radius"]).max())
        self.least = int(top["least"].min())
        #: Products computed, and those of all entries of opened pages.
        self.count = [0, 0]

    def search(self, queries: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, times, score) of each query's best ``k`` ids here, by query row, score and id.

        Only what comes before score ``floor`` with id ``floor_id`` counts, both given or none (NONE). Pages are opened
        best bound first; an open page is worked off for all queries that it may still serve.
        """
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(1))
        wide = norm.max(initial=0) * np.sqrt((self.levels[0]["points"] ** 2).sum(1).max()) >= 2.0**52
        scores, names, entry_of = np.full((len(q), k), NONE), np.full((len(q), k), LAST), np.full((len(q), k), -1)
        scores[:, -1], names[:, -1] = floor, floor_id
        product = q @ self.centre
        bound = product + norm * self.radius
        room = ROOM * (1 + np.abs(bound).max(initial=0))

        def serves(rows, bound, least):
            """Whether something with this bound and no smaller id may come before the query's last place."""
            most, last = np.floor(bound + room), scores[rows, k - 1]
            return (most > last) | ((most == last) & (least < names[rows, k - 1]))

        heap = [(-float(bound.max(initial=0)), 0, len(self.levels) - 1, 0, np.arange(len(q)), product, bound, self.least)]
        made = 1
        while heap:
            _, _, level, page, rows, product, bound, least = heapq.heappop(heap)
            kept = serves(rows, bound, least)
            rows, product = rows[kept], product[kept]
            if not len(rows):
                continue
            node = self.levels[level]
            a, b = node["starts"][page], node["starts"][page + 1]
            reach = node["to_parent"][a:b] + node["radius"][a:b]
            # what stored distances leave of the page, for each query
            may = product[:, None] + norm[rows][:, None] * reach + room >= scores[rows, k - 1][:, None]
            self.count[1] += may.size
            few = np.count_nonzero(may) < FEW * may.size
            self.count[0] += np.count_nonzero(may) if few else may.size
            points = node["points"][a:b]
            if few:
                values = np.full(may.shape, -np.inf)
                i, j = np.nonzero(may)
                values[i, j] = np.einsum("ij,ij->i", q[rows[i]], points[j])
            else:
                values = q[rows] @ points.T
            if level == 0:
                exact = queries[rows] @ points.astype(np.int64).T if wide else np.where(np.isfinite(values), np.rint(values), float(NONE)).astype(np.int64)
                self._merge(rows, exact, node["least"][a:b], np.arange(a, b), scores, names, entry_of, k)
                continue
            bounds = values + norm[rows][:, None] * node["radius"][a:b]
            for j in np.flatnonzero(may.any(0)).tolist():
                least = int(node["least"][a + j])
                kept = serves(rows, bounds[:, j], least)
                if kept.any():
                    heapq.heappush(heap, (-float(bounds[kept, j].max()), made, level - 1, int(self.child[level][a + j]), rows[kept], values[kept, j], bounds[kept, j], least))
                    made += 1
        row, place = np.nonzero(entry_of >= 0)
        return self._ids_of(row, entry_of[row, place], scores[row, place], floor, floor_id, k)

    def _ids_of(self, row, entry, score, floor, floor_id, k):
        """The best ``k`` ids of each query's entries that come before its floor."""
        sizes = self.edges[entry + 1] - self.edges[entry]
        at = np.repeat(self.edges[entry] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        row, score, name = np.repeat(row, sizes), np.repeat(score, sizes), self.ids[at]
        before = (score > floor[row]) | ((score == floor[row]) & (name < floor_id[row]))
        row, score, name, at = row[before], score[before], name[before], at[before]
        order = np.lexsort((name, ~score, row))
        row, score, name, at = row[order], score[order], name[order], at[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], name[kept], self.times[at[kept]], score[kept]

    @staticmethod
    def _merge(rows, values, least, entries, scores, names, entry_of, k):
        """Puts a page's scores into the running best ``k`` entries of its queries, ties by smaller id. Most pages have nothing for most queries."""
        last, last_id = scores[rows, k - 1][:, None], names[rows, k - 1][:, None]
        better = ((values > last) | ((values == last) & (least < last_id))).any(1)
        if not better.any():
            return
        rows, values = rows[better], values[better]
        all_scores = np.concatenate([scores[rows], values], axis=1)
        all_names = np.concatenate([names[rows], np.broadcast_to(least, values.shape)], axis=1)
        all_entries = np.concatenate([entry_of[rows], np.broadcast_to(entries, values.shape)], axis=1)
        best = np.lexsort((all_names, ~all_scores))[:, :k]
        scores[rows] = np.take_along_axis(all_scores, best, 1)
        names[rows] = np.take_along_axis(all_names, best, 1)
        entry_of[rows] = np.take_along_axis(all_entries, best, 1)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, depth=len(self.levels), ids=self.ids, times=self.times, edges=self.edges, **{f"{n}_{k}": v for n, level in enumerate(self.levels) for k, v in level.items()})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data), allow_pickle=False) as saved:
            tree.levels = [{k: saved[f"{n}_{k}"] for k in ("points", "least", "radius", "to_parent", "starts", "order", "centre")} for n in range(int(saved["depth"]))]
            tree.ids, tree.times, tree.edges = saved["ids"], saved["times"], saved["edges"]
        tree._finish()
        return tree


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id, v (array<long>): rows without id, or whose vector is null, empty or holds a null or non-finite component, are left out."""
    value = F.col(vector_column).cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), value.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(finite)
    return found.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def first_floor(questions: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` different entries reach for each question, from a sample of entries; NONE if that has fewer."""
    if len(sample) < k:
        return np.full(len(questions), NONE)
    q, s = questions.astype(np.float64), sample.astype(np.float64)
    wide = np.sqrt((q * q).sum(1).max(initial=0) * (s * s).sum(1).max()) >= 2.0**52
    products = questions @ sample.T if wide else np.rint(q @ s.T).astype(np.int64)
    return np.partition(products, len(sample) - k, axis=1)[:, len(sample) - k]


BUILT = "tree long, ask long, data binary, centre array<double>, radius double, v array<long>, floor long, floor_id long, names array<long>, times array<long>, scores array<long>"


def built_rows(n: int, **given) -> pd.DataFrame:
    """``n`` rows of BUILT; what isn't given is null."""
    return pd.DataFrame({c: given.get(c, [None] * n) for c in (f.split()[0] for f in BUILT.split(", "))})


def _entries(vectors: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """v, ids, times, ask: each distinct vector with its ``k`` smallest ids, how often each occurs, and its question if it is one.

    Counting and ranking have partial sums and limits, so a vector of any frequency sends at most ``k`` rows from each task.
    """
    counted = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("_row", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_row") <= k)
    held = ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("own"))
    return held.join(asks, "v", "left").select("v", F.transform("own", lambda x: x["vec_id"]).alias("ids"), F.transform("own", lambda x: x["n"]).alias("times"), "ask")


def top_k(rows: DataFrame, k: int = TOP, every: int = 20, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``k`` best others by integer inner product.

    Ties go to the smaller id. Fewer than ``k`` others: all of them. Rows with a null id, or whose vector is null, empty or
    holds a null or non-finite component, take no part. A shorter vector counts as filled with zeros. Rows with the query's own id
    are left out; another id's repeated rows are candidates each; a repeated query id is answered once, for its smallest vector.
    No rows: no rows. Other columns are ignored. Scores must stay below 2**63.
    """
    ready(rows.sparkSession)
    vectors = cut(integer_vectors(rows, id_column, vector_column, scale))
    total, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    padded = vectors.select("vec_id", F.when(F.size("v") < width, F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))).otherwise(F.col("v")).alias("v"))
    # the query's own id is found too, once for each of its different vectors, and goes at the end
    kinds = padded.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.lit(1).alias("one")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("kinds"), F.min("v").alias("v"))
    queries = cut(kinds.select(F.col("vec_id").alias("query_id"), "v", "kinds"))
    most = k + (queries.agg(F.max("kinds")).first()[0] or 0)
    # a question has the smallest id among the queries of its vector
    asks = cut(queries.groupBy("v").agg(F.min("query_id").alias("ask")))
    entries = cut(_entries(padded, asks, most))
    distinct = entries.count()
    sample = np.array([r.v for r in entries.orderBy(F.xxhash64("v"), "v").select("v").limit(SAMPLE).collect()], np.int64)
    pivots = sample[:: max(1, len(sample) // PIVOTS)][:PIVOTS].astype(np.float64)
    half = (pivots**2).sum(1) / 2

    def route(frames):
        for frame in frames:
            if len(frame):
                nearest = np.argmax(_matrix(frame["v"]) @ pivots.T - half, axis=1)
                yield frame.assign(pivot=nearest.astype(np.int32))

    half_tree = TREE // 2
    parts = -(-distinct // (half_tree * max(1, distinct // (half_tree * MOST_PARTS))))
    routed = entries.mapInPandas(route, "v array<long>, ids array<long>, times array<long>, ask long, pivot int")
    laid = cut(routed.repartitionByRange(parts, "pivot", F.xxhash64("v"), "v").sortWithinPartitions("pivot", "v"))

    def build(frames):
        """Trees, and the answers that their own questions find in them."""
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def trees(frame):
            values = _matrix(frame["v"])
            tree = MTree(values, [np.asarray(x, np.int64) for x in frame["ids"]], [np.asarray(x, np.int64) for x in frame["times"]])
            key = part << 32 | number
            yield built_rows(1, tree=[key], data=[tree.to_bytes()], centre=[tree.centre], radius=[tree.radius])
            asked = np.flatnonzero(frame["ask"].notna().to_numpy())
            for at in range(0, len(asked), QUERY_BLOCK):
                own = asked[at : at + QUERY_BLOCK]
                floor = first_floor(values[own], sample, most)
                row, name, times, score = tree.search(values[own], floor, np.full(len(own), LAST), most)
                edges = np.searchsorted(row, np.arange(len(own) + 1))
                full, last = np.diff(edges) == most, np.maximum(edges[1:] - 1, 0)
                parted = lambda x: [x[b:e] for b, e in zip(edges[:-1], edges[1:], strict=True)]  # noqa: B023, E731
                yield built_rows(
                    len(own), tree=[key] * len(own), ask=frame["ask"].to_numpy()[own].astype(np.int64), v=list(values[own]), floor=np.where(full, score[last], floor) if len(score) else floor,
                    floor_id=np.where(full, name[last], LAST) if len(score) else LAST, names=parted(name), times=parted(times), scores=parted(score),
                )

        for frame in frames:
            while len(frame):
                piece, frame = frame.iloc[: TREE - size], frame.iloc[TREE - size :]
                held.append(piece)
                size += len(piece)
                if size == TREE:
                    yield from trees(pd.concat(held))
                    held, size, number = [], 0, number + 1
        if held:
            yield from trees(pd.concat(held))

    built = cut(laid.select("v", "ids", "times", "ask").mapInPandas(build, BUILT))
    asked = built.where("ask is not null").select(F.col("tree").alias("home"), "ask", "v", "floor", "floor_id", "names", "times", "scores")
    trees = built.where("data is not null").select("tree", "data")
    sent = _sent(asked, built.where("data is not null").select("tree", "centre", "radius"))
    # a tree is copied for each block of questions that it may serve, so that either side of a task is bounded
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int"))
    held = sent.select(F.col("there").alias("tree"), "block").distinct().join(trees, "tree")

    def answer(questions, tree):
        if not len(tree) or not len(questions):
            return pd.DataFrame({"ask": [], "vec_id": [], "times": [], "score": []}).astype("int64")
        questions = questions.sort_values("ask", ignore_index=True)
        row, name, times, score = MTree.from_bytes(tree["data"].iloc[0]).search(_matrix(questions["v"]), questions["floor"].to_numpy(np.int64), questions["floor_id"].to_numpy(np.int64), most)
        return pd.DataFrame({"ask": questions["ask"].to_numpy(np.int64)[row], "vec_id": name, "times": times, "score": score})

    held = held.select(F.col("tree").alias("tree_no"), F.col("block").alias("block_no"), "data")
    elsewhere = sent.groupBy("there", "block").cogroup(held.groupBy("tree_no", "block_no")).applyInPandas(answer, "ask long, vec_id long, times long, score long")
    here = asked.select("ask", F.explode(F.arrays_zip("names", "times", "scores")).alias("z")).select("ask", F.col("z.names").alias("vec_id"), F.col("z.times").alias("times"), F.col("z.scores").alias("score"))
    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    ranked = here.unionByName(elsewhere).withColumn("_row", F.row_number().over(best)).where(F.col("_row") <= most)
    answers = ranked.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_"), "vec_id", "times", "score"))).alias("best"))
    others = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    each = F.flatten(F.transform(others, lambda x: F.array_repeat(x, F.least(x["times"], F.lit(k)).cast("int"))))
    mine = queries.join(asks, "v").select("query_id", "ask").join(answers, "ask")
    placed = mine.select("query_id", F.posexplode(F.slice(each, 1, k)).alias("place", "x"))
    return placed.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _sent(asked: DataFrame, roots: DataFrame) -> DataFrame:
    """ask, v, floor, floor_id, there: each question with every other tree whose root may hold what comes before its floor.

    Roots are read ROOTS at a time, so that what a task holds is bounded whatever the number of trees.
    """
    numbers = sorted(r.tree for r in roots.select("tree").collect())
    schema = "ask long, v array<long>, floor long, floor_id long, there long"
    out = None
    for at in range(0, len(numbers), ROOTS):
        chosen = roots.where(F.col("tree").between(numbers[at], numbers[min(at + ROOTS, len(numbers)) - 1])).orderBy("tree").collect()
        tree = np.array([r.tree for r in chosen], np.int64)
        centre, radius = np.array([r.centre for r in chosen]), np.array([r.radius for r in chosen])

        def send(frames, tree=tree, centre=centre, radius=radius):
            for frame in frames:
                for begin in range(0, len(frame), 256):
                    piece = frame.iloc[begin : begin + 256]
                    q = _matrix(piece["v"]).astype(np.float64)
                    bound = q @ centre.T + np.sqrt((q * q).sum(1))[:, None] * radius
                    room = ROOM * (1 + np.abs(bound).max(initial=0))
                    row, there = np.nonzero((bound + room >= piece["floor"].to_numpy(np.float64)[:, None]) & (piece["home"].to_numpy()[:, None] != tree))
                    if len(row):
                        found = piece.iloc[row]
                        yield pd.DataFrame({"ask": found["ask"].to_numpy(), "v": found["v"].to_numpy(), "floor": found["floor"].to_numpy(), "floor_id": found["floor_id"].to_numpy(), "there": tree[there]})

        part = asked.select("home", "ask", "v", "floor", "floor_id").mapInPandas(send, schema)
        out = part if out is None else out.unionByName(part)
    return out
