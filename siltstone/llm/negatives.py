"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x gains the component sqrt(M^2 - |x|^2), M the largest norm, and a query q a
zero: then |q - x|^2 = |q|^2 + M^2 - 2 qx, so high inner products are small distances
and a window of scores is an annulus around the query. A tree cuts rows at the median
distance to a vantage point, again and again; from the distances of a query to the
vantage points on the way to a leaf follow a least and a most distance of its rows. A
query visits the leaves whose range meets its annulus, nearest first, and ends when
the next one cannot hold a row before its k-th. Scores are exact integers; distances
only decide what to visit, with some slack.

Rows are routed by a tree over a bounded sample, so that a task's rows lie near each
other; a task builds trees over some of its rows at a time, and queries go out in
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import settle, ship

#: Positives of an anchor and negatives of a pair; least score of a negative in percent of the positive's; factor of components.
POSITIVES, NEGATIVES, LEAST, SCALE = 5, 5, 80, 256
#: Every so many ids an anchor; ids whose label is moved on; labels.
ANCHORS, MOVED, LABELS = 100, 7, 10
#: Rows of a leaf; sampled rows of the routing tree; bytes of the vectors of one tree, and of the queries of one block; queries at a time.
LEAF, SAMPLE, TREE_BYTES, BLOCK_BYTES, LANES = 64, 4096, 1 << 24, 1 << 24, 256
#: Squared norms from here on have scores that are no longs, or products that a double does not hold.
_LONG, _EXACT = 1 << 62, 1 << 52
_NONE = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, q): the rows that take part, components times SCALE rounded down, labels of ids divisible by MOVED moved on.

    Rows without id, label or vector, with a component that is null or not finite, or
    with a squared norm of 2^62 or more (its score is no long) take no part. Whole
    repeats are one row.
    """
    x = F.col(embedding)
    number = lambda c: c.cast("double")
    wrong = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(number(c)) == float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).filter(~wrong)
    q = F.transform(x, lambda c: F.floor(number(c) * SCALE).cast("double"))
    norm = F.aggregate(q, F.lit(0.0), lambda a, c: a + c * c)
    moved = F.when(F.col(key) % MOVED == 0, (F.col(label) + 1) % LABELS).otherwise(F.col(label))
    return rows.select(F.col(key).cast("long").alias("id"), moved.cast("long").alias("label"), q.alias("q"), norm.alias("norm")).filter(F.col("norm") < float(_LONG)).distinct()


class Tree:
    """A vantage-point tree over augmented vectors, with ranges of distances for each leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaves: list[np.ndarray] = []
        self.pivots: list[int] = []
        self.cuts: list[tuple[float, int, int]] = []
        paths: list[list[tuple[int, float, float]]] = []
        norms = np.einsum("ij,ij->i", points, points)

        def distances(rows: np.ndarray, to: int) -> np.ndarray:
            return np.sqrt(np.maximum(norms[rows] + norms[to] - 2 * (points[rows] @ points[to]), 0))

        # (rows, path, where to say that this part is: cut and side)
        stack = [(np.arange(len(points)), [], None)]
        while stack:
            rows, path, above = stack.pop()
            away = None
            if len(rows) > leaf:
                pivot = int(rows[np.argmax(distances(rows, int(rows[0])))])
                away = distances(rows, pivot)
            if away is None or away.max() == 0:
                # One point many times is not cut by distance, but into leaves of bounded size.
                for a in range(0, max(len(rows), 1), leaf):
                    if above and a == 0:
                        self._link(above, -len(self.leaves) - 1)
                    self.leaves.append(rows[a : a + leaf])
                    paths.append(path)
                continue
            order = np.argsort(away, kind="stable")
            half = len(rows) // 2
            at, here = len(self.pivots), len(self.cuts)
            self.pivots.append(pivot)
            self.cuts.append((float(away[order[half]]), 0, 0))
            if above:
                self._link(above, here)
            for side, part in enumerate((order[:half], order[half:])):
                stack.append((rows[part], [*path, (at, float(away[part].min()), float(away[part].max()))], (here, side)))
        depth = max(map(len, paths), default=0)
        # A leaf's path is filled up with a range that says nothing.
        self.on = np.zeros((len(paths), depth), np.int64)
        self.low = np.full((len(paths), depth), -np.inf)
        self.high = np.full((len(paths), depth), np.inf)
        for i, path in enumerate(paths):
            for t, (at, low, high) in enumerate(path):
                self.on[i, t], self.low[i, t], self.high[i, t] = at, low, high

    def _link(self, above: tuple[int, int], to: int) -> None:
        radius, near, far = self.cuts[above[0]]
        self.cuts[above[0]] = (radius, to, far) if above[1] == 0 else (radius, near, to)

    def _to_pivots(self, queries: np.ndarray, squares: np.ndarray) -> np.ndarray:
        pivots = self.points[self.pivots]
        return np.sqrt(np.maximum(squares[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * (queries @ pivots.T), 0))

    def ranges(self, queries: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) distance of each query to the rows of each leaf."""
        least, most = np.zeros((len(queries), len(self.leaves))), np.full((len(queries), len(self.leaves)), np.inf)
        if self.pivots:
            away = self._to_pivots(queries, squares)
            for t in range(self.on.shape[1]):
                d = away[:, self.on[:, t]]
                np.maximum(least, np.maximum(d - self.high[:, t], self.low[:, t] - d), out=least)
                np.minimum(most, d + self.high[:, t], out=most)
        return least, most

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point would be in."""
        out = np.zeros(len(points), np.int64)
        if not self.cuts:
            return out
        away = self._to_pivots(points, np.einsum("ij,ij->i", points, points))
        at = np.zeros(len(points), np.int64)
        radius, near, far = (np.array(x) for x in zip(*self.cuts, strict=True))
        while (at >= 0).any():
            live = np.flatnonzero(at >= 0)
            node = at[live]
            at[live] = np.where(away[live, node] < radius[node], near[node], far[node])
        return -at - 1


def augmented(q: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that gives all of them the norm sqrt(most)."""
    return np.column_stack([q, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", q, q), 0))])


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of one width; missing components are zero."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    edge = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(edge, size)] = flat
    return out


class Best:
    """The k first rows of each query so far, by score and id."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), _NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """For the queries ``who`` a row of scores each (_NONE: no candidate) of the rows ``ids``."""
        last, last_id = self.score[who, -1:], self.id[who, -1:]
        some = ((score > last) | ((score == last) & (ids < last_id) & (score != _NONE))).any(1)
        who, score = who[some], score[some]
        if len(who):
            scores = np.concatenate([self.score[who], score], 1)
            names = np.concatenate([self.id[who], np.broadcast_to(ids, score.shape)], 1)
            # Least first: the complement of a score reverses the order without overflow.
            order = np.lexsort((names, ~scores), axis=1)[:, : self.k]
            self.score[who] = np.take_along_axis(scores, order, 1)
            self.id[who] = np.take_along_axis(names, order, 1)


class Queries:
    """Queries of one block: which anchor each is, least and most score, and whether the label shall be its own or another."""

    def __init__(self, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        (self.ids, self.labels, self.q), self.at, self.low, self.high, self.same = anchors, at, low, high, same

    def __len__(self) -> int:
        return len(self.at)


def search(tree: Tree, rows: tuple[np.ndarray, np.ndarray, np.ndarray], queries: Queries, most: float, best: Best) -> None:
    """Bring the rows (ids, labels, vectors) of a tree into the bests of the queries, leaves nearest first."""
    ids, labels, q = rows
    exact = most < _EXACT
    whole = None if exact else q.astype(np.int64)
    for a in range(0, len(queries), LANES):
        b = min(a + LANES, len(queries))
        anchor = queries.at[a:b]
        own = queries.q[anchor]
        squares = np.einsum("ij,ij->i", own, own)
        slack = 1e-6 * (np.sqrt(squares) + np.sqrt(most))
        inner = np.sqrt(np.maximum(squares + most - 2 * queries.high[a:b].astype(float), 0)) - slack
        outer = np.sqrt(np.maximum(squares + most - 2 * queries.low[a:b].astype(float), 0)) + slack
        least, far = tree.ranges(np.column_stack([own, np.zeros(b - a)]), squares)
        least = np.where((least > outer[:, None]) | (far < inner[:, None]), np.inf, np.maximum(least, inner[:, None]))
        order = np.argsort(least, axis=1, kind="stable")
        live = np.arange(b - a)
        for turn in range(len(tree.leaves)):
            kth = best.score[a + live, -1]
            limit = np.sqrt(np.maximum(squares[live] + most - 2 * np.maximum(kth, queries.low[a + live]).astype(float), 0)) + slack[live]
            # Later leaves of a query are not nearer, so it has ended.
            live = live[least[live, order[live, turn]] <= limit]
            if not len(live):
                break
            leaf = order[live, turn]
            by = np.argsort(leaf, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                who = live[part]
                members = tree.leaves[leaf[part[0]]]
                if exact:
                    score = (own[who] @ q[members].T).astype(np.int64)
                else:
                    score = own[who].astype(np.int64) @ whole[members].T
                fits = (labels[members] == queries.labels[anchor[who], None]) == queries.same
                if queries.same:
                    fits &= ids[members] != queries.ids[anchor[who], None]
                fits &= (score >= queries.low[a + who, None]) & (score <= queries.high[a + who, None])
                best.add(a + who, np.where(fits, score, _NONE), ids[members])


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of the negatives of positives with these scores: none where the score is below zero."""
    return LEAST * (score // 100) - (-LEAST * (score % 100)) // 100, score


def first_copies(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but those after the k least ids of one vector and label: these come before them for every query."""
    body = np.ascontiguousarray(q).view(np.dtype((np.void, q.shape[1] * 8))).ravel()
    same = np.unique(body, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, labels, same))
    edge = np.concatenate(([True], (np.diff(same[order]) != 0) | (np.diff(labels[order]) != 0)))
    begin = np.flatnonzero(edge)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (ids, labels, vectors) of some batches at a time, TREE_BYTES of vectors about."""
    most = max(1024, TREE_BYTES // (8 * (width + 1)))
    kept: list[pa.RecordBatch] = []
    n = 0

    def stacked():
        return np.concatenate([x.column(0).to_numpy() for x in kept]), np.concatenate([x.column(1).to_numpy() for x in kept]), np.concatenate([padded(x.column(2), width) for x in kept])

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            if kept and n + piece.num_rows > most:
                yield stacked()
                kept, n = [], 0
            kept.append(piece)
            n += piece.num_rows
    if kept:
        yield stacked()


_FOUND = T.StructType().add("query", "long").add("id", "long").add("score", "long")


def _nearest(rows: DataFrame, queries: Queries, width: int, most: float, k: int) -> DataFrame:
    """(query, id, score): of each task the first k rows of each query, which is known by its place in the block."""
    index = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for ids, labels, q in _chunks(batches, width):
            # One more than k, as an anchor may be among its own copies.
            some = first_copies(ids, labels, q, k + 1)
            ids, labels, q = ids[some], labels[some], q[some]
            best = best or Best(len(index.value), k)
            search(Tree(augmented(q, most)), (ids, labels, q), index.value, most, best)
        if best:
            who, place = np.nonzero(best.score != _NONE)
            for a in range(0, len(who), 1 << 16):
                w, p = who[a : a + (1 << 16)], place[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(best.id[w, p]), pa.array(best.score[w, p])], _FOUND.names)

    found = rows.select("id", "label", "q").mapInArrow(run, _FOUND)
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _routed(rows: DataFrame, width: int, most: float) -> DataFrame:
    """Rows dealt by the leaf that a tree over SAMPLE rows leads them to; a leaf with many rows fills several tasks."""
    spark = rows.sparkSession
    some = rows.orderBy(F.xxhash64("id", "label")).limit(SAMPLE).select("q").toArrow().column(0).combine_chunks()
    n = rows.count()
    parts = max(1, min(-(-n // 8192), max(spark.sparkContext.defaultParallelism * 4, n >> 17)))
    tree = spark.sparkContext.broadcast(Tree(augmented(padded(some, width), most), LEAF))
    schema = T.StructType([*rows.select("id", "label", "q").schema.fields, T.StructField("cell", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.value.route(augmented(padded(batch.column(2), width), most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], schema.names)

    return rows.select("id", "label", "q").mapInArrow(run, schema).repartitionByRange(parts, "cell", F.xxhash64("id", "label"))


def mine(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    Anchors are the rows whose id is divisible by ANCHORS, positives of an anchor its
    ``positives`` first rows of its label with another id, negatives of a pair the
    ``negatives`` first rows of another label with LEAST percent of the positive's score
    or more, and not above it; first is by higher score, then smaller id. Which rows
    take part is said in ``prepared``. Rows that share an id but differ are rows each,
    and ids are given once for each. Shorter vectors count as filled with zeros. A
    label, or one vector, may hold most rows. Other columns are not read; an empty
    table, or one without anchors, gives no rows.
    """
    spark = ship(vectors.sparkSession)
    rows = settle(prepared(vectors, key, embedding, label), "vectors")
    width, most = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    width = max(width, 1)
    dealt = settle(_routed(rows, width, most), "routed", release=True)
    anchors = rows.filter(F.col("id") % ANCHORS == 0).select("id", "label", "q")
    per = max(1, BLOCK_BYTES // (8 * width))
    blocks = 1 + anchors.count() // per
    out = None
    for b in range(blocks):
        asked = (anchors if blocks == 1 else anchors.filter(F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        n = asked.num_rows
        ids, labels = (asked.column(i).to_numpy() for i in (0, 1))
        q = padded(asked.column(2).combine_chunks() if n else pa.array([], pa.list_(pa.float64())), width)
        own = (ids, labels, q)
        everything = Queries(own, np.arange(n), np.full(n, _NONE + 1), np.full(n, np.iinfo(np.int64).max), True)
        found = _nearest(dealt, everything, width, most, positives).toArrow().combine_chunks()
        who, positive, score = (found.column(c).to_numpy() for c in ("query", "id", "score"))
        # Equal scores of an anchor have one window.
        pair, place = np.unique(np.stack([who, score]), axis=1, return_inverse=True)
        low, high = window(pair[1])
        near = _nearest(dealt, Queries(own, pair[0], low, high, False), width, most, negatives)
        pairs = pa.table({"query": pa.array(place.reshape(-1).astype(np.int64)), "anchor_id": ids[who], "positive_id": positive, "positive_score": score})
        pairs = settle(spark.createDataFrame(pairs, T.StructType([T.StructField(c, T.LongType()) for c in pairs.column_names])), "pairs", few=True)
        part = near.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id").join(pairs, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        part = part if blocks == 1 else settle(part, "negatives", release=True)
        out = part if out is None else out.unionByName(part)
    return out


SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
