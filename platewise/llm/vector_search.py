"""Exact top-k search by inner product: ball-tree branch and bound per shard.

The upper levels of a ball tree are split from a bounded sample (SAMPLE vectors) on the driver; every vector descends them to a
leaf, so near vectors share one. Each leaf has a centre, from the sample, and a radius that covers all of its vectors. Leaves
of more than SHARD_ROWS vectors are cut into shards by a hash, so a task never holds more than one shard of bounded size.

A query first searches the leaf that it lies nearest to by bound, which gives it a k-th score. It is then sent only to leaves
whose upper bound q.c + |q| r on the inner product reaches that score. In a shard's task the vectors come first, a ball tree
is built from them once, and the queries that were sent stream through it in blocks, branch and bound by the same upper bound
and the current k-th score. Scores below a query's known k-th score are never sent on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.llm.common import cut, table

SHARD_ROWS, BLOCK_QUERIES, LEAF = 16_384, 1_024, 256
SCALE = 64

#: Vectors that the upper levels are split from, the fewest of them in a leaf, and the most leaves.
SAMPLE, LEAF_SAMPLE, MOST_LEAVES = 65_536, 16, 2_048


class Ball:
    __slots__ = ("center", "radius", "least", "rows", "parts")

    def __init__(self, ids: np.ndarray, points: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.center = own.mean(axis=0)
        self.radius = float(np.sqrt(((own - self.center) ** 2).sum(axis=1).max()))
        self.least, self.rows, self.parts = int(ids[rows].min()), rows, ()
        if len(rows) > LEAF:
            order = np.argsort(own @ _direction(own, self.center), kind="stable")
            half = len(rows) // 2
            self.parts = (Ball(ids, points, rows[order[:half]]), Ball(ids, points, rows[order[half:]]))
            self.rows = None


def _direction(own: np.ndarray, center: np.ndarray) -> np.ndarray:
    """From one far point to another."""
    one = own[((own - center) ** 2).sum(axis=1).argmax()]
    two = own[((own - one) ** 2).sum(axis=1).argmax()]
    return two - one


def _slack(bound: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """An upper bound raised by more than it can be rounded."""
    return bound + 1e-6 * (np.abs(bound) + reach + 1)


class Upper:
    """The upper levels: a binary tree of directions and thresholds with numbered leaves, each with a centre."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.splits: list[tuple[np.ndarray, float, int, int]] = []
        self.centers: list[np.ndarray] = []
        self.top = self._split(points, leaves)
        self.centers = np.array(self.centers)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        """Number of a split, or -1 - the number of a leaf."""
        if leaves > 1 and len(points) >= 2 * LEAF_SAMPLE:
            way = _direction(points, points.mean(axis=0))
            along = points @ way
            edge = float(np.median(along))
            right = along > edge
            if right.any() and not right.all():
                at = len(self.splits)
                self.splits.append(())
                self.splits[at] = (way, edge, self._split(points[~right], leaves // 2), self._split(points[right], leaves - leaves // 2))
                return at
        self.centers.append(points.mean(axis=0))
        return -len(self.centers)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), np.int64)
        stack = [(self.top, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            if at < 0:
                found[rows] = -at - 1
            elif len(rows):
                way, edge, left, right = self.splits[at]
                beyond = points[rows] @ way > edge
                stack += [(left, rows[~beyond]), (right, rows[beyond])]
        return found


def top_k(tree: Ball, ids: np.ndarray, points: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, exact_queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k (ids, scores) per query among the points but the query's own, by score and then least id.

    ``points`` and ``queries`` are doubles, for bounds; scores are taken from ``exact`` ones, doubles or longs as they need.
    ``floor``: scores below it need not be found. Empty places have the least score of the type.
    """
    low = -np.inf if exact.dtype == np.float64 else np.iinfo(np.int64).min
    best = np.full((len(queries), k), low, exact.dtype)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    norms = np.sqrt((queries**2).sum(axis=1))
    stack = [(tree, np.arange(len(queries)))]
    while stack:
        ball, asking = stack.pop()
        reach = norms[asking] * ball.radius
        bound = _slack(queries[asking] @ ball.center + reach, reach)
        kth = best[asking, -1].astype(np.float64)
        asking = asking[(bound >= floor[asking]) & ((bound > kth) | (bound == kth) & (ball.least < who[asking, -1]))]
        if not len(asking):
            continue
        if ball.parts:
            near = sorted(ball.parts, key=lambda b: float((queries[asking] @ b.center).sum()))
            stack += [(b, asking) for b in near]
            continue
        scores = exact_queries[asking] @ exact[ball.rows].T
        own = ids[ball.rows]
        scores[(query_ids[asking][:, None] == own[None, :]) | (scores < floor[asking][:, None])] = low
        better = (scores > best[asking, -1:]) | (scores == best[asking, -1:]) & (own[None, :] < who[asking, -1:]) & (scores > low)
        some = better.any(axis=1)
        if some.any():
            asking, scores = asking[some], np.where(better[some], scores[some], low)
            every = np.concatenate([best[asking], scores], axis=1)
            names = np.concatenate([who[asking], np.broadcast_to(own, scores.shape)], axis=1)
            order = np.lexsort((names, np.invert(every) if every.dtype == np.int64 else -every), axis=-1)[:, :k]
            best[asking], who[asking] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
    return who, best


FOUND = "query_id long, vec_id long, score long, kth long"
DEALT = "dim int, leaf long, shard long, asks boolean, ident long, v array<double>, floor double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _search(batches: Iterator[pa.RecordBatch], k: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of (dim, leaf, shard, asks): a shard's vectors, then its queries. ``whole``: scores need longs."""
    number = np.int64 if whole else np.float64
    key = tree = ids = points = exact = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        shape = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in shape], axis=0)) + 1
        for start, stop in zip([0, *edges], [*edges, len(batch)], strict=True):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            mine, asks = tuple(int(x[start]) for x in shape[:3]), bool(shape[3][start])
            if mine != key:
                key, tree, held = mine, None, []
            own_ids, vectors = part.column("ident").to_numpy(), _matrix(part.column("v"))
            if not asks:
                held.append((own_ids, vectors))
                continue
            if not held:
                continue
            if tree is None:
                ids, points = (np.concatenate(x) for x in zip(*held, strict=True))
                exact, tree = points.astype(number), Ball(ids, points, np.arange(len(ids)))
            for i in range(0, len(own_ids), BLOCK_QUERIES):
                block = slice(i, i + BLOCK_QUERIES)
                queries, floor = vectors[block], part.column("floor").to_numpy()[block]
                who, best = top_k(tree, ids, points, exact, own_ids[block], queries, queries.astype(number), floor, k)
                there = best > (np.iinfo(np.int64).min if whole else -np.inf)
                row, at = np.nonzero(there)
                full = there[:, -1]
                kth = pa.array(np.where(full, best[:, -1], 0).astype(np.int64)[row], mask=~full[row])
                yield pa.RecordBatch.from_arrays([pa.array(own_ids[block][row]), pa.array(who[row, at]), pa.array(best[row, at].astype(np.int64)), kth], ["query_id", "vec_id", "score", "kth"])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(ident, v, norm2): components floor(scale * x) of the vectors whose components are all finite numbers, and their squares' sum.

    Vectors whose squares sum to 2^62 or more are left out: their scores may fit no long. (No score exceeds the product of the norms.)
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0)
    fine &= F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("ident"), v.alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).where(F.col("norm2") < 2.0**62)


def _leaves(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Adds leaf and far, the distance from its centre, to rows (ident, v, dim)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        leaf, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            points, upper = _matrix(batch.column("v").take(pa.array(rows))), shared.value[d]
            leaf[rows] = upper.leaf_of(points)
            far[rows] = np.sqrt(((points - upper.centers[leaf[rows]]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(far)], [*batch.schema.names, "leaf", "far"])


def _route(batches: Iterator[pa.RecordBatch], shared, home: bool) -> Iterator[pa.RecordBatch]:
    """Sends queries (ident, v, dim[, floor, done]) to the leaf of the greatest bound, or to all others that may beat the floor.

    The shared value has, per dimension, the numbers, centres, radii and shards of the leaves that have vectors.
    """
    names = ["dim", "leaf", "shards", "ident", "v", "floor"]
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            part = batch.take(pa.array(rows))
            queries = _matrix(part.column("v"))
            numbers, centers, radii, shards = shared.value[d]
            for i in range(0, len(queries), BLOCK_QUERIES):
                some = queries[i : i + BLOCK_QUERIES]
                reach = np.sqrt((some**2).sum(axis=1))[:, None] * radii[None, :]
                bound = _slack(some @ centers.T + reach, reach)
                if home:
                    q, leaf = np.arange(len(some)), bound.argmax(axis=1)
                    floor = np.full(len(some), -np.inf)
                else:
                    floor = part.column("floor").to_numpy()[i : i + BLOCK_QUERIES]
                    done = np.searchsorted(numbers, part.column("done").to_numpy()[i : i + BLOCK_QUERIES])
                    bound[np.arange(len(some)), done] = -np.inf
                    q, leaf = np.nonzero((bound >= floor[:, None]) & (bound > -np.inf))
                    floor = floor[q]
                at = pa.array(q + i)
                yield pa.RecordBatch.from_arrays([part.column("dim").take(at), pa.array(numbers[leaf]), pa.array(shards[leaf]), part.column("ident").take(at), part.column("v").take(at), pa.array(floor)], names)


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the k highest integer inner products with other rows.

    ``is_query`` is a condition on the column ``ident``, the identifier. Ties go to the smaller identifier; a query with
    fewer than k other vectors gets all. Vectors that are null, empty or hold null or non-finite components take no part.
    Vectors of different length are never compared. Identifiers are taken as unique: of rows that repeat one, none is
    another's neighbour, and k rows are given for the identifier. Scores are exact; vectors of a norm (after scaling) of 2^31 or
    more take no part, as their scores may fit no long. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    points = cut(quantised(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")))
    per = points.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("norm2")).collect()
    whole = any(r.norm2 >= 2.0**51 for r in per)
    total = sum(r.n for r in per)
    # a bounded sample, the same on every run, for the upper levels only
    drawn = points.where(F.pmod(F.xxhash64(F.lit(7), "ident"), F.lit(1 << 20)) < math.ceil(SAMPLE / max(1, total) * 1.2 * (1 << 20))).orderBy(F.xxhash64("ident")).limit(SAMPLE)
    sample = drawn.select("dim", "v").toArrow() if total else None
    upper = {}
    for r in per:
        mine = sample.filter(pa.compute.equal(sample["dim"], r.dim))["v"].combine_chunks()
        own = _matrix(mine) if len(mine) else np.zeros((1, r.dim))
        upper[r.dim] = Upper(own, max(1, min(MOST_LEAVES, math.ceil(r.n / SHARD_ROWS * 2))))
    shared = spark.sparkContext.broadcast(upper)
    dealt = cut(points.select("ident", "v", "dim").mapInArrow(partial(_leaves, shared=shared), "ident long, v array<double>, dim int, leaf long, far double"))
    # at most MOST_LEAVES rows a dimension
    balls: dict[int, list] = {}
    for r in dealt.groupBy("dim", "leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("dim", "leaf").collect():
        balls.setdefault(r.dim, []).append((r.leaf, r.far, 1 + (r.n - 1) // SHARD_ROWS))
    known = {}
    for d, rows in balls.items():
        numbers = np.array([x[0] for x in rows], np.int64)
        known[d] = (numbers, upper[d].centers[numbers], np.array([x[1] for x in rows]), np.array([x[2] for x in rows], np.int64))
    leaves = spark.sparkContext.broadcast(known)
    shards = spark.createDataFrame([(d, int(leaf), int(n)) for d, rows in balls.items() for leaf, _, n in rows], "dim int, leaf long, shards long")

    columns = [c.split()[0] for c in DEALT.split(", ")]
    homes = dealt.join(F.broadcast(shards), ["dim", "leaf"]).withColumns({"shard": F.pmod(F.xxhash64("ident"), F.col("shards")), "asks": F.lit(False), "floor": F.lit(0.0)}).select(*columns)
    asked = dealt.where(is_query).select("ident", "v", "dim")
    routed = "dim int, leaf long, shards long, ident long, v array<double>, floor double"

    def over(queries: DataFrame) -> DataFrame:
        sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("asks", F.lit(True)).select(*columns)
        key = ["dim", "leaf", "shard"]
        return homes.unionByName(sent).repartition(*key).sortWithinPartitions(*key, "asks", "ident").mapInArrow(partial(_search, k=k, whole=whole), FOUND)

    first = asked.mapInArrow(partial(_route, shared=leaves, home=True), routed)
    home = cut(over(first))
    # a query's k-th score over the shards of its first leaf; none if no shard had k
    kth = home.groupBy("query_id").agg(F.max("kth").cast("double").alias("floor"))
    left = first.select("ident", "v", "dim", F.col("leaf").alias("done")).join(kth, F.col("ident") == F.col("query_id"), "left").drop("query_id")
    away = over(left.fillna(float("-inf"), ["floor"]).mapInArrow(partial(_route, shared=leaves, home=False), routed))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("ident") % 20 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
