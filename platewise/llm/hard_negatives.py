"""Hard-negative mining with cover trees over norm-augmented candidates.

Candidates are given one more component, the root of R^2 - |x|^2 for the largest norm R of their shard, so that all have norm R.
Then |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, and a distance bounds an inner product. A cover tree's node stands for points within a
radius of its centre, itself one of them; at each level the radius shrinks by BASE, centres are further apart than it and cover
the node's points. So q.x of all points below a node lies between two bounds, and best-first descent opens the node of the
highest bound first, skips nodes outside the window of scores that is asked for or below the kth score so far, and verifies the
points of leaves exactly.

Vectors are dealt to shards by a hash, for positives within their label, so that a label with any share of the rows is many
shards and none holds more than about SHARD_ROWS vectors. Anchors, the stated queries, are sent to the shards of their label
for positives, and with their windows to all shards for negatives. A first round asks one shard; the others are asked only for
scores that reach the kth score which that gave. What shards find is ranked per anchor, or anchor and positive, at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.llm.common import cut, join_checked, table

SCALE = 256
SHARD_ROWS, LEAF, BASE = 8_192, 128, 1.6
#: A level that needs more centres than one for SPREAD points has no clusters to tell apart; the node is a leaf then.
SPREAD = 8
#: Vectors beyond this norm could have scores that fit no long.
MOST_NORM = 2.0**31
#: Most groups whose numbers of shards are broadcast; with more of them they are joined by a shuffle.
BROADCAST_SHARDS = 100_000
LOW = np.iinfo(np.int64).min


class Node:
    __slots__ = ("center", "radius", "rows", "parts")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray | None, parts: list[Node]):
        self.center, self.radius, self.rows, self.parts = center, radius, rows, parts


def augmented(points: np.ndarray) -> np.ndarray:
    """Points with the component that gives all the largest norm."""
    norms = (points**2).sum(axis=1)
    return np.hstack([points, np.sqrt(np.maximum(norms.max() - norms, 0.0))[:, None]])


def cover_tree(points: np.ndarray) -> Node:
    """A cover tree of augmented points; its leaves hold row numbers."""

    def build(rows: np.ndarray, center: int, radius: float) -> Node:
        own = points[rows]
        far = np.sqrt(((own - points[center]) ** 2).sum(axis=1))
        covering = float(far.max())
        if len(rows) <= LEAF or covering == 0.0:
            return Node(points[center], covering, rows, [])
        level = min(radius, covering) / BASE
        while True:
            # the centre first, then always the point that is furthest from those chosen, until all are covered
            centers, least, nearest = [center], far.copy(), np.zeros(len(rows), np.int64)
            while least.max() > level and len(centers) * SPREAD <= len(rows):
                new = int(least.argmax())
                there = np.sqrt(((own - own[new]) ** 2).sum(axis=1))
                closer = there < least
                nearest[closer] = len(centers)
                least = np.where(closer, there, least)
                centers.append(int(rows[new]))
            if least.max() > level:
                return Node(points[center], covering, rows, [])
            if len(centers) > 1:
                return Node(points[center], covering, None, [build(rows[nearest == i], c, level) for i, c in enumerate(centers)])
            level /= BASE

    return build(np.arange(len(points)), 0, np.inf)


class Shard:
    """The vectors of a shard, exact and in a cover tree, and what a query asks of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        wide = augmented(points)
        self.ids, self.labels, self.points, self.tree = ids, labels, points, cover_tree(wide)
        self.norm = float((wide[0] ** 2).sum())
        # doubles are exact while both norms stay within 2^25.5
        self.small = float((points**2).sum(axis=1).max()) < 2.0**51
        self.exact = points if self.small else points.astype(np.int64)

    def ask(self, ident: int, label: int, same: bool, query: np.ndarray) -> Query:
        return Query(self, ident, label, same, query)


class Query:
    """One query against a shard; bounds and scores are kept for its several windows."""

    def __init__(self, shard: Shard, ident: int, label: int, same: bool, query: np.ndarray):
        self.shard, self.ident, self.label, self.same = shard, ident, label, same
        self.half, self.reach = (query @ query + shard.norm) / 2, np.append(query, 0.0)
        small = shard.small and float(query @ query) < 2.0**51
        self.exact, self.query = (shard.exact, query) if small else (shard.exact.astype(np.int64, copy=False), query.astype(np.int64))
        self.known: dict[int, tuple] = {}

    def bounds(self, node: Node) -> tuple[float, float]:
        """The highest and the lowest inner product that a point below the node can have."""
        if (found := self.known.get(id(node))) is None:
            d = float(np.sqrt(((self.reach - node.center) ** 2).sum()))
            slack = 1e-9 * (self.half + d * d + node.radius**2) + 1e-6
            found = self.known[id(node)] = (self.half - max(d - node.radius, 0.0) ** 2 / 2 + slack, self.half - (d + node.radius) ** 2 / 2 - slack)
        return found

    def verified(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of a leaf's points, without the query's own and those of the wrong label."""
        if (found := self.known.get(-id(node))) is None:
            ids = self.shard.ids[node.rows]
            fits = ((self.shard.labels[node.rows] == self.label) == self.same) & (ids != self.ident)
            found = self.known[-id(node)] = ((self.exact[node.rows] @ self.query)[fits], ids[fits])
        return found

    def best(self, low: int, high: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) from ``low`` to ``high``, highest first, ties by least id."""
        heap, best, count = [(-self.bounds(self.shard.tree)[0], 0, self.shard.tree)], [], 0
        while heap:
            upper, _, node = heapq.heappop(heap)
            least = max(low, best[0][0]) if len(best) == k else low
            if -upper < least:
                break
            for part in node.parts:
                upper, lower = self.bounds(part)
                if upper >= least and lower <= high:
                    count += 1
                    heapq.heappush(heap, (-upper, count, part))
            if node.parts:
                continue
            scores, ids = self.verified(node)
            at = np.flatnonzero((scores >= least) & (scores <= high))
            if len(at) > k:
                # of more than k only the k best can matter
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            for score, ident in zip(scores[at].astype(np.int64).tolist(), ids[at].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -ident))
                elif (score, -ident) > best[0]:
                    heapq.heapreplace(best, (score, -ident))
        return [(score, -ident) for score, ident in sorted(best, reverse=True)]


FOUND = "anchor_id long, positive_id long, place int, positive_score long, ident long, score long"
#: What an anchor asks for, one for each positive.
WINDOWS = "array<struct<place:int,positive_id:long,positive_score:long,low:long,high:long>>"
#: Rows as they are dealt; those that ask come after the vectors of their shard.
DEALT = ["key", "asks", "ident", "label", "v", "windows"]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT in order of (key, asks): a shard's vectors, then who asks it."""
    key, held, shard = None, [], None
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        keys, asks = batch.column("key").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, stop in zip([0, *edges], [*edges, len(batch)], strict=True):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            if keys[start] != key:
                key, held, shard = keys[start], [], None
            own = part.column("ident").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"))
            if not asks[start]:
                held.append(own)
                continue
            if held:
                shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True))), []
            if shard is None:
                continue
            found = []
            for ident, label, query, windows in zip(own[0].tolist(), own[1].tolist(), own[2], part.column("windows").to_pylist(), strict=True):
                asked = shard.ask(ident, label, same, query)
                for w in windows:
                    found += [(ident, w["positive_id"], w["place"], w["positive_score"], other, score) for score, other in asked.best(w["low"], w["high"], k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], [c.split()[0] for c in FOUND.split(", ")])


def quantised(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(ident, label, v, dim) of the rows that take part: components floor(scale * x) as whole doubles."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & (F.size(x) > 0)
    fine &= F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    # beyond a long floor() saturates; such a vector is beyond MOST_NORM as well
    norm = F.sqrt(F.aggregate(F.transform(x, lambda e: F.pow(F.lit(float(scale)) * e.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, e: s + e))
    return vectors.where(fine).where(norm < MOST_NORM - 2**20).select(F.col(id_col).cast("long").alias("ident"), label.cast("long").alias("label"), v.alias("v"), F.size(x).alias("dim"))


def hard_negatives(
    vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): mined negatives of anchors and positives.

    ``is_anchor`` is a condition on the column ``ident``, the identifier. An anchor's positives are its ``positives`` best other
    rows of its label; a positive's negatives are the ``negatives`` best rows of other labels whose score lies from ``low`` to
    ``high`` percent of the positive's. Scores are integer inner products, exact; ties go to the smaller identifier. Rows whose
    label or vector is null, and vectors that are empty or hold null or non-finite components, take no part; nor do vectors
    of a norm (after scaling) near 2^31 or more, as their scores may not fit a long. Vectors of different length are never compared.
    Identifiers are taken as unique: rows that repeat one are ranked together and are not each other's positives or negatives.
    Other columns are not read. An empty table gives an empty result.
    """
    points = cut(quantised(vectors, label, id_col, vector_col, scale))
    nothing = F.lit(None).cast(WINDOWS)

    def ask(shards: DataFrame, key: list[str], asking: DataFrame, k: int, same: bool) -> DataFrame:
        """``asking`` has key, a group's columns, and shard beside ident, label, v and windows."""
        homes = join_checked(points, shards, key, "inner", BROADCAST_SHARDS).withColumn("shard", F.pmod(F.xxhash64("ident"), F.col("shards")))
        both = homes.select(F.xxhash64(*key, "shard").alias("key"), F.lit(False).alias("asks"), "ident", "label", "v", nothing.alias("windows"))
        both = both.unionByName(asking.select(F.xxhash64(*key, "shard").alias("key"), F.lit(True).alias("asks"), "ident", "label", "v", "windows"))
        return both.select(*DEALT).repartition("key").sortWithinPartitions("key", "asks", "ident").mapInArrow(partial(_search, k=k, same=same), FOUND)

    def shards_of(*key: str) -> DataFrame:
        return cut(points.groupBy(*key).agg(F.ceil(F.count("*") / SHARD_ROWS).cast("long").alias("shards")))

    def to_all(rows: DataFrame, shards: DataFrame, key: list[str]) -> DataFrame:
        return join_checked(rows, shards, key, "inner", BROADCAST_SHARDS).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))

    own, every = shards_of("dim", "label"), shards_of("dim")
    anchors = cut(points.where(is_anchor))
    whole = F.struct(F.lit(0).alias("place"), F.lit(0).cast("long").alias("positive_id"), F.lit(0).cast("long").alias("positive_score"), F.lit(LOW).alias("low"), F.lit(-(LOW + 1)).alias("high"))
    best = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.col("score").desc(), "ident"))
    found = ask(own, ["dim", "label"], to_all(anchors, own, ["dim", "label"]).withColumn("windows", F.array(whole)), positives, True)
    found = found.withColumn("place", best).where(F.col("place") <= positives)
    # low p <= 100 s <= high p for a whole s
    share = lambda x: F.col("score").cast("decimal(20,0)") * F.lit(x) / F.lit(100)
    least, most = F.ceil(share(low)).cast("long"), F.floor(share(high)).cast("long")
    one = F.struct("place", F.col("ident").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"), most.alias("high"))
    windows = found.where(least <= most).groupBy("anchor_id").agg(F.collect_list(one).alias("windows"))
    sent = to_all(cut(anchors.join(windows, anchors.ident == windows.anchor_id).drop("anchor_id")), every, ["dim"])
    is_first = F.col("shard") == F.pmod(F.xxhash64("ident"), F.col("shards"))
    first = cut(ask(every, ["dim"], sent.where(is_first), negatives, False))
    floors = first.groupBy("anchor_id", "place").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= negatives)
    floors = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floors"))
    raised = F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.col("floors")[w["place"]], w["low"]))))
    rest = sent.where(~is_first).join(floors, F.col("ident") == F.col("anchor_id"), "left").withColumn("windows", raised)
    order = W.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "ident")
    ranked = first.unionByName(ask(every, ["dim"], rest, negatives, False)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("ident") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
