"""Near-duplicate pages by parts of their hashes, similarity hashes of texts, and similar vectors by shards."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def text_hashes(text: DataFrame, ident: str, column: str) -> DataFrame:
    """(ident, phash): 64-bit similarity hash of a text's words, a bit set if it is in over half of their hashes.

    Words are exploded and their bits summed by 64 aggregates, combined before the shuffle. Texts without words have hash 0.
    """
    words = text.select(F.col(ident).alias("ident"), F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"(\S+)"), F.lit(1))).alias("w"))
    digest = F.md5("w")
    halves = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9)]
    rows = words.select("ident", *[h.alias(n) for h, n in zip(halves, ("hi", "lo"), strict=True)])
    bits = [F.coalesce(F.sum(F.shiftright(n, b).bitwiseAND(1)), F.lit(0)).alias(f"{n}{b}") for n in ("hi", "lo") for b in range(32)]
    per = rows.groupBy("ident").agg(F.count("hi").alias("n"), *bits)
    value = F.lit(0).cast("long")
    for n, base in (("hi", 32), ("lo", 0)):
        for b in range(32):
            value = value.bitwiseOR(F.when(F.col(f"{n}{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b + base)).otherwise(F.lit(0).cast("long")))
    return per.select("ident", value.alias("phash"))


#: Most nodes for 6 and for 7 parts of a hash; more have 8.
PARTS = ((1 << 14, 6), (1 << 20, 7))
#: A hash is hot if it has over 1/HOT of all pages; so there are fewer than HOT of them.
HOT = 1000
#: Keys of hashes that a task makes or compares, as a rule.
TASK_KEYS = 1 << 19


def hash_keys(phash: Column, parts: int, most: int = 4) -> Column:
    """Keys of a 64-bit hash: two hashes that differ in at most ``most`` bits agree in one of its choices of parts - most parts.

    With 6 parts a key has 21 bits, with 7 parts 27 and with 8 parts 32, so that a wider key goes with more rows.
    """
    edges = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for n, kept in enumerate(itertools.combinations(range(parts), parts - most)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        keys.append(F.struct(F.lit(n).alias("band"), phash.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("part")))
    return F.array(*keys)


def hash_candidates(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (one, h1, two, h2) of distinct hashes (ident, phash) that agree in a key, some more than once.

    Keys are many times the hashes, so their tasks go with their own number, not with the few in which the hashes stand.
    """
    n = nodes.count()
    parts = next((p for limit, p in PARTS if n <= limit), 8)
    tasks = 1 + n * math.comb(parts, most) // TASK_KEYS
    banded = nodes.repartition(tasks, "phash").select("ident", "phash", F.explode(hash_keys(F.col("phash"), parts, most)).alias("k"))
    banded = banded.select("ident", "phash", "k.*").repartition(tasks, "band", "part")
    left, right = (banded.select(F.col("ident").alias(i), F.col("phash").alias(h), "band", "part") for i, h in (("one", "h1"), ("two", "h2")))
    return left.join(right.hint("merge"), ["band", "part"]).where("one < two")


def near_hashes(pages: DataFrame, most: int = 4) -> DataFrame:
    """Pairs (one, two, distance, similarity) of pages (ident, phash) whose 64-bit hashes differ in at most ``most`` bits.

    Of the parts of a hash all but ``most`` must be equal: an equi-join on each choice of them, whose keys widen with the number
    of hashes, then a check. Pages of equal hash are one node, its least id: between nodes stand pairs of least ids, and each
    further page has a pair of distance 0 with its node; nodes of hot hashes are broadcast, so their pages stay where they
    are. Similarity is (1 - distance / 64) * 100.
    """
    nodes = pages.groupBy("phash").agg(F.min("ident").alias("ident"), F.count("*").alias("n")).checkpoint()
    distance = F.bit_count(F.col("h1").bitwiseXOR(F.col("h2")))
    near = hash_candidates(nodes, most).where(distance <= most).select("one", "two", distance.cast("int").alias("distance")).distinct()
    named, total = nodes.select("phash", F.col("ident").alias("one"), "n"), nodes.agg(F.sum("n")).first()[0] or 0
    hot, rest = named.where(F.col("n") * HOT > total), named.where((F.col("n") * HOT <= total) & (F.col("n") > 1))
    rows = pages.select(F.col("ident").alias("two"), "phash")
    same = rows.join(F.broadcast(hot), "phash").unionByName(rows.join(F.broadcast(hot.select("phash")), "phash", "left_anti").join(rest, "phash"))
    same = same.where("one < two").select("one", "two", F.lit(0).alias("distance")).distinct()
    return near.unionByName(same).withColumn("similarity", (1 - F.col("distance") / 64) * 100)


#: Vectors that a task searches at once, and cosines that it holds at a time (8 MB, with some copies).
SHARD_VECTORS, CELLS = 16_384, 1 << 20


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, asks, ident, v) in order of (key, asks): a shard's unit vectors, then the queries; the k best of the shard for each."""
    key, held, ids, points = None, [], None, None
    for batch in batches:
        keys, asks = batch.column("key").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, stop in zip([0, *edges], [*edges, len(batch)], strict=True):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            if keys[start] != key:
                key, held, points = keys[start], [], None
            own = part.column("ident").to_numpy(), part.column("v").flatten().to_numpy().reshape(len(part), -1)
            if not asks[start]:
                held.append(own)
                continue
            if held:
                (ids, points), held = (np.concatenate(x) for x in zip(*held, strict=True)), []
            if points is None:
                continue
            block = max(1, CELLS // len(ids))
            for at in range(0, len(own[0]), block):
                queries = own[0][at : at + block]
                cosine = own[1][at : at + block] @ points.T
                cosine[queries[:, None] == ids[None, :]] = -np.inf
                few = min(k, len(ids))
                # all that reach the k-th, so that ties are settled by identifier
                kth = np.partition(cosine, len(ids) - few, axis=1)[:, len(ids) - few].copy()
                row, col = np.nonzero((cosine >= kth[:, None]) & (cosine > -np.inf))
                order = np.lexsort((ids[col], -cosine[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(ids[col]), pa.array(cosine[row, col])], ["query_id", "ident", "cosine"])


def similar_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, ident, cosine): the k vectors of the greatest cosine for each query, exact; ties go to the smaller id.

    ``vectors`` and ``queries`` have (ident, v), an array of numbers; a vector is not its own neighbour, and vectors of another
    length, of length 0 in space, or with null or non-finite numbers take no part. Vectors are dealt by a hash to shards of
    about SHARD_VECTORS, queries are sent to each shard of their length and compared in blocks; only the k best of a shard go on.
    """

    def units(rows: DataFrame) -> DataFrame:
        v = F.transform("v", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
        fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).select("ident", v.alias("v"), norm.alias("norm")).where("norm > 0 AND norm < double('infinity')")
        return fine.select("ident", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.size("v").alias("dim"))

    points = units(vectors)
    shards = points.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_VECTORS).cast("long").alias("shards"))
    # a row for each length of vectors
    known = {r.dim: r.shards for r in shards.limit(1000).collect()}
    of = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<int,bigint>")
    homes = points.withColumn("shard", F.pmod(F.xxhash64("ident"), of[F.col("dim")])).withColumn("asks", F.lit(False))
    asking = units(queries).where(of[F.col("dim")].isNotNull()).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), of[F.col("dim")] - 1))).withColumn("asks", F.lit(True))
    dealt = homes.unionByName(asking, allowMissingColumns=True).select(F.xxhash64("dim", "shard").alias("key"), "asks", "ident", "v")
    found = dealt.repartition("key").sortWithinPartitions("key", "asks", "ident").mapInArrow(partial(_best, k=k), "query_id long, ident long, cosine double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "ident"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ident", F.round("cosine", 6).alias("cosine"))
