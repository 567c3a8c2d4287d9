"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the 64 bits of a fingerprint are two blocks of 23 bits and 18 further bits. Each
block is covered by the perfect binary Golay code (length 23, 4096 words, covering radius 3), so two code words are one of
2^24 anchors; a fingerprint's home is the anchor that covers it. Fingerprints within the threshold t of each other meet at
the home of either, so each is replicated to every anchor that a change of t bits or fewer can make its home (these lie
within the covering radius plus t). Per anchor only a replica and a home are compared.

A replica that needs f changed bits to reach an anchor can differ from its partner in at most t - f of the 18 further bits.
These are compared by pigeonhole as well: split into t - f + 1 parts of which one must be equal, they extend the anchor to a
key of 30 to 42 bits, which keeps the groups small when there are 10^10 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import cut, join_groups, keep_rows, row_key, stored, table

#: Seed of XXH64, for shingles.
SEED = 42

BLOCK, REST = 23, 18
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes | None, width: int = 3, block: int = 1 << 16) -> int:
    """64-bit SimHash of a text: bit set if it is set in over half the shingles' hashes; no word: zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < width:
        return digest(b" ".join(words))
    total, n = np.zeros(64, np.int64), len(words) - width + 1
    for i in range(0, n, block):
        part = words[i : i + block + width - 1]
        grams = map(b" ".join, zip(*(part[k : len(part) - width + 1 + k] for k in range(width)), strict=True))
        hashes = np.fromiter(map(digest, grams), np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, width) for t in batch.column("body")), np.uint64, len(batch))
        kept = batch.drop_columns(["body"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prints.view(np.int64))], [*kept.schema.names, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, key: bool = False) -> DataFrame:
    """(ident, [key,] fp) per row; fp is the unsigned fingerprint in a long's bits, key tells rows apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("ident"), *[row_key(id_col, text_col).alias("key")] * key, F.encode(text_col, "utf-8").alias("body"))
    return rows.mapInArrow(partial(_fingerprints, width=width), f"ident long, {'key binary, ' * key}fp long")


@cache
def golay_homes() -> np.ndarray:
    """For each value of a 23-bit block the number (0-4095) of the one code word within distance 3."""
    codes = np.zeros(4096, np.int64)
    for k in range(12):
        codes ^= np.where(np.arange(4096) >> k & 1, GOLAY << k, 0)
    bit = [1 << i for i in range(BLOCK)]
    errors = [0, *bit, *(a ^ b for i, a in enumerate(bit) for b in bit[:i]), *(a ^ b ^ c for i, a in enumerate(bit) for j, b in enumerate(bit[:i]) for c in bit[:j])]
    homes = np.empty(1 << BLOCK, np.uint16)
    for e in errors:
        homes[codes ^ e] = np.arange(4096)
    return homes


def _reach(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homes that ``most`` (at most 2) changed bits of a block can give, as (row, home, fewest changes)."""
    bit = np.array([1 << i for i in range(BLOCK)])
    flips = [np.zeros(1, np.int64), bit, np.array([a ^ b for i, a in enumerate(bit) for b in bit[:i]])][: most + 1]
    cost = np.concatenate([np.full(len(x), k) for k, x in enumerate(flips)])
    keys = golay_homes()[values[:, None] ^ np.concatenate(flips)[None, :]].astype(np.int64) * 4 + cost
    keys.sort(axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] >> 2 != keys[:, :-1] >> 2
    row, _ = np.nonzero(first)
    keys = keys[first]
    return row, keys >> 2, keys & 3


def anchors(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that ``most`` changed bits of each fingerprint can make its home, as (row, anchor, fewest changes)."""
    mask = np.uint64((1 << BLOCK) - 1)
    one = _reach((fp & mask).astype(np.int64), most)
    two = _reach((fp >> np.uint64(BLOCK) & mask).astype(np.int64), most)
    found = []
    for a in range(most + 1):
        for b in range(most + 1 - a):
            (ra, ha), (rb, hb) = ((x[0][x[2] == f], x[1][x[2] == f]) for x, f in ((one, a), (two, b)))
            count = np.bincount(rb, minlength=len(fp))
            start = np.cumsum(count) - count
            repeat = count[ra]
            left = np.repeat(np.arange(len(ra)), repeat)
            right = np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + start[ra][left]
            found.append((ra[left], ha[left] << 12 | hb[right], np.full(len(left), a + b)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parts(rest: np.ndarray, n: int) -> list[np.ndarray]:
    """The further bits in n parts."""
    edges = [REST * k // n for k in range(n + 1)]
    return [rest >> lo & (1 << (hi - lo)) - 1 for lo, hi in zip(edges, edges[1:], strict=False)]


def _replicas(batches: Iterator[pa.RecordBatch], most: int, step: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, home): each fingerprint's replicas and homes. The key has the parts' kind, the anchor and the part."""
    for batch in batches:
        every = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(every), step):
            fp = every[i : i + step]
            rest = (fp >> np.uint64(2 * BLOCK)).astype(np.int64)
            row, anchor, used = anchors(fp, most)
            keys, rows, home = [], [], []
            kind = 0
            for f in range(most + 1):
                for k in range(most - f + 1):
                    for mine, at_home in ((used == f, False), (used == 0, True)):
                        part = _parts(rest, most - f + 1)[k]
                        keys.append(kind << 42 | anchor[mine] << REST | part[row[mine]])
                        rows.append(row[mine])
                        home.append(np.full(len(keys[-1]), at_home))
                    kind += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(rows)].view(np.int64)), pa.array(np.concatenate(home))], ["key", "fp", "home"])


def near_links(prints: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct values of ``prints.fp`` that differ in 1 to ``most`` (at most 2) bits."""
    if not 0 <= most <= 2:
        raise ValueError("most must be 0, 1 or 2")
    replicas = prints.select("fp").mapInArrow(partial(_replicas, most=most), "key long, fp long, home boolean").repartition("key")
    probes, homes = (replicas.where(F.col("home") == h).select("key", F.col("fp").alias(n)) for h, n in ((False, "a"), (True, "b")))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return probes.join(homes, (probes.key == homes.key) & near).select("a", "b").distinct()


#: Most nodes of a step (24 bytes each) that are joined by a broadcast.
FEW_NODES = 400_000


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) as (node, root), root the least node of the component, for nodes with links.

    Large-star and small-star steps take turns until nothing changes, each step stored. A step aggregates by node
    (combined before the shuffle) and joins on node; a node that has over a HOT_SHARE-th of all links, as the root of a large
    component has, is joined by a broadcast, so that its neighbours never meet in one task. The nodes' least neighbours are
    stored before they are joined, which keeps the plan of a step at a few operators. Steps of at most FEW_NODES nodes, which
    are counted, join them by a broadcast and write one file, so that small graphs cost no shuffles of many empty partitions.
    """

    def star(edges: DataFrame, large: bool, n: int) -> DataFrame:
        """``n``: how many edges there are. A step makes at most two of each edge, and as many nodes."""
        few = 2 * n <= FEW_NODES
        whole = lambda df: stored(df.coalesce(1) if few else df)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        nodes = whole(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"), F.count("*").alias("n")))
        hung = both.join(F.broadcast(nodes), "a") if few else join_groups(both, nodes, "a", "n")
        if large:
            out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            # the node itself hangs on its root, and so does each neighbour
            out = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("root").alias("b"))
        return whole(out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def hanging(edges: DataFrame) -> bool:
        """Every node hangs on one other, on which nothing hangs itself: nothing can change."""
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not per.where("up > 1 OR up > 0 AND down > 0").limit(1).count()

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    n = edges.count()
    while n and not hanging(edges):
        edges = star(edges, True, n)
        edges = star(edges, False, edges.count())
        n = edges.count()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str, width: int, most: int, key: bool) -> DataFrame:
    """(ident, [key,] fp, root, component_id) per row; root is the component's least fingerprint."""
    marked = cut(fingerprints(docs, id_col, text_col, width, key))
    prints = cut(marked.groupBy("fp").agg(F.min("ident").alias("least"), F.count("*").alias("n")))
    inside = components(near_links(prints, most))
    linked = cut(prints.join(inside, prints.fp == inside.node).select("fp", "least", "root"))
    ends = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")))
    named = join_groups(linked, ends, "root", "prints").select("fp", "root", "component_id")
    alone = prints.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return join_groups(marked, cut(alone), "fp", "n").drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, component_id), component_id the least identifier reachable.

    Texts are lower-cased (A-Z); shingles are ``width`` words, repeats included; a shorter text is one shingle; no word,
    empty and null give fingerprint zero, which links like any other. Repeated rows come back as often as they came in.
    A null identifier is never a component's least unless the component has no other; then component_id is null.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = _marked(docs, id_col, text_col, width, most, False)
    return rows.select(F.col("ident").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """One row of each component, with all its columns: that with the least identifier.

    Rows are told apart by identifier and text. Of rows of a component that share its least identifier one stays, whichever;
    so it is where all identifiers of a component are null.
    """
    rows = _marked(docs, id_col, text_col, width, most, True)
    marks = cut(rows.select("key", F.col("ident").eqNullSafe(F.col("component_id")).alias("chosen"), F.col("root").alias("group")))
    return keep_rows(docs, row_key(id_col, text_col), marks)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
