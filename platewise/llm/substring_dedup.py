"""Substring deduplication with difference-cover anchors.

Two equal windows of ``window`` words start at any two positions i and j. With a difference cover D modulo v there is a shift
d < v for which i + d and j + d are both cover positions, so the windows share an anchor there: equal runs of window - v + 1
words at positions whose remainder is in D. Only anchors (3 of 7 positions) are hashed and compared over the corpus:

1. anchors: tasks deal sorted anchor hashes by hash bucket; a bucket finds those in several documents and tells these;
2. extension: around the shared anchors documents extend to whole windows, whose 128-bit hashes are dealt likewise; a bucket
   tells each document which of its windows also start in a smaller one;
3. removal: every word that such a window covers goes.

A task settles what it sees in several of its own documents by itself and sends a bucket one entry per hash, so a passage
that a third of all documents share is never gathered. Anchor hashes have 48 bits, as they only nominate windows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import table

WINDOW = 13
#: A perfect difference cover: every remainder modulo 7 is a difference of two of these.
PERIOD, COVER = 7, (0, 1, 3)

#: Words that a task takes up before it sorts and sends their hashes, and bytes of text per hash bucket.
CHUNK_WORDS, BUCKET_BYTES, LEAST_BITS = 1_000_000, 32 << 20, 6

#: Bytes of text in a partition of the joins with what documents are told.
PART_BYTES = 32 << 20

Q1, Q2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, at: np.ndarray, length: int, q: np.uint64 = Q1) -> np.ndarray:
    """Hashes of the runs of ``length`` words that start at ``at``."""
    found = np.zeros(len(at), np.uint64)
    for k in range(length):
        found = found * q + words[at + k]
    found ^= found >> np.uint64(32)
    found *= MIX
    return found ^ found >> np.uint64(29)


def anchor_positions(n: int, window: int) -> np.ndarray:
    """Cover positions of a document of n words at which an anchor fits."""
    at = np.arange(max(0, n - (window - PERIOD)))
    return at[np.isin(at % PERIOD, COVER)] if n >= window else at[:0]


def anchor_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    at = anchor_positions(len(words), window)
    return at, run_hashes(words, at, window - PERIOD + 1) >> np.uint64(16)


def _send(keys: tuple[np.ndarray, ...], docs: np.ndarray, bits: int, width: int, settle: Callable) -> Iterator[dict]:
    """Rows for the buckets of one task's entries: per distinct key its least document, and what the task settles itself.

    ``keys``: parallel arrays that make the key, the first of ``width`` bits also gives the bucket. ``settle(first, several,
    group)`` says which of the sorted distinct (key, document) pairs are settled here.
    """
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = tuple(k[order] for k in keys), docs[order]
    new_key = np.ones(len(docs), bool)
    new_key[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    distinct = new_key.copy()
    distinct[1:] |= docs[1:] != docs[:-1]
    keys, docs, first = tuple(k[distinct] for k in keys), docs[distinct], new_key[distinct]
    group = np.cumsum(first) - 1
    several = np.bincount(group, minlength=0)[group] > 1 if len(group) else first
    mine = settle(first, several)
    bucket = (keys[0] >> np.uint64(width - bits)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        lead, own = first[part], mine[part]
        names, which = np.unique(docs[part][lead], return_inverse=True)
        yield {
            "bucket": int(b),
            "names": names.tobytes(),
            "which": which.astype(np.uint32 if len(names) > 65535 else np.uint16).tobytes(),
            "hashes": _packed(keys[0][part][lead], width),
            "second": keys[1][part][lead].tobytes() if len(keys) > 1 else b"",
            "flags": np.packbits(several[part][lead]).tobytes(),
            "own_docs": docs[part][own].tobytes(),
            "own_hashes": keys[0][part][own].tobytes(),
        }


def _packed(hashes: np.ndarray, width: int) -> bytes:
    return hashes.tobytes() if width == 64 else hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width // 8].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    if width == 64:
        return np.frombuffer(data, np.uint64)
    raw = np.frombuffer(data, np.uint8).reshape(-1, width // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : width // 8] = raw
    return wide.view("<u8").ravel()


SENT = "bucket long, names binary, which binary, hashes binary, second binary, flags binary, own_docs binary, own_hashes binary"
SENT_ARROW = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in ("names", "which", "hashes", "second", "flags", "own_docs", "own_hashes"))])
TOLD = "ident long, hash long"


def _rows(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = list(found)
    if held:
        yield pa.RecordBatch.from_pylist(held, SENT_ARROW)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    hashes, docs, n = [], [], 0

    def flush():
        return _rows(_send((np.concatenate(hashes),), np.concatenate(docs), bits, 48, lambda first, several: several))

    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if ident is None or not text.is_valid:
                continue
            words = word_hashes(text.as_buffer().to_pybytes().split())
            _, found = anchor_hashes(words, window)
            if len(found):
                hashes.append(found)
                docs.append(np.full(len(found), ident, np.int64))
                n += len(words)
            if n >= CHUNK_WORDS:
                yield from flush()
                hashes, docs, n = [], [], 0
    if hashes:
        yield from flush()


def _told(docs: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    docs, hashes = np.concatenate(docs), np.concatenate(hashes)
    for i in range(0, len(docs), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 50_000]), pa.array(hashes[i : i + 50_000].view(np.int64))], ["ident", "hash"])


def _buckets(batches: Iterator[pa.RecordBatch], width: int, smaller: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket. Tells documents which hashes several documents have or, if ``smaller``, a smaller one has."""
    held: list[dict] = []

    def decide():
        hashes = np.concatenate([_unpacked(r["hashes"], width) for r in held])
        names = [np.frombuffer(r["names"], np.int64) for r in held]
        docs = np.concatenate([x[np.frombuffer(r["which"], np.uint32 if len(x) > 65535 else np.uint16)] for r, x in zip(held, names, strict=True)])
        second = np.concatenate([np.frombuffer(r["second"], np.uint64) for r in held]) if smaller else np.zeros(len(docs), np.uint64)
        settled = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(r["which"]) // (4 if len(x) > 65535 else 2)) for r, x in zip(held, names, strict=True)]).astype(bool)
        order = np.lexsort((docs, second, hashes))
        hashes, second, docs, settled = hashes[order], second[order], docs[order], settled[order]
        first = np.ones(len(docs), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
        group = np.cumsum(first) - 1
        told = docs > docs[first][group] if smaller else (np.bincount(group)[group] > 1) & ~settled
        yield from _told([docs[told], *(np.frombuffer(r["own_docs"], np.int64) for r in held)], [hashes[told], *(np.frombuffer(r["own_hashes"], np.uint64) for r in held)])

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from decide()
                held = []
            held.append(row)
    if held:
        yield from decide()


def _windows(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Extends the shared anchors of each document (column 2) to whole windows."""
    one, two, docs, n = [], [], [], 0

    def flush():
        return _rows(_send((np.concatenate(one), np.concatenate(two)), np.concatenate(docs), bits, 64, lambda first, several: ~first))

    for batch in batches:
        for ident, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if not shared.is_valid or not text.is_valid:
                continue
            words = word_hashes(text.as_buffer().to_pybytes().split())
            at, found = anchor_hashes(words, window)
            at = at[np.isin(found, shared.values.to_numpy().view(np.uint64))]
            starts = np.unique((at[:, None] - np.arange(PERIOD)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= len(words) - window)]
            if len(starts):
                one.append(run_hashes(words, starts, window))
                two.append(run_hashes(words, starts, window, Q2))
                docs.append(np.full(len(starts), ident, np.int64))
                n += len(starts)
            if n >= CHUNK_WORDS // 2:
                yield from flush()
                one, two, docs, n = [], [], [], 0
    if one:
        yield from flush()


def _removed(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["ident", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    for batch in batches:
        rows = []
        for ident, text, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            kept = words
            if told.is_valid and len(words) >= window:
                hashes = run_hashes(word_hashes(words), np.arange(len(words) - window + 1), window)
                starts = np.flatnonzero(np.isin(hashes, told.values.to_numpy().view(np.uint64)))
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
            joined = b" ".join(kept)
            rows.append([ident, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()] + [joined.decode()] * with_text)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in zip(range(len(names)), kinds, strict=False)], names)


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_removed, kept_sha256[, kept_text]).

    Words are runs of anything but ASCII white space, unchanged; null has none. A word goes if it is covered by a window
    of ``window`` (at least 7) words that also starts in a document with a smaller identifier; windows are judged on the
    input. Kept words are joined by one space. Rows that repeat an identifier are one document's parts: they aren't
    smaller than each other. Rows with a null identifier lose nothing and count for no other row. Other columns are not
    read. An empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    rows = docs.select(F.col(id_col).cast("long").alias("ident"), F.encode(text_col, "utf-8").alias("body"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # the session's partitions, or more where texts would not fit them
    parts = math.ceil(size / PART_BYTES)
    more = parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(40, max(LEAST_BITS, math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))

    def told(sent: DataFrame, width: int, smaller: bool) -> DataFrame:
        dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
        hashes = dealt.mapInArrow(partial(_buckets, width=width, smaller=smaller), TOLD)
        return (hashes.repartition(parts, "ident") if more else hashes).groupBy("ident").agg(F.collect_set("hash").alias("hashes"))

    # the same exchange and order of the texts serve both joins, which sort and so can spill
    dealt_rows = rows.repartition(parts, "ident") if more else rows

    def beside(found: DataFrame) -> DataFrame:
        return dealt_rows.join(found.hint("merge"), "ident", "left").select("ident", "body", "hashes")

    shared = told(rows.mapInArrow(partial(_anchors, window=window, bits=bits), SENT), 48, False)
    doubled = told(beside(shared).mapInArrow(partial(_windows, window=window, bits=bits), SENT), 64, True)
    schema = f"ident long, n_words long, n_removed long, kept_sha256 string{', kept_text string' * with_text}"
    return beside(doubled).mapInArrow(partial(_removed, window=window, with_text=with_text), schema).withColumnRenamed("ident", id_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents"), with_text=False)


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d)),
m AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY run) AS least FROM g) WHERE least < doc_id),
k AS (SELECT w.doc_id, w.pos, w.word, max(m.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM w LEFT JOIN m ON w.doc_id = m.doc_id AND w.pos = m.pos),
s AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed, coalesce(string_agg(CASE WHEN gone THEN NULL ELSE word END, ' ' ORDER BY pos), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
