"""Exact deduplication by Patricia-trie owners.

Texts are dealt to owner partitions by length and content hash. Before the shuffle each task combines the copies that it
sees, so that a group with a third of all rows sends one text per combined block rather than all its copies. An owner
partition is sorted by text (Spark's external sort) and inserts the full byte strings into a compressed radix trie; each
terminal node keeps the identifiers of its text. As strings arrive in byte order, a subtree that the next string does not
enter is complete: it is spilled to the output and freed, so a trie never holds more than one path and its open siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import cut, join_groups, keep_rows, lean, row_key, small_batches, table

#: Bytes of distinct text that a task combines before it hands them on.
COMBINE_BYTES = 24 << 20


class Node:
    """A trie node: the bytes on the edge to it, its children by first byte, and what its text's rows add up to."""

    __slots__ = ("label", "children", "rows", "least", "most", "digest")

    def __init__(self, label: bytes):
        self.label, self.children, self.digest = label, {}, None
        self.rows, self.least, self.most = 0, None, None

    def add(self, rows: int, least: int, most: int) -> None:
        self.least = least if not self.rows else min(self.least, least)
        self.most = most if not self.rows else max(self.most, most)
        self.rows += rows


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, found by halving so that long strings are compared in C."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over whole byte strings."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, rows: int, least: int, most: int, digest: bytes) -> bool:
        """Add a string; True if it is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            shared = common_prefix(child.label, key[at:])
            upper = Node(child.label[:shared])
            child.label = child.label[shared:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + shared
        new = not node.rows
        node.add(rows, least, most)
        node.digest = digest
        return new

    def drain(self) -> Iterator[tuple[bytes, Node]]:
        """Every text with its terminal node; the trie is empty afterwards."""
        stack = [(b"", self.root)]
        self.root = Node(b"")
        while stack:
            prefix, node = stack.pop()
            text = prefix + node.label
            if node.rows:
                yield text, node
            stack.extend((text, child) for child in node.children.values())

    def spill_closed(self, key: bytes) -> Iterator[Node]:
        """Free the subtrees off the path of ``key`` and give their terminal nodes; strings must arrive in order."""
        node, at = self.root, 0
        while True:
            step = key[at] if at < len(key) else None
            for first in [b for b in node.children if b != step]:
                stack = [node.children.pop(first)]
                while stack:
                    done = stack.pop()
                    if done.rows:
                        yield done
                    stack.extend(done.children.values())
            child = node.children.get(step) if step is not None else None
            if child is None or not key.startswith(child.label, at):
                return
            node, at = child, at + len(child.label)


COMBINED = "digest binary, n long, body binary, row_count long, least long, most long"
OWNERS = "digest binary, row_count long, least long, most long"


def _normal(batch: pa.RecordBatch, at: int) -> list[bytes]:
    """Texts as bytes with A-Z lower-cased; null is empty."""
    return [(x or b"").lower() for x in batch.column(at).to_pylist()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ident, key, digest) of each row (ident, key, body)."""
    for batch in batches:
        digests = [hashlib.sha256(b).digest() for b in _normal(batch, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], ["ident", "key", "digest"])


@lean
def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the copies within blocks of a task's rows (ident, body) to one row per distinct text of a block."""

    def flush(trie):
        found = list(trie.drain())
        for i in range(0, len(found), 2000):
            part = found[i : i + 2000]
            yield _packed([x for _, x in part], [t for t, _ in part])

    trie, held = PatriciaTrie(), 0
    for batch in batches:
        for body, ident in zip(_normal(batch, 1), batch.column(0).to_pylist(), strict=True):
            if trie.insert(body, 1, ident, ident, hashlib.sha256(body).digest()):
                held += len(body)
            if held >= COMBINE_BYTES:
                yield from flush(trie)
                trie, held = PatriciaTrie(), 0
    yield from flush(trie)


def _packed(nodes: list[Node], bodies: list[bytes] | None = None) -> pa.RecordBatch:
    cols = {"digest": pa.array([x.digest for x in nodes], pa.binary())}
    cols |= {} if bodies is None else {"n": pa.array(map(len, bodies), pa.int64()), "body": pa.array(bodies, pa.binary())}
    cols |= {k: pa.array([getattr(x, v) for x in nodes], pa.int64()) for k, v in (("row_count", "rows"), ("least", "least"), ("most", "most"))}
    return pa.RecordBatch.from_pydict(cols)


@lean
def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner partition: rows in order of text; one row per distinct text."""
    trie, out = PatriciaTrie(), []
    for batch in batches:
        for digest, body, rows, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.extend(trie.spill_closed(body))
            trie.insert(body, rows, least, most, digest)
            if len(out) >= 2000:
                yield _packed(out)
                out = []
    out.extend(x for _, x in trie.drain())
    if out:
        yield _packed(out)


def marked_duplicates(docs: DataFrame, id_col: str, text_col: str, keep: str, key: bool = False) -> DataFrame:
    """(ident, key, digest, keep_id, group_size, kept) per row; ``key`` tells rows apart that share an identifier."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    ident, body = F.col(id_col).cast("long").alias("ident"), F.encode(text_col, "utf-8").alias("body")
    with small_batches(docs.sparkSession):
        marks = cut(docs.select(ident, (row_key(id_col, text_col) if key else F.lit(None).cast("binary")).alias("key"), body).mapInArrow(_digests, "ident long, key binary, digest binary"))
    extreme = -(2**63) if keep == "largest" else 2**63 - 1
    combined = docs.select(F.coalesce(ident, F.lit(extreme)).alias("ident"), body).mapInArrow(_combine, COMBINED)
    dealt = combined.repartition("n", "digest").sortWithinPartitions("body")
    with small_batches(docs.sparkSession):
        owners = cut(dealt.select("digest", "body", "row_count", "least", "most").mapInArrow(_own, OWNERS))
    chosen = F.col("most" if keep == "largest" else "least")
    owners = owners.select("digest", F.nullif(chosen, F.lit(extreme)).alias("keep_id"), F.col("row_count").alias("group_size"))
    return join_groups(marks, owners, "digest", "group_size").withColumn("kept", F.col("ident").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z. ``keep`` says which identifier of a group stays: "smallest"
    or "largest". Null text counts as empty, so all null and empty texts are one group. Rows that repeat an identifier
    with the same text each come back once per row and are all marked kept when the identifier is kept. Rows with a
    null identifier never are a group's owner unless all of the group's are null; then keep_id is null and they are kept.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    marks = marked_duplicates(docs, id_col, text_col, keep)
    return marks.select(F.col("ident").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the smallest or largest identifier.

    Rows are told apart by identifier and text, so a row goes only if its own text has another owner. Of rows that repeat
    the owner's identifier one stays, whichever; so it is where all identifiers of a group are null.
    """
    marks = cut(marked_duplicates(docs, id_col, text_col, keep, key=True).select("key", F.col("kept").alias("chosen"), F.col("digest").alias("group")))
    return keep_rows(docs, row_key(id_col, text_col), marks)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g ON t.text_sha256 = g.text_sha256
"""
