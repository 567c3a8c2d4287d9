"""Secret scan with corpus-wide ownership frequency.

Patterns find assignments, access keys and long hex strings. Beyond these, every long token that looks like a credential
(mixed classes, high entropy) is a candidate; candidate hashes are counted by distinct documents (the repositories) and
distinct sources (their owners). What the base patterns match is counted alike, by the secret value itself. Strings that many
owners or repositories carry are widely copied examples; others are owner-specific and look live. A candidate of its own
that is owner-specific is reported as well, as kind ``owned``; base spans stay and are told to be one or the other.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import cut, join_groups, table

KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The greedy runs of at least the asked length are those of the unbounded patterns that don't fail.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
LEAST_VALUE = 6

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.0

#: A candidate is a copied example if more repositories carry it, or more owners and more than a few repositories.
MOST_REPOSITORIES, MOST_OWNERS, FEW_REPOSITORIES = 20, 2, 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, in code points, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if max(map(len, text.split()), default=0) >= 20:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def looks_live(value: str) -> bool:
    """Letters and digits, and as many bits a character as a random string has."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= LEAST_ENTROPY


def hashed(value: str) -> bytes:
    """128 bits that stand for a secret value, so that no value leaves its task in clear."""
    return xxhash.xxh3_128_digest(value.encode())


def candidates(text: str) -> list[tuple[int, int, bytes]]:
    """(start, end, hash) of the strings that look like credentials."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    return [(m.start(), m.end(), hashed(m[0])) for m in CANDIDATE.finditer(text) if looks_live(m[0])]


def secret_values(text: str, spots: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, hash) of base spans and of the candidates outside them; an assignment's value is what it assigns."""
    found = [(a, b, k, hashed(ASSIGN.match(text, a)[2] if k == "assign" else text[a:b])) for a, b, k in spots]
    return found + [(a, b, "own", h) for a, b, h in candidates(text) if not any(x <= a and b <= y for x, y, _ in spots)]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


SPAN = "struct<start:int,stop:int,kind:string,hash:binary>"
SCANNED = f"ident long, owner string, row binary, base string, n_assign long, n_access long, n_hex long, found array<{SPAN}>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("hash", pa.binary())]))
    for batch in batches:
        base, counted, found, rows = [], [], [], []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spots = base_spans(text or "")
            base.append(written(spots))
            counted.append(Counter(k for *_, k in spots))
            found.append([dict(zip(("start", "stop", "kind", "hash"), c, strict=True)) for c in secret_values(text or "", spots)])
            rows.append(hashlib.md5(f"{ident}|{found[-1]}".encode()).digest())
        counts = [pa.array([c[k] for c in counted], pa.int64()) for k in KINDS[:3]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary()), pa.array(base, pa.string()), *counts, pa.array(found, spans)], ["ident", "owner", "row", "base", "n_assign", "n_access", "n_hex", "found"])


def _merge(base: str, owned: list | None) -> str:
    spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base.split(",") if x)]
    return written(spans + [(s["start"], s["stop"], "owned") for s in owned or []])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, owned = batch.column(1).to_pylist(), batch.column(5).to_pylist()
        cols = [batch.column(0), *batch.columns[2:5], pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(list(map(_merge, base, owned)), pa.string())]
        cols += [pa.array([len(x or []) for x in owned], pa.int64()), *batch.columns[6:]]
        yield pa.RecordBatch.from_arrays(cols, ["ident", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_live", "n_copied", "carriers"])


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every value: distinct documents and sources that carry it."""
    carried = scanned.select("ident", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    return carried.groupBy("hash").agg(F.count_distinct(F.struct("ident")).alias("repositories"), F.count_distinct(F.struct("owner")).alias("owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, few: int = FEW_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied, carriers).

    ``spans`` lists kind:start:end in code points by start; base spans always stay, and candidates outside them that are
    owner-specific are added as ``owned``. A value that more than ``most_repositories`` documents carry, or more than
    ``most_owners`` sources and more than ``few`` documents, is copied, else live; n_live and n_copied count both among base
    spans and candidates. ``carriers`` lists kind:start:end:repositories:owners:class of every value by start (kind ``own``
    for a candidate). Null text counts as empty, a null source is one owner, rows that repeat an identifier count as one
    document and share what is owned if their texts are equal. Texts are scanned whole. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("ident"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    scanned = cut(rows.mapInArrow(_scan, SCANNED))
    some = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*").distinct()
    known = join_groups(some, cut(ownership(scanned)), "hash", "repositories")
    copied = (F.col("repositories") > most_repositories) | ((F.col("owners") > most_owners) & (F.col("repositories") > few))
    said = F.struct("start", "stop", "kind", "repositories", "owners", F.when(copied, "copied").otherwise("live").alias("class"))
    per = known.groupBy("row").agg(F.collect_list(F.when((F.col("kind") == "own") & ~copied, F.struct("start", "stop"))).alias("owned"), F.count_if(~copied).alias("n_live"), F.count_if(copied).alias("n_copied"), F.sort_array(F.collect_list(said)).alias("carriers"))
    listed = F.array_join(F.transform(F.coalesce("carriers", F.array()), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"], s["repositories"], s["owners"], s["class"])), ",")
    joined = scanned.join(per, "row", "left").select("ident", "base", "n_assign", "n_access", "n_hex", "owned", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied")], listed.alias("carriers"))
    schema = "ident long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_owned long, n_live long, n_copied long, carriers string"
    return joined.mapInArrow(_write, schema).withColumnRenamed("ident", id_col)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
