"""Hard negatives, document fingerprints and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import conversations, hard_negatives, spotsigs

# --- hard negatives


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90, every=100, scale=256):
    """rows: (vec_id, label, vector)"""
    kept = []
    for i, label, v in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    found = []
    for i, label, q in kept:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), j, other) for j, other, x in kept if j != i and len(x) == len(q)]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)
            found += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(fits[:negatives], 1)]
    return sorted(found)


def mined(spark, rows, every=100, **more):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, label int, embedding array<double>, key string, ident int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, label, F.col("ident") % every == 0, **more).collect())


def clustered(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, (centers[rng.integers(0, 12)] + rng.normal(size=dim) * 0.1).tolist()) for i in range(n)]
    # ties and repeats
    return [*rows, *[(n + k, k % 2, rows[5][2]) for k in range(30)]]


@pytest.mark.parametrize("shard", [40, 8192])
def test_hard_negatives(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    odd = [(100, 1, None), (200, None, [1.0] * 6), (300, 1, []), (301, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, 1, [float("nan")] * 6), (400, 1, [float("inf")] * 6), (500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.1]), (502, 2, [0.5, 1.0]), (503, 1, [1e300] * 6), (600, 2, [1e5] * 6), (601, 2, [3e5] * 6)]
    rows = [(i + 1000, *r) for i, *r in clustered(1, 400)] + odd
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, rows, positives=2, negatives=500, low=-20, high=100) == brute_negatives(rows, 2, 500, -20, 100)


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, [(100, 1, [1.0, 0.0])]) == [] and mined(spark, [(100, 1, [1.0]), (1, 1, [1.0])]) == []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.hard_negatives(empty, F.col("label"), F.col("ident") >= 0).count() == 0


@pytest.mark.parametrize("dim", [2, 5, 40])
def test_cover_tree_covers_and_its_bounds_hold(monkeypatch, dim):
    monkeypatch.setattr(hard_negatives, "LEAF", 6)
    rows = clustered(dim, 300, dim)
    points = np.floor(np.array([v for *_, v in rows]) * 256)
    shard = hard_negatives.Shard(np.arange(len(points)), np.zeros(len(points), np.int64), points)
    query = shard.ask(-1, 0, True, np.floor(np.random.default_rng(9).normal(size=dim) * 256))

    def below(node):
        return np.concatenate([below(p) for p in node.parts]) if node.parts else node.rows

    def check(node):
        rows = below(node)
        wide = hard_negatives.augmented(points)
        assert np.sqrt(((wide[rows] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        upper, lower = query.bounds(node)
        scores = points[rows] @ query.query
        assert lower <= scores.min() and scores.max() <= upper
        for part in node.parts:
            check(part)
            assert part.radius <= node.radius + 1e-9

    check(shard.tree)
    assert sorted(below(shard.tree)) == list(range(len(points)))


def test_search_skips_nodes_of_clustered_points():
    rng = np.random.default_rng(3)
    points = np.floor((rng.normal(size=(40, 16))[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 0.02) * 256)
    shard = hard_negatives.Shard(np.arange(8000), np.zeros(8000, np.int64), points)
    query = shard.ask(-1, 0, True, points[17])
    query.best(hard_negatives.LOW, -(hard_negatives.LOW + 1), 10)
    leaves, stack = 0, [shard.tree]
    while stack:
        node = stack.pop()
        stack += node.parts
        leaves += not node.parts
    assert 1 <= sum(k < 0 for k in query.known) < leaves / 4


# --- fingerprints


def slow_signatures(text):
    low = (text or "").lower()
    words, word = [], ""
    for c in low + " ":
        if c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    common = set(spotsigs.COMMON)
    content = [(words[k - 1] if k else "^", w) for k, w in enumerate(words) if w not in common]
    if not content:
        return [hashlib.md5(low.encode()).hexdigest()[:8]] if low else []
    chains = [" ".join([before, *(w for _, w in content[k : k + 3])]) for k, (before, _) in enumerate(content) if before == "^" or before in common]
    return sorted({hashlib.md5(c.encode()).hexdigest()[:8] for c in chains})


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_prints(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    found = {}
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        own, new, far = (slow_signatures(t) for t in (text, edited, other))
        found[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(new), round(jaccard(own, new), 9), round(jaccard(own, far), 9))
    return found


def prints(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.edited_fingerprints(df).collect()}


ODD_TEXTS = [None, "", " ", "!!! ???", "a", "The", "the of and", "word", "日本語 テキスト 🎉🎉 the end", "x" * 5000, "The cat of the house sat on a mat. " * 900, "É à la carte et les vins du pays", "same text here", "same text here"]


@pytest.mark.parametrize("wide", [64, 2])
def test_document_fingerprints(spark, sf, monkeypatch, wide):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", wide)
    rows = [(i * i - 20, t) for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame([(*r, 5, "z", "y") for r in rows], "doc_id long, text string, n_chars int, range string, sigs string")
    assert prints(df) == brute_prints(rows)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert prints(table) == brute_prints([(r.doc_id, r.text) for r in table.collect()])


def test_fingerprints_of_repeats_nulls_and_nothing(spark):
    rows = [(5, "alpha beta"), (5, "alpha beta"), (5, "gamma"), (None, "the end of it"), (None, None), (9, "alpha beta")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = spotsigs.edited_fingerprints(df).collect()
    assert len(found) == len(rows)
    assert len({(r.n_chars, r.fingerprint) for r in found}) == 4 and all(r.near_next in (0.0, 1.0) for r in found)
    assert spotsigs.edited_fingerprints(df.limit(0)).count() == 0
    one = spotsigs.edited_fingerprints(df.limit(1)).first()
    assert one.near_next == 1.0


def test_similar_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [" ".join(rng.choice(["the", "of", word()]) + " " + word() for _ in range(60)) for _ in range(12)]
    texts = list(base)
    for _ in range(150):
        words = rng.choice(base[:3] if rng.random() < 0.7 else base).split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words[: rng.choice([len(words), len(words) - 8])]))
    texts += [None, "", "", "!", *texts[:5]]
    rng.shuffle(texts)
    sets = [set(slow_signatures(t)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.class_id for r in spotsigs.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) < len(texts) / 2


# --- conversations


def slow_repair(symbols):
    """Dijkstra over (cost, audit), so that of equal costs the least audit comes first."""
    import heapq

    heap, seen = [(0, "", 0, conversations.START)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(symbols) and state in (0, 3):
            return cost, audit
        rest = [("I", 5, i, {0: 2, 1: 2, 2: 3, 3: 2}[state])]
        if i < len(symbols):
            initial, fault = symbols[i] % 4, symbols[i] // 4
            rest.append(("D", 2, i + 1, state))
            if fault != 1:
                more = 5 * (fault == 2)
                rest.append(("R", 1 + more, i + 1, {0: 2, 1: 2, 2: 3, 3: 2}[state]))
                to = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((state, initial))
                if to is not None:
                    rest.append(("K", more, i + 1, to))
        for edit, c, j, to in rest:
            heapq.heappush(heap, (cost + c, audit + edit, j, to))


def test_search_finds_the_least_cheapest_audit():
    every = [s for n in range(5) for s in itertools.product((0, 1, 2, 3, 5, 9, 10), repeat=n)]
    rng = random.Random(4)
    longer = [tuple(rng.randrange(12) for _ in range(rng.randrange(5, 14))) for _ in range(300)]
    for symbols in every + longer:
        want = slow_repair(symbols)
        assert conversations.search(bytes(symbols), conversations.faulty_ahead(bytes(symbols))) == want
        assert conversations.descend(bytes(symbols)) == want


def slow_conversations(rows):
    """rows: (conv_id, turn, role, text) -> the contract's row per conversation, by its words."""
    groups = {}
    for conv, turn, role, text in rows:
        group = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        group += [(turn is not None, turn or 0, digest, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, group in groups.items():
        group.sort()
        seen, symbols, counts = set(), [], [0, 0, 0]
        for *_, role, text in group:
            ink = text.strip(" \t\n\v\f\r")
            fault = 1 if not ink or (role, text) in seen else 2 if ink[-1] not in ".!?" else 0
            counts[0 if not ink else 1 if fault == 1 else 2] += fault > 0
            seen.add((role, text))
            symbols.append("sua".find(role[:1]) % 4 + 4 * fault if role else 3 + 4 * fault)
        cost, audit = slow_repair(symbols)
        turns = [t for given, t, *_ in group if given]
        legal = {"su", "ua", "au"}
        illegal = sum((a[3][:1] + b[3][:1]) not in legal for a, b in itertools.pairwise(group))
        out, todo = [], iter(group)
        odd = sum(e != "D" for e in audit) % 2
        for edit in audit:
            row = next(todo) if edit != "I" else (None, None, None, None, "")
            if edit != "D":
                named = ("user", "assistant")[(len(out) - odd) % 2]
                out.append(f"{named if edit in 'RI' else row[3]}:{row[4]}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def repaired(df):
    return {r[0]: tuple(r)[1:] for r in conversations.repair_conversations(conversations.damaged(df)).collect()}


def test_conversations_are_repaired(spark, sf):
    rng = random.Random(8)
    texts = ["Hello.", "What?", "no end", "", " \t", None, "Fine!", "Ünïcode 🎉.", "Hello. \n"]
    rows = [(c, rng.choice([None, t, t, t + 2]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", f"turn {t}.") for t in range(5)] + [(900, t, ("user", "assistant")[t % 2], f"Turn {t}" + "." * (t % 3 > 0)) for t in range(1500)] + rows[:40]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, copies int, hash string, reads boolean")
    assert repaired(df) == slow_conversations(rows)
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    assert repaired(table) == slow_conversations([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert repaired(df.limit(0)) == {}


def test_conversations_without_rows_are_returned(spark):
    gone = next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, gone, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert repaired(df) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
