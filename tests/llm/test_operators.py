"""The training-data operators against brute force, on small fixtures and on the smallest tables."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platewise.llm import exact_dedup, language_id, mixing, packing, pii, secrets, simhash, substring_dedup, url_filter, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, keep_id long, ident long, fp long, size int"


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeats and clashing column names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "  \t\n ", "en", "a"), (4, "Same Text here", "en", "a"), (5, "same text HERE", "en", "b"), (6, "one", None, "b"),
        (7, long, "en", "a"), (8, long + " tail", "en", None), (9, "12345 !!", "de", "a"), (10, passage, "de", "a"), (11, "before " + passage + " after", "de", "c"),
        (12, "ÄÖ é ß 日本語", "fr", "c"), (13, "one", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(params=["odd", "empty", "table"])
def docs(request, spark, sf):
    odd = odd_documents(spark)
    return {"odd": odd, "empty": odd.limit(0), "table": spark.read.parquet(f"{sf}/documents.parquet")}[request.param]


def test_exact_duplicates(docs):
    groups = collections.defaultdict(list)
    norm = {i: "".join(c.lower() if c.isascii() else c for c in t or "") for i, t in texts(docs).items()}
    for i, t in norm.items():
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs, keep="largest").collect()}
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    assert {r.doc_id for r in exact_dedup.drop_exact_duplicates(docs, keep="smallest").collect()} == {min(g) for g in groups.values()}


def test_dropping_tells_rows_apart(spark):
    rows = [(5, "alpha"), (5, "beta"), (9, "beta"), (7, "gamma"), (9, "BETA"), (None, "alpha"), (None, "z"), (None, "z"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, i, "g") for i, r in enumerate(rows)], "doc_id long, text string, key int, group string")
    found = sorted((str(r.doc_id), (r.text or "").lower()) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert found == [("3", ""), ("5", "alpha"), ("7", "gamma"), ("9", "beta"), ("None", "z")]
    found = sorted((str(r.doc_id), (r.text or "").lower()) for r in simhash.drop_near_duplicates(docs).collect())
    assert found == [("3", ""), ("5", "alpha"), ("5", "beta"), ("7", "gamma"), ("None", "z")]
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_trie_spills_closed_subtrees_and_loses_nothing():
    rng = random.Random(3)
    words = sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(300)})
    trie, seen = exact_dedup.PatriciaTrie(), 0
    for w in words:
        seen += sum(1 for _ in trie.spill_closed(w))
        trie.insert(w, 1, 0, 0, b"")
    assert seen + sum(1 for _ in trie.drain()) == len(words)


def brute_components(prints, most=2):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def slow_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def test_simhash_near_duplicates(docs):
    prints = {i: slow_print(t) for i, t in texts(docs).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ends = brute_components(prints)
    assert got == {i: (f"{p:016x}", ends[i]) for i, p in prints.items()}


def test_anchor_covering_finds_every_link(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            v = int(s)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {(r.a, r.b) for r in links} == want


def test_components_of_a_long_path(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_substring_duplicates(docs):
    words = {i: (t or "").encode().split() for i, t in texts(docs).items()}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k : k + 13]), i)
    want = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_duplicates(docs).collect()}
    assert got == want


def test_language_is_learned_and_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.9 * len(held)


def test_language_scores_are_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    assert 0.1 < model.heat < 10
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL").collect()
    right = [r.lang == r.lang_pred for r in rows]
    loss = -sum(np.log(r.score if ok else max(1e-9, 1 - r.score)) for r, ok in zip(rows, right, strict=True)) / len(rows)
    assert sum(right) >= 0.95 * len(rows) and loss < 0.2
    assert abs(sum(r.score for r in rows) / len(rows) - sum(right) / len(rows)) < 0.1
    assert max(r.score for r in rows) < 1 - 1e-6


def test_temperature_against_a_fine_grid():
    rng = np.random.default_rng(2)
    for scale in (0.3, 5.0, 60.0):
        y = rng.integers(0, 3, 80)
        logits = rng.normal(0, 1, (80, 3)) * scale + scale * 2 * np.eye(3)[y]
        grid = np.geomspace(1e-4, 1e4, 4001)
        best = min(language_id.smoothed_loss(logits, y, t) for t in grid)
        assert language_id.smoothed_loss(logits, y, language_id.temperature(logits, y)) <= best + 1e-6


def test_unlabelled_documents_pass_the_language_stage(spark):
    rows = [(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "", None), (4, "other words", None), (4, "other words", None)]
    got = language_id.keep_identified(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, _score string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "some words"), (4, "other words"), (4, "other words")]


def test_predictions_fill_missing_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = language_id.keep_identified(docs).collect()
    assert got and all(r.lang for r in got) and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert {i for i, (lang, _) in found.items() if lang == "und"} == {1, 2, 3, 9}
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_pii_is_replaced_alike_and_apart(spark):
    rows = [(1, "Mr. John Smith met Mrs. Jane Smith; a@b.com, +1 (017) 555-7713"), (2, "a@B.com from 1.2.3.4 or 5.6.7.8, card 4845168114407329"), (3, None), (4, ""), (5, "nothing"), (5, "nothing")]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[3] == [None] and by[4] == [""] and by[5] == ["nothing"] * 2
    for lost in ("John", "Jane", "a@b", "555-7713", "1.2.3.4", "5.6.7.8", "4845168114407329"):
        assert not any(lost in (t or "") for r in by.values() for t in r)
    mail = [re.search(r"\S+@[\w.]+", by[i][0])[0] for i in (1, 2)]
    assert mail[0].rstrip(",").lower() == mail[1].rstrip(",").lower()
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", by[1][0]) and "Mr. " in by[1][0] and "Mrs. " in by[1][0]


def test_pii_collisions_are_drawn_again(spark):
    def few(e, kind, attempt, key):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.concat(F.substring(F.sha2(F.concat(pii.canonical(e, kind), attempt.cast("string")), 256), 1, 1), F.lit("@x.yz"))

    docs = spark.createDataFrame([(i, f"mail w{i}@m.com and w{i % 5}@m.com and 3@x.yz") for i in range(10)], "doc_id long, text string")
    pairs = {}
    for r in pii.replace_entities(docs, draw=few).collect():
        for old, new in zip((f"w{r.doc_id}", f"w{r.doc_id % 5}", "3"), re.findall(r"(\S+)@", r.text), strict=True):
            assert pairs.setdefault(old, new) == new
    assert len(set(pairs.values())) == 11 and "3" not in pairs.values()


def test_secrets(spark):
    live, shared = "Zx9Qw8Er7Ty6Ui5Op4As3", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    rows = [(i, f"é see {shared} here", f"s{i}") for i in range(4)]
    rows += [(10, f"key {live}", "s1"), (11, "Token: 'abc' SECRET=longer_value AKIA" + "B" * 16 + " " + "0a" * 12, "s1"), (12, None, None), (13, "", "s2"), (13, "", "s2")]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[10].spans == "owned:4:25" and got[0].spans == "" and got[0].n_copied == 1
    assert (got[11].n_assign, got[11].n_access, got[11].n_hex) == (1, 1, 1)
    assert got[12].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("sizes", [None, (64, 16)])
def test_search_with_ties_and_odd_vectors(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(vector_search, "SHARD_ROWS", sizes[0])
        monkeypatch.setattr(vector_search, "LEAF", sizes[1])
    rng = random.Random(1)
    rows = [(i, [rng.randint(-2, 2) / 8 for _ in range(4)]) for i in range(300)] + [(i, [0.25] * 4) for i in range(300, 400)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (420, [float("inf")] * 4), (440, [])]
    rows += [(500, [1.0, 2.0]), (501, [0.5, 1.0])]
    docs = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "vec_id long, embedding array<float>, leaf int, floor double, shard string")
    got = collections.defaultdict(list)
    for r in vector_search.search(docs, F.col("ident") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows[:400]}
    for q in range(0, 400, 20):
        every = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
        assert got[q] == [(i, -s) for s, i in every[:7]]
    assert got[500] == [(501, 64 * 32 + 128 * 64)] and len(got) == 21
    assert vector_search.search(docs.limit(0), F.col("ident") % 20 == 0).count() == 0


def test_search_is_exact_for_large_components(spark):
    rows = [(i, [2.0**23 + i, -(2.0**22), 1.0 + i]) for i in range(60)]
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("ident") % 20 == 0, 3).collect()
    for q in (0, 20, 40):
        every = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(k, i, -s) for k, (s, i) in enumerate(every[:3], 1)]
    large = spark.createDataFrame([(1, [1e17, 1.0]), (2, [1e300, 1.0]), (3, [3.0, -1.0]), (4, [2.0**24, 2.0**24]), (20, [1.0, 2.0]), (40, [2.0**24, 1.0])], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in vector_search.search(large, F.col("ident") % 20 == 0, k=2).orderBy("query_id", "rank").collect()]
    ints = {3: (192, -64), 4: (1 << 30, 1 << 30), 20: (64, 128), 40: (1 << 30, 64)}
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    want = [(q, k, i, -s) for q in (20, 40) for k, (s, i) in enumerate(sorted((-dot(q, i), i) for i in ints if i != q)[:2], 1)]
    assert found == want


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs).collect()
    by, at = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        at[r.sequence_id].append((r.offset, r.length))
    for i, t in texts(docs).items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(by[i]) == [(k, 4096 * k, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, p in enumerate(parts)]
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(at) <= max(1, 1.1 * sum(r.length for r in rows) / 4096 + 1)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(30):
        counts = collections.Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 400)))
        used = collections.Counter()
        for pattern, n in packing.plan(counts, 64):
            assert sum(pattern) <= 64
            for x in pattern:
                used[x] += n
        assert used == counts


def test_encoding_of_runs_is_the_tokenizers_own(monkeypatch):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    odd = ["".join(rng.choices("aBcé İßſKΣς'., !?1²½ \x85\x0b\x1c\u00ad\u2003\u0300sStT|<>日\u2014\U0001f600\ud55c\uac00\u1100\u1161\u0416\u0663\uffff", k=rng.randint(0, 40))) for _ in range(1500)]
    odd += ["x<|endoftext|>y", "don't we'Ll <|startoftext|>", ""]
    want = [x.ids for x in encoder.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(odd)] == want
    monkeypatch.setattr(packing.WordEncoder, "GROUP", 50)
    assert [x.tolist() for x in encoder.encode(odd)] == want
    long = " ".join(odd[:300])
    assert next(encoder.encode([long])).tolist() == encoder.tokenizer.encode(long, add_special_tokens=False).ids


def test_exact_complements_step_past_blocked_pairs():
    # 6 + 6 + 4 + 4 needs both pairs; (6, 4, 6) is blocked where 6 is short
    assert sum(n for _, n in packing.plan({6: 2, 4: 2}, 20)) == 1
    assert sorted(packing.plan({7: 1, 5: 1, 3: 1, 1: 1}, 16)) == [((7, 5, 3, 1), 1)]
    # the pair of 9 that needs a second 7 is passed over for the next
    assert sum(n for _, n in packing.plan({9: 1, 7: 1, 5: 1, 4: 1, 2: 1, 1: 1}, 14)) == 2


def test_pieces_carry_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "a b c " * 40), (1, "a b c " * 40), (2, None), (None, "x y"), (3, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), window=64, with_ids=True).collect()
    assert collections.Counter((r.doc_id, r.start) for r in got) == collections.Counter([(1, 0), (1, 0), (1, 64), (1, 64), (2, 0), (None, 0), (3, 0)])
    for r in got:
        text = {1: rows[0][1], 2: "", None: "x y", 3: ""}[r.doc_id]
        assert r.ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 1][r.start : r.start + r.length]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y", "http://example.net", "x://net/", "https://b.org/fr/#f", "https://example.com/de/1", "https://c.io?q#z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(8, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.host, r.path, r.rule) for r in url_filter.judge(pages, labels).orderBy("page_id").collect()]
    assert got == [("", "", None)] * 3 + [("a.example.net", "/en/x", "example.net/en/"), ("example.net", "", None), ("net", "/", "net/"), ("b.org", "/fr/", "org/fr/"), ("example.com", "/de/1", "example.com/de/"), ("c.io", "", None)]
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_domains_and_suffixes(spark):
    hosts = {"a.b.example.co.uk:80": ("example.co.uk", "co.uk"), "u@x.example.com": ("example.com", "com"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "local": ("local", "local"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = rows.select("host", url_filter.domain_of(F.col("host")).alias("d"), url_filter.suffix_of(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in got} == hosts


def test_judging_ties_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", 3, "x"), (1, "http://a.com/", 3, "x"), (2, None, 1, "y"), (None, "http://b.com", 0, "z")], "page_id long, url string, n long, host string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels)
    assert sorted((str(r.page_id), r.host) for r in got.collect()) == [("1", "a.com"), ("1", "a.com"), ("2", ""), ("None", "b.com")]
    bound = {r.host: r.bound for r in got.collect()}["a.com"]
    assert {r.verdict for r in url_filter.judge(pages, labels, limit=bound).where("host = 'a.com'").collect()} == {"allow"}


def test_bad_hosts_are_blocked_by_their_labels(spark):
    pages = spark.createDataFrame([(i, f"https://{'bad' if i % 2 else 'good'}.com/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {(r.host, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got == {("bad.com", "block"), ("good.com", "allow")}


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mixed(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    per = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(s for s, _ in per.values()))
    assert all(t <= 2 * s + 1e-9 for s, t in per.values())
    assert mixing.mix(docs).count() == sum(r.copies for r in rows)


def test_targets_fill_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": pytest.approx(1445.0), None: 0.0}


def test_stages_keep_columns_with_clashing_names(spark):
    names = "_text _ok _lang_pred _score _rate _copy _documents _source_key key group node root".split()
    rows = [(i, f"der hund und die katze {i}" if i % 2 else f"the dog and a cat {i}", "de" if i % 2 else "en", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for stage in (language_id.keep_identified, mixing.mix):
        kept = stage(docs)
        assert kept.columns == docs.columns and all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in names)
