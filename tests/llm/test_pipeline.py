"""The pipeline's stages, each against brute force on the stage's own input."""

import collections

import __spark_entry__
import corpus_pipeline
import pyarrow as pa
from platewise.llm import language_id, mixing, packing
from tests.llm.test_jaccard import least_of_components, slow_shingles


def normal(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_stages_against_brute_force(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf).collect(), docs.schema)
        assert after.columns == docs.columns
        rows, kept = before.collect(), after.collect()
        if name == "language_id":
            model = language_id.fit(before)
            want = set()
            for r in rows:
                lang, score = model.predict(r.text) if any(c.isalpha() for c in r.text or "") else ("und", 0.0)
                if lang != "und" and (score >= 0.5 or lang == r.lang):
                    want.add((r.doc_id, r.lang or lang))
            assert {(r.doc_id, r.lang) for r in kept} == want and len(kept) == len(want)
        if name == "exact_dedup":
            best = collections.defaultdict(int)
            for r in rows:
                best[normal(r.text)] = max(best[normal(r.text)], r.doc_id)
            assert sorted(r.doc_id for r in kept) == sorted(best.values())
        if name == "near_dedup":
            assert sorted(r.doc_id for r in kept) == sorted(least_of_components({r.doc_id: slow_shingles(r.text) for r in rows}))
        if name == "mixing":
            copies = collections.Counter({r.doc_id: r.copies for r in mixing.mixed(before).collect()})
            assert collections.Counter(r.doc_id for r in kept) == +copies
            size = collections.Counter()
            for r in rows:
                size[r.source] += len((r.text or "").split())
            assert all(2 * sum(len((r.text or "").split()) for r in kept if r.source == s) <= 4 * n + 1 for s, n in size.items())
        before = after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in before.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.update((r.doc_id, k, tuple(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    got = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert collections.Counter((r.doc_id, r.start, tuple(r.ids)) for r in got) == want
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spots in used.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 4096


def test_whole_run_and_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_registered_queries():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_language_id_hands_only_texts_to_python(spark, sf):
    kept = language_id.keep_identified(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("BatchEvalPython") == 1


def test_packing_hands_on_ids_in_small_batches():
    batch = pa.RecordBatch.from_pydict({"ident": pa.array(range(3000)), "ids": pa.array([bytes([i % 256, 0]) for i in range(3000)])})
    out = list(packing._full(iter([batch]), 2))
    assert max(map(len, out)) <= 1024 and [x for b in out for x in b.column(1).to_pylist()] == [[i % 256] for i in range(3000)]
