"""Joins that avoid all pairs: boxes in cells, names by deletions, hashes by parts, vectors by shards; each against all pairs."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.operators import dieline, families, similarity, spatial

BOXES = "job_id long, op_idx long, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n, side=2000.0, jobs=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w, h = (rng.choice([0, 5, 30, 200, 1900]) * rng.random() for _ in "xy")
        x, y = rng.uniform(-50, side), rng.uniform(-50, side)
        rows.append((rng.randrange(jobs), i, x, y, x + w, y + h))
    return rows


@pytest.mark.parametrize("within", [0.0, 25.0])
def test_box_pairs_are_all_pairs_that_meet(spark, within):
    one, two = boxes(1, 150), boxes(2, 150)
    one += [(0, 900, 0.0, 0.0, 72.0, 72.0), (0, 901, 72.0, 72.0, 144.0, 144.0), (0, 902, None, 0.0, 1.0, 1.0), (0, 903, 5.0, 5.0, 1.0, 9.0), (0, 904, float("nan"), 0.0, 1.0, 1.0)]
    two += [(0, 905, 72.0, 72.0, 72.0, 72.0), (0, 906, -1e7, -1e7, 1e7, 1e7)]
    got = [(r.op_idx, r.oop_idx) for r in spatial.box_pairs(spark.createDataFrame(one, BOXES), spark.createDataFrame(two, BOXES), ["job_id"], within).collect()]
    good = lambda b: all(v is not None and v == v for v in b[2:]) and b[2] <= b[4] and b[3] <= b[5]
    want = {(a[1], b[1]) for a in one for b in two if a[0] == b[0] and good(a) and good(b) and a[2] - within <= b[4] and b[2] <= a[4] + within and a[3] - within <= b[5] and b[3] <= a[5] + within}
    assert len(got) == len(set(got)) and set(got) == want
    empty = spark.createDataFrame([], BOXES)
    assert spatial.box_pairs(empty, empty, ["job_id"]).count() == 0


def test_boxes_of_a_larger_sheet_are_compared_in_proportion(spark):
    def compared(n):
        side = 60.0 * n**0.5
        rows = [(0, i, x, y, x + 20, y + 20) for i, (x, y) in enumerate(np.random.default_rng(4).uniform(0, side, (n, 2)).tolist())]
        df = spark.createDataFrame(rows, BOXES)
        cells = spatial._in_cells(spatial._placed(df, 0.0, spatial.CELL), F.array("_level"), spatial.CELL)
        return cells.groupBy("_cx", "_cy").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]

    assert compared(8000) < 5 * compared(2000)


def test_dieline_content_on_repeated_dies(spark):
    page = "job_id long, page_num int"
    regions = [(1, 1, 100.0 * k, 0.0, 100.0 * k + 80, 80.0) for k in range(3)] + [(2, 1, 0.0, 0.0, 80.0, 80.0), (2, 1, 200.0, 0.0, 210.0, 80.0)]
    art = [(1, 1, 1, "art", 10.0, 10.0, 70.0, 70.0), (1, 1, 2, "art", 70.0, 10.0, 84.0, 20.0), (1, 1, 3, "art", 10.0, 10.0, 290.0, 20.0), (1, 1, 4, "crease", -90.0, 0.0, 0.0, 0.0), (2, 1, 5, "art", 100.0, 0.0, 150.0, 10.0), (2, 1, 6, "art", 0.0, -20.0, 5.0, 0.0)]
    df = spark.createDataFrame(art, f"{page}, op_idx long, role string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.job_id, r.inspection_id, r.boxes, r.worst) for r in dieline.content_outside(df, spark.createDataFrame(regions, f"{page}, x0 double, y0 double, x1 double, y1 double")).collect())
    assert got == [(1, "DIE_CONTENT_OUTSIDE", 2, 110.0), (1, "DIE_EXCESSIVE_BLEED", 1, 10.0), (2, "DIE_CONTENT_OUTSIDE", 1, 20.0), (2, "DIE_EXCESSIVE_BLEED", 1, 20.0)]


def test_small_dieline_features(spark):
    rows = [(1, 1, [(0.0, 0.0), (2.0, 0.0), (2.0, 40.0)]), (1, 1, [(0.0, 0.0), (90.0, 0.0), (90.0, 90.0)]), (2, 1, [(1.0, 1.0)])]
    got = dieline.small_features(spark.createDataFrame(rows, "job_id long, page_num int, points array<struct<x:double,y:double>>")).collect()
    assert [(r.job_id, r.inspection_id, r.features, r.smallest) for r in got] == [(1, "DIE_TOO_SMALL", 1, 0.705556)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_close_names_are_all_close_names(spark):
    rng = random.Random(5)
    names = {"".join(rng.choices("ab", k=rng.randrange(0, 7))) for _ in range(60)}
    for _ in range(60):
        word = "pantone warm " + "".join(rng.choices("abcdef", k=rng.randrange(2, 12)))
        names.add(word)
        for _ in range(3):
            at = rng.randrange(len(word))
            names.add(word[:at] + rng.choice(["", "x", "xy", word[at : at + 1] * 2]) + word[at + rng.randrange(2) :])
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.other, r.distance) for r in families.close_pairs(df, []).collect()}
    want = {(a, b, d) for a, b in itertools.combinations(sorted(names), 2) if 1 <= (d := distance(a, b)) <= 2}
    assert got == want and len(want) > 100


def test_near_hashes_are_all_near_hashes(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            v ^= 1 << b
        values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for parts in (6, 7, 8):
        df = spark.createDataFrame(list(enumerate(signed)), "ident long, phash long")
        keys = df.select("ident", F.explode(similarity.hash_keys(F.col("phash"), parts)).alias("k"))
        met = {(r.a, r.b) for r in keys.alias("x").join(keys.alias("y"), "k").select(F.col("x.ident").alias("a"), F.col("y.ident").alias("b")).where("a < b").collect()}
        assert {(a, b) for a, b in itertools.combinations(range(300), 2) if (values[a] ^ values[b]).bit_count() <= 4} <= met


def test_near_hashes_compare_in_proportion(spark):
    made = lambda n: spark.range(n).select(F.col("id").alias("ident"), F.xxhash64("id").alias("phash"))
    few, many = (similarity.hash_candidates(made(n)).count() for n in (2_000, 16_000))
    assert many <= 80 * max(few, 30) and many < 16_000


def test_keys_of_hashes_are_dealt_by_their_own_number(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TASK_KEYS", 1000, raising=False)
    nodes = spark.range(2_000).select(F.col("id").alias("ident"), F.xxhash64("id").alias("phash")).coalesce(1)
    met = similarity.hash_candidates(nodes)
    # 15 keys of a hash
    assert met.rdd.getNumPartitions() == 31 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_similar_vectors_are_exact(spark, sf, monkeypatch):
    monkeypatch.setattr(similarity, "SHARD_VECTORS", 100)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows += [(10_001, rows[0][1]), (10_002, [2 * x for x in rows[0][1]]), (10_003, [0.0] * 64), (10_004, [1.0, 2.0]), (10_005, None), (10_006, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "ident long, v array<double>")
    got = {}
    for r in similarity.similar_vectors(df, df.where("ident % 20 = 0 OR ident > 10000")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.ident, r.cosine))
    fine = [(i, np.array(v)) for i, v in rows if v and len(v) == 64 and any(v) and not np.isnan(v).any()]
    unit = {i: v / np.linalg.norm(v) for i, v in fine}
    for q in [i for i in unit if i % 20 == 0 or i > 10_000]:
        best = sorted(((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q))[:5]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in best]
    assert set(got) <= set(unit)


def test_similar_vectors_hold_few_cosines_at_a_time():
    n, asked, dim = 16_384, 1_000, 4
    rng = np.random.default_rng(3)

    def rows(asks, m):
        v = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dim), pa.array(rng.standard_normal(m * dim)))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int64)), pa.array(np.full(m, asks)), pa.array(np.arange(m)), v], ["key", "asks", "ident", "v"])

    given = [rows(False, n), rows(True, asked)]
    tracemalloc.start()
    try:
        found = sum(len(b) for b in similarity._best(iter(given), 5))
        assert found == 5 * asked and tracemalloc.get_traced_memory()[1] < 48 << 20
    finally:
        tracemalloc.stop()


def test_names_of_small_and_large_jobs_are_compared_alike(spark):
    rng = random.Random(5)
    rows = [(j, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(rng.randint(1, 2)))) for j in (1, 2, 3) for _ in range(25)]
    inks = spark.createDataFrame([*rows, (4, None), (4, "abca"), (4, "abcb")], "job_id long, colorant string")
    few, many = ({tuple(r) for r in families.close_pairs(inks.withColumnRenamed("colorant", "name"), ["job_id"], paired=n).select("job_id", "name", "other", "distance").collect()} for n in (64, 2))
    assert few == many and (4, "abca", "abcb", 1) in few
    few, many = ({tuple(r) for r in families.token_typos(inks, paired=n).collect()} for n in (64, 2))
    assert few == many and (4, "abca", "abcb", "abca", "abcb") in few
