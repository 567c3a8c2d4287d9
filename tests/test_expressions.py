"""Column expressions and operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from platewise.functions import color as C
from platewise.functions import geometry as G
from platewise.functions import text as T
from platewise.operators import findings as A
from platewise.operators import series as S
from platewise.sources import readers
from platewise.streaming import monitors as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_resolution_of_known_rotated_and_degenerate_matrices(spark):
    lit = [F.lit(float(v)) for v in (300, 300)]
    assert one(spark, G.effective_dpi(*lit, *[F.lit(float(v)) for v in (72, 0, 0, 72)])) == pytest.approx(300)
    assert one(spark, G.effective_dpi(*lit, *[F.lit(float(v)) for v in (0, 72, -72, 0)])) == pytest.approx(300)
    assert one(spark, G.effective_dpi(*lit, *[F.lit(float(v)) for v in (0, 0, 0, 0)])) is None


# pairs of the published CIEDE2000 test data
@pytest.mark.parametrize(
    "lab1, lab2, expected",
    [
        ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425),
        ((50, -1.0, 2.0), (50, 0, 0), 2.3669),
        ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
        ((50, 2.5, 0), (73, 25, -18), 27.1492),
        ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
    ],
)
def test_color_difference(spark, lab1, lab2, expected):
    one_, two = (tuple(F.lit(float(v)) for v in lab) for lab in (lab1, lab2))
    assert one(spark, C.delta_e2000(one_, two)) == pytest.approx(expected, abs=1e-4)


def test_check_digit_glob_and_tokens(spark):
    assert one(spark, T.check_digit(F.lit("400638133393"))) == 1
    assert one(spark, T.glob(F.lit("COLOR_004"), "COLOR_*")) and not one(spark, T.glob(F.lit("XCOLOR_004"), "COLOR_*"))
    assert one(spark, T.token_similarity(F.lit("Best before May"), F.lit("best BEFORE june"))) == pytest.approx(0.5)


def test_boxes(spark):
    a, b = (G.Box(*[F.lit(float(v)) for v in c]) for c in ((0, 0, 10, 10), (5, 5, 15, 15)))
    assert one(spark, a.iou(b)) == pytest.approx(25 / 175)
    assert one(spark, a.overhang(b)) == 5
    assert one(spark, a.gap(G.Box(*[F.lit(float(v)) for v in (13, 14, 20, 20)]))) == 5


def test_conditions(spark):
    rows = spark.createDataFrame([(1, "A", "error", 3, "engine", 3), (2, "A", "error", 1, None, 3), (3, "B", "error", 1, "ai", 3)], "ord int, inspection_id string, severity string, page_num int, source string, pages int")
    rules = {"A": [{"when": {"page": {"in": [-1]}}, "include": False}, {"when": {"source": {"ne": "ai"}}, "severity": "advisory"}]}
    found = {r.ord: r.severity for r in A.evaluate(rows, rules, {"B": "warning"}, None).collect()}
    assert found == {2: "error", 3: "warning"}  # a missing source never matches


def test_control_rules_on_short_flat_and_spiked_series(spark):
    rows = [("flat", i, i, 5.0) for i in range(10)] + [("one", 0, 0, 1.0)] + [("spike", i, i, 100.0 if i == 15 else (20.0 if i % 2 else -20.0)) for i in range(30)]
    points = spark.createDataFrame(rows, "series string, ts long, seq long, value double")
    found = {(r.series, r.rule, r.side, r.seq) for r in S.control_alerts(points).collect()}
    assert found == {("spike", 1, "up", 15)}


def test_payloads_fall_back_and_explode(spark, tmp_path):
    box = '{"x0":0,"y0":0,"x1":10,"y1":20}'
    line = f'{{"job_id":1,"version":"1.6","page_count":1,"color_spaces":[{{"id":"cs1","type":"DeviceN","components":2}}],"pages":[{{"page_num":1,"media":{box},"fonts":[],"images":[{{"name":"Im1","width":3,"height":4,"color_space_id":"cs1"}}]}}]}}'
    (tmp_path / "a.json").write_text(line + "\nbroken\n")
    tables = readers.explode_payloads(readers.payloads(spark, str(tmp_path)))
    page = tables["pages"].first()
    assert page.trim == page.media and page.rotate == 0
    assert tables["images"].first().cs_type == "DeviceN"


def test_imported_findings(spark):
    raw = spark.createDataFrame([(1, None, "Fatal", "bad"), (1, "X", "odd", "worse"), (1, "Y", "hint", " ")], "job_id long, check string, severity string, message string")
    found = {r.message: (r.inspection_id, r.severity) for r in readers.imported_findings(raw, {"fatal": "error"}).collect()}
    assert found["worse"] == ("X", "warning") and found["bad"][1] == "error" and found["bad"][0].startswith("EXT-CUSTOM-") and len(found) == 2


def test_streams_agree_with_their_batch_twins(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = X.requests_per_window(stream, "user_id", "ts", "1 day", 5).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, X.requests_per_window(events, "user_id", "ts", "1 day", 5).collect()))


def test_continuous_checking_skips_redelivered_findings(spark, tmp_path):
    rows = [(1, 1, "error"), (1, 1, "error"), (1, 2, "warning"), (2, 1, "advisory")]
    found = spark.createDataFrame(rows, "job_id long, ord long, severity string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    found.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(found.schema).parquet(str(tmp_path / "in"))
    X.check_continuously(stream, lambda b: A.counts(b, "job_id"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = {r.job_id: (r.total, r.passed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (2, False), 2: (1, True)}
