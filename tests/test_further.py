"""Lattice search, label sheets, food labels, folded settings, sketches and stored rules: literal cases and brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from platewise.operators import families, findings, jobs, labels, lattice, layout, predicates, press, settings
from platewise.streaming import monitors


def test_lattice_finds_the_nearest_colour(spark):
    rng = random.Random(3)
    tone = lambda s: (rng.uniform(0, 100), rng.uniform(-s, s), rng.uniform(-s, s))
    references = [(f"r{i}", *tone(40)) for i in range(60)] + [("far", 50.0, 900.0, -900.0), ("a0", 10.0, 0.0, 0.0), ("a1", 10.0, 0.0, 0.0)]
    colors = [(f"c{i}", *tone(120)) for i in range(120)] + [("tie", 10.0, 0.0, 0.0), ("edge", 50.0, 5000.0, 0.0), ("none", None, 0.0, 0.0), ("nan", math.nan, 0.0, 0.0)]
    got = {r.k: (r.name, round(r.distance, 6)) for r in lattice.nearest_colors(spark.createDataFrame(colors, "k string, l double, a double, b double"), spark.createDataFrame(references, "name string, l double, a double, b double"), "k").collect()}
    want = {}
    for k, *c in colors[:-2]:
        d, name = min((math.dist(c, r[1:]), r[0]) for r in references)
        want[k] = (name, round(d, 6))
    assert got == want
    empty = spark.createDataFrame([], "name string, l double, a double, b double")
    assert lattice.nearest_colors(spark.createDataFrame(colors, "k string, l double, a double, b double"), empty, "k").count() == 0


def test_a_sheet_of_labels_is_one_lattice(spark):
    rng = random.Random(1)
    sheet = [(1, 1, 10 + 120.0 * c, 20 + 90.0 * r, 110 + 120.0 * c, 100 + 90.0 * r) for c in range(5) for r in range(2)]
    strays = [(2, 1, x, y, x + 100, y + 80) for x, y in ((rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(40))]
    row = [(3, 1, 50.0 * c, 0.0, 50.0 * c + 40, 40.0) for c in range(4)]
    rows = [*sheet, (1, 1, 0.0, 0.0, 700.0, 300.0), *strays, *row, (4, 1, 0.0, 0.0, 5.0, 5.0), (4, 1, 9.0, 0.0, 14.0, 5.0)]
    found = layout.step_and_repeat(spark.createDataFrame(rows, "job_id long, page_num int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted((r.job_id, r.boxes, r["columns"], r["rows"], r.step_x, r.step_y) for r in found) == [(1, 10, 5, 2, 120.0, 90.0), (3, 4, 4, 1, 50.0, None)]


def test_allergens_in_their_declaration(spark):
    far = "x " * 100
    texts = [
        "Ingredients: wheat flour, MILK, eggs", "Gluten Free. Ingredients: rice", f"Ingredients here. {far} milk", "Our ingredients. Contains: soya and Soy", "wheat: no list", "Ingredients: Almonds, almonds", "INGREDIENTS may contain peanuts", "Ingredients: barley",
    ]
    df = spark.createDataFrame([(1, i, t, i == 7) for i, t in enumerate(texts)], "job_id long, page_num int, text string, bold boolean")
    got = sorted((r.page_num, r.allergen, r.at, r.word) for r in labels.allergen_emphasis(df).collect())
    assert got == [(0, "cereals containing gluten", 14, "wheat"), (0, "eggs", 33, "eggs"), (3, "soybeans", 37, "Soy"), (5, "nuts", 14, "Almonds"), (5, "nuts", 23, "almonds"), (6, "peanuts", 25, "peanuts")]


def test_order_of_nutrients(spark):
    texts = ["Energy fat saturates carbohydrate sugars protein salt", "energy salt fat protein sugars", "100 kJ sugars carbohydrate", "fat energyless salt", "Energy", "salt then energy"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "job_id long, page_num int, text string")
    got = sorted((r.page_num, r.first, r.second, r.found, r.kept) for r in labels.nutrient_order(df).collect())
    assert got == [(1, "sugars", "protein", 5, 3), (2, "carbohydrate", "sugars", 2, 1), (5, "energy", "salt", 2, 1)]


def test_settings_fold_by_their_strategy(spark):
    layer = lambda name, items=None, entries=None, locked=False: (name, items, entries, locked)
    rows = [
        (1, "replace", [layer("default", ["a"]), layer("tenant", ["b", "b"]), layer("workflow")]), (2, "union", [layer("default", ["a", "b"]), layer("tenant", ["c", "a"]), layer("call", ["d"])]),
        (3, "merge", [layer("default", None, {"x": "1", "y": "1"}), layer("tenant", None, {"y": "2"}), layer("workflow", None, {"z": "3"})]), (4, "union", [layer("default", ["a"]), layer("tenant", ["t"], None, True), layer("call", ["d"])]),
        (5, "merge", [layer("default", None, {"x": "1"}), layer("tenant", None, {"y": "2"}, True), layer("workflow", None, {"z": "3"})]), (6, "union", [layer("default", ["a"]), layer("tenant", None, None, True), layer("call", ["d"])]), (7, "odd", [layer("default", ["a"]), layer("call", [])]), (8, "merge", []),
    ]
    got = {r.id: (r["items"], r.entries, r.source) for r in settings.folded_settings(spark.createDataFrame(rows, f"id int, strategy string, layers array<{settings.LAYER}>"), ["id"]).collect()}
    assert got == {
        1: (["b"], {}, {"b": "tenant"}), 2: (["a", "b", "c", "d"], {}, {"a": "default", "b": "default", "c": "tenant", "d": "call"}), 3: ([], {"x": "1", "y": "2", "z": "3"}, {"x": "default", "y": "tenant", "z": "workflow"}), 4: (["t"], {}, {"t": "tenant"}),
        5: ([], {"y": "2"}, {"y": "tenant"}), 6: (["a", "d"], {}, {"a": "default", "d": "call"}), 7: ([], {}, {}), 8: ([], {}, {}),
    }


def test_sketches_roll_up_within_their_error(spark):
    rng = random.Random(9)
    values = [rng.lognormvariate(3, 1) for _ in range(6000)]
    rows = [(dt.datetime(2024, 1, 1 + i % 20), {"parse": v, "rules": None}) for i, v in enumerate(values)]
    sketches = jobs.stage_sketches(spark.createDataFrame(rows, "ts timestamp, stages map<string,double>"))
    assert sketches.count() == 20
    told = jobs.stage_percentiles(sketches, ["stage"]).collect()
    assert [(r.stage, r.n) for r in told] == [("parse", 6000)]
    for share in (50, 90, 99):
        rank = sum(v <= told[0][f"p{share}"] for v in values) / len(values)
        assert abs(rank - share / 100) <= jobs.RANK_ERROR


def test_stored_rules_are_checked_before_the_plan(spark):
    table = spark.createDataFrame([(1, 2.0, "Type3", True, None), (2, 7.0, "Type1", False, "x")], "job_id long, size_pt double, subtype string, embedded boolean, note string")
    rule = lambda test: [{"id": "R", "severity": "error", "test": test}]
    ids = lambda test: [r.job_id for r in predicates.apply_stored(table, rule(test), "job_id").collect()]
    assert ids({"all": [{"is": "text_below"}, {"is": "font_of_type", "type": "Type3"}]}) == [1]
    assert ids({"not": {"is": "font_embedded"}}) == [2] and ids({"any": [{"col": "note", "contains": "x"}, {"col": "size_pt", "lte": 2}]}) == [1, 2]
    assert ids({"col": "note", "missing": True}) == [1] and ids({"not": {"col": "note", "eq": "y"}}) == [1, 2] and ids({"all": []}) == [1, 2] and ids({"any": []}) == []
    assert ids({"col": "subtype", "in": ["Type1", "TrueType"], "regex": "1$"}) == [2]
    bad = [
        {"is": "no_such"}, {"is": "hairline"}, {"is": "text_below", "point": 3}, {"is": "text_below", "points": "5"}, {"is": "font_of_type", "type": "a' OR '1"}, {"col": "none", "eq": 1}, {"col": "size_pt", "eq": "5"}, {"col": "subtype", "gt": "a"}, {"col": "size_pt", "like": 1},
        {"col": "size_pt", "in": 3}, {"or": []}, {}, {"all": [], "any": []}, {"col": "embedded", "eq": 1}, {"col": "size_pt", "contains": "x"}, "text_below",
    ]
    for test in bad:
        with pytest.raises(predicates.RuleError):
            predicates.apply_stored(table, rule(test), "job_id")
    with pytest.raises(predicates.RuleError):
        predicates.stored_rules('[{"id": "R", "severity": "fatal", "test": {}}]')
    assert predicates.apply_stored(table.where(F.lit(False)), rule({"is": "font_embedded"}), "job_id").count() == 0


def codes(df):
    return sorted((r.job_id, r.page_num, r.inspection_id, r.severity) for r in df.collect())


def test_sizes_are_rounded_as_they_are_stored(spark):
    # 1.005 is stored a little below the tie: on a page it is the size 1.0, not 1.01
    runs = spark.createDataFrame([(1, 1, x, 0.5, 0.0, 0.0, 0.0) for x in (1.005, 1.0)] + [(1, 2, x, 0.5, 0.0, 0.0, 0.0) for x in (1.005, 1.01)], "job_id long, page_num int, size_pt double, c double, m double, y double, k double")
    paths = spark.createDataFrame([], "job_id long, page_num int, c double, m double, y double, k double, fill boolean")
    docs = spark.createDataFrame([], "job_id long, substrate string")
    assert sorted(r.page_num for r in press.hard_rejections(paths, runs, docs).collect()) == [1, 2, 2]


def test_hard_rejections_of_the_press_without_black(spark):
    fill = [(1, 1, 0.95, 1.0, 0.96, 0.5, True), (1, 1, 0.95, 1.0, 0.96, 0.5, True), (2, 1, 0.0, 0.0, 0.0, 0.8, True), (3, 1, 1.0, 1.0, 1.0, 1.0, True), (4, 1, 0.4, 0.2, 0.2, 0.95, True), (5, 1, 0.0, 0.9, 0.0, 0.95, False), (6, 1, 0.3, 0.3, 0.3, 0.2, True)]
    text = [(7, 1, 4.0, 0.0, 0.0, 0.0, 1.0), (7, 2, 4.0, 0.5, 0.0, 0.0, 1.0), (7, 2, 4.001, 0.5, 0.0, 0.0, 1.0), (7, 3, 5.0, 0.5, 0.0, 0.0, 0.0)]
    inks = "c double, m double, y double, k double"
    paths, runs = spark.createDataFrame(fill, f"job_id long, page_num int, {inks}, fill boolean"), spark.createDataFrame(text, f"job_id long, page_num int, size_pt double, {inks}")
    docs = spark.createDataFrame([(8, "Clear TRANSPARENT film"), (9, "silk"), (10, None)], "job_id long, substrate string")
    assert codes(press.hard_rejections(paths, runs, docs)) == sorted([
        (1, 1, "EPM_GAMUT_OUT_REJECT", "error"), (2, 1, "EPM_K_COVERAGE_REJECT", "error"), (3, 1, "EPM_GAMUT_OUT_REJECT", "error"), (3, 1, "EPM_RICH_BLACK_REJECT", "error"), (4, 1, "EPM_K_COVERAGE_REJECT", "error"), (7, 2, "EPM_TEXT_SIZE_REJECT", "error"), (8, 0, "EPM_SUBSTRATE_REJECT", "error"),
    ])


def test_soft_rejections_and_advisories(spark):
    sides = ("x0", "y0", "x1", "y1")
    box = ", ".join(f"{p}{s} double" for p in "mcbt" for s in sides)
    none = (None,) * 4
    pages = [(1, n, 0.0, 0.0, 100.0, 100.0, *none, *none, 10.0, 10.0, 90.0, 90.0) for n in range(4)] + [(2, 1, 0.0, 0.0, 100.0, 100.0, *none, 5.0, 5.0, 95.0, 95.0, 10.0, 10.0, 92.0, 90.0), (2, 2, 0.0, 0.0, 120.0, 100.0, *none, *none, 10.0, 10.0, 90.0, 90.0)]
    spaces = [(1, "DeviceCMYK", None), (2, "DeviceCMYK", None), (2, "DeviceRGB", None), (2, "Separation", "Gold"), (2, "DeviceN", "Silver"), (2, "DeviceN", "Cyan"), (2, "DeviceN", "Red"), (3, "DeviceGray", None)]
    images = [(1, 1, "a", 100, 100, 72.0, 0.0, 0.0, 72.0), (1, 1, "a", 90, 90, 72.0, 0.0, 0.0, 72.0), (1, 2, "b", 200, 300, 72.0, 0.0, 0.0, 72.0)]
    strokes = [(1, 1, False, 0.3), (1, 1, False, 0.3), (1, 1, False, 0.35), (1, 1, True, 0.1), (1, 1, False, 0.0)]
    p, s = spark.createDataFrame(pages, f"job_id long, page_num int, {box}"), spark.createDataFrame(spaces, "job_id long, cs_type string, colorant string")
    found = codes(press.soft_rejections(s, p, spark.createDataFrame(images, "job_id long, page_num int, image_name string, pixel_width int, pixel_height int, a double, b double, c double, d double")))
    assert found == [(1, 1, "EPM_IMAGE_RES_REJECT", "warning"), (2, 0, "EPM_PAGE_COUNT_REJECT", "warning"), (2, 0, "EPM_PROCESS_COUNT_REJECT", "warning"), (2, 0, "EPM_TRIM_REJECT", "warning"), (2, 1, "EPM_BLEED_REJECT", "warning")]
    docs = spark.createDataFrame([(1, "True"), (2, " yes "), (3, None), (4, "Unknown")], "job_id long, trapped string")
    found = codes(press.advisories(s, spark.createDataFrame(strokes, "job_id long, page_num int, fill boolean, line_width double"), docs, p, spots=2))
    assert found == [
        (1, 1, "EPM_FEATURE_SIZE_REJECT", "advisory"), (2, 0, "EPM_MIXED_SPACES_REJECT", "advisory"), (2, 0, "EPM_PAGE_GEOM_REJECT", "advisory"), (2, 0, "EPM_SPOT_COUNT_REJECT", "advisory"), (2, 1, "EPM_TRIM_BLEED_REJECT", "advisory"), (2, 2, "EPM_TRIM_BLEED_REJECT", "advisory"),
        (3, 0, "EPM_TRAPPING_REJECT", "advisory"), (4, 0, "EPM_TRAPPING_REJECT", "advisory"),
    ]


def test_strokes_by_rule(spark):
    base = {"stroke": True, "line_width": 2.0, "line_cap": 1, "c": 0.5, "m": 0.0, "y": 0.0, "k": 0.0, "stroke_alpha": None, "stroke_grey": None, "flatness": 1.0, "point_count": 5}
    faults = [{}, {"line_width": 0.4, "line_cap": 0}, {"line_width": 0.7, "k": 0.2}, {"stroke_alpha": 0.0}, {"stroke_grey": 1.0}, {"stroke_grey": 1.0, "stroke_alpha": 1.0}, {"flatness": 3.0}, {"point_count": 10_001}, {"stroke": False, "line_width": 0.4, "line_cap": 0}, {"flatness": None}]
    df = spark.createDataFrame([{"job_id": n, **base, **f} for n, f in enumerate(faults)], "job_id long, stroke boolean, line_width double, line_cap int, c double, m double, y double, k double, stroke_alpha double, stroke_grey double, flatness double, point_count int")
    got = sorted((r.job_id, r.inspection_id) for r in families.fused(df, families.line_rules(), "job_id").collect())
    assert got == [(1, "STROKE_003"), (2, "STROKE_007"), (3, "STROKE_005"), (4, "STROKE_005"), (6, "STROKE_006"), (7, "PATH_001")]


def test_a_run_adopts_what_has_no_baseline(spark):
    schema = "job_id long, inspection_id string, severity string, page_num int"
    expected = spark.createDataFrame([(1, "A", "error", 1), (1, "B", "error", None), (2, "A", "error", 1)], schema)
    actual = spark.createDataFrame([(1, "B", "error", None), (1, "C", "error", 2), (2, "A", "error", 1), (2, "A", "error", 1), (3, "A", "error", 1)], schema)
    assays = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id long")
    got = sorted(tuple(r) for r in findings.regression_run(expected, actual, assays).collect())
    assert got == [(1, 1, 1, 1, False, False), (2, 0, 0, 1, False, True), (3, 0, 0, 1, True, True), (4, 0, 0, 0, True, True)]
    base = findings.adopted(expected, actual)
    assert sorted((r.job_id, r.inspection_id) for r in base.collect()) == [(1, "A"), (1, "B"), (2, "A"), (3, "A")]


def test_names_of_two_versions(spark):
    one, two = (spark.createDataFrame(rows, "job_id long, name string") for rows in ([(1, "a"), (1, "b"), (1, "b"), (2, "x")], [(1, "b"), (1, "c"), (1, None), (2, "x"), (3, "y")]))
    assert sorted(tuple(r) for r in jobs.compare_names(one, two, ["job_id"], "name").collect()) == [(1, "c", "a"), (3, "y", "")]


def test_ages_are_counted_between_seconds_of_the_clock(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = ["2024-01-21 23:59:59.5", "2024-01-22 00:00:00", "2024-01-22 00:00:00.5"]
    rows = spark.createDataFrame(list(enumerate(at)), "delivery_id long, at string").select("delivery_id", F.lit("job.x").alias("event"), F.col("at").cast("timestamp").alias("created_at"), F.lit("processing").alias("status"))
    assert sorted(r.delivery_id for r in jobs.retained(rows, [("job.*", 10)], now).collect()) == [1, 2]
    assert sorted(r.delivery_id for r in monitors.stuck(rows, now, 10 * 24 * 60).collect()) == [0]
