"""Literal cases of rules whose meaning SQL made from the same words could not show, and brute force where there is no SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from platewise.operators import accuracy, content, families, findings, similarity, standards
from platewise.operators.registry import Families
from platewise.sources import readers


def hits(df, *keys):
    return sorted(tuple(r[k] for k in (*keys, "inspection_id", "severity")) for r in df.collect())


@pytest.mark.parametrize(
    "codes, verdict, upsell",
    [
        ([], "pass", False), (["COLOR_004"], "pass", False), (["EPM_TEXT_SIZE_REJECT"], "reject", False), (["EPM_BLEED_REJECT"], "marginal", False), (["EPM_BLEED_REJECT", "EPM_TRIM_REJECT"], "reject", False),
        (["EPM_TRAPPING_REJECT"], "pass_with_advisory", False), (["EPM_SPOT_COUNT_REJECT"], "pass_with_advisory", False), (["EPM_005"], "marginal", True), (["EPM_GAMUT_OUT_REJECT", "EPM_010"], "reject", True),
        (["EPM_BLEED_REJECT"] * 3, "marginal", False), (["EPM_PAGE_GEOM_REJECT", "EPM_TRIM_BLEED_REJECT"], "pass_with_advisory", False),
    ],
)
def test_press_verdicts(spark, codes, verdict, upsell):
    rows = [(1, i, c) for i, c in enumerate(codes)] or [(1, 0, None)]
    got = findings.press_verdict(spark.createDataFrame(rows, "job_id long, ord long, inspection_id string")).first()
    assert (got.verdict, got.upsell) == (verdict, upsell)


def test_color_score_of_clean_and_critical_jobs(spark):
    rows = [(1, 0, "IMG_001", "error"), (2, 0, "COLOR_004", "warning"), (2, 1, "COLOR_004", "error"), (3, 0, "COLOR_013", "error"), (4, 0, None, None), (5, 0, "COLOR_013", "warning")]
    got = {r.job_id: (r.score, r.grade, r.floor) for r in findings.color_score(spark.createDataFrame(rows, "job_id long, ord long, inspection_id string, severity string")).collect()}
    assert got == {1: (100.0, "Excellent", None), 2: (90.0, "Excellent", None), 3: (20.0, "Critical", 20.0), 4: (100.0, "Excellent", None), 5: (100.0, "Excellent", None)}


def test_page_boxes(spark):
    box = [f"{k}{c} double" for k in "mcbt" for c in ("x0", "y0", "x1", "y1")]
    none, media = [None] * 4, [0.0, 0.0, 200.0, 100.0]

    def page(n, crop=none, bleed=(5.0, 5.0, 195.0, 95.0), trim=(15.0, 15.0, 185.0, 85.0), rotate=0, unit=1.0, objects=1):
        return (1, n, *media, *crop, *bleed, *trim, rotate, unit, objects)

    rows = [page(1), page(2, trim=none), page(3, bleed=none), page(4, bleed=(-1.0, 5.0, 195.0, 95.0)), page(5, crop=(0.0, 0.0, 201.0, 100.0)), page(6, trim=(4.0, 15.0, 185.0, 85.0)), page(7, rotate=90), page(8, rotate=45), page(9, unit=2.0), page(10, objects=0), page(11, trim=(10.0, 15.0, 185.0, 85.0))]
    got = hits(families.box_rules(spark.createDataFrame(rows, f"job_id long, page_num int, {', '.join(box)}, rotate int, user_unit double, objects int")), "page_num")
    want = [(2, "BOX_001", "warning"), (3, "BOX_001", "warning"), (4, "BOX_002", "warning"), (5, "BOX_002", "warning"), (6, "BOX_002", "warning"), (6, "BOX_003", "warning")]
    assert got == [*want, (8, "BOX_008", "advisory"), (9, "BOX_007", "warning"), (10, "BOX_004", "advisory"), (11, "BOX_003", "warning")]


def test_grey_and_black(spark):
    rows = [(1, 0.3, 0.3, 0.32, 0.0, True), (2, 0.3, 0.3, 0.32, 0.1, True), (3, 0.3, 0.3, 0.32, 0.0, False), (4, 0.06, 0.0, 0.0, 0.91, True), (5, 0.05, 0.0, 0.0, 1.0, True), (6, 0.06, 0.0, 0.0, 0.9, True)]
    df = spark.createDataFrame(rows, "op_idx int, c double, m double, y double, k double, fill boolean").withColumn("line_width", F.lit(1.0))
    assert hits(families.fused(df, families.ink_rules(), "op_idx"), "op_idx") == [(1, "COLOR_016", "warning"), (4, "COLOR_017", "warning")]


def test_overprint_state_is_carried(spark):
    rows = [
        (1, "colour", None, None, None, "DeviceRGB", 0.0), (2, "overprint", True, 0, None, "DeviceCMYK", 0.0), (3, "colour", None, None, None, "DeviceRGB", 0.0), (4, "colour", None, None, None, "DeviceCMYK", 0.0),
        (5, "path", None, None, None, "Separation", 0.0), (6, "opacity", None, None, 0.5, None, 0.0), (7, "overprint", None, 1, None, "DeviceCMYK", 0.0), (8, "overprint", False, None, None, "DeviceCMYK", 0.0), (9, "text", None, None, None, "DeviceCMYK", 1.0),
    ]
    df = spark.createDataFrame([(1, *r[:-1], 0.0, 0.0, 0.0, r[-1]) for r in rows], "job_id long, op_idx int, kind string, overprint boolean, opm int, alpha double, color_space string, c double, m double, y double, k double")
    want = [(2, "OVER_002", "warning"), (3, "OVER_006", "error"), (4, "OVER_004", "warning"), (5, "OVER_001", "warning"), (7, "OVER_003", "warning"), (9, "OVER_007", "warning")]
    assert hits(families.overprint_rules(df), "op_idx") == want


def test_placeholders(spark):
    rows = [(1, "see Lot Number here"), (2, "PILOT NUMBER"), (3, "Best before: 12 May"), (4, "BEST BEFORE date"), (5, "put [BRAND NAME] and FPO, fpo"), (6, "best before end; " + "x" * 40 + " Best Before: 1"), (7, None), (8, "a loser, closer"), (9, "Template # 12")]
    got = {(r.job_id, r.phrase) for r in families.placeholder_text(spark.createDataFrame([(i, 1, t) for i, t in rows], "job_id long, page_num int, text string")).collect()}
    assert got == {(1, "LOT NUMBER"), (4, "BEST BEFORE"), (5, "FPO"), (5, "[BRACKETED PLACEHOLDER]"), (6, "BEST BEFORE"), (9, "Template #...")}


def test_element_strings(spark):
    cases = {
        "3103000189011234567890": [("310", "3000189", True), ("01", "1234567890", False)],
        "]C10112345678901231\x1d": [("01", "12345678901231", True), ("?", "\x1d", False)],
        "10AB\x1d17250230": [("10", "AB", True), ("17", "250230", True)],
        "99x0112345678901231": [("?", "99x0112345678901231", False)],
        "8200http://a.b": [("8200", "http://a.b", True)], "": [], "21": [("21", "", False)], "\x1d3012345678\x1d209": [("30", "12345678", True), ("20", "9", False)],
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: [tuple(e) for e in r.e] for r in df.select("p", content.gs1_elements(F.col("p")).alias("e")).collect()}
    assert got == cases


def test_greedy_replay_against_brute_force(spark):
    rng = random.Random(7)

    def some(n, verdict):
        rows = []
        for i in range(n):
            x, y = rng.choice([None, rng.random() * 4]), rng.random() * 4
            box = [None] * 4 if x is None else [x, y, x + 4.0, y + 4.0]
            rows.append((rng.choice("ab"), rng.choice("rs"), i, *box, *([rng.choice(["disputed", "confirmed", "skipped"])] if verdict else [])))
        return rows

    old, new = some(60, True), some(60, False)
    base = "file string, rule string, id long, x0 double, y0 double, x1 double, y1 double"
    got = accuracy.replay_matches(spark.createDataFrame(old, base + ", verdict string"), spark.createDataFrame(new, base), ["file", "rule"])
    free, want = {o[2]: o for o in old}, set()

    def iou(a, b):
        if a[0] is None or b[0] is None:
            return 1.0
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / (32 - w * h)

    for n in new:
        found = [(iou(n[3:7], o[3:7]), -o[2]) for o in free.values() if o[:2] == n[:2]]
        best = max(found, default=(0, 0))
        if best[0] >= 0.5:
            want.add((n[1], -best[1], n[2]))
            del free[-best[1]]
        else:
            want.add((n[1], None, n[2]))
    want |= {(o[1], o[2], None) for o in free.values()}
    assert {(r.rule, r.old_id, r.new_id) for r in got.collect()} == want
    score = {r.rule: r for r in accuracy.replay_score(got).collect()}
    assert score[None].baseline == 60 and score[None].fresh == 60 and score["r"].baseline + score["s"].baseline == 60
    assert score[None].removed_disputed == sum(free[i][7] == "disputed" for i in free) and score[None].removed_confirmed == sum(free[i][7] == "confirmed" for i in free)


def test_text_hashes_bring_near_texts_together(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words)), (4, " ".join(f"z{i}" for i in range(400))), (5, None), (6, "")]
    got = {(r.one, r.two, r.distance) for r in similarity.near_hashes(similarity.text_hashes(spark.createDataFrame(rows, "id long, t string"), "id", "t")).collect()}
    assert (1, 3, 0) in got and (5, 6, 0) in got and any(a == 1 and b == 2 for a, b, _ in got) and not any(4 in p[:2] for p in got)


def test_families_are_selected_before_the_plan(spark):
    some = Families()
    rows = spark.createDataFrame([(1, 2)], "job_id long, page_num int")
    read = []

    def table(name):
        read.append(name)
        return rows

    some.register("one", "a", "t1")(lambda t: t.withColumns({"inspection_id": F.lit("X"), "severity": F.lit("error")}))
    some.register("two", "b", "t2")(lambda t: t.drop("page_num").withColumns({"inspection_id": F.lit("Y"), "severity": F.lit("warning")}))
    assert [tuple(r) for r in some.findings(table, categories=("b",)).collect()] == [("two", 1, 0, "Y", "warning")] and read == ["t2"]
    assert some.findings(table).count() == 2
    with pytest.raises(ValueError):
        some.register("one", "a")(None)
    with pytest.raises(ValueError):
        some.findings(table, names=("none",))


def test_packs_differ_by_level(spark):
    flags = "encrypted linearized has_prev has_id has_xmp names_js open_js embedded_files xfa launch_action reader_allowed has_create_date has_mod_date intent_profile transfer_functions halftones transparency has_layer_config has_metadata".split()
    good = {f: f in ("has_id", "has_xmp", "reader_allowed", "has_create_date", "has_mod_date", "intent_profile", "has_metadata") for f in flags}
    base = {"version": "1.4", "xmp_pdfx": "PDF/X-4", "xmp_version": "", "xmp_title": "t", "title": "t", "trapped": "True", "intents": 1, "condition": "F", "intent_subtype": "GTS_PDFX", "info_pdfx": "v", "form_fields": 0, "layers": 0, "ps_xobjects": 0, "pdfa_part": "1", "pdfa_conformance": "B"}
    rows = [{"job_id": 1, **base, **good}, {"job_id": 2, **base, **good, "embedded_files": True, "version": "1.6"}]
    found = standards.standards({"docs": spark.createDataFrame(rows)})
    assert {(r.job_id, r.pack, r.inspection_id, r.severity) for r in found.collect()} == {
        (1, "X-4", "PDFX4-001", "error"), (2, "X-4", "PDFX4-073", "error"), (2, "X-1a", "PDFX1A-035", "error"), (2, "A-1", "PDFA-028", "error"), (2, "A-2", "PDFA-028", "warning"), (2, "A-1", "PDFA-009", "error")
    }
    assert {(r.job_id, r.pack): r.conforms for r in standards.conformance(found).collect()}[2, "A-2"]


def test_rulesets_and_thresholds_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ruleset_id": "r", "enabled": ["*"], "max_severity": null,\n "thresholds": {"min_dpi": 150, "max_ink": 300}}')
    rulesets = readers.rulesets(spark, str(tmp_path))
    jobs = spark.createDataFrame([(1, "r", {"min_dpi": 200.0, "other": 1.0}), (2, "r", {})], "job_id long, ruleset_id string, override map<string,double>")
    got = {r.job_id: r.thresholds for r in readers.resolved_thresholds(rulesets, jobs).collect()}
    assert got == {1: {"min_dpi": 200.0, "max_ink": 300.0}, 2: {"min_dpi": 150.0, "max_ink": 300.0}}


def test_metadata_of_standard_a_by_rule(spark):
    good = {"has_metadata": True, "has_xmp": True, "pdfa_part": "1", "pdfa_conformance": "B", "title": "t", "xmp_title": "t", "has_create_date": True, "has_mod_date": True, "intents": 1, "intent_profile": True, "condition": None, "version": "1.4"}
    faults = {
        "PDFA-010": {"has_metadata": False}, "PDFA-001": {"has_xmp": False, "pdfa_part": None}, "PDFA-002": {"pdfa_part": ""}, "PDFA-003": {"pdfa_conformance": None}, "PDFA-004": {"title": "other"}, "PDFA-005": {"has_create_date": False},
        "PDFA-006": {"has_mod_date": False}, "PDFA-007": {"intents": 0, "intent_profile": False}, "PDFA-008": {"intent_profile": False}, "PDFA-009": {"version": "1.5"},
    }
    rows = [{"job_id": 0, **good}, {"job_id": 99, **good, "intent_profile": False, "condition": "FOGRA39"}, *({"job_id": n, **good, **f} for n, f in enumerate(faults.values(), 1))]
    df = spark.createDataFrame(rows, "job_id long, has_metadata boolean, has_xmp boolean, pdfa_part string, pdfa_conformance string, title string, xmp_title string, has_create_date boolean, has_mod_date boolean, intents int, intent_profile boolean, condition string, version string")
    tests = tuple((name, severity, test) for pack, name, severity, table, test in standards.PACKS if pack == standards.A1 and table == "docs" and name <= "PDFA-010")
    weak = {"PDFA-004", "PDFA-005", "PDFA-006"}
    assert hits(standards.apply_rules(df, tests, "job_id"), "job_id") == [(n, k, "warning" if k in weak else "error") for n, k in enumerate(faults, 1)]


def test_colour_spaces_by_rule(spark):
    rows = [
        (1, 1, "CalRGB", None, None, False, False, False), (2, 1, "DeviceRGB", None, None, False, False, True), (3, 1, "DeviceRGB", None, None, True, False, False), (4, 1, "DeviceN", None, "Gold", True, False, True), (5, 1, "Separation", "DeviceCMYK", "All", True, False, True),
        (6, 1, "Lab", None, None, False, False, True), (7, 1, "Indexed", None, None, False, False, True), (8, 1, "DeviceCMYK", None, None, False, True, True), (9, 1, "ICCBased", None, None, True, False, True), (9, 1, "Lab", None, None, True, False, True), (9, 1, "Lab", None, None, True, False, True),
    ]
    spaces = spark.createDataFrame(rows, "job_id long, page_num int, cs_type string, alternate string, colorant string, has_profile boolean, has_default boolean, has_intent boolean")
    found = hits(standards.color_space_rules(spaces, spark.createDataFrame([(1, 0), (2, 1)], "job_id long, intents int")), "job_id", "page_num")
    assert found == sorted([
        (1, 0, "COLOR_006", "warning"), (1, 1, "COLOR_001", "error"), (2, 1, "COLOR_002", "warning"), (2, 1, "COLOR_015", "advisory"), (4, 1, "COLOR_003", "warning"), (4, 1, "COLOR_007", "advisory"), (6, 1, "COLOR_018", "advisory"), (7, 1, "COLOR_019", "advisory"),
        (8, 1, "COLOR_015", "advisory"), (8, 1, "COLOR_020", "warning"), (9, 1, "COLOR_018", "advisory"),
    ])


def test_profiles_by_rule(spark):
    base = {"space": "CMYK", "components": 4, "size": 9, "is_intent": True, "subtype": "GTS_PDFX", "condition": "FOGRA39", "has_tags": True, "white_x": 0.9642, "white_z": 0.8249}
    faults = [{}, {"components": 3}, {"size": 0}, {"subtype": None}, {"subtype": "odd"}, {"condition": ""}, {"has_tags": False}, {"white_x": 0.98}, {"is_intent": False, "subtype": None, "condition": None}, {"condition": "unheard of"}]
    df = spark.createDataFrame([{"job_id": n, **base, **f} for n, f in enumerate(faults)], "job_id long, space string, components int, size int, is_intent boolean, subtype string, condition string, has_tags boolean, white_x double, white_z double")
    got = [h for h in hits(standards.apply_rules(df, standards.PROFILE, "job_id"), "job_id") if h[1] != "ICC_005"]
    assert got == [(1, "ICC_001", "error"), (2, "ICC_003", "error"), (3, "ICC_004", "warning"), (4, "ICC_004", "warning"), (5, "ICC_004", "warning"), (6, "ICC_007", "warning"), (7, "ICC_009", "warning")]
    known = {h[0] for h in hits(standards.apply_rules(df, standards.PROFILE, "job_id"), "job_id") if h[1:] == ("ICC_005", "advisory")}
    assert known == set(range(10)) - {5, 8}


def test_accessibility_by_rule(spark):
    good = {"tagged": True, "marked": False, "lang": "en", "intents": 1, "tab_order": True, "encrypted": False, "reader_allowed": False}
    faults = [{}, {"tagged": False}, {"lang": None}, {"lang": " "}, {"marked": True}, {"intents": 0}, {"tab_order": False}, {"encrypted": True}, {"tagged": False, "marked": True}]
    df = spark.createDataFrame([{"job_id": n, **good, **f} for n, f in enumerate(faults)], "job_id long, tagged boolean, marked boolean, lang string, intents int, tab_order boolean, encrypted boolean, reader_allowed boolean")
    assert hits(standards.apply_rules(df, standards.ACCESS, "job_id"), "job_id") == [
        (1, "ACCESS_001", "advisory"), (2, "ACCESS_002", "advisory"), (2, "ACCESS_004", "warning"), (3, "ACCESS_004", "warning"), (4, "ACCESS_003", "advisory"), (5, "ACCESS_012", "advisory"), (6, "ACCESS_013", "advisory"), (7, "SCREEN_READER", "warning"), (8, "ACCESS_001", "advisory"),
    ]
    nodes = spark.createDataFrame([(0, t) for t in ("H2", "Table", "LI", "Artifact", "Em")] + [(2, t) for t in ("H", "TH", "L", "Artifact", "Strong", "Table", "LI")], "job_id long, type string")
    images = spark.createDataFrame([(0, 3), (0, 3), (1, 1)], "job_id long, page_num int")
    docs = df.where("job_id < 4 AND job_id <> 3")
    assert hits(standards.structure_tag_rules(nodes, docs, images), "job_id", "page_num") == [(0, 0, "ACCESS_007", "warning"), (0, 0, "ACCESS_008", "advisory"), (0, 3, "ACCESS_005", "warning")]


def test_packaging_layers_by_rule(spark):
    layers = spark.createDataFrame([(1, "Dieline", True, "OFF"), (1, "Cut", True, "ON"), (2, "Die", True, "ON"), (3, "Art", False, "OFF")], "job_id long, name string, dieline boolean, print_state string")
    got = hits(standards.packaging(layers, spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "job_id long")), "job_id")
    assert got == [(1, "PKG_001", "advisory"), (1, "PKG_003", "advisory"), (2, "PKG_001", "advisory"), (3, "PKG_002", "warning"), (4, "PKG_002", "warning")]


def test_replays_of_small_groups_cost_no_call_each(spark):
    base = "file long, rule string, id long, x0 double, y0 double, x1 double, y1 double"
    old = spark.createDataFrame([(1, "r", 1, 0.0, 0.0, 4.0, 4.0, "disputed"), (1, "r", 2, 0.0, 0.0, 4.0, 4.0, "confirmed"), (2, "r", 3, None, 0.0, 1.0, 1.0, "skipped")], base + ", verdict string")
    new = spark.createDataFrame([(1, "r", 8, 0.0, 0.0, 4.0, 4.0), (1, "r", 9, 50.0, 0.0, 54.0, 4.0), (2, "r", 7, 0.0, 0.0, float("nan"), 1.0), (3, "r", 6, 0.0, 0.0, 1.0, 1.0)], base)
    got = accuracy.replay_matches(old, new, ["file", "rule"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("r", 1, 8, "disputed"), ("r", None, 9, None), ("r", 2, None, "confirmed"), ("r", 3, 7, "skipped"), ("r", None, 6, None)]))
    assert "InPandas" not in got._jdf.queryExecution().toString()
