"""What one task holds or computes: rules without interpreted functions, and rows dealt by their number."""

from pyspark.sql import functions as F

from platewise.operators import families


def plan(df) -> str:
    """The plan as it is before it runs: with a run it is printed twice."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_rules_are_compiled(spark):
    rows = spark.createDataFrame([(1, 5.0, "x"), (2, None, "y"), (3, 50.0, "z")], "job_id long, v double, s string")
    found = families.fused(rows, {"A#1": ("warning", F.col("v") > 1), "A#2": (F.col("s"), F.col("v") > 10), "B": ("error", F.col("v").isNull())}, "job_id")
    assert "lambda" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "A", "warning"), (2, "B", "error"), (3, "A", "warning"), (3, "A", "z")]


def test_rows_go_to_tasks_by_their_number(spark):
    from platewise.operators.dealing import ROWS, dealt, tasks_for

    rows = spark.range(10_000)
    assert (tasks_for(rows), tasks_for(rows, 1000), tasks_for(spark.range(3 * ROWS))) == (3, 11, 4)
    spread = dealt(rows.withColumn("k", F.col("id") % 100), 7, "k").groupBy("k", "id").count()
    assert plan(spread).count("Exchange hashpartitioning") == 1 and spread.count() == 10_000


def explicit_exchanges(df) -> int:
    return plan(df).count("REPARTITION_BY_NUM")


def test_references_of_one_place_are_one(spark):
    from platewise.operators import lattice

    references = spark.range(5000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), *[F.lit(1.0).alias(c) for c in "lab"])
    inks = spark.createDataFrame([(1, "x", 1.0, 1.0, 2.0), (1, "x", 1.0, 1.0, 0.0), (1, "x", 1.0, 1.0, 0.0), (2, "y", None, 1.0, 1.0)], "job_id long, ink string, l double, a double, b double")
    reach = lattice.spot_reach(inks, references)
    assert sorted(map(str, (tuple(r) for r in reach.collect()))) == ["(1, 'x', 'achievable', 'advisory', 'r00000', 1.0)", "(2, 'y', 'unmapped', 'advisory', None, None)"]
    assert explicit_exchanges(reach) == 1


def test_inks_are_shuffled_as_rows_once_for_all_counts(spark):
    rows = [(1, 2, "Pantone_185  C", "a", "x"), (1, 10, "pantone 185 c", "b", "x"), (1, 2, "pantone-185 c", None, "y"), (2, 1, "Gold", None, None)]
    found = families.ink_inventory(spark.createDataFrame(rows, "job_id long, page_num int, colorant string, alternate string, cs_type string"))
    assert sorted(map(tuple, found.collect())) == [(1, "pantone 185 c", "10,2", 2, 2, True), (2, "gold", "1", 0, 0, False)]
    assert "Expand" not in plan(found) and explicit_exchanges(found) == 1


def test_a_lattice_needs_no_join(spark):
    from platewise.operators import layout

    rows = [(1, 1, 120.0 * c, 90.0 * r, 120.0 * c + 100, 90.0 * r + 80) for c in range(4) for r in range(2)] + [(2, 1, 30.0 * c, 0.0, 30.0 * c + 20, 40.0) for c in (0, 1, 2, 4, 6)] * 2
    found = layout.step_and_repeat(spark.createDataFrame(rows, "job_id long, page_num int, x0 double, y0 double, x1 double, y1 double"), agree=0.5)
    assert [tuple(r)[4:] for r in found.orderBy("job_id").collect()] == [(8, 4, 2, 120.0, 90.0), (5, 5, 1, 30.0, None)]
    assert "Join" not in plan(found) and explicit_exchanges(found) == 2


def test_visible_rulesets_are_dealt_by_tenant(spark):
    from platewise.operators import settings

    tenants = spark.createDataFrame([(1, "free"), (1, "pro"), (2, None)], "tenant_id long, plan string")
    rulesets = spark.createDataFrame([("a", "all", None, None), ("p", "plan", "pro", None), ("l", "list", None, [2, 2]), ("b", "both", "free", [1])], "ruleset_id string, mode string, min_plan string, allowed array<long>")
    found = settings.visible_rulesets(tenants, rulesets)
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (1, "b"), (1, "p"), (2, "a"), (2, "l")]
    assert explicit_exchanges(found) == 1


def test_font_rules_send_bits(spark):
    from platewise.operators import typography

    fields = "job_id long, page_num int, base_font string, name string, subtype string, embedded boolean, standard_14 boolean, encoding string, cid_info string, descriptor boolean, files array<string>, weight int, stem_v int, italic_angle double"
    plainly = ("Type1", True, False, "W", "A", False, [], None, None, 0.0)
    rows = [(1, 1, "F", "b", *plainly), (1, 1, "F", None, *plainly[:2], True, *plainly[3:]), (1, 2, None, "F", *plainly), (1, 1, None, "G", *plainly[:3], None, *plainly[4:])]
    found = typography.font_program_rules(spark.createDataFrame(rows, fields))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "F", "FONT_003", "advisory"), (1, 1, "G", "FONT_007", "advisory")]
    sent = next(line for line in plan(found).splitlines() if "Exchange" in line)
    assert "WindowGroupLimit" in plan(found) and "descriptor" not in plan(found).split("Exchange")[0] and sent


def test_page_sizes_are_told_by_their_ends(spark):
    from platewise.operators import press

    box = ", ".join(f"{p}{s} double" for p in "mctb" for s in ("x0", "y0", "x1", "y1"))
    page = lambda job, n, w, h: (job, n, 0.0, 0.0, w, h, *[None] * 12)
    pages = spark.createDataFrame([page(1, 1, 9.0, 5.0), page(1, 2, 9.0, 6.0), page(2, 1, 9.0, 5.0), page(2, 2, 9.01, 5.0), page(2, 3, None, 8.0)], f"job_id long, page_num int, {box}")
    spaces = spark.createDataFrame([], "job_id long, cs_type string, colorant string")
    paths = spark.createDataFrame([], "job_id long, page_num int, fill boolean, line_width double")
    found = press.advisories(spaces, paths, spark.createDataFrame([], "job_id long, trapped string"), pages).where("inspection_id = 'EPM_PAGE_GEOM_REJECT'")
    assert [r.job_id for r in found.collect()] == [1]
    assert "min(w" in plan(found)


def test_jobs_of_checks_are_counted_without_sending_each(spark):
    from platewise.operators.registry import Families

    rows = [(j, c) for j in (*range(-70, 200, 3), 1 << 40, None) for c in "AAB" if j is None or c == "A" or j % 2]
    given = spark.createDataFrame(rows, "job_id long, inspection_id string").withColumn("severity", F.lit("error"))
    some = Families()
    some.register("spread", "a", "t")(lambda t: t)
    some.register("dealt", "a", "t", by_job=True)(lambda t: t.groupBy("job_id").agg(F.max("inspection_id").alias("inspection_id")).withColumn("severity", F.lit("error")))
    found = some.counts(lambda name: given)
    jobs = lambda check: {j for j, c in rows if c == check and j is not None}
    last = {j: max(c for i, c in rows if i == j) for j, _ in rows}
    want = [("dealt", c, "error", sum(x == c for x in last.values()), sum(x == c for j, x in last.items() if j is not None)) for c in "AB"]
    want += [("spread", c, "error", sum(x == c for _, x in rows), len(jobs(c))) for c in "AB"]
    assert sorted(map(tuple, found.collect())) == want
    dealt = [line for line in plan(found).splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 3 and sum("job_id" in line for line in dealt) == 1


def test_profiles_and_names_are_sent_once(spark):
    from platewise.operators import standards

    kinds = spark.createDataFrame([(1, "2.1", "P", "CMYK", True), (1, "4.3", "P", "RGB", False), (2, "2.1", "P", "RGB", True), (2, "2.4", "R", "CMYK", True), (3, None, None, None, True)], "job_id long, version string, rendering string, space string, is_intent boolean")
    found = standards.profile_conflicts(kinds)
    assert sorted((r.job_id, r.inspection_id) for r in found.collect()) == [(1, "ICC_002"), (2, "ICC_006"), (2, "ICC_008")]
    assert "Expand" not in plan(found)
    inks = spark.createDataFrame([(1, "Gold"), (1, "Gold"), (1, " gold ")], "job_id long, ink string")
    assert "canonical" not in plan(standards.name_taxonomy(inks, {"gold": "Gold"})).split("hashpartitioning")[1].splitlines()[0]


def test_font_rules_of_a_first_page_send_bits(spark):
    from platewise.operators import typography

    rows = [(1, 1, "F", "b", "Type0", True, True, False, 0), (1, 1, "F", "a", "TrueType", False, True, True, 0), (1, 2, None, "G", "Type0", True, True, False, None), (2, 1, None, "H", None, True, None, False, 2)]
    found = typography.font_rules(spark.createDataFrame(rows, "job_id long, page_num int, base_font string, name string, subtype string, embedded boolean, subset boolean, has_unicode boolean, fs_type int"))
    got = sorted((r.job_id, r.page_num, r.font, r.inspection_id, r.severity) for r in found.collect())
    assert got == [(1, 1, "F", "FONT_001", "error"), (1, 2, "G", "FONT_005", "warning"), (2, 1, "H", "FONT_005", "advisory"), (2, 1, "H", "FONT_015", "advisory")]
    assert "fs_type" not in plan(found).split("Exchange")[0]
