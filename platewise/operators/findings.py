"""Rule evaluation and summaries over findings (job_id, ord, inspection_id, severity, page_num, source)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.text import glob, severity_of, severity_rank


def is_enabled(check: Column, source: Column, enabled: Iterable[str], disabled: Iterable[str], overrides: dict[str, str] | None = None) -> Column:
    """A disabled pattern or an ``ignore`` override wins; else an enabled pattern must match, but not for source ``ai``."""
    keep = source == "ai"
    for p in enabled:
        keep = keep | glob(check, p)
    for p in disabled:
        keep = keep & ~glob(check, p)
    for name, severity in (overrides or {}).items():
        if severity == "ignore":
            keep = keep & (check != name)
    return keep


def matches(when: dict, columns: dict[str, Column], pages: Column) -> Column:
    """All keys of a ``when`` clause hold; a missing value never matches; negative page numbers count from the end."""

    def page(v):
        return pages + F.lit(v) + 1 if isinstance(v, int) and not isinstance(v, bool) and v < 0 else F.lit(v)

    def one_of(col, values):
        found = F.lit(False)
        for v in values:
            found = found | (col == page(v))
        return found

    tests = {
        "eq": lambda c, v: c == F.lit(v),
        "ne": lambda c, v: c != F.lit(v),
        "in": one_of,
        "not_in": lambda c, v: ~one_of(c, v),
        "gt": lambda c, v: c > page(v),
        "lt": lambda c, v: c < page(v),
        "gte": lambda c, v: c >= page(v),
        "lte": lambda c, v: c <= page(v),
        "contains": lambda c, v: c.contains(v),
        "regex": lambda c, v: c.rlike(v),
    }
    found = F.lit(True)
    for key, condition in when.items():
        col = columns[key]
        for op, value in (condition if isinstance(condition, dict) else {"eq": condition}).items():
            found = found & F.coalesce(tests[op](col, value), F.lit(False))
    return found


def evaluate(findings: DataFrame, rules: dict[str, list[dict]], overrides: dict[str, str] | None = None, cap: str | None = None) -> DataFrame:
    """Conditions (first that matches wins; may drop or set the severity), then overrides, then the cap; per check id.

    ``rules``: check id to a list of {"when": …, "severity": …, "include": …}. ``findings`` has a column ``pages``.
    """
    columns = {"page": F.col("page_num"), "total_pages": F.col("pages"), "source": F.col("source"), "severity": F.col("severity")}
    keep, severity = F.lit(True), F.col("severity")
    for check, conditions in rules.items():
        include, level = F.lit(True), F.col("severity")
        for c in reversed(conditions):
            hit = matches(c.get("when", {}), columns, F.col("pages"))
            include = F.when(hit, F.lit(c.get("include", True))).otherwise(include)
            level = F.when(hit, F.lit(c["severity"]) if c.get("severity") else F.col("severity")).otherwise(level)
        mine = F.col("inspection_id") == check
        keep, severity = F.when(mine, include).otherwise(keep), F.when(mine, level).otherwise(severity)
    for check, level in (overrides or {}).items():
        if level != "ignore":
            severity = F.when(F.col("inspection_id") == check, F.lit(level)).otherwise(severity)
    if cap:
        severity = severity_of(F.least(severity_rank(severity), severity_rank(F.lit(cap))))
    return findings.where(keep).withColumn("severity", severity)


def counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Totals by severity; passed if there is no error."""
    by = {f"{s}_count": F.count_if(F.col("severity") == s) for s in ("error", "warning", "advisory")}
    return findings.groupBy(*keys).agg(F.count("*").alias("total"), *[v.alias(k) for k, v in by.items()], (F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def merge_repeats(findings: DataFrame) -> DataFrame:
    """One row per (job, check, page): the first finding's severity (the least word, if two are first) and how many there are."""
    return findings.groupBy("job_id", "inspection_id", "page_num").agg(F.min("ord").alias("ord"), F.min_by("severity", F.struct("ord", "severity")).alias("severity"), F.count("*").alias("repeats"))


def health_score(summary: DataFrame) -> DataFrame:
    """100 - 10 errors - 3 warnings - half an advisory, rounded half to even, 0 to 100, with a letter."""
    raw = 100 - F.col("error_count") * 10 - F.col("warning_count") * 3 - F.col("advisory_count") * 0.5
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0).cast("int")))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return summary.select("job_id", score.alias("score"), grade.alias("grade"))


# Fixed values of the colour score: caps of critical errors, then deductions by weight class.
FLOORS = {"COLOR_013": 20.0, "COLOR_006": 25.0, "ICC_003": 30.0, "ICC_001": 30.0}
MAJOR = {"COLOR_004": 10.0, "GAMUT_001": 8.0, "SPOT_001": 7.0, "SPOT_003": 5.0, "SPOT_002": 5.0, "SPOT_004": 10.0, "ICC_003": 8.0, "ICC_009": 5.0}
MODERATE = {
    "OVER_001": 3.0, "OVER_002": 3.0, "OVER_003": 2.0, "OVER_004": 5.0, "OVER_006": 5.0, "OVER_008": 5.0, "ADV_005": 3.0, "COLOR_008": 3.0,
    "ADV_001": 2.0, "COLOR_015": 2.0, "COLOR_002": 3.0, "ICC_007": 3.0, "ADV_006": 3.0,
}
MINOR = {"INK_001": 1.0, "SPOT_006": 0.5, "ADV_003": 1.5, "INK_003": 0.5, "COLOR_014": 0.0, "ICC_008": 1.5}
CATEGORIES = {
    "COLOR_": "color_spaces", "ICC_": "profiles", "SPOT_": "spot_colors", "OVER_": "overprint", "INK_": "ink_coverage", "ADV_": "ink_coverage",
    "GAMUT_": "profiles", "STD_": "color_spaces", "ECG_": "color_spaces", "EPM_": "ink_coverage",
}
WEIGHTS = {"color_spaces": 25.0, "ink_coverage": 25.0, "profiles": 20.0, "spot_colors": 15.0, "overprint": 15.0}
GRADES = ((90, "Excellent"), (75, "Good"), (50, "Fair"), (25, "Poor"))


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("inspection_id")]


def category_of(check: Column) -> Column:
    found = F.lit(None).cast("string")
    for prefix, name in CATEGORIES.items():
        found = F.when(check.startswith(prefix), name).otherwise(found)
    return found


def color_score(findings: DataFrame) -> DataFrame:
    """Colour quality per job: each check deducts once, at its first finding's severity; a job without colour findings has 100.

    A category's deductions stop at its weight; the worst critical error caps the score. What is left of each category is
    returned as well. A job without any finding is in the result if it has a row whose inspection_id is null.
    """
    rows = findings.withColumn("category", category_of(F.col("inspection_id")))
    rows = rows.withColumn("inspection_id", F.when(F.col("category").isNotNull(), F.col("inspection_id")))
    first = rows.groupBy("job_id", "inspection_id", "category").agg(F.min_by("severity", F.struct("ord", "severity")).alias("severity"), F.count_if(F.col("severity") == "error").alias("errors"))
    serious = F.col("severity").isin("error", "warning")
    deduction = F.when(F.col("category").isNull(), 0.0).otherwise(F.coalesce(F.when(serious, _lookup(MAJOR)), F.when(serious, _lookup(MODERATE)), _lookup(MINOR), F.lit(0.0)))
    first = first.withColumn("deduction", deduction).withColumn("floor", F.when((F.col("errors") > 0) & F.col("category").isNotNull(), _lookup(FLOORS)))
    lost = [F.least(F.sum(F.when(F.col("category") == c, F.col("deduction")).otherwise(0.0)), F.lit(w)).alias(c) for c, w in WEIGHTS.items()]
    per = first.groupBy("job_id").agg(*lost, F.min("floor").alias("floor"))
    score = F.least(F.lit(sum(WEIGHTS.values())) - sum((F.col(c) for c in WEIGHTS), F.lit(0.0)), F.coalesce("floor", F.lit(100.0)))
    grade = F.lit("Critical")
    for least, name in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return per.withColumn("score", F.round(score, 1)).select("job_id", "score", grade.alias("grade"), "floor", *[F.round(F.lit(w) - F.col(c), 1).alias(c) for c, w in WEIGHTS.items()])


# Fixed tiers of the press-candidate codes.
TIERS = {
    "A": ("EPM_GAMUT_OUT_REJECT", "EPM_K_COVERAGE_REJECT", "EPM_RICH_BLACK_REJECT", "EPM_SUBSTRATE_REJECT", "EPM_TEXT_SIZE_REJECT", "EPM_001", "EPM_002", "EPM_006", "EPM_007"),
    "B": ("EPM_PROCESS_COUNT_REJECT", "EPM_BLEED_REJECT", "EPM_PAGE_COUNT_REJECT", "EPM_IMAGE_RES_REJECT", "EPM_TRIM_REJECT", "EPM_003", "EPM_004", "EPM_005", "EPM_008", "EPM_009", "EPM_018"),
    "C": ("EPM_SPOT_COUNT_REJECT", "EPM_FEATURE_SIZE_REJECT", "EPM_MIXED_SPACES_REJECT", "EPM_TRAPPING_REJECT", "EPM_TRIM_BLEED_REJECT", "EPM_PAGE_GEOM_REJECT", "EPM_010", "EPM_011", "EPM_012", "EPM_013", "EPM_014", "EPM_015", "EPM_016", "EPM_017"),
}
UPSELL = ("EPM_GAMUT_OUT_REJECT", "EPM_SPOT_COUNT_REJECT", "EPM_005", "EPM_011")


def press_verdict(findings: DataFrame) -> DataFrame:
    """Per job: reject (any A, or two B), marginal (one B), advisory (only C), pass (no press code); drivers in first-seen order.

    The upsell is offered if a driver of the verdict is one that more inks would cure.
    """
    tier = F.lit(None).cast("string")
    for name, codes in TIERS.items():
        tier = F.when(F.col("inspection_id").isin(*codes), name).otherwise(tier)
    codes = findings.withColumn("tier", tier).groupBy("job_id", "tier", F.when(F.col("tier").isNotNull(), F.col("inspection_id")).alias("inspection_id")).agg(F.min("ord").alias("ord"))
    n = {t: F.count_if(F.col("tier") == t) for t in TIERS}

    def listed(t: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("ord", "inspection_id")))), lambda s: s["inspection_id"])

    verdict = F.when((n["A"] > 0) | (n["B"] >= 2), "reject").when(n["B"] == 1, "marginal").when(n["C"] > 0, "pass_with_advisory").otherwise("pass")
    per = codes.groupBy("job_id").agg(verdict.alias("verdict"), F.array_join(F.concat(listed("A"), listed("B")), ",").alias("drivers"), F.array_join(listed("C"), ",").alias("advisories"))
    upsell = F.lit(False)
    for code in UPSELL:
        upsell = upsell | F.array_contains(F.split("drivers", ","), code)
    return per.withColumn("upsell", upsell)


def catalogue_name(check: Column, names: dict[str, str]) -> Column:
    """Name of a check, else one derived from its id."""
    derived = F.initcap(F.translate(check, "_-", "  "))
    return F.coalesce(F.create_map(*[F.lit(x) for item in names.items() for x in item])[check], derived) if names else derived


def identity_diff(expected: DataFrame, actual: DataFrame, *run: str) -> DataFrame:
    """Missing and new (check, severity, page) identities per run; a run passes if there is neither."""
    keys = [*run, "inspection_id", "severity", "page_num"]
    both = expected.select(*keys).distinct().withColumn("side", F.lit(1)).unionByName(actual.select(*keys).distinct().withColumn("side", F.lit(2)))
    per = both.groupBy(*keys).agg(F.sum("side").alias("side"))
    return per.groupBy(*run).agg(F.count_if(F.expr("side = 1")).alias("missing"), F.count_if(F.expr("side = 2")).alias("new"), F.count_if(F.expr("side = 3")).alias("same"), (F.count_if(F.expr("side < 3")) == 0).alias("passed"))


def regression_run(expected: DataFrame, actual: DataFrame, assays: DataFrame, run: str = "job_id") -> DataFrame:
    """(run, missing, new, same, bootstrapped, passed) of every assay of a run against its baseline.

    An assay without a baseline passes: what was found becomes one, see ``adopted``. Its findings count as the same.
    """
    known = expected.select(run).distinct().withColumn("has_baseline", F.lit(True))
    diff = identity_diff(expected, actual, run).drop("passed")
    rows = assays.select(run).distinct().join(known, run, "left").join(diff, run, "left").fillna(0, ["missing", "new", "same"])
    fresh = F.col("has_baseline").isNull()
    counted = rows.select(run, F.when(fresh, 0).otherwise(F.col("missing")).cast("long").alias("missing"), F.when(fresh, 0).otherwise(F.col("new")).cast("long").alias("new"), F.when(fresh, F.col("new")).otherwise(F.col("same")).cast("long").alias("same"), fresh.alias("bootstrapped"))
    return counted.withColumn("passed", (F.col("missing") == 0) & (F.col("new") == 0))


def adopted(expected: DataFrame, actual: DataFrame, run: str = "job_id") -> DataFrame:
    """The baseline after a run: that of before, and what was found for assays that had none."""
    keys = [run, "inspection_id", "severity", "page_num"]
    fresh = actual.join(expected.select(run).distinct(), run, "left_anti")
    return expected.select(*keys).unionByName(fresh.select(*keys)).distinct()


def fingerprint(hashes: DataFrame, *keys: str, prefix: int = 4) -> DataFrame:
    """Digest of a corpus in two levels: SHA-256 of the sorted, comma-joined hashes of each prefix, then of these in order.

    A prefix of four hexadecimal digits gives at most 65536 groups a corpus, each of which is sorted by itself.
    """
    per = hashes.groupBy(*keys, F.substring("hash", 1, prefix).alias("_prefix")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), ","), 256).alias("_digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_prefix", "_digest"))), lambda s: s["_digest"])
    return per.groupBy(*keys).agg(F.sha2(F.array_join(ordered, ","), 256).alias("fingerprint"))


def fill_boxes(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Give findings the box of their object: by (page, object id), else by the id's part after the last point, else by font.

    The last event of a key wins. Findings: job_id, page_num, object_id, font_name; events: job_id, page_num, name, ord, bbox.
    """
    last = events.groupBy("job_id", "page_num", "name").agg(F.max_by("bbox", "ord").alias("bbox"))
    keys = {"one": F.col("object_id"), "two": F.substring_index("object_id", ".", -1), "three": F.col("font_name")}
    found = findings
    for name, key in keys.items():
        own = last.select(F.col("job_id").alias("_job"), F.col("page_num").alias("_page"), F.col("name").alias("_name"), F.col("bbox").alias(name))
        found = found.join(own, (F.col("job_id") == F.col("_job")) & (F.col("page_num") == F.col("_page")) & (key == F.col("_name")), "left").drop("_job", "_page", "_name")
    return found.withColumn("bbox", F.coalesce(*keys)).drop(*keys)
