"""How findings agree with expectations and with earlier runs, and how inks agree across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.families import first_per


def expected_ids(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per file the numbers of expected, found and common check identifiers, with precision and recall.

    Both tables have (file, inspection_id); repeats count once; a side without identifiers gives a null ratio.
    """
    e = expected.select("file", "inspection_id", F.lit(1).alias("e")).distinct()
    f = found.select("file", "inspection_id", F.lit(1).alias("f")).distinct()
    per = e.join(f, ["file", "inspection_id"], "full").groupBy("file").agg(
        F.count("e").alias("expected"), F.count("f").alias("found"), F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("common")
    )
    ratio = {"precision": F.col("common") / F.nullif(F.col("found"), F.lit(0)), "recall": F.col("common") / F.nullif(F.col("expected"), F.lit(0))}
    return per.withColumns({k: F.round(v, 6) for k, v in ratio.items()})


def overlap(one: str, two: str) -> Column:
    """Intersection over union of two boxes, columns prefixed x0, y0, x1, y1; 0 if either is empty."""
    a, b = ([F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")] for p in (one, two))
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    return F.when((area[0] > 0) & (area[1] > 0), width * height / (area[0] + area[1] - width * height)).otherwise(0.0)


BOXES = ["x0", "y0", "x1", "y1"]


def _iou(one: Column, two: Column) -> Column:
    """Overlap of the boxes of two findings; a box that is not whole overlaps anything."""
    boxless = F.lit(False)
    for side in (one, two):
        for c in BOXES:
            boxless |= side[c].isNull() | F.isnan(side[c])
    width = F.greatest(F.lit(0.0), F.least(one["x1"], two["x1"]) - F.greatest(one["x0"], two["x0"]))
    height = F.greatest(F.lit(0.0), F.least(one["y1"], two["y1"]) - F.greatest(one["y0"], two["y0"]))
    area = lambda s: (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
    whole = area(one) + area(two) - width * height
    return F.when(boxless, 1.0).when(whole > 0, width * height / whole).otherwise(0.0)


def replay_matches(old: DataFrame, new: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(rule, old_id, new_id, verdict): greedy one-to-one matches of new findings with old ones of the same key.

    New findings, in order of id, each take the free old one that they overlap most, of equal ones that with the least id; a side
    may stay alone. Both tables have rule, id and a box, which may be null and then overlaps anything of its key whole; ``old`` has
    a verdict. The keys (file, rule, page) keep a group to the findings of one rule on one page; groups are spread by key, and a
    group is an array of either side, so that many small groups cost no call each.
    """
    listed = lambda rows, side, *more: rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *BOXES, *more))).alias(side))
    box = "x0 double, y0 double, x1 double, y1 double"
    typed = lambda rows: rows.withColumns({"id": F.col("id").cast("long"), **{c: F.col(c).cast("double") for c in BOXES}})
    a, b = listed(typed(old), "_old", F.col("verdict").cast("string").alias("verdict")), listed(typed(new), "_new")
    both = a.join(b, keys, "full").withColumns({"_old": F.coalesce("_old", F.array().cast(f"array<struct<id long, {box}, verdict string>>")), "_new": F.coalesce("_new", F.array().cast(f"array<struct<id long, {box}>>"))})
    none = F.lit(None)
    pair = lambda one, two, verdict: F.struct(one.cast("long").alias("old_id"), two.cast("long").alias("new_id"), verdict.cast("string").alias("verdict"))
    start = F.struct(F.col("_old").alias("free"), F.array().cast("array<struct<old_id long, new_id long, verdict string>>").alias("out"))

    def take(state: Column, item: Column) -> Column:
        # the places of the free ones by overlap; the first of the greatest is taken
        told = F.transform(state["free"], lambda o: _iou(item, o))
        best = F.array_max(told)
        place = F.array_position(told, best).cast("int")
        taken = F.get(state["free"], place - 1)
        left = F.concat(F.slice(state["free"], F.lit(1), place - 1), F.slice(state["free"], place + 1, F.size(state["free"])))
        match = F.struct(left.alias("free"), F.concat(state["out"], F.array(pair(taken["id"], item["id"], taken["verdict"]))).alias("out"))
        alone = F.struct(state["free"].alias("free"), F.concat(state["out"], F.array(pair(none, item["id"], none))).alias("out"))
        return F.when((best > 0) & (best >= least), match).otherwise(alone)

    lone = F.transform("_new", lambda n: pair(none, n["id"], none))
    rest = lambda free: F.transform(free, lambda o: pair(o["id"], none, o["verdict"]))
    matched = F.aggregate("_new", start, take, lambda state: F.concat(state["out"], rest(state["free"])))
    found = F.when(F.size("_old") == 0, lone).when(F.size("_new") == 0, rest(F.col("_old"))).otherwise(matched)
    return both.select("rule", F.explode(found).alias("m")).select("rule", "m.*")


def replay_score(matches: DataFrame) -> DataFrame:
    """Per rule and in total (rule null): findings, disputed ones kept and removed, confirmed ones lost, regressions.

    A new finding without a counterpart is a regression if its rule has a disputed one among the old.
    """
    disputed, confirmed = F.col("verdict") == "disputed", F.col("verdict") == "confirmed"
    old, new = F.col("old_id").isNotNull(), F.col("new_id").isNotNull()
    per = matches.groupBy("rule").agg(
        F.count_if(old).alias("baseline"), F.count_if(new).alias("fresh"), F.count_if(old & disputed).alias("baseline_disputed"), F.count_if(old & new & disputed).alias("fresh_disputed"),
        F.count_if(old & ~new & disputed).alias("removed_disputed"), F.count_if(old & ~new & confirmed).alias("removed_confirmed"), F.count_if(new & ~old).alias("unmatched"),
    )
    per = per.withColumn("regressions", F.when(F.col("baseline_disputed") > 0, F.col("unmatched")).otherwise(0)).drop("unmatched")
    return per.unionByName(per.agg(*[F.sum(c).alias(c) for c in per.columns[1:]]).withColumn("rule", F.lit(None).cast("string")))


def ink_spread(inks: DataFrame, least: int = 2) -> DataFrame:
    """Inks that several documents define: number of documents and the greatest distance of a definition to their mean.

    ``inks`` has (job_id, ink, l, a, b); means are taken over definitions. Two aggregates and a join on the ink.
    """
    mean = inks.groupBy("ink").agg(F.count_distinct("job_id").alias("jobs"), *[F.avg(c).alias(f"m{c}") for c in "lab"])
    off = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "lab"), F.lit(0.0)))
    return inks.join(mean.where(F.col("jobs") >= least), "ink").groupBy("ink").agg(F.first("jobs").alias("jobs"), F.round(F.max(off), 4).alias("spread"))


def evidence_digest(fonts: DataFrame, images: DataFrame) -> DataFrame:
    """Per job the distinct fonts and colour spaces, sorted and joined by commas, and how many fonts are embedded."""
    f = fonts.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("base_font")), ",").alias("fonts"), F.count_distinct(F.when(F.col("embedded"), F.col("base_font"))).alias("embedded"))
    s = images.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("color_space")), ",").alias("spaces"))
    return f.join(s, "job_id", "full")


def verifiability(check: Column, reason: Column) -> Column:
    """Whether a finding can be verified on the page, only in the file's structure, or speaks of the run itself."""
    structural = check.rlike("^(META|STRUCT|DOC|ICC)_")
    return F.when(reason.isin("timeout", "skipped", "unavailable"), "operational").when(structural, "structural").otherwise("verifiable")


def label_requirements(text: DataFrame, triggers: dict[str, str], elements: dict[str, dict[str, str]]) -> DataFrame:
    """Required elements that a text with a category's trigger phrase lacks: (job_id, page_num, category, element).

    Patterns are case-insensitive regular expressions; all categories are tested in one pass over the text.
    """

    def missing(category: str, name: str, pattern: str) -> Column:
        lacks = F.col("text").rlike(f"(?i){triggers[category]}") & ~F.col("text").rlike(f"(?i){pattern}")
        return F.when(lacks, F.struct(F.lit(category).alias("category"), F.lit(name).alias("element")))

    tests = [missing(c, n, p) for c, found in elements.items() for n, p in found.items()]
    return text.select("job_id", "page_num", F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("t")).select("job_id", "page_num", "t.*")
