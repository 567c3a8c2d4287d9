"""Rule families: predicates over one table, fused into one scan that yields findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.functions import color as C
from platewise.functions import geometry as G
from platewise.functions.text import close_names, normal_name
from platewise.operators.dealing import dealt, tasks_for

POINTS_PER_MM = 72.0 / 25.4


def fused(rows: DataFrame, rules: dict[str, tuple[str, Column]], *keep: str) -> DataFrame:
    """One row per rule that holds: (*keep, inspection_id, severity), all rules in one pass.

    What follows a ``#`` in a name tells rules apart that report under one identifier. A null test does not hold. Rules are exploded
    before they are filtered: inside a higher-order function Spark compiles no expression, and tests each row's rules twice.
    """
    hits = [F.when(test, F.struct(F.lit(name.split("#")[0]).alias("inspection_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))) for name, (severity, test) in rules.items()]
    return rows.select(*keep, F.explode(F.array(*hits)).alias("hit")).where("hit IS NOT NULL").select(*keep, "hit.*")


def image_rules(low: float = 150.0, high: float = 450.0) -> dict[str, tuple[str, Column]]:
    """Resolution, shear, rotation, mirroring and scale of placed images (a, b, c, d, pixel_width, pixel_height)."""
    a, b, c, d = (F.col(k) for k in "abcd")
    dpi = G.effective_dpi(F.col("pixel_width"), F.col("pixel_height"), a, b, c, d)
    percent = [s / F.col(p) * 100 for s, p in ((G.scale_x(a, c), "pixel_width"), (G.scale_y(b, d), "pixel_height"))]
    return {
        "IMG_001": ("warning", dpi < low),
        "IMG_002": ("advisory", dpi > high),
        "IMG_006": ("warning", dpi < 72 / 1.5),
        "IMG_014": ("advisory", G.shear(a, b, c, d) > 0.01),
        "IMG_015": ("advisory", G.off_right_angle(a, b) > 0.5),
        "IMG_016": ("advisory", G.is_mirrored(a, b, c, d)),
        "IMG_017": ("advisory", (F.least(*percent) < 10) | (F.greatest(*percent) > 1000)),
    }


# Filters that do not compress (fixed values of the format).
PLAIN_FILTERS = ("ASCIIHexDecode", "ASCII85Decode")


def image_data_rules() -> dict[str, tuple[str, Column]]:
    """How images are stored (filters, inline_image, bits, opi, alternates): no compression, inline, LZW, JPEG 2000, depth, references."""
    filters = F.col("filters")
    return {
        "IMG_004": ("advisory", (F.size(filters) > 0) & F.forall(filters, lambda f: f.isin(*PLAIN_FILTERS))),
        "IMG_005": ("advisory", F.col("inline_image")),
        "IMG_007": ("warning", F.array_contains(filters, "LZWDecode")),
        "IMG_008": ("advisory", F.array_contains(filters, "JPXDecode")),
        "IMG_009": ("advisory", F.col("bits") > 8),
        "IMG_010": ("error", F.col("opi")),
        "IMG_011": ("warning", F.col("alternates")),
    }


def line_rules(thin: float = 0.5, wide: float = 1.0, points: int = 10_000) -> dict[str, tuple[str, Column]]:
    """Caps, inks, opacity and flatness of strokes and the points of paths (stroke, line_width, line_cap, c, m, y, k, stroke_alpha,
    stroke_grey, flatness, point_count). A grey stroke of full white without a stated opacity is invisible as well.
    """
    width, alpha = F.col("line_width"), F.col("stroke_alpha")
    stroke = F.col("stroke")
    unseen = F.when(alpha.isNotNull(), F.abs(alpha) < 1e-6).otherwise((width > 0) & (F.abs(F.col("stroke_grey") - 1) < 0.01))
    return {
        "STROKE_003": ("advisory", stroke & (width > 0) & (width < thin) & (F.col("line_cap") == 0)),
        "STROKE_007": ("advisory", stroke & (width >= thin) & (width <= wide) & (C.active_inks(*[F.col(x) for x in "cmyk"]) > 1)),
        "STROKE_005": ("warning", stroke & unseen),
        "STROKE_006": ("advisory", stroke & (F.col("flatness") != 0) & (F.col("flatness") != 1)),
        "PATH_001": ("warning", F.col("point_count") > points),
    }


def white_fills(paths: DataFrame) -> DataFrame:
    """(job_id, page_num, op_idx, inspection_id, severity): PATH_002, the first white fill of each page."""
    white = paths.where(F.col("fill") & (F.greatest(*[F.col(x) for x in "cmyk"]) < 0.01)).groupBy("job_id", "page_num").agg(F.min("op_idx").alias("op_idx"))
    return white.select("job_id", "page_num", "op_idx", F.lit("PATH_002").alias("inspection_id"), F.lit("advisory").alias("severity"))


def ink_rules(limit: float = 300.0, hairline: float = 0.25) -> dict[str, tuple[str, Column]]:
    """Coverage, registration colour, impure grey and black, hairlines of painted paths (c, m, y, k, line_width, fill).

    Grey is impure if three nearly equal inks make it without black, black if other inks stand below it; both on fills only.
    """
    inks = [F.col(x) for x in "cmyk"]
    c, m, y, k = inks
    fill, width = F.col("fill"), F.col("line_width")
    return {
        "COLOR_004": ("warning", C.coverage(*inks) > limit),
        "COLOR_005": ("warning", C.is_registration(*inks)),
        "COLOR_016": ("warning", fill & (F.least(c, m, y) > 0.05) & (k < 0.10) & (F.greatest(c, m, y) - F.least(c, m, y) < 0.05)),
        "COLOR_017": ("warning", fill & (k > 0.90) & (F.greatest(c, m, y) > 0.05)),
        "STROKE_001": ("warning", ~fill & (width > 0) & (width < hairline)),
        "STROKE_002": ("error", ~fill & (width == 0)),
        "STROKE_004": ("warning", ~fill & (width > 0) & (width < 0.5) & (C.active_inks(*inks) > 1)),
    }


def black_text_rules(small: float = 12.0, least: float = 0.01) -> dict[str, tuple[str, Column]]:
    """Text of positive size in several inks: an advisory at any size, a warning as well below ``small`` points."""
    several = (F.col("size_pt") > 0) & (C.active_inks(*[F.col(x) for x in "cmyk"], over=least) > 1)
    return {"COLOR_008": ("warning", several & (F.col("size_pt") < small)), "COLOR_021": ("advisory", several)}


def box_rules(pages: DataFrame, bleed: float = 8.5) -> DataFrame:
    """Missing boxes, boxes outside the next larger one, bleed below ``bleed`` on any side, empty pages, user units, rotation.

    Boxes: media m, crop c, bleed b, trim t (a missing crop box is the media box).
    """
    m, c, b, t = (G.Box.of(x) for x in "mcbt")
    crop = G.Box(*[F.coalesce(x, y) for x, y in ((c.x0, m.x0), (c.y0, m.y0), (c.x1, m.x1), (c.y1, m.y1))])
    short = F.least(t.x0 - b.x0, t.y0 - b.y0, b.x1 - t.x1, b.y1 - t.y1) < bleed
    rules = {
        "BOX_001#trim": ("warning", t.x0.isNull()),
        "BOX_001#bleed": ("warning", b.x0.isNull()),
        "BOX_002#crop": ("warning", ~m.contains(c)),
        "BOX_002#bleed": ("warning", ~crop.contains(b)),
        "BOX_002#trim": ("warning", ~b.contains(t)),
        "BOX_003": ("warning", t.x0.isNotNull() & b.x0.isNotNull() & short),
        "BOX_004": ("advisory", F.col("objects") == 0),
        "BOX_007": ("warning", F.col("user_unit") != 1),
        "BOX_008": ("advisory", ~F.col("rotate").isin(0, 90, 180, 270)),
    }
    return fused(pages, rules, "job_id", "page_num")


def content_against_boxes(content: DataFrame, pages: DataFrame, margin: float = 10.0) -> DataFrame:
    """Paths, text and detected text in the safety band of their page's trim box, or beyond its bleed box.

    Joined on (job, page); boxes as a residue. A page without a box has no findings of that box.
    """
    boxes = [f"{k}{c}" for k in "tb" for c in ("x0", "y0", "x1", "y1")]
    rows = content.select("job_id", "page_num", "op_idx", "x0", "y0", "x1", "y1").join(pages.select("job_id", "page_num", *boxes), ["job_id", "page_num"])
    own, trim, bleed = G.Box.of(""), G.Box.of("t"), G.Box.of("b")
    rules = {"BOX_005": ("advisory", trim.x0.isNotNull() & G.in_safety_band(own, trim, margin)), "BOX_006": ("warning", bleed.x0.isNotNull() & ~bleed.contains(own))}
    return fused(rows, rules, "job_id", "page_num", "op_idx")


def first_per(rows: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def separations(paths: DataFrame, high: float = 300.0) -> DataFrame:
    """Per job and ink: pages that use it, its greatest value and the number of paints."""
    long = paths.select("job_id", "page_num", F.explode(F.array(*[F.struct(F.lit(x).alias("ink"), F.col(x).alias("amount")) for x in "cmyk"])).alias("s")).select("job_id", "page_num", "s.*")
    return long.where("amount > 0").groupBy("job_id", "ink").agg(F.countDistinct("page_num").alias("pages"), F.max("amount").alias("most"), F.count("*").alias("paints"))


def worst_coverage(paths: DataFrame) -> DataFrame:
    """Per page the greatest coverage and the path that has it (the first, if several)."""
    rows = paths.withColumn("coverage", F.round(C.coverage(*[F.col(x) for x in "cmyk"]), 4))
    return rows.groupBy("job_id", "page_num").agg(F.max("coverage").alias("coverage"), F.max_by("op_idx", F.struct("coverage", -F.col("op_idx"))).alias("op_idx"))


def ink_inventory(inks: DataFrame) -> DataFrame:
    """Per job and ink name: pages, definitions, colour-space families; a conflict if there are several alternates.

    Rows are dealt by job, ink and page, where they are combined before those of an ink meet: counts of distinct values beside one
    another would shuffle each row once for each count, and sort it before that. ``inks`` is counted.
    """
    rows = inks.select("job_id", normal_name(F.col("colorant")).alias("ink"), "page_num", "alternate", "cs_type")
    sets = dealt(rows, tasks_for(inks), "job_id", "ink", "page_num").groupBy("job_id", "ink").agg(
        F.collect_set(F.col("page_num").cast("string")).alias("pages"), F.collect_set("alternate").alias("alternates"), F.collect_set("cs_type").alias("families")
    )
    counts = [F.size(c).cast("long").alias(c) for c in ("alternates", "families")]
    return sets.select("job_id", "ink", F.array_join(F.sort_array("pages"), ",").alias("pages"), *counts, (F.size("alternates") > 1).alias("conflict"))


#: Characters of a name from which letters are left out for the index; what follows is only compared.
INDEXED = 14
#: Most names of a group that are compared without an index.
PAIRED = 64


def _less_letters(word: Column, most: int, indexed: int) -> Column:
    """A word's start with at most ``most`` (1 or 2) of its letters left out."""
    start = F.substring(word, 1, indexed)
    shorter = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    once = F.array_distinct(shorter(start))
    every = F.concat(F.array(start), once)
    return F.array_distinct(F.concat(every, F.flatten(F.transform(once, shorter))) if most == 2 else every)


def _small_and_large(names: DataFrame, keys: list[str], paired: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (*keys, name) of groups of at most ``paired`` names, and those of larger groups."""
    rows = names.select(*keys, "name").where(F.col("name").isNotNull()).distinct()
    if not keys:
        return rows.limit(0), rows
    sized = rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    return (sized.where(test).drop("_n") for test in (F.col("_n") <= paired, F.col("_n") > paired))


def close_pairs(names: DataFrame, keys: list[str], most: int = 2, indexed: int = INDEXED, paired: int = PAIRED) -> DataFrame:
    """(*keys, name, other, distance), name < other: distinct names with equal keys at an edit distance of 1 to ``most`` (1 or 2).

    Groups of at most ``paired`` names are compared as they are. For larger ones there is a deletion-neighbourhood index: each name
    stands under its start with up to ``most`` letters left out; two names this close share such an entry, and only those that do
    are compared. Entries of a name are bounded by ``indexed``, so the index grows with the number of names.
    """
    few, many = _small_and_large(names, keys, paired)
    near = (F.col("name") < F.col("other")) & (F.abs(F.length("name") - F.length("other")) <= most)
    rows = many.withColumn("entry", F.explode(_less_letters(F.col("name"), most, indexed)))
    pairs = rows.join(rows.withColumnRenamed("name", "other"), [*keys, "entry"]).where(near).select(*keys, "name", "other").distinct()
    if keys:
        pairs = pairs.unionByName(few.join(few.withColumnRenamed("name", "other"), keys).where(near))
    return pairs.withColumn("distance", close_names(F.col("name"), F.col("other"), most)).where("distance > 0")


def name_typos(inks: DataFrame, least: int = 4) -> DataFrame:
    """Pairs of ink names of a job that differ by an edit distance of one or two."""
    names = inks.select("job_id", normal_name(F.col("colorant")).alias("name")).where(F.length("name") >= least)
    return close_pairs(names, ["job_id"])


def corpus_typos(inks: DataFrame, excluded: Column, least: int = 4) -> DataFrame:
    """(name, other, distance, jobs, other_jobs): close names over all jobs, with how many jobs have each; ``excluded`` names take no part."""
    rows = inks.where(~excluded).select("job_id", normal_name(F.col("colorant")).alias("name")).where(F.length("name") >= least)
    per = rows.groupBy("name").agg(F.count_distinct("job_id").alias("jobs"))
    pairs = close_pairs(per, [])
    return pairs.join(per, "name").join(per.withColumnsRenamed({"name": "other", "jobs": "other_jobs"}), "other").select("name", "other", "distance", "jobs", "other_jobs")


def token_typos(inks: DataFrame, least: int = 4, paired: int = PAIRED) -> DataFrame:
    """(job_id, name, other, token, other_token): ink names of a job that hold words one or two letters apart, the first such words in order.

    Names of a job with at most ``paired`` of them are compared word by word; of a larger job words are indexed, so that names are
    joined only through close words.
    """
    split = lambda whole: F.filter(F.array_distinct(F.split(whole, " ")), lambda w: F.length(w) >= least)
    few, many = _small_and_large(inks.select("job_id", normal_name(F.col("colorant")).alias("name")), ["job_id"], paired)
    few = few.withColumn("words", split("name"))
    apart = lambda t, u: (F.abs(F.length(t) - F.length(u)) <= 2) & (t != u) & (F.levenshtein(t, u, 2) > 0)
    # words are sorted, so the first pair found is the first in order
    some = few.where(F.size("words") > 0).withColumn("words", F.array_sort("words"))
    held = some.select("job_id", F.col("name").alias("other"), F.col("words").alias("other_words"))
    near = F.flatten(F.transform("words", lambda t: F.transform(F.slice(F.filter("other_words", lambda u: apart(t, u)), 1, 1), lambda u: F.struct(t.alias("token"), u.alias("other_token")))))
    small = some.join(held, "job_id").where("name < other").withColumn("w", F.try_element_at(near, F.lit(1))).where("w IS NOT NULL").select("job_id", "name", "other", "w.*")
    words = many.withColumnRenamed("name", "whole").withColumn("name", F.explode(split("whole")))
    close = close_pairs(words, ["job_id"])
    has = lambda word, whole: words.select("job_id", F.col("name").alias(word), F.col("whole").alias(whole))
    pairs = close.select("job_id", F.col("name").alias("t"), F.col("other").alias("u")).join(has("t", "a"), ["job_id", "t"]).join(has("u", "b"), ["job_id", "u"]).where("a <> b")
    swap = F.col("a") > F.col("b")
    ordered = pairs.select("job_id", F.least("a", "b").alias("name"), F.greatest("a", "b").alias("other"), F.when(swap, F.col("u")).otherwise(F.col("t")).alias("token"), F.when(swap, F.col("t")).otherwise(F.col("u")).alias("other_token"))
    return small.unionByName(ordered.groupBy("job_id", "name", "other").agg(F.min(F.struct("token", "other_token")).alias("w")).select("job_id", "name", "other", "w.*"))


def overprint_rules(state: DataFrame, order: tuple[str, ...] = ("op_idx",)) -> DataFrame:
    """Overprint, its mode and the colour are carried forward in drawing order within a job; then rules at each event.

    ``order`` is drawing order; kinds of events: overprint, opacity, colour, path and text. Transparency, once used, counts for all that follows.
    """
    frame = W.partitionBy("job_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = state.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in ("overprint", "opm")})
    rows = rows.withColumn("clear", F.max(F.coalesce(F.col("alpha") < 1.0, F.lit(False))).over(frame))
    kind, space, inks = F.col("kind"), F.col("color_space"), [F.col(x) for x in "cmyk"]
    on, cmyk = F.coalesce("overprint", F.lit(False)), space == "DeviceCMYK"
    c, m, y, k = inks
    rules = {
        "OVER_001": ("warning", on & (kind == "path") & ~space.isin("DeviceCMYK", "DeviceGray")),
        "OVER_002": ("warning", on & (kind == "overprint") & (F.col("opm") == 0) & cmyk),
        "OVER_003": ("warning", on & (kind == "overprint") & F.col("clear")),
        "OVER_004": ("warning", on & (kind == "colour") & cmyk & (F.greatest(*inks) == 0)),
        "OVER_006": ("error", on & (kind == "colour") & (space == "DeviceRGB")),
        "OVER_007": ("warning", ~on & (kind == "text") & cmyk & (F.greatest(c, m, y) == 0) & (k > 0)),
        "OVER_008": ("error", on & (kind == "colour") & cmyk & C.is_registration(*inks)),
    }
    return fused(rows, rules, "job_id", *order)


# Phrases that are left in artwork by mistake, and forms that are right (fixed values).
PLACEHOLDERS = (
    (r"(?i)\bLOT\s+NUMBER\b", "LOT NUMBER"),
    (r"(?i)\bDATE\s+CODE\b", "DATE CODE"),
    (r"(?i)\bEXP(?:IRY)?\s+DATE\b", "EXPIRY DATE"),
    (r"(?i)\bMANUFACTURED\s+ON\b", "MANUFACTURED ON"),
    (r"(?i)\bUSE\s+BY\b", "USE BY"),
    (r"(?i)\bBEST\s+BEFORE\b", "BEST BEFORE"),
    (r"(?i)\bFRONT\s+PANEL\b", "FRONT PANEL"),
    (r"(?i)\bBACK\s+PANEL\b", "BACK PANEL"),
    (r"(?i)\bTOP\s+PANEL\b", "TOP PANEL"),
    (r"(?i)\bBOTTOM\s+PANEL\b", "BOTTOM PANEL"),
    (r"(?i)\bSIDE\s+PANEL\b", "SIDE PANEL"),
    (r"(?i)\bOVERLAP\s+IN\s+SEAL\b", "OVERLAP IN SEAL"),
    (r"(?i)\bOVERLAP\s+FIN\s+SEAL\b", "OVERLAP FIN SEAL"),
    (r"(?i)\bEND\s+SEAL\b", "END SEAL"),
    (r"(?i)\bSEAL\s+AREA\b", "SEAL AREA"),
    (r"(?i)\bDIE\s+CUT\s+AREA\b", "DIE CUT AREA"),
    (r"(?i)\bTemplate\s*#\s*\d+\b", "Template #..."),
    (r"(?i)\bINSERT\s+IN\s+(?:END\s+SEAL|HERE)\b", "INSERT IN ..."),
    (r"(?i)\bTEAR\s+(?:ACROSS|HERE|OPEN)\b", "TEAR HERE"),
    (r"(?i)\bD[ÉE]CHIRER\s+ICI\b", "DÉCHIRER ICI"),
    (r"(?i)\bUNDER\s+PANEL\b", "UNDER PANEL"),
    (r"(?i)\bGUSSET\s+PANEL\b", "GUSSET PANEL"),
    (r"(?i)\bCOPY\s+NOT\s+RECOMMENDED\b", "COPY NOT RECOMMENDED"),
    (r"(?i)\bCOLOR\s+AND\s+IMAGES?\s+OK\b", "COLOR AND IMAGES OK"),
    (r"(?i)\bATTACH\s+(?:BACK|FRONT)\s+PANEL\b", "ATTACH PANEL"),
    (r"(?i)\bFOR\s+POSITION\s+ONLY\b", "FOR POSITION ONLY"),
    (r"\bFPO\b", "FPO"),
    (r"(?i)\bPRINT\s+AREA\b", "PRINT AREA"),
    (r"(?i)\bFOLD\s+(?:LINE|HERE|AREA)\b", "FOLD LINE"),
    (r"(?i)\bCUT\s+(?:LINE|HERE|AREA)\b", "CUT LINE"),
    (r"(?i)\bPERF(?:ORATION)?\s+(?:LINE|HERE)\b", "PERF LINE"),
    (r"(?i)\bSCORE\s+(?:LINE|HERE)\b", "SCORE LINE"),
    (r"(?i)\bENHANCED\s+TO\s+SHOW\s+DETAIL\b", "ENHANCED TO SHOW DETAIL"),
    (r"(?i)\bACTUAL\s+SIZE\s+MAY\s+VARY\b", "ACTUAL SIZE MAY VARY"),
    (r"\[[A-Z][A-Z\s_\-/]{2,30}\]", "[BRACKETED PLACEHOLDER]"),
)
LEGITIMATE = r"(?i)\bBest\s+Before\s*:\s*\d|\bUse\s+by\s*:\s*\d|\bLot\s+#\s*[A-Z0-9]"


def placeholder_text(text: DataFrame, phrases: tuple[tuple[str, str], ...] = PLACEHOLDERS, around: int = 30) -> DataFrame:
    """(job_id, page_num, phrase) once per page for each phrase whose first occurrence has no legitimate form around it."""

    def hit(pattern: str, label: str) -> Column:
        at = F.regexp_instr("text", F.lit(pattern))
        start = F.greatest(at - around, F.lit(1))
        window = F.substring(F.col("text"), start, at + F.length(F.regexp_extract("text", pattern, 0)) + around - start)
        return F.when((at > 0) & ~window.rlike(LEGITIMATE), F.lit(label))

    hits = F.array(*[hit(p, label) for p, label in phrases])
    return text.select("job_id", "page_num", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("phrase")).distinct()
