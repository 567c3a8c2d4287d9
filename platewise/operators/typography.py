"""Rules on fonts and text runs: embedding, licence bits, sizes, directions, legibility and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.functions import color as C
from platewise.operators.families import first_per, fused

# Licence bits of a font's embedding flags (fixed values of the OpenType format).
RESTRICTED, NO_SUBSETTING, BITMAP_ONLY = 0x0002, 0x0100, 0x0200


def font_rules(fonts: DataFrame) -> DataFrame:
    """Embedding and encoding rules, once per job and base font, at the first page that uses it.

    Columns: job_id, page_num, base_font, name, subtype, embedded, subset, has_unicode, fs_type. A font without a base font
    goes by its name. Null flags never match.
    """
    cid = F.col("subtype") == "Type0"

    def bit(flag):
        return F.col("embedded") & (F.col("fs_type").bitwiseAND(flag) != 0)

    rules = {
        "FONT_001": ("error", ~F.col("embedded") & (F.col("subtype") != "Type3")),
        "FONT_002": ("advisory", F.col("embedded") & ~F.col("subset")),
        "FONT_004": ("warning", F.col("subtype") == "Type3"),
        "FONT_005#cid": ("warning", cid & ~F.col("has_unicode")),
        "FONT_005": ("advisory", ~F.coalesce(cid, F.lit(False)) & ~F.col("has_unicode")),
        "FONT_015": ("advisory", bit(RESTRICTED)),
        "FONT_016": ("warning", bit(NO_SUBSETTING) & F.col("subset")),
        "FONT_017": ("warning", bit(BITMAP_ONLY)),
    }
    return _once_a_font(fonts, rules)


def _once_a_font(fonts: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(job_id, page_num, font, inspection_id, severity): the rules that hold of a job's fonts, at the first page that uses each, by its first name there."""
    # which rules hold is told before fonts meet, a bit for each; a name is sent only beside a base font, else it is the font
    alone, bits = F.col("base_font").isNull(), F.lit(0)
    for i, test in enumerate([alone, *[test for _, test in rules.values()]]):
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << i)).otherwise(F.lit(0)))
    sent = fonts.select("job_id", "page_num", F.coalesce("base_font", "name").alias("font"), F.when(~alone, F.col("name")).alias("other"), bits.alias("bits"))
    holds = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    rank = F.row_number().over(W.partitionBy("job_id", "font").orderBy("page_num", F.when(holds(0), F.col("font")).otherwise(F.col("other"))))
    rows = sent.withColumn("_rank", rank).where(F.col("_rank") <= 1)
    return fused(rows, {name: (severity, holds(i)) for i, (name, (severity, _)) in enumerate(rules.items(), 1)}, "job_id", "page_num", "font")


def font_program_rules(fonts: DataFrame) -> DataFrame:
    """Rules on a font's program and descriptor, once per job and base font, at the first page that uses it.

    Columns: job_id, page_num, base_font, name, subtype, embedded, standard_14, encoding, cid_info, descriptor, files (the font
    files of the descriptor), weight, stem_v, italic_angle.
    """
    kind, low, files = F.col("subtype"), F.lower(F.coalesce("base_font", F.lit(""))), F.coalesce("files", F.array().cast("array<string>"))
    heavy = F.coalesce(F.col("weight") >= 700, F.lit(False)) | F.coalesce(F.col("stem_v") > 165, F.lit(False))
    wrong = ((kind == "Type1") & ~F.array_contains(files, "FontFile")) | ((kind == "TrueType") & ~F.array_contains(files, "FontFile2"))
    rules = {
        "FONT_003": ("advisory", F.col("standard_14")),
        "FONT_006": ("warning", (kind == "Type0") & F.col("cid_info").isNull()),
        "FONT_007": ("advisory", F.col("encoding").isNull() & ~kind.isin("Type3", "Type0")),
        "FONT_008": ("error", (kind == "TrueType") & ~F.col("embedded")),
        "FONT_009": ("error", (kind == "Type0") & ~F.col("embedded")),
        "FONT_010": ("warning", F.col("descriptor") & (F.size(files) == 0)),
        "FONT_011": ("warning", (kind == "MMType1") | F.coalesce(F.col("base_font").endswith("MM"), F.lit(False))),
        "FONT_012": ("advisory", F.col("descriptor") & heavy & ~low.contains("bold")),
        "FONT_013": ("advisory", F.col("descriptor") & (F.col("italic_angle") != 0) & ~low.contains("italic") & ~low.contains("oblique")),
        "FONT_014": ("warning", (F.size(files) > 0) & wrong),
    }
    return _once_a_font(fonts, rules)


def pages_without_fonts(pages: DataFrame, fonts: DataFrame, paths: DataFrame) -> DataFrame:
    """(job_id, page_num) of pages that paint paths but declare no font."""
    page = ["job_id", "page_num"]
    return pages.select(*page).distinct().join(fonts.select(*page), page, "left_anti").join(paths.select(*page), page, "left_semi")


def text_size_rules(runs: DataFrame, small: float = 6.0, tiny: float = 4.0) -> DataFrame:
    """Size and rendering rules of text runs, rolled up per page: number of runs, least size and first operation.

    Columns: job_id, page_num, op_idx, size_pt, render_mode, c, m, y, k. Runs without a positive size match no size rule.
    """
    size, inks = F.col("size_pt"), [F.col(x) for x in "cmyk"]
    white = (F.greatest(*inks) == 0) & (F.col("render_mode") != 3)
    rules = {
        "TEXT_001": ("advisory", (size >= tiny) & (size < small)),
        "TEXT_002": ("warning", (size > 0) & (size < tiny)),
        "TEXT_003": ("advisory", F.col("render_mode") == 3),
        "TEXT_004": ("advisory", white),
        "TEXT_005": ("warning", C.is_registration(*inks)),
        "TEXT_006": ("warning", (size > 0) & (size < small) & (C.active_inks(*inks) > 1)),
    }
    hits = fused(runs, rules, "job_id", "page_num", "op_idx", "size_pt")
    return hits.groupBy("job_id", "page_num", "inspection_id", "severity").agg(F.count("*").alias("runs"), F.min("size_pt").alias("least_pt"), F.min("op_idx").alias("first_op"))


def _ways(runs: DataFrame, step: float) -> DataFrame:
    turned = F.pmod(F.round(F.col("angle") / step) * step, F.lit(360.0))
    return runs.where("NOT mirrored").withColumn("way", turned)


def upside_down(runs: DataFrame, step: float = 5.0, least: int = 8, majority: int = 5, opposite: int = 3) -> DataFrame:
    """Pages where at least ``opposite`` runs stand on their head against the most common direction.

    Directions are rounded to ``step`` degrees. A page counts from ``least`` runs on if its most common direction (the
    smaller, if several) has ``majority``. Only counts per page and direction are joined, never runs with runs.
    """
    page = ["job_id", "page_num"]
    ways = _ways(runs, step).groupBy(*page, "way").agg(F.count("*").alias("n"))
    top = ways.groupBy(*page).agg(F.sum("n").alias("runs"), F.max_by("way", F.struct("n", -F.col("way"))).alias("upright"), F.max("n").alias("most"))
    apart = F.pmod(F.col("way") - F.col("upright"), F.lit(360.0))
    near = ways.join(top.where((F.col("runs") >= least) & (F.col("most") >= majority)), page).where(F.abs(apart - 180) <= step)
    return near.groupBy(*page, "upright").agg(F.sum("n").alias("inverted")).where(F.col("inverted") >= opposite)


def mirrored_text(runs: DataFrame, least: int = 3) -> DataFrame:
    """(job_id, page_num, mirrored) of pages with at least ``least`` mirrored runs."""
    return runs.where("mirrored").groupBy("job_id", "page_num").agg(F.count("*").alias("mirrored")).where(F.col("mirrored") >= least)


def legal_copy(runs: DataFrame, least: float = 5.0, ignore: float = 2.0, most: int = 5) -> DataFrame:
    """The first run of each page, font and tenth of a point below ``least``; at most ``most`` per page, smallest first.

    Sizes up to ``ignore`` are taken as degenerate.
    """
    small = runs.where((F.col("size_pt") < least) & (F.col("size_pt") > ignore)).withColumn("tenth", F.floor(F.col("size_pt") * 10))
    one = small.groupBy("job_id", "page_num", "font", "tenth").agg(F.min("op_idx").alias("op_idx"))
    return first_per(one, ["job_id", "page_num"], ["tenth", "op_idx"], most)


def language_mix(pages: DataFrame) -> DataFrame:
    """Pages whose language differs from that of most pages of the job (the smaller name, if several)."""
    counted = pages.where("lang IS NOT NULL").groupBy("job_id", "lang").agg(F.count("*").alias("n"))
    # the least name among the most frequent
    best = counted.groupBy("job_id").agg(F.max("n").alias("n")).join(counted, ["job_id", "n"]).groupBy("job_id").agg(F.min("lang").alias("majority"))
    return pages.join(best, "job_id").where("lang <> majority").select("job_id", "page_num", "lang", "majority")


def outlined_text(events: DataFrame, regions: DataFrame, paths: int = 50, most_chars: int = 10, least_chars: int = 20, sure: float = 0.5) -> DataFrame:
    """Pages with many paths and hardly any text on which a detector still found text.

    ``events`` has (job_id, page_num, kind, chars), ``regions`` (job_id, page_num, chars, confidence).
    """
    page = ["job_id", "page_num"]
    per = events.groupBy(*page).agg(F.count_if(F.col("kind") == "path").alias("paths"), F.coalesce(F.sum(F.when(F.col("kind") == "text", F.col("chars"))), F.lit(0)).alias("chars"))
    seen = regions.where(F.col("confidence") > sure).groupBy(*page).agg(F.sum("chars").alias("seen"))
    return per.where((F.col("paths") >= paths) & (F.col("chars") <= most_chars)).join(seen.where(F.col("seen") > least_chars), page)


def needs_detection(pages: DataFrame, share: float = 0.25, paths: int = 50, most_chars: int = 10) -> DataFrame:
    """Pages to run text detection on: images cover over ``share``, or many paths and hardly any text."""
    return pages.where((F.col("image_area") > share * F.col("area")) | ((F.col("paths") >= paths) & (F.col("chars") <= most_chars))).select("job_id", "page_num")
