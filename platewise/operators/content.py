"""Rules on colours, bar codes and the words of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import color as C
from platewise.functions.text import check_digit
from platewise.operators.families import first_per
from platewise.operators.layout import PAGE, PROCESS
from platewise.operators.spatial import box_pairs

#: Words in names of inks that stand for a step of finishing instead of a colour.
FINISHING = ("cut", "crease", "varnish", "foil", "emboss", "white")


def ink_class(name: Column) -> Column:
    """reserved, process, library, finishing or spot, by the ink's name in lower case without spaces around it; null has none."""
    n = F.lower(F.trim(name))
    finishing = F.lit(False)
    for word in FINISHING:
        finishing |= n.contains(word)
    return F.when(n.isin("all", "none"), "reserved").when(n.isin(*PROCESS), "process").when(n.startswith("pantone"), "library").when(finishing, "finishing").when(n.isNotNull(), "spot")


# Application identifiers: length of a fixed value (0 if it ends at a separator) and its syntax (fixed values of the standard).
GS1 = {
    "00": (18, r"\d{18}"), "01": (14, r"\d{14}"), "02": (14, r"\d{14}"), "10": (0, r"[\x21-\x7e]{1,20}"), "11": (6, r"\d{6}"), "12": (6, r"\d{6}"), "13": (6, r"\d{6}"),
    "15": (6, r"\d{6}"), "16": (6, r"\d{6}"), "17": (6, r"\d{6}"), "20": (2, r"\d{2}"), "21": (0, r"[\x21-\x7e]{1,20}"), "22": (0, r"[\x21-\x7e]{1,20}"), "30": (0, r"\d{1,8}"), "37": (0, r"\d{1,8}"),
    "240": (0, r"[\x21-\x7e]{1,30}"), "241": (0, r"[\x21-\x7e]{1,30}"), "250": (0, r"[\x21-\x7e]{1,30}"), "251": (0, r"[\x21-\x7e]{1,30}"), "310": (7, r"[0-5]\d{6}"), "320": (7, r"[0-5]\d{6}"),
    "8200": (0, r"[\x21-\x7e]{1,70}"), "8201": (0, r"[\x21-\x7e]{1,70}"), "8202": (0, r"[\x21-\x7e]{1,70}"),
}
_LONGEST = sorted(GS1, key=len, reverse=True)
ELEMENT = "|".join(f"{ai}(?s:.{{0,{GS1[ai][0]}}})" if GS1[ai][0] else f"{ai}[^\\x1d]*+(?:\\x1d|$)" for ai in _LONGEST)


def gs1_elements(payload: Column) -> Column:
    """Array of (ai, value, valid) of a GS1 element string, element by element from its start.

    The longest identifier that fits is taken; a fixed value has its length, or less at the end, others end at a separator.
    What follows the first unknown identifier is one element ``?`` that is not valid. Leading symbology marks are skipped.
    """
    body = F.regexp_replace(payload, r"^(?:\]C1|\]Q3|\]e0|\x1d)", "")
    known = F.regexp_extract(body, f"^((?:{ELEMENT})*+)", 1)
    rest = F.substring(body, F.length(known) + 1, F.length(body))

    def element(e: Column) -> Column:
        ai = F.regexp_extract(e, f"^({'|'.join(_LONGEST)})", 1)
        value = F.regexp_replace(F.substring(e, F.length(ai) + 1, F.length(e)), r"\x1d$", "")
        valid = F.lit(False)
        for name, (_, syntax) in GS1.items():
            valid = F.when(ai == name, value.rlike(f"^{syntax}$")).otherwise(valid)
        return F.struct(ai.alias("ai"), value.alias("value"), valid.alias("valid"))

    found = F.transform(F.regexp_extract_all(known, F.lit(f"({ELEMENT})"), F.lit(1)), element)
    unknown = F.struct(F.lit("?").alias("ai"), rest.alias("value"), F.lit(False).alias("valid"))
    return F.when(F.length(rest) > 0, F.concat(found, F.array(unknown))).otherwise(found)


def grade(score: Column) -> Column:
    """Letter of a quality score from 0 to 4."""
    return F.when(score >= 3.5, "A").when(score >= 2.5, "B").when(score >= 1.5, "C").when(score >= 0.5, "D").otherwise("F")


def bar_candidates(bars: DataFrame, least: int = 20) -> DataFrame:
    """Pages with at least ``least`` bars (x0, x1): number, range and the grade of contrast, 4 (1 - variation of the widths)."""
    width = F.col("x1") - F.col("x0")
    per = bars.groupBy(*PAGE).agg(F.count("*").alias("bars"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), (F.stddev_pop(width) / F.avg(width)).alias("cv"))
    score = F.round(F.greatest(4 * (1 - F.col("cv")), F.lit(0.0)), 4)
    return per.where(F.col("bars") >= least).select(*PAGE, "bars", "x0", "x1", score.alias("score"), grade(score).alias("grade"))


def rgb_in_cmyk_jobs(images: DataFrame) -> DataFrame:
    """First page of each job that has a device RGB image although the job has CMYK ones, with the number of such pages."""
    rgb, cmyk = (F.col("color_space") == s for s in ("DeviceRGB", "DeviceCMYK"))
    per = images.groupBy("job_id").agg(F.min(F.when(rgb, F.col("page_num"))).alias("page_num"), F.count_distinct(F.when(rgb, F.col("page_num"))).alias("pages"), F.bool_or(cmyk).alias("cmyk"))
    return per.where("cmyk AND pages > 0").select("job_id", "page_num", "pages")


def coverage_over_limit(paths: DataFrame, limits: DataFrame) -> DataFrame:
    """Jobs whose greatest coverage exceeds their print condition's limit (job_id, max_coverage), with the page that has it.

    Pages are reduced before the join; the first page is taken, if several have it. Null limits never match.
    """
    value = F.round(C.coverage(*[F.col(x) for x in "cmyk"]), 4)
    worst = paths.groupBy("job_id").agg(F.max(value).alias("coverage"), F.max_by("page_num", F.struct(value, -F.col("page_num"))).alias("page_num"))
    return worst.join(limits.select("job_id", "max_coverage"), "job_id").where("coverage > max_coverage")


def three_color_press(paths: DataFrame, most_objects: int = 5000, weak: float = 0.85) -> DataFrame:
    """Per job what a press without black would stumble over: paints with black, pure black, weak three-ink black, too many objects."""
    c, m, y, k = (F.col(x) for x in "cmyk")
    three = F.least(c, m, y)
    return paths.groupBy("job_id").agg(
        F.count_if(k > 0).alias("with_black"),
        F.count_if((k > 0) & (F.greatest(c, m, y) == 0)).alias("pure_black"),
        F.count_if((three >= 0.5) & (three < weak)).alias("weak_black"),
        (F.count("*") > most_objects).alias("many_objects"),
    )


def text_contrast(colors: DataFrame, large: float = 18.0) -> DataFrame:
    """Distinct text colours (r, g, bl) and sizes of a job with their contrast on white and the levels AA and AAA that they reach."""
    one = colors.select("job_id", "r", "g", "bl", "size_pt").distinct()
    ratio = F.round(C.contrast(F.lit(1.0), C.luminance(F.col("r"), F.col("g"), F.col("bl"))), 6)
    big = F.col("size_pt") >= large
    aa, aaa = (ratio >= F.when(big, lo).otherwise(hi) for lo, hi in ((3.0, 4.5), (4.5, 7.0)))
    return one.select("job_id", "size_pt", ratio.alias("contrast"), aa.alias("aa"), aaa.alias("aaa")).distinct()


def nearest_in_palette(colors: DataFrame, palette: dict[str, tuple[float, float, float]], delta: Callable[[tuple, tuple], Column] = C.delta_e2000, most: float = 3.0) -> DataFrame:
    """The nearest palette colour of each row's Lab colour (l, a, b) if it is farther than ``most``; the first name, if several.

    The palette is part of the plan, so the rows are neither shuffled nor multiplied. Hand in distinct colours.
    """
    lab = (F.col("l"), F.col("a"), F.col("b"))
    found = F.array_min(F.array(*[F.struct(F.round(delta(lab, tuple(map(F.lit, v))), 4).alias("distance"), F.lit(k).alias("name")) for k, v in sorted(palette.items())]))
    return colors.withColumn("near", found).where(F.col("near.distance") > most).select(*colors.columns, "near.*")


def dimension_callouts(text: DataFrame, least: int = 2) -> DataFrame:
    """Pages on which at least ``least`` different dimensions with a technical unit stand, sorted and joined by bars."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+(?:[.][0-9]+)? ?(?:mm|cm|pt))"), F.lit(1))))
    return text.select(*PAGE, found.alias("f")).where(F.size("f") >= least).select(*PAGE, F.array_join("f", "|").alias("dimensions"))


def suspicious_words(text: DataFrame, pattern: str, known: tuple[str, ...] = (), most: int = 10) -> DataFrame:
    """Words that match ``pattern`` and aren't known, with their number; at most ``most`` per page, the most frequent first."""
    words = text.select(*PAGE, F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("word")).where(~F.lower("word").isin(*known))
    counted = words.groupBy(*PAGE, "word").agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    return first_per(counted, PAGE, ["less", "word"], most).select(*PAGE, "word", "n")


def overlaps(one: DataFrame, two: DataFrame) -> DataFrame:
    """Boxes of ``one`` that boxes of ``two`` on their page cover in part: number of those and the greatest common area.

    Boxes meet in cells of a grid (``spatial.box_pairs``), so a page's boxes are not all compared.
    """
    box = ["x0", "y0", "x1", "y1"]
    pairs = box_pairs(one.select(*PAGE, "op_idx", *box), two.select(*PAGE, *box), PAGE)
    width = F.least("x1", "ox1") - F.greatest("x0", "ox0")
    height = F.least("y1", "oy1") - F.greatest("y0", "oy0")
    return pairs.where((width > 0) & (height > 0)).groupBy(*PAGE, "op_idx").agg(F.count("*").alias("boxes"), F.max(width * height).alias("area"))
