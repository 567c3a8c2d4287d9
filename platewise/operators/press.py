"""Whether a job suits a press without black: hard, soft and advisory rejections, in the order in which they are found.

Every function gives (job_id, page_num, inspection_id, severity, ord); page 0 is the document, and ``ord`` is the place of a rule,
then of its page, so that ``findings.press_verdict`` names its drivers in that order. Repeats of one recipe, size or image on a
page are one finding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import color as C
from platewise.functions import geometry as G

PAGE = ["job_id", "page_num"]
INKS = list("cmyk")
# Rules in order with their tiers, inks that are no spots, and stocks that do not suit (fixed values).
CODES = (
    "EPM_GAMUT_OUT_REJECT", "EPM_K_COVERAGE_REJECT", "EPM_RICH_BLACK_REJECT", "EPM_SUBSTRATE_REJECT", "EPM_TEXT_SIZE_REJECT", "EPM_PROCESS_COUNT_REJECT", "EPM_BLEED_REJECT", "EPM_PAGE_COUNT_REJECT", "EPM_IMAGE_RES_REJECT", "EPM_TRIM_REJECT",
    "EPM_SPOT_COUNT_REJECT", "EPM_FEATURE_SIZE_REJECT", "EPM_MIXED_SPACES_REJECT", "EPM_TRAPPING_REJECT", "EPM_TRIM_BLEED_REJECT", "EPM_PAGE_GEOM_REJECT",
)
SEVERITIES = ("error",) * 5 + ("warning",) * 5 + ("advisory",) * 6
NO_SPOTS = ("cyan", "magenta", "yellow", "black", "all", "none")
SUBSTRATES = ("uncoated_heavy", "metallic", "transparent", "newsprint")
#: House recipe of rich black in percent.
RICH_BLACK = {"c": 40.0, "m": 20.0, "y": 20.0, "k": 80.0}


def _found(rows: DataFrame, code: str, page: str | None = "page_num") -> DataFrame:
    n = CODES.index(code)
    at = F.col(page).cast("int") if page else F.lit(0)
    return rows.select("job_id", at.alias("page_num"), F.lit(code).alias("inspection_id"), F.lit(SEVERITIES[n]).alias("severity"), (F.lit(n * 10_000_000).cast("long") + at).alias("ord"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def with_black_shift(rows: DataFrame, out: str, delta: Callable[[tuple, tuple], Column] = C.delta_e2000) -> DataFrame:
    """``rows`` with ``out``: how far a colour (c, m, y, k) moves if its black is left out.

    Light and Lab are columns of their own before they are compared: written into one another, the expression would grow manifold.
    """
    c, m, y, k = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x))) for x in INKS)
    both = {"f": C.cmyk_to_rgb(c, m, y, k), "w": C.cmyk_to_rgb(c, m, y, F.lit(0.0))}
    light = {f"_{p}{x}": v for p, rgb in both.items() for x, v in zip("rgb", rgb, strict=True)}
    rows = rows.withColumns(light)
    labs = {f"_{p}{x}": v for p in both for x, v in zip(("l", "a", "z"), C.rgb_to_lab(*(F.col(f"_{p}{q}") for q in "rgb")), strict=True)}
    rows = rows.withColumns(labs)
    one, two = (tuple(F.col(f"_{p}{x}") for x in ("l", "a", "z")) for p in both)
    return rows.withColumn(out, delta(one, two)).drop(*light, *labs)


def hard_rejections(
    paths: DataFrame, runs: DataFrame, docs: DataFrame, black: float = 80.0, within: float = 2.0, recipe: float = 25.0, points: float = 5.0, delta: Callable[[tuple, tuple], Column] = C.delta_e2000
) -> DataFrame:
    """Tier A: fills that need black, fills with much black that would shift without it, rich black off the recipe, stocks, small text.

    ``paths`` and ``runs`` have c, m, y, k from 0 to 1; ``docs`` has substrate. One scan of paths gives three rules.
    """
    c, m, y, k = (F.col(x) for x in INKS)
    off = sum((F.abs(F.col(x) * 100 - v) for x, v in RICH_BLACK.items()), F.lit(0.0))
    tests = {
        "EPM_GAMUT_OUT_REJECT": (F.least(c, m, y) >= 0.95) & (k >= 0.5),
        "EPM_K_COVERAGE_REJECT": (k * 100 >= black) & (F.col("shift") > within),
        "EPM_RICH_BLACK_REJECT": (k * 100 >= 90) & (F.greatest(c, m, y) * 100 >= 5) & (off > recipe),
    }
    fills = with_black_shift(paths.where("fill").select(*PAGE, *[G.rounded(F.col(x), 2).alias(x) for x in INKS]).distinct(), "shift", delta)
    marked = fills.select(*PAGE, F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda n: n.isNotNull())).alias("code"))
    parts = [_found(marked.where(F.col("code") == n), n) for n in tests]
    fit = F.lit(False)
    for s in SUBSTRATES:
        fit |= F.lower("substrate").contains(s)
    parts.append(_found(docs.where(fit), "EPM_SUBSTRATE_REJECT", None))
    coloured = ~((F.greatest(c, m, y) < 0.05) & (k > 0.5))
    small = runs.where((F.col("size_pt") < points) & coloured).select(*PAGE, G.rounded(F.col("size_pt"), 2).alias("size_pt")).distinct()
    return _union([*parts, _found(small, "EPM_TEXT_SIZE_REJECT")])


def _boxes(pages: DataFrame) -> DataFrame:
    """Pages with trim t and bleed b filled from the next larger box, and bleed s as the trim rule fills it."""
    sides = ("x0", "y0", "x1", "y1")
    return pages.select(*PAGE, *[F.coalesce(f"t{s}", f"c{s}", f"m{s}").alias(f"t{s}") for s in sides], *[F.coalesce(f"b{s}", f"m{s}").alias(f"b{s}") for s in sides], *[F.coalesce(f"b{s}", f"c{s}", f"m{s}").alias(f"s{s}") for s in sides], *[f"m{s}" for s in sides])


def _spaces(spaces: DataFrame) -> DataFrame:
    """Per job: which process colours and spot names its colour spaces have."""
    kind = F.lower("cs_type")
    spot = (kind.contains("separation") | kind.contains("devicen")) & (F.col("colorant") != "") & ~F.lower("colorant").isin(*NO_SPOTS)
    has = lambda word: F.max(kind.contains(word).cast("int"))
    return spaces.groupBy("job_id").agg(has("cmyk").alias("cmyk"), has("rgb").alias("rgb"), has("gray").alias("gray"), has("separation").alias("separation"), has("devicen").alias("devicen"), F.count_distinct(F.when(spot, F.col("colorant"))).alias("spots"))


def soft_rejections(spaces: DataFrame, pages: DataFrame, images: DataFrame, plates: int = 4, bleed: float = 8.5, least_pages: int = 4, dpi: float = 200.0, tolerance: float = 0.5) -> DataFrame:
    """Tier B: too many process colours, bleed, page count, image resolution, and boxes that differ between pages."""
    boxes = _boxes(pages)
    margin = F.least(F.col("tx0") - F.col("bx0"), F.col("ty0") - F.col("by0"), F.col("bx1") - F.col("tx1"), F.col("by1") - F.col("ty1"))
    spread = F.greatest(*[F.max(f"{p}{s}") - F.min(f"{p}{s}") for p in "ts" for s in ("x0", "y0", "x1", "y1")])
    per = boxes.groupBy("job_id").agg(F.count_distinct("page_num").alias("pages"), spread.alias("spread"))
    res = G.effective_dpi(F.col("pixel_width"), F.col("pixel_height"), *[F.col(x) for x in "abcd"])
    low = images.where((F.col("pixel_width") > 0) & (F.col("pixel_height") > 0) & (res < dpi)).select(*PAGE, "image_name").distinct()
    return _union([
        _found(_spaces(spaces).where(F.col("cmyk") + F.col("rgb") + F.col("gray") + F.col("spots") > plates), "EPM_PROCESS_COUNT_REJECT", None), _found(boxes.where(margin < bleed), "EPM_BLEED_REJECT"),
        _found(per.where(F.col("pages") < least_pages), "EPM_PAGE_COUNT_REJECT", None), _found(low, "EPM_IMAGE_RES_REJECT"), _found(per.where((F.col("pages") > 1) & (F.col("spread") > tolerance)), "EPM_TRIM_REJECT", None),
    ])


def advisories(spaces: DataFrame, paths: DataFrame, docs: DataFrame, pages: DataFrame, spots: int = 6, line: float = 0.35, tolerance: float = 1.0) -> DataFrame:
    """Tier C: many spots, thin strokes, mixed process spaces, no trapping, trim off centre in the bleed, page sizes that vary."""
    used, boxes = _spaces(spaces), _boxes(pages)
    thin = paths.where(~F.col("fill") & (F.col("line_width") > 0) & (F.col("line_width") < line)).select(*PAGE, G.rounded(F.col("line_width"), 3).alias("w")).distinct()
    kinds = F.col("cmyk") + F.col("rgb") + F.col("gray") + F.col("separation") + F.col("devicen")
    across = F.abs((F.col("tx0") - F.col("bx0")) - (F.col("bx1") - F.col("tx1"))) > tolerance
    along = F.abs((F.col("ty0") - F.col("by0")) - (F.col("by1") - F.col("ty1"))) > tolerance
    # sizes vary if one side does: two ends a side are combined before the shuffle, distinct sizes would be held
    sides = {"w": G.rounded(F.col("mx1") - F.col("mx0"), 1), "h": G.rounded(F.col("my1") - F.col("my0"), 1)}
    whole = boxes.select("job_id", *[v.alias(k) for k, v in sides.items()]).where("w IS NOT NULL AND h IS NOT NULL")
    sizes = whole.groupBy("job_id").agg(F.greatest(*[(F.min(k) != F.max(k)).cast("int") for k in sides]).alias("vary"))
    trapped = F.lower(F.trim(F.coalesce("trapped", F.lit("")))).isin("true", "yes", "/true")
    return _union([
        _found(used.where(F.col("spots") > spots), "EPM_SPOT_COUNT_REJECT", None), _found(thin, "EPM_FEATURE_SIZE_REJECT"), _found(used.where(kinds > 1), "EPM_MIXED_SPACES_REJECT", None),
        _found(docs.where(~trapped), "EPM_TRAPPING_REJECT", None), _found(boxes.where(across | along), "EPM_TRIM_BLEED_REJECT"), _found(sizes.where("vary > 0"), "EPM_PAGE_GEOM_REJECT", None),
    ])
