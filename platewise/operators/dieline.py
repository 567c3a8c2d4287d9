"""Dieline geometry and paint state: rules on what is painted against, over and near cutting and folding lines.

``paints`` has a row for each paint of a page in drawing order: job_id, page_num, op_idx, role (dieline, crease, varnish,
varnish_free, white or art), kind (path, text, image), fill and stroke, overprint, alpha, blend_mode, in_die_layer, x0, y0, x1, y1.
``regions`` are the boxes of the dieline's islands: job_id, page_num, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.families import fused
from platewise.operators.spatial import box_pairs, gap

PAGE = ["job_id", "page_num"]
SIDES = ["x0", "y0", "x1", "y1"]
#: Millimetres of a point as these rules count them.
MM = 0.352778


def paint_state_rules(paints: DataFrame, large: float = 100.0) -> DataFrame:
    """(job_id, page_num, inspection_id, severity): dielines drawn below artwork, knocked out, filled as art, clear or blended, and
    artwork on a layer of dielines; one aggregate per page.

    A dieline that is filled is an error from ``large`` square points on, an advisory below.
    """
    die = F.col("role") == "dieline"
    normal = F.coalesce("blend_mode", F.lit("Normal")).isin("Normal", "Compatible")
    per = paints.groupBy(*PAGE).agg(
        F.max(F.when(die, F.col("op_idx"))).alias("last_die"), F.max(F.when(~die, F.col("op_idx"))).alias("last_art"),
        F.count_if(die & F.col("stroke") & ~F.coalesce("overprint", F.lit(False))).alias("knocked"),
        F.count_if(die & F.col("fill")).alias("fills"), F.sum(F.when(die & F.col("fill"), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("area"),
        F.count_if(die & (F.col("alpha") < 1.0)).alias("clear"), F.count_if(die & ~normal).alias("blended"), F.count_if(~die & F.coalesce("in_die_layer", F.lit(False))).alias("foreign"),
    )
    rules = {
        "DIE_ZORDER": ("warning", F.col("last_art") > F.col("last_die")), "DIE_KNOCKOUT": ("warning", F.col("knocked") > 0),
        "DIE_AS_ART": (F.when(F.col("area") >= large, "error").otherwise("advisory"), F.col("fills") > 0), "DIE_OPACITY_LOW": ("warning", F.col("clear") > 0),
        "DIE_BLEND_MODE": ("warning", F.col("blended") > 0), "DIE_LAYER_CONTENT": ("warning", F.col("foreign") > 0),
    }
    return fused(per, rules, *PAGE)


def _hull(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.groupBy(*PAGE).agg(*[(F.min if s.endswith("0") else F.max)(s).alias(f"{prefix}{s}") for s in SIDES])


def _overhang(box: str, hull: str) -> Column:
    sides = [F.col(f"{hull}x0") - F.col(f"{box}x0"), F.col(f"{hull}y0") - F.col(f"{box}y0"), F.col(f"{box}x1") - F.col(f"{hull}x1"), F.col(f"{box}y1") - F.col(f"{hull}y1")]
    return F.greatest(F.lit(0.0), *sides)


def with_layout(regions: DataFrame) -> DataFrame:
    """Per page the hull of its regions and whether they repeat one die: three or more of sizes within a tenth of the median."""
    sized = regions.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    # the upper of the two middle sizes, where their number is even
    middle = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})") * -1
    sizes = sized.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("w").alias("w0"), F.max("w").alias("w1"), F.min("h").alias("h0"), F.max("h").alias("h1"), middle("w").alias("mw"), middle("h").alias("mh"))
    near = lambda c, m: F.abs(F.col(c) - F.col(m)) / F.col(m) < 0.1
    many = (F.col("n") >= 3) & near("w0", "mw") & near("w1", "mw") & near("h0", "mh") & near("h1", "mh")
    return _hull(regions, "h").join(sizes.select(*PAGE, many.alias("multi_up")), PAGE, "left").fillna(False, ["multi_up"])


def content_outside(paints: DataFrame, regions: DataFrame, tolerance: float = 2.83, max_bleed_mm: float = 3.0) -> DataFrame:
    """(job_id, page_num, inspection_id, severity, boxes, worst): artwork beyond the dieline by more than ``tolerance`` points
    (DIE_CONTENT_OUTSIDE), or beyond its hull by more than the bleed allowed (DIE_EXCESSIVE_BLEED); worst in points.

    On a sheet that repeats one die a box counts by the region that it leaves least. Regions within reach are found by the grid; a
    box that none is near overhangs all, so its least overhang over all regions is taken from the page's list, which only such boxes join.
    """
    layout = with_layout(regions)
    art = paints.where(~F.col("role").isin("dieline", "crease")).select(*PAGE, "op_idx", *SIDES)
    beside = art.join(layout, PAGE).withColumn("over", _overhang("", "h"))
    single = beside.where("NOT multi_up").select(*PAGE, F.col("over").alias("least"))
    many = beside.where("multi_up").select(*PAGE, "op_idx", *SIDES)
    near = box_pairs(many, regions.select(*PAGE, *SIDES), PAGE, tolerance).withColumn("over", _overhang("", "o"))
    inside = near.groupBy(*PAGE, "op_idx", *SIDES).agg(F.min("over").alias("least"))
    # within the tolerance of a region, a box is done; the others need their exact least overhang
    settled = inside.where(F.col("least") <= tolerance)
    far = many.join(settled.select(*PAGE, "op_idx"), [*PAGE, "op_idx"], "left_anti")
    exact = far.join(regions.select(*PAGE, *[F.col(s).alias(f"o{s}") for s in SIDES]), PAGE).withColumn("over", _overhang("", "o")).groupBy(*PAGE, "op_idx").agg(F.min("over").alias("least")).select(*PAGE, "least")
    outside = single.unionByName(exact).where(F.col("least") > tolerance).groupBy(*PAGE).agg(F.count("*").alias("boxes"), F.max("least").alias("worst"))
    bleed = beside.where(F.col("over") > max_bleed_mm / MM).groupBy(*PAGE).agg(F.count("*").alias("boxes"), F.max("over").alias("worst"))
    named = lambda rows, name, severity: rows.select(*PAGE, F.lit(name).alias("inspection_id"), F.lit(severity).alias("severity"), "boxes", "worst")
    return named(outside, "DIE_CONTENT_OUTSIDE", "warning").unionByName(named(bleed, "DIE_EXCESSIVE_BLEED", "advisory"))


def coverage_rules(paints: DataFrame, regions: DataFrame, least_white: float = 0.95, least_area: float = 50.0) -> DataFrame:
    """(job_id, page_num, inspection_id, severity, amount): varnish over a varnish-free area (square points) and gaps in the white
    below the dieline (percent covered), by the hulls of their paints; one aggregate and one join by page.
    """
    sides = lambda role, p: [(F.min if s.endswith("0") else F.max)(F.when(F.col("role") == role, F.col(s))).alias(f"{p}{s}") for s in SIDES]
    per = paints.groupBy(*PAGE).agg(*sides("varnish", "v"), *sides("varnish_free", "f"), *sides("white", "w")).join(_hull(regions, "h"), PAGE, "left")

    def common(a: str, b: str) -> Column:
        width, height = (F.least(f"{a}{c}1", f"{b}{c}1") - F.greatest(f"{a}{c}0", f"{b}{c}0") for c in "xy")
        return F.when((F.col(f"{a}x0").isNotNull()) & F.col(f"{b}x0").isNotNull(), F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)))

    area = (F.col("hx1") - F.col("hx0")) * (F.col("hy1") - F.col("hy0"))
    per = per.withColumns({"both": common("v", "f"), "covered": F.when(area > 0, common("w", "h") / area * 100)})
    rows = per.select(*PAGE, F.explode(F.array(F.struct(F.lit("DIE_VARNISH_COLLISION").alias("inspection_id"), F.col("both").alias("amount")), F.struct(F.lit("DIE_WHITE_GAP").alias("inspection_id"), F.col("covered").alias("amount")))).alias("r"))
    rows = rows.select(*PAGE, "r.inspection_id", "r.amount")
    hit = F.when(F.col("inspection_id") == "DIE_WHITE_GAP", F.col("amount") < least_white * 100).otherwise(F.col("amount") >= least_area)
    return rows.where(hit).select(*PAGE, "inspection_id", F.lit("warning").alias("severity"), F.round("amount", 6).alias("amount"))


def near_lines(paints: DataFrame, quiet_mm: float = 2.5, fold_mm: float = 3.0) -> DataFrame:
    """(job_id, page_num, inspection_id, severity, boxes, least): images closer than ``quiet_mm`` to a cutting or folding line
    (BARCODE_QUIET_ZONE) and text closer than ``fold_mm`` to a fold (TEXT_NEAR_FOLD), by the grid; least in millimetres.
    """
    lines = paints.where(F.col("role").isin("dieline", "crease") & F.col("stroke")).select(*PAGE, "role", *SIDES)
    live = paints.where((F.col("role") == "art") & F.col("kind").isin("image", "text")).select(*PAGE, "op_idx", "kind", *SIDES)
    pairs = box_pairs(live, lines, PAGE, max(quiet_mm, fold_mm) / MM).withColumn("d", gap())
    hit = F.when((F.col("kind") == "image") & (F.col("d") < quiet_mm / MM), "BARCODE_QUIET_ZONE").when((F.col("kind") == "text") & (F.col("orole") == "crease") & (F.col("d") < fold_mm / MM), "TEXT_NEAR_FOLD")
    per = pairs.withColumn("inspection_id", hit).where("inspection_id IS NOT NULL").groupBy(*PAGE, "inspection_id", "op_idx").agg(F.min("d").alias("d"))
    severity = F.when(F.col("inspection_id") == "TEXT_NEAR_FOLD", "warning").otherwise("advisory")
    return per.groupBy(*PAGE, "inspection_id").agg(F.count("*").alias("boxes"), F.round(F.min("d") * MM, 6).alias("least")).select(*PAGE, "inspection_id", severity.alias("severity"), "boxes", "least")


def small_features(polylines: DataFrame, least_mm: float = 1.0, least_perimeter_mm: float = 1.0) -> DataFrame:
    """(job_id, page_num, inspection_id, severity, features, smallest): dieline polylines (``points`` of x, y) too small to cut; smallest side in mm."""
    side = lambda c: (F.array_max(F.transform("points", lambda p: p[c])) - F.array_min(F.transform("points", lambda p: p[c]))) * MM
    n = F.size("points")
    steps = F.zip_with(F.slice("points", F.lit(1), n - 1), F.slice("points", F.lit(2), n - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    rows = polylines.where(n >= 2).select(*PAGE, F.least(side("x"), side("y")).alias("side"), (F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) * MM).alias("perimeter"))
    small = rows.where((F.col("side") < least_mm) | (F.col("perimeter") < least_perimeter_mm))
    return small.groupBy(*PAGE).agg(F.count("*").alias("features"), F.round(F.min("side"), 6).alias("smallest")).select(*PAGE, F.lit("DIE_TOO_SMALL").alias("inspection_id"), F.lit("warning").alias("severity"), "features", "smallest")
