"""Rules on where and in which order a page is painted: bands, keep-out zones, cutting inks, symbols and plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.operators.dealing import dealt, tasks_for
from platewise.operators.families import POINTS_PER_MM, first_per, fused
from platewise.operators.series import carried
from platewise.operators.spatial import box_pairs

PAGE = ["job_id", "page_num"]


def empty_bands(boxes: DataFrame, least: float = 30.0) -> DataFrame:
    """Empty horizontal bands of at least ``least`` points between painted boxes of a page: (job_id, page_num, below, above).

    Gaps of the union of intervals: each box is compared with the highest end of all that begin before it.
    """
    before = W.partitionBy(*PAGE).orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    rows = boxes.select(*PAGE, "y0", "y1").distinct().withColumn("below", F.max("y1").over(before))
    return rows.where(F.col("y0") - F.col("below") >= least).select(*PAGE, "below", F.col("y0").alias("above"))


def step_and_repeat(boxes: DataFrame, least: int = 3, agree: float = 0.8, whole: float = 1.0) -> DataFrame:
    """(job_id, page_num, width, height, boxes, columns, rows, step_x, step_y): lattices of equal boxes, as a sheet of labels has.

    Boxes of one size, to ``whole`` points, vote with the vector to the next one in their row and in their column; a lattice is
    there if ``agree`` of all votes, two at least, are for one step each way. Neighbours vote, not all pairs, so votes grow with the boxes.
    Boxes are dealt by row, then by column, and votes are combined before they meet. ``boxes`` is counted.
    """
    snap = lambda c: F.round(F.col(c) / whole) * whole
    size = ["width", "height"]
    rows = boxes.where("x1 > x0 AND y1 > y0").select(*PAGE, snap("x0").alias("x"), snap("y0").alias("y"), (F.round((F.col("x1") - F.col("x0")) / whole) * whole).alias("width"), (F.round((F.col("y1") - F.col("y0")) / whole) * whole).alias("height"))
    group = [*PAGE, *size]
    step = lambda along, across: F.col(along) - F.lag(along).over(W.partitionBy("_at", *group, across).orderBy(along))
    # doubles as keys of a window are normalised anew, so rows are dealt by the hash of a line of boxes
    tasks = tasks_for(boxes)
    at = lambda across: F.xxhash64(*group, F.col(across) + 0.0)
    lines = dealt(rows.withColumn("_at", at("y")), tasks, "_at").distinct().withColumn("dx", step("x", "y"))
    votes = dealt(lines.withColumn("_at", at("x")), tasks, "_at").withColumn("dy", step("y", "x"))
    ways = votes.select(*group, F.explode(F.array(*[F.struct(F.lit(c).alias("way"), F.col(c).alias("step")) for c in ("dx", "dy")])).alias("v")).select(*group, "v.*")
    told = ways.groupBy(*group, "way", "step").agg(F.count("*").alias("n"))
    # in each row of boxes the first has no step along it, and so it is in each column
    of = lambda c, test: F.coalesce(F.sum(F.when((F.col("way") == c) & test, F.col("n"))), F.lit(0))
    stepped, first = F.col("step").isNotNull(), F.col("step").isNull()
    # the most frequent step each way, the least of several: the greatest count, then the least step of those that have it
    best = lambda c: F.max(F.when((F.col("way") == c) & stepped, F.struct("n", (-F.col("step")).alias("step"))))
    per = told.groupBy(*group).agg(of("dx", F.lit(True)).alias("boxes"), of("dy", first).alias("columns"), of("dx", first).alias("rows"), of("dx", stepped).alias("dx_all"), of("dy", stepped).alias("dy_all"), best("dx").alias("dx"), best("dy").alias("dy"))
    won, every = F.coalesce("dx.n", F.lit(0)) + F.coalesce("dy.n", F.lit(0)), F.col("dx_all") + F.col("dy_all")
    # most boxes must have a neighbour at all
    hit = (F.col("boxes") >= least) & (won >= 2) & (won >= agree * every) & (every >= agree * (F.col("boxes") - F.greatest("columns", "rows")))
    found = per.where(hit & (F.col("columns") * F.col("rows") >= F.col("boxes")) & (F.col("boxes") >= agree * F.col("columns") * F.col("rows")))
    return found.select(*group, "boxes", "columns", "rows", (-F.col("dx.step")).alias("step_x"), (-F.col("dy.step")).alias("step_y"))


def seal_zone_hits(runs: DataFrame, labels: Column, margin_mm: float = 5.0) -> DataFrame:
    """Text runs that reach into the zone around a run that marks a seal area (``labels``); one row per run.

    Runs and padded marks meet in cells of a grid (``spatial.box_pairs``).
    """
    pad = margin_mm * POINTS_PER_MM
    box = ["x0", "y0", "x1", "y1"]
    pairs = box_pairs(runs.where(~labels).select(*PAGE, "op_idx", *box), runs.where(labels).select(*PAGE, *box), PAGE, pad)
    meets = (F.col("x0") < F.col("ox1") + pad) & (F.col("x1") > F.col("ox0") - pad) & (F.col("y0") < F.col("oy1") + pad) & (F.col("y1") > F.col("oy0") - pad)
    return pairs.where(meets).groupBy(*PAGE, "op_idx").agg(F.count("*").alias("zones"))


def cutting_paints(events: DataFrame, cutting: dict[str, str]) -> DataFrame:
    """(job_id, ink, page_num, op_idx, overprinted) of the paths of an event log with state that are painted in a cutting ink.

    ``cutting`` names the ink of a colour space's resource name, with or without its slash; it is part of the plan. A path that
    is filled and stroked counts for both.
    """
    ink_of = F.create_map(*[F.lit(x) for item in cutting.items() for x in item])
    paint = lambda on, space, over: F.when(F.col(on), F.struct(ink_of[F.ltrim(F.col(space), F.lit("/"))].alias("ink"), F.coalesce(over, F.lit(False)).alias("overprinted")))
    both = F.array(paint("stroke", "stroke_space", "overprint_stroke"), paint("fill", "fill_space", "overprint_fill"))
    rows = events.where(F.col("kind") == "path").select("job_id", "page_num", "op_idx", F.explode(F.filter(both, lambda p: p["ink"].isNotNull())).alias("p"))
    return rows.select("job_id", "p.ink", "page_num", "op_idx", "p.overprinted")


def cutting_offences(paints: DataFrame) -> DataFrame:
    """(job_id, ink, page_num, op_idx, paints, never) of cutting inks painted without overprint: the first such path in drawing
    order, how many there are, and whether the ink is never overprinted.

    Page and number are one long (numbers are below 2^40), so the aggregate is a hash aggregate and needs no sort."""
    off = ~F.col("overprinted")
    first = F.min(F.when(off, F.shiftleft(F.col("page_num").cast("long"), 40) + F.col("op_idx")))
    per = paints.groupBy("job_id", "ink").agg(first.alias("first"), F.count_if(off).alias("paints"), (F.count_if(~off) == 0).alias("never"))
    page = F.shiftright("first", 40)
    return per.where("paints > 0").select("job_id", "ink", page.cast("int").alias("page_num"), (F.col("first") - F.shiftleft(page, 40)).alias("op_idx"), "paints", "never")


def cutting_not_overprinted(state: DataFrame) -> DataFrame:
    """First event of each job and cutting ink at which overprint, carried forward in drawing order, is off.

    ``state`` has (job_id, op_idx, ink, cutting, overprint); overprint is null where it isn't set and off before it is.
    """
    rows = carried(state, ["job_id"], ["op_idx"], ["overprint"])
    off = rows.where(F.col("cutting") & ~F.coalesce("overprint", F.lit(False)))
    return off.groupBy("job_id", "ink").agg(F.min("op_idx").alias("op_idx"), F.count("*").alias("events"))


def cut_below_art(paths: DataFrame, cutting: Column) -> DataFrame:
    """Pages whose cutting paths all lie below some artwork: (job_id, page_num, last_cut, last_art)."""
    per = paths.groupBy(*PAGE).agg(F.max(F.when(cutting, F.col("op_idx"))).alias("last_cut"), F.max(F.when(~cutting, F.col("op_idx"))).alias("last_art"))
    return per.where("last_cut < last_art")


def art_size(boxes: DataFrame) -> DataFrame:
    """Width and height in millimetres of what each job paints."""
    hull = boxes.groupBy("job_id").agg(*[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    return hull.select("job_id", F.round((F.col("x1") - F.col("x0")) / POINTS_PER_MM, 3).alias("width_mm"), F.round((F.col("y1") - F.col("y0")) / POINTS_PER_MM, 3).alias("height_mm"))


def against_hull(boxes: DataFrame, cutting: Column) -> DataFrame:
    """Each box inside, outside or across the hull of the job's cutting boxes; jobs without one are left out."""
    hull = boxes.where(cutting).groupBy("job_id").agg(F.min("x0").alias("hx0"), F.min("y0").alias("hy0"), F.max("x1").alias("hx1"), F.max("y1").alias("hy1"))
    inside = (F.col("x0") >= F.col("hx0")) & (F.col("y0") >= F.col("hy0")) & (F.col("x1") <= F.col("hx1")) & (F.col("y1") <= F.col("hy1"))
    apart = (F.col("x1") <= F.col("hx0")) | (F.col("x0") >= F.col("hx1")) | (F.col("y1") <= F.col("hy0")) | (F.col("y0") >= F.col("hy1"))
    where = F.when(inside, "inside").when(apart, "outside").otherwise("across")
    return boxes.where(~cutting).join(hull, "job_id").select("job_id", "page_num", "op_idx", where.alias("place"))


def transparent_overprints(state: DataFrame) -> DataFrame:
    """Pages that have both, transparency (alpha below one) and overprint, with the least alpha."""
    per = state.groupBy(*PAGE).agg(F.bool_or(F.col("alpha") < 0.9999).alias("clear"), F.bool_or("overprint").alias("over"), F.min("alpha").alias("least_alpha"))
    return per.where("clear AND over").select(*PAGE, "least_alpha")


def symbol_candidates(fills: DataFrame, least: int = 25, sides: tuple[float, float] = (0.5, 10.0)) -> DataFrame:
    """Pages with many small, nearly square fills: their number, region, mean side and its variation."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    small = fills.where(w.between(*sides) & h.between(*sides) & (w / h).between(0.5, 2.0)).withColumn("side", (w + h) / 2)
    per = small.groupBy(*PAGE).agg(F.count("*").alias("modules"), F.avg("side").alias("mean_side"), F.stddev_pop("side").alias("spread"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y1") - F.min("y0")).alias("height"))
    return per.where(F.col("modules") >= least).select(*PAGE, "modules", F.round("mean_side", 4).alias("side"), F.round(F.col("spread") / F.col("mean_side"), 4).alias("variation"), (F.col("width") / F.col("height")).alias("aspect"))


# Names of process inks (fixed values).
PROCESS = ("cyan", "magenta", "yellow", "black")


def plate_rules(inks: DataFrame, most: int = 6) -> DataFrame:
    """Plates per job: distinct inks, process inks, spots that are a second black, and the rules these break.

    ``inks`` has (job_id, ink). Names count in lower case, without spaces around them.
    """
    name = F.lower(F.trim("ink"))
    spot = ~name.isin(*PROCESS, "all", "none")
    per = inks.withColumn("name", name).groupBy("job_id").agg(
        F.count_distinct(F.when(~name.isin("all", "none"), name)).alias("plates"),
        F.count_distinct(F.when(name.isin(*PROCESS), name)).alias("process"),
        F.count_distinct(F.when(spot & name.contains("black"), name)).alias("black_spots"),
        F.bool_or(name == "all").alias("all_ink"),
    )
    return per.select(
        "job_id", "plates", "process",
        (F.col("plates") > most).alias("count_high"),
        ((F.col("process") > 0) & (F.col("plates") > F.col("process"))).alias("mixed"),
        (F.col("black_spots") > 0).alias("second_black"),
        "all_ink",
    )


# Names of process channels, of dielines and of finishing steps (fixed values).
CHANNELS = ("cyan", "magenta", "yellow", "black", "process_cyan", "process_magenta", "process_yellow", "process_black")
DIELINES = ("dieline", "die_line", "cutcontour", "cut_contour", "cut", "trim", "diecut", "die_cut")
STEPS = ("cutting", "perforating", "creasing", "crease", "kiss_cut", "kisscut", "score", "scoring", "foldline", "fold_line", "perfline", "perf_line", "embossing", "deboss", "debossing", "varnish", "varnishing", "spot_varnish", "stamping", "hot_stamping", "foil", "foiling")


def plate_findings(inks: DataFrame, used: DataFrame, most: int = 6) -> DataFrame:
    """(job_id, ink, inspection_id, severity): the plate inventory of a job's inks (job_id, ink, cs_type); ink is null for the job.

    ``used`` says of each job whether it uses CMYK and black (job_id, cmyk, black). Names count in lower case, with underscores for
    blanks and hyphens. Inks are made distinct and each job's are counted in one aggregate.
    """
    name = F.translate(F.lower(F.regexp_replace("ink", r"^[\s/]+|[\s/]+$", "")), "- ", "__")
    rows = inks.select("job_id", name.alias("ink"), (F.col("cs_type") == "DeviceN").alias("many")).where("ink <> ''").groupBy("job_id", "ink").agg(F.bool_or("many").alias("many"))
    channel, spot = F.col("ink").isin(*CHANNELS), ~F.col("ink").isin(*CHANNELS, "all", "none")
    die, step = F.col("ink").isin(*DIELINES), F.col("ink").isin(*STEPS)
    rows = rows.join(used, "job_id")
    any_black = F.col("cmyk") | F.col("black")
    words = F.split("ink", "_")
    each = {
        "COLOR_DUPLICATE_K_SPOT": ("advisory", any_black & spot & F.array_contains(words, "black") & (F.size(words) > 1)),
        "COLOR_ALL_SEPARATION": ("warning", F.col("ink") == "all"),
        "COLOR_DEVICEN_CMYK_NAMED": ("warning", F.col("many") & channel),
    }
    per = rows.groupBy("job_id", "cmyk", "black").agg(F.count_if(spot & ~die & ~step).alias("spots"), F.count_if(die).alias("dies"), F.count_if(step).alias("steps"))
    process = F.when(F.col("cmyk"), 4).when(F.col("black"), 1).otherwise(0)
    whole = {
        "COLOR_PLATE_COUNT_HIGH": ("advisory", process + F.col("spots") > most),
        "COLOR_DIELINE_PRINTABLE": ("advisory", (F.col("dies") > 0) & (F.col("steps") == 0)),
        "COLOR_MIXED_SPOT_PROCESS": ("advisory", F.col("cmyk") & F.col("spots").between(1, 2)),
    }
    return fused(rows, each, "job_id", "ink").unionByName(fused(per, whole, "job_id").select("job_id", F.lit(None).cast("string").alias("ink"), "inspection_id", "severity"))


def page_size_rules(pages: DataFrame) -> DataFrame:
    """Jobs whose trim boxes differ in orientation or in size, rounded to whole points; turned pages are swapped."""
    w, h = F.col("tx1") - F.col("tx0"), F.col("ty1") - F.col("ty0")
    turned = F.col("rotate") % 180 != 0
    size = F.struct(F.round(F.when(turned, h).otherwise(w)).alias("w"), F.round(F.when(turned, w).otherwise(h)).alias("h"))
    rows = pages.where("tx0 IS NOT NULL").select("job_id", size.alias("s"))
    per = rows.groupBy("job_id").agg(F.count_distinct("s").alias("sizes"), F.bool_or(F.col("s.w") > F.col("s.h")).alias("wide"), F.bool_or(F.col("s.w") < F.col("s.h")).alias("tall"))
    return per.select("job_id", "sizes", (F.col("wide") & F.col("tall")).alias("mixed_orientation"))


def heading_skips(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the one before: (job_id, seq, previous, level)."""
    before = F.lag("level").over(W.partitionBy("job_id").orderBy("seq"))
    return headings.withColumn("previous", before).where("level > previous + 1").select("job_id", "seq", "previous", "level")


def first_resource(resources: DataFrame, hit: Column) -> DataFrame:
    """The first resource of each job that holds ``hit``, by page and name."""
    return first_per(resources.where(hit), ["job_id"], ["page_num", "name"]).select("job_id", "page_num", "name")
