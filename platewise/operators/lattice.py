"""Nearest reference colours by a lattice in Lab space, exact by ring expansion, and how far spot inks lie from a gamut.

A level of the lattice has cells twice as wide as the one before. A colour is compared with the references in its own cell and
the 26 around it; a reference elsewhere is farther away than a cell is wide, so a distance within that is the least one. Colours
that find none so near go on to the next level, and only they: the ring grows with the distance, and no colour meets all references.
References of one place are one, the first by name, so that a colour meets places and not names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.dealing import dealt, tasks_for

LAB = ["l", "a", "b"]
#: Width of a cell at the first level, and levels at most: beyond them a cell is wider than any Lab space.
CELL, LEVELS = 4.0, 40
#: Most colours (a few hundred bytes each) that are broadcast to the inks.
BROADCAST_COLORS = 100_000


def _cell(width: float) -> list[Column]:
    return [F.floor(F.col(c) / width).alias(f"_{c}") for c in LAB]


def nearest_colors(colors: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, name, distance): for each distinct ``key`` of ``colors`` (key, l, a, b) the reference (name, l, a, b) of least CIE76 distance.

    Ties go to the first name. Colours with a null or non-finite component, and all if there are no references, are left out.
    """
    fine = F.lit(True)
    for c in LAB:
        fine &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    left = colors.where(fine).groupBy(key).agg(*[F.first(F.col(c).cast("double")).alias(c) for c in LAB]).checkpoint()
    known = references.where(fine).groupBy(*[F.col(c).cast("double").alias(f"o{c}") for c in LAB]).agg(F.min("name").alias("name")).checkpoint()
    found = left.limit(0).select(key, F.lit("").alias("name"), F.lit(0.0).alias("distance"))
    if not known.limit(1).count():
        return found
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    for level in range(LEVELS):
        if not left.limit(1).count():
            break
        width = CELL * 2.0**level
        cells = known.select("*", *[F.floor(F.col(f"o{c}") / width).alias(f"_{c}") for c in LAB])
        asked = left.select("*", *_cell(width))
        for c in LAB:
            asked = asked.withColumn("_d", F.explode(around)).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_d")).drop("_d")
        distance = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in LAB), F.lit(0.0)))
        near = asked.join(cells, [f"_{c}" for c in LAB]).groupBy(key).agg(F.min(F.struct(distance.alias("distance"), "name")).alias("n"))
        settled = near.where(F.col("n.distance") <= width).select(key, "n.name", "n.distance").checkpoint()
        found = found.unionByName(settled)
        left = left.join(settled.select(key), key, "left_anti").checkpoint()
    return found


def spot_reach(inks: DataFrame, gamut: DataFrame, within: float = 3.0, marginal: float = 6.0) -> DataFrame:
    """(job_id, ink, status, severity, name, distance): ECG_002 of each spot ink (job_id, ink, l, a, b): achievable, marginal or out of reach.

    Inks without a Lab colour are unmapped. Distinct colours are compared, not inks. ``inks`` is counted and read twice.
    """
    tone = F.when(F.col("l").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat_ws("/", "l", "a", "b"))
    near = nearest_colors(inks.select(*LAB, tone.alias("tone")).where("tone IS NOT NULL").distinct(), gamut, "tone")
    few = near.limit(BROADCAST_COLORS + 1).count() <= BROADCAST_COLORS
    rows = inks.select("job_id", "ink", tone.alias("tone")).join(F.broadcast(near) if few else near, "tone", "left")
    d = F.col("distance")
    status = F.when(d.isNull(), "unmapped").when(d < within, "achievable").when(d < marginal, "marginal").otherwise("not_achievable")
    told = rows.select("job_id", "ink", status.alias("status"), F.when(d >= marginal, "warning").otherwise("advisory").alias("severity"), "name", F.round("distance", 6).alias("distance"))
    return dealt(told, tasks_for(inks), "job_id", "ink").distinct()


def reach_totals(reach: DataFrame) -> DataFrame:
    """(job_id, inks, outside, share, severity): GAMUT_003, how many of a job's inks are out of reach."""
    per = reach.groupBy("job_id").agg(F.count("*").alias("inks"), F.count_if(F.col("status") == "not_achievable").alias("outside"))
    share = F.col("outside") / F.col("inks")
    return per.select("job_id", "inks", "outside", F.round(share, 6).alias("share"), F.when(F.col("outside") > 0, "warning").otherwise("advisory").alias("severity"))
