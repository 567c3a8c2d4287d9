"""Joins of boxes that meet or lie near, by a hierarchical grid of cells: no comparison of all boxes of a page with all.

A box belongs to the level whose cells are as wide as its longer side, CELL times a power of two, so it touches at most four of
them. It is looked up at its own level and at all coarser ones that occur. Two boxes are compared at the coarser of their
two levels, where one of them is at home, and only in the cell that holds the lower corner of what they share, so each pair comes
once. Cells are part of the join key: a sheet with a third of all boxes is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 72.0
SIDES = ["x0", "y0", "x1", "y1"]
#: Sizes of boxes go up to CELL times 2^MOST_LEVEL; what is larger counts as that level and touches more cells.
MOST_LEVEL = 40


def _placed(boxes: DataFrame, pad: float, cell: float) -> DataFrame:
    """Boxes with a level and padded sides _x0 to _y1; those with null, non-finite or reversed sides meet nothing."""
    good = F.lit(True)
    for s in SIDES:
        good &= F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < 1e15)
    rows = boxes.where(good & (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0")))
    rows = rows.withColumns({"_x0": F.col("x0") - pad, "_y0": F.col("y0") - pad, "_x1": F.col("x1") + pad, "_y1": F.col("y1") + pad})
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    level = F.ceil(F.log2(F.greatest(side / cell, F.lit(1.0))) - 1e-9)
    return rows.withColumn("_level", F.least(level, F.lit(MOST_LEVEL)).cast("int"))


def _in_cells(rows: DataFrame, levels: Column, cell: float) -> DataFrame:
    """A row for each level and each cell there that the padded box touches."""
    rows = rows.withColumn("_at", F.explode(levels))
    width = F.pow(F.lit(2.0), F.col("_at")) * cell
    span = lambda low, high: F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    return rows.withColumn("_cx", F.explode(span("_x0", "_x1"))).withColumn("_cy", F.explode(span("_y0", "_y1")))


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], within: float = 0.0, cell: float = CELL) -> DataFrame:
    """Pairs of boxes of ``left`` and ``right`` with equal ``keys`` that meet, or lie no farther apart than ``within`` on either axis.

    Both have keys and x0, y0, x1, y1; the result has the keys, all other columns of ``left``, and those of ``right`` with an
    ``o`` before their names. Boxes that only touch are a pair.
    """
    one, two = _placed(left, within, cell), _placed(right.select(*keys, *[F.col(c).alias(f"o{c}") for c in right.columns if c not in keys], *SIDES), 0.0, cell)
    two = two.drop(*SIDES)
    used = sorted(r[0] for r in one.select("_level").union(two.select("_level")).distinct().limit(MOST_LEVEL + 1).collect())
    all_levels = F.array(*map(F.lit, used)) if used else F.array().cast("array<int>")
    own, coarser = F.array("_level"), F.filter(all_levels, lambda n: n > F.col("_level"))
    inner = [*keys, "_at", "_cx", "_cy"]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*keys, "_at", "_cx", "_cy", *[c for c in b.columns if c.startswith("o")], *[F.col(f"_{s}").alias(f"_o{s}") for s in SIDES])
        low = [F.greatest(f"_{s}", f"_o{s}") for s in ("x0", "y0")]
        high = [F.least(f"_{s}", f"_o{s}") for s in ("x1", "y1")]
        width = F.pow(F.lit(2.0), F.col("_at")) * cell
        here = (F.floor(low[0] / width) == F.col("_cx")) & (F.floor(low[1] / width) == F.col("_cy"))
        pairs = a.join(b, inner).where((low[0] <= high[0]) & (low[1] <= high[1]) & here)
        return pairs.select(*left.columns, *[f"o{c}" for c in right.columns if c not in keys])

    at_home, above = [_in_cells(x, own, cell) for x in (one, two)], [_in_cells(x, coarser, cell) for x in (one, two)]
    return met(at_home[0], at_home[1]).unionByName(met(above[0], at_home[1])).unionByName(met(at_home[0], above[1]))


def gap(prefix: str = "o") -> Column:
    """Distance between the boxes of a pair, 0 where they meet."""
    dx = F.greatest(F.lit(0.0), F.greatest("x0", f"{prefix}x0") - F.least("x1", f"{prefix}x1"))
    dy = F.greatest(F.lit(0.0), F.greatest("y0", f"{prefix}y0") - F.least("y1", f"{prefix}y1"))
    return F.sqrt(dx * dx + dy * dy)
