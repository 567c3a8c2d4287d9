"""Control charts over time series (series, ts, seq, value), ordered by (ts, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def limits(points: DataFrame) -> DataFrame:
    """Mean, sample deviation and the 1, 2 and 3 sigma limits per series; flat limits below two points."""
    per = points.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sigma"))
    bounds = {f"{side}{k}": F.col("mean") + sign * k * F.col("sigma") for side, sign in (("up", 1), ("low", -1)) for k in (1, 2, 3)}
    return per.withColumns(bounds)


def control_alerts(points: DataFrame) -> DataFrame:
    """Alerts (series, rule, side, seq) by the four control rules; a run is labelled by its first point.

    Rule 1: a point beyond three sigma. Rule 2: two of three beyond two sigma. Rule 3: four of five beyond one sigma.
    Rule 4: eight in a row on one side of the mean. The sums by series are aggregated before they are joined; the runs
    need a series in order.
    """
    rows = points.join(limits(points), "series")
    order = W.partitionBy("series").orderBy("ts", "seq")
    rules = [(2, 3, 2, "2"), (3, 5, 4, "1"), (4, 8, 8, "")]
    flags = []
    for rule, length, least, k in rules:
        frame = order.rowsBetween(0, length - 1)
        whole = F.count("*").over(frame) == length
        for side in ("up", "low"):
            bound = F.col(f"{side}{k}") if k else F.col("mean")
            beyond = (F.col("value") > bound) if side == "up" else (F.col("value") < bound)
            flags.append(F.when(whole & (F.sum(beyond.cast("int")).over(frame) >= least), F.struct(F.lit(rule).alias("rule"), F.lit(side).alias("side"))))
    for side in ("up", "low"):
        beyond = (F.col("value") > F.col("up3")) if side == "up" else (F.col("value") < F.col("low3"))
        flags.append(F.when(beyond, F.struct(F.lit(1).alias("rule"), F.lit(side).alias("side"))))
    hits = rows.select("series", "seq", F.array(*flags).alias("hits")).select("series", "seq", F.explode(F.filter("hits", lambda h: h.isNotNull())).alias("hit"))
    return hits.select("series", F.col("hit.rule").alias("rule"), F.col("hit.side").alias("side"), "seq")


def trend(points: DataFrame, least: int = 20) -> DataFrame:
    """Per series of ``least`` points or more: points that break each control rule by the end of its window, and the lower limit from 0.

    beyond: outside three sigma; pairs: two of three beyond two sigma on one side; fours: four of five beyond one; runs: eight on one
    side of the mean. Windows at the start are as long as there are points. Points may have ``passed``: pass_rate is its share, else null.
    """
    rows = points.join(limits(points).where(F.col("n") >= least), "series")
    if "passed" not in points.columns:
        rows = rows.withColumn("passed", F.lit(None).cast("boolean"))

    def broken(length: int, enough: int, k: float) -> Column:
        window = W.partitionBy("series").orderBy("ts", "seq").rowsBetween(1 - length, 0)
        sides = (F.col("value") > F.col("mean") + k * F.col("sigma"), F.col("value") < F.col("mean") - k * F.col("sigma"))
        return F.greatest(*[F.sum(s.cast("int")).over(window) for s in sides]) >= enough

    rules = {"beyond": (1, 1, 3.0), "pairs": (3, 2, 2.0), "fours": (5, 4, 1.0), "runs": (8, 8, 0.0)}
    marked = rows.withColumns({name: broken(*rule).cast("long") for name, rule in rules.items()})
    per = marked.groupBy("series").agg(F.max("n").alias("points"), *[F.sum(name).alias(name) for name in rules], F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"), F.max("mean").alias("mean"), F.max("low3").alias("low3"))
    return per.select("series", "points", *rules, "pass_rate", F.round("mean", 6).alias("mean"), F.round(F.greatest("low3", F.lit(0.0)), 6).alias("lower"))


def outage(outcomes: DataFrame, last: int = 20, failures: int = 11) -> DataFrame:
    """Outcomes (series, ts, seq, success) after which at least ``failures`` of the last ``last`` of the series failed."""
    frame = W.partitionBy("series").orderBy("ts", "seq").rowsBetween(-(last - 1), 0)
    flag = (F.count("*").over(frame) == last) & (F.sum((~F.col("success")).cast("int")).over(frame) >= failures)
    return outcomes.withColumn("out", flag).where("out").select("series", "seq")


def carried(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """State that null leaves unchanged, carried forward within the keys."""
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """For each left row the value of the last right row of its key at or before its time, without a range join."""
    both = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(dict(right.dtypes)[value])}).unionByName(right.select(key, time, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    frame = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(frame)).where("_side = 1").drop("_side")
