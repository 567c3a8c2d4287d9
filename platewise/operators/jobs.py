"""Jobs, decisions, settings, versions and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.functions.text import glob


def batch_rollup(jobs: DataFrame, batch: str) -> DataFrame:
    """Per batch its jobs by status; processing if any is, else complete, failed or partial."""
    n = {s: F.count_if(F.col("status") == s) for s in ("complete", "failed", "processing")}
    status = F.when(n["processing"] > 0, "processing").when(n["failed"] == 0, "complete").when(n["complete"] == 0, "failed").otherwise("partial")
    return jobs.groupBy(batch).agg(F.count("*").alias("jobs"), *[v.alias(k) for k, v in n.items()], status.alias("status"))


def quality_history(jobs: DataFrame, findings: DataFrame, newest: int = 10) -> DataFrame:
    """The newest jobs of each tenant with their finding counts."""
    per = findings.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rank = F.row_number().over(W.partitionBy("tenant_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc()))
    rows = jobs.select("tenant_id", "job_id", "created_at").withColumn("place", rank).where(F.col("place") <= newest).join(per, "job_id", "left")
    return rows.select("tenant_id", "job_id", "place", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "errors", "warnings")])


def usage_cost(usage: DataFrame, *keys: str) -> DataFrame:
    """Cents per key: whole thousandths of a cent rounded up, one cent at least."""
    return usage.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum("milli_cents") / 1000)).cast("long").alias("cents"))


def month_to_date(spend: DataFrame, key: str, cap: int, alert_percent: int = 80) -> DataFrame:
    """Spend (key, ts, cents) per month with what is left of the cap, and whether it is over the alert or the cap."""
    per = spend.groupBy(key, F.date_trunc("month", "ts").alias("month")).agg(F.sum("cents").alias("spent"))
    return per.withColumns({"remaining": F.greatest(F.lit(0).cast("long"), cap - F.col("spent")), "alert": F.col("spent") * 100 >= cap * alert_percent, "over": F.col("spent") >= cap})


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The newest decision of each finding that is not revoked."""
    active = decisions.where("revoked_at IS NULL")
    return active.groupBy("finding_id").agg(F.max_by(F.struct("decision_id", "decision_type"), F.struct("decided_at", "decision_id")).alias("d")).select("finding_id", "d.*")


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.where("revoked_at IS NULL").groupBy("decision_type").agg(F.count("*").alias("n"))


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page of a sorted list; the size is clamped to 1 to 100, pages count from 1."""
    size = max(1, min(100, size))
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def duration_distribution(jobs: DataFrame, edges: list[float]) -> DataFrame:
    """Jobs per status and duration bucket; bucket k holds durations from edge k - 1 up to edge k."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("duration_ms") >= e, 1).otherwise(0)
    return jobs.groupBy("status", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 2).alias("total_ms"))


#: Size of a quantile sketch; its rank error is about 1.65 % at this size, with 99 % confidence.
SKETCH_SIZE, RANK_ERROR = 200, 0.0165


def stage_sketches(jobs: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(stage, day, n, sketch): the durations of each stage and day as a mergeable quantile sketch.

    ``jobs`` has a timestamp ts and stages, a map of stage to milliseconds. The table of sketches is what is kept: days are
    rolled up from it, and jobs are not read again.
    """
    rows = jobs.select(F.to_date("ts").alias("day"), F.explode("stages").alias("stage", "ms")).where(F.col("ms").isNotNull())
    return rows.groupBy("stage", "day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("ms").cast("double"), F.lit(size)).alias("sketch"))


def stage_percentiles(sketches: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(*keys, n, p50, p90, p99): quantiles of rolled-up sketches, for any keys that the sketches have."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(p * 100)}") for p in shares])


def cascade(toggles: DataFrame) -> DataFrame:
    """Setting per tenant: default, then tenant, then workflow; a locked tenant value ends the chain. With provenance."""
    workflow = F.col("workflow_value").isNotNull() & ~(F.col("locked") & F.col("tenant_value").isNotNull())
    value = F.when(workflow, F.col("workflow_value")).otherwise(F.coalesce("tenant_value", "default_value"))
    source = F.when(workflow, "workflow").when(F.col("tenant_value").isNotNull(), "tenant").otherwise("default")
    return toggles.select("tenant_id", value.alias("value"), source.alias("provenance"))


def compare_versions(one: DataFrame, two: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two versions' pages: added, removed, or the number of values that differ."""
    left = one.select(*keys, F.struct(*values).alias("one"))
    right = two.select(*keys, F.struct(*values).alias("two"))
    both = left.join(right, keys, "full")
    differ = sum((F.when(F.col(f"one.{v}").eqNullSafe(F.col(f"two.{v}")), 0).otherwise(1) for v in values), F.lit(0))
    state = F.when(F.col("one").isNull(), "added").when(F.col("two").isNull(), "removed").when(differ > 0, "changed").otherwise("same")
    return both.select(*keys, state.alias("state"), F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), differ).otherwise(0).alias("differences"))


def similarity(compared: DataFrame, *keys: str) -> DataFrame:
    """Per pair max(0, 1 - differences / 100), a page that is added or removed counting as one."""
    n = F.sum(F.col("differences") + F.when(F.col("state").isin("added", "removed"), 1).otherwise(0))
    return compared.groupBy(*keys).agg(n.alias("differences"), F.greatest(F.lit(0.0), 1 - n / 100).alias("similarity"))


def retained(deliveries: DataFrame, rules: list[tuple[str, int | None]], now) -> DataFrame:
    """Deliveries that stay: the longest event pattern that fits sets the days; None keeps for ever; no pattern keeps.

    Ages are counted between whole seconds of the clock, so a delivery in the second before the limit is past it.
    """
    days = F.lit(None).cast("int")
    for pattern, keep in sorted(rules, key=lambda r: len(r[0])):
        days = F.when(glob(F.col("event"), pattern), F.lit(keep).cast("int")).otherwise(days)
    age = F.timestamp_diff("SECOND", F.date_trunc("second", F.col("created_at")), F.date_trunc("second", now))
    return deliveries.where(days.isNull() | (age <= days * 86400))


def delivery_outcomes(attempts: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Per delivery its attempts, whether one succeeded, and whether it is dead: ``most`` attempts and no success."""
    ok = F.coalesce(F.bool_or("success"), F.lit(False))
    return attempts.groupBy(key).agg(F.count("*").alias("attempts"), ok.alias("delivered"), (~ok & (F.count("*") >= most)).alias("dead"))


def job_states(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per job with its findings in order, as id:severity."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "inspection_id", "severity"))), lambda s: F.concat(s["inspection_id"], F.lit(":"), s["severity"]))
    per = findings.groupBy("job_id").agg(F.array_join(listed, ",").alias("findings"))
    return jobs.select("job_id", "tenant_id", "status").join(per, "job_id", "left").withColumn("findings", F.coalesce("findings", F.lit("")))


def compare_names(one: DataFrame, two: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(*keys, added, removed): names (fonts, colour spaces, info keys) that one version of a document's part has and the other has not.

    Distinct names are compared by a full outer join, so no set is gathered but what differs; both are sorted, joined by commas.
    """
    left, right = (rows.select(*keys, name).where(F.col(name).isNotNull()).distinct().withColumn(side, F.lit(True)) for rows, side in ((one, "one"), (two, "two")))
    both = left.join(right, [*keys, name], "full").where(F.col("one").isNull() | F.col("two").isNull())
    listed = lambda missing: F.array_join(F.sort_array(F.collect_list(F.when(F.col(missing).isNull(), F.col(name)))), ",")
    return both.groupBy(*keys).agg(listed("one").alias("added"), listed("two").alias("removed"))
