"""Which settings, rulesets and brand specifications hold for a tenant or a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.dealing import ROWS, dealt, tasks_for

#: Plans from the least to the greatest.
PLANS = ("free", "starter", "pro", "enterprise")


def plan_rank(plan: Column, plans: tuple[str, ...] = PLANS) -> Column:
    """Place of a plan, from 1; null for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, plans)), plan)
    return F.when(at > 0, at)


def visible_rulesets(tenants: DataFrame, rulesets: DataFrame) -> DataFrame:
    """(tenant_id, ruleset_id) by the ruleset's mode: all, plan (at least min_plan), list (allowed tenants), both.

    Unknown modes, plans and missing lists hide a ruleset. Each mode is a join of its own: lists by tenant, plans by rank,
    so that the only product is the answer itself. Rulesets are few beside tenants and are not broadcast by hand. The answer is dealt
    by tenant, a few thousand of them to a task. ``tenants`` is counted.
    """
    t = tenants.select("tenant_id", plan_rank(F.col("plan")).alias("rank"))
    r = rulesets.select("ruleset_id", "mode", plan_rank(F.col("min_plan")).alias("least"), "allowed")
    listed = r.where(F.col("mode").isin("list", "both")).select("ruleset_id", "mode", "least", F.explode("allowed").alias("tenant_id"))
    by_list = t.join(listed, "tenant_id").where((F.col("mode") == "list") | (F.col("rank") >= F.col("least")))
    ranks = r.where(F.col("mode").isin("all", "plan")).select("ruleset_id", F.explode(F.sequence(F.when(F.col("mode") == "all", F.lit(0)).otherwise(F.col("least").cast("int")), F.lit(len(PLANS)))).alias("rank"))
    by_plan = t.withColumn("rank", F.coalesce("rank", F.lit(0)).cast("int")).join(ranks, "rank")
    return dealt(by_list.select("tenant_id", "ruleset_id").union(by_plan.select("tenant_id", "ruleset_id")), tasks_for(tenants, ROWS // 16), "tenant_id").distinct()


def chosen_ruleset(jobs: DataFrame, visible: DataFrame, default: str) -> DataFrame:
    """Per job the requested ruleset if its tenant sees it, else the tenant's default if visible, else ``default``."""

    def seen(column: str) -> DataFrame:
        return visible.select("tenant_id", F.col("ruleset_id").alias(column), F.lit(True).alias(f"{column}_seen"))

    rows = jobs.join(seen("requested"), ["tenant_id", "requested"], "left").join(seen("preferred"), ["tenant_id", "preferred"], "left")
    pick = F.when(F.col("requested_seen"), F.col("requested")).when(F.col("preferred_seen"), F.col("preferred")).otherwise(default)
    return rows.select("job_id", pick.alias("ruleset_id"))


def chosen_spec(jobs: DataFrame, specs: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """Per job the first of ``levels`` (columns) that names a known specification that isn't archived; else null."""
    known = specs.where("NOT archived").select("spec_id").distinct()
    for level in levels:
        jobs = jobs.join(known.select(F.col("spec_id").alias(f"_{level}")), F.col(level) == F.col(f"_{level}"), "left")
    return jobs.select("job_id", F.coalesce(*[F.col(f"_{x}") for x in levels]).alias("spec_id"))


def entitlements(tenants: DataFrame, plans: DataFrame) -> DataFrame:
    """Limit and features per tenant: its override, else its own column if that differs from the plan's, else the plan's override, else the default.

    Features of plan and tenant are united. Tenants of an unknown plan keep their own values.
    """
    rows = tenants.join(plans, "plan", "left")
    given = F.coalesce("plan_override", "plan_limit")
    own = F.when(~F.col("tenant_limit").eqNullSafe(F.col("plan_limit")), F.col("tenant_limit"))
    both = F.array_union(F.coalesce("plan_features", F.array().cast("array<string>")), F.coalesce("tenant_features", F.array().cast("array<string>")))
    return rows.select("tenant_id", F.coalesce("tenant_override", own, given).alias("limit"), F.array_join(F.array_sort(both), ",").alias("features"))


def formats_outside_plan(requests: DataFrame, requested: str, allowed: str) -> DataFrame:
    """Requests for report formats that the plan hasn't, with those formats, sorted and joined by commas."""
    extra = F.array_sort(F.array_except(requested, allowed))
    return requests.withColumn("extra", F.array_join(extra, ",")).where(F.size(extra) > 0)


#: How a layer changes what the layers before it gave: as a whole, by adding items in order, or key by key.
STRATEGIES = ("replace", "union", "merge")
LAYER = "struct<name:string,items:array<string>,entries:map<string,string>,locked:boolean>"


def folded_settings(settings: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, items, entries, source): layers of a setting, from the default on, folded by its strategy; a lock ends the fold.

    ``settings`` has the keys, strategy and ``layers``, an array of LAYER in order: a layer that is not set has null items and entries.
    ``items`` are the value of strategies replace and union, ``entries`` that of merge. A locked layer's own value stands, as it is,
    and later layers are not read. ``source`` names the layer of each item or key: of several that give it, the first that did for
    union, the last for merge. An unknown strategy counts as replace.
    """
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    union, merge = F.col("strategy") == "union", F.col("strategy") == "merge"
    start = F.struct(none.alias("items"), empty.alias("entries"), empty.alias("source"), F.lit(False).alias("ended"))

    def named(names: Column, layer: Column) -> Column:
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), layer.alias("value"))))

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)

    def step(acc: Column, layer: Column) -> Column:
        given = layer["items"].isNotNull() | layer["entries"].isNotNull()
        items, entries = F.array_distinct(F.coalesce(layer["items"], none)), F.coalesce(layer["entries"], empty)
        own = named(F.when(merge, F.map_keys(entries)).otherwise(items), layer["name"])
        alone = F.struct(items.alias("items"), F.when(merge, entries).otherwise(empty).alias("entries"), own.alias("source"), F.coalesce(layer["locked"], F.lit(False)).alias("ended"))
        joined = F.struct(
            F.when(union, F.array_distinct(F.concat(acc["items"], items))).otherwise(acc["items"]).alias("items"), F.when(merge, over(acc["entries"], entries)).otherwise(acc["entries"]).alias("entries"),
            F.when(union, over(own, acc["source"])).otherwise(over(acc["source"], own)).alias("source"), F.lit(False).alias("ended"),
        )
        return F.when(acc["ended"] | ~given, acc).when(F.coalesce(layer["locked"], F.lit(False)) | ~(union | merge), alone).otherwise(joined)

    return settings.select(*keys, F.aggregate("layers", start, step).alias("f")).select(*keys, "f.items", "f.entries", "f.source")
