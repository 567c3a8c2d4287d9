"""Mixing sources to target weights: each document is taken floor(rate) times plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.llm.common import cut, join_groups, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"

#: Sources up to this many are joined by broadcast; of more only those with very many documents.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, documents, target, rate) per source of ``sizes`` (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn. They share ``share`` of all sizes by weight; no
    target exceeds ``most`` times its source's size, and the excess is shared anew by weight among the others until none
    is above. That is the level L with sum(least(L * weight, most * size)) = share * total: sources are capped in order of
    size / weight, and L follows from the capped sizes before and the weights after. Empty sources have target and rate 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("weight", weight)
    order = W.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    per = per.withColumns({"capped": F.sum("source_size").over(upto), "heavy": F.sum("weight").over(upto), "whole": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    # the level if all up to and with this source are capped; it is right at the first source that is not above its cap
    level = (F.lit(share) * F.col("whole") - F.lit(float(most)) * (F.col("capped") - F.col("source_size"))) / (F.col("weights") - F.col("heavy") + F.col("weight"))
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * float(most))
    per = per.withColumn("level", F.min(F.when(F.col("free"), F.struct("heavy", "level"))).over(every)["level"])
    cap = F.col("source_size") * F.lit(float(most))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), cap), cap)
    return per.select("source", "source_size", "documents", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def source_key(source: Column) -> Column:
    """A source's key for joins; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def with_plan(rows: DataFrame, plan: DataFrame, source: Column, documents: str = "documents") -> DataFrame:
    """Each row with what ``plan`` has for its source; no source, however large, is gathered in a task."""
    keyed, keys = rows.withColumn("_platewise_source_key", source_key(source)), plan.withColumn("_platewise_source_key", source_key(F.col("source"))).drop("source")
    if keys.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return keyed.join(F.broadcast(keys), "_platewise_source_key")
    return join_groups(keyed, keys, "_platewise_source_key", documents)


def copies_of(ident: Column, rate: Column, seed: str) -> Column:
    """floor(rate) and one more if a hash of seed and identifier falls below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: (id_col, source, size, source_size, target, copies, taken).

    Size is the number of words, 0 for null. The extra copy is drawn from a hash of the seed and the identifier, so
    reruns agree; rows that repeat an identifier draw alike. A null source is a source of its own; a null identifier
    draws as the empty string. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("ident"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    joined = with_plan(rows, cut(targets(rows)), F.col("source")).withColumn("copies", copies_of(F.col("ident"), F.col("rate"), seed))
    return joined.select(F.col("ident").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each repeated as often as it is taken."""
    plan = cut(targets(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))).select("source", F.col("documents").alias("_platewise_documents"), F.col("rate").alias("_platewise_rate"))
    joined = with_plan(docs, plan, F.col(source_col), "_platewise_documents")
    return joined.withColumn("_platewise_copy", F.explode(F.array_repeat(F.lit(1), copies_of(F.col(id_col), F.col("_platewise_rate"), seed)))).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, sum(source_size) OVER o AS capped, sum(weight) OVER o AS heavy, sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights FROM w
  WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, (1.5::DOUBLE * whole::DOUBLE - 2.0::DOUBLE * (capped - source_size)::DOUBLE) / (weights - heavy + weight) AS level FROM c),
f AS (SELECT *, (SELECT level FROM l WHERE level * weight <= source_size * 2.0::DOUBLE ORDER BY source_size / weight, source ASC NULLS LAST LIMIT 1) AS at_level FROM l),
t AS (SELECT source, source_size, least(coalesce(at_level * weight, source_size * 2.0::DOUBLE), source_size * 2.0::DOUBLE) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
