"""Registered queries that run as streams over the given tables, up to their watermark, with the SQL of their batch meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.plans.registry import query
from platewise.plans.views import oracle, table
from platewise.sources.shared import shared_path
from platewise.streaming import timers as T


def _streamed(spark: SparkSession, sf_dir: str, name: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``plan`` makes of a table that is read as a stream, all of it, then the rows that the last watermark lets go."""
    path = shared_path(spark, "stream")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    T.with_rocksdb(spark)
    try:
        # a pattern that fits the one name: a table may be a file or a folder
        rows = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")
        plan(rows).writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out", format="parquet", outputMode="append").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{path}/out")


def _outcomes(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("user_id") % 8).alias("series"), "ts", F.col("event_id").alias("seq"), (F.col("value") < 40).alias("success"))


PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query(
    oracle(
        "",
        f"""SELECT series, CAST(happened AS TIMESTAMP) AS happened, event FROM (SELECT series, ts AS happened, 'raised' AS event FROM p WHERE bad AND NOT was_up UNION ALL SELECT series, ts, 'cleared' FROM p WHERE NOT bad AND was_up
  UNION ALL SELECT series, ts + INTERVAL 300 SECOND, 'expired' FROM p WHERE bad AND (later IS NULL OR later >= ts + INTERVAL 300 SECOND)) WHERE happened <= {PASSED}""",
        "o AS (SELECT user_id % 8 AS series, date_trunc('millisecond', ts) AS ts, event_id AS seq, value < 40 AS success FROM events)",
        "b AS (SELECT *, count(*) OVER w = 20 AND sum((NOT success)::INT) OVER w >= 11 AS bad FROM o WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
        "p AS (SELECT *, coalesce(lag(bad) OVER v AND ts < lag(ts) OVER v + INTERVAL 300 SECOND, false) AS was_up, lead(ts) OVER v AS later FROM b WINDOW v AS (PARTITION BY series ORDER BY ts, seq))",
    )
)
def x3_u3_outage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "events", lambda rows: T.outage_events(_outcomes(rows)))


STATUS = "CASE event_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' ELSE 'processing' END"


@query(
    oracle(
        "",
        f"""SELECT series, start + INTERVAL 12 MINUTE AS happened FROM (SELECT series, min(ts) FILTER (WHERE status = 'processing') AS start, min({{'t': ts, 's': seq}}) FILTER (WHERE status = 'processing') AS one, min({{'t': ts, 's': seq}}) FILTER (WHERE status <> 'processing') AS two FROM s GROUP BY series)
  WHERE start IS NOT NULL AND (two IS NULL OR (two > one AND two.t >= start + INTERVAL 12 MINUTE)) AND start + INTERVAL 12 MINUTE <= {PASSED}""",
        f"s AS (SELECT user_id * 10 + event_id % 9 AS series, date_trunc('millisecond', ts) AS ts, event_id AS seq, {STATUS} AS status FROM events)",
    )
)
def x4_u3_stuck_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "events", lambda rows: T.stuck_events(rows.select((F.col("user_id") * 10 + F.col("event_id") % 9).alias("series"), "ts", F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"))))


@query(
    oracle(
        "",
        f"""SELECT series, start + INTERVAL 7 DAY AS happened FROM (SELECT series, min(ts) FILTER (WHERE status = 'issued') AS start, min({{'t': ts, 's': seq}}) FILTER (WHERE status = 'issued') AS one, min({{'t': ts, 's': seq}}) FILTER (WHERE status = 'revoked') AS two FROM s GROUP BY series)
  WHERE start IS NOT NULL AND (two IS NULL OR (two > one AND two.t >= start + INTERVAL 7 DAY)) AND start + INTERVAL 7 DAY <= {PASSED}""",
        "s AS (SELECT user_id * 100 + event_id % 23 AS series, date_trunc('millisecond', ts) AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'revoked' ELSE 'issued' END AS status FROM events WHERE event_type IN ('signup', 'error'))",
    )
)
def x7_u3_token_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plan(rows: DataFrame) -> DataFrame:
        some = rows.where("event_type IN ('signup', 'error')")
        return T.expired_tokens(some.select((F.col("user_id") * 100 + F.col("event_id") % 23).alias("series"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "revoked").otherwise("issued").alias("status")), 7 * 24 * 60)

    return _streamed(spark, sf_dir, "events", plan)
