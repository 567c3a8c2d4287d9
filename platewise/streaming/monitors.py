"""Rate and session monitors, newest events and continuous checking as Structured Streaming plans; rates work on a batch table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def requests_per_window(requests: DataFrame, key: str, ts: str, width: str, ceiling: int, late: str = "10 minutes") -> DataFrame:
    """Requests per key and tumbling window, and whether they exceed the ceiling; late rows are dropped by the watermark."""
    per = requests.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return per.select(key, F.col("window.start").alias("start"), "n", (F.col("n") > ceiling).alias("over"))


def sliding(requests: DataFrame, kind: str, ts: str, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    per = requests.withWatermark(ts, late).groupBy(F.window(ts, width, slide), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(requests: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    per = requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return per.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stuck(jobs: DataFrame, now, minutes: int = 12) -> DataFrame:
    """Batch twin of the stuck-job timer: jobs still processing after so many minutes, counted between whole seconds of the clock."""
    return jobs.where((F.col("status") == "processing") & (F.timestamp_diff("SECOND", F.date_trunc("second", F.col("created_at")), F.date_trunc("second", now)) > minutes * 60))


def check_continuously(findings: DataFrame, summarise, path: str, checkpoint: str):
    """Summarise each micro-batch of findings; a redelivered (job, ord) within the watermark is skipped."""
    fresh = findings.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["job_id", "ord"])

    def write(batch: DataFrame, number: int) -> None:
        summarise(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest ``n`` events of each key, with their place."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return events.withColumn("place", rank).where(F.col("place") <= n)
