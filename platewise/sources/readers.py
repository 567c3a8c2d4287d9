"""Extraction payloads, rulesets and results: fixed schemas on the way in, partitioned Parquet and JSON on the way out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAYLOAD = f"""job_id long, version string, page_count int, color_spaces array<struct<id:string,type:string,components:int,colorants:array<string>>>,
  pages array<struct<page_num:int,media:{BOX},crop:{BOX},bleed:{BOX},trim:{BOX},rotate:int,
    fonts:array<struct<name:string,base_font:string,font_type:string,embedded:boolean,subset:boolean>>,
    images:array<struct<name:string,width:int,height:int,bits:int,color_space_id:string,filters:array<string>>>>>"""

RULESET = "ruleset_id string, enabled array<string>, disabled array<string>, severity_overrides map<string,string>, max_severity string, thresholds map<string,double>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Extraction payloads, one JSON object a line; broken lines keep nulls rather than fail the read."""
    return spark.read.schema(PAYLOAD).option("mode", "PERMISSIVE").json(path)


def explode_payloads(raw: DataFrame) -> dict[str, DataFrame]:
    """The docs, pages, fonts, images and color_spaces tables of payloads; a missing box falls back to the next larger."""
    pages = raw.select("job_id", F.explode("pages").alias("p"))
    boxes = [F.coalesce("p.crop", "p.media").alias("crop"), F.coalesce("p.bleed", "p.crop", "p.media").alias("bleed"), F.coalesce("p.trim", "p.crop", "p.media").alias("trim")]
    spaces = raw.select("job_id", F.explode("color_spaces").alias("s")).select("job_id", "s.*")
    images = pages.select("job_id", "p.page_num", F.explode("p.images").alias("i")).select("job_id", "page_num", "i.*")
    kinds = spaces.select("job_id", F.col("id").alias("color_space_id"), F.col("type").alias("cs_type"))
    return {
        "docs": raw.select("job_id", "version", "page_count"),
        "pages": pages.select("job_id", "p.page_num", "p.media", *boxes, F.coalesce("p.rotate", F.lit(0)).alias("rotate")),
        "fonts": pages.select("job_id", "p.page_num", F.explode("p.fonts").alias("f")).select("job_id", "page_num", "f.*"),
        "images": images.join(kinds, ["job_id", "color_space_id"], "left"),
        "color_spaces": spaces,
    }


def rulesets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULESET).option("multiLine", True).json(path)


def imported_findings(raw: DataFrame, words: dict[str, str]) -> DataFrame:
    """Findings of third-party reports (job_id, check, severity, message): unknown severity words are warnings, blank goes.

    A missing check id is made from the message's whole hash, so that reading again gives the same id and messages do not share one.
    """
    level = F.create_map(*[F.lit(x) for item in words.items() for x in item])[F.lower("severity")]
    derived = F.concat(F.lit("EXT-CUSTOM-"), F.lower(F.hex(F.xxhash64("message"))))
    return raw.where(F.trim("message") != "").select("job_id", F.coalesce("check", derived).alias("inspection_id"), F.coalesce(level, F.lit("warning")).alias("severity"), "message")


def resolved_thresholds(rulesets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Thresholds of a job: the ruleset's, with the override of each key that the ruleset knows."""
    joined = overrides.join(rulesets.select("ruleset_id", "thresholds"), "ruleset_id")
    merged = F.transform_values("thresholds", lambda k, v: F.coalesce(F.col("override")[k], v))
    return joined.select("job_id", "ruleset_id", merged.alias("thresholds"))


def write_results(findings: DataFrame, path: str, *partition: str) -> None:
    """Findings as Parquet, by date or another coarse partition column."""
    findings.write.mode("overwrite").partitionBy(*partition).parquet(path)


def result_documents(findings: DataFrame) -> DataFrame:
    """One JSON document per job: its findings in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "inspection_id", "severity", "page_num")))
    return findings.groupBy("job_id").agg(F.to_json(F.struct(F.count("*").alias("total"), rows.alias("findings"))).alias("document"))
