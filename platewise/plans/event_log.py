"""Registered queries over the drawing-event log: it is stored bucketed and sorted, and rules that carry state read it as it lies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import families as R
from platewise.operators import layout as L
from platewise.plans.registry import query
from platewise.plans.views import VIEWS, oracle, table
from platewise.sources import event_log as Z
from platewise.sources.shared import shared_path

VIEWS["v_events"] = """SELECT user_id AS job_id, CAST(event_id % 3 AS INT) + 1 AS page_num, event_id * 7919 % 100003 AS op_idx, CASE event_type WHEN 'error' THEN 'overprint' WHEN 'signup' THEN 'opacity' WHEN 'click' THEN 'colour' WHEN 'view' THEN 'path' ELSE 'text' END AS kind,
      event_type AS operator, CASE WHEN event_type = 'error' THEN value > 50 END AS overprint_fill, CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN value > 20 END AS overprint_stroke, CASE WHEN event_type = 'error' THEN CAST(event_id % 2 AS INT) END AS overprint_mode,
      CASE WHEN event_type = 'signup' THEN value / 100 END AS fill_alpha, CASE WHEN event_type = 'click' THEN event_id % 2 = 0 END AS stroking, CASE WHEN event_type = 'view' THEN event_id % 3 > 0 END AS fill, CASE WHEN event_type = 'view' THEN event_id % 4 > 1 END AS stroke,
      CASE WHEN event_type = 'click' OR event_id % 6 = 0 THEN CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN '/CS4' WHEN 2 THEN 'CS7' ELSE 'DeviceCMYK' END END AS color_space, CASE WHEN event_id % 11 = 0 THEN 'CS7' END AS stroke_color_space FROM {events}"""

CUTTING = {"CS4": "CutContour", "CS7": "Crease"}
_LAST = "last_value({0} IGNORE NULLS) OVER w"
_STATE = f"""s AS (SELECT job_id, page_num, op_idx, kind, fill, stroke, color_space, stroke_color_space, {_LAST.format("overprint_fill")} AS op, {_LAST.format("overprint_stroke")} AS ops, {_LAST.format("overprint_mode")} AS mode, min(fill_alpha) OVER w AS least_alpha,
  {_LAST.format("CASE WHEN kind = 'colour' AND NOT coalesce(stroking, false) THEN color_space END")} AS fs, {_LAST.format("CASE WHEN kind = 'colour' AND stroking THEN color_space END")} AS ss
  FROM v_events WINDOW w AS (PARTITION BY job_id ORDER BY page_num, op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the given events, stored as a table of its own; events of one number stand in order of event_id, which the SQL leaves open."""
    told = spark.sql(VIEWS["v_events"].replace(" FROM {events}", ", event_id AS seq FROM {events}"), events=table(spark, sf_dir, "events"))
    name = f"event_log_{uuid.uuid4().hex}"
    Z.write_event_log(told, name, shared_path(spark, "event-log"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return Z.event_log(spark, name)


@query(
    oracle(
        "v_events",
        """SELECT job_id, page_num, op_idx, 'OVER_001' AS inspection_id, 'warning' AS severity FROM s WHERE op AND kind = 'path' AND color_space NOT IN ('DeviceCMYK', 'DeviceGray')
  UNION ALL SELECT job_id, page_num, op_idx, 'OVER_002', 'warning' FROM s WHERE op AND kind = 'overprint' AND mode = 0 AND color_space = 'DeviceCMYK' UNION ALL SELECT job_id, page_num, op_idx, 'OVER_003', 'warning' FROM s WHERE op AND kind = 'overprint' AND least_alpha < 1
  UNION ALL SELECT job_id, page_num, op_idx, 'OVER_006', 'error' FROM s WHERE op AND kind = 'colour' AND color_space = 'DeviceRGB'""",
        _STATE,
    )
)
def s2_r48_overprint_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    inks = [F.element_at("color_values", i).alias(x) for i, x in enumerate("cmyk", 1)]
    rows = _log(spark, sf_dir).select(*Z.DRAWN, "kind", "color_space", F.col("overprint_fill").alias("overprint"), F.col("overprint_mode").alias("opm"), F.col("fill_alpha").alias("alpha"), *inks)
    return R.overprint_rules(rows, tuple(Z.DRAWN[1:])).drop("seq")


@query(
    oracle(
        "v_events",
        """SELECT job_id, ink, min({'p': page_num, 'o': op_idx}) FILTER (WHERE NOT over).p AS page_num, min({'p': page_num, 'o': op_idx}) FILTER (WHERE NOT over).o AS op_idx, count(*) FILTER (WHERE NOT over) AS paints, count(*) FILTER (WHERE over) = 0 AS never
  FROM p WHERE ink IS NOT NULL GROUP BY job_id, ink HAVING count(*) FILTER (WHERE NOT over) > 0""",
        _STATE,
        """p AS (SELECT job_id, page_num, op_idx, CASE ltrim(coalesce(color_space, fs), '/') WHEN 'CS4' THEN 'CutContour' WHEN 'CS7' THEN 'Crease' END AS ink, coalesce(op, false) AS over FROM s WHERE kind = 'path' AND fill
  UNION ALL SELECT job_id, page_num, op_idx, CASE ltrim(coalesce(stroke_color_space, ss), '/') WHEN 'CS4' THEN 'CutContour' WHEN 'CS7' THEN 'Crease' END, coalesce(ops, false) FROM s WHERE kind = 'path' AND stroke)""",
    )
)
def s2_r50_cutting_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cutting_offences(L.cutting_paints(Z.with_state(_log(spark, sf_dir)), CUTTING))
