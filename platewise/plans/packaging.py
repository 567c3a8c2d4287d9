"""Registered queries on dielines: geometry by the grid join, paint state and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import dieline as D
from platewise.operators import spatial as S
from platewise.plans.registry import query
from platewise.plans.views import VIEWS, oracle, view

VIEWS["v_paints"] = """SELECT user_id AS job_id, CAST(event_id % 3 AS INT) + 1 AS page_num, event_id AS op_idx, CASE CAST(event_id % 11 AS INT) WHEN 0 THEN 'dieline' WHEN 1 THEN 'crease' WHEN 2 THEN 'varnish' WHEN 3 THEN 'varnish_free' WHEN 4 THEN 'white' ELSE 'art' END AS role,
      CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'path' END AS kind, event_id % 5 = 0 AS fill, event_id % 5 > 0 AS stroke, CASE WHEN event_id % 7 > 1 THEN value > 60 END AS overprint, CASE WHEN event_id % 13 = 0 THEN value / 100 ELSE CAST(1 AS DOUBLE) END AS alpha,
      CASE WHEN event_id % 17 = 0 THEN 'Multiply' ELSE 'Normal' END AS blend_mode, event_id % 19 = 0 AS in_die_layer, CAST(event_id * 37 % 900 AS DOUBLE) AS x0, CAST(event_id * 53 % 700 AS DOUBLE) AS y0,
      CAST(event_id * 37 % 900 + CASE WHEN event_id % 50 = 0 THEN 400 ELSE event_id % 23 END AS DOUBLE) AS x1, CAST(event_id * 53 % 700 + CASE WHEN event_id % 50 = 0 THEN 300 ELSE event_id % 17 END AS DOUBLE) AS y1 FROM {events}"""
VIEWS["v_regions"] = """SELECT user_id AS job_id, CAST(event_id % 3 AS INT) + 1 AS page_num, CAST(event_id * 41 % 800 AS DOUBLE) AS x0, CAST(event_id * 59 % 600 AS DOUBLE) AS y0, CAST(event_id * 41 % 800 + CASE WHEN user_id % 2 = 0 THEN 120 ELSE 100 + event_id % 60 END AS DOUBLE) AS x1,
      CAST(event_id * 59 % 600 + 90 AS DOUBLE) AS y1 FROM {events} WHERE event_id % 8 = 0"""

MEET = "a.job_id = b.job_id AND a.page_num = b.page_num"
OVER = "greatest(0.0, {h}x0 - {b}x0, {h}y0 - {b}y0, {b}x1 - {h}x1, {b}y1 - {h}y1)"
DIST = "sqrt(greatest(0.0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) ** 2 + greatest(0.0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) ** 2)"


@query(oracle("v_paints", f"SELECT a.job_id, a.page_num, a.op_idx, count(*) AS near FROM v_paints a JOIN v_paints b ON {MEET} AND b.role <> 'art' WHERE a.role = 'art' AND a.x0 - 6 <= b.x1 AND a.x1 + 6 >= b.x0 AND a.y0 - 6 <= b.y1 AND a.y1 + 6 >= b.y0 GROUP BY ALL"))
def j3_boxes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_paints").select("job_id", "page_num", "op_idx", "role", *S.SIDES)
    pairs = S.box_pairs(rows.where("role = 'art'"), rows.where("role <> 'art'"), ["job_id", "page_num"], 6.0)
    return pairs.groupBy("job_id", "page_num", "op_idx").agg(F.count("*").alias("near"))


@query(
    oracle(
        "v_paints",
        """SELECT job_id, page_num, 'DIE_ZORDER' AS inspection_id, 'warning' AS severity FROM p WHERE last_art > last_die UNION ALL SELECT job_id, page_num, 'DIE_KNOCKOUT', 'warning' FROM p WHERE knocked > 0 UNION ALL SELECT job_id, page_num, 'DIE_AS_ART', CASE WHEN area >= 100 THEN 'error' ELSE 'advisory' END FROM p WHERE fills > 0
  UNION ALL SELECT job_id, page_num, 'DIE_OPACITY_LOW', 'warning' FROM p WHERE clear > 0 UNION ALL SELECT job_id, page_num, 'DIE_BLEND_MODE', 'warning' FROM p WHERE blended > 0 UNION ALL SELECT job_id, page_num, 'DIE_LAYER_CONTENT', 'warning' FROM p WHERE foreigners > 0""",
        """p AS (SELECT job_id, page_num, max(op_idx) FILTER (WHERE role = 'dieline') AS last_die, max(op_idx) FILTER (WHERE role <> 'dieline') AS last_art, count(*) FILTER (WHERE role = 'dieline' AND stroke AND overprint IS NOT TRUE) AS knocked, count(*) FILTER (WHERE role = 'dieline' AND fill) AS fills,
  sum((x1 - x0) * (y1 - y0)) FILTER (WHERE role = 'dieline' AND fill) AS area, count(*) FILTER (WHERE role = 'dieline' AND alpha < 1) AS clear, count(*) FILTER (WHERE role = 'dieline' AND blend_mode = 'Multiply') AS blended, count(*) FILTER (WHERE role <> 'dieline' AND in_die_layer) AS foreigners FROM v_paints GROUP BY ALL)""",
    )
)
def r52_dieline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.paint_state_rules(view(spark, sf_dir, "v_paints"))


@query(
    oracle(
        "v_paints v_regions",
        f"""SELECT job_id, page_num, 'DIE_CONTENT_OUTSIDE' AS inspection_id, 'warning' AS severity, count(*) AS boxes, max(over) AS worst FROM m WHERE over > 2.83 GROUP BY ALL
  UNION ALL SELECT job_id, page_num, 'DIE_EXCESSIVE_BLEED', 'advisory', count(*), max(hull_over) FROM m WHERE hull_over > 3.0::DOUBLE / 0.352778::DOUBLE GROUP BY ALL""",
        "h AS (SELECT job_id, page_num, min(x0) AS hx0, min(y0) AS hy0, max(x1) AS hx1, max(y1) AS hy1, list_sort(list(x1 - x0)) AS w, list_sort(list(y1 - y0)) AS hh FROM v_regions GROUP BY ALL)",
        "g AS (SELECT *, len(w) >= 3 AND len(list_filter(w, lambda v: abs(v - w[len(w) // 2 + 1]) / w[len(w) // 2 + 1] >= 0.1)) = 0 AND len(list_filter(hh, lambda v: abs(v - hh[len(hh) // 2 + 1]) / hh[len(hh) // 2 + 1] >= 0.1)) = 0 AS multi FROM h)",
        f"""m AS (SELECT a.job_id, a.page_num, {OVER.format(h="g.h", b="a.")} AS hull_over, CASE WHEN multi THEN (SELECT min({OVER.format(h="b.", b="a.")}) FROM v_regions b WHERE {MEET}) ELSE {OVER.format(h="g.h", b="a.")} END AS over
  FROM v_paints a JOIN g ON a.job_id = g.job_id AND a.page_num = g.page_num WHERE role NOT IN ('dieline', 'crease'))""",
    )
)
def r51_content_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.content_outside(view(spark, sf_dir, "v_paints"), view(spark, sf_dir, "v_regions"))


@query(
    oracle(
        "v_paints v_regions",
        """SELECT job_id, page_num, 'DIE_VARNISH_COLLISION' AS inspection_id, 'warning' AS severity, round(greatest(least(vx1, fx1) - greatest(vx0, fx0), 0) * greatest(least(vy1, fy1) - greatest(vy0, fy0), 0), 6) AS amount FROM p WHERE vx0 IS NOT NULL AND fx0 IS NOT NULL AND amount >= 50
  UNION ALL SELECT p.job_id, p.page_num, 'DIE_WHITE_GAP', 'warning', round(greatest(least(wx1, hx1) - greatest(wx0, hx0), 0) * greatest(least(wy1, hy1) - greatest(wy0, hy0), 0) / ((hx1 - hx0) * (hy1 - hy0)) * 100, 6) AS part FROM p JOIN h ON p.job_id = h.job_id AND p.page_num = h.page_num WHERE wx0 IS NOT NULL AND part < 95""",
        "p AS (SELECT job_id, page_num, " + ", ".join(f"{'min' if s[1] == '0' else 'max'}({s}) FILTER (WHERE role = '{role}') AS {p}{s}" for role, p in (("varnish", "v"), ("varnish_free", "f"), ("white", "w")) for s in ("x0", "y0", "x1", "y1")) + " FROM v_paints GROUP BY ALL)",
        "h AS (SELECT job_id, page_num, min(x0) AS hx0, min(y0) AS hy0, max(x1) AS hx1, max(y1) AS hy1 FROM v_regions GROUP BY ALL)",
    )
)
def r51_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.coverage_rules(view(spark, sf_dir, "v_paints"), view(spark, sf_dir, "v_regions"))


@query(
    oracle(
        "v_paints",
        """SELECT job_id, page_num, inspection_id, CASE inspection_id WHEN 'TEXT_NEAR_FOLD' THEN 'warning' ELSE 'advisory' END AS severity, count(*) AS boxes, round(min(d) * 0.352778::DOUBLE, 6) AS least FROM (SELECT job_id, page_num, op_idx, 'BARCODE_QUIET_ZONE' AS inspection_id, min(d) AS d FROM n WHERE kind = 'image' AND d < 2.5::DOUBLE / 0.352778::DOUBLE GROUP BY ALL
  UNION ALL SELECT job_id, page_num, op_idx, 'TEXT_NEAR_FOLD', min(d) FROM n WHERE kind = 'text' AND role = 'crease' AND d < 3.0::DOUBLE / 0.352778::DOUBLE GROUP BY ALL) GROUP BY ALL""",
        f"n AS (SELECT a.job_id, a.page_num, a.op_idx, a.kind, b.role, {DIST} AS d FROM v_paints a JOIN v_paints b ON {MEET} WHERE a.role = 'art' AND b.role IN ('dieline', 'crease') AND b.stroke)",
    )
)
def r51_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_lines(view(spark, sf_dir, "v_paints"))
