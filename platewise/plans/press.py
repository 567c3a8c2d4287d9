"""Registered queries on the press without black: its tiers of rejections, and the verdict from the findings themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import color as C
from platewise.operators import findings as A
from platewise.operators import press as P
from platewise.plans.registry import LIN, TIER_SQL, query
from platewise.plans.views import oracle, view


def _lab_sql(p: str) -> str:
    """Columns l, a, b with a prefix from those of linear light."""
    xyz = [f"(0.4124564::DOUBLE * {p}r + 0.3575761::DOUBLE * {p}g + 0.1804375::DOUBLE * {p}b) / 0.95047::DOUBLE", f"(0.2126729::DOUBLE * {p}r + 0.7151522::DOUBLE * {p}g + 0.0721750::DOUBLE * {p}b)", f"(0.0193339::DOUBLE * {p}r + 0.1191920::DOUBLE * {p}g + 0.9503041::DOUBLE * {p}b) / 1.08883::DOUBLE"]
    x, y, z = (f"CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE (24389.0::DOUBLE / 27 * {t} + 16) / 116 END" for t in xyz)
    return f"116 * ({y}) - 16 AS {p}_l, 500 * (({x}) - ({y})) AS {p}_a, 200 * (({y}) - ({z})) AS {p}_b"


_FULL, _BARE = ([f"(1 - least({i}, 1)) * {k}" for i in "cmy"] for k in ("(1 - least(k, 1))", "1"))
_FILLS = (
    "p AS (SELECT DISTINCT job_id, page_num, round(c, 2) AS c, round(m, 2) AS m, round(y, 2) AS y, round(k, 2) AS k FROM v_paths WHERE fill)",
    "n AS (SELECT *, " + ", ".join(f"{LIN.format(f'({e})')} AS {p}{x}" for p, es in (("u", _FULL), ("w", _BARE)) for x, e in zip("rgb", es, strict=True)) + " FROM p)",
    f"q AS (SELECT *, sqrt((u_l - w_l) ** 2 + (u_a - w_a) ** 2 + (u_b - w_b) ** 2) AS d FROM (SELECT *, {_lab_sql('u')}, {_lab_sql('w')} FROM n))",
    "bx AS (SELECT job_id, page_num, mx0, my0, mx1, my1, " + ", ".join(f"coalesce(t{s}, c{s}, m{s}) AS t{s}, coalesce(b{s}, m{s}) AS b{s}, coalesce(b{s}, c{s}, m{s}) AS s{s}" for s in ("x0", "y0", "x1", "y1")) + " FROM v_pages)",
    """sp AS (SELECT job_id, max((cs_type = 'DeviceCMYK')::INT) + max((cs_type IN ('DeviceRGB', 'CalRGB'))::INT) + max((cs_type IN ('DeviceGray', 'CalGray'))::INT) AS process, max((cs_type = 'Separation')::INT) + max((cs_type = 'DeviceN')::INT) AS special,
  count(DISTINCT colorant) FILTER (WHERE cs_type IN ('Separation', 'DeviceN') AND colorant IN ('Gold', 'Silver')) AS spots FROM v_spaces GROUP BY job_id)""",
    "im AS (SELECT DISTINCT job_id, page_num, image_name FROM v_images WHERE sqrt(a * a + c * c) >= 1e-10 AND sqrt(b * b + d * d) >= 1e-10 AND least(pixel_width / (sqrt(a * a + c * c) / 72), pixel_height / (sqrt(b * b + d * d) / 72)) < 200)",
    "pg AS (SELECT job_id, count(DISTINCT page_num) AS pages, greatest(" + ", ".join(f"max({p}{s}) - min({p}{s})" for p in "ts" for s in ("x0", "y0", "x1", "y1")) + ") AS spread, count(DISTINCT {'w': round(mx1 - mx0, 1), 'h': round(my1 - my0, 1)}) AS sizes FROM bx GROUP BY job_id)",
)
_A_SQL = """SELECT job_id, page_num, 0 AS n FROM q WHERE least(c, m, y) >= 0.95 AND k >= 0.5 UNION ALL SELECT job_id, page_num, 1 FROM q WHERE k * 100 >= 80 AND d > 2 UNION ALL SELECT job_id, page_num, 2 FROM q WHERE k * 100 >= 90 AND greatest(c, m, y) * 100 >= 5 AND abs(c * 100 - 40) + abs(m * 100 - 20) + abs(y * 100 - 20) + abs(k * 100 - 80) > 25
  UNION ALL SELECT job_id, 0, 3 FROM v_docs WHERE title IN ('4-NOT SPECIFIED') UNION ALL SELECT job_id, page_num, 4 FROM (SELECT DISTINCT job_id, page_num, round(size_pt, 2) FROM v_runs WHERE size_pt < 5 AND NOT (greatest(c, m, y) < 0.05 AND k > 0.5))"""
_B_SQL = """SELECT job_id, 0 AS page_num, 5 AS n FROM sp WHERE process + spots > 4 UNION ALL SELECT job_id, page_num, 6 FROM bx WHERE least(tx0 - bx0, ty0 - by0, bx1 - tx1, by1 - ty1) < 8.5 UNION ALL SELECT job_id, 0, 7 FROM pg WHERE pages < 4 UNION ALL SELECT job_id, page_num, 8 FROM im UNION ALL SELECT job_id, 0, 9 FROM pg WHERE pages > 1 AND spread > 0.5"""
_C_SQL = """SELECT job_id, 0 AS page_num, 10 AS n FROM sp WHERE spots > 1 UNION ALL SELECT job_id, page_num, 11 FROM (SELECT DISTINCT job_id, page_num, round(line_width, 3) FROM v_paths WHERE NOT fill AND line_width > 0 AND line_width < 0.35) UNION ALL SELECT job_id, 0, 12 FROM sp WHERE process + special > 1 UNION ALL SELECT job_id, 0, 13 FROM v_docs WHERE trapped IS NULL OR trapped <> 'True'
  UNION ALL SELECT job_id, page_num, 14 FROM bx WHERE abs((tx0 - bx0) - (bx1 - tx1)) > 1 OR abs((ty0 - by0) - (by1 - ty1)) > 1 UNION ALL SELECT job_id, 0, 15 FROM pg WHERE sizes > 1"""
_VIEWS = "v_paths v_pages v_spaces v_images v_runs v_docs"
_NAMED = f"SELECT job_id, CAST(page_num AS INT) AS page_num, {list(P.CODES)!r}[n + 1] AS inspection_id, {list(P.SEVERITIES)!r}[n + 1] AS severity, CAST(n * 10000000 + page_num AS BIGINT) AS ord FROM "


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    substrate = F.when(F.col("title") == "4-NOT SPECIFIED", "Coated Metallic 90 gsm").otherwise("silk")
    return view(spark, sf_dir, "v_docs").select("job_id", "trapped", substrate.alias("substrate"))


def _tier(spark: SparkSession, sf_dir: str, tier: str) -> DataFrame:
    v = lambda name: view(spark, sf_dir, name)
    if tier == "A":
        return P.hard_rejections(v("v_paths"), v("v_runs"), _docs(spark, sf_dir), delta=C.delta_e76)
    if tier == "B":
        return P.soft_rejections(v("v_spaces"), v("v_pages"), v("v_images"))
    return P.advisories(v("v_spaces"), v("v_paths"), _docs(spark, sf_dir), v("v_pages"), spots=1)


@query(oracle(_VIEWS, f"{_NAMED} ({_A_SQL})", *_FILLS))
def r22_hard_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier(spark, sf_dir, "A")


@query(oracle(_VIEWS, f"{_NAMED} ({_B_SQL})", *_FILLS))
def r22_soft_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier(spark, sf_dir, "B")


@query(oracle(_VIEWS, f"{_NAMED} ({_C_SQL})", *_FILLS))
def r22_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tier(spark, sf_dir, "C")


@query(
    oracle(
        _VIEWS,
        "SELECT *, len(list_intersect(string_split(drivers, ','), ['EPM_GAMUT_OUT_REJECT', 'EPM_SPOT_COUNT_REJECT', 'EPM_005', 'EPM_011'])) > 0 AS upsell FROM v",
        *_FILLS,
        f"c AS (SELECT job_id, {TIER_SQL} AS tier, inspection_id, min(ord) AS ord FROM ({_NAMED} ({_A_SQL} UNION ALL {_B_SQL} UNION ALL {_C_SQL})) GROUP BY ALL)",
        """v AS (SELECT job_id, CASE WHEN count(*) FILTER (WHERE tier = 'A') > 0 OR count(*) FILTER (WHERE tier = 'B') >= 2 THEN 'reject' WHEN count(*) FILTER (WHERE tier = 'B') = 1 THEN 'marginal' WHEN count(*) FILTER (WHERE tier = 'C') > 0 THEN 'pass_with_advisory' ELSE 'pass' END AS verdict,
  coalesce(string_agg(inspection_id, ',' ORDER BY tier, ord, inspection_id) FILTER (WHERE tier IN ('A', 'B')), '') AS drivers, coalesce(string_agg(inspection_id, ',' ORDER BY ord, inspection_id) FILTER (WHERE tier = 'C'), '') AS advisories FROM c GROUP BY job_id)""",
    )
)
def r22_a5_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of jobs with any finding, from what the three tiers find."""
    found = [_tier(spark, sf_dir, t) for t in "ABC"]
    return A.press_verdict(found[0].unionByName(found[1]).unionByName(found[2]))
