"""Registered queries and their SQL: operators of this library over views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import color as C
from platewise.functions import geometry as G
from platewise.functions import text as T
from platewise.operators import accuracy as Q
from platewise.operators import content as K
from platewise.operators import families as R
from platewise.operators import findings as A
from platewise.operators import jobs as J
from platewise.operators import layout as L
from platewise.operators import series as S
from platewise.operators import settings as P
from platewise.operators import similarity as N
from platewise.operators import typography as Y
from platewise.plans.views import oracle, table, view
from platewise.streaming import monitors as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


NOW = "2024-02-01 00:00:00"

# --- scalar expressions

DPI = "CASE WHEN sqrt(a * a + c * c) >= 1e-10 AND sqrt(b * b + d * d) >= 1e-10 THEN least(pixel_width / (sqrt(a * a + c * c) / 72), pixel_height / (sqrt(b * b + d * d) / 72)) END"
SHEAR = "abs(a * b + c * d) / abs(a * d - b * c)"


@query(oracle("v_images", f"SELECT job_id, page_num, round({DPI}, 6) AS dpi, round({SHEAR}, 6) AS shear, a * d - b * c < 0 AS mirrored FROM v_images"))
def f1_effective_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_images")
    m = [F.col(k) for k in "abcd"]
    dpi = G.effective_dpi(F.col("pixel_width"), F.col("pixel_height"), *m)
    return rows.select("job_id", "page_num", F.round(dpi, 6).alias("dpi"), F.round(G.shear(*m), 6).alias("shear"), G.is_mirrored(*m).alias("mirrored"))


@query(
    oracle(
        "v_paths v_pages",
        """SELECT p.job_id, p.page_num, op_idx, round((x1 - x0) * (y1 - y0), 4) AS area,
  round(greatest(tx0 - x0, ty0 - y0, x1 - tx1, y1 - ty1, 0), 6) AS overhang, round(greatest(least(x1, tx1) - greatest(x0, tx0), 0) * greatest(least(y1, ty1) - greatest(y0, ty0), 0), 4) AS common
  FROM v_paths p JOIN v_pages g ON p.job_id = g.job_id AND p.page_num = g.page_num WHERE tx0 IS NOT NULL""",
    )
)
def f5_box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_paths").join(view(spark, sf_dir, "v_pages").where("tx0 IS NOT NULL"), ["job_id", "page_num"])
    box, trim = G.Box.of(""), G.Box.of("t")
    return rows.select("job_id", "page_num", "op_idx", F.round(box.area, 4).alias("area"), F.round(trim.overhang(box), 6).alias("overhang"), F.round(box.meet(trim).area, 4).alias("common"))


@query(
    oracle(
        "v_paths",
        """SELECT job_id, page_num, op_idx, round((c + m + y + k) * 100, 4) AS coverage, c >= 0.99 AND m >= 0.99 AND y >= 0.99 AND k >= 0.99 AS registration,
  CAST((c > 0)::INT + (m > 0)::INT + (y > 0)::INT + (k > 0)::INT AS INT) AS inks FROM v_paths""",
    )
)
def f7_ink_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    inks = [F.col(x) for x in "cmyk"]
    return view(spark, sf_dir, "v_paths").select("job_id", "page_num", "op_idx", F.round(C.coverage(*inks), 4).alias("coverage"), C.is_registration(*inks).alias("registration"), C.active_inks(*inks).alias("inks"))


LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92::DOUBLE ELSE pow(({0} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
RGB = "v_rgb AS (SELECT *, (1 - least(c, 1)) * (1 - k) AS r, (1 - least(m, 1)) * (1 - k) AS g, (1 - y) * (1 - k) AS bl FROM v_paths)"
LUM = f"0.2126::DOUBLE * {LIN.format('r')} + 0.7152::DOUBLE * {LIN.format('g')} + 0.0722::DOUBLE * {LIN.format('bl')}"


def _rgb(rows: DataFrame) -> DataFrame:
    r, g, b = C.cmyk_to_rgb(F.least("c", F.lit(1.0)), F.least("m", F.lit(1.0)), F.col("y"), F.col("k"))
    return rows.withColumns({"r": r, "g": g, "bl": b})


@query(oracle("v_paths", f"SELECT job_id, page_num, op_idx, round(1.05::DOUBLE / ({LUM} + 0.05::DOUBLE), 6) AS contrast FROM v_rgb", RGB))
def f11_contrast_on_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rgb(view(spark, sf_dir, "v_paths"))
    return rows.select("job_id", "page_num", "op_idx", F.round(C.contrast(F.lit(1.0), C.luminance(F.col("r"), F.col("g"), F.col("bl"))), 6).alias("contrast"))


@query(
    oracle(
        "v_paths",
        f"""SELECT job_id, page_num, op_idx, round(sqrt(l * l + (500 * (fx - fy)) ** 2 + (200 * (fy - fz)) ** 2), 4) AS from_black
  FROM (SELECT *, 116 * fy - 16 AS l FROM (SELECT *, {", ".join(f"CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE (24389.0::DOUBLE / 27 * {t} + 16) / 116 END AS f{t}" for t in "xyz")} FROM v_xyz))""",
        RGB,
        f"v_lin AS (SELECT job_id, page_num, op_idx, {LIN.format('r')} AS lr, {LIN.format('g')} AS lg, {LIN.format('bl')} AS lb FROM v_rgb)",
        """v_xyz AS (SELECT job_id, page_num, op_idx, (0.4124564::DOUBLE * lr + 0.3575761::DOUBLE * lg + 0.1804375::DOUBLE * lb) / 0.95047::DOUBLE AS x,
  0.2126729::DOUBLE * lr + 0.7151522::DOUBLE * lg + 0.0721750::DOUBLE * lb AS y, (0.0193339::DOUBLE * lr + 0.1191920::DOUBLE * lg + 0.9503041::DOUBLE * lb) / 1.08883::DOUBLE AS z FROM v_lin)""",
    )
)
def f9_lab_distance_from_black(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rgb(view(spark, sf_dir, "v_paths"))
    lab = C.rgb_to_lab(F.col("r"), F.col("g"), F.col("bl"))
    return rows.select("job_id", "page_num", "op_idx", F.round(C.delta_e76(lab, (F.lit(0.0),) * 3), 4).alias("from_black"))


@query("SELECT p_partkey, CAST((10 - (3 * (d // 1 % 10) + (d // 10 % 10) + 3 * (d // 100 % 10) + (d // 1000 % 10) + 3 * (d // 10000 % 10) + (d // 100000 % 10) + 3 * (d // 1000000 % 10)) % 10) % 10 AS INT) AS digit FROM (SELECT p_partkey, p_partkey + 5000000 AS d FROM part)")
def f16_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.check_digit((F.col("p_partkey") + 5000000).cast("string")).alias("digit"))


# --- rule families

IMAGE_SQL = f"""SELECT job_id, page_num, inspection_id, severity FROM (
  SELECT job_id, page_num, 'IMG_001' AS inspection_id, 'warning' AS severity FROM i WHERE dpi < 150 UNION ALL SELECT job_id, page_num, 'IMG_002', 'advisory' FROM i WHERE dpi > 450
  UNION ALL SELECT job_id, page_num, 'IMG_006', 'warning' FROM i WHERE dpi < 48 UNION ALL SELECT job_id, page_num, 'IMG_014', 'advisory' FROM i WHERE {SHEAR} > 0.01
  UNION ALL SELECT job_id, page_num, 'IMG_016', 'advisory' FROM i WHERE a * d - b * c < 0
  UNION ALL SELECT job_id, page_num, 'IMG_017', 'advisory' FROM i WHERE least(px, py) < 10 OR greatest(px, py) > 1000)"""


@query(oracle("v_images", IMAGE_SQL, f"i AS (SELECT *, {DPI} AS dpi, sqrt(a * a + c * c) / pixel_width * 100 AS px, sqrt(b * b + d * d) / pixel_height * 100 AS py FROM v_images)"))
def r1_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fused(view(spark, sf_dir, "v_images"), R.image_rules(), "job_id", "page_num")


INK_SQL = """SELECT job_id, page_num, op_idx, inspection_id, severity FROM (
  SELECT job_id, page_num, op_idx, 'COLOR_004' AS inspection_id, 'warning' AS severity FROM v_paths WHERE (c + m + y + k) * 100 > 300
  UNION ALL SELECT job_id, page_num, op_idx, 'COLOR_005', 'warning' FROM v_paths WHERE c >= 0.99 AND m >= 0.99 AND y >= 0.99 AND k >= 0.99
  UNION ALL SELECT job_id, page_num, op_idx, 'COLOR_016', 'warning' FROM v_paths WHERE fill AND c > 0.05 AND m > 0.05 AND y > 0.05 AND k < 0.10 AND greatest(c, m, y) - least(c, m, y) < 0.05
  UNION ALL SELECT job_id, page_num, op_idx, 'COLOR_017', 'warning' FROM v_paths WHERE fill AND k > 0.90 AND (c > 0.05 OR m > 0.05 OR y > 0.05)
  UNION ALL SELECT job_id, page_num, op_idx, 'STROKE_001', 'warning' FROM v_paths WHERE NOT fill AND line_width > 0 AND line_width < 0.25
  UNION ALL SELECT job_id, page_num, op_idx, 'STROKE_002', 'error' FROM v_paths WHERE NOT fill AND line_width = 0
  UNION ALL SELECT job_id, page_num, op_idx, 'STROKE_004', 'warning' FROM v_paths WHERE NOT fill AND line_width > 0 AND line_width < 0.5 AND (c > 0)::INT + (m > 0)::INT + (y > 0)::INT + (k > 0)::INT > 1)"""


@query(oracle("v_paths", INK_SQL))
def r6_r12_ink_and_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fused(view(spark, sf_dir, "v_paths"), R.ink_rules(), "job_id", "page_num", "op_idx")


@query(
    oracle(
        "v_pages",
        """SELECT job_id, page_num, 'BOX_001' AS inspection_id, 'warning' AS severity FROM v_pages WHERE tx0 IS NULL UNION ALL SELECT job_id, page_num, 'BOX_001', 'warning' FROM v_pages WHERE bx0 IS NULL
  UNION ALL SELECT job_id, page_num, 'BOX_002', 'warning' FROM v_pages WHERE cx0 < mx0 OR cy0 < my0 OR cx1 > mx1 OR cy1 > my1
  UNION ALL SELECT job_id, page_num, 'BOX_002', 'warning' FROM v_pages WHERE bx0 < coalesce(cx0, mx0) OR by0 < coalesce(cy0, my0) OR bx1 > coalesce(cx1, mx1) OR by1 > coalesce(cy1, my1)
  UNION ALL SELECT job_id, page_num, 'BOX_002', 'warning' FROM v_pages WHERE tx0 < bx0 OR ty0 < by0 OR tx1 > bx1 OR ty1 > by1
  UNION ALL SELECT job_id, page_num, 'BOX_003', 'warning' FROM v_pages WHERE tx0 - bx0 < 8.5 OR ty0 - by0 < 8.5 OR bx1 - tx1 < 8.5 OR by1 - ty1 < 8.5
  UNION ALL SELECT job_id, page_num, 'BOX_004', 'advisory' FROM v_pages WHERE objects = 0 UNION ALL SELECT job_id, page_num, 'BOX_007', 'warning' FROM v_pages WHERE user_unit <> 1
  UNION ALL SELECT job_id, page_num, 'BOX_008', 'advisory' FROM v_pages WHERE rotate NOT IN (0, 90, 180, 270)""",
    )
)
def r9_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.box_rules(view(spark, sf_dir, "v_pages"))


@query(
    oracle(
        "v_paths v_pages",
        """SELECT job_id, page_num, op_idx, 'BOX_005' AS inspection_id, 'advisory' AS severity FROM b WHERE x0 < tx1 AND tx0 < x1 AND y0 < ty1 AND ty0 < y1 AND NOT (x0 >= tx0 + 10 AND y0 >= ty0 + 10 AND x1 <= tx1 - 10 AND y1 <= ty1 - 10)
  UNION ALL SELECT job_id, page_num, op_idx, 'BOX_006', 'warning' FROM b WHERE x0 < bx0 OR y0 < by0 OR x1 > bx1 OR y1 > by1""",
        "b AS (SELECT p.job_id, p.page_num, op_idx, x0, y0, x1, y1, tx0, ty0, tx1, ty1, bx0, by0, bx1, by1 FROM v_paths p JOIN v_pages g ON p.job_id = g.job_id AND p.page_num = g.page_num)",
    )
)
def r10_content_against_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.content_against_boxes(view(spark, sf_dir, "v_paths"), view(spark, sf_dir, "v_pages"))


@query(
    oracle(
        "v_inks",
        """SELECT job_id, trim(regexp_replace(lower(colorant), '[\\s_-]+', ' ', 'g')) AS ink, string_agg(DISTINCT CAST(page_num AS VARCHAR), ',' ORDER BY CAST(page_num AS VARCHAR)) AS pages,
  count(DISTINCT alternate) AS alternates, count(DISTINCT cs_type) AS families, count(DISTINCT alternate) > 1 AS conflict FROM v_inks GROUP BY 1, 2""",
    )
)
def r30_ink_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ink_inventory(view(spark, sf_dir, "v_inks"))


@query(
    oracle(
        "v_inks",
        "SELECT a.job_id, a.name, b.name AS other, CAST(levenshtein(a.name, b.name) AS INT) AS distance FROM n a JOIN n b ON a.job_id = b.job_id AND a.name < b.name WHERE levenshtein(a.name, b.name) BETWEEN 1 AND 2",
        "n AS (SELECT DISTINCT job_id, trim(regexp_replace(lower(colorant), '[\\s_-]+', ' ', 'g')) AS name FROM v_inks WHERE length(trim(regexp_replace(lower(colorant), '[\\s_-]+', ' ', 'g'))) >= 4)",
    )
)
def r31_name_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.name_typos(view(spark, sf_dir, "v_inks"))


_NORMAL = "trim(regexp_replace(lower(colorant), '[\\s_-]+', ' ', 'g'))"


@query(
    oracle(
        "v_plates",
        "SELECT a.name, b.name AS other, CAST(levenshtein(a.name, b.name) AS INT) AS distance, a.jobs, b.jobs AS other_jobs FROM n a JOIN n b ON a.name < b.name WHERE levenshtein(a.name, b.name) BETWEEN 1 AND 2",
        f"n AS (SELECT {_NORMAL} AS name, count(DISTINCT job_id) AS jobs FROM (SELECT job_id, ink || '-' || right(CAST(job_id AS VARCHAR), 2) AS colorant FROM v_plates WHERE ink <> 'All') GROUP BY 1 HAVING length(name) >= 4)",
    )
)
def r31_corpus_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_plates").withColumn("colorant", F.concat("ink", F.lit("-"), F.expr("right(CAST(job_id AS STRING), 2)")))
    return R.corpus_typos(rows, F.col("ink") == "All")


@query(
    oracle(
        "v_inks",
        """SELECT job_id, least(a, b) AS name, greatest(a, b) AS other, min({'t': CASE WHEN a < b THEN t ELSE u END, 'u': CASE WHEN a < b THEN u ELSE t END}).t AS token, min({'t': CASE WHEN a < b THEN t ELSE u END, 'u': CASE WHEN a < b THEN u ELSE t END}).u AS other_token
  FROM (SELECT x.job_id, x.whole AS a, x.word AS t, y.whole AS b, y.word AS u FROM w x JOIN w y ON x.job_id = y.job_id AND x.word < y.word AND x.whole <> y.whole WHERE levenshtein(x.word, y.word) <= 2) GROUP BY ALL""",
        f"w AS (SELECT DISTINCT job_id, whole, word FROM (SELECT job_id, {_NORMAL} AS whole, unnest(string_split({_NORMAL}, ' ')) AS word FROM v_inks) WHERE length(word) >= 4)",
    )
)
def r31_token_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.token_typos(view(spark, sf_dir, "v_inks"))


def _phrase_sql(pattern: str, label: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT job_id, page_num, '{label}' AS phrase FROM (SELECT job_id, page_num, text, length(regexp_extract(text, '(?s)^(.*?)(?:{p})', 1)) + 1 AS pos, regexp_extract(text, '{p}') AS hit FROM v_text WHERE regexp_matches(text, '{p}'))
  WHERE NOT regexp_matches(substr(text, greatest(pos - 30, 1), pos + length(hit) + 30 - greatest(pos - 30, 1)), '(?i)\\bBest\\s+Before\\s*:\\s*\\d|\\bUse\\s+by\\s*:\\s*\\d|\\bLot\\s+#\\s*[A-Z0-9]')"""


@query(oracle("v_text", "SELECT DISTINCT * FROM (" + " UNION ALL ".join(_phrase_sql(p, label) for p, label in R.PLACEHOLDERS) + ")"))
def r34_placeholder_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placeholder_text(view(spark, sf_dir, "v_text"))


@query(
    oracle(
        "v_drawing",
        """SELECT job_id, op_idx, 'OVER_001' AS inspection_id, 'warning' AS severity FROM s WHERE op AND kind = 'path' AND color_space NOT IN ('DeviceCMYK', 'DeviceGray')
  UNION ALL SELECT job_id, op_idx, 'OVER_002', 'warning' FROM s WHERE op AND kind = 'overprint' AND mode = 0 AND color_space = 'DeviceCMYK' UNION ALL SELECT job_id, op_idx, 'OVER_003', 'warning' FROM s WHERE op AND kind = 'overprint' AND least_alpha < 1
  UNION ALL SELECT job_id, op_idx, 'OVER_004', 'warning' FROM s WHERE op AND kind = 'colour' AND color_space = 'DeviceCMYK' AND c + m + y + k = 0 UNION ALL SELECT job_id, op_idx, 'OVER_006', 'error' FROM s WHERE op AND kind = 'colour' AND color_space = 'DeviceRGB'
  UNION ALL SELECT job_id, op_idx, 'OVER_007', 'warning' FROM s WHERE NOT coalesce(op, false) AND kind = 'text' AND color_space = 'DeviceCMYK' AND c + m + y = 0 AND k > 0
  UNION ALL SELECT job_id, op_idx, 'OVER_008', 'error' FROM s WHERE op AND kind = 'colour' AND color_space = 'DeviceCMYK' AND least(c, m, y, k) >= 0.99""",
        """s AS (SELECT *, last_value(overprint IGNORE NULLS) OVER w AS op, last_value(opm IGNORE NULLS) OVER w AS mode, min(alpha) OVER w AS least_alpha FROM v_drawing
  WINDOW w AS (PARTITION BY job_id ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    )
)
def r48_overprint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overprint_rules(view(spark, sf_dir, "v_drawing"))


@query(oracle("v_runs", """SELECT job_id, page_num, op_idx, 'COLOR_008' AS inspection_id, 'warning' AS severity FROM v_runs WHERE size_pt > 0 AND size_pt < 12 AND (c > 0.01)::INT + (m > 0.01)::INT + (y > 0.01)::INT + (k > 0.01)::INT > 1
  UNION ALL SELECT job_id, page_num, op_idx, 'COLOR_021', 'advisory' FROM v_runs WHERE size_pt > 0 AND (c > 0.01)::INT + (m > 0.01)::INT + (y > 0.01)::INT + (k > 0.01)::INT > 1"""))  # fmt: skip
def r13_black_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fused(view(spark, sf_dir, "v_runs"), R.black_text_rules(), "job_id", "page_num", "op_idx")


# --- evaluation of findings

ENABLED, DISABLED, OVERRIDES, CAP = ("COLOR_*", "ICC_*", "SPOT_*", "OVER_*"), ("*_003",), {"ICC_001": "ignore", "COLOR_015": "error"}, "warning"
RULES = {
    "COLOR_004": [{"when": {"page": {"in": [-1]}}, "include": False}, {"when": {"source": "ai"}, "severity": "advisory"}],
    "SPOT_001": [{"when": {"page": {"gte": 1}, "severity": {"ne": "error"}}, "severity": "error"}],
}


@query(
    oracle(
        "v_findings",
        """SELECT job_id, ord, inspection_id FROM v_findings WHERE (source = 'ai' OR inspection_id LIKE 'COLOR\\_%' ESCAPE '\\' OR inspection_id LIKE 'ICC\\_%' ESCAPE '\\' OR inspection_id LIKE 'SPOT\\_%' ESCAPE '\\'
  OR inspection_id LIKE 'OVER\\_%' ESCAPE '\\') AND NOT inspection_id LIKE '%\\_003' ESCAPE '\\' AND inspection_id <> 'ICC_001'""",
    )
)
def e1_enabled_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_findings").where(A.is_enabled(F.col("inspection_id"), F.col("source"), ENABLED, DISABLED, OVERRIDES)).select("job_id", "ord", "inspection_id")


@query(
    oracle(
        "v_findings",
        """SELECT job_id, ord, inspection_id, CASE WHEN severity = 'error' THEN 'warning' ELSE severity END AS severity FROM (
  SELECT job_id, ord, inspection_id, CASE WHEN inspection_id = 'COLOR_015' THEN 'error' WHEN inspection_id = 'COLOR_004' AND source = 'ai' THEN 'advisory'
    WHEN inspection_id = 'SPOT_001' AND page_num >= 1 AND severity <> 'error' THEN 'error' ELSE severity END AS severity FROM v_findings WHERE NOT (inspection_id = 'COLOR_004' AND page_num = 2))""",
    )
)
def e2_e3_conditions_and_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_findings").withColumn("pages", F.lit(2))
    return A.evaluate(rows, RULES, OVERRIDES, CAP).select("job_id", "ord", "inspection_id", "severity")


# --- aggregates

SUMMARY = "SELECT job_id, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'advisory') AS advisory_count, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM v_findings GROUP BY job_id"


@query(oracle("v_findings", SUMMARY))
def a1_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts(view(spark, sf_dir, "v_findings"), "job_id")


@query(oracle("v_findings", "SELECT job_id, inspection_id, page_num, min(ord) AS ord, min({'o': ord, 's': severity}).s AS severity, count(*) AS repeats FROM v_findings GROUP BY ALL"))
def a2_merge_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merge_repeats(view(spark, sf_dir, "v_findings"))


@query(
    oracle(
        "v_findings",
        "SELECT job_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT job_id, CAST(greatest(0, least(100, round_even(100 - error_count * 10 - warning_count * 3 - advisory_count * 0.5, 0))) AS INT) AS score FROM s)",
        f"s AS ({SUMMARY})",
    )
)
def a3_health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.health_score(A.counts(view(spark, sf_dir, "v_findings"), "job_id"))


def _values(values: dict) -> str:
    return "CASE inspection_id " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " END"


CATEGORY = "CASE " + " ".join(f"WHEN starts_with(inspection_id, '{k}') THEN '{v}'" for k, v in A.CATEGORIES.items()) + " END"
LOST = {k: f"least(coalesce(sum(deduction) FILTER (WHERE category = '{k}'), 0), {v}::DOUBLE)" for k, v in A.WEIGHTS.items()}


@query(
    oracle(
        "v_findings",
        "SELECT job_id, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Fair' WHEN score >= 25 THEN 'Poor' ELSE 'Critical' END AS grade, floor, " + ", ".join(A.WEIGHTS) + " FROM p",
        f"f AS (SELECT job_id, inspection_id, {CATEGORY} AS category, min({{'o': ord, 's': severity}}).s AS severity, count(*) FILTER (WHERE severity = 'error') AS errors FROM v_findings GROUP BY ALL)",
        f"d AS (SELECT *, CASE WHEN category IS NULL THEN 0 ELSE 1 END * coalesce(CASE WHEN severity <> 'advisory' THEN {_values(A.MAJOR)} END, CASE WHEN severity <> 'advisory' THEN {_values(A.MODERATE)} END, {_values(A.MINOR)}, 0) AS deduction, CASE WHEN errors > 0 THEN {_values(A.FLOORS)} END AS floor FROM f)",
        f"p AS (SELECT job_id, round(least(100 - ({' + '.join(LOST.values())}), coalesce(min(floor), 100)), 1) AS score, min(floor) AS floor, {', '.join(f'round({A.WEIGHTS[k]}::DOUBLE - {v}, 1) AS {k}' for k, v in LOST.items())} FROM d GROUP BY job_id)",
    )
)
def a4_color_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.color_score(view(spark, sf_dir, "v_findings"))


TIER_SQL = """CASE WHEN inspection_id IN ('EPM_GAMUT_OUT_REJECT', 'EPM_K_COVERAGE_REJECT', 'EPM_RICH_BLACK_REJECT', 'EPM_SUBSTRATE_REJECT', 'EPM_TEXT_SIZE_REJECT', 'EPM_001', 'EPM_002', 'EPM_006', 'EPM_007') THEN 'A'
  WHEN inspection_id IN ('EPM_PROCESS_COUNT_REJECT', 'EPM_BLEED_REJECT', 'EPM_PAGE_COUNT_REJECT', 'EPM_IMAGE_RES_REJECT', 'EPM_TRIM_REJECT', 'EPM_003', 'EPM_004', 'EPM_005', 'EPM_008', 'EPM_009', 'EPM_018') THEN 'B'
  WHEN inspection_id IN ('EPM_SPOT_COUNT_REJECT', 'EPM_FEATURE_SIZE_REJECT', 'EPM_MIXED_SPACES_REJECT', 'EPM_TRAPPING_REJECT', 'EPM_TRIM_BLEED_REJECT', 'EPM_PAGE_GEOM_REJECT', 'EPM_010', 'EPM_011', 'EPM_012', 'EPM_013', 'EPM_014', 'EPM_015', 'EPM_016', 'EPM_017') THEN 'C' END"""


@query(
    oracle(
        "v_findings",
        "SELECT *, len(list_intersect(string_split(drivers, ','), ['EPM_GAMUT_OUT_REJECT', 'EPM_SPOT_COUNT_REJECT', 'EPM_005', 'EPM_011'])) > 0 AS upsell FROM v",
        f"c AS (SELECT job_id, {TIER_SQL} AS tier, inspection_id, min(ord) AS ord FROM v_findings GROUP BY ALL)",
        """v AS (SELECT job_id, CASE WHEN count(*) FILTER (WHERE tier = 'A') > 0 OR count(*) FILTER (WHERE tier = 'B') >= 2 THEN 'reject' WHEN count(*) FILTER (WHERE tier = 'B') = 1 THEN 'marginal' WHEN count(*) FILTER (WHERE tier = 'C') > 0 THEN 'pass_with_advisory' ELSE 'pass' END AS verdict,
  coalesce(string_agg(inspection_id, ',' ORDER BY tier, ord, inspection_id) FILTER (WHERE tier IN ('A', 'B')), '') AS drivers, coalesce(string_agg(inspection_id, ',' ORDER BY ord, inspection_id) FILTER (WHERE tier = 'C'), '') AS advisories FROM c GROUP BY job_id)""",
    )
)
def a5_press_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.press_verdict(view(spark, sf_dir, "v_findings"))


@query(
    oracle(
        "v_paths",
        "SELECT job_id, ink, count(DISTINCT page_num) AS pages, max(amount) AS most, count(*) AS paints FROM s WHERE amount > 0 GROUP BY job_id, ink",
        "s AS (" + " UNION ALL ".join(f"SELECT job_id, page_num, '{x}' AS ink, {x} AS amount FROM v_paths" for x in "cmyk") + ")",
    )
)
def a6_separations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.separations(view(spark, sf_dir, "v_paths"))


@query(oracle("v_paths", "SELECT job_id, page_num, max(t) AS coverage, min(op_idx) FILTER (WHERE t = best) AS op_idx FROM (SELECT *, max(t) OVER (PARTITION BY job_id, page_num) AS best FROM (SELECT *, round((c + m + y + k) * 100, 4) AS t FROM v_paths)) GROUP BY job_id, page_num"))
def k3_worst_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worst_coverage(view(spark, sf_dir, "v_paths"))


@query(oracle("v_inks", "SELECT job_id, cs_type, count(*) AS n, string_agg(DISTINCT CAST(page_num AS VARCHAR), ',' ORDER BY CAST(page_num AS VARCHAR)) AS pages FROM v_inks GROUP BY job_id, cs_type"))
def a7_color_space_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.array_join(F.sort_array(F.collect_set(F.col("page_num").cast("string"))), ",")
    return view(spark, sf_dir, "v_inks").groupBy("job_id", "cs_type").agg(F.count("*").alias("n"), pages.alias("pages"))


@query(
    oracle(
        "v_jobs",
        """SELECT tenant_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'processing') AS processing,
  CASE WHEN count(*) FILTER (WHERE status = 'processing') > 0 THEN 'processing' WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'complete' WHEN count(*) FILTER (WHERE status = 'complete') = 0 THEN 'failed' ELSE 'partial' END AS status
  FROM v_jobs GROUP BY tenant_id""",
    )
)
def a8_batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.batch_rollup(view(spark, sf_dir, "v_jobs"), "tenant_id")


@query(
    oracle(
        "v_jobs v_findings",
        "SELECT tenant_id, j.job_id, place, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM j LEFT JOIN f ON j.job_id = f.job_id WHERE place <= 10",
        "j AS (SELECT tenant_id, job_id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, job_id DESC) AS INT) AS place FROM v_jobs)",
        "f AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM v_findings GROUP BY job_id)",
    )
)
def a9_quality_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.quality_history(view(spark, sf_dir, "v_jobs"), view(spark, sf_dir, "v_findings"))


USAGE = "u AS (SELECT user_id, ts, CAST(floor(value * 100) AS BIGINT) AS milli_cents FROM events)"


@query(oracle("", "SELECT user_id, CAST(greatest(1, ceil(sum(milli_cents) / 1000)) AS BIGINT) AS cents FROM u GROUP BY user_id", USAGE))
def a12_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "events").select("user_id", "ts", F.floor(F.col("value") * 100).alias("milli_cents"))
    return J.usage_cost(usage, "user_id")


@query(oracle("", "SELECT user_id, date_trunc('month', ts) AS month, CAST(sum(milli_cents) AS BIGINT) AS spent, CAST(greatest(0, 100000 - sum(milli_cents)) AS BIGINT) AS remaining, sum(milli_cents) * 100 >= 8000000 AS alert, sum(milli_cents) >= 100000 AS over FROM u GROUP BY ALL", USAGE))
def a13_month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = table(spark, sf_dir, "events").select("user_id", "ts", F.floor(F.col("value") * 100).alias("cents"))
    return J.month_to_date(spend, "user_id", 100_000)


@query(oracle("v_decisions", "SELECT decision_type, count(*) AS n FROM v_decisions WHERE revoked_at IS NULL GROUP BY decision_type"))
def a14_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.decision_counts(view(spark, sf_dir, "v_decisions"))


@query(oracle("v_jobs", "SELECT status, CAST((duration_ms >= 50000)::INT + (duration_ms >= 100000)::INT + (duration_ms >= 200000)::INT AS INT) AS bucket, count(*) AS n, round(sum(duration_ms), 2) AS total_ms FROM v_jobs GROUP BY ALL"))
def a15_duration_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.duration_distribution(view(spark, sf_dir, "v_jobs"), [50000.0, 100000.0, 200000.0])


@query(oracle("v_findings", "SELECT inspection_id, severity, source, CAST(grouping_id(inspection_id, severity, source) AS BIGINT) AS level, count(*) AS n FROM v_findings GROUP BY CUBE (inspection_id, severity, source)"))
def a19_report_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_findings").cube("inspection_id", "severity", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


# --- windows

LIMITS = "l AS (SELECT series, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sigma FROM v_series GROUP BY series)"


@query(oracle("v_series", "SELECT series, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(mean + 3 * sigma, 6) AS up3, round(mean - 3 * sigma, 6) AS low3 FROM l", LIMITS))
def w1_control_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.limits(view(spark, sf_dir, "v_series")).select("series", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sigma", "up3", "low3")])


def _run_sql(rule: int, length: int, least: int, k: int) -> str:
    parts = []
    for side, sign, op in (("up", "+", ">"), ("low", "-", "<")):
        parts.append(f"SELECT series, {rule} AS rule, '{side}' AS side, seq FROM (SELECT series, seq, count(*) OVER w AS n, sum((value {op} mean {sign} {k} * sigma)::INT) OVER w AS s FROM p WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)) WHERE n = {length} AND s >= {least}")
    return " UNION ALL ".join(parts)


@query(oracle("v_series", " UNION ALL ".join(_run_sql(*r) for r in ((1, 1, 1, 3), (2, 3, 2, 2), (3, 5, 4, 1), (4, 8, 8, 0))), LIMITS, "p AS (SELECT v.*, mean, sigma FROM v_series v JOIN l ON v.series = l.series)"))
def w2_w5_control_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.control_alerts(view(spark, sf_dir, "v_series"))


@query(
    oracle(
        "v_series",
        "SELECT series, max(n) AS points, CAST(sum((greatest(hi1, lo1) >= 1)::INT) AS BIGINT) AS beyond, CAST(sum((greatest(hi3, lo3) >= 2)::INT) AS BIGINT) AS pairs, CAST(sum((greatest(hi5, lo5) >= 4)::INT) AS BIGINT) AS fours, CAST(sum((greatest(hi8, lo8) >= 8)::INT) AS BIGINT) AS runs, round(avg(passed::INT), 6) AS pass_rate, round(max(mean), 6) AS mean, round(greatest(max(mean - 3 * sigma), 0), 6) AS lower FROM p GROUP BY series",
        LIMITS,
        "p AS (SELECT v.series, value, n, mean, sigma, seq % 3 > 0 AS passed, sum((value > mean + 3 * sigma)::INT) OVER w1 AS hi1, sum((value < mean - 3 * sigma)::INT) OVER w1 AS lo1, sum((value > mean + 2 * sigma)::INT) OVER w3 AS hi3, sum((value < mean - 2 * sigma)::INT) OVER w3 AS lo3, sum((value > mean + 1 * sigma)::INT) OVER w5 AS hi5, sum((value < mean - 1 * sigma)::INT) OVER w5 AS lo5, sum((value > mean + 0 * sigma)::INT) OVER w8 AS hi8, sum((value < mean - 0 * sigma)::INT) OVER w8 AS lo8 FROM v_series v JOIN l ON v.series = l.series WHERE n >= 20 WINDOW w1 AS (PARTITION BY v.series ORDER BY ts, seq ROWS BETWEEN 0 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY v.series ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY v.series ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY v.series ORDER BY ts, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))",
    )
)
def w6_submission_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trend(view(spark, sf_dir, "v_series").withColumn("passed", F.col("seq") % 3 > 0))


@query(oracle("v_decisions", "SELECT finding_id, decision_id, decision_type FROM v_decisions WHERE revoked_at IS NULL QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY decided_at DESC, decision_id DESC) = 1"))
def w7_latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_decisions(view(spark, sf_dir, "v_decisions"))


@query(oracle("v_state", "SELECT job_id, op_idx, last_value(overprint IGNORE NULLS) OVER w AS overprint, round(last_value(alpha IGNORE NULLS) OVER w, 8) AS alpha FROM v_state WINDOW w AS (PARTITION BY job_id ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def w8_carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.carried(view(spark, sf_dir, "v_state"), ["job_id"], ["op_idx"], ["overprint", "alpha"])
    return rows.select("job_id", "op_idx", "overprint", F.round("alpha", 8).alias("alpha"))


@query(oracle("v_images", "SELECT job_id, page_num, image_name FROM v_images QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY page_num, op_idx) = 1"))
def w9_first_image_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per(view(spark, sf_dir, "v_images"), ["job_id"], ["page_num", "op_idx"]).select("job_id", "page_num", "image_name")


@query(oracle("v_jobs", "SELECT job_id, tenant_id, status FROM v_jobs ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 50"))
def k1_job_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.page_of(view(spark, sf_dir, "v_jobs"), [F.col("created_at").desc(), F.col("job_id").desc()], 2, 50).select("job_id", "tenant_id", "status")


# --- sets and settings


@query(
    oracle(
        "v_findings",
        "SELECT job_id, count(*) FILTER (WHERE side = 1) AS missing, count(*) FILTER (WHERE side = 2) AS new, count(*) FILTER (WHERE side = 3) AS same, count(*) FILTER (WHERE side < 3) = 0 AS passed FROM k GROUP BY job_id",
        "k AS (SELECT job_id, inspection_id, severity, page_num, sum(side) AS side FROM (SELECT DISTINCT job_id, inspection_id, severity, page_num, 1 AS side FROM v_findings WHERE ord % 3 <> 0 UNION ALL SELECT DISTINCT job_id, inspection_id, severity, page_num, 2 FROM v_findings WHERE ord % 2 <> 0) GROUP BY ALL)",
    )
)
def d1_regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_findings")
    return A.identity_diff(rows.where("ord % 3 <> 0"), rows.where("ord % 2 <> 0"), "job_id")


@query("""SELECT lang, sha256(string_agg(digest, ',' ORDER BY prefix)) AS fingerprint FROM (
  SELECT lang, substr(hash, 1, 4) AS prefix, sha256(string_agg(hash, ',' ORDER BY hash)) AS digest FROM (SELECT lang, sha256(CAST(doc_id AS VARCHAR)) AS hash FROM documents) GROUP BY ALL) GROUP BY lang""")
def d2_corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fingerprint(table(spark, sf_dir, "documents").select("lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("hash")), "lang")


@query(
    oracle(
        "v_toggles",
        """SELECT tenant_id, CASE WHEN workflow_value IS NOT NULL AND NOT (locked AND tenant_value IS NOT NULL) THEN workflow_value ELSE coalesce(tenant_value, default_value) END AS value,
  CASE WHEN workflow_value IS NOT NULL AND NOT (locked AND tenant_value IS NOT NULL) THEN 'workflow' WHEN tenant_value IS NOT NULL THEN 'tenant' ELSE 'default' END AS provenance FROM v_toggles""",
    )
)
def d4_settings_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.cascade(view(spark, sf_dir, "v_toggles"))


@query(
    "SELECT DISTINCT l_partkey AS partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'"
)
def d6_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    part = lambda flag: rows.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("partkey"))
    return part("R").intersect(part("A"))


# --- joins


@query(
    oracle(
        "v_pages",
        "SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.page_num, b.page_num) AS page_num, CASE WHEN a.job_id IS NULL THEN 'added' WHEN b.job_id IS NULL THEN 'removed' WHEN a.rotate IS DISTINCT FROM b.rotate OR a.tx1 IS DISTINCT FROM b.tx1 THEN 'changed' ELSE 'same' END AS state, CASE WHEN a.job_id IS NOT NULL AND b.job_id IS NOT NULL THEN CAST((a.rotate IS DISTINCT FROM b.rotate)::INT + (a.tx1 IS DISTINCT FROM b.tx1)::INT AS INT) ELSE 0 END AS differences FROM a FULL JOIN b ON a.job_id = b.job_id AND a.page_num = b.page_num",
        "a AS (SELECT job_id, page_num, max(rotate) AS rotate, max(tx1) AS tx1 FROM v_pages WHERE job_id % 5 <> 0 GROUP BY ALL)",
        "b AS (SELECT job_id, page_num, min(rotate) AS rotate, min(tx1) AS tx1 FROM v_pages WHERE job_id % 7 <> 0 GROUP BY ALL)",
    )
)
def j2_compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_pages")
    one = rows.where("job_id % 5 <> 0").groupBy("job_id", "page_num").agg(F.max("rotate").alias("rotate"), F.max("tx1").alias("tx1"))
    two = rows.where("job_id % 7 <> 0").groupBy("job_id", "page_num").agg(F.min("rotate").alias("rotate"), F.min("tx1").alias("tx1"))
    return J.compare_versions(one, two, ["job_id", "page_num"], ["rotate", "tx1"])


_BITS = ", ".join(f"sum({n} >> {b} & 1) AS {n}{b}" for n in ("hi", "lo") for b in range(32))
_VALUE = " + ".join(f"CASE WHEN {n}{b} * 2 > n THEN {1 << (b + base)}::HUGEINT ELSE 0::HUGEINT END" for n, base in (("hi", 32), ("lo", 0)) for b in range(32))


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([^\\s]+)', 1)) AS w FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(w), 9, 8) AS BIGINT) AS lo FROM w),
b AS (SELECT doc_id, count(*) AS n, {_BITS} FROM h GROUP BY doc_id),
p AS (SELECT d.doc_id, coalesce({_VALUE}, 0::HUGEINT) AS phash FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id),
n AS (SELECT phash, min(doc_id) AS ident FROM p GROUP BY phash),
x AS (SELECT a.ident AS one, b.ident AS two, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM n a JOIN n b ON a.ident < b.ident AND bit_count(xor(a.phash, b.phash)) < 5
  UNION ALL SELECT n.ident, p.doc_id, 0 FROM p JOIN n ON p.phash = n.phash AND n.ident < p.doc_id)
SELECT *, (1 - distance / 64) * 100 AS similarity FROM x"""
)
def j5_near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.near_hashes(N.text_hashes(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(
    oracle(
        "v_jobs v_findings",
        "SELECT j.job_id, tenant_id, status, coalesce(findings, '') AS findings FROM v_jobs j LEFT JOIN f ON j.job_id = f.job_id",
        "f AS (SELECT job_id, string_agg(inspection_id || ':' || severity, ',' ORDER BY ord, inspection_id, severity) AS findings FROM v_findings GROUP BY job_id)",
    )
)
def j8_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_states(view(spark, sf_dir, "v_jobs"), view(spark, sf_dir, "v_findings"))


@query(
    oracle(
        "",
        "SELECT l.user_id, l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
        "l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click')",
        "r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')",
    )
)
def j9_as_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    left = rows.where("event_type = 'click'").select("user_id", "event_id", "ts")
    right = rows.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return S.as_of(left, right, "user_id", "ts", "value").select("user_id", "event_id", "value")


# --- streaming, on batch tables


@query("SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY ALL")
def x1_requests_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.requests_per_window(table(spark, sf_dir, "events"), "user_id", "ts", "1 minute", 2)


@query("SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, count(*) > 5 AS over FROM events GROUP BY ALL")
def x2_requests_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.requests_per_window(table(spark, sf_dir, "events"), "user_id", "ts", "1 day", 5)


@query(
    oracle(
        "",
        "SELECT series, seq FROM (SELECT series, seq, count(*) OVER w AS n, sum((NOT success)::INT) OVER w AS bad FROM o WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20 AND bad >= 11",
        "o AS (SELECT user_id AS series, ts, event_id AS seq, value < 40 AS success FROM events)",
    )
)
def x3_outage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), "ts", F.col("event_id").alias("seq"), (F.col("value") < 40).alias("success"))
    return S.outage(rows)


@query(oracle("v_jobs", "SELECT job_id FROM v_jobs WHERE status = 'processing' AND date_diff('second', created_at, TIMESTAMP '1998-01-01 00:00:00') > 720"))
def x4_stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stuck(view(spark, sf_dir, "v_jobs"), F.lit("1998-01-01 00:00:00").cast("timestamp")).select("job_id")


@query(oracle("v_deliveries", "SELECT endpoint_id, event, count(*) AS attempts, bool_or(success) AS delivered, NOT bool_or(success) AND count(*) >= 5 AS dead FROM v_deliveries GROUP BY ALL"))
def x5_delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_deliveries").withColumn("key", F.struct("endpoint_id", "event"))
    return J.delivery_outcomes(rows, "key").select("key.*", "attempts", "delivered", "dead")


@query(oracle("v_deliveries", f"SELECT delivery_id FROM v_deliveries WHERE CASE WHEN event = 'job.error' THEN true WHEN starts_with(event, 'job.c') THEN date_diff('second', created_at, TIMESTAMP '{NOW}') <= 25 * 86400 WHEN starts_with(event, 'job.') THEN date_diff('second', created_at, TIMESTAMP '{NOW}') <= 10 * 86400 ELSE true END"))
def x6_retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("job.*", 10), ("job.c*", 25), ("job.error", None)]
    return J.retained(view(spark, sf_dir, "v_deliveries"), rules, F.lit(NOW).cast("timestamp")).select("delivery_id")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x10_tumbling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sliding(table(spark, sf_dir, "events"), "event_type", "ts", "30 minutes", "30 minutes")


@query(
    """WITH s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def x10_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


# --- fonts and text runs

FONT_SQL = """SELECT job_id, page_num, font, unnest(list_filter([
    CASE WHEN NOT embedded AND subtype <> 'Type3' THEN {'i': 'FONT_001', 's': 'error'} END, CASE WHEN embedded AND NOT subset THEN {'i': 'FONT_002', 's': 'advisory'} END,
    CASE WHEN subtype = 'Type3' THEN {'i': 'FONT_004', 's': 'warning'} END, CASE WHEN NOT has_unicode THEN {'i': 'FONT_005', 's': CASE subtype WHEN 'Type0' THEN 'warning' ELSE 'advisory' END} END,
    CASE WHEN embedded AND fs_type & 2 <> 0 THEN {'i': 'FONT_015', 's': 'advisory'} END, CASE WHEN embedded AND fs_type & 256 <> 0 AND subset THEN {'i': 'FONT_016', 's': 'warning'} END,
    CASE WHEN embedded AND fs_type & 512 <> 0 THEN {'i': 'FONT_017', 's': 'warning'} END], lambda x: x IS NOT NULL)) AS h
  FROM (SELECT *, coalesce(base_font, name) AS font FROM v_fonts QUALIFY row_number() OVER (PARTITION BY job_id, coalesce(base_font, name) ORDER BY page_num, name) = 1)"""


@query(oracle("v_fonts", f"SELECT job_id, page_num, font, h.i AS inspection_id, h.s AS severity FROM ({FONT_SQL})"))
def r3_r4_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.font_rules(view(spark, sf_dir, "v_fonts"))


@query(
    oracle(
        "v_pages v_fonts v_paths",
        """SELECT DISTINCT job_id, page_num FROM v_pages p WHERE NOT EXISTS (FROM v_fonts f WHERE f.subtype = 'Type3' AND f.job_id = p.job_id AND f.page_num = p.page_num)
  AND EXISTS (FROM v_paths q WHERE q.fill AND q.job_id = p.job_id AND q.page_num = p.page_num)""",
    )
)
def r5_pages_without_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.pages_without_fonts(view(spark, sf_dir, "v_pages"), view(spark, sf_dir, "v_fonts").where("subtype = 'Type3'"), view(spark, sf_dir, "v_paths").where("fill"))


TEXT_TESTS = {
    ("TEXT_001", "advisory"): "size_pt >= 4 AND size_pt < 6",
    ("TEXT_002", "warning"): "size_pt > 0 AND size_pt < 4",
    ("TEXT_003", "advisory"): "render_mode = 3",
    ("TEXT_004", "advisory"): "greatest(c, m, y, k) = 0 AND render_mode <> 3",
    ("TEXT_005", "warning"): "c >= 0.99 AND m >= 0.99 AND y >= 0.99 AND k >= 0.99",
    ("TEXT_006", "warning"): "size_pt > 0 AND size_pt < 6 AND (c > 0)::INT + (m > 0)::INT + (y > 0)::INT + (k > 0)::INT > 1",
}
TEXT_SQL = " UNION ALL ".join(f"SELECT job_id, page_num, '{i}' AS inspection_id, '{s}' AS severity, count(*) AS runs, min(size_pt) AS least_pt, min(op_idx) AS first_op FROM v_runs WHERE {t} GROUP BY ALL" for (i, s), t in TEXT_TESTS.items())


@query(oracle("v_runs", TEXT_SQL))
def r7_text_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.text_size_rules(view(spark, sf_dir, "v_runs"))


@query(
    oracle(
        "v_runs",
        "SELECT w.job_id, w.page_num, upright, CAST(sum(n) AS BIGINT) AS inverted FROM w JOIN t ON w.job_id = t.job_id AND w.page_num = t.page_num WHERE runs >= 8 AND most >= 5 AND abs((way - upright + 360) % 360 - 180) <= 5 GROUP BY ALL HAVING sum(n) >= 3",
        "w AS (SELECT job_id, page_num, round(angle / 5) * 5 % 360 AS way, count(*) AS n FROM v_runs WHERE NOT mirrored GROUP BY ALL)",
        "t AS (SELECT job_id, page_num, sum(n) AS runs, max(n) AS most, arg_max(way, {'n': n, 'w': -way}) AS upright FROM w GROUP BY ALL)",
    )
)
def r37_upside_down_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.upside_down(view(spark, sf_dir, "v_runs"))


@query(oracle("v_runs", "SELECT job_id, page_num, count(*) AS mirrored FROM v_runs WHERE mirrored GROUP BY ALL HAVING count(*) >= 3"))
def r37_mirrored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.mirrored_text(view(spark, sf_dir, "v_runs"))


@query(
    oracle(
        "v_runs",
        """SELECT job_id, page_num, font, tenth, op_idx FROM (SELECT job_id, page_num, font, CAST(floor(size_pt * 10) AS BIGINT) AS tenth, min(op_idx) AS op_idx FROM v_runs WHERE size_pt < 5 AND size_pt > 2 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY job_id, page_num ORDER BY tenth, op_idx) <= 5""",
    )
)
def r36_legal_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.legal_copy(view(spark, sf_dir, "v_runs"))


@query(
    oracle(
        "v_text",
        "SELECT t.job_id, page_num, lang, majority FROM v_text t JOIN m ON t.job_id = m.job_id WHERE lang <> majority",
        "m AS (SELECT job_id, arg_min(lang, {'n': -n, 'l': lang}) AS majority FROM (SELECT job_id, lang, count(*) AS n FROM v_text WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY job_id)",
    )
)
def r38_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.language_mix(view(spark, sf_dir, "v_text").drop("text"))


@query(
    oracle(
        "v_marks",
        """SELECT a.job_id, a.page_num, paths, chars, seen FROM (SELECT job_id, page_num, count(*) FILTER (WHERE kind = 'path') AS paths, CAST(coalesce(sum(chars) FILTER (WHERE kind = 'text'), 0) AS BIGINT) AS chars FROM v_marks GROUP BY ALL) a
  JOIN (SELECT job_id, page_num, CAST(sum(chars) AS BIGINT) AS seen FROM v_marks WHERE confidence > 0.5 GROUP BY ALL) b ON a.job_id = b.job_id AND a.page_num = b.page_num WHERE paths >= 50 AND chars <= 10 AND seen > 20""",
    )
)
def r59_outlined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = view(spark, sf_dir, "v_marks")
    return Y.outlined_text(marks, marks)


@query(oracle("v_page_counts", "SELECT job_id, page_num FROM v_page_counts WHERE image_area > 0.25 * area OR (paths >= 50 AND chars <= 10)"))
def e5_pages_to_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.needs_detection(view(spark, sf_dir, "v_page_counts"))


# --- layout and paint order


@query(
    oracle(
        "v_runs",
        """SELECT job_id, page_num, below, y0 AS above FROM (SELECT job_id, page_num, y0, max(y1) OVER (PARTITION BY job_id, page_num ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
  FROM (SELECT DISTINCT job_id, page_num, y0, y1 FROM v_runs)) WHERE y0 - below >= 30""",
    )
)
def r11_empty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.empty_bands(view(spark, sf_dir, "v_runs"))


PAD = f"({5 * R.POINTS_PER_MM!r}::DOUBLE)"


@query(
    oracle(
        "v_runs",
        f"""SELECT r.job_id, r.page_num, r.op_idx, count(*) AS zones FROM v_runs r JOIN v_runs z ON r.job_id = z.job_id AND r.page_num = z.page_num AND z.font = 'signup' AND r.font <> 'signup'
  WHERE r.x0 < z.x1 + {PAD} AND r.x1 > z.x0 - {PAD} AND r.y0 < z.y1 + {PAD} AND r.y1 > z.y0 - {PAD} GROUP BY ALL""",
    )
)
def r53_seal_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.seal_zone_hits(view(spark, sf_dir, "v_runs"), F.col("font") == "signup")


@query(
    oracle(
        "v_state",
        """SELECT job_id, kind AS ink, min(op_idx) AS op_idx, count(*) AS events FROM (SELECT job_id, kind, op_idx, last_value(overprint IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS op FROM v_state)
  WHERE kind IN ('click', 'view') AND NOT coalesce(op, false) GROUP BY ALL""",
    )
)
def r50_cutting_not_overprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = view(spark, sf_dir, "v_state").select("job_id", "op_idx", F.col("kind").alias("ink"), F.col("kind").isin("click", "view").alias("cutting"), "overprint")
    return L.cutting_not_overprinted(state)


@query(oracle("v_runs", "SELECT job_id, page_num, max(op_idx) FILTER (WHERE font = 'click') AS last_cut, max(op_idx) FILTER (WHERE font <> 'click') AS last_art FROM v_runs GROUP BY ALL HAVING last_cut < last_art"))
def r52_cut_below_art(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cut_below_art(view(spark, sf_dir, "v_runs"), F.col("font") == "click")


MM = f"({R.POINTS_PER_MM!r}::DOUBLE)"


@query(oracle("v_runs", f"SELECT job_id, round((max(x1) - min(x0)) / {MM}, 3) AS width_mm, round((max(y1) - min(y0)) / {MM}, 3) AS height_mm FROM v_runs GROUP BY job_id"))
def r54_art_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.art_size(view(spark, sf_dir, "v_runs"))


@query(
    oracle(
        "v_runs",
        """SELECT r.job_id, page_num, op_idx, CASE WHEN x0 >= hx0 AND y0 >= hy0 AND x1 <= hx1 AND y1 <= hy1 THEN 'inside' WHEN x1 <= hx0 OR x0 >= hx1 OR y1 <= hy0 OR y0 >= hy1 THEN 'outside' ELSE 'across' END AS place
  FROM v_runs r JOIN (SELECT job_id, min(x0) AS hx0, min(y0) AS hy0, max(x1) AS hx1, max(y1) AS hy1 FROM v_runs WHERE font = 'click' GROUP BY job_id) h ON r.job_id = h.job_id WHERE font <> 'click'""",
    )
)
def r54_art_against_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.against_hull(view(spark, sf_dir, "v_runs"), F.col("font") == "click")


@query(oracle("v_runs", "SELECT job_id, page_num, min(alpha) AS least_alpha FROM v_runs GROUP BY ALL HAVING bool_or(alpha < 0.9999) AND bool_or(overprint)"))
def r49_transparent_overprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.transparent_overprints(view(spark, sf_dir, "v_runs"))


@query(
    oracle(
        "v_marks",
        """SELECT job_id, page_num, count(*) AS modules, round(avg(side), 4) AS side, round(stddev_pop(side) / avg(side), 4) AS variation, (max(x1) - min(x0)) / (max(y1) - min(y0)) AS aspect
  FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0 + (y1 - y0)) / 2 AS side FROM v_marks) WHERE w BETWEEN 0.5 AND 10 AND h BETWEEN 0.5 AND 10 AND w / h BETWEEN 0.5 AND 2 GROUP BY ALL HAVING count(*) >= 25""",
    )
)
def r60_symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.symbol_candidates(view(spark, sf_dir, "v_marks"))


@query(
    oracle(
        "v_plates",
        """SELECT job_id, plates, process, plates > 6 AS count_high, process > 0 AND plates > process AS mixed, blacks > 0 AS second_black, all_ink FROM (
  SELECT job_id, count(DISTINCT n) FILTER (WHERE n NOT IN ('all', 'none')) AS plates, count(DISTINCT n) FILTER (WHERE n IN ('cyan', 'magenta', 'yellow', 'black')) AS process,
    count(DISTINCT n) FILTER (WHERE n NOT IN ('cyan', 'magenta', 'yellow', 'black', 'all', 'none') AND contains(n, 'black')) AS blacks, bool_or(n = 'all') AS all_ink FROM (SELECT job_id, lower(trim(ink)) AS n FROM v_plates) GROUP BY job_id)""",
    )
)
def r33_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plate_rules(view(spark, sf_dir, "v_plates"))


@query(
    oracle(
        "v_pages",
        """SELECT job_id, count(DISTINCT {'w': w, 'h': h}) AS sizes, bool_or(w > h) AND bool_or(w < h) AS mixed_orientation FROM (
  SELECT job_id, round(CASE WHEN rotate % 180 <> 0 THEN ty1 - ty0 ELSE tx1 - tx0 END) AS w, round(CASE WHEN rotate % 180 <> 0 THEN tx1 - tx0 ELSE ty1 - ty0 END) AS h FROM v_pages WHERE tx0 IS NOT NULL) GROUP BY job_id""",
    )
)
def r23_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_size_rules(view(spark, sf_dir, "v_pages"))


@query("SELECT job_id, seq, previous, level FROM (SELECT user_id AS job_id, event_id AS seq, CAST(event_id * 7 % 6 + 1 AS INT) AS level, lag(CAST(event_id * 7 % 6 + 1 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE level > previous + 1")
def r26_heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 6 + 1).cast("int").alias("level"))
    return L.heading_skips(rows)


@query(oracle("v_fonts", "SELECT job_id, page_num, name FROM v_fonts WHERE subtype = 'Type3' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY page_num, name) = 1"))
def r2_r27_first_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_resource(view(spark, sf_dir, "v_fonts"), F.col("subtype") == "Type3")


# --- agreement


@query(
    oracle(
        "v_findings",
        """SELECT file, count(e) AS expected, count(f) AS found, count(*) FILTER (WHERE e IS NOT NULL AND f IS NOT NULL) AS common,
  round(count(*) FILTER (WHERE e IS NOT NULL AND f IS NOT NULL) / nullif(count(f), 0), 6) AS precision, round(count(*) FILTER (WHERE e IS NOT NULL AND f IS NOT NULL) / nullif(count(e), 0), 6) AS recall
  FROM (SELECT DISTINCT job_id AS file, inspection_id, 1 AS e FROM v_findings WHERE ord <= 4) a FULL JOIN (SELECT DISTINCT job_id AS file, inspection_id, 1 AS f FROM v_findings WHERE source = 'engine') b USING (file, inspection_id) GROUP BY file""",
    )
)
def a17_expected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_findings").withColumnRenamed("job_id", "file")
    return Q.expected_ids(rows.where("ord <= 4"), rows.where("source = 'engine'"))


def _replayed(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    box = [f"CASE WHEN op_idx % 11 > 0 THEN {e} END AS {n}" for e, n in (("x0 / 4", "x0"), ("y0 / 20", "y0"), ("x0 / 4 + 100", "x1"), ("y0 / 20 + 100", "y1"))]
    rows = view(spark, sf_dir, "v_runs").where(f"op_idx % 2 = {side}")
    return rows.selectExpr("job_id AS file", "page_num", "font AS rule", "op_idx AS id", *box, "CASE op_idx % 3 WHEN 0 THEN 'disputed' WHEN 1 THEN 'confirmed' ELSE 'skipped' END AS verdict")


@query()
def a16_u2_replay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.replay_score(Q.replay_matches(_replayed(spark, sf_dir, 0), _replayed(spark, sf_dir, 1), ["file", "page_num", "rule"]))


@query(
    oracle(
        "v_plates",
        """SELECT ink, any_value(jobs) AS jobs, round(max(sqrt((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb))), 4) AS spread FROM v_plates JOIN (
  SELECT ink, count(DISTINCT job_id) AS jobs, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb FROM v_plates GROUP BY ink) USING (ink) WHERE jobs >= 2 GROUP BY ink""",
    )
)
def a18_ink_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ink_spread(view(spark, sf_dir, "v_plates"))


@query(
    oracle(
        "v_fonts v_images",
        """SELECT job_id, fonts, embedded, spaces FROM (SELECT job_id, coalesce(string_agg(DISTINCT base_font, ',' ORDER BY base_font), '') AS fonts, count(DISTINCT base_font) FILTER (WHERE embedded) AS embedded FROM v_fonts GROUP BY job_id) f
  FULL JOIN (SELECT job_id, string_agg(DISTINCT color_space, ',' ORDER BY color_space) AS spaces FROM v_images GROUP BY job_id) s USING (job_id)""",
    )
)
def a10_a11_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.evidence_digest(view(spark, sf_dir, "v_fonts"), view(spark, sf_dir, "v_images"))


@query(
    oracle(
        "v_findings",
        """SELECT job_id, CASE WHEN page_num = 0 AND ord = 1 THEN 'operational' WHEN regexp_matches(inspection_id, '^(META|STRUCT|DOC|ICC)_') THEN 'structural' ELSE 'verifiable' END AS kind, count(*) AS n FROM v_findings GROUP BY ALL""",
    )
)
def e8_verifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when((F.col("page_num") == 0) & (F.col("ord") == 1), "timeout")
    return view(spark, sf_dir, "v_findings").groupBy("job_id", Q.verifiability(F.col("inspection_id"), reason).alias("kind")).agg(F.count("*").alias("n"))


TRIGGERS = {"alcohol": "wine|wein|beer|bier|vin ", "cosmetics": "cream|creme|soap|seife"}
ELEMENTS = {"alcohol": {"warning": "government warning", "strength": "[0-9] ?% ?(vol|abv)", "volume": "[0-9] ?(ml|cl)"}, "cosmetics": {"ingredients": "ingredients|ingr", "period": "[0-9]+ ?m"}}
LABEL_SQL = " UNION ALL ".join(f"SELECT job_id, page_num, '{c}' AS category, '{n}' AS element FROM v_text WHERE regexp_matches(text, '(?i){TRIGGERS[c]}') AND NOT regexp_matches(text, '(?i){p}')" for c, found in ELEMENTS.items() for n, p in found.items())


@query(oracle("v_text", LABEL_SQL))
def r40_label_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.label_requirements(view(spark, sf_dir, "v_text"), TRIGGERS, ELEMENTS)


# --- settings of tenants and jobs

RANK = "CASE {} WHEN 'free' THEN 1 WHEN 'starter' THEN 2 WHEN 'pro' THEN 3 WHEN 'enterprise' THEN 4 END"
SEEN = f"""seen AS (SELECT tenant_id, ruleset_id FROM v_tenants JOIN v_rulesets ON mode = 'all' OR (mode IN ('plan', 'both') AND {RANK.format("plan")} >= {RANK.format("min_plan")} AND (mode = 'plan' OR tenant_id BETWEEN n_nationkey AND n_nationkey * 9))
  OR (mode = 'list' AND tenant_id BETWEEN n_nationkey AND n_nationkey * 9))"""


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rulesets = view(spark, sf_dir, "v_rulesets").withColumn("allowed", F.expr("sequence(CAST(n_nationkey AS BIGINT), CAST(n_nationkey * 9 AS BIGINT))"))
    return P.visible_rulesets(view(spark, sf_dir, "v_tenants"), rulesets)


@query(oracle("v_tenants v_rulesets", "SELECT tenant_id, ruleset_id FROM seen", SEEN))
def e7_visible_rulesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir)


@query(
    oracle(
        "v_tenants v_rulesets v_requests",
        """SELECT job_id, CASE WHEN EXISTS (FROM seen s WHERE s.tenant_id = r.tenant_id AND s.ruleset_id = requested) THEN requested WHEN EXISTS (FROM seen s WHERE s.tenant_id = r.tenant_id AND s.ruleset_id = preferred) THEN preferred ELSE 'default' END AS ruleset_id
  FROM v_requests r""",
        SEEN,
    )
)
def d8_chosen_ruleset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chosen_ruleset(view(spark, sf_dir, "v_requests"), _visible(spark, sf_dir), "default")


@query(
    oracle(
        "v_requests",
        """SELECT job_id, coalesce(a.p_partkey, b.p_partkey, c.p_partkey) AS spec_id FROM v_requests LEFT JOIN k a ON job_spec = a.p_partkey LEFT JOIN k b ON endpoint_spec = b.p_partkey LEFT JOIN k c ON tenant_spec = c.p_partkey""",
        "k AS (SELECT p_partkey FROM part WHERE p_size <= 25)",
    )
)
def d7_chosen_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec_id"), (F.col("p_size") > 25).alias("archived"))
    return P.chosen_spec(view(spark, sf_dir, "v_requests"), specs, ("job_spec", "endpoint_spec", "tenant_spec"))


@query(
    oracle(
        "v_tenants v_plans",
        """SELECT tenant_id, coalesce(tenant_override, CASE WHEN tenant_limit IS DISTINCT FROM plan_limit THEN tenant_limit END, plan_override, plan_limit) AS "limit",
  array_to_string(list_sort(list_distinct(coalesce(plan_features, []) || coalesce(tenant_features, []))), ',') AS features FROM v_tenants t LEFT JOIN v_plans p ON t.plan = p.plan""",
    )
)
def d5_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.entitlements(view(spark, sf_dir, "v_tenants"), view(spark, sf_dir, "v_plans"))


@query(oracle("v_requests", "SELECT job_id, extra FROM (SELECT job_id, list_sort(list_filter(formats, lambda f: NOT list_contains(allowed, f))) AS x, array_to_string(x, ',') AS extra FROM v_requests) WHERE len(x) > 0"))
def e9_formats_outside_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.formats_outside_plan(view(spark, sf_dir, "v_requests"), "formats", "allowed").select("job_id", "extra")


# --- colours, bar codes and words


@query(
    oracle(
        "v_plates",
        """SELECT job_id, CASE WHEN n IN ('all', 'none') THEN 'reserved' WHEN n IN ('cyan', 'magenta', 'yellow', 'black') THEN 'process' WHEN starts_with(n, 'pantone') THEN 'library'
  WHEN regexp_matches(n, 'cut|crease|varnish|foil|emboss|white') THEN 'finishing' WHEN n IS NOT NULL THEN 'spot' END AS class, count(*) AS inks FROM (SELECT job_id, lower(trim(ink)) AS n FROM v_plates) GROUP BY ALL""",
    )
)
def f12_ink_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_plates").groupBy("job_id", K.ink_class(F.col("ink")).alias("class")).agg(F.count("*").alias("inks"))


PAYLOAD = "concat(CASE WHEN p_partkey % 3 = 0 THEN ']C1' ELSE '' END, '01', lpad(CAST(p_partkey * 7919 AS VARCHAR(9)), 13, '0'), CAST(p_partkey % 10 AS VARCHAR(9)), '17', '2', CAST(p_size % 10 AS VARCHAR(9)), lpad(CAST(p_size AS VARCHAR(9)), 2, '0'), CASE WHEN p_size % 7 = 0 THEN 'x1' ELSE '01' END, CASE WHEN p_size % 5 = 0 THEN '99' ELSE '310' END, lpad(CAST(p_partkey AS VARCHAR(9)), 7, '7'), '10', p_brand, chr(29), '21', p_name)"
_VARIABLE, _THREE, _FOUR = "'10', '21', '22', '30', '37', '240', '241', '250', '251', '8200', '8201', '8202'", "'240', '241', '250', '251', '310', '320'", "'8200', '8201', '8202'"


@query(
    f"""WITH RECURSIVE s AS (SELECT p_partkey, regexp_replace({PAYLOAD}, '^(\\]C1|\\]Q3|\\]e0|\x1d)', '') AS rest FROM part),
w AS (SELECT p_partkey, 0 AS n, NULL::VARCHAR AS ai, NULL::VARCHAR AS value, rest FROM s UNION ALL
  SELECT p_partkey, n + 1, kind, CASE WHEN kind = '?' THEN rest WHEN len > 0 THEN substr(body, 1, len) ELSE split_part(body, chr(29), 1) END,
    CASE WHEN kind = '?' THEN '' WHEN len > 0 THEN substr(body, len + 1) WHEN contains(body, chr(29)) THEN substr(body, strpos(body, chr(29)) + 1) ELSE '' END
  FROM (SELECT p_partkey, n, rest, kind, substr(rest, length(kind) + 1) AS body, CASE kind WHEN '00' THEN 18 WHEN '01' THEN 14 WHEN '02' THEN 14 WHEN '20' THEN 2 WHEN '310' THEN 7 WHEN '320' THEN 7 ELSE CASE WHEN kind IN ({_VARIABLE}) THEN 0 ELSE 6 END END AS len
    FROM (SELECT *, CASE WHEN rest[1:4] IN ({_FOUR}) THEN rest[1:4] WHEN rest[1:3] IN ({_THREE}) THEN rest[1:3] WHEN rest[1:2] IN ('00', '01', '02', '10', '11', '12', '13', '15', '16', '17', '20', '21', '22', '30', '37') THEN rest[1:2] ELSE '?' END AS kind FROM w WHERE rest <> '')))
SELECT p_partkey, ai, value, CASE WHEN ai = '?' THEN false WHEN ai IN ('10', '21', '22') THEN regexp_full_match(value, '[!-~]{{1,20}}') WHEN ai IN ('30', '37') THEN regexp_full_match(value, '\\d{{1,8}}') WHEN ai IN ('310', '320') THEN regexp_full_match(value, '[0-5]\\d{{6}}')
  WHEN ai IN ({_FOUR}) THEN regexp_full_match(value, '[!-~]{{1,70}}') WHEN ai IN ({_THREE}) THEN regexp_full_match(value, '[!-~]{{1,30}}') WHEN ai = '00' THEN regexp_full_match(value, '\\d{{18}}') WHEN ai IN ('01', '02') THEN regexp_full_match(value, '\\d{{14}}')
  WHEN ai = '20' THEN regexp_full_match(value, '\\d{{2}}') ELSE regexp_full_match(value, '\\d{{6}}') END AS valid FROM w WHERE n > 0"""
)
def f17_gs1_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("payload", F.expr(PAYLOAD.replace("VARCHAR(9)", "STRING")))
    return rows.select("p_partkey", F.explode(K.gs1_elements(F.col("payload"))).alias("e")).select("p_partkey", "e.*")


@query(
    oracle(
        "v_marks",
        """SELECT *, CASE WHEN score >= 3.5 THEN 'A' WHEN score >= 2.5 THEN 'B' WHEN score >= 1.5 THEN 'C' WHEN score >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT job_id, page_num, count(*) AS bars, min(x0) AS x0, max(x1) AS x1, round(greatest(4 * (1 - stddev_pop(x1 - x0) / avg(x1 - x0)), 0), 4) AS score FROM v_marks GROUP BY ALL HAVING count(*) >= 20)""",
    )
)
def r44_f21_bar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bar_candidates(view(spark, sf_dir, "v_marks"))


@query(
    oracle(
        "v_images",
        """SELECT job_id, min(page_num) FILTER (WHERE color_space = 'DeviceRGB') AS page_num, count(DISTINCT page_num) FILTER (WHERE color_space = 'DeviceRGB') AS pages FROM v_images GROUP BY job_id
  HAVING bool_or(color_space = 'DeviceCMYK') AND bool_or(color_space = 'DeviceRGB')""",
    )
)
def r14_rgb_in_cmyk_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rgb_in_cmyk_jobs(view(spark, sf_dir, "v_images"))


@query(
    oracle(
        "v_paths",
        """SELECT job_id, coverage, page_num, max_coverage FROM (SELECT job_id, page_num, round((c + m + y + k) * 100, 4) AS coverage FROM v_paths QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY round((c + m + y + k) * 100, 4) DESC, page_num) = 1)
  JOIN (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 240.0::DOUBLE WHEN 'O' THEN 300.0::DOUBLE END AS max_coverage FROM orders) USING (job_id) WHERE coverage > max_coverage""",
    )
)
def r16_coverage_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("o_orderstatus") == "F", 240.0).when(F.col("o_orderstatus") == "O", 300.0)
    return K.coverage_over_limit(view(spark, sf_dir, "v_paths"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), limit.alias("max_coverage")))


@query(
    oracle(
        "v_paths",
        """SELECT job_id, count(*) FILTER (WHERE k > 0) AS with_black, count(*) FILTER (WHERE k > 0 AND greatest(c, m, y) = 0) AS pure_black, count(*) FILTER (WHERE least(c, m, y) >= 0.5 AND least(c, m, y) < 0.85) AS weak_black,
  count(*) > 5000 AS many_objects FROM v_paths GROUP BY job_id""",
    )
)
def r21_three_color_press(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.three_color_press(view(spark, sf_dir, "v_paths"))


@query(
    oracle(
        "v_paths",
        f"SELECT DISTINCT job_id, size_pt, contrast, contrast >= CASE WHEN size_pt >= 18 THEN 3 ELSE 4.5 END AS aa, contrast >= CASE WHEN size_pt >= 18 THEN 4.5 ELSE 7 END AS aaa FROM (SELECT job_id, line_width * 30 AS size_pt, round(1.05::DOUBLE / ({LUM} + 0.05::DOUBLE), 6) AS contrast FROM v_rgb)",
        RGB,
    )
)
def r46_text_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.text_contrast(_rgb(view(spark, sf_dir, "v_paths")).withColumn("size_pt", F.col("line_width") * 30))


PALETTE = {"ash": (60.0, 0.0, 0.0), "moss": (40.0, 4.0, 6.0), "rose": (20.0, 8.0, 2.0)}
NEAR = ", ".join(f"{{'distance': round(sqrt((l - {p}) * (l - {p}) + (a - {q}) * (a - {q}) + (b - {r}) * (b - {r})), 4), 'name': '{k}'}}" for k, (p, q, r) in PALETTE.items())


@query(oracle("v_plates", f"SELECT ink, l, a, b, near.distance AS distance, near.name AS name FROM (SELECT *, list_min([{NEAR}]) AS near FROM (SELECT DISTINCT ink, l, a, b FROM v_plates)) WHERE near.distance > 3"))
def r45_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    colors = view(spark, sf_dir, "v_plates").select("ink", "l", "a", "b").distinct()
    return K.nearest_in_palette(colors, PALETTE, C.delta_e76)


@query(oracle("v_text", "SELECT job_id, page_num, array_to_string(f, '|') AS dimensions FROM (SELECT job_id, page_num, list_sort(list_distinct(regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)? ?(?:mm|cm|pt))', 1))) AS f FROM v_text) WHERE len(f) >= 2"))
def r35_dimension_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dimension_callouts(view(spark, sf_dir, "v_text"))


ODD_WORD, KNOWN_WORDS = "[a-zA-Z]*[bcdfghjklmnpqrstvwxz]{5,}[a-zA-Z]*", ("rhythms", "strengths")


@query(
    oracle(
        "v_text",
        f"""SELECT job_id, page_num, word, count(*) AS n FROM (SELECT job_id, page_num, unnest(regexp_extract_all(text, '({ODD_WORD})', 1)) AS word FROM v_text) WHERE lower(word) NOT IN {KNOWN_WORDS} GROUP BY job_id, page_num, word
  QUALIFY row_number() OVER (PARTITION BY job_id, page_num ORDER BY count(*) DESC, word) <= 10""",
    )
)
def r39_suspicious_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.suspicious_words(view(spark, sf_dir, "v_text"), ODD_WORD, KNOWN_WORDS)


@query(
    oracle(
        "v_runs",
        """SELECT a.job_id, a.page_num, a.op_idx, count(*) AS boxes, max((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS area FROM v_runs a JOIN v_runs b ON a.job_id = b.job_id AND a.page_num = b.page_num
  WHERE a.font = 'view' AND b.font = 'error' AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY ALL""",
    )
)
def r51_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view(spark, sf_dir, "v_runs")
    return K.overlaps(runs.where("font = 'view'"), runs.where("font = 'error'"))
