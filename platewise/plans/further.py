"""Registered queries on spot reach, label sheets, food labels, folded settings, stage percentiles and stored rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import families as R
from platewise.operators import findings as A
from platewise.operators import jobs as J
from platewise.operators import labels as B
from platewise.operators import lattice as N
from platewise.operators import layout as L
from platewise.operators import predicates as P
from platewise.operators import settings as T
from platewise.operators import typography as Y
from platewise.plans.registry import query
from platewise.plans.views import VIEWS, oracle, table, view

# --- spot inks and a gamut

VIEWS["v_gamut"] = "SELECT concat('g', CAST(p_partkey AS VARCHAR(9))) AS name, CAST(p_size * 2 AS DOUBLE) AS l, CAST(p_partkey * 13 % 50 - 20 AS DOUBLE) AS a, CAST(p_partkey * 7 % 40 - 15 AS DOUBLE) AS b FROM {part}"
_REACH = """n AS (SELECT l, a, b, min({'d': d, 'n': name}).d AS distance, min({'d': d, 'n': name}).n AS name FROM (SELECT c.l, c.a, c.b, g.name, sqrt((c.l - g.l) * (c.l - g.l) + (c.a - g.a) * (c.a - g.a) + (c.b - g.b) * (c.b - g.b)) AS d FROM (SELECT DISTINCT l, a, b FROM v_plates) c, v_gamut g) GROUP BY ALL),
r AS (SELECT DISTINCT job_id, ink, CASE WHEN distance < 3 THEN 'achievable' WHEN distance < 6 THEN 'marginal' ELSE 'not_achievable' END AS status, CASE WHEN distance >= 6 THEN 'warning' ELSE 'advisory' END AS severity, name, round(distance, 6) AS distance FROM v_plates p JOIN n ON p.l = n.l AND p.a = n.a AND p.b = n.b)"""


def _reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.spot_reach(view(spark, sf_dir, "v_plates"), view(spark, sf_dir, "v_gamut"))


@query(oracle("v_plates v_gamut", "SELECT status, severity, name, distance, count(*) AS inks FROM r GROUP BY ALL", _REACH))
def r20_spot_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reach(spark, sf_dir).groupBy("status", "severity", "name", "distance").agg(F.count("*").alias("inks"))


@query(oracle("v_plates v_gamut", "SELECT job_id, count(*) AS inks, count(*) FILTER (WHERE status = 'not_achievable') AS outside, round(outside / inks, 6) AS share, CASE WHEN outside > 0 THEN 'warning' ELSE 'advisory' END AS severity FROM r GROUP BY job_id", _REACH))
def r15_reach_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.reach_totals(_reach(spark, sf_dir))


# --- sheets of labels

VIEWS["v_labels"] = """SELECT l_orderkey AS job_id, CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END AS page_num, CAST(l_linenumber % 4 * 110 + CASE WHEN l_orderkey % 5 = 0 THEN l_partkey % 90 ELSE 0 END AS DOUBLE) AS x0, CAST(floor(l_linenumber / 4) * 90 + CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey % 70 ELSE 0 END AS DOUBLE) AS y0,
      CAST(l_linenumber % 4 * 110 + CASE WHEN l_orderkey % 5 = 0 THEN l_partkey % 90 ELSE 0 END + 100 AS DOUBLE) AS x1, CAST(floor(l_linenumber / 4) * 90 + CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey % 70 ELSE 0 END + CASE WHEN l_suppkey % 4 = 0 THEN 60 ELSE 80 END AS DOUBLE) AS y1 FROM {lineitem}"""
_VOTES = "{0} AS (SELECT job_id, page_num, width, height, min({{'v': -n, 's': {0}}}).s AS step, max(n) AS votes, sum(n) AS every FROM (SELECT job_id, page_num, width, height, {0}, count(*) AS n FROM v WHERE {0} IS NOT NULL GROUP BY ALL) GROUP BY ALL)"
_GROUP = "g.job_id = {0}.job_id AND g.page_num = {0}.page_num AND g.width = {0}.width AND g.height = {0}.height"


@query(
    oracle(
        "v_labels",
        f"""SELECT g.job_id, g.page_num, g.width, g.height, boxes, columns, rows, dx.step AS step_x, dy.step AS step_y FROM g LEFT JOIN dx ON {_GROUP.format("dx")} LEFT JOIN dy ON {_GROUP.format("dy")} WHERE boxes >= 3 AND coalesce(dx.votes, 0) + coalesce(dy.votes, 0) >= 2
  AND coalesce(dx.votes, 0) + coalesce(dy.votes, 0) >= 0.8 * (coalesce(dx.every, 0) + coalesce(dy.every, 0)) AND coalesce(dx.every, 0) + coalesce(dy.every, 0) >= 0.8 * (boxes - greatest(columns, rows)) AND columns * rows >= boxes AND boxes >= 0.8 * columns * rows""",
        "b AS (SELECT DISTINCT job_id, page_num, round(x0) AS x, round(y0) AS y, round(x1 - x0) AS width, round(y1 - y0) AS height FROM v_labels)",
        "v AS (SELECT *, x - lag(x) OVER (PARTITION BY job_id, page_num, width, height, y ORDER BY x) AS dx, y - lag(y) OVER (PARTITION BY job_id, page_num, width, height, x ORDER BY y) AS dy FROM b)",
        "g AS (SELECT job_id, page_num, width, height, count(*) AS boxes, count(DISTINCT x) AS columns, count(DISTINCT y) AS rows FROM b GROUP BY ALL)",
        _VOTES.format("dx"), _VOTES.format("dy"),
    )
)
def r11_step_and_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.step_and_repeat(view(spark, sf_dir, "v_labels"))


# --- food labels

VIEWS["v_food"] = """SELECT p_size AS job_id, p_partkey AS page_num, p_partkey % 6 = 0 AS bold, concat(CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Ingredients: ' WHEN 1 THEN 'ingredient list ' WHEN 2 THEN 'Our ingredients ' ELSE '' END, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'Wheat flour, ' WHEN 1 THEN 'OATS, ' WHEN 2 THEN 'Gluten Free barley and ' ELSE 'sugar, ' END, p_name,
      CASE CAST(p_size % 3 AS INT) WHEN 0 THEN ' skimmed milk, eggs' WHEN 1 THEN ' brazil nuts. May contain soya, celery' ELSE ' SO2' END, CASE WHEN p_size % 7 = 0 THEN repeat(' lorem', 30) ELSE ' ' END, ' Traces of fish ', p_brand, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN ' Energy 100 kJ, Fat 2, saturates 1, carbohydrate 3, sugars 1, protein 4, salt 0'
      WHEN 1 THEN ' energy 90 kcal salt 1 fat 3 Protein 2 sugars 9' WHEN 2 THEN ' 200 kcal, Sugars, Carbohydrate' WHEN 3 THEN ' fat salt' ELSE ' Energy Salt' END) AS text FROM {part}"""
_ORDER = ", ".join(f"{{'name': '{n}', 'at': CASE WHEN regexp_matches(text, '(?i)\\b{n}\\b') THEN length(regexp_extract(text, '(?is)^(.*?)\\b{n}\\b', 1)) + 1 ELSE 0 END}}" for n in B.NUTRIENTS)


@query(
    oracle(
        "v_food",
        "SELECT job_id, page_num, there[i].name AS first, there[i + 1].name AS second, CAST(len(there) AS INT) AS found, CAST(kept AS INT) AS kept FROM k WHERE i IS NOT NULL",
        f"t AS (SELECT job_id, page_num, list_filter([{_ORDER}], lambda x: x.at > 0) AS there FROM v_food WHERE regexp_matches(text, '(?i)\\b(?:energy|kj|kcal)\\b'))",
        """k AS (SELECT *, list_filter(range(1, len(there)), lambda n: there[n].at > there[n + 1].at)[1] AS i,
  list_max(list_transform(range(1, 1 << len(there)), lambda s: CASE WHEN len(list_filter(range(1, len(there)), lambda n: (s >> (n - 1)) & 1 = 1 AND coalesce(list_min(list_transform(list_filter(range(n + 1, len(there) + 1), lambda m: (s >> (m - 1)) & 1 = 1), lambda m: there[m].at)), 1 << 30) < there[n].at)) = 0 THEN bit_count(s) ELSE 0 END)) AS kept FROM t)""",
    )
)
def r41_nutrient_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nutrient_order(view(spark, sf_dir, "v_food"))


_CLAIMS, _ANCHORS = B.CLAIMS, B.ANCHORS
_HITS = " UNION ALL ".join(
    f"SELECT job_id, page_num, text, '{name}' AS allergen, unnest(list_transform(regexp_extract_all(text, '((?i)\\b(?:{p})\\b)', 1), lambda w, i: {{'w': w, 'at': CAST(1 + list_sum(list_transform(string_split_regex(text, '(?i)\\b(?:{p})\\b')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '((?i)\\b(?:{p})\\b)', 1)[1:i - 1], lambda x: length(x))), 0) AS INT)}})) AS h FROM f"
    for name, p in B.ALLERGENS.items()
)


@query(
    oracle(
        "v_food",
        f"""SELECT job_id, page_num, allergen, h.at AS at_char, h.w AS word FROM h WHERE upper(h.w) <> h.w AND regexp_matches(substr(text, greatest(h.at - 120, 1), h.at + length(h.w) + 120 - greatest(h.at - 120, 1)), '{_ANCHORS}')
  AND NOT regexp_matches(substr(text, greatest(h.at - 40, 1), h.at + length(h.w) + 40 - greatest(h.at - 40, 1)), '{_CLAIMS}')""",
        "f AS (SELECT * FROM v_food WHERE regexp_matches(text, '(?i)\\bingredients?\\b') AND NOT bold)",
        f"h AS ({_HITS})",
    )
)
def r41_allergen_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.allergen_emphasis(view(spark, sf_dir, "v_food")).withColumnRenamed("at", "at_char")


# --- folded settings

VIEWS["v_layered"] = """SELECT c_custkey AS tenant_id, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'replace' WHEN 1 THEN 'union' WHEN 2 THEN 'merge' ELSE 'odd' END AS strategy, r_name AS d, CASE WHEN c_custkey % 3 > 0 THEN n_name END AS t, CASE WHEN c_custkey % 5 > 1 THEN c_mktsegment END AS w, c_custkey % 7 = 0 AS locked
      FROM {customer} AS cu JOIN {nation} AS na ON c_nationkey = n_nationkey JOIN {region} AS re ON n_regionkey = r_regionkey"""


@query(
    oracle(
        "v_layered",
        """SELECT tenant_id, array_to_string(CASE WHEN strategy = 'merge' THEN [] WHEN strategy = 'union' AND NOT ends THEN list_filter([d, 'base', t, w], lambda x: x IS NOT NULL) WHEN ends THEN [t] ELSE CASE WHEN w IS NOT NULL THEN [w] WHEN t IS NOT NULL THEN [t] ELSE [d, 'base'] END END, ';') AS items,
  array_to_string(CASE WHEN strategy <> 'merge' THEN [] WHEN ends THEN ['k=' || t] ELSE ['b=' || d, 'k=' || coalesce(w, t, d)] END, ';') AS entries,
  array_to_string(CASE strategy WHEN 'merge' THEN CASE WHEN ends THEN ['k:tenant'] ELSE ['b:default', 'k:' || CASE WHEN w IS NOT NULL THEN 'workflow' WHEN t IS NOT NULL THEN 'tenant' ELSE 'default' END] END
    WHEN 'union' THEN CASE WHEN ends THEN [t || ':tenant'] ELSE list_sort(list_filter([d || ':default', 'base:default', t || ':tenant', w || ':workflow'], lambda x: x IS NOT NULL)) END
    ELSE CASE WHEN ends THEN [t || ':tenant'] WHEN w IS NOT NULL THEN [w || ':workflow'] WHEN t IS NOT NULL THEN [t || ':tenant'] ELSE list_sort([d || ':default', 'base:default']) END END, ';') AS source FROM (SELECT *, locked AND t IS NOT NULL AS ends FROM v_layered)""",
    )
)
def d4_folded_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)

    def layer(name: str, items, entries, locked=None):
        return F.struct(F.lit(name).alias("name"), items.alias("items"), entries.alias("entries"), (F.lit(False) if locked is None else locked).alias("locked"))

    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    key = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("k"), F.col(c)))
    merge = F.col("strategy") == "merge"
    layers = F.array(
        layer("default", F.when(~merge, F.array("d", F.lit("base"))), F.when(merge, F.create_map(F.lit("k"), F.col("d"), F.lit("b"), F.col("d")))),
        layer("tenant", F.when(~merge, one("t")), F.when(merge, key("t")), F.col("locked")),
        layer("workflow", F.when(~merge, one("w")), F.when(merge, key("w"))), layer("call", none.cast("array<string>"), none.cast("map<string,string>")),
    )
    folded = T.folded_settings(view(spark, sf_dir, "v_layered").select("tenant_id", "strategy", layers.alias("layers")), ["tenant_id"])
    text = lambda c, sep: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(sep), e["value"]))), ";")
    return folded.select("tenant_id", F.array_join("items", ";").alias("items"), text("entries", "=").alias("entries"), text("source", ":").alias("source"))


# --- percentiles by stage

_STAGES = {"parse": "o_totalprice / 100", "rules": "o_totalprice * (o_orderkey % 13 + 1)", "report": "CAST(o_orderkey % 500 AS DOUBLE)"}


@query("SELECT stage, count(*) AS n, true AS near50, true AS near90, true AS near99 FROM (SELECT unnest(['parse', 'rules', 'report']) AS stage FROM orders) GROUP BY stage")
def a15_stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all days rolled up from daily sketches, and whether their true ranks in all durations are within the sketch's error."""
    entries = F.create_map(*[x for k, e in _STAGES.items() for x in (F.lit(k), F.expr(e))])
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), entries.alias("stages"))
    told = J.stage_percentiles(J.stage_sketches(jobs), ["stage"])
    rows = jobs.select(F.explode("stages").alias("stage", "ms")).join(F.broadcast(told.drop("n")), "stage")
    # a value that repeats has a range of ranks
    near = lambda p: ((F.count_if(F.col("ms") < F.col(f"p{p}")) / F.count("*") - p / 100 <= J.RANK_ERROR) & (p / 100 - F.count_if(F.col("ms") <= F.col(f"p{p}")) / F.count("*") <= J.RANK_ERROR)).alias(f"near{p}")
    return rows.groupBy("stage").agg(F.count("*").alias("n"), near(50), near(90), near(99))


# --- stored rules

STORED = """[
 {"id": "HOUSE_001", "severity": "error", "test": {"all": [{"is": "coverage_above", "percent": 280}, {"not": {"is": "registration"}}]}},
 {"id": "HOUSE_002", "severity": "warning", "test": {"any": [{"is": "hairline", "points": 0.3}, {"is": "zero_width"}]}},
 {"id": "HOUSE_003", "severity": "advisory", "test": {"all": [{"is": "inks_above", "inks": 3}, {"col": "op_idx", "gte": 100, "lt": 300}, {"col": "fill", "eq": true}]}},
 {"id": "HOUSE_004", "severity": "warning", "test": {"all": [{"is": "pure_black"}, {"col": "page_num", "not_in": [1, 2]}, {"col": "x0", "missing": false}]}}
]"""


@query(
    oracle(
        "v_paths",
        """SELECT job_id, page_num, op_idx, 'HOUSE_001' AS inspection_id, 'error' AS severity FROM v_paths WHERE (c + m + y + k) * 100 > 280 AND NOT least(c, m, y, k) >= 0.99 UNION ALL SELECT job_id, page_num, op_idx, 'HOUSE_002', 'warning' FROM v_paths WHERE NOT fill AND line_width < 0.3
  UNION ALL SELECT job_id, page_num, op_idx, 'HOUSE_003', 'advisory' FROM v_paths WHERE c > 0 AND m > 0 AND y > 0 AND k > 0 AND op_idx BETWEEN 100 AND 299 AND fill UNION ALL SELECT job_id, page_num, op_idx, 'HOUSE_004', 'warning' FROM v_paths WHERE k > 0 AND greatest(c, m, y) = 0 AND page_num > 2""",
    )
)
def f15_stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply_stored(view(spark, sf_dir, "v_paths"), P.stored_rules(STORED), "job_id", "page_num", "op_idx")


# --- images and strokes as they are stored

VIEWS["v_image_data"] = """SELECT l_orderkey AS job_id, l_linenumber AS page_num, l_partkey AS seq, split(CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'LZWDecode' WHEN 1 THEN 'JPXDecode' WHEN 2 THEN 'ASCIIHexDecode' WHEN 3 THEN 'ASCII85Decode,FlateDecode' ELSE 'DCTDecode' END, ',') AS filters,
      l_suppkey % 9 = 0 AS inline_image, CASE WHEN l_suppkey % 5 = 0 THEN 16 ELSE 8 END AS bits, l_partkey % 29 = 0 AS opi, l_partkey % 31 = 0 AS alternates FROM {lineitem}"""
VIEWS["v_strokes"] = """SELECT l_orderkey AS job_id, l_linenumber AS page_num, CAST(l_partkey % 1000 AS INT) AS op_idx, l_linestatus = 'O' AS stroke, l_linestatus = 'F' AS fill, round(l_discount * 12, 2) AS line_width, CAST(l_suppkey % 3 AS INT) AS line_cap, CASE WHEN l_suppkey % 4 = 0 THEN l_tax * 0 ELSE round(l_discount * 9, 2) END AS c, l_tax * 0 AS m,
      CASE WHEN l_suppkey % 4 = 0 THEN l_tax * 0 ELSE round(l_tax * 5, 2) END AS y, l_tax * 0 AS k, CASE WHEN l_partkey % 3 = 0 THEN l_tax END AS stroke_alpha, CASE WHEN l_partkey % 7 = 0 THEN l_tax * 0 + 1 END AS stroke_grey, CAST(l_partkey % 4 AS DOUBLE) / 2 AS flatness, CAST(floor(l_extendedprice / 5) AS INT) AS point_count FROM {lineitem}"""


@query(
    oracle(
        "v_image_data",
        """SELECT job_id, page_num, seq, 'IMG_004' AS inspection_id, 'advisory' AS severity FROM v_image_data WHERE seq % 6 = 2 UNION ALL SELECT job_id, page_num, seq, 'IMG_005', 'advisory' FROM v_image_data WHERE inline_image UNION ALL SELECT job_id, page_num, seq, 'IMG_007', 'warning' FROM v_image_data WHERE seq % 6 = 0
  UNION ALL SELECT job_id, page_num, seq, 'IMG_008', 'advisory' FROM v_image_data WHERE seq % 6 = 1 UNION ALL SELECT job_id, page_num, seq, 'IMG_009', 'advisory' FROM v_image_data WHERE bits = 16 UNION ALL SELECT job_id, page_num, seq, 'IMG_010', 'error' FROM v_image_data WHERE opi UNION ALL SELECT job_id, page_num, seq, 'IMG_011', 'warning' FROM v_image_data WHERE alternates""",
    )
)
def r1_image_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fused(view(spark, sf_dir, "v_image_data"), R.image_data_rules(), "job_id", "page_num", "seq")


@query(
    oracle(
        "v_strokes",
        """SELECT job_id, page_num, op_idx, 'STROKE_003' AS inspection_id, 'advisory' AS severity FROM v_strokes WHERE stroke AND line_width > 0 AND line_width < 0.5 AND line_cap = 0 UNION ALL SELECT job_id, page_num, op_idx, 'STROKE_007', 'advisory' FROM v_strokes WHERE stroke AND line_width BETWEEN 0.5 AND 1 AND c > 0 AND y > 0
  UNION ALL SELECT job_id, page_num, op_idx, 'STROKE_005', 'warning' FROM v_strokes WHERE stroke AND (stroke_alpha = 0 OR (stroke_alpha IS NULL AND line_width > 0 AND stroke_grey = 1)) UNION ALL SELECT job_id, page_num, op_idx, 'STROKE_006', 'advisory' FROM v_strokes WHERE stroke AND flatness IN (0.5, 1.5)
  UNION ALL SELECT job_id, page_num, op_idx, 'PATH_001', 'warning' FROM v_strokes WHERE point_count > 10000 UNION ALL SELECT job_id, page_num, min(op_idx), 'PATH_002', 'advisory' FROM v_strokes WHERE fill AND c = 0 AND y = 0 GROUP BY job_id, page_num""",
    )
)
def r6_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_strokes")
    return R.fused(rows, R.line_rules(), "job_id", "page_num", "op_idx").unionByName(R.white_fills(rows))


# --- versions and baselines


@query(
    oracle(
        "v_fonts",
        """SELECT job_id, page_num, array_to_string(list_sort(list(name) FILTER (WHERE NOT a)), ',') AS added, array_to_string(list_sort(list(name) FILTER (WHERE NOT b)), ',') AS removed FROM (SELECT job_id, page_num, name, bool_or(fs_type % 5 > 0) AS a, bool_or(fs_type % 4 > 0) AS b FROM v_fonts GROUP BY ALL) WHERE a <> b GROUP BY job_id, page_num""",
    )
)
def j2_compare_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_fonts")
    return J.compare_names(rows.where("fs_type % 5 > 0"), rows.where("fs_type % 4 > 0"), ["job_id", "page_num"], "name").select("job_id", "page_num", F.nullif("added", F.lit("")).alias("added"), F.nullif("removed", F.lit("")).alias("removed"))


_K = "k AS (SELECT job_id, inspection_id, severity, page_num, bool_or(job_id % 4 > 0 AND ord % 3 <> 0) AS e, bool_or(ord % 2 <> 0) AS a FROM v_findings GROUP BY ALL)"


@query(
    oracle(
        "v_findings v_jobs",
        """SELECT j.job_id, count(*) FILTER (WHERE e AND NOT a) AS missing, CASE WHEN bool_or(e) THEN count(*) FILTER (WHERE a AND NOT e) ELSE 0 END AS new, CASE WHEN bool_or(e) THEN count(*) FILTER (WHERE a AND e) ELSE count(*) FILTER (WHERE a) END AS same, NOT coalesce(bool_or(e), false) AS bootstrapped, missing = 0 AND new = 0 AS passed
  FROM (SELECT DISTINCT job_id FROM v_jobs) j LEFT JOIN k ON j.job_id = k.job_id GROUP BY j.job_id""",
        _K,
    )
)
def d1_regression_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_findings")
    return A.regression_run(rows.where("job_id % 4 > 0 AND ord % 3 <> 0"), rows.where("ord % 2 <> 0"), view(spark, sf_dir, "v_jobs"))


@query(oracle("v_findings", "SELECT job_id, inspection_id, severity, page_num FROM (SELECT *, bool_or(e) OVER (PARTITION BY job_id) AS known FROM k) WHERE e OR (a AND NOT known)", _K))
def d1_adopted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_findings")
    return A.adopted(rows.where("job_id % 4 > 0 AND ord % 3 <> 0"), rows.where("ord % 2 <> 0"))


# --- font programs

VIEWS["v_font_data"] = """SELECT l_orderkey AS job_id, l_linenumber AS page_num, concat(p_name, CAST(p_partkey AS VARCHAR(9))) AS name, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN concat(p_brand, ' Bold') WHEN 2 THEN concat(p_brand, '-Oblique') WHEN 3 THEN concat(p_brand, CAST(p_partkey AS VARCHAR(9)), 'MM') ELSE concat(p_brand, CAST(p_partkey AS VARCHAR(9))) END AS base_font,
      CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'Type1' WHEN 1 THEN 'TrueType' WHEN 2 THEN 'Type0' WHEN 3 THEN 'Type3' ELSE 'MMType1' END AS subtype, p_size % 3 > 0 AS embedded, p_partkey % 14 = 0 AS standard_14, CASE WHEN p_partkey % 3 > 0 THEN 'WinAnsi' END AS encoding, CASE WHEN p_partkey % 4 > 0 THEN 'Adobe' END AS cid_info,
      p_size % 4 > 0 AS descriptor, split(CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'FontFile' WHEN 1 THEN 'FontFile2' ELSE 'FontFile3' END, ',') AS files, CASE WHEN p_size % 2 = 0 THEN p_size * 20 END AS weight, CASE WHEN p_size % 7 = 0 THEN p_partkey % 300 END AS stem_v, CAST(p_partkey % 3 - 1 AS DOUBLE) * 12 AS italic_angle FROM {lineitem} AS li JOIN {part} AS pa ON l_partkey = p_partkey"""


@query(
    oracle(
        "v_font_data",
        """SELECT job_id, page_num, font, 'FONT_003' AS inspection_id, 'advisory' AS severity FROM f WHERE standard_14 UNION ALL SELECT job_id, page_num, font, 'FONT_006', 'warning' FROM f WHERE subtype = 'Type0' AND cid_info IS NULL UNION ALL SELECT job_id, page_num, font, 'FONT_007', 'advisory' FROM f WHERE encoding IS NULL AND subtype IN ('Type1', 'TrueType', 'MMType1')
  UNION ALL SELECT job_id, page_num, font, 'FONT_008', 'error' FROM f WHERE subtype = 'TrueType' AND NOT embedded UNION ALL SELECT job_id, page_num, font, 'FONT_009', 'error' FROM f WHERE subtype = 'Type0' AND NOT embedded UNION ALL SELECT job_id, page_num, font, 'FONT_010', 'warning' FROM f WHERE descriptor AND len(files) = 0
  UNION ALL SELECT job_id, page_num, font, 'FONT_011', 'warning' FROM f WHERE subtype = 'MMType1' OR base_font LIKE '%MM' UNION ALL SELECT job_id, page_num, font, 'FONT_012', 'advisory' FROM f WHERE descriptor AND (coalesce(weight, 0) >= 700 OR coalesce(stem_v, 0) > 165) AND coalesce(base_font, '') NOT ILIKE '%bold%'
  UNION ALL SELECT job_id, page_num, font, 'FONT_013', 'advisory' FROM f WHERE descriptor AND italic_angle <> 0 AND coalesce(base_font, '') NOT ILIKE '%italic%' AND coalesce(base_font, '') NOT ILIKE '%oblique%' UNION ALL SELECT job_id, page_num, font, 'FONT_014', 'warning' FROM f WHERE (subtype = 'Type1' AND files[1] <> 'FontFile') OR (subtype = 'TrueType' AND files[1] <> 'FontFile2')""",
        "f AS (SELECT *, coalesce(base_font, name) AS font FROM v_font_data QUALIFY row_number() OVER (PARTITION BY job_id, coalesce(base_font, name) ORDER BY page_num, name) = 1)",
    )
)
def r3_font_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.font_program_rules(view(spark, sf_dir, "v_font_data"))


# --- plates

VIEWS["v_plate_names"] = """SELECT l_orderkey AS job_id, CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN ' /Dieline' WHEN 1 THEN 'Cut Contour' WHEN 2 THEN 'All' WHEN 3 THEN 'Rich-Black' WHEN 4 THEN 'Process Cyan' WHEN 5 THEN 'Varnish' WHEN 6 THEN 'Black' ELSE concat('PMS ', CAST(l_suppkey % 40 AS VARCHAR(9))) END AS ink,
      CASE WHEN l_suppkey % 2 = 0 THEN 'DeviceN' ELSE 'Separation' END AS cs_type, l_orderkey % 3 = 0 AS cmyk, l_orderkey % 5 = 0 AS black FROM {lineitem}"""


@query(
    oracle(
        "v_plate_names",
        """SELECT job_id, ink, 'COLOR_DUPLICATE_K_SPOT' AS inspection_id, 'advisory' AS severity FROM n WHERE ink = 'rich_black' AND (cmyk OR black) UNION ALL SELECT job_id, ink, 'COLOR_ALL_SEPARATION', 'warning' FROM n WHERE ink = 'all' UNION ALL SELECT job_id, ink, 'COLOR_DEVICEN_CMYK_NAMED', 'warning' FROM n WHERE many AND ink IN ('process_cyan', 'black')
  UNION ALL SELECT job_id, NULL, 'COLOR_PLATE_COUNT_HIGH', 'advisory' FROM j WHERE CASE WHEN cmyk THEN 4 WHEN black THEN 1 ELSE 0 END + spots > 6 UNION ALL SELECT job_id, NULL, 'COLOR_DIELINE_PRINTABLE', 'advisory' FROM j WHERE dies > 0 AND steps = 0 UNION ALL SELECT job_id, NULL, 'COLOR_MIXED_SPOT_PROCESS', 'advisory' FROM j WHERE cmyk AND spots IN (1, 2)""",
        "n AS (SELECT job_id, cmyk, black, replace(replace(lower(trim(ltrim(ink, ' /'))), ' ', '_'), '-', '_') AS ink, bool_or(cs_type = 'DeviceN') AS many FROM v_plate_names GROUP BY ALL)",
        "j AS (SELECT job_id, cmyk, black, count(*) FILTER (WHERE ink LIKE 'pms%' OR ink = 'rich_black') AS spots, count(*) FILTER (WHERE ink IN ('dieline', 'cut_contour')) AS dies, count(*) FILTER (WHERE ink = 'varnish') AS steps FROM n GROUP BY ALL)",
    )
)
def r33_plate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_plate_names")
    used = rows.groupBy("job_id").agg(F.bool_or("cmyk").alias("cmyk"), F.bool_or("black").alias("black"))
    return L.plate_findings(rows, used)
