"""Registered queries of the rule tables, the family registry, sources and further operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import color as C
from platewise.functions import geometry as G
from platewise.functions import text as T
from platewise.operators import families as R
from platewise.operators import findings as A
from platewise.operators import similarity as N
from platewise.operators import standards as D
from platewise.operators import typography as Y
from platewise.operators.registry import Families
from platewise.plans.registry import ORACLES, query
from platewise.plans.views import oracle, table, view
from platewise.sources import readers as Z

# --- rule tables


def _sql(source: str, rules: tuple[D.Rule, ...], *keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(keep)}, '{name}' AS inspection_id, '{severity}' AS severity FROM {source} WHERE {test}" for name, severity, test in rules)


def _rules(name: str, source: str, rules: tuple[D.Rule, ...], *keep: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.apply_rules(view(spark, sf_dir, source), rules, *keep)

    run.__name__ = name
    return query(oracle(source, _sql(source, rules, *keep)))(run)


r24_metadata = _rules("r24_metadata", "v_docs", D.METADATA, "job_id")
r23_documents = _rules("r23_documents", "v_docs", D.DOCUMENT, "job_id")
r25_structure = _rules("r25_structure", "v_docs", D.STRUCTURE, "job_id")
r8_annotations = _rules("r8_annotations", "v_annotations", D.ANNOTATION, "job_id", "page_num", "seq")
r28_layers = _rules("r28_layers", "v_layers", D.LAYER, "job_id", "name")


# The SQL of the next queries is written out from what the rules mean, not from the tables of predicates.


@query(
    oracle(
        "v_docs",
        """SELECT job_id, 'ACCESS_001' AS inspection_id, 'advisory' AS severity FROM v_docs WHERE NOT tagged UNION ALL SELECT job_id, 'ACCESS_002', 'advisory' FROM v_docs WHERE lang IS NULL
  UNION ALL SELECT job_id, 'ACCESS_003', 'advisory' FROM v_docs WHERE tagged AND marked UNION ALL SELECT job_id, 'ACCESS_004', 'warning' FROM v_docs WHERE lang IS NULL OR trim(lang) = ''
  UNION ALL SELECT job_id, 'ACCESS_012', 'advisory' FROM v_docs WHERE intents = 0 UNION ALL SELECT job_id, 'ACCESS_013', 'advisory' FROM v_docs WHERE NOT tab_order AND tagged UNION ALL SELECT job_id, 'SCREEN_READER', 'warning' FROM v_docs WHERE encrypted AND NOT reader_allowed""",
    )
)
def r26_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.apply_rules(view(spark, sf_dir, "v_docs"), D.ACCESS, "job_id")


@query(
    oracle(
        "v_nodes v_docs v_images",
        """SELECT job_id, 0 AS page_num, 'ACCESS_006' AS inspection_id, 'advisory' AS severity FROM t WHERE h = 0 UNION ALL SELECT job_id, 0, 'ACCESS_007', 'warning' FROM t WHERE tables > 0 AND th = 0
  UNION ALL SELECT job_id, 0, 'ACCESS_008', 'advisory' FROM t WHERE li > 0 AND l = 0 UNION ALL SELECT job_id, 0, 'ACCESS_009', 'advisory' FROM t WHERE artifacts = 0 UNION ALL SELECT job_id, 0, 'ACCESS_010', 'warning' FROM t WHERE n = 0
  UNION ALL SELECT job_id, 0, 'ACCESS_011', 'advisory' FROM t WHERE em = 0 UNION ALL SELECT DISTINCT i.job_id, page_num, 'ACCESS_005', 'warning' FROM v_images i JOIN v_docs d ON i.job_id = d.job_id WHERE tagged""",
        """t AS (SELECT d.job_id, count(type) AS n, count(*) FILTER (WHERE type IN ('H', 'H1', 'H2', 'H3', 'H4', 'H5', 'H6')) AS h, count(*) FILTER (WHERE type = 'Table') AS tables, count(*) FILTER (WHERE type = 'TH') AS th, count(*) FILTER (WHERE type = 'LI') AS li,
  count(*) FILTER (WHERE type = 'L') AS l, count(*) FILTER (WHERE type = 'Artifact') AS artifacts, count(*) FILTER (WHERE type IN ('Em', 'Strong')) AS em FROM v_docs d LEFT JOIN v_nodes n ON d.job_id = n.job_id WHERE tagged GROUP BY d.job_id)""",
    )
)
def r26_structure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.structure_tag_rules(view(spark, sf_dir, "v_nodes"), view(spark, sf_dir, "v_docs"), view(spark, sf_dir, "v_images"))


@query(
    oracle(
        "v_profiles",
        """SELECT job_id, seq, 'ICC_001' AS inspection_id, 'error' AS severity FROM v_profiles WHERE (space = 'GRAY' AND components <> 1) OR (space IN ('RGB', 'Lab') AND components <> 3) OR (space = 'CMYK' AND components <> 4)
  UNION ALL SELECT job_id, seq, 'ICC_003', 'error' FROM v_profiles WHERE size = 0 UNION ALL SELECT job_id, seq, 'ICC_004', 'warning' FROM v_profiles WHERE is_intent AND (subtype IS NULL OR subtype NOT IN ('GTS_PDFX', 'GTS_PDFA1', 'ISO_PDFE1'))
  UNION ALL SELECT job_id, seq, 'ICC_004', 'warning' FROM v_profiles WHERE is_intent AND condition = '' UNION ALL SELECT job_id, seq, 'ICC_005', 'advisory' FROM v_profiles WHERE is_intent AND condition IN ('FOGRA39', 'custom')
  UNION ALL SELECT job_id, seq, 'ICC_007', 'warning' FROM v_profiles WHERE NOT has_tags UNION ALL SELECT job_id, seq, 'ICC_009', 'warning' FROM v_profiles WHERE abs(white_x - 0.9642::DOUBLE) > 0.01::DOUBLE OR abs(white_z - 0.8249::DOUBLE) > 0.01::DOUBLE""",
    )
)
def r17_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.apply_rules(view(spark, sf_dir, "v_profiles"), D.PROFILE, "job_id", "seq")


@query(
    oracle(
        "v_profiles",
        "SELECT job_id, 'ICC_002' AS inspection_id, 'advisory' AS severity FROM v_profiles GROUP BY job_id HAVING count(DISTINCT version[1]) > 1 UNION ALL SELECT job_id, 'ICC_008', 'advisory' FROM v_profiles GROUP BY job_id HAVING count(DISTINCT rendering) > 1 UNION ALL SELECT job_id, 'ICC_006', 'warning' FROM v_profiles WHERE is_intent GROUP BY job_id HAVING count(DISTINCT space) > 1",
    )
)
def r17_profile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.profile_conflicts(view(spark, sf_dir, "v_profiles"))


@query(
    oracle(
        "v_spaces v_docs",
        """SELECT job_id, page_num, 'COLOR_001' AS inspection_id, 'error' AS severity FROM o WHERE cs_type = 'CalGray' OR cs_type = 'CalRGB' UNION ALL SELECT job_id, page_num, 'COLOR_002', 'warning' FROM o WHERE cs_type = 'DeviceRGB' AND NOT has_profile
  UNION ALL SELECT job_id, page_num, 'COLOR_003', 'warning' FROM o WHERE cs_type IN ('Separation', 'DeviceN') AND alternate IS NULL UNION ALL SELECT job_id, page_num, 'COLOR_007', 'advisory' FROM o WHERE cs_type IN ('Separation', 'DeviceN') AND colorant IN ('Gold', 'Silver')
  UNION ALL SELECT job_id, page_num, 'COLOR_018', 'advisory' FROM o WHERE cs_type = 'Lab' UNION ALL SELECT job_id, page_num, 'COLOR_019', 'advisory' FROM o WHERE cs_type = 'Indexed' UNION ALL SELECT job_id, page_num, 'COLOR_015', 'advisory' FROM o WHERE starts_with(cs_type, 'Device') AND cs_type <> 'DeviceN' AND has_intent
  UNION ALL SELECT job_id, page_num, 'COLOR_020', 'warning' FROM o WHERE has_default UNION ALL SELECT job_id, 0, 'COLOR_006', 'warning' FROM v_docs WHERE intents = 0""",
        "o AS (SELECT job_id, page_num, cs_type, colorant, max(alternate) AS alternate, bool_or(has_profile) AS has_profile, bool_or(has_default) AS has_default, bool_or(has_intent) AS has_intent FROM v_spaces GROUP BY ALL)",
    )
)
def r14_color_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.color_space_rules(view(spark, sf_dir, "v_spaces"), view(spark, sf_dir, "v_docs"))


SOURCES = {"docs": "v_docs", "pages": "v_pages", "fonts": "v_fonts", "spaces": "v_spaces", "annotations": "v_annotations"}
PACK_SQL = "SELECT job_id, pack, inspection_id, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT job_id, '{pack}' AS pack, '{rule}' AS inspection_id, '{severity}' AS severity FROM {SOURCES[name]} WHERE {test}" for pack, rule, severity, name, test in D.PACKS) + ") GROUP BY ALL"


def _standards(spark: SparkSession, sf_dir: str, *packs: str) -> DataFrame:
    return D.standards({k: view(spark, sf_dir, v) for k, v in SOURCES.items()}, packs)


@query(oracle(" ".join(SOURCES.values()), f"SELECT * FROM ({PACK_SQL}) WHERE pack = 'X-4'"))
def r55_standard_x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standards(spark, sf_dir, D.X4)


@query(oracle(" ".join(SOURCES.values()), f"SELECT * FROM ({PACK_SQL}) WHERE pack = 'X-1a'"))
def r56_standard_x1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standards(spark, sf_dir, D.X1A)


_A_META = " UNION ALL ".join(
    f"SELECT job_id, '{pack}' AS pack, inspection_id, severity, 1 AS n FROM (SELECT job_id, 'PDFA-010' AS inspection_id, 'error' AS severity FROM v_docs WHERE NOT has_metadata UNION ALL SELECT job_id, 'PDFA-001', 'error' FROM v_docs WHERE NOT has_xmp UNION ALL SELECT job_id, 'PDFA-002', 'error' FROM v_docs WHERE has_xmp AND pdfa_part = '' "
    f"UNION ALL SELECT job_id, 'PDFA-003', 'error' FROM v_docs WHERE has_xmp AND pdfa_conformance IS NULL UNION ALL SELECT job_id, 'PDFA-004', 'warning' FROM v_docs WHERE has_xmp AND title <> '' AND title <> xmp_title UNION ALL SELECT job_id, 'PDFA-005', 'warning' FROM v_docs WHERE NOT has_create_date UNION ALL SELECT job_id, 'PDFA-006', 'warning' FROM v_docs WHERE NOT has_mod_date "
    f"UNION ALL SELECT job_id, 'PDFA-007', 'error' FROM v_docs WHERE intents = 0 UNION ALL SELECT job_id, 'PDFA-008', 'error' FROM v_docs WHERE intents > 0 AND NOT intent_profile AND condition IS NULL UNION ALL SELECT job_id, 'PDFA-009', 'error' FROM v_docs WHERE version IN {too_new})"
    for pack, too_new in (("A-1", "('1.6', '1.7', '2.0')"), ("A-2", "('2.0', '2.1')"))
)


@query(oracle("v_docs", _A_META))
def r57_metadata_of_standard_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.standards({"docs": view(spark, sf_dir, "v_docs")}, (D.A1, D.A2))
    return found.where("inspection_id <= 'PDFA-010'").withColumn("n", F.col("n").cast("int"))


@query(oracle(" ".join(SOURCES.values()), f"SELECT job_id, pack, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'error') = 0 AS conforms FROM ({PACK_SQL}) WHERE pack IN ('A-1', 'A-2') GROUP BY ALL"))
def r57_standard_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.conformance(_standards(spark, sf_dir, D.A1, D.A2))


@query(
    oracle(
        "v_layers v_docs",
        """SELECT job_id, CASE d WHEN true THEN 'PKG_001' ELSE 'PKG_002' END AS inspection_id, CASE d WHEN true THEN 'advisory' ELSE 'warning' END AS severity FROM j UNION ALL
  SELECT job_id, 'PKG_003', 'advisory' FROM (SELECT DISTINCT l.job_id, trim(name) FROM v_layers l JOIN v_docs d ON l.job_id = d.job_id WHERE starts_with(name, 'Dieline ') AND print_state = 'OFF')""",
        "j AS (SELECT v.job_id, coalesce(bool_or(dieline), false) AS d FROM v_docs v LEFT JOIN v_layers l ON v.job_id = l.job_id GROUP BY v.job_id)",
    )
)
def r29_packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.packaging(view(spark, sf_dir, "v_layers"), view(spark, sf_dir, "v_docs").select("job_id"))


@query(oracle("v_layers v_plates", "SELECT job_id, lower(name) AS name, min(source) AS source FROM (SELECT job_id, name, 'layer' AS source FROM v_layers UNION ALL SELECT job_id, ink, 'spot' FROM v_plates) WHERE regexp_matches(name, '(?i)die|cut|black') GROUP BY ALL"))
def r47_dieline_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.named_resources(view(spark, sf_dir, "v_layers"), view(spark, sf_dir, "v_plates"), "(?i)die|cut|black")


SYNONYMS = {"rich black": "black", "all": "registration", "yellow": "yellow"}


@query(
    oracle(
        "v_plates",
        """SELECT DISTINCT job_id, low, 'SPOT_NONCANONICAL' AS inspection_id, 'advisory' AS severity FROM n WHERE low IN ('rich black', 'all') UNION ALL SELECT DISTINCT job_id, low, 'SPOT_WHITE_SUBTYPE', 'advisory' FROM n WHERE low IN ('white', 'opaque', 'weiss')
  UNION ALL SELECT job_id, NULL, 'SPOT_CASE_STYLES', 'advisory' FROM n GROUP BY job_id HAVING count(*) FILTER (WHERE regexp_matches(ink, '[A-Z]') AND upper(ink) = ink) > 0 AND count(*) FILTER (WHERE regexp_matches(ink, '[a-z]')) > 0""",
        "n AS (SELECT DISTINCT job_id, ink, lower(trim(ink)) AS low FROM v_plates)",
    )
)
def r32_name_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.name_taxonomy(view(spark, sf_dir, "v_plates"), SYNONYMS)


DIGIT_SQL = "CAST((10 - list_sum(list_transform(range(1, length(payload)), lambda i: CAST(substr(payload, i, 1) AS INT) * CASE WHEN (length(payload) - i) % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR)"


@query(
    oracle(
        "v_codes",
        f"""SELECT job_id, code, 'BARCODE_CHECK_DIGIT' AS inspection_id, 'error' AS severity FROM v_codes WHERE CASE WHEN regexp_full_match(payload, '[0-9]{{12,14}}') THEN {DIGIT_SQL} <> right(payload, 1) ELSE false END
  UNION ALL SELECT job_id, code, 'BARCODE_URL', 'warning' FROM v_codes WHERE payload LIKE 'http%' AND NOT regexp_full_match(payload, 'https?://[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}(/\\S*)?')
  UNION ALL SELECT job_id, code, 'BARCODE_TEXT_MISMATCH', 'advisory' FROM v_codes WHERE nearby <> '' AND NOT contains(replace(nearby, ' ', ''), payload)""",
    )
)
def r43_code_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.substring(F.col("payload"), F.lit(1), F.length("payload") - 1)
    valid = F.when(F.col("payload").rlike(r"^\d+$"), T.check_digit(body).cast("string") == F.substring("payload", -1, 1))
    return D.code_content(view(spark, sf_dir, "v_codes"), F.coalesce(valid, F.lit(False)))


@query("SELECT concat('reg', n_nationkey) AS regulation_id, unnest(['CHK_' || n_nationkey % 3, 'CHK_' || n_nationkey % 5]) AS check FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND n_nationkey % 2 = 0")
def e6_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    check = lambda m: F.concat(F.lit("CHK_"), (F.col("n_nationkey") % m).cast("string"))
    until = F.when(F.col("n_nationkey") % 2 == 1, "2020-01-01")
    named = rows.select(F.concat(F.lit("reg"), F.col("n_nationkey").cast("string")).alias("regulation_id"), F.col("r_name").alias("authority"), F.lit("2019-01-01").alias("from_day"), until.alias("until_day"), F.array(check(3), check(5)).alias("checks"))
    return D.regulations(named, "EUROPE", "2024-01-01")


# --- expressions


@query(oracle("v_runs", "SELECT job_id, op_idx, round(size_pt * CASE WHEN c * 0.9 BETWEEN 0.3 AND 0.8 THEN c * 0.9 ELSE 0.5 END * 25.4::DOUBLE / 72, 4) AS x_height FROM v_runs"))
def f4_x_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_runs").select("job_id", "op_idx", F.round(D.x_height_mm(F.col("size_pt"), F.col("c") * 0.9), 4).alias("x_height"))


@query(oracle("v_spaces", "SELECT cs_type, CASE WHEN cs_type LIKE 'Device_' || '%' AND cs_type <> 'DeviceN' THEN 'device' WHEN cs_type IN ('CalGray', 'CalRGB', 'Lab', 'ICCBased') THEN 'calibrated' ELSE 'special' END AS family, count(*) AS n FROM v_spaces GROUP BY ALL"))
def f13_space_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.lit(None).cast("string")
    for name, types in D.FAMILIES.items():
        family = F.when(F.col("cs_type").isin(*types), name).otherwise(family)
    return view(spark, sf_dir, "v_spaces").groupBy("cs_type", family.alias("family")).agg(F.count("*").alias("n"))


PLANES = ((1.0, 0.5, 0.0, -30.0), (-1.0, 0.0, 0.5, 5.0), (0.0, 1.0, 1.0, -8.0))


@query(oracle("v_plates", "SELECT job_id, ink, l, a, b, round(greatest(l + 0.5 * a - 30, -l + 0.5 * b + 5, a + b - 8), 6) AS violation, greatest(l + 0.5 * a - 30, -l + 0.5 * b + 5, a + b - 8) > 0.000001 AS outside FROM v_plates"))
def f10_r15_gamut(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = C.out_of_gamut((F.col("l"), F.col("a"), F.col("b")), list(PLANES))
    return view(spark, sf_dir, "v_plates").select("job_id", "ink", "l", "a", "b", F.round(far, 6).alias("violation"), (far > 1e-6).alias("outside"))


@query(
    """SELECT p_partkey, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 9) AS similarity FROM (SELECT p_partkey, len(list_intersect(a, b)) AS i, len(list_distinct(a || b)) AS u FROM (
  SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM part))"""
)
def f19_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.round(T.token_similarity(F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand")), 9).alias("similarity"))


@query(oracle("v_images", "SELECT job_id, page_num, round(a * 2 + b * 1, 6) AS a, round(a * 0 + b * 3, 6) AS b, round(c * 2 + d * 1, 6) AS c, round(c * 0 + d * 3, 6) AS d FROM v_images"))
def f3_matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    m = {**{k: F.col(k) for k in "abcd"}, "e": zero, "f": zero}
    found = G.product(m, {"a": F.lit(2.0), "b": zero, "c": F.lit(1.0), "d": F.lit(3.0), "e": zero, "f": zero})
    return view(spark, sf_dir, "v_images").select("job_id", "page_num", *[F.round(found[k], 6).alias(k) for k in "abcd"])


# --- vectors


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS ident, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS cosine FROM q JOIN embeddings ON query_id <> vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ident) AS INT) AS rank, ident, round(cosine, 6) AS cosine FROM s QUALIFY rank <= 5"""
)
def j6_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ident"), F.col("embedding").alias("v"))
    return N.similar_vectors(rows, rows.where("ident % 20 = 0"))


# --- families and the findings of all of them

FAMILIES = Families()
FAMILIES.register("images", "image", "v_images")(lambda rows: R.fused(rows, R.image_rules(), "job_id", "page_num"))
FAMILIES.register("inks", "colour", "v_paths")(lambda rows: R.fused(rows, R.ink_rules(), "job_id", "page_num"))
FAMILIES.register("black_text", "colour", "v_runs")(lambda rows: R.fused(rows, R.black_text_rules(), "job_id", "page_num"))
FAMILIES.register("overprint", "colour", "v_drawing", by_job=True)(R.overprint_rules)
FAMILIES.register("spaces", "colour", "v_spaces", "v_docs")(D.color_space_rules)
FAMILIES.register("boxes", "page", "v_pages")(R.box_rules)
FAMILIES.register("content", "page", "v_paths", "v_pages")(R.content_against_boxes)
FAMILIES.register("fonts", "text", "v_fonts")(Y.font_rules)
FAMILIES.register("documents", "document", "v_docs")(lambda rows: D.apply_rules(rows, D.DOCUMENT + D.METADATA + D.STRUCTURE, "job_id"))
FAMILIES.register("annotations", "document", "v_annotations")(lambda rows: D.apply_rules(rows, D.ANNOTATION, "job_id", "page_num"))
FAMILIES.register("text", "text", "v_runs")(Y.text_size_rules)
FAMILIES.register("profiles", "profile", "v_profiles")(lambda rows: D.apply_rules(rows, D.PROFILE, "job_id", "seq"))
FAMILIES.register("profile_conflicts", "profile", "v_profiles", by_job=True)(D.profile_conflicts)
FAMILIES.register("layers", "document", "v_layers")(lambda rows: D.apply_rules(rows, D.LAYER, "job_id", "name"))
FAMILIES.register("accessibility", "document", "v_docs")(lambda rows: D.apply_rules(rows, D.ACCESS, "job_id"))
FAMILIES.register("structure_tags", "document", "v_nodes", "v_docs", "v_images")(D.structure_tag_rules)
FAMILIES.register("packaging", "packaging", "v_layers", "v_docs", by_job=True)(lambda layers, docs: D.packaging(layers, docs.select("job_id")))
FAMILIES.register("names", "text", "v_plates")(lambda rows: D.name_taxonomy(rows, SYNONYMS))

OF_FAMILY = {
    "images": ["r1_images"], "inks": ["r6_r12_ink_and_strokes"], "black_text": ["r13_black_text"], "overprint": ["r48_overprint_state"], "spaces": ["r14_color_spaces"], "boxes": ["r9_page_boxes"],
    "content": ["r10_content_against_boxes"], "fonts": ["r3_r4_fonts"], "documents": ["r23_documents", "r24_metadata", "r25_structure"], "annotations": ["r8_annotations"],
    "text": ["r7_text_size"], "profiles": ["r17_profiles"], "profile_conflicts": ["r17_profile_conflicts"], "layers": ["r28_layers"], "accessibility": ["r26_accessibility"], "structure_tags": ["r26_structure_tags"], "packaging": ["r29_packaging"], "names": ["r32_name_taxonomy"],
}
ALL_SQL = " UNION ALL ".join(f"SELECT '{k}' AS family, job_id, inspection_id, severity FROM ({ORACLES[q]})" for k, names in OF_FAMILY.items() for q in names)


@query(f"SELECT family, inspection_id, severity, count(*) AS n, count(DISTINCT job_id) AS jobs FROM ({ALL_SQL}) GROUP BY ALL")
def d3_u1_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FAMILIES.counts(lambda name: view(spark, sf_dir, name))


@query(
    f"""SELECT job_id, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'advisory') AS advisory_count, count(*) FILTER (WHERE severity = 'error') = 0 AS passed
  FROM (SELECT job_id, CASE WHEN inspection_id = 'COLOR_004' THEN 'error' ELSE severity END AS severity FROM ({ALL_SQL}) WHERE family IN ('inks', 'black_text', 'overprint', 'spaces') AND NOT inspection_id LIKE '%\\_017' ESCAPE '\\') GROUP BY job_id"""
)
def d3_e3_a1_checked_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = FAMILIES.findings(lambda name: view(spark, sf_dir, name), categories=("colour",)).withColumns({"source": F.lit("engine"), "pages": F.lit(2)})
    kept = found.where(A.is_enabled(F.col("inspection_id"), F.col("source"), ("COLOR_*", "OVER_*", "STROKE_*"), ("*_017",)))
    return A.counts(A.evaluate(kept, {}, {"COLOR_004": "error"}), "job_id")


# --- sources


@query(oracle("v_findings", "SELECT DISTINCT inspection_id, CASE inspection_id WHEN 'COLOR_004' THEN 'Ink coverage' ELSE array_to_string(list_transform(string_split(replace(inspection_id, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name FROM v_findings"))
def s7_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_findings").select("inspection_id", A.catalogue_name(F.col("inspection_id"), {"COLOR_004": "Ink coverage"}).alias("name")).distinct()


@query(oracle("v_findings", "SELECT job_id, CASE WHEN ord % 3 > 0 THEN inspection_id END AS given, CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'warning' END AS severity, count(*) AS n FROM v_findings WHERE ord % 5 > 0 GROUP BY ALL"))
def s3_imported_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_findings").select("job_id", F.when(F.col("ord") % 3 > 0, F.col("inspection_id")).alias("check"), F.upper("severity").alias("severity"), F.when(F.col("ord") % 5 > 0, F.lit("text")).otherwise(F.lit(" ")).alias("message"))
    found = Z.imported_findings(rows, {"error": "error", "warning": "warning"})
    given = F.when(~F.col("inspection_id").startswith("EXT-CUSTOM-"), F.col("inspection_id"))
    return found.groupBy("job_id", given.alias("given"), "severity").agg(F.count("*").alias("n"))


@query(oracle("v_findings", "SELECT job_id, count(*) AS total, arg_min(inspection_id, {'o': ord, 'i': inspection_id}) AS first FROM v_findings GROUP BY job_id"))
def s6_result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Z.result_documents(view(spark, sf_dir, "v_findings"))
    read = F.from_json("document", "total long, findings array<struct<ord:long,inspection_id:string>>")
    return docs.select("job_id", read.alias("d")).select("job_id", "d.total", F.col("d.findings")[0]["inspection_id"].alias("first"))


@query(oracle("v_requests", "SELECT job_id, CASE WHEN len(formats) > 1 THEN 150.0::DOUBLE ELSE CAST(job_id % 7 AS DOUBLE) END AS min_dpi, 300.0::DOUBLE AS max_ink FROM v_requests WHERE job_id % 30 < 25"))
def e4_s5_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rulesets = table(spark, sf_dir, "nation").select(F.concat(F.lit("rs"), F.col("n_nationkey").cast("string")).alias("ruleset_id"), F.create_map(F.lit("min_dpi"), F.lit(150.0), F.lit("max_ink"), F.lit(300.0)).alias("thresholds"))
    given = F.when(F.size("formats") > 1, F.map_from_arrays(F.array(F.lit("unknown")), F.array(F.lit(1.0)))).otherwise(F.map_from_arrays(F.array(F.lit("min_dpi")), F.array((F.col("job_id") % 7).cast("double"))))
    jobs = view(spark, sf_dir, "v_requests").select("job_id", F.col("requested").alias("ruleset_id"), given.alias("override"))
    return Z.resolved_thresholds(rulesets, jobs).select("job_id", F.col("thresholds")["min_dpi"].alias("min_dpi"), F.col("thresholds")["max_ink"].alias("max_ink"))


@query(
    oracle(
        "v_findings v_images",
        "SELECT f.job_id, f.ord, coalesce(a.x0, b.x0, c.x0) AS x0 FROM f LEFT JOIN e a ON f.job_id = a.job_id AND f.page_num = a.page_num AND f.object_id = a.name LEFT JOIN e b ON f.job_id = b.job_id AND f.page_num = b.page_num AND f.tail = b.name LEFT JOIN e c ON f.job_id = c.job_id AND f.page_num = c.page_num AND f.font_name = c.name",
        "f AS (SELECT job_id, ord, page_num + 1 AS page_num, CASE ord % 3 WHEN 0 THEN 'Im' || (page_num + 1) WHEN 1 THEN 'Fm0.Im' || (page_num + 1) ELSE 'none' END AS object_id, CASE ord % 3 WHEN 2 THEN 'none' ELSE 'Im' || (page_num + 1) END AS tail, CASE WHEN ord % 2 = 0 THEN 'Im' || (page_num + 1) END AS font_name FROM v_findings)",
        "e AS (SELECT job_id, page_num, image_name AS name, max(a) AS x0 FROM v_images GROUP BY ALL)",
    )
)
def j1_filled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Im"), (F.col("page_num") + 1).cast("string"))
    objects = F.when(F.col("ord") % 3 == 0, name).when(F.col("ord") % 3 == 1, F.concat(F.lit("Fm0."), name)).otherwise("none")
    rows = view(spark, sf_dir, "v_findings").select("job_id", "ord", (F.col("page_num") + 1).alias("page_num"), objects.alias("object_id"), F.when(F.col("ord") % 2 == 0, name).alias("font_name"))
    events = view(spark, sf_dir, "v_images").select("job_id", "page_num", F.col("image_name").alias("name"), F.col("a").alias("ord"), F.struct(F.col("a").alias("x0")).alias("bbox"))
    return A.fill_boxes(rows, events).select("job_id", "ord", F.col("bbox.x0").alias("x0"))


# --- expiry and newest events


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20 00:00:00'")
def x7_expired_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return rows.where(F.expr("ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20 00:00:00'")).select("event_id", "user_id")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events QUALIFY place <= 5")
def x8_newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platewise.streaming.monitors import newest

    return newest(table(spark, sf_dir, "events"), ["user_id"], 5).select("user_id", "event_id", "place")
