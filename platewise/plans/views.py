"""Views that derive this library's tables from the order, event, part and text tables, for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Check identifiers that the findings view draws from.
CHECKS = "COLOR_013,COLOR_006,ICC_003,ICC_001,COLOR_004,GAMUT_001,SPOT_001,SPOT_003,OVER_001,OVER_004,ADV_005,COLOR_015,INK_001,ADV_003,EPM_TEXT_SIZE_REJECT,EPM_BLEED_REJECT,EPM_TRIM_REJECT,EPM_SPOT_COUNT_REJECT"

#: In braces the tables that a view reads; VARCHAR(9) is a string of either engine.
VIEWS = {
    "v_images": """SELECT l_orderkey AS job_id, l_linenumber AS page_num, concat('Im', CAST(l_linenumber AS VARCHAR(9))) AS image_name, l_linenumber AS op_idx,
      CAST(floor(l_extendedprice / 40) AS INT) + 40 AS pixel_width, CAST(floor(l_extendedprice / 50) AS INT) + 40 AS pixel_height, l_quantity * 8 AS a, l_quantity * 0 AS b,
      CASE WHEN l_tax > 0.06 THEN l_quantity ELSE l_quantity * 0 END AS c, CASE WHEN l_returnflag = 'R' THEN l_quantity * -6 ELSE l_quantity * 6 END AS d,
      CASE WHEN l_linestatus = 'O' THEN 'DeviceRGB' ELSE 'DeviceCMYK' END AS color_space FROM {lineitem}""",
    "v_paths": """SELECT l_orderkey AS job_id, l_linenumber AS page_num, CAST(l_partkey % 1000 AS INT) AS op_idx, round(l_discount * 10, 2) AS c, round(l_tax * 12, 2) AS m,
      round((l_quantity % 10) / 10, 2) AS y, CASE WHEN l_returnflag = 'A' THEN l_tax * 0 + 1 ELSE round((l_quantity % 7) / 10, 2) END AS k, round(l_discount * 8, 2) AS line_width,
      l_quantity * 10 AS x0, l_tax * 5000 AS y0, l_quantity * 10 + 40 AS x1, l_tax * 5000 + 25 AS y1, l_linestatus = 'F' AS fill FROM {lineitem}""",
    "v_state": """SELECT user_id AS job_id, event_id AS op_idx, CASE WHEN event_type = 'error' THEN value > 50 END AS overprint, CASE WHEN value > 30 THEN value / 500 END AS alpha, event_type AS kind FROM {events}""",
    "v_drawing": """SELECT user_id AS job_id, event_id AS op_idx, CASE event_type WHEN 'error' THEN 'overprint' WHEN 'signup' THEN 'opacity' WHEN 'click' THEN 'colour' WHEN 'view' THEN 'path' ELSE 'text' END AS kind,
      CASE WHEN event_type = 'error' THEN value > 50 END AS overprint, CASE WHEN event_type = 'error' THEN CAST(event_id % 2 AS INT) END AS opm, CASE WHEN event_type = 'signup' THEN value / 100 END AS alpha,
      CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN 'DeviceGray' ELSE 'DeviceCMYK' END AS color_space, CAST(event_id * 3 % 2 AS DOUBLE) AS c, CAST(event_id % 2 AS DOUBLE) AS m,
      CAST(event_id % 4 % 2 AS DOUBLE) AS y, CAST(event_id % 3 AS DOUBLE) / 2 AS k FROM {events}""",
    "v_pages": """SELECT job_id, page_num, mx0, my0, mx1, my1, CASE WHEN l_suppkey % 4 = 0 THEN mx0 + 2 END AS cx0, CASE WHEN l_suppkey % 4 = 0 THEN my0 - 1 + l_suppkey % 3 END AS cy0, CASE WHEN l_suppkey % 4 = 0 THEN mx1 - 2 END AS cx1,
      CASE WHEN l_suppkey % 4 = 0 THEN my1 - 2 END AS cy1, CASE WHEN l_suppkey % 5 > 0 THEN coalesce(tx0, mx0 + 9) - l_tax * 200 END AS bx0, CASE WHEN l_suppkey % 5 > 0 THEN coalesce(ty0, my0 + 9) - 9 END AS by0,
      CASE WHEN l_suppkey % 5 > 0 THEN coalesce(tx1, mx1 - 9) + l_discount * 100 + 5 END AS bx1, CASE WHEN l_suppkey % 5 > 0 THEN coalesce(ty1, my1 - 9) + 9 END AS by1, tx0, ty0, tx1, ty1,
      CASE WHEN l_suppkey % 9 = 0 THEN 45 ELSE CAST(page_num % 4 AS INT) * 90 END AS rotate, CASE WHEN l_suppkey % 7 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS user_unit, CAST(l_quantity AS INT) % 10 AS objects
      FROM (SELECT l_orderkey AS job_id, l_linenumber AS page_num, l_suppkey, l_tax, l_discount, l_quantity, l_tax * 0 AS mx0, l_tax * 0 AS my0, l_tax * 0 + 560 AS mx1, l_tax * 0 + 420 AS my1, CASE WHEN l_discount < 0.08 THEN l_tax * 0 + 20 END AS tx0,
      CASE WHEN l_discount < 0.08 THEN l_tax * 0 + 20 END AS ty0, CASE WHEN l_discount < 0.08 THEN 540 - l_tax * 100 END AS tx1, CASE WHEN l_discount < 0.08 THEN l_tax * 0 + 400 END AS ty1 FROM {lineitem}) AS pg""",
    "v_inks": """SELECT l_orderkey AS job_id, l_linenumber AS page_num, p_name AS colorant, p_brand AS alternate, CASE WHEN p_size > 25 THEN 'Separation' ELSE 'DeviceN' END AS cs_type
      FROM {lineitem} AS li JOIN {part} AS pa ON l_partkey = p_partkey""",
    "v_findings": f"""SELECT l_orderkey AS job_id, split_part('{CHECKS}', ',', CAST(l_partkey % 18 + 1 AS INT)) AS inspection_id,
      CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'advisory' END AS severity, CAST(l_suppkey % 3 AS INT) AS page_num, l_linenumber AS ord,
      CASE WHEN l_tax > 0.06 THEN 'ai' ELSE 'engine' END AS source FROM {{lineitem}}""",
    "v_jobs": """SELECT o_orderkey AS job_id, o_custkey AS tenant_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
      o_orderpriority AS ruleset_id, o_totalprice AS duration_ms FROM {orders}""",
    "v_series": "SELECT user_id AS series, ts, event_id AS seq, value FROM {events}",
    "v_decisions": "SELECT event_id AS decision_id, user_id AS finding_id, event_type AS decision_type, ts AS decided_at, CASE WHEN value > 100 THEN ts END AS revoked_at FROM {events}",
    "v_toggles": """SELECT c_custkey AS tenant_id, r_regionkey AS default_value, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS tenant_value, n_nationkey % 6 = 0 AS locked,
      CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS INT) END AS workflow_value FROM {customer} AS cu JOIN {nation} AS na ON c_nationkey = n_nationkey JOIN {region} AS re ON n_regionkey = r_regionkey""",
    "v_deliveries": "SELECT event_id AS delivery_id, CAST(user_id % 10 AS INT) AS endpoint_id, concat('job.', event_type) AS event, ts AS created_at, value < 40 AS success FROM {events}",
    "v_audit": """SELECT dd.doc_id, dd.source AS file_label, dd.lang AS rule, ll.quality, CASE WHEN ll.toxic = 1 THEN 'disputed' WHEN ll.quality = 1 THEN 'confirmed' ELSE 'skipped' END AS verdict
      FROM {documents} AS dd LEFT JOIN {labels} AS ll ON dd.doc_id = ll.doc_id""",
    "v_text": """SELECT doc_id AS job_id, 1 AS page_num, lang, text FROM {documents} UNION ALL SELECT conv_id + 1000000000 AS job_id, CAST(turn AS INT) + 1 AS page_num, role AS lang, text FROM {conversations}""",
    "v_fonts": """SELECT l_orderkey AS job_id, l_linenumber AS page_num, concat(p_name, ' ', CAST(p_partkey AS VARCHAR(9))) AS name, CASE WHEN p_size % 7 > 0 THEN p_brand END AS base_font,
      CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Type1' WHEN 1 THEN 'TrueType' WHEN 2 THEN 'Type0' ELSE 'Type3' END AS subtype, p_size % 3 <> 0 AS embedded, p_partkey % 2 = 0 AS subset,
      p_size % 5 <> 0 AS has_unicode, CAST(p_partkey * 37 % 1024 AS INT) AS fs_type FROM {lineitem} AS li JOIN {part} AS pa ON l_partkey = p_partkey""",
    "v_runs": """SELECT user_id AS job_id, CAST(event_id % 3 AS INT) + 1 AS page_num, event_id AS op_idx, event_type AS font, value / 8 AS size_pt, CAST(event_id % 5 AS INT) AS render_mode,
      CAST(event_id % 2 AS DOUBLE) AS c, CAST(event_id % 4 AS DOUBLE) / 3 AS m, CAST(event_id % 6 AS DOUBLE) / 5 AS y, CAST(event_id % 8 AS DOUBLE) / 7 AS k,
      CAST(CASE event_type WHEN 'error' THEN 181 WHEN 'purchase' THEN 90 ELSE 1 END AS DOUBLE) AS angle, event_id % 7 = 0 AS mirrored, CASE WHEN event_id % 4 = 0 THEN value > 50 END AS overprint,
      CASE WHEN value > 30 THEN value / 200 ELSE CAST(1 AS DOUBLE) END AS alpha, value * 4 AS x0, CAST(event_id % 97 AS DOUBLE) * 8 AS y0, value * 4 + 40 AS x1, CAST(event_id % 97 AS DOUBLE) * 8 + 10 AS y1 FROM {events}""",
    "v_marks": """SELECT user_id AS job_id, 1 AS page_num, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'text' ELSE 'path' END AS kind, CAST(floor(value / 20) AS INT) AS chars,
      CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, value / 4 AS x0, CAST(event_id % 50 AS DOUBLE) AS y0, value / 4 + 1 + CAST(event_id % 5 AS DOUBLE) / 2 AS x1, CAST(event_id % 50 AS DOUBLE) + 2 AS y1 FROM {events}""",
    "v_page_counts": """SELECT user_id AS job_id, CAST(event_id % 3 AS INT) + 1 AS page_num, max(value) AS image_area, CAST(700 AS DOUBLE) AS area, count(*) AS paths, CAST(min(floor(value)) AS INT) AS chars
      FROM {events} GROUP BY 1, 2""",
    "v_plates": """SELECT l_orderkey AS job_id, CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'Cyan' WHEN 1 THEN 'magenta' WHEN 2 THEN ' Yellow' WHEN 3 THEN 'Black' WHEN 4 THEN 'Rich Black' WHEN 5 THEN 'All' ELSE p_brand END AS ink,
      l_quantity AS l, l_discount * 100 AS a, l_tax * 100 AS b FROM {lineitem} AS li JOIN {part} AS pa ON l_partkey = p_partkey""",
    "v_docs": """SELECT o_orderkey AS job_id, o_custkey AS tenant_id, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '1.3' WHEN 1 THEN '1.4' WHEN 2 THEN '1.6' WHEN 3 THEN '1.7' WHEN 4 THEN '2.0' WHEN 5 THEN '' END AS version, o_orderkey * 7919 % 11 < 1 AS encrypted, o_orderkey * 7919 % 7 < 2 AS linearized, o_orderkey * 7919 % 9 < 2 AS has_prev, o_orderkey * 7919 % 13 < 9 AS has_id, o_orderkey * 7919 % 8 < 6 AS has_xmp, o_orderkey * 7919 % 5 < 2 AS display_title, o_orderkey * 7919 % 6 < 5 AS has_text, o_orderkey * 7919 % 23 < 1 AS names_js, o_orderkey * 7919 % 29 < 1 AS open_js, o_orderkey * 7919 % 31 < 1 AS page_js, o_orderkey * 7919 % 19 < 1 AS embedded_files, o_orderkey * 7919 % 37 < 1 AS xfa, o_orderkey * 7919 % 4 < 1 AS tagged, o_orderkey * 7919 % 3 < 1 AS marked, o_orderkey * 7919 % 12 < 1 AS thumbnails, o_orderkey * 7919 % 41 < 1 AS launch_action, o_orderkey * 7919 % 5 < 3 AS tab_order, o_orderkey * 7919 % 10 < 8 AS reader_allowed, o_orderkey * 7919 % 9 < 7 AS has_create_date, o_orderkey * 7919 % 7 < 5 AS has_mod_date, o_orderkey * 7919 % 6 < 4 AS intent_profile, o_orderkey * 7919 % 17 < 1 AS transfer_functions, o_orderkey * 7919 % 18 < 1 AS halftones, o_orderkey * 7919 % 5 < 2 AS transparency, o_orderkey * 7919 % 16 < 3 AS has_layer_config, o_orderkey * 7919 % 14 < 12 AS has_metadata, CASE WHEN o_orderkey % 3 > 0 THEN '1' ELSE '' END AS pdfa_part, CASE WHEN o_orderkey % 4 > 0 THEN 'B' END AS pdfa_conformance,
      CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'True' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'odd' WHEN 3 THEN '' END AS trapped, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE '' END AS title, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority ELSE 'other' END AS xmp_title,
      CASE WHEN o_orderkey % 3 = 0 THEN '1.6' ELSE '' END AS xmp_version, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'PDF/X-4' WHEN 1 THEN 'PDF/X-1a' END AS xmp_pdfx, CASE WHEN o_orderkey % 3 = 1 THEN 'PDF/X-1:2001' END AS info_pdfx, CASE WHEN o_orderkey % 5 > 1 THEN 'en' ELSE ' ' END AS lang,
      CAST(o_orderkey % 3 AS INT) AS intents, CASE WHEN o_orderkey % 8 > 0 THEN 'GTS_PDFX' ELSE 'GTS_PDFA1' END AS intent_subtype, CASE WHEN o_orderkey % 10 > 0 THEN 'FOGRA39' END AS condition, CAST(o_orderkey % 9 - 5 AS INT) AS form_fields, CAST(o_orderkey % 6 - 3 AS INT) AS layers,
      CAST(o_orderkey % 14 - 11 AS INT) AS ps_xobjects, CAST(o_orderkey % 11 - 6 AS INT) AS bookmarks, CAST(floor(o_totalprice * 500) AS BIGINT) AS file_size FROM {orders}""",
    "v_annotations": """SELECT user_id AS job_id, CAST(event_id % 3 AS INT) + 1 AS page_num, event_id AS seq, CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'TrapNet' WHEN 1 THEN 'Link' WHEN 2 THEN 'Stamp' WHEN 3 THEN 'Movie' WHEN 4 THEN 'Sound' WHEN 5 THEN '3D' WHEN 6 THEN 'Text'
      WHEN 7 THEN 'PrinterMark' WHEN 8 THEN 'RichMedia' ELSE 'FileAttachment' END AS subtype, event_id % 3 = 0 AS printable, value * 4 AS x0, value * 2 AS y0, value * 4 + 30 AS x1, value * 2 + 10 AS y1, CAST(20 AS DOUBLE) AS tx0, CAST(20 AS DOUBLE) AS ty0, CAST(200 AS DOUBLE) AS tx1, CAST(120 AS DOUBLE) AS ty1 FROM {events}""",
    "v_layers": """SELECT l_orderkey AS job_id, concat(CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'Dieline ' WHEN 1 THEN 'White Ink ' WHEN 2 THEN 'Varnish ' WHEN 3 THEN 'Cut ' ELSE 'Art ' END, CAST(l_linenumber AS VARCHAR(9))) AS name, l_partkey % 6 IN (0, 2, 3) AS finishing, l_partkey % 6 = 1 AS white,
      l_partkey % 6 = 0 AS dieline, CASE WHEN l_suppkey % 3 = 0 THEN 'OFF' ELSE 'ON' END AS print_state, CASE WHEN l_suppkey % 5 = 0 THEN 'OFF' ELSE 'ON' END AS view_state FROM {lineitem}""",
    "v_profiles": """SELECT l_orderkey AS job_id, l_linenumber AS seq, CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'GRAY' WHEN 1 THEN 'RGB' WHEN 2 THEN 'CMYK' ELSE 'Lab' END AS space, CAST(l_suppkey % 4 + 1 AS INT) AS components, CASE WHEN l_partkey % 3 = 0 THEN '4.3' ELSE '2.1' END AS version,
      CASE WHEN l_partkey % 5 = 0 THEN 'mntr' ELSE 'prtr' END AS class, CAST(l_partkey % 50 AS INT) AS size, l_linenumber % 3 = 0 AS is_intent, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'FOGRA39' WHEN 1 THEN 'custom' ELSE '' END AS condition, CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'GTS_PDFX' WHEN 1 THEN 'GTS_PDFA1' WHEN 2 THEN 'odd' END AS subtype, l_partkey % 7 > 0 AS has_tags, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'Perceptual' ELSE 'RelativeColorimetric' END AS rendering,
      0.9642 + l_discount / 5 AS white_x, 0.8249 + l_tax / 5 AS white_z FROM {lineitem}""",
    "v_spaces": """SELECT l_orderkey AS job_id, l_linenumber AS page_num, CASE CAST(l_partkey % 10 AS INT) WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN 'DeviceCMYK' WHEN 2 THEN 'DeviceGray' WHEN 3 THEN 'CalRGB' WHEN 4 THEN 'CalGray' WHEN 5 THEN 'Lab' WHEN 6 THEN 'ICCBased' WHEN 7 THEN 'Separation'
      WHEN 8 THEN 'DeviceN' ELSE 'Indexed' END AS cs_type, CASE WHEN l_suppkey % 3 > 0 THEN 'DeviceCMYK' END AS alternate, l_suppkey % 4 = 0 AS has_default, l_orderkey % 2 = 0 AS has_intent, l_suppkey % 5 > 1 AS has_profile, CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'All' WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN 'Gold' WHEN 4 THEN 'Silver' END AS colorant FROM {lineitem}""",
    "v_nodes": """SELECT user_id AS job_id, event_id AS seq, CASE CAST(event_id * user_id % 13 AS INT) WHEN 0 THEN 'Document' WHEN 1 THEN 'H1' WHEN 2 THEN 'Table' WHEN 3 THEN 'TH' WHEN 4 THEN 'LI' WHEN 5 THEN 'L' WHEN 6 THEN 'Artifact' WHEN 7 THEN 'Em' ELSE 'P' END AS type FROM {events}""",
    "v_codes": """SELECT p_size AS job_id, p_partkey AS code, CASE WHEN p_partkey % 4 = 0 THEN concat('http', CASE WHEN p_partkey % 8 = 0 THEN 's' ELSE ':' END, '://shop.example.com/', CAST(p_partkey AS VARCHAR(9))) ELSE lpad(CAST(p_partkey * 7919 AS VARCHAR(9)), 13, '4') END AS payload,
      CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN lpad(CAST(p_partkey * 7919 AS VARCHAR(9)), 13, '4') WHEN 1 THEN p_name ELSE '' END AS nearby FROM {part}""",
    "v_tenants": """SELECT c_custkey AS tenant_id, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' WHEN 3 THEN 'enterprise' ELSE 'trial' END AS plan,
      CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 40 AS INT) END AS tenant_limit, CASE WHEN c_custkey % 10 = 0 THEN 999 END AS tenant_override,
      split(CASE WHEN c_acctbal > 0 THEN 'api,seats' ELSE 'audit' END, ',') AS tenant_features FROM {customer}""",
    "v_plans": """SELECT CASE r_regionkey WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' WHEN 3 THEN 'enterprise' ELSE 'other' END AS plan, CAST(r_regionkey * 10 AS INT) AS plan_limit,
      CASE WHEN r_regionkey = 2 THEN 25 END AS plan_override, split(CASE WHEN r_regionkey > 1 THEN 'api,viewer,pdf' ELSE 'viewer' END, ',') AS plan_features FROM {region}""",
    "v_rulesets": """SELECT concat('rs', CAST(n_nationkey AS VARCHAR(9))) AS ruleset_id, n_nationkey, CASE CAST(n_nationkey % 5 AS INT) WHEN 0 THEN 'all' WHEN 1 THEN 'plan' WHEN 2 THEN 'list' WHEN 3 THEN 'both' ELSE 'odd' END AS mode,
      CASE CAST(n_regionkey AS INT) WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'pro' WHEN 3 THEN 'enterprise' ELSE 'none' END AS min_plan FROM {nation}""",
    "v_requests": """SELECT o_orderkey AS job_id, o_custkey AS tenant_id, concat('rs', CAST(o_orderkey % 30 AS VARCHAR(9))) AS requested, concat('rs', CAST(o_custkey % 25 AS VARCHAR(9))) AS preferred,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 150 END AS job_spec, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 170 END AS endpoint_spec, o_orderkey % 190 AS tenant_spec,
      split(CASE o_orderstatus WHEN 'F' THEN 'pdf,json,xml' WHEN 'O' THEN 'json' ELSE 'html,pdf' END, ',') AS formats, split(CASE WHEN o_totalprice > 150000 THEN 'pdf,html' ELSE 'json' END, ',') AS allowed FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS, or a table, over the Parquet tables of ``sf_dir``."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name].replace("VARCHAR(9)", "STRING"), **used)


def oracle(views: str, select: str, *parts: str) -> str:
    """DuckDB SQL: ``select`` over the named views and further common table expressions."""
    ctes = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views.split()]
    ctes += parts
    return (f"WITH {', '.join(ctes)} " if ctes else "") + select
