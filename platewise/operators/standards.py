"""Rule families as tables of SQL predicates: document, annotation, layer, profile and colour-space rules, and standards packs.

A rule is (identifier, severity, predicate); the predicates of a table are tested in one scan of it. A null predicate does
not hold. Standards packs are the same with a pack in front, so that one scan tests a table for all packs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.families import fused

Rule = tuple[str, str, str]

METADATA: tuple[Rule, ...] = (
    ("META_001", "warning", "NOT has_xmp"),
    ("META_002", "advisory", "title <> '' AND xmp_title <> '' AND title <> xmp_title"),
    ("META_003", "advisory", "trapped IS NULL OR trapped IN ('', 'Unknown')"),
    ("META_004", "advisory", "xmp_version <> '' AND xmp_version <> version"),
    ("VIEWER_DISPLAY_TITLE", "advisory", "NOT coalesce(display_title, false)"),
    ("LANG_001", "advisory", "has_text AND trim(coalesce(lang, '')) = ''"),
)

DOCUMENT: tuple[Rule, ...] = (
    ("DOC_003", "advisory", "coalesce(title, '') = ''"),
    ("DOC_004", "error", "encrypted"),
    ("DOC_005", "advisory", "linearized"),
    ("DOC_006", "advisory", "has_prev"),
    ("DOC_007", "advisory", "file_size > 104857600"),
    ("DOC_009", "warning", "coalesce(version, '') NOT IN ('1.4', '1.5', '1.6', '1.7', '2.0')"),
)

STRUCTURE: tuple[Rule, ...] = (
    ("STRUCT_001", "error", "names_js OR open_js"),
    ("STRUCT_002", "warning", "form_fields > 0"),
    ("STRUCT_003", "advisory", "layers > 0"),
    ("STRUCT_004", "warning", "embedded_files"),
    ("STRUCT_006", "error", "xfa"),
    ("STRUCT_007", "advisory", "tagged OR marked"),
    ("STRUCT_008", "error", "page_js"),
    ("STRUCT_009", "advisory", "form_fields > 0"),
    ("STRUCT_011", "error", "ps_xobjects > 0"),
    ("STRUCT_012", "advisory", "bookmarks > 0"),
    ("STRUCT_013", "advisory", "thumbnails"),
    ("STRUCT_014", "warning", "launch_action"),
)

ACCESS: tuple[Rule, ...] = (
    ("ACCESS_001", "advisory", "NOT tagged"),
    ("ACCESS_002", "advisory", "lang IS NULL"),
    ("ACCESS_003", "advisory", "tagged AND marked"),
    ("ACCESS_004", "warning", "trim(coalesce(lang, '')) = ''"),
    ("ACCESS_012", "advisory", "intents = 0"),
    ("ACCESS_013", "advisory", "tagged AND NOT tab_order"),
    ("SCREEN_READER", "warning", "encrypted AND NOT reader_allowed"),
)

#: Rules on the set ``types`` of a tagged document's structure elements.
TAGS: tuple[Rule, ...] = (
    ("ACCESS_006", "advisory", "NOT exists(types, t -> t RLIKE '^H[1-6]?$')"),
    ("ACCESS_007", "warning", "array_contains(types, 'Table') AND NOT array_contains(types, 'TH')"),
    ("ACCESS_008", "advisory", "array_contains(types, 'LI') AND NOT array_contains(types, 'L')"),
    ("ACCESS_009", "advisory", "NOT array_contains(types, 'Artifact')"),
    ("ACCESS_010", "warning", "size(types) = 0"),
    ("ACCESS_011", "advisory", "NOT arrays_overlap(types, array('Em', 'Strong'))"),
)

ANNOTATION: tuple[Rule, ...] = (
    ("ANNOT_006", "advisory", "subtype = 'TrapNet'"),
    ("ANNOT_002", "error", "subtype IN ('Sound', 'Movie', 'Screen', '3D', 'RichMedia')"),
    ("ANNOT_003", "advisory", "subtype = 'Link'"),
    ("ANNOT_004", "advisory", "subtype = 'Stamp'"),
    ("ANNOT_001", "warning", "printable AND x0 < tx1 AND tx0 < x1 AND y0 < ty1 AND ty0 < y1"),
    ("ANNOT_005", "advisory", "subtype NOT IN ('TrapNet', 'Sound', 'Movie', 'Screen', '3D', 'RichMedia', 'Link', 'Stamp', 'PrinterMark')"),
)

LAYER: tuple[Rule, ...] = (("STRUCT_010", "advisory", "print_state <> view_state"), ("PROC_001", "advisory", "finishing"), ("PROC_002", "advisory", "white"))

# Subtypes of an output intent that are known (fixed values of the format).
INTENT_SUBTYPES = ("GTS_PDFX", "GTS_PDFA1", "ISO_PDFE1")

PROFILE: tuple[Rule, ...] = (
    ("ICC_001", "error", "components <> CASE space WHEN 'GRAY' THEN 1 WHEN 'RGB' THEN 3 WHEN 'Lab' THEN 3 WHEN 'CMYK' THEN 4 END"),
    ("ICC_003", "error", "size = 0"),
    ("ICC_004", "warning", f"is_intent AND coalesce(subtype, '') NOT IN {INTENT_SUBTYPES}"),
    ("ICC_004", "warning", "is_intent AND coalesce(condition, '') = ''"),
    ("ICC_005", "advisory", "is_intent AND condition <> ''"),
    ("ICC_007", "warning", "NOT has_tags"),
    ("ICC_009", "warning", "abs(white_x - 0.9642) > 0.01 OR abs(white_z - 0.8249) > 0.01"),
)

SPACE: tuple[Rule, ...] = (
    ("COLOR_001", "error", "cs_type IN ('CalGray', 'CalRGB')"),
    ("COLOR_002", "warning", "cs_type = 'DeviceRGB' AND NOT has_profile"),
    ("COLOR_003", "warning", "cs_type IN ('Separation', 'DeviceN') AND alternate IS NULL"),
    ("COLOR_007", "advisory", "cs_type IN ('Separation', 'DeviceN') AND colorant <> '' AND colorant NOT IN ('All', 'None')"),
    ("COLOR_018", "advisory", "cs_type = 'Lab'"),
    ("COLOR_019", "advisory", "cs_type = 'Indexed'"),
    ("COLOR_015", "advisory", "cs_type IN ('DeviceRGB', 'DeviceCMYK', 'DeviceGray') AND has_intent"),
    ("COLOR_020", "warning", "has_default"),
)

#: Colour-space families by type (fixed values of the page description format).
FAMILIES = {"device": ("DeviceGray", "DeviceRGB", "DeviceCMYK"), "calibrated": ("CalGray", "CalRGB", "Lab", "ICCBased"), "special": ("Separation", "DeviceN", "Indexed", "Pattern")}

X4, X1A, A1, A2 = "X-4", "X-1a", "A-1", "A-2"

#: (packs, identifier, severity, table, predicate); ``@`` in an identifier is the pack's prefix.
PACKS: tuple[tuple[str, str, str, str, str], ...] = (
    (X4, "PDFX4-001", "error", "docs", "coalesce(try_cast(version AS DOUBLE), 0) < 1.6"),
    (X4, "PDFX4-002", "error", "docs", "coalesce(version, '') = ''"),
    (X4, "PDFX4-004", "advisory", "docs", "linearized"),
    (X4, "PDFX4-083", "warning", "docs", "NOT has_id"),
    (X4, "PDFX4-084", "advisory", "docs", "has_prev"),
    (X4, "PDFX4-005", "error", "docs", "NOT has_xmp"),
    (X4, "PDFX4-006", "error", "docs", "has_xmp AND coalesce(xmp_pdfx, '') <> 'PDF/X-4'"),
    (X4, "PDFX4-008", "warning", "docs", "has_xmp AND xmp_version <> '' AND xmp_version <> version"),
    (X4, "PDFX4-009", "warning", "docs", "has_xmp AND NOT has_create_date"),
    (X4, "PDFX4-010", "warning", "docs", "has_xmp AND NOT has_mod_date"),
    (X4, "PDFX4-011", "warning", "docs", "has_xmp AND coalesce(xmp_title, '') = ''"),
    (X4, "PDFX4-012", "warning", "docs", "trapped NOT IN ('True', 'False', 'Unknown')"),
    (X4, "PDFX4-013", "advisory", "docs", "title <> '' AND xmp_title <> '' AND title <> xmp_title"),
    (X4, "PDFX4-016", "error", "docs", "intents = 0"),
    (X4, "PDFX4-018", "error", "docs", "intents > 0 AND coalesce(condition, '') = ''"),
    (X4, "PDFX4-019", "error", "docs", "intents > 0 AND NOT intent_profile"),
    (X4, "PDFX4-017", "error", "docs", "intents > 0 AND intent_subtype <> 'GTS_PDFX'"),
    (X4, "PDFX4-023", "warning", "docs", "intents > 1 AND intent_subtype = 'GTS_PDFX'"),
    (X4, "PDFX4-063", "error", "docs", "encrypted"),
    (X4, "PDFX4-065", "error", "docs", "NOT reader_allowed"),
    (X4, "PDFX4-069", "warning", "docs", "layers = 0 AND has_layer_config"),
    (X4, "PDFX4-071", "error", "docs", "names_js OR open_js"),
    (X4, "PDFX4-072", "error", "docs", "launch_action"),
    (X4, "PDFX4-073", "error", "docs", "embedded_files"),
    (X4, "PDFX4-074", "error", "docs", "xfa"),
    (X4, "PDFX4-075", "error", "docs", "transfer_functions"),
    (X4, "PDFX4-076", "advisory", "docs", "halftones"),
    (X4, "PDFX4-077", "error", "docs", "ps_xobjects > 0"),
    (X4, "PDFX4-043", "advisory", "docs", "transparency"),
    (X1A, "PDFX1A-017", "error", "docs", "coalesce(info_pdfx, '') = ''"),
    (X1A, "PDFX1A-019", "warning", "docs", "trapped IS NULL"),
    (X1A, "PDFX1A-020", "warning", "docs", "NOT has_create_date"),
    (X1A, "PDFX1A-021", "warning", "docs", "NOT has_mod_date"),
    (X1A, "PDFX1A-022", "warning", "docs", "coalesce(title, '') = ''"),
    (X1A, "PDFX1A-023", "error", "docs", "intents = 0"),
    (X1A, "PDFX1A-025", "error", "docs", "intents > 0 AND coalesce(condition, '') = ''"),
    (X1A, "PDFX1A-024", "error", "docs", "intents > 0 AND intent_subtype <> 'GTS_PDFX'"),
    (X1A, "PDFX1A-028", "warning", "docs", "intents > 1 AND intent_subtype = 'GTS_PDFX'"),
    (X1A, "PDFX1A-029", "error", "docs", "transparency"),
    (X1A, "PDFX1A-034", "error", "docs", "names_js OR open_js"),
    (X1A, "PDFX1A-035", "error", "docs", "embedded_files"),
    (X1A, "PDFX1A-036", "error", "docs", "form_fields > 0"),
    (X1A, "PDFX1A-039", "error", "docs", "encrypted"),
    (X1A, "PDFX1A-040", "error", "docs", "transfer_functions"),
    (X1A, "PDFX1A-041", "error", "docs", "halftones"),
    (X1A, "PDFX1A-045", "error", "docs", "layers > 0"),
    (A1, "PDFA-010", "error", "docs", "NOT has_metadata"), (A2, "PDFA-010", "error", "docs", "NOT has_metadata"),
    (A1, "PDFA-001", "error", "docs", "NOT has_xmp"), (A2, "PDFA-001", "error", "docs", "NOT has_xmp"),
    (A1, "PDFA-002", "error", "docs", "has_xmp AND coalesce(pdfa_part, '') = ''"), (A2, "PDFA-002", "error", "docs", "has_xmp AND coalesce(pdfa_part, '') = ''"),
    (A1, "PDFA-003", "error", "docs", "has_xmp AND coalesce(pdfa_conformance, '') = ''"), (A2, "PDFA-003", "error", "docs", "has_xmp AND coalesce(pdfa_conformance, '') = ''"),
    (A1, "PDFA-004", "warning", "docs", "has_xmp AND title <> '' AND xmp_title <> '' AND title <> xmp_title"), (A2, "PDFA-004", "warning", "docs", "has_xmp AND title <> '' AND xmp_title <> '' AND title <> xmp_title"),
    (A1, "PDFA-005", "warning", "docs", "NOT has_create_date"), (A2, "PDFA-005", "warning", "docs", "NOT has_create_date"),
    (A1, "PDFA-006", "warning", "docs", "NOT has_mod_date"), (A2, "PDFA-006", "warning", "docs", "NOT has_mod_date"),
    (A1, "PDFA-007", "error", "docs", "intents = 0"), (A2, "PDFA-007", "error", "docs", "intents = 0"),
    (A1, "PDFA-008", "error", "docs", "intents > 0 AND NOT intent_profile AND coalesce(condition, '') = ''"), (A2, "PDFA-008", "error", "docs", "intents > 0 AND NOT intent_profile AND coalesce(condition, '') = ''"),
    (A1, "PDFA-009", "error", "docs", "try_cast(version AS DOUBLE) > 1.4"), (A2, "PDFA-009", "error", "docs", "try_cast(version AS DOUBLE) > 1.7"),
    (A1, "PDFA-026", "error", "docs", "names_js OR open_js"), (A2, "PDFA-026", "error", "docs", "names_js OR open_js"),
    (A1, "PDFA-027", "error", "docs", "encrypted"), (A2, "PDFA-027", "error", "docs", "encrypted"),
    (A1, "PDFA-028", "error", "docs", "embedded_files"), (A2, "PDFA-028", "warning", "docs", "embedded_files"),
    (A1, "PDFA-031", "error", "docs", "xfa"), (A2, "PDFA-031", "error", "docs", "xfa"),
    (A1, "PDFA-033", "error", "docs", "transparency"),
    (A1, "PDFA-035", "error", "docs", "layers > 0"), (A2, "PDFA-035", "warning", "docs", "layers > 0"),
    (A1, "PDFA-037", "error", "docs", "transfer_functions"), (A2, "PDFA-037", "error", "docs", "transfer_functions"),
    (A1, "PDFA-038", "error", "docs", "ps_xobjects > 0"), (A2, "PDFA-038", "error", "docs", "ps_xobjects > 0"),
    (X4, "PDFX4-050", "error", "pages", "tx0 IS NULL"),
    (X4, "PDFX4-052", "warning", "pages", "bx0 < coalesce(cx0, mx0) OR by0 < coalesce(cy0, my0) OR bx1 > coalesce(cx1, mx1) OR by1 > coalesce(cy1, my1)"),
    (X4, "PDFX4-053", "warning", "pages", "tx0 < bx0 OR ty0 < by0 OR tx1 > bx1 OR ty1 > by1"),
    (X4, "PDFX4-054", "error", "pages", "tx1 <= tx0 OR ty1 <= ty0 OR bx1 <= bx0 OR by1 <= by0"),
    (X4, "PDFX4-055", "warning", "pages", "cx0 < mx0 OR cy0 < my0 OR cx1 > mx1 OR cy1 > my1"),
    (X4, "PDFX4-036", "error", "fonts", "NOT embedded AND subtype <> 'Type3'"),
    (X4, "PDFX4-037", "error", "fonts", "NOT embedded AND subtype = 'TrueType'"),
    (X1A, "PDFX1A-012", "error", "fonts", "subtype = 'Type3'"),
    (X1A, "PDFX1A-011", "error", "fonts", "NOT embedded AND subtype <> 'Type3'"),
    (A1, "PDFA-022", "error", "fonts", "subtype = 'Type3'"),
    (A1, "PDFA-019", "error", "fonts", "NOT embedded AND subtype <> 'Type3'"), (A2, "PDFA-019", "error", "fonts", "NOT embedded AND subtype <> 'Type3'"),
    (A1, "PDFA-020", "warning", "fonts", "NOT has_unicode AND subtype = 'Type0'"), (A2, "PDFA-020", "warning", "fonts", "NOT has_unicode AND subtype = 'Type0'"),
    (X4, "PDFX4-026", "warning", "spaces", "cs_type = 'CalGray'"),
    (X4, "PDFX4-027", "warning", "spaces", "cs_type = 'CalRGB'"),
    (X4, "PDFX4-028", "warning", "spaces", "cs_type = 'DeviceRGB' AND NOT has_default"),
    (X4, "PDFX4-033", "advisory", "spaces", "cs_type = 'DeviceN'"),
    (X4, "PDFX4-034", "advisory", "spaces", "cs_type = 'Lab'"),
    (X1A, "PDFX1A-001", "error", "spaces", "cs_type = 'DeviceRGB'"),
    (X1A, "PDFX1A-003", "error", "spaces", "cs_type = 'CalRGB'"),
    (X1A, "PDFX1A-004", "error", "spaces", "cs_type = 'CalGray'"),
    (X1A, "PDFX1A-005", "error", "spaces", "cs_type = 'Lab'"),
    (A1, "PDFA-011", "error", "spaces", "cs_type IN ('DeviceRGB', 'DeviceCMYK') AND NOT has_intent"), (A2, "PDFA-011", "error", "spaces", "cs_type IN ('DeviceRGB', 'DeviceCMYK') AND NOT has_intent"),
    (X4, "PDFX4-057", "error", "annotations", "subtype = 'Sound'"),
    (X4, "PDFX4-058", "error", "annotations", "subtype = 'Movie'"),
    (X4, "PDFX4-059", "error", "annotations", "subtype = '3D'"),
    (X4, "PDFX4-060", "error", "annotations", "subtype IN ('RichMedia', 'Screen')"),
    (X4, "PDFX4-061", "advisory", "annotations", "subtype = 'PrinterMark' AND NOT printable"),
    (X4, "PDFX4-062", "advisory", "annotations", "subtype = 'TrapNet'"),
    (A1, "PDFA-029", "error", "annotations", "subtype IN ('Sound', 'Movie', 'Screen', '3D', 'RichMedia')"), (A2, "PDFA-029", "error", "annotations", "subtype IN ('Sound', 'Movie', 'Screen', '3D', 'RichMedia')"),
)


def apply_rules(rows: DataFrame, rules: tuple[Rule, ...], *keep: str) -> DataFrame:
    """(*keep, inspection_id, severity) of every rule that holds, in one scan."""
    return fused(rows, {f"{name}#{i}": (severity, F.expr(test)) for i, (name, severity, test) in enumerate(rules)}, *keep)


def standards(tables: dict[str, DataFrame], packs: tuple[str, ...] = (X4, X1A, A1, A2)) -> DataFrame:
    """(job_id, pack, inspection_id, severity, n): rules of standards packs that documents break, and how many objects break them.

    ``tables``: docs, pages, fonts, spaces, annotations. Each is scanned once for all packs and reduced by document.
    """
    found = None
    for name, rows in tables.items():
        mine = [(pack, rule, severity, test) for pack, rule, severity, table, test in PACKS if table == name and pack in packs]
        if not mine:
            continue
        hits = [F.when(F.expr(test), F.struct(F.lit(pack).alias("pack"), F.lit(rule).alias("inspection_id"), F.lit(severity).alias("severity"))) for pack, rule, severity, test in mine]
        out = rows.select("job_id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("job_id", "h.*").groupBy("job_id", "pack", "inspection_id", "severity").agg(F.count("*").alias("n"))
        found = out if found is None else found.unionByName(out)
    return found


def conformance(broken: DataFrame) -> DataFrame:
    """(job_id, pack, errors, conforms) of documents with findings of a pack: it conforms if none is an error."""
    errors = F.count_if(F.col("severity") == "error")
    return broken.groupBy("job_id", "pack").agg(errors.alias("errors"), (errors == 0).alias("conforms"))


def profile_conflicts(profiles: DataFrame) -> DataFrame:
    """Per document: profiles of versions 2 and 4 together (ICC_002), several rendering intents (ICC_008), output intents of different colour spaces (ICC_006)."""
    told = {"version": F.substring("version", 1, 1), "rendering": F.col("rendering"), "space": F.when(F.col("is_intent"), F.col("space"))}
    # several values are there if the least is not the greatest: a row is not repeated for each column, as distinct counts do
    per = profiles.groupBy("job_id").agg(*[f(c).alias(f"{name}_{k}") for name, c in told.items() for k, f in (("least", F.min), ("most", F.max))])
    several = lambda name: f"{name}_least < {name}_most"
    return apply_rules(per, (("ICC_002", "advisory", several("version")), ("ICC_008", "advisory", several("rendering")), ("ICC_006", "warning", several("space"))), "job_id")


def color_space_rules(spaces: DataFrame, docs: DataFrame) -> DataFrame:
    """(job_id, page_num, inspection_id, severity) of colour spaces, each kind once a page, and of documents without an output intent
    (COLOR_006, page 0). What any of a page's spaces of one kind and name has counts for it.
    """
    once = spaces.groupBy("job_id", "page_num", "cs_type", "colorant").agg(F.max("alternate").alias("alternate"), *[F.bool_or(c).alias(c) for c in ("has_profile", "has_default", "has_intent")])
    found = apply_rules(once, SPACE, "job_id", "page_num")
    none = apply_rules(docs.select("job_id", F.lit(0).alias("page_num"), "intents"), (("COLOR_006", "warning", "intents = 0"),), "job_id", "page_num")
    return found.unionByName(none)


def structure_tag_rules(nodes: DataFrame, docs: DataFrame, images: DataFrame) -> DataFrame:
    """(job_id, page_num, inspection_id, severity): rules on a tagged document's structure elements (job_id, type), page 0, and its pages
    with images, which need alternate text (ACCESS_005). Elements are reduced to a set of types before the join.
    """
    tagged = docs.where("tagged").select("job_id")
    sets = nodes.groupBy("job_id").agg(F.collect_set("type").alias("types"))
    rows = tagged.join(sets, "job_id", "left").select("job_id", F.lit(0).alias("page_num"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))
    alt = images.select("job_id", "page_num").distinct().join(tagged, "job_id", "left_semi")
    return apply_rules(rows, TAGS, "job_id", "page_num").unionByName(apply_rules(alt, (("ACCESS_005", "warning", "true"),), "job_id", "page_num"))


def packaging(layers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Dieline layers per packaging job: there is one (PKG_001), none (PKG_002), and each that does not print (PKG_003)."""
    per = layers.groupBy("job_id").agg(F.bool_or("dieline").alias("dieline"), F.collect_set(F.when(F.col("dieline") & (F.col("print_state") == "OFF"), F.trim("name"))).alias("silent"))
    rows = jobs.join(per, "job_id", "left").fillna(False, ["dieline"])
    each = rows.select("job_id", F.explode("silent").alias("layer")).select("job_id", F.lit("PKG_003").alias("inspection_id"), F.lit("advisory").alias("severity"))
    return apply_rules(rows, (("PKG_001", "advisory", "dieline"), ("PKG_002", "warning", "NOT dieline")), "job_id").unionByName(each)


def named_resources(layers: DataFrame, inks: DataFrame, pattern: str) -> DataFrame:
    """(job_id, name, source) of layers and inks whose name fits a pattern, once per lower-case name; layers come first."""
    both = layers.select("job_id", "name", F.lit("layer").alias("source")).unionByName(inks.select("job_id", F.col("ink").alias("name"), F.lit("spot").alias("source"))).where(F.col("name").rlike(pattern))
    return both.groupBy("job_id", F.lower("name").alias("name")).agg(F.min("source").alias("source"))


def name_taxonomy(inks: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Names that stand for another (SPOT_NONCANONICAL), vague whites, and mixed case styles of a job's names, in one pass each.

    ``synonyms`` is part of the plan.
    """
    low = F.lower(F.trim("ink"))
    known = F.create_map(*[F.lit(x) for item in synonyms.items() for x in item])[low]
    # what follows from a name is not sent with it
    rows = inks.select("job_id", "ink").distinct().select("job_id", "ink", low.alias("low"), known.alias("canonical"))
    each = apply_rules(rows, (("SPOT_NONCANONICAL", "advisory", "canonical IS NOT NULL AND canonical <> low"), ("SPOT_WHITE_SUBTYPE", "advisory", "low IN ('white', 'opaque', 'weiss')")), "job_id", "low")
    styles = rows.groupBy("job_id").agg(F.count_if(F.col("ink").rlike("[A-Z]") & (F.upper("ink") == F.col("ink"))).alias("upper"), F.count_if(F.col("ink").rlike("[a-z]")).alias("mixed"))
    return each.unionByName(apply_rules(styles, (("SPOT_CASE_STYLES", "advisory", "upper > 0 AND mixed > 0"),), "job_id").withColumn("low", F.lit(None).cast("string")))


def code_content(codes: DataFrame, valid_digit) -> DataFrame:
    """Bar codes (job_id, code, payload, nearby): check digit, link syntax, and printed text that the payload does not repeat."""
    digits = F.col("payload").rlike(r"^\d{12,14}$")
    rules = {
        "BARCODE_CHECK_DIGIT": ("error", digits & ~valid_digit),
        "BARCODE_URL": ("warning", F.col("payload").startswith("http") & ~F.col("payload").rlike(r"^https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(/\S*)?$")),
        "BARCODE_TEXT_MISMATCH": ("advisory", (F.col("nearby") != "") & ~F.translate("nearby", " ", "").contains(F.col("payload"))),
    }
    return fused(codes, rules, "job_id", "code")


def regulations(rules: DataFrame, authority: str, day: str) -> DataFrame:
    """Regulations of an authority in force on a day, one row for each check that they are linked to."""
    live = rules.where((F.col("authority") == authority) & (F.col("from_day") <= day) & (F.col("until_day").isNull() | (F.col("until_day") >= day)))
    return live.select("regulation_id", F.explode("checks").alias("check"))


def x_height_mm(size_pt, ratio, fallback: float = 0.5):
    """x-height in millimetres: size by the font's ratio, if that is between 0.3 and 0.8, else by the fallback."""
    return size_pt * F.when(ratio.between(0.3, 0.8), ratio).otherwise(fallback) * 25.4 / 72.0
