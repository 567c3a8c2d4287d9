"""Registered queries on third-party reports and job tickets; the payloads are made from the given tables, in each dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.plans.registry import query
from platewise.plans.views import oracle, table, view
from platewise.sources import reports as Z
from platewise.sources.shared import shared_path

#: A tenant's mapping of its own XML format.
MAPPING = {
    "format": "xml", "item_selector": "Issues/Issue", "severity_map": {"high": "error", "low": "advisory"},
    "fields": {"severity": "@level", "message": "Description", "page": "@page", "bbox": "Geometry/Box", "check_id": "@ruleId", "object_type": {"selector": "Object/@kind"}, "object_id": "Object"},
}
KINDS = ("acrobat_xml", "pitstop_xml", "callas_xml", "callas_json", "native_json", "custom")


def _joined(item: Column, separator: str = "") -> Column:
    """The items of a job in order of ord."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda e: e["x"]), separator)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, kind, payload): each job's findings as a report in the dialect of its number; every fifth item has no message."""
    rows = view(spark, sf_dir, "v_findings")
    message = F.when(F.col("ord") % 5 == 0, " ").otherwise(F.concat(F.lit("Rule "), "inspection_id", F.lit(" &lt;b&gt; at "), F.col("ord").cast("string")))
    plain = F.replace(F.replace(message, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    c = {"id": F.col("inspection_id"), "m": message, "t": plain, "p": F.col("page_num").cast("string"), "o": F.col("ord").cast("string"), "s": F.col("severity"), "S": F.initcap("severity"), "w": F.when(F.col("severity") == "advisory", "hint").otherwise(F.col("severity"))}

    def made(pattern: str) -> Column:
        """A pattern with columns in brackets."""
        parts = pattern.split("[")
        return F.concat(F.lit(parts[0]), *[x for p in parts[1:] for x in (c[p.split("]", 1)[0]], F.lit(p.split("]", 1)[1]))])

    items = {
        "acrobat_xml": made('<Hit severity="[S]" page="[p]"><Description>[m]</Description><Rule>[id]</Rule><BBox>[o] 2 30 4.5</BBox></Hit>'),
        "pitstop_xml": F.when(F.col("severity") == "advisory", made("<e:ResultItem><e:Severity>info</e:Severity><e:Message>[m]</e:Message><e:Code>[id]</e:Code><e:Page>[p]</e:Page></e:ResultItem>")).otherwise(made('<e:[S]><e:CheckID>[id]</e:CheckID><e:Description>[m]</e:Description><e:Page>[p]</e:Page><e:BBox llx="[o]" lly="2" urx="30" ury="4.5"/></e:[S]>')),
        "callas_xml": made('<hit id="[id]"><severity>[w]</severity><comment>[m]</comment><page>[p]</page><geometry><bbox x0="[o]" y0="2" x1="30" y1="4.5"/></geometry></hit>'),
        "callas_json": made('{"rule_id":"[id]","level":"[s]","comment":"[t]","pageNumber":"[p]","geometry":{"x":[o],"y":2,"width":4,"height":2.5}}'),
        "native_json": F.concat(made('{"inspection_id":"[id]","severity":"[s]","message":"[t]","page_num":[p],"bbox":'), F.lit("["), c["o"], F.lit(",2,30,4.5]}")),
        "custom": F.concat(F.lit('<Issue level="'), F.when(F.col("severity") == "error", "HIGH").when(F.col("severity") == "warning", "odd").otherwise("Low"), made('" page="[p]" ruleId="[id]"><Description>[m]</Description><Geometry><Box>[o] 2 30 4.5</Box></Geometry><Object kind="image">Im[o]</Object></Issue>')),
    }
    wraps = {
        "acrobat_xml": ('<?xml version="1.0"?><Preflight><Hits>', "</Hits></Preflight>", ""), "pitstop_xml": ('<e:PitStopReport xmlns:e="urn:e"><e:Results>', "</e:Results></e:PitStopReport>", ""), "callas_xml": ("<preflight_report><!-- x --><hits>", "</hits></preflight_report>", ""),
        "callas_json": ('{"pdfToolboxVersion":"1","hits":[', "]}", ","), "native_json": ('{"schema_version":"1","findings":[', "]}", ","), "custom": ("<Log><Issues>", "</Issues></Log>", ""),
    }
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("job_id") % len(KINDS) + 1).cast("int"))
    item = payload = F.lit(None).cast("string")
    for name in KINDS:
        item = F.when(kind == name, items[name]).otherwise(item)
        start, end, separator = wraps[name]
        payload = F.when(F.col("kind") == name, F.concat(F.lit(start), F.col("body_comma" if separator else "body"), F.lit(end))).otherwise(payload)
    per = rows.withColumn("kind", kind).withColumn("item", item).groupBy("job_id", "kind").agg(_joined(F.col("item")).alias("body"), _joined(F.col("item"), ",").alias("body_comma"))
    # a broken report among them gives nothing
    return per.select("job_id", "kind", F.when(F.col("job_id") % 17 == 0, F.expr("substr(body, 1, 40)")).otherwise(payload).alias("payload"))


@query(
    oracle(
        "v_findings",
        """SELECT job_id, source, inspection_id, severity, page_num, x0, x1, count(*) AS n FROM (SELECT job_id, 'external:' || ['acrobat', 'pitstop', 'callas', 'callas', 'native', 'custom'][job_id % 6 + 1] AS source,
  ['EXT-ACROBAT-', 'EXT-PS-', 'EXT-CALLAS-', 'EXT-CALLAS-', 'EXT-NATIVE-', 'EXT-CUSTOM-'][job_id % 6 + 1] || inspection_id AS inspection_id, severity, page_num,
  CASE WHEN job_id % 6 = 1 AND severity = 'advisory' THEN NULL ELSE CAST(ord AS DOUBLE) END AS x0, CASE WHEN job_id % 6 = 1 AND severity = 'advisory' THEN NULL WHEN job_id % 6 = 3 THEN CAST(ord + 4 AS DOUBLE) ELSE 30.0::DOUBLE END AS x1
  FROM v_findings WHERE ord % 5 <> 0 AND job_id % 17 <> 0) GROUP BY ALL""",
    )
)
def s3_report_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "reports")
    # each dialect reads its own reports only
    _payloads(spark, sf_dir).write.partitionBy("kind").parquet(path)
    payloads = spark.read.parquet(path)
    found = None
    for name, dialect in (Z.DIALECTS | {"custom": Z.mapped(MAPPING)}).items():
        one = Z.report_findings(payloads.where(F.col("kind") == name), dialect)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("job_id", "source", "inspection_id", "severity", "page_num", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1")).agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS media_type, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE round(o_custkey * 0.352778::DOUBLE, 6) END AS width,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'FOGRA39;PMS ' || (o_orderkey % 4) END AS spots, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 > 0 THEN round(o_orderkey % 7 * 0.352778::DOUBLE, 6) END AS min_bleed_mm, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS condition FROM orders"""
)
def s4_job_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string(
        '<?xml version="1.0"?><j:JDF xmlns:j="http://www.CIP4.org/JDFSchema_1_1"><j:Media MediaType="x"/><j:Media MediaType="%s" Dimension="%s"/><j:ColorIntent NumColors="4"><j:SeparationSpec Name="FOGRA39"/><j:SeparationSpec Name="PMS %d"/><j:SeparationSpec Name="FOGRA39"/></j:ColorIntent><j:ColorSpaceConversionParams FinalTargetDevice="%s"/><j:LayoutPreparationParams BleedMargin="%d"/></j:JDF>',
        "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "wide high").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(" 20.5"))), F.col("o_orderkey") % 4, "o_orderstatus", F.col("o_orderkey") % 7,
    )
    tickets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 5 == 0, F.substring(body, 1, 120)).otherwise(body).alias("payload"))
    told = Z.ticket_parameters(tickets)
    limits = Z.ticket_overrides(told).select("job_id", F.round(F.col("overrides")["min_bleed_mm"].cast("double"), 6).alias("min_bleed_mm"), F.col("overrides")["target_output_condition"].alias("condition"))
    return told.select("job_id", "media_type", F.round("trim_width_mm", 6).alias("width"), F.array_join("spot_colors", ";").alias("spots")).join(limits, "job_id")
