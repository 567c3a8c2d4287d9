"""The event log, third-party reports and job tickets."""

import json

import pytest
from pyspark.sql import functions as F

from platewise.operators import families, layout
from platewise.sources import event_log, reports
from platewise.sources.shared import shared_path


def test_the_event_log_is_read_as_it_lies(spark, tmp_path):
    events = [{"job_id": j, "page_num": p, "op_idx": i, "kind": k, **more} for j in (1, 2) for p, i, k, more in [
        (1, 1, "overprint", {"overprint_fill": True, "overprint_stroke": False, "overprint_mode": 0}), (1, 2, "colour", {"color_space": "/CS4", "stroking": True}), (1, 3, "path", {"stroke": True, "fill": False}),
        (2, 1, "colour", {"color_space": "CS4", "stroking": False}), (2, 2, "path", {"fill": True, "stroke": True, "stroke_color_space": "DeviceCMYK"}), (2, 3, "colour", {"color_space": "DeviceRGB", "unknown": 3}),
    ]]
    (tmp_path / "raw.json").write_text("\n".join(map(json.dumps, reversed(events))))
    raw = event_log.raw_events(spark, str(tmp_path / "raw.json"))
    assert raw.count() == 12 and raw.columns == event_log.fields().names
    event_log.write_event_log(raw, "log_of_test", str(tmp_path / "log"), 3)
    log = event_log.event_log(spark, "log_of_test")
    cutting = layout.cutting_offences(layout.cutting_paints(event_log.with_state(log), {"CS4": "Cut"}))
    assert sorted(map(tuple, cutting.collect())) == [(j, "Cut", 1, 3, 1, False) for j in (1, 2)]
    rows = log.select(*event_log.ORDER, "kind", "color_space", F.col("overprint_fill").alias("overprint"), F.col("overprint_mode").alias("opm"), F.col("fill_alpha").alias("alpha"), *[F.lit(0.0).alias(x) for x in "cmyk"])
    found = families.overprint_rules(rows, ("page_num", "op_idx"))
    assert sorted(map(tuple, found.collect())) == [(j, 2, 3, "OVER_006", "error") for j in (1, 2)]
    for plan in (cutting, found):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Window" in text and "Exchange" not in text and "Sort " not in text


ACROBAT = """<?xml version="1.0" encoding="UTF-8"?>
<Preflight><Status>Error</Status><Summary><Profile>Prepress (PDF/X-1a)</Profile></Summary>
  <Hits>
    <Hit severity="Error" page="3"><Description>Image resolution too low</Description><Rule>IMG_RES_LOW</Rule><BBox>72 72 144 144</BBox><ObjectId>Im7</ObjectId></Hit>
    <Hit severity="Warning" page="1"><Description>Trim box missing</Description><Rule>TRIM_MISSING</Rule></Hit>
    <Problem severity="Info"><Description>Legacy &amp; row</Description><Rule>LEGACY_OK</Rule></Problem>
    <Hit severity="Error"><!-- no message --></Hit>
  </Hits>
</Preflight>"""
PITSTOP = """<n:PitStopReport xmlns:n="urn:x"><n:Results>
    <n:Error><n:CheckID>IMG_LOWRES</n:CheckID><n:Description>Below 300 dpi</n:Description><n:Category>Images</n:Category><n:Page>2</n:Page><n:Rect llx="1" lly="2" urx="3" ury="4"/><n:ISO>PDF/X-4 6.2.3</n:ISO></n:Error>
    <n:ResultItem><n:Severity>caution</n:Severity><n:Label>Sized</n:Label><n:X>10</n:X><n:Y>20</n:Y><n:Width>5</n:Width><n:Height>6</n:Height></n:ResultItem>
    <n:Info><n:CheckID>OK</n:CheckID><n:Description>Applied</n:Description></n:Info><n:Error/>
  </n:Results></n:PitStopReport>"""
CALLAS = """<preflight_report><hits><hit id="A1" severity="fatal"><comment>Too dark</comment><page>4</page><geometry><bbox x0="1" y0="2" x1="3" y1="4"/></geometry></hit><hit><page>x</page><description>Plain</description></hit></hits></preflight_report>"""
CALLAS_JSON = '{"pdfToolboxVersion": "13.2", "profile": "X", "hits": [{"rule_id": "LOW", "severity": "error", "comment": "120 dpi", "page": 5, "geometry": {"bbox": [100, 200, 300, 400]}, "object_id": "Im2"}, {"level": "", "type": "hint", "message": "Glyphs", "page": "1", "box": [1, 2]}, 7, {"severity": "error"}]}'
NATIVE = '{"schema_version": "1", "findings": [{"inspection_id": "EXT-A", "severity": "odd", "message": "one", "page": 2}, {"inspection_id": "B", "severity": "note", "message": " two ", "bbox": [1, 2, 3, 4.5]}, {"message": ""}]}'


def found(spark, payload, dialect):
    rows = reports.report_findings(spark.createDataFrame([(1, payload)], "job_id long, payload string"), dialect).collect()
    return [(r.inspection_id, r.severity, r.message, r.page_num, tuple(r.bbox) if r.bbox else None, r.category) for r in rows]


def test_dialects_of_reports(spark):
    assert found(spark, ACROBAT, reports.ACROBAT) == [
        ("EXT-ACROBAT-IMG_RES_LOW", "error", "Image resolution too low", 3, (72.0, 72.0, 144.0, 144.0), "acrobat"), ("EXT-ACROBAT-TRIM_MISSING", "warning", "Trim box missing", 1, None, "acrobat"), ("EXT-ACROBAT-LEGACY_OK", "advisory", "Legacy & row", 0, None, "acrobat"),
    ]
    got = found(spark, PITSTOP, reports.PITSTOP)
    assert got[0] == ("EXT-PS-IMG_LOWRES", "error", "Below 300 dpi", 2, (1.0, 2.0, 3.0, 4.0), "Images") and got[2][:3] == ("EXT-PS-OK", "advisory", "Applied")
    assert got[1][1:] == ("warning", "Sized", 0, (10.0, 20.0, 15.0, 26.0), "pitstop") and len(got) == 3 and len(got[1][0]) > len("EXT-PS-") + 12
    assert [g[1:5] for g in found(spark, CALLAS, reports.CALLAS_XML)] == [("error", "Too dark", 4, (1.0, 2.0, 3.0, 4.0)), ("warning", "Plain", 0, None)]
    assert [g[1:5] for g in found(spark, CALLAS_JSON, reports.CALLAS_JSON)] == [("error", "120 dpi", 5, (100.0, 200.0, 300.0, 400.0)), ("advisory", "Glyphs", 1, None)]
    assert found(spark, NATIVE, reports.NATIVE) == [("EXT-A", "warning", "one", 2, None, ""), ("EXT-NATIVE-B", "advisory", "two", 0, (1.0, 2.0, 3.0, 4.5), "")]


def test_broken_and_empty_reports_give_nothing(spark):
    for payload in (None, "", "<Preflight><Hits><Hit", "<not-closed>", "plain", "[1, 2]", '{"hits": 3}', "{"):
        for dialect in reports.DIALECTS.values():
            assert found(spark, payload, dialect) == []
    inner = "<Preflight><Hit><Description>ok</Description></Hit><Hit><Description>bad</Hit></Preflight>"
    assert found(spark, inner, reports.ACROBAT) == []


def test_a_tenants_mapping(spark):
    xml = '<?xml version="1.0"?><PreflightLog><Issues><Issue level="HIGH" page="2" ruleId="IMG_DPI"><Description>Image below 300 dpi</Description><Geometry><Box>72 72 216 216</Box></Geometry><Object kind="image">Im3</Object></Issue><Issue level="fatal"><Description>Fatal</Description></Issue><Issue level="weird"><Description>Odd</Description></Issue><Issue level="HIGH" page="3"/></Issues></PreflightLog>'
    mapping = {"item_selector": "Issues/Issue", "severity_map": {"high": "error"}, "fields": {"severity": {"selector": "@level"}, "message": "Description", "page": "@page", "bbox": "Geometry/Box", "check_id": "@ruleId", "object_type": "Object/@kind", "unknown": "x"}}
    got = found(spark, xml, reports.mapped(mapping))
    assert got[0] == ("EXT-CUSTOM-IMG_DPI", "error", "Image below 300 dpi", 2, (72.0, 72.0, 216.0, 216.0), "") and [g[1] for g in got] == ["error", "error", "warning"]
    deep = '<ns:root xmlns:ns="urn:e"><ns:wrap><ns:Issue level="HIGH" page="4"><ns:Description>Deep</ns:Description></ns:Issue></ns:wrap></ns:root>'
    assert [g[1:4] for g in found(spark, deep, reports.mapped(mapping | {"item_selector": "//Issue"}))] == [("error", "Deep", 4)]
    json_map = {"format": "json", "item_selector": "results[*].issues[*]", "fields": {"severity": "sev", "message": "text", "page": "loc.page", "bbox": "loc.box", "check_id": "rule"}, "severity_map": {"blocker": "error"}}
    text = '{"results": [{"issues": [{"sev": "blocker", "text": "Bleed", "loc": {"page": 2, "box": [10, 20, 100, 200]}, "rule": "B"}, {"sev": "info", "text": "Profile", "loc": {"page": 0}}]}, {"issues": [{"sev": "blocker"}]}]}'
    assert [g[1:5] for g in found(spark, text, reports.mapped(json_map))] == [("error", "Bleed", 2, (10.0, 20.0, 100.0, 200.0)), ("advisory", "Profile", 0, None)]
    for bad in ({"item_selector": ""}, {"format": "csv", "item_selector": "a"}, {"item_selector": "a", "fields": {"message": "b[position()=1]"}}):
        with pytest.raises(ValueError):
            reports.mapped(bad)


def test_formats_are_told_apart(spark):
    payloads = [ACROBAT, PITSTOP, CALLAS, CALLAS_JSON, NATIVE, "<x><hit/></x>", "<x/>", "", None, '{"a": 1}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "n int, payload string").select("n", reports.format_of("payload").alias("f")).orderBy("n").collect()
    assert [r.f for r in rows] == ["acrobat_xml", "pitstop_xml", "callas_xml", "callas_json", "native_json", "callas_xml", None, None, None, None]


def test_job_tickets(spark):
    ticket = '<JDF xmlns="http://www.CIP4.org/JDFSchema_1_1"><Media MediaType="Paper" Dimension="100 200"/><Media Dimension="bad"/><ColorIntent NumColors="5"><SeparationSpec Name="Gold"/></ColorIntent><ColorSpaceConversionParams FinalTargetDevice="FOGRA51"/><LayoutPreparationParams BleedMargin="9"/></JDF>'
    told = reports.ticket_parameters(spark.createDataFrame([(1, ticket), (2, "<JDF"), (3, None)], "job_id long, payload string"))
    got = {r.job_id: r for r in told.collect()}
    assert (got[1].media_type, got[1].colors, got[1].spot_colors, got[1].output_condition) == ("Paper", "5", ["Gold"], "FOGRA51")
    assert abs(got[1].trim_width_mm - 35.2778) < 1e-9 and abs(got[1].bleed_mm - 3.175002) < 1e-9 and got[2].media_type is None and got[3].spot_colors == []
    limits = {r.job_id: set(r.overrides) for r in reports.ticket_overrides(told).collect()}
    assert limits == {1: {"min_bleed_mm", "target_output_condition"}, 2: set(), 3: set()}


def test_events_of_one_number_stand_as_they_were_told(spark):
    events = [(1, 1, 5, 0, "path", None, "CS4", True), (1, 1, 5, 1, "overprint", True, None, None), (1, 1, 5, 2, "path", None, "CS4", True), (1, 1, 5, 3, "overprint", False, None, None), (1, 1, 5, 4, "path", None, "CS4", True)]
    for k, rows in enumerate((events, events[::-1])):
        given = spark.createDataFrame(rows, "job_id long, page_num int, op_idx long, seq long, kind string, overprint_fill boolean, color_space string, fill boolean")
        event_log.write_event_log(given, f"ties_{k}", shared_path(spark, "ties"), 1)
        got = layout.cutting_offences(layout.cutting_paints(event_log.with_state(event_log.event_log(spark, f"ties_{k}")), {"CS4": "Cut"})).collect()
        assert [(r.ink, r.paints, r.never) for r in got] == [("Cut", 2, False)]


def test_an_item_is_parsed_once_for_all_selectors(spark):
    rows = spark.createDataFrame([(1, ACROBAT)], "job_id long, payload string")
    for plan in (reports.report_findings(rows, reports.ACROBAT), reports.ticket_parameters(rows)):
        assert "xpath" not in plan._jdf.queryExecution().toString().lower()
    root = reports._tree('<e:a><b x:k="1">t<c>u</c></b><c k="2"/><b><b k="3">v</b></b></e:a>'.replace("e:a", "a"))
    assert reports._values(root, "//b/@k") == ["3"] and reports._values(root, "/*/b") == ["tu", "v"] and reports._values(root, "//a//c") == ["u", ""] and reports._values(root, "/*/c/@k") == ["2"]


def test_a_report_is_parsed_once_for_all_its_items(spark):
    """Items are found among the elements, not in the text: one in another of its name and a sign of an end in an attribute do not break it."""
    nested = '<Preflight><Hit severity="error"><Description>outer</Description><Hit note="a/>b"><Description>inner</Description></Hit></Hit></Preflight>'
    assert sorted(g[1:3] for g in found(spark, nested, reports.ACROBAT)) == [("error", "outer"), ("warning", "inner")]
    plan = reports.report_findings(spark.createDataFrame([(1, nested)], "job_id long, payload string"), reports.ACROBAT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    for text in ('<e:a><e:Hit><Message>m</Message></e:Hit></e:a>', ' <?xml version="1.0" encoding="latin-1"?><!-- <Hit/> --><a xmlns="urn:x"><Hit><Message>m</Message></Hit></a>', "<a><Hit><Message><![CDATA[m]]></Message></Hit></a>"):
        assert [g[2] for g in found(spark, text, reports.ACROBAT)] == ["m"]
    assert found(spark, '<!DOCTYPE a [<!ENTITY x "m">]><a><Hit><Message>&x;</Message></Hit></a>', reports.ACROBAT) == []
