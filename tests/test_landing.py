"""Parsing, flattening and keys."""

import hashlib

import pytest

from sedimenta.config import DEFAULT, FLAT, Profile
from sedimenta.operators import landing
from sedimenta.sources import xml_documents
from tests.documents import NS, document, header, line

AT = "2024-05-06T07:08:09+00:00"


def parse(spark, texts, profile=DEFAULT):
    return xml_documents.parse(spark.createDataFrame(list(texts.items()), "source_file string, xml string"), profile)


def key(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def test_header_and_parties(spark):
    parsed = parse(spark, {"a.xml": document(lines=line(1) + line(2))})
    rows = landing.invoices(parsed, AT)
    assert len(rows.columns) == 35
    r = rows.first()
    assert r.sk == key("a.xml", "1", "") and r.variant == "DetailedInvoice" and r.total == 100.5 and r.line_count == 2
    assert (r.action_status, r.action_datetime, r.ingested_at) == ("Approved", "2021-03-04T10:00:00", AT)
    assert (r.vendor_entity_name, r.vendor_city, r.vendor_entity_code_type) == ("Acme", "Town", None)
    assert (r.client_entity_name, r.client_entity_code, r.client_entity_code_type, r.client_city) == ("Buyer", "C1", "T", None)


def test_lines_and_allocations(spark):
    two = "<Allocation><CostCenter>first</CostCenter><Total>x</Total></Allocation><Allocation><CostCenter>second</CostCenter></Allocation>"
    shared = "<Allocation><CostCenter>shared</CostCenter><ProjectCode>P</ProjectCode></Allocation>"
    lines = line(1) + line(2, allocation="") + line(3, allocation=two) + line("", allocation="<Allocation/>")
    parsed = parse(spark, {"a.xml": document("SummaryInvoice", lines=lines, shared=shared)})
    rows = landing.line_items(parsed, AT)
    assert len(rows.columns) == 44
    got = {r.line_number: r for r in rows.collect()}
    assert got[1].sk == key("a.xml", "1", "1") and got[1].invoice_sk == key("a.xml", "1", "")
    assert {n: r.alloc_cost_center for n, r in got.items()} == {1: "own", 2: "shared", 3: "first", None: None}
    assert got[2].alloc_project_code == "P" and got[1].alloc_project_code is None and got[3].alloc_total is None
    assert got[None].sk == key("a.xml", "1", "") and (got[1].quantity, got[1].unit_price, got[1].line_total, got[1].units) == (4.0, 2.5, 10.0, "EA")
    every = landing.allocations(parsed).collect()
    assert sorted((r.allocation_number, r.alloc_cost_center or "") for r in every) == [(1, ""), (1, "first"), (1, "own"), (1, "shared"), (2, "second")]


def test_missing_id_is_null_above_and_empty_below(spark):
    parsed = parse(spark, {"a.xml": document(invoice_id=None, lines=line(1))})
    assert landing.invoices(parsed, AT).first().invoice_id is None
    assert landing.line_items(parsed, AT).first().invoice_id == "" and landing.line_items(parsed, AT).first().invoice_sk == key("a.xml", "", "")


def test_first_of_repeated_elements_counts_and_text_is_trimmed(spark):
    twice = "<Notes>  one </Notes><Notes>two</Notes><SubmissionMethod>   </SubmissionMethod>"
    r = landing.invoices(parse(spark, {"a.xml": document(head=header(extra=twice))}), AT).first()
    assert r.notes == "one" and r.submission_method is None


def test_skips_are_quarantined_with_a_reason(spark):
    texts = {
        "good.xml": document(), "broken.xml": document()[:-30], "other.xml": "<Other/>", "none.xml": "<StandardBillingDocument><Third/></StandardBillingDocument>",
        "headless.xml": document(head=""), "null.xml": None, "empty.xml": "",
    }
    parsed = parse(spark, texts)
    assert {r.source_file: r.skip_reason for r in landing.quarantine(parsed).collect()} == {
        "broken.xml": "malformed", "other.xml": "other root", "none.xml": "unknown variant", "headless.xml": "no header", "null.xml": "malformed", "empty.xml": "malformed",
    }
    assert [r.source_file for r in landing.invoices(parsed, AT).collect()] == ["good.xml"]
    strict = Profile(namespace=NS)
    foreign = parse(spark, {"a.xml": document(ns="urn:else"), "b.xml": document()}, strict)
    assert {r.source_file: r.skip_reason for r in foreign.collect()} == {"a.xml": "foreign namespace", "b.xml": None}
    assert {r.variant: r.documents for r in landing.variant_counts(parsed).collect()} == {"DetailedInvoice": 2}


ROOT = "StandardBillingDocument"
HEAD = "<DocumentHeader><Total>1</Total></DocumentHeader>"
PROBES = {
    "default": (f'<{ROOT} xmlns="{NS}"><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>', "DetailedInvoice", None),
    "single": (f"<{ROOT} xmlns='{NS}'><SummaryInvoice>{HEAD}</SummaryInvoice></{ROOT}>", "SummaryInvoice", None),
    "spaces": (f'<{ROOT}\n xmlns = "{NS}" ><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>', "DetailedInvoice", None),
    "prefix": (f'<n:{ROOT} xmlns="urn:else" xmlns:n="{NS}"><n:DetailedInvoice><n:DocumentHeader/></n:DetailedInvoice></n:{ROOT}>', "DetailedInvoice", None),
    "foreign": (f'<{ROOT} xmlns="urn:else"><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>', "DetailedInvoice", "foreign namespace"),
    "none": (f"<{ROOT}><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>", "DetailedInvoice", "foreign namespace"),
    "decoy": (f"""<{ROOT} xmlns="urn:else" note='x xmlns="{NS}" > '><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>""", "DetailedInvoice", "foreign namespace"),
    "comment": (f'<{ROOT} xmlns="{NS}"><!-- <SummaryInvoice> --><?p <SummaryInvoice>?><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>', "DetailedInvoice", None),
    "later": (f'<{ROOT} xmlns="{NS}"><Other><DetailedInvoice/></Other><SummaryInvoice>{HEAD}</SummaryInvoice></{ROOT}>', "SummaryInvoice", None),
    "both": (f'<{ROOT} xmlns="{NS}"><Other/><SummaryInvoice>{HEAD}</SummaryInvoice><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>', "SummaryInvoice", None),
    "deep": (f'<{ROOT} xmlns="{NS}"><Other><DetailedInvoice/></Other></{ROOT}>', None, "unknown variant"),
    "empty": (f'<{ROOT} xmlns="{NS}"/>', None, "unknown variant"),
    "cdata": (f'<{ROOT} xmlns="{NS}"><Other><![CDATA[<SummaryInvoice>]]></Other><DetailedInvoice>{HEAD}</DetailedInvoice></{ROOT}>', "DetailedInvoice", None),
    "broken": (f'<{ROOT} xmlns="{NS}"><Other/><DetailedInvoice>{HEAD}', None, "malformed"),
}


def test_variant_and_namespace_are_those_of_the_elements(spark):
    rows = parse(spark, {k: v[0] for k, v in PROBES.items()}, Profile(namespace=NS)).collect()
    assert {r.source_file: (r.variant if r.skip_reason != "malformed" else None, r.skip_reason) for r in rows} == {k: v[1:] for k, v in PROBES.items()}
    loose = {r.source_file: r.skip_reason for r in parse(spark, {k: v[0] for k, v in PROBES.items()}).collect()}
    assert loose == {k: None if v[2] == "foreign namespace" else v[2] for k, v in PROBES.items()}


def test_flat_profile_finds_fields_directly_below_the_line(spark):
    text = {"a.xml": document(lines=line(1, "<ServiceCode>S</ServiceCode><DaysDue>30</DaysDue>") + line(2, "<ServiceItem><ServiceCode>T</ServiceCode></ServiceItem><ServiceCode>S</ServiceCode>"))}
    assert [r.service_code for r in landing.line_items(parse(spark, text), AT).orderBy("line_number").collect()] == [None, "T"]
    flat = landing.line_items(parse(spark, text, FLAT), AT, FLAT).orderBy("line_number").collect()
    assert [(r.service_code, r.early_pay_days_due) for r in flat] == [("S", 30), ("T", None)]


@pytest.mark.parametrize("text,double,long", [("12.7", 12.7, None), ("1_000", None, None), ("1.0d", None, None), (" 12 ", 12.0, 12), ("inf", float("inf"), None), ("", None, None), (None, None, None), ("-3", -3.0, -3), ("1e2", 100.0, None), ("abc", None, None), ("99999999999999999999", 1e20, None)])
def test_tolerant_numbers(spark, text, double, long):
    from pyspark.sql import functions as F

    from sedimenta.functions.scalars import to_double, to_long

    r = spark.createDataFrame([(text,)], "t string").select(to_double(F.col("t")).alias("d"), to_long(F.col("t")).alias("l")).first()
    assert (r.d, r.l) == (double, long)


def test_files_are_read_by_pattern(spark, tmp_path):
    (tmp_path / "a.xml").write_text(document(), encoding="utf-8")
    (tmp_path / "b.txt").write_text(document(), encoding="utf-8")
    assert [r.source_file for r in xml_documents.read_texts(spark, str(tmp_path)).collect()] == ["a.xml"]
