"""What the work of a query is spread over, and that less is parsed where less is asked for."""

from pathlib import Path

import pytest

from sedimenta import queries
from sedimenta.config import DEFAULT
from sedimenta.operators import landing
from sedimenta.sources import xml_documents
from tests.documents import document, header, line

DATA = Path("/root/testdata/sf0.001")
AT = "2024-05-06T07:08:09+00:00"


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("made", [queries._full_documents, queries.xml_texts])
def test_documents_of_small_tables_are_made_and_parsed_by_the_whole_cluster(spark, made):
    rows = made(spark, str(DATA))
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_a_narrow_profile_parses_less_and_gives_the_same(spark):
    texts = {
        "a.xml": document(lines=line(1) + line(2, allocation=""), shared="<Allocation><CostCenter>all</CostCenter></Allocation>"), "b.xml": document("SummaryInvoice", head="<DocumentHeader/>", lines=line(3)),
        "c.xml": document(head=""), "d.xml": document()[:-9], "e.xml": document(head=header(extra="<Notes> \t x \n</Notes>")),
    }
    given = spark.createDataFrame(list(texts.items()), "source_file string, xml string")

    def rows(profile, make, *names):
        return sorted(map(str, make(xml_documents.parse(given, profile), AT, profile).select("sk", *names).collect()))

    skipped = lambda p: sorted(map(tuple, landing.quarantine(xml_documents.parse(given, p)).collect()))
    for profile in (DEFAULT.only(header="notes total", party="city entity_code_type"), DEFAULT.only(line="quantity", allocation="alloc_cost_center"), DEFAULT.only(line="*"), DEFAULT.only()):
        assert len(xml_documents.document_schema(profile).json()) < 0.7 * len(xml_documents.document_schema().json())
        head = [f.name for f in profile.header] + [f"{r}_{f.name}" for r in ("vendor", "client") for f in profile.party]
        below = [f.name for f in (*profile.line, *profile.allocation)]
        assert rows(profile, landing.invoices, *head) == rows(DEFAULT, landing.invoices, *head)
        assert rows(profile, landing.line_items, "line_number", *below) == rows(DEFAULT, landing.line_items, "line_number", *below)
        assert skipped(profile) == skipped(DEFAULT) == [("c.xml", "no header"), ("d.xml", "malformed")]


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["dq_staging", "dq_mart"])
def test_checks_of_all_models_read_their_tables_once(spark, name):
    rows = queries.QUERIES[name](spark, str(DATA))
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Scan parquet") == 3


def test_parts_of_one_table_are_checked_as_tables_of_their_own(spark):
    from pyspark.sql import functions as F

    from sedimenta.operators.checks import Check, run_checks, run_models

    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", None), (None, "b", "x"), (None, "b", "x"), (3, None, "y"), (3, None, "y")], "k int, part string, v string")
    of = [Check("k", "unique"), Check("k", "not_null"), Check("v", "accepted_values", ("x",), "warn"), Check("v", "unique")]
    parts = {p: F.col("part") == p for p in ("a", "b", "none")}
    got = sorted(map(tuple, run_models(rows, {p: (where, of * 9) for p, where in parts.items()}).distinct().collect()))
    assert got == sorted(t for p, where in parts.items() for t in map(tuple, run_checks(p, rows.where(where), of).collect()))
    assert [(r.column, r.test, r.failures, r.status) for r in run_checks("a", rows.where("part = 'a'"), of).collect()] == [
        ("k", "not_null", 0, "pass"), ("v", "accepted_values", 1, "warn"), ("k", "unique", 1, "fail"), ("v", "unique", 0, "pass"),
    ]


def test_structures_count_what_observations_count(spark):
    from pyspark.sql import functions as F

    from sedimenta.operators import drift
    from tests.test_landing import PROBES

    texts = [(k, v[0]) for k, v in PROBES.items()] + [("two.xml", document(lines=line(1))), ("two.xml", document(lines=line(1) + line(2))), ("two.xml", document("SummaryInvoice")), ("null.xml", None), (None, document())]
    texts += [("dtd.xml", "<!DOCTYPE x>" + document(ns="a").partition("?>")[2]), ("entity.xml", '<!DOCTYPE x [<!ENTITY e "v">]>' + document(head=header(extra="<Notes>&e;</Notes>")).partition("?>")[2])]
    given = spark.createDataFrame(texts, "source_file string, xml string")
    seen = drift.observations(xml_documents.parse(given))
    want = seen.groupBy("variant", "field", "parent").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("documents"))
    got = drift.element_counts(given)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 9
