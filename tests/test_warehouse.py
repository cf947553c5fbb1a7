"""Staging to mart, reports, checks, the whole run, the stream and the command line."""

import pytest

from sedimenta import __main__ as cli
from sedimenta.operators import checks, landing, mapping, reports, warehouse
from sedimenta.plans.lakehouse import Lakehouse
from sedimenta.streaming.incremental import land_stream
from tests.documents import document, header, line
from tests.test_landing import AT, parse


@pytest.fixture(scope="module")
def texts():
    tax = "<TaxEntry><TaxType>V</TaxType><Total>1.5</Total></TaxEntry>"
    return {
        "a.xml": document("DetailedInvoice", "1", header("N1", date="2021-03-04", total="100.00", vendor="Acme"), line(1, tax) + line(2)),
        "b.xml": document("SummaryInvoice", "2", header("N2", date="2022-05-06", total="40.00", status="Pending", vendor="Bolt"), line(1, tax).replace("<UnitPrice>2.5</UnitPrice>", "")),
        "c.xml": document("DetailedInvoice", "1", header("N1", date="2021-03-09", total="110.00", vendor="Acme"), line(1)),
        "d.xml": document("DetailedInvoice", "3", header("N3", date="soon", total="x", status="Odd", vendor="Bolt"), line(1)),
    }


@pytest.fixture(scope="module")
def models(spark, texts):
    parsed = parse(spark, texts).persist()
    invoices, lines = landing.invoices(parsed, AT), landing.line_items(parsed, AT)
    out = {"stg_detailed": warehouse.stage_detailed(lines, invoices), "stg_summary": warehouse.stage_summary(lines, invoices)}
    out["union"] = warehouse.union_variants(out["stg_detailed"], out["stg_summary"])
    out["all"] = warehouse.stage_all(lines, invoices)
    out["int_deduped"] = warehouse.dedup_invoices(out["union"])
    out["mart"] = warehouse.mart(out["int_deduped"]).persist()
    return out


def test_widths(models):
    assert {k: len(v.columns) for k, v in models.items()} == {"stg_detailed": 74, "stg_summary": 74, "union": 75, "all": 75, "int_deduped": 75, "mart": 81}


def test_one_join_gives_the_union(models):
    assert sorted(models["all"].columns) == sorted(models["union"].columns)
    order = models["union"].columns
    assert sorted(map(str, models["all"].select(*order).collect())) == sorted(map(str, models["union"].collect()))


def test_latest_version_of_a_line_wins(models):
    rows = {(r.invoice_id, r.line_number): r for r in models["mart"].collect()}
    assert set(rows) == {("1", 1), ("1", 2), ("2", 1), ("3", 1)}
    assert rows["1", 1].source_file == "c.xml" and rows["1", 2].source_file == "a.xml"


def test_enrichment(models):
    rows = {(r.invoice_id, r.line_number): r for r in models["mart"].collect()}
    one, two, odd = rows["1", 1], rows["2", 1], rows["3", 1]
    assert one.effective_unit_price == 2.5 and two.effective_unit_price == 2.5 and one.effective_line_total == 10.0
    assert two.tax_total is None and two.has_tax is False and two.units is None and two.period_date == "2021-03-31" and one.period_date is None
    assert (one.is_approved, two.is_approved, one.document_year, one.document_month) == (True, False, 2021, 3)
    assert odd.document_year is None and odd.invoice_total is None and one.has_cost_center and not one.has_project_code


def test_has_tax_is_null_for_text(spark, models):
    from pyspark.sql import functions as F

    rows = models["int_deduped"].withColumn("tax_total", F.when(F.col("invoice_id") == "1", "abc"))
    assert {r.has_tax for r in warehouse.mart(rows).collect()} == {None, False}


def test_reports(models):
    mart = models["mart"]
    s = reports.summary(mart).first()
    assert (s.total_invoices, s.total_line_items, s.total_spend, s.latest_date) == (3, 4, 250.0, "soon")
    assert reports.invoice_grain_summary(mart).first().invoice_spend == 250.0
    assert [tuple(r) for r in reports.by_year(mart).collect()] == [(2021, 1, 210.0), (2022, 1, 40.0)]
    assert [r.vendor_entity_name for r in reports.top_vendors(mart, 1).collect()] == ["Acme"]
    assert {r.action_status: r.share_pct for r in reports.status_share(mart).collect()} == {"Approved": 84.0, "Pending": 16.0, "Odd": None}
    assert reports.by_variant(mart).first().asDict() == {"variant": "DetailedInvoice", "invoices": 2, "line_items": 3, "total_spend": 210.0}
    assert reports.status_year_pivot(mart).columns == ["action_status", "2021", "2022"]
    assert tuple(reports.health_counts(mart).first()) == (4, 3, 3, 1)
    assert tuple(reports.pipeline_info(mart).first()) == (AT[:19].replace("T", " "), 4)
    text = reports.render(mart)
    assert "Total spend       : $250.00" in text and "84.0%" in text
    assert reports.render(mart.where("false")) == "No data found."


def test_checks(models):
    assert sum(len(c) for c in checks.MODELS.values()) == 51
    out = {(r.column, r.test): (r.failures, r.status) for r in checks.run_checks("mart", models["mart"], checks.MODELS["mart"]).collect()}
    assert len(out) == 16 and out["line_sk", "unique"] == (0, "pass") and out["document_year", "not_null"] == (1, "fail")
    assert out["action_status", "accepted_values"] == (1, "warn") and out["charge_class", "accepted_values"] == (0, "pass")
    assert checks.failed(checks.run_checks("mart", models["mart"], checks.MODELS["mart"]))


def test_warehouse_frame(spark):
    rows = spark.createDataFrame([(1, ["a"], {"k": 2})], "id int, tags array<string>, m map<string,int>")
    assert warehouse.warehouse_frame(rows).first().asDict() == {"ID": 1, "TAGS": '["a"]', "M": '{"k":2}'}


def write(folder, texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_whole_run(spark, tmp_path, texts):
    extra = {"e.xml": document("DetailedInvoice", "9", header("N9", extra="<InvoiceTotal>5.0</InvoiceTotal>"), line(1)), "f.xml": "<bad"}
    house = Lakehouse(spark, write(tmp_path / "src", texts | extra), str(tmp_path / "out"), "2024-05-06", AT, mapper=mapping.NameMapper())
    with pytest.raises(FileNotFoundError):
        house.require("mart_invoices")
    out = house.run()
    assert out["diff"]["has_drift"] and [d["source_field"] for d in out["decisions"]] == ["InvoiceTotal"] and len(out["checks"]) == 51
    assert house.table("mart_invoices").count() == 5 and house.store().read().count() == 1 and house.table("quarantine").count() == 1
    house.run()
    assert house.store().read().count() == 1
    dry = Lakehouse(spark, str(tmp_path / "src"), str(tmp_path / "dry"), "2024-05-06", AT, dry_run=True)
    assert len(dry.run()["decisions"]) == 1 and dry.store().read().count() == 0


def test_catalog_tables_and_views(spark, tmp_path, texts):
    house = Lakehouse(spark, write(tmp_path / "src", texts), str(tmp_path / "out"), "2024-05-06", AT, database="layers_of_test")
    try:
        assert len(house.run()["checks"]) == 51
        assert spark.table("layers_of_test.mart_invoices").count() == house.table("mart_invoices").count() == spark.read.parquet(str(tmp_path / "out" / "mart_invoices")).count()
        assert set(house.register()) == {"parsed", "invoices", "line_items", "quarantine", "observations", "staged", "int_deduped", "mart_invoices"}
        assert spark.sql("SELECT count(DISTINCT invoice_id) AS n FROM int_deduped JOIN invoices USING (invoice_id)").first().n == 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS layers_of_test CASCADE")
    with pytest.raises(FileNotFoundError, match="there are: .*mart_invoices"):
        house.require("nothing")


def test_staging_models_are_parts_of_one_table(spark, texts):
    parsed = parse(spark, texts)
    lines, invoices = landing.line_items(parsed, AT), landing.invoices(parsed, AT)
    staged = warehouse.stage_all(lines, invoices)
    for variant, model in (("DetailedInvoice", warehouse.stage_detailed), ("SummaryInvoice", warehouse.stage_summary)):
        want, got = model(lines, invoices), warehouse.of_variant(staged, variant)
        assert set(want.columns) == set(got.columns) and len(got.columns) == 74
        assert sorted(map(str, want.collect())) == sorted(map(str, got.select(want.columns).collect()))


def test_no_drift_skips_mapping_only(spark, tmp_path):
    house = Lakehouse(spark, write(tmp_path / "src", {"a.xml": document(lines=line(1))}), str(tmp_path / "out"), "2024-05-06", AT)
    out = house.run()
    assert not out["diff"]["has_drift"] and out["decisions"] == [] and house.table("mart_invoices").count() == 1


def test_stream_lands_new_files_once(spark, tmp_path, texts):
    source, root, mark = write(tmp_path / "src", {"a.xml": texts["a.xml"]}), str(tmp_path / "out"), str(tmp_path / "mark")
    land_stream(spark, source, root, mark, AT).awaitTermination()
    (tmp_path / "src" / "b.xml").write_text(texts["b.xml"], encoding="utf-8")
    land_stream(spark, source, root, mark, AT).awaitTermination()
    assert sorted(r.source_file for r in spark.read.parquet(root + "/invoices").collect()) == ["a.xml", "b.xml"]


def test_command_line(spark, tmp_path, texts, capsys):
    source, root = write(tmp_path / "src", texts), str(tmp_path / "out")
    base = ["--src", source, "--root", root, "--run-date", "2024-05-06"]
    assert cli.main([*base, "run"]) == 1  # a document's date gives no year, which a check refuses
    assert cli.main([*base, "diff", "--out", str(tmp_path / "diff")]) == 0 and (tmp_path / "diff" / "2024-05-06" / "diff.json").exists()
    capsys.readouterr()
    assert cli.main([*base, "map", "--dry-run", "--diff", str(tmp_path / "diff" / "2024-05-06" / "diff.json")]) == 0 and "no new fields" in capsys.readouterr().out
    (tmp_path / "diff.json").write_text('{"run_date": "2024-05-06", "has_drift": true, "new_fields": [{"field_name": "UnitPrices", "parents": ["LineEntry"], "observed_type": "decimal"}]}', encoding="utf-8")
    assert cli.main([*base, "--auto", "0.5", "map", "--diff", str(tmp_path / "diff.json")]) == 0 and "auto_approved=1" in capsys.readouterr().out
    assert cli.main([*base, "report", "--top", "2"]) == 0 and "Total invoices    : 3" in capsys.readouterr().out
    assert cli.main([*base, "verify"]) == 0 and cli.main([*base, "load", "--out", str(tmp_path / "wh")]) == 0
    assert "INVOICE_ID" in spark.read.parquet(str(tmp_path / "wh" / "INVOICES")).columns
