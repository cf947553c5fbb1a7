"""Drift, mapping, scoring and the registry."""

import pytest
from pyspark.sql import functions as F

from sedimenta.config import BASELINE, CORPUS, STRUCTURAL
from sedimenta.functions.scalars import infer_type
from sedimenta.operators import drift, mapping, registry
from tests.documents import document, header, line
from tests.test_landing import parse

DAY = "2024-05-06"


def diff(spark, **texts):
    return drift.compute_diff(parse(spark, {f"{k}.xml": v for k, v in texts.items()}), DAY)


def test_dictionaries_have_their_sizes():
    assert (len(BASELINE), len(STRUCTURAL), len(CORPUS)) == (58, 43, 40)


def test_no_drift(spark):
    found = diff(spark, a=document(lines=line(1)), b=document("SummaryInvoice", lines=line(1).replace("<Units>EA</Units>", "")))
    assert not found["has_drift"] and found["files_scanned"] == 2 and found["run_date"] == DAY
    assert found["variant_counts"] == {"DetailedInvoice": 1, "SummaryInvoice": 1} and found["baseline_field_count"] == 58
    assert found["new_fields"] == found["variant_drift"] == found["type_conflicts"] == []


def test_new_fields_with_examples_in_file_order(spark):
    texts = {n: document(head=header(extra=f"<InvoiceAmount>{v}</InvoiceAmount><VendorTag>v{n}</VendorTag>")) for n, v in (("a", "1250.00"), ("b", "7"), ("c", "3.5"), ("d", "9.25"))}
    found = {f["field_name"]: f for f in diff(spark, **texts)["new_fields"]}
    assert set(found) == {"InvoiceAmount", "VendorTag"}
    amount = found["InvoiceAmount"]
    assert amount["observed_type"] == "decimal" and amount["all_types"] == ["decimal", "integer"] and amount["parents"] == ["DocumentHeader"]
    assert amount["example_values"] == ["1250.00", "7", "3.5"] and (amount["file_count"], amount["occurrence_count"]) == (4, 4)
    assert "| InvoiceAmount | decimal |" in drift.to_markdown(diff(spark, **texts)) and '"InvoiceAmount"' in drift.to_json(diff(spark, **texts))


def test_variant_drift_and_type_conflict(spark):
    found = diff(spark, a=document("SummaryInvoice", head=header(date="yesterday"), lines=line(1)))
    assert [(f["field_name"], f["new_variants"]) for f in found["variant_drift"]] == [("Units", ["SummaryInvoice"])]
    assert {(f["field_name"], f["baseline_type"], f["observed_type"]) for f in found["type_conflicts"]} == {("DocumentDate", "date", "string"), ("TransactionDateTime", "datetime", "string")}


def test_nothing_and_malformed(spark):
    empty = drift.compute_diff(parse(spark, {"x": None}).where("false"), DAY)
    assert empty["files_scanned"] == 0 and not empty["has_drift"]
    assert diff(spark, bad="<unclosed>", good=document())["files_scanned"] == 1


def test_walk_is_in_document_order():
    text = "<A xmlns='urn:x'><Action><Q>1</Q></Action><Q> two <R>3</R></Q><!-- c --><S>  </S></A>"
    assert drift.walk(text) == [("Q", "Action", "1", 0), ("Q", "A", "two", 1), ("R", "Q", "3", 2)]


@pytest.mark.parametrize("text,kind", [("2021-01-02", "date"), ("2021-01-02T03:04:05Z", "datetime"), ("-1.5", "decimal"), ("1234", "integer"), ("12345", "string"), ("-5", "string"), (" x ", "string"), ("  ", "unknown"), (None, "unknown"), ("1.", "string")])
def test_types(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(infer_type(F.col("t"))).first()[0] == kind


def test_position_drift_extension(spark):
    schema = "field string, parents array<string>"
    now, before = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], schema), spark.createDataFrame([("a", ["x"]), ("b", ["x"])], schema)
    assert [tuple(r) for r in drift.position_drift(now, before).collect()] == [("a", ["x"], ["y"])]


def score(spark, to, own, kind, parents):
    rows = spark.createDataFrame([(to, own, kind, parents)], "mapped_to string, llm_confidence double, observed_type string, parents array<string>")
    return mapping.with_tier(mapping.score_confidence(rows, mapping.corpus_table(spark))).first()


@pytest.mark.parametrize(
    "to,own,kind,parents,want,tier,status",
    [
        ("UNKNOWN", 0.9, "decimal", ["DocumentHeader"], 0.0, "pending_human", "pending"),
        ("elsewhere", 0.8, "decimal", ["DocumentHeader"], 0.4, "pending_human", "pending"),
        ("invoice_total", 1.0, "decimal", ["DocumentHeader"], 1.0, "auto_approved", "active"),
        ("invoice_total", 0.8, "integer", ["DocumentHeader"], 0.81, "flagged_review", "active"),
        ("invoice_total", 0.8, "string", ["LineEntry"], 0.5, "pending_human", "pending"),
        ("quantity", 0.8, "decimal", ["LineEntry", "DocumentHeader"], 0.8, "flagged_review", "active"),
        ("cost_center", 0.9, "string", ["Allocation"], 0.95, "auto_approved", "active"),
        ("cost_center", 0.9, "string", [], 0.85, "flagged_review", "active"),
    ],
)
def test_scores_and_tiers(spark, to, own, kind, parents, want, tier, status):
    r = score(spark, to, own, kind, parents)
    assert abs(r.confidence - want) < 1e-9 and (r.decision_type, r.status) == (tier, status)


def test_mappers():
    field = {"field_name": "InvoiceTotal", "observed_type": "decimal", "parents": ["DocumentHeader"], "variants": [], "example_values": ["1.0"]}
    assert mapping.NameMapper().suggest_mapping(field)["mapped_to"] == "invoice_total"
    assert mapping.NameMapper().suggest_mapping(field | {"field_name": "Zzzzqqq"})["mapped_to"] == mapping.UNKNOWN
    assert mapping.TableMapper({"InvoiceTotal": ("x", 0.5, "y")}).suggest_mapping(field) == {"mapped_to": "x", "confidence": 0.5, "reasoning": "y"}

    def fails(prompt):
        raise OSError("no network")

    assert mapping.CallMapper(fails, "remote").suggest_mapping(field) == {"mapped_to": "UNKNOWN", "confidence": 0.0, "reasoning": "provider failed: no network"}
    asked = []
    ok = mapping.CallMapper(lambda p: asked.append(p) or {"mapped_to": "units", "confidence": 3, "reasoning": "r"}, "remote")
    assert ok.suggest_mapping(field)["confidence"] == 1.0 and "InvoiceTotal" in asked[0] and "line_total" in asked[0]


def decisions(spark, *rows):
    full = [(DAY, f, "p", "string", to, c, "auto_approved", "t", "why", s) for f, to, c, s in rows]
    table = spark.createDataFrame(full, "run_date string, source_field string, source_path string, source_type string, mapped_to string, confidence double, decision_type string, llm_provider string, llm_reasoning string, status string")
    return table.withColumn("run_date", F.to_date("run_date"))


def test_registry_versions(spark, tmp_path):
    store = registry.Store(spark, str(tmp_path / "reg"))
    assert store.read().count() == 0
    store.write(registry.upsert(store.read(), decisions(spark, ("A", "x", 0.9, "active"), ("B", "y", 0.5, "pending")), "2024-05-06 01:00:00"))
    store.write(registry.upsert(store.read(), decisions(spark, ("A", "z", 0.7, "active")), "2024-05-06 02:00:00"))
    rows = {r.source_field: r for r in store.read().collect()}
    assert len(rows) == 2 and rows["A"].mapped_to == "z" and len({r.id for r in rows.values()}) == 2
    store.write(registry.resolve(store.read(), "A", "2024-05-06 03:00:00"))
    assert [r.source_field for r in registry.open_rows(store.read()).collect()] == ["B"]
    store.write(registry.override(store.read(), "B", "w", "someone", "2024-05-06 04:00:00"))
    b = store.read().where("source_field = 'B'").first()
    assert (b.mapped_to, b.overridden_by, b.status, str(b.updated_at)) == ("w", "someone", "overridden", "2024-05-06 04:00:00")
    assert registry.of_run(spark, store.read(), DAY).count() == 2 and registry.of_run(spark, store.read(), "2024-05-07").count() == 0


def test_nearest_names_are_those_of_the_mapper(spark):
    names = ["UnitPrices", "unit_price", "Zzz", "", "TaxTotl", "ProjectCodes", "a", "Alloc-Total"]
    mapper = mapping.NameMapper()
    rows = mapping.nearest_names(spark.createDataFrame([(n,) for n in [*names, "UnitPrices"]], "field_name string"), mapping.corpus_table(spark)).collect()
    assert len(rows) == len(names) + 1
    for r in rows:
        want = mapper.suggest_mapping({"field_name": r.field_name})
        assert (r.mapped_to, r.llm_confidence) == (want["mapped_to"], want["confidence"])


def test_providers_by_name(tmp_path):
    (tmp_path / "t.json").write_text('{"New": ["units", 0.9, "told"]}', encoding="utf-8")
    assert mapping.mapper_named("edit_distance", {}).name == "edit_distance"
    assert mapping.mapper_named("table", {"SEDIMENTA_TABLE": str(tmp_path / "t.json")}).suggest_mapping({"field_name": "New"}) == {"mapped_to": "units", "confidence": 0.9, "reasoning": "told"}
    chat = mapping.mapper_named("chat", {"SEDIMENTA_CHAT_URL": "http://127.0.0.1:9/none", "SEDIMENTA_CHAT_MODEL": "m"})
    assert chat.name == "chat:m" and chat.suggest_mapping({"field_name": "New"})["mapped_to"] == mapping.UNKNOWN
    with pytest.raises(ValueError):
        mapping.mapper_named("other", {})


def test_corpus_tells_what_each_column_means():
    assert len(CORPUS) == 40 and all(len(t.description.split()) > 3 for t in CORPUS)
    assert all(t.description in mapping.build_prompt({"field_name": "X"}) for t in CORPUS)


def test_diff_document_is_read_back(spark, tmp_path):
    diff = {"run_date": "2024-01-01", "has_drift": False, "new_fields": [], "files_scanned": 0}
    (tmp_path / "diff.json").write_text(drift.to_json(diff), encoding="utf-8")
    assert drift.read_json(spark, str(tmp_path / "diff.json")) == diff
    (tmp_path / "bad.json").write_text("{}", encoding="utf-8")
    with pytest.raises(ValueError, match="lacks"):
        drift.read_json(spark, str(tmp_path / "bad.json"))


def test_registry_writers_do_not_overwrite_one_another(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry.Store, "KEEP", 2)
    one, two = (registry.Store(spark, str(tmp_path / "registry")) for _ in range(2))
    empty = one.read()
    two.read()
    one.write(empty)
    with pytest.raises(RuntimeError, match="another run"):
        two.write(empty)
    two.read()
    for _ in range(3):
        two.write(two.read())
    assert two._versions() == [3, 4] and one.read().count() == 0
