"""Command line: python -m sedimenta COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from sedimenta.config import AUTO, DEFAULT, FLAT, REVIEW, Profile
from sedimenta.operators import drift, mapping, registry, reports, warehouse
from sedimenta.plans.lakehouse import LAYERS, Lakehouse


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sedimenta")
    p.add_argument("--root", default="output", help="folder of the tables")
    p.add_argument("--src", default="data", help="folder of the XML documents")
    p.add_argument("--run-date", default=None, help="date of the run, today if not given")
    p.add_argument("--namespace", default=os.environ.get("SEDIMENTA_NAMESPACE"), help="namespace that a document's root must have; any if not given")
    p.add_argument("--database", default=None, help="database of the catalog that gets the tables")
    p.add_argument("--provider", default=os.environ.get("SEDIMENTA_PROVIDER", "edit_distance"), help="edit_distance, table or chat")
    p.add_argument("--auto", type=float, default=float(os.environ.get("SEDIMENTA_AUTO", AUTO)), help="confidence from which a mapping is approved")
    p.add_argument("--review", type=float, default=float(os.environ.get("SEDIMENTA_REVIEW", REVIEW)), help="confidence from which a mapping is used and reviewed")
    p.add_argument("--flat", action="store_true", help="also look for fields directly below the line")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="the whole run or some layers")
    run.add_argument("--layers", nargs="+", choices=LAYERS, default=list(LAYERS))
    run.add_argument("--dry-run", action="store_true")
    sub.add_parser("parse", help="documents to landing tables")
    diff = sub.add_parser("diff", help="drift against the dictionary")
    diff.add_argument("--out", default=None, help="folder for diff.json and diff.md")
    m = sub.add_parser("map", help="map the new fields")
    m.add_argument("--diff", default=None, help="a diff.json to map from, instead of a new one")
    m.add_argument("--dry-run", action="store_true")
    rep = sub.add_parser("report", help="business report")
    rep.add_argument("--top", type=int, default=5)
    ver = sub.add_parser("verify", help="health check, or resolve a field")
    ver.add_argument("--rows", type=int, default=5)
    ver.add_argument("--resolve", default=None)
    ovr = sub.add_parser("override", help="a person's mapping of a field")
    ovr.add_argument("field")
    ovr.add_argument("mapped_to")
    ovr.add_argument("--by", required=True)
    load = sub.add_parser("load", help="write landing tables for another warehouse")
    load.add_argument("--out", required=True)
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("sedimenta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(timezone.utc)
    base = FLAT if a.flat else DEFAULT
    profile = Profile(base.header, base.party, base.line, base.allocation, a.namespace)
    house = Lakehouse(spark, a.src, a.root, a.run_date or now.date().isoformat(), now.isoformat(timespec="seconds"), profile, mapping.mapper_named(a.provider, dict(os.environ)), getattr(a, "dry_run", False), a.database, a.auto, a.review)
    if a.command == "run":
        out = house.run(tuple(a.layers))
        if "diff" in out:
            print(drift.to_markdown(out["diff"]))
        bad = [c for c in out.get("checks", []) if c["status"] == "fail"]
        print(*[f"{c['model']}.{c['column']} {c['test']}: {c['failures']}" for c in bad], sep="\n")
        return int(bool(bad))
    if a.command == "parse":
        house.land()
    elif a.command == "diff":
        found = house.diff()
        if a.out:
            folder = Path(a.out) / house.run_date
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "diff.json").write_text(drift.to_json(found), encoding="utf-8")
            (folder / "diff.md").write_text(drift.to_markdown(found), encoding="utf-8")
        print(drift.to_markdown(found))
    elif a.command == "map":
        decisions = house.map_fields(drift.read_json(spark, a.diff) if a.diff else house.diff())
        print("no new fields" if decisions is None else mapping.tier_summary(decisions).first())
    elif a.command == "report":
        house.require("mart_invoices")
        print(reports.render(house.table("mart_invoices"), a.top))
    elif a.command == "verify":
        store = house.store()
        if a.resolve:
            store.write(registry.resolve(store.read(), a.resolve, house.ingested_at))
            return 0
        house.require("mart_invoices")
        mart = house.table("mart_invoices")
        print(reports.health_counts(mart).first(), *reports.status_distribution(mart).collect(), *reports.sample(mart, a.rows).collect(), sep="\n")
        print(*[f"{r['source_field']} -> {r['mapped_to']} ({r['confidence']:.2f}) {r['status']}: {(r['llm_reasoning'] or '')[:300]}" for r in registry.open_rows(store.read()).collect()], sep="\n")
    elif a.command == "override":
        store = house.store()
        store.write(registry.override(store.read(), a.field, a.mapped_to, a.by, house.ingested_at))
    elif a.command == "load":
        for name in ("invoices", "line_items"):
            warehouse.warehouse_frame(house.table(name)).write.mode("overwrite").parquet(f"{a.out}/{name.upper()}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
