"""The whole run: parse, diff, map if there is drift, stage, dedup, mart, checks. Each layer is a written table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from sedimenta.config import AUTO, DEFAULT, REVIEW, VARIANTS, Profile
from sedimenta.operators import checks, drift, landing, mapping, registry, warehouse
from sedimenta.sources import xml_documents

TABLES = ("parsed", "invoices", "line_items", "quarantine", "observations", "staged", "int_deduped", "mart_invoices")
LAYERS = ("landing", "diff", "mapping", "mart", "checks")


@dataclass
class Lakehouse:
    """Folders and settings of a run. run_date and ingested_at are given, never taken from a task's clock."""

    spark: SparkSession
    source: str
    root: str
    run_date: str
    ingested_at: str
    profile: Profile = DEFAULT
    mapper: mapping.Mapper = field(default_factory=mapping.NameMapper)
    dry_run: bool = False
    #: Database of the catalog whose tables the layers are, besides being folders below root.
    database: str | None = None
    auto: float = AUTO
    review: float = REVIEW

    def table(self, name: str) -> DataFrame:
        """A layer's table: that of the catalog, if it has one, or the folder."""
        if self.database is not None and self.spark.catalog.tableExists(f"{self.database}.{name}"):
            return self.spark.table(f"{self.database}.{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def require(self, *names: str) -> None:
        there = self.tables()
        missing = [n for n in names if n not in there]
        if missing:
            raise FileNotFoundError(f"no such table yet: {', '.join(missing)}; there are: {', '.join(there) or 'none'}")

    def tables(self) -> list[str]:
        """The layers that are complete."""
        return [n for n in TABLES if self.has(n)]

    def register(self) -> list[str]:
        """Makes a temporary view of each layer that is complete, for SQL; their names."""
        for name in self.tables():
            self.table(name).createOrReplaceTempView(name)
        return self.tables()

    def _write(self, rows: DataFrame, name: str, *partitions: str) -> None:
        out = rows.write.mode("overwrite").partitionBy(*partitions)
        if self.database is None:
            out.parquet(f"{self.root}/{name}")
        else:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
            out.format("parquet").option("path", f"{self.root}/{name}").saveAsTable(f"{self.database}.{name}")

    def store(self) -> registry.Store:
        return registry.Store(self.spark, f"{self.root}/mapping_registry")

    def parsed(self) -> DataFrame:
        return xml_documents.parse(xml_documents.read_texts(self.spark, self.source), self.profile)

    def land(self) -> None:
        """Parses once into a table of parsed documents, from which both landing tables are made."""
        self._write(self.parsed(), "parsed")
        parsed = self.table("parsed")
        self._write(landing.invoices(parsed, self.ingested_at, self.profile), "invoices")
        self._write(landing.line_items(parsed, self.ingested_at, self.profile), "line_items")
        self._write(landing.quarantine(parsed), "quarantine")

    def diff(self) -> dict:
        self._write(drift.observations(self.table("parsed")), "observations")
        return drift.compute_diff(self.table("parsed"), self.run_date, seen=self.table("observations"))

    def map_fields(self, diff: dict) -> DataFrame | None:
        """Decisions for new fields, put into the registry unless this is a dry run; None without drift."""
        if not diff["has_drift"] or not diff["new_fields"]:
            return None
        decisions = mapping.decide(self.spark, diff, self.mapper, self.auto, self.review)
        if not self.dry_run:
            store = self.store()
            store.write(registry.upsert(store.read(), decisions, self.ingested_at))
        return decisions

    def build(self) -> dict[str, DataFrame]:
        """The models, each written once and read again: both staging models as the parts of one table, from one join."""
        self._write(warehouse.stage_all(self.table("line_items"), self.table("invoices")), "staged", "variant")
        self._write(warehouse.dedup_invoices(self.table("staged")), "int_deduped")
        self._write(warehouse.mart(self.table("int_deduped")), "mart_invoices")
        stages = {name: warehouse.of_variant(self.table("staged"), v) for name, v in zip(("stg_detailed", "stg_summary"), VARIANTS)}
        return stages | {"int_deduped": self.table("int_deduped"), "mart": self.table("mart_invoices")}

    def run(self, layers: tuple[str, ...] = LAYERS) -> dict:
        """The chosen layers in order; mapping is skipped without drift and nothing else is."""
        out: dict = {}
        if "landing" in layers:
            self.land()
        if "diff" in layers:
            out["diff"] = self.diff()
        if "mapping" in layers:
            found = self.map_fields(out.get("diff") or self.diff())
            out["decisions"] = [r.asDict() for r in found.collect()] if found is not None else []
        if "mart" in layers or "checks" in layers:
            models = self.build()
            if "checks" in layers:
                # One query, whose branches run side by side.
                results = reduce(DataFrame.unionByName, [checks.run_checks(name, rows, checks.MODELS[name]) for name, rows in models.items()])
                out["checks"] = [r.asDict() for r in results.collect()]
        return out
