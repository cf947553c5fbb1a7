"""Mapping registry: an auditable table kept in versions, each a folder of its own; the newest complete one counts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "id int, run_date date, source_field string, source_path string, source_type string, mapped_to string, confidence double, decision_type string, "
    "llm_provider string, llm_reasoning string, status string, overridden_by string, created_at timestamp, updated_at timestamp"
)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def upsert(registry: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The registry with the decisions in place of its rows of equal source_field and run_date; new rows get new ids.

    Of decisions with equal keys the one of the highest confidence counts.
    """
    last = Window.partitionBy("source_field", "run_date").orderBy(F.desc_nulls_last("confidence"), "mapped_to", "source_path")
    fresh = decisions.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    kept = registry.join(fresh.select("source_field", "run_date"), ["source_field", "run_date"], "left_anti")
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # Decisions are one a field and run, so a single window numbers them.
    added = fresh.crossJoin(F.broadcast(top)).withColumn("id", (F.col("top") + F.row_number().over(Window.orderBy("run_date", "source_field"))).cast("int"))
    stamp = F.lit(now).cast("timestamp")
    added = added.withColumn("overridden_by", F.lit(None).cast("string")).withColumn("created_at", stamp).withColumn("updated_at", stamp)
    return kept.select(*_COLUMNS).unionByName(added.select(*_COLUMNS))


def resolve(registry: DataFrame, source_field: str, now: str) -> DataFrame:
    """All open rows of a field marked as resolved."""
    hit = (F.col("source_field") == source_field) & (F.col("status") != "resolved")
    return registry.withColumn("updated_at", F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))


def override(registry: DataFrame, source_field: str, mapped_to: str, by: str, now: str) -> DataFrame:
    """A person's mapping put in place of the one of a field's open rows."""
    hit = (F.col("source_field") == source_field) & (F.col("status") != "resolved")
    new = {"mapped_to": F.lit(mapped_to), "overridden_by": F.lit(by), "updated_at": F.lit(now).cast("timestamp"), "status": F.lit("overridden")}
    return registry.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in registry.columns])


def open_rows(registry: DataFrame) -> DataFrame:
    return registry.where("status <> 'resolved'").orderBy(F.desc_nulls_last("confidence"), "source_field", "run_date")


def of_run(spark: SparkSession, registry: DataFrame, run_date: str) -> DataFrame:
    """The rows of a run by confidence, through a parameter of the statement."""
    return spark.sql("SELECT * FROM {registry} WHERE run_date = to_date(:run_date) ORDER BY confidence, source_field", {"run_date": run_date}, registry=registry)


class Store:
    """Registry versions below a folder. A write goes to the next version, so nothing that is read is overwritten.

    Of two writers that started from one version the first to finish makes the next one and the other one fails, so
    no decision is lost. The newest KEEP versions stay.
    """

    KEEP = 20
    #: Seconds after which the claim of a writer that died between claiming and renaming no longer counts.
    STALE = 600

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read_from: int | None = None

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        files = self._files()
        if not files.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path())]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and files.exists(self._path(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """The newest version; empty before the first write."""
        found = self._versions()
        self.read_from = found[-1] if found else 0
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v={found[-1]}")

    def write(self, registry: DataFrame) -> None:
        """The next version after the one that was read last."""
        files, found = self._files(), self._versions()
        version = (self.read_from if self.read_from is not None else (found[-1] if found else 0)) + 1
        fresh = f"_writing-{uuid.uuid4().hex}"
        registry.coalesce(1).write.parquet(f"{self.path}/{fresh}")
        claim = self._path(f"_claim-{version}")
        if version not in found and files.exists(claim) and time.time() - files.getFileStatus(claim).getModificationTime() / 1000 > self.STALE:
            files.delete(claim, False)
        if version in self._versions() or not files.createNewFile(claim):
            files.delete(self._path(fresh), True)
            raise RuntimeError(f"version {version} of the registry was written by another run; read it and decide again")
        files.rename(self._path(fresh), self._path(f"v={version}"))
        self.read_from = version
        for old in self._versions()[: -self.KEEP]:
            files.delete(self._path(f"v={old}"), True)
            files.delete(self._path(f"_claim-{old}"), False)
