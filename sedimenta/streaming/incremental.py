"""Extension: new documents land as they arrive, by a file stream whose micro-batches go through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.config import DEFAULT, Profile
from sedimenta.operators import landing
from sedimenta.sources import xml_documents


def land_stream(spark: SparkSession, source: str, root: str, checkpoint: str, ingested_at: str, profile: Profile = DEFAULT, files_per_batch: int = 1000) -> StreamingQuery:
    """Appends landing rows of files not seen before and stops when there are none left.

    Each micro-batch writes to a folder of its own number, so a batch that is run again replaces its own rows.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", files_per_batch)
    texts = files.schema("value string").load(source).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("xml"))

    def land(batch: DataFrame, number: int) -> None:
        parsed = xml_documents.parse(batch, profile).persist()
        landing.invoices(parsed, ingested_at, profile).write.mode("overwrite").parquet(f"{root}/invoices/batch={number}")
        landing.line_items(parsed, ingested_at, profile).write.mode("overwrite").parquet(f"{root}/line_items/batch={number}")
        parsed.unpersist()

    return texts.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
