"""Landing tables: parsed documents flattened to one row a document and one row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import DEFAULT, PARTY_ROLES, VARIANTS, Profile
from sedimenta.functions.scalars import surrogate_key, to_long
from sedimenta.sources.xml_documents import at_path, document_schema, flat


def _types(profile: Profile):
    body = document_schema(profile)[VARIANTS[0]].dataType.elementType
    header = body["DocumentHeader"].dataType.elementType
    lines = body["DocumentLines"].dataType.elementType
    line = lines["LineEntry"].dataType.elementType
    party, allocation = (of[n].dataType.elementType if n in of.names else None for of, n in ((header, "Party"), (line, "Allocation")))
    return header, party, line, allocation


def _body() -> Column:
    """The variant's element; both variants have one type."""
    return F.when(F.col("variant") == VARIANTS[0], F.get(F.col(f"doc.{VARIANTS[0]}"), F.lit(0))).otherwise(F.get(F.col(f"doc.{VARIANTS[1]}"), F.lit(0)))


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where("skip_reason is null")


def quarantine(parsed: DataFrame) -> DataFrame:
    """(source_file, skip_reason) of the documents that give no rows."""
    return parsed.where("skip_reason is not null").select("source_file", "skip_reason")


def variant_counts(parsed: DataFrame) -> DataFrame:
    """(variant, documents) over well-formed documents of a known variant."""
    known = parsed.where("skip_reason is null or skip_reason in ('foreign namespace', 'no header')")
    return known.groupBy("variant").agg(F.count(F.lit(1)).alias("documents"))


def first_party(header: Column, role: str) -> Column:
    """The first party of a role; a party of another or no role is passed over."""
    return F.get(F.filter(header.getField("Party"), lambda p: p.getField("_PartyRole") == role), F.lit(0))


def invoices(parsed: DataFrame, ingested_at: str, profile: Profile = DEFAULT) -> DataFrame:
    """One row a document, 35 columns under the default profile. ingested_at is the run's, the same in all rows."""
    header_type, party_type, _, _ = _types(profile)
    rows = usable(parsed).select("source_file", "variant", F.col("doc._invoice_id").alias("invoice_id"), F.get(_body().getField("DocumentHeader"), F.lit(0)).alias("h"))
    parties = [c for role in PARTY_ROLES for c in flat(first_party(F.col("h"), role), profile.party, party_type, role.lower() + "_")]
    return rows.select(
        surrogate_key(F.col("source_file"), F.col("invoice_id")).alias("sk"), F.lit(ingested_at).alias("ingested_at"), "source_file", "variant", "invoice_id",
        *flat(F.col("h"), profile.header, header_type), *parties,
    )


def _lines(parsed: DataFrame, profile: Profile) -> DataFrame:
    lines = usable(parsed).select("source_file", "variant", F.coalesce(F.col("doc._invoice_id"), F.lit("")).alias("invoice_id"), F.get(_body().getField("DocumentLines"), F.lit(0)).alias("d"))
    shared = F.get(F.col("d.Allocation"), F.lit(0)) if profile.allocation else F.lit(None)
    return lines.select("source_file", "variant", "invoice_id", shared.alias("shared"), F.explode("d.LineEntry").alias("l"))


def line_items(parsed: DataFrame, ingested_at: str, profile: Profile = DEFAULT) -> DataFrame:
    """One row a line, 44 columns under the default profile; a document without lines gives none.

    A line without an allocation of its own takes that of all lines as a whole. Of several the first counts. A
    missing invoice_id is empty here and NULL in invoices.
    """
    _, _, line_type, allocation_type = _types(profile)
    number = at_path(F.col("l"), "LineNumber", line_type)
    own = F.get(F.col("l.Allocation"), F.lit(0)) if profile.allocation else F.lit(None)
    rows = _lines(parsed, profile).withColumn("a", F.coalesce(own, F.col("shared"))).withColumn("n", number)
    return rows.select(
        surrogate_key(F.col("source_file"), F.col("invoice_id"), F.col("n")).alias("sk"), surrogate_key(F.col("source_file"), F.col("invoice_id")).alias("invoice_sk"),
        F.lit(ingested_at).alias("ingested_at"), "source_file", "variant", "invoice_id", to_long(F.col("n")).alias("line_number"),
        *flat(F.col("l"), profile.line, line_type), *flat(F.col("a"), profile.allocation, allocation_type),
    )


def allocations(parsed: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Extension: every allocation of every line, not only the first: (line_sk, allocation_number, alloc_*)."""
    _, _, line_type, allocation_type = _types(profile)
    rows = _lines(parsed, profile).withColumn("n", at_path(F.col("l"), "LineNumber", line_type))
    rows = rows.withColumn("sk", surrogate_key(F.col("source_file"), F.col("invoice_id"), F.col("n")))
    every = rows.select("sk", F.posexplode(F.coalesce("l.Allocation", F.array("shared"))).alias("i", "a")).where("a is not null")
    return every.select(F.col("sk").alias("line_sk"), (F.col("i") + 1).alias("allocation_number"), *flat(F.col("a"), profile.allocation, allocation_type))
