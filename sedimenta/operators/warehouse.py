"""Staging, union, latest-version dedup and the mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import ALLOCATION, LINE, PARTY, PARTY_ROLES, VARIANTS
from sedimenta.functions.scalars import month_of, year_of

_HEADER = "invoice_id document_number document_date document_type submission_method currency_code".split()
_ACTION = ["action_type", "action_status", "action_datetime"]
_PARTIES = [f"{role.lower()}_{f.name}" for role in PARTY_ROLES for f in PARTY]
_ALLOC = [f.name for f in ALLOCATION]
#: Line columns that only detailed documents fill in.
_DETAILED = [
    f.name for f in LINE
    if f.name.startswith(("service_", "product_", "tax_", "early_pay_", "cross_ref_")) or f.name in ("units", "line_subtotal", "line_pretax_total")
]
#: Columns that are text in the warehouse, whatever they are on landing.
_AS_TEXT = {"units", "tax_total", "early_pay_days_due"}
_RENAMED = {"notes": "line_notes", "period_date": "line_period_date", "discount_total": "line_discount_total", "discount_rate": "line_discount_rate"}


#: Versions of one line: their key, what is latest, what decides between equals.
_VERSIONS = (["invoice_id", "line_number"], ["action_datetime", "ingested_at"], ["source_file", "line_sk"])


def _staged(line_items: DataFrame, invoices: DataFrame, variant: str) -> DataFrame:
    li, inv = line_items.where(F.col("variant") == variant).alias("li"), invoices.where(F.col("variant") == variant).alias("inv")
    detailed = variant == "DetailedInvoice"
    head = [
        F.col("li.sk").alias("line_sk"), F.col("li.invoice_sk"), F.col("inv.sk").alias("invoice_sk_header"),
        *[F.col(f"inv.{c}") for c in ("ingested_at", "source_file", "variant", *_HEADER)], F.col("inv.total").alias("invoice_total"),
        F.col("inv.vendor_total"), F.col("inv.line_count"), F.col("inv.notes").alias("invoice_notes"),
        *([] if detailed else [F.col("inv.period_date").alias("header_period_date")]), F.col("inv.discount_total").alias("invoice_discount_total"),
        *[F.col(f"inv.{c}") for c in (*_ACTION, *_PARTIES)], F.col("li.line_number"),
    ]
    body = []
    for f in LINE:
        if f.name == "period_start_date" and not detailed:
            continue
        kind = "string" if f.name in _AS_TEXT else {"double": "double", "long": "bigint"}.get(f.type, "string")
        value = F.col(f"li.{f.name}") if detailed or f.name not in _DETAILED else F.lit(None)
        body.append(value.cast(kind).alias(_RENAMED.get(f.name, f.name)))
    return li.join(inv, F.col("li.invoice_sk") == F.col("inv.sk"), "inner").select(*head, *body, *[F.col(f"li.{c}") for c in _ALLOC])


def stage_detailed(line_items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines of detailed documents with their header, 74 columns."""
    return _staged(line_items, invoices, "DetailedInvoice")


def stage_summary(line_items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines of summary documents with their header, 74 columns; what only detailed lines have is NULL."""
    return _staged(line_items, invoices, "SummaryInvoice")


def stage_all(line_items: DataFrame, invoices: DataFrame) -> DataFrame:
    """The union of both staging models, 75 columns, from one join: each landing table is read and shuffled once."""
    li, inv = line_items.alias("li"), invoices.where(F.col("variant").isin(*VARIANTS)).alias("inv")
    detailed = F.col("inv.variant") == VARIANTS[0]
    body = []
    for f in LINE:
        kind = "string" if f.name in _AS_TEXT else {"double": "double", "long": "bigint"}.get(f.type, "string")
        value = F.col(f"li.{f.name}").cast(kind)
        only = f.name in _DETAILED or f.name == "period_start_date"
        body.append((F.when(detailed, value) if only else value).alias(_RENAMED.get(f.name, f.name)))
    joined = li.join(inv, (F.col("li.invoice_sk") == F.col("inv.sk")) & (F.col("li.variant") == F.col("inv.variant")), "inner")
    return joined.select(
        F.col("li.sk").alias("line_sk"), F.col("li.invoice_sk"), F.col("inv.sk").alias("invoice_sk_header"),
        *[F.col(f"inv.{c}") for c in ("ingested_at", "source_file", "variant", *_HEADER)], F.col("inv.total").alias("invoice_total"),
        F.col("inv.vendor_total"), F.col("inv.line_count"), F.col("inv.notes").alias("invoice_notes"), F.col("inv.discount_total").alias("invoice_discount_total"),
        *[F.col(f"inv.{c}") for c in (*_ACTION, *_PARTIES)], F.col("li.line_number"), *body, *[F.col(f"li.{c}") for c in _ALLOC],
        F.when(~detailed, F.col("inv.period_date")).alias("header_period_date"),
    )


def of_variant(staged: DataFrame, variant: str) -> DataFrame:
    """A staging model out of stage_all's table: the rows of a variant, without the column that only the other has."""
    return staged.where(F.col("variant") == variant).drop("header_period_date" if variant == VARIANTS[0] else "period_start_date")


def union_variants(detailed: DataFrame, summary: DataFrame) -> DataFrame:
    """All lines by column name, 75 columns; a column that one side lacks is NULL there."""
    return detailed.unionByName(summary, allowMissingColumns=True)


def dedup_latest(rows: DataFrame, keys: list[str], latest: list[str], tiebreak: list[str]) -> DataFrame:
    """One row for each key, NULL keys being equal: the latest by the given columns, NULLs last, then by the tiebreak."""
    return rows.withColumn("__rank", _rank(keys, latest, tiebreak)).where("__rank = 1").drop("__rank")


def _rank(keys: list[str], latest: list[str], tiebreak: list[str]) -> Column:
    order = [F.col(c).desc_nulls_last() for c in latest] + [F.col(c).asc_nulls_last() for c in tiebreak]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def dedup_invoices(rows: DataFrame) -> DataFrame:
    """The latest version of each line: by the time of the action, then of ingestion; ties go to the least file and line key."""
    return dedup_latest(rows, *_VERSIONS)


def mark_latest(rows: DataFrame, name: str) -> DataFrame:
    """All rows, with a column that says whether dedup_invoices keeps them."""
    return rows.withColumn(name, _rank(*_VERSIONS) == 1)


def effective_unit_price():
    by_quantity = F.when(F.col("quantity") > 0, F.col("line_total") / F.nullif(F.col("quantity"), F.lit(0.0)))
    return F.when(F.col("unit_price") > 0, F.col("unit_price")).otherwise(by_quantity)


def mart(rows: DataFrame) -> DataFrame:
    """Deduplicated lines with derived columns, 81 columns."""
    lines = [_RENAMED.get(f.name, f.name) for f in LINE if f.name not in ("notes", "period_date")]
    derived = {
        "effective_unit_price": effective_unit_price(),
        "effective_line_total": F.coalesce("line_total", "invoice_total"),
        "has_tax": F.col("tax_total").isNotNull() & (F.col("tax_total").try_cast("double") > 0),
        "has_early_payment": F.col("early_pay_due_date").isNotNull(),
        "has_cost_center": F.col("alloc_cost_center").isNotNull(),
        "has_project_code": F.col("alloc_project_code").isNotNull(),
        "has_cross_reference": F.col("cross_ref_doc_number").isNotNull(),
        "is_approved": F.col("action_status") == "Approved",
        "document_year": year_of(F.col("document_date")),
        "document_month": month_of(F.col("document_date")),
    }
    return rows.select(
        "line_sk", "invoice_sk", "ingested_at", "source_file", "variant", *_HEADER, "invoice_total", "vendor_total", "line_count", "invoice_discount_total",
        *_ACTION, *_PARTIES, "line_number", F.coalesce("line_period_date", "header_period_date").alias("period_date"), *lines, *_ALLOC,
        *[c.alias(n) for n, c in derived.items()],
    )


def build_mart(line_items: DataFrame, invoices: DataFrame) -> DataFrame:
    return mart(dedup_invoices(stage_all(line_items, invoices)))


def warehouse_frame(rows: DataFrame) -> DataFrame:
    """For loading elsewhere: column names in upper case, nested and other object columns as text."""
    plain = ("string", "double", "float", "bigint", "int", "smallint", "boolean", "date", "timestamp")
    return rows.select(*[(F.col(c) if kind in plain or kind.startswith("decimal") else F.to_json(c) if kind.startswith(("struct", "array", "map")) else F.col(c).cast("string")).alias(c.upper()) for c, kind in rows.dtypes])
