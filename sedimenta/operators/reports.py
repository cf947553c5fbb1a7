"""Business reports and health checks over the mart. Sums of the header total are at line grain unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MONEY = "decimal(38,6)"


def money(column: str):
    """Sum of a money column, exact in any order of rows; NULL if no row has one."""
    return F.sum(F.col(column).cast(_MONEY)).cast("double")


def _invoices():
    return F.count_distinct("invoice_id").alias("invoices")


def _spend(rows: DataFrame, key: str, *more) -> DataFrame:
    return rows.groupBy(key).agg(_invoices(), *more, money("invoice_total").alias("total_spend"))


def summary(mart: DataFrame) -> DataFrame:
    return mart.agg(
        F.count_distinct("invoice_id").alias("total_invoices"), F.count(F.lit(1)).alias("total_line_items"), money("invoice_total").alias("total_spend"),
        (money("invoice_total") / F.nullif(F.count("invoice_total"), F.lit(0))).alias("avg_invoice_value"),
        F.min("document_date").alias("earliest_date"), F.max("document_date").alias("latest_date"),
    )


def invoice_grain_summary(mart: DataFrame) -> DataFrame:
    """Extension: totals that count each document once."""
    once = mart.groupBy("invoice_sk").agg(F.max("invoice_total").alias("invoice_total"))
    return once.agg(F.count(F.lit(1)).alias("documents"), money("invoice_total").alias("invoice_spend"))


def by_year(mart: DataFrame) -> DataFrame:
    return _spend(mart.where("document_year is not null"), "document_year").orderBy("document_year")


def top_vendors(mart: DataFrame, n: int = 5) -> DataFrame:
    return _spend(mart.where("vendor_entity_name is not null"), "vendor_entity_name").orderBy(F.desc_nulls_last("total_spend"), "vendor_entity_name").limit(n)


def status_share(mart: DataFrame) -> DataFrame:
    """Spend by status with its share of all spend, that of rows without a status included."""
    whole = mart.agg(money("invoice_total").alias("whole"))
    rows = _spend(mart.where("action_status is not null"), "action_status").crossJoin(F.broadcast(whole))
    share = (F.col("total_spend") / F.nullif(F.col("whole"), F.lit(0.0)) * 100).alias("share_pct")
    return rows.select("action_status", "invoices", "total_spend", share).orderBy(F.desc_nulls_last("total_spend"), "action_status")


def by_variant(mart: DataFrame) -> DataFrame:
    return _spend(mart, "variant", F.count(F.lit(1)).alias("line_items")).orderBy(F.desc_nulls_last("total_spend"), "variant")


def by_document_type(mart: DataFrame) -> DataFrame:
    return _spend(mart.where("document_type is not null"), "document_type").orderBy(F.desc_nulls_last("total_spend"), "document_type")


def status_year_pivot(mart: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Spend by status, a column a year; giving the years saves the job that finds them."""
    rows = mart.where("action_status is not null and document_year is not null").groupBy("action_status")
    return (rows.pivot("document_year", years) if years else rows.pivot("document_year")).agg(money("invoice_total")).orderBy("action_status")


def pipeline_info(mart: DataFrame) -> DataFrame:
    return mart.agg(F.replace(F.left(F.max("ingested_at"), F.lit(19)), F.lit("T"), F.lit(" ")).alias("last_run"), F.count_distinct("source_file").alias("source_files"))


def dashboard_purchase_category(mart: DataFrame) -> DataFrame:
    return mart.groupBy("purchase_category").agg(
        F.count(F.lit(1)).alias("line_items"), _invoices(), F.count_distinct("vendor_entity_name").alias("vendors"),
        money("invoice_total").alias("total_spend"), money("line_total").alias("line_spend"),
    ).orderBy("purchase_category")


def health_counts(mart: DataFrame) -> DataFrame:
    return mart.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("invoice_id").alias("unique_invoices"),
        F.count_if(F.col("variant") == "DetailedInvoice").alias("detailed"), F.count_if(F.col("variant") == "SummaryInvoice").alias("summary"),
    )


def status_distribution(mart: DataFrame, n: int = 5) -> DataFrame:
    return mart.where("action_status is not null").groupBy("action_status").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "action_status").limit(n)


def sample(mart: DataFrame, n: int = 5) -> DataFrame:
    """The n rows ingested last, ties by document and line."""
    order = [F.desc_nulls_last("ingested_at"), "invoice_id", "line_number", "line_sk"]
    return mart.orderBy(*order).limit(n).select("invoice_id", "document_number", "document_date", "vendor_entity_name", "invoice_total", "action_status")


def currency(value: float | None) -> str:
    return "N/A" if value is None else f"${value:,.2f}"


def percent(value: float | None) -> str:
    return "N/A" if value is None else f"{value:.1f}%"


def render(mart: DataFrame, top: int = 5) -> str:
    """The business report as text; every table in it is of report size."""
    head = summary(mart).first()
    if not head["total_invoices"]:
        return "No data found."
    out = [
        f"Total invoices    : {head['total_invoices']:,}", f"Total line items  : {head['total_line_items']:,}",
        f"Total spend       : {currency(head['total_spend'])}", f"Avg invoice value : {currency(head['avg_invoice_value'])}",
        f"Date range        : {head['earliest_date']} to {head['latest_date']}",
    ]
    sections = {
        "Spend by year": by_year(mart), f"Top {top} vendors": top_vendors(mart, top), "By status": status_share(mart), "By variant": by_variant(mart),
        "By document type": by_document_type(mart), "Status by year": status_year_pivot(mart), "Pipeline": pipeline_info(mart),
    }
    for title, table in sections.items():
        out += ["", title, "  " + " | ".join(table.columns)]
        for row in table.collect():
            shown = (percent(v) if c == "share_pct" else currency(v) if isinstance(v, float) else "N/A" if v is None else str(v) for c, v in row.asDict().items())
            out.append("  " + " | ".join(shown))
    return "\n".join(out)
