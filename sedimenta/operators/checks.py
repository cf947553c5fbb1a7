"""Data-quality checks: not_null, unique and accepted_values with severities, one pass over each model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import CHARGE_CLASSES, CURRENCIES, STATUSES, VARIANTS, YEARS


@dataclass(frozen=True)
class Check:
    column: str
    kind: str
    values: tuple = ()
    severity: str = "error"


RESULT = "model string, column string, test string, severity string, failures long, status string"


#: Bits of a mask that are used.
_BITS = 60


def _marked(check: Check) -> Column:
    """Whether a row fails, and for unique whether it counts."""
    c = F.col(check.column)
    if check.kind == "unique":
        return c.isNotNull()
    return c.isNull() if check.kind == "not_null" else c.isNotNull() & ~c.isin(*check.values)


def run_models(rows: DataFrame, models: dict[str, tuple[Column, list[Check]]]) -> DataFrame:
    """(model, column, test, severity, failures, status) of several models that are parts of one table, given by conditions.

    NULL passes accepted_values and unique; a unique check counts the values that occur more than once. What a row fails is
    packed into bits, and masks are counted. Masks and the column that has to be unique go through one exchange, which
    both countings read, so rows are made once; once more for each further column that has to be unique.
    """
    listed = [(model, check, where & _marked(check)) for model, (where, checks) in models.items() for check in checks]
    masks = [
        reduce(Column.bitwiseOR, [F.when(marked, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, _, marked) in enumerate(listed[at : at + _BITS])]).alias(f"m{at // _BITS}")
        for at in range(0, len(listed), _BITS)
    ]

    def has(i: int) -> Column:
        return F.col(f"m{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0

    def shown(counted: DataFrame, which: list[int]) -> DataFrame:
        labels = [
            F.struct(F.lit(listed[i][0]).alias("model"), *[F.lit(v).alias(n) for n, v in (("column", listed[i][1].column), ("test", listed[i][1].kind), ("severity", listed[i][1].severity))], F.col(f"c{i}").alias("failures"))
            for i in which
        ]
        return counted.select(F.inline(F.array(*labels)))

    unique: dict[str, list[int]] = {}
    for i, (_, check, _) in enumerate(listed):
        if check.kind == "unique":
            unique.setdefault(check.column, []).append(i)
    by_key = {key: rows.select(F.col(key).alias("key"), *masks).repartition("key") for key in unique}
    plain = [i for i, (_, check, _) in enumerate(listed) if check.kind != "unique"]
    parts = []
    if plain:
        few = next(iter(by_key.values()), rows.select(*masks)).groupBy(*[f"m{k}" for k in range(len(masks))]).agg(F.count(F.lit(1)).alias("n"))
        parts.append(shown(few.agg(*[F.coalesce(F.sum(F.when(has(i), F.col("n"))), F.lit(0)).cast("long").alias(f"c{i}") for i in plain]), plain))
    for key, which in unique.items():
        many = by_key[key].groupBy("key").agg(*[F.count_if(has(i)).alias(f"n{i}") for i in which])
        parts.append(shown(many.agg(*[F.count_if(F.col(f"n{i}") > 1).alias(f"c{i}") for i in which]), which))
    out = reduce(DataFrame.unionByName, parts)
    status = F.when(F.col("failures") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    return out.select("model", "column", "test", "severity", "failures", status.alias("status"))


def run_checks(model: str, rows: DataFrame, checks: list[Check]) -> DataFrame:
    """The checks of one model, as run_models gives them."""
    return run_models(rows, {model: (F.lit(True), checks)})


def _not_null(text: str) -> list[Check]:
    return [Check(c, "not_null") for c in text.split()]


_STATUS = Check("action_status", "accepted_values", STATUSES, "warn")

_KEY = [*_not_null("line_sk invoice_id variant document_date line_number"), Check("line_sk", "unique")]
_STAGED = [*_KEY, *_not_null("invoice_sk invoice_total vendor_entity_name client_entity_name"), _STATUS]

#: The checks of each model of the warehouse, 51 in all.
MODELS: dict[str, list[Check]] = {
    "stg_detailed": [*_STAGED, *_not_null("quantity unit_price"), Check("variant", "accepted_values", VARIANTS[:1])],
    "stg_summary": [*_STAGED, Check("variant", "accepted_values", VARIANTS[1:])],
    "int_deduped": [*_KEY, *_not_null("invoice_total"), _STATUS, Check("variant", "accepted_values", VARIANTS)],
    "mart": [
        *_KEY, *_not_null("document_year invoice_total effective_line_total vendor_entity_name client_entity_name"), _STATUS,
        Check("variant", "accepted_values", VARIANTS), Check("document_year", "accepted_values", YEARS, "warn"),
        Check("charge_class", "accepted_values", CHARGE_CLASSES, "warn"), Check("currency_code", "accepted_values", CURRENCIES, "warn"),
    ],
}


def failed(results: DataFrame) -> bool:
    """Whether a check of severity error failed."""
    return results.where("status = 'fail'").limit(1).count() > 0
