"""Column expressions shared by the operators; all stay inside the JVM and are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """Text without white space at its ends; NULL if nothing is left."""
    return F.nullif(F.btrim(value, F.lit(" \t\n\x0b\f\r")), F.lit(""))


def to_double(value: Column) -> Column:
    """A double, or NULL for text that is no plain number: Java's type suffixes such as 1.0d are refused."""
    text = F.lower(value.cast("string"))
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"), value.try_cast("double"))


def to_long(value: Column) -> Column:
    """A long, or NULL for text that is no integer: fractions aren't rounded."""
    return F.when(value.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("long"))


def typed(value: Column, kind: str) -> Column:
    return {"double": to_double, "long": to_long}.get(kind, lambda v: v)(value)


def surrogate_key(source_file: Column, invoice_id: Column, extra: Column | None = None) -> Column:
    """First 16 hex digits of SHA-256 over file|id|extra, NULL parts counting as empty."""
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in (source_file, invoice_id, F.lit("") if extra is None else extra)]
    return F.substring(F.sha2(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]), 256), 1, 16)


def first_of(*values: Column) -> Column:
    """The first of the alternatives that has text."""
    return F.coalesce(*[clean(v) for v in values])


def infer_type(text: Column) -> Column:
    """Label of a text's type: date, datetime, decimal, integer of up to four digits, else string; unknown if empty.

    Negative integers and longer digit runs are identifiers as likely as numbers, so they are strings.
    """
    t = clean(text)
    return (
        F.when(t.isNull(), "unknown")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), "datetime")
        .when(t.rlike(r"^-?\d+\.\d+$"), "decimal")
        .when(t.rlike(r"^\d{1,4}$"), "integer")
        .otherwise("string")
    )


def year_of(date: Column) -> Column:
    return F.left(date, F.lit(4)).try_cast("int")


def month_of(date: Column) -> Column:
    return F.substring(date, 6, 2).try_cast("int")
