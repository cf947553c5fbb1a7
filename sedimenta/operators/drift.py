"""Schema drift: the observed structure of documents profiled and held against the declared dictionary."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.config import BASELINE, ROOT, STRUCTURAL, VARIANTS, Declared
from sedimenta.functions.scalars import clean, infer_type
from sedimenta.sources.xml_documents import is_document

EXAMPLES = 3
#: Types in order of precedence where two are equally frequent.
TYPES = ("string", "date", "datetime", "decimal", "integer", "unknown")

OBSERVATION = "source_file string, variant string, field string, parent string, value string, pos int"


def walk(xml: str) -> list[tuple[str, str, str, int]]:
    """(field, parent, text, position) of the elements that hold text, in document order.

    Structural elements are walked through and not recorded; all others are recorded if they have text of their own
    and walked through as well. Names are without their namespace. Malformed text gives nothing.
    """
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    stack = [(root, "")]
    while stack:
        element, parent = stack.pop()
        name = element.tag.rpartition("}")[2]
        text = (element.text or "").strip()
        if name not in STRUCTURAL and text:
            out.append((name, parent, text, len(out)))
        stack += [(child, name) for child in reversed(element) if isinstance(child.tag, str)]
    return out


def observations(parsed: DataFrame) -> DataFrame:
    """(source_file, variant, field, parent, value, pos) of documents of a known variant, as parse() gives them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_file", "variant", "field", "parent", "value", "pos"]
        for batch in batches:
            files, variants, texts = (batch.column(c).to_pylist() for c in ("source_file", "variant", "xml"))
            rows = [(f, v, *r) for f, v, x in zip(files, variants, texts) for r in walk(x)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    known = parsed.where("skip_reason is null or skip_reason in ('foreign namespace', 'no header')")
    return known.select("source_file", "variant", "xml").mapInArrow(emit, OBSERVATION)


def _structure(xml: str | None) -> tuple[str | None, str | None]:
    """(variant, structure) of a document's text: a line "field parent n" for each pair that holds text, in order; None without a variant."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None, None
    names = (child.tag.rpartition("}")[2] for child in root if isinstance(child.tag, str))
    variant = next((n for n in names if n in VARIANTS), None) if root.tag.rpartition("}")[2] == ROOT else None
    if variant is None:
        return None, None
    seen: dict[tuple[str, str], int] = {}
    stack = [(root, "")]
    while stack:
        element, parent = stack.pop()
        name = element.tag.rpartition("}")[2]
        if name not in STRUCTURAL and (element.text or "").strip():
            seen[name, parent] = seen.get((name, parent), 0) + 1
        if len(element):
            stack += [(child, name) for child in element if isinstance(child.tag, str)]
    return variant, "\n".join(f"{name} {parent} {n}" for (name, parent), n in sorted(seen.items()))


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, fit = (batch.column(c).to_pylist() for c in ("xml", "fit"))
        found = [(None, None) if ok is False else _structure(x) for x, ok in zip(texts, fit)]
        columns = [batch.column("source_file"), *[pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, ["source_file", "variant", "structure"])


def element_counts(texts: DataFrame) -> DataFrame:
    """(variant, field, parent, n, documents) of (source_file, xml): how often an element with text is seen, and in how many files.

    The same as counting observations(parse(texts)), from one row a document instead of one an element. Texts are walked
    and classified in one reading; those with a document type, where parsers differ, must pass from_xml as well.
    """
    # A column and not a filter, which would be pushed to where texts are made and make them again.
    fit = F.when(F.col("xml").contains("<!DOCTYPE"), is_document(F.col("xml")))
    rows = texts.select("source_file", "xml", fit.alias("fit")).mapInArrow(_structures, "source_file string, variant string, structure string").where("structure <> ''")
    # The documents of one file are one row; files alike in structure are counted together, and there are few kinds of them.
    own = rows.groupBy("source_file", "variant", "structure").agg(F.count(F.lit(1)).alias("times"))
    files = own.groupBy("source_file", "variant").agg(F.sort_array(F.collect_list(F.struct("structure", "times"))).alias("kind"))
    kinds = files.groupBy("variant", "kind").agg(F.count(F.lit(1)).alias("files"), F.count("source_file").alias("named"))
    each = kinds.select("variant", "kind", "files", "named", F.explode("kind").alias("k"))
    each = each.select("variant", "kind", "files", "named", "k.times", F.explode(F.split("k.structure", "\n")).alias("line")).withColumn("p", F.split("line", " "))
    pairs = each.groupBy("variant", "kind", "files", "named", F.col("p")[0].alias("field"), F.col("p")[1].alias("parent")).agg(F.sum(F.col("p")[2].cast("long") * F.col("times")).alias("n"))
    return pairs.groupBy("variant", "field", "parent").agg(F.sum(F.col("n") * F.col("files")).alias("n"), F.sum("named").alias("documents"))


def _dominant(counts: list[Column]) -> Column:
    """The type of the highest count, the first in TYPES of equal ones; counts are in the order of TYPES."""
    ranked = [F.struct(n.alias("n"), F.lit(-i).alias("rank"), F.lit(t).alias("type")) for i, (n, t) in enumerate(zip(counts, TYPES))]
    return F.array_max(F.array(*ranked)).getField("type")


def dominant_type(typed: DataFrame) -> DataFrame:
    """(field, observed_type): the most frequent type of (field, type), the first in TYPES of equally frequent ones."""
    return typed.groupBy("field").agg(_dominant([F.count_if(F.col("type") == t) for t in TYPES]).alias("observed_type"))


def first_examples(seen: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """(field, example_values): the first k values in order of file and position.

    Each file's own first k are taken before the lists are made, and then the first k over all, so no list is longer.
    """
    place = Window.partitionBy("field").orderBy("source_file", "pos", "value")
    few = seen.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k)
    listed = F.sort_array(F.collect_list(F.struct("nth", "value")))
    return few.groupBy("field").agg(F.transform(listed, lambda x: x.getField("value")).alias("example_values"))


def field_profile(seen: DataFrame) -> DataFrame:
    """One row a field: all_types, parents, variants (sorted), occurrence_count, file_count, observed_type, example_values.

    seen has source_file, variant, field, parent, value, pos. Values without text don't count.
    """
    seen = seen.where(clean(F.col("value")).isNotNull() & ~F.col("field").isin(*sorted(STRUCTURAL)))
    typed = seen.withColumn("type", infer_type(F.col("value")))
    sets = typed.groupBy("field").agg(
        *[F.sort_array(F.collect_set(c)).alias(n) for c, n in (("type", "all_types"), ("parent", "parents"), ("variant", "variants"))],
        F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct("source_file").alias("file_count"),
        _dominant([F.count_if(F.col("type") == t) for t in TYPES]).alias("observed_type"),
    )
    return sets.join(first_examples(seen), "field")


def dictionary(spark: SparkSession, declared: tuple[Declared, ...] = BASELINE) -> DataFrame:
    """(field, baseline_type, baseline_variants, position) of the declared dictionary; its size is that of the configuration."""
    rows = [(d.name, d.type, sorted(d.variants), d.position) for d in declared]
    return spark.createDataFrame(rows, "field string, baseline_type string, baseline_variants array<string>, position string")


def new_fields(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed fields that the dictionary lacks, eight columns."""
    return profile.join(F.broadcast(declared), "field", "left_anti").select(
        F.col("field").alias("field_name"), "observed_type", "all_types", "parents", "variants", "example_values", "file_count", "occurrence_count"
    )


def variant_drift(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared fields seen in a variant that the dictionary doesn't give them; "both" allows all."""
    extra = F.array_except("variants", "baseline_variants")
    rows = profile.join(F.broadcast(declared), "field").where(~F.array_contains("baseline_variants", "both") & (F.size(extra) > 0))
    return rows.select(F.col("field").alias("field_name"), "baseline_variants", extra.alias("new_variants"), "example_values")


def _both_numeric(a: Column, b: Column) -> Column:
    return a.isin("integer", "decimal") & b.isin("integer", "decimal")


def type_conflicts(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared fields whose dominant type is another one; integer and decimal stand for each other."""
    seen, told = F.col("observed_type"), F.col("baseline_type")
    rows = profile.join(F.broadcast(declared), "field").where((seen != "unknown") & (seen != told) & ~_both_numeric(seen, told))
    return rows.select(F.col("field").alias("field_name"), "baseline_type", "observed_type", "all_types", "example_values")


def position_drift(profile: DataFrame, earlier: DataFrame) -> DataFrame:
    """Extension: fields found below an element that an earlier profile doesn't have them below."""
    before = earlier.select("field", F.col("parents").alias("known_parents"))
    extra = F.array_except("parents", "known_parents")
    return profile.join(before, "field").where(F.size(extra) > 0).select(F.col("field").alias("field_name"), "known_parents", extra.alias("new_parents"))


def compute_diff(parsed: DataFrame, run_date: str, declared: tuple[Declared, ...] = BASELINE, seen: DataFrame | None = None) -> dict:
    """The drift document: ten keys, as written to diff.json. Only profile-sized tables reach the driver.

    seen are the observations of the documents if they are a table already; otherwise the documents are walked twice.
    """
    spark = parsed.sparkSession
    profile, book = field_profile(observations(parsed) if seen is None else seen).persist(), dictionary(spark, declared)
    known = parsed.where("skip_reason is null or skip_reason in ('foreign namespace', 'no header')")
    counts = {r["variant"]: r["n"] for r in known.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).orderBy("variant").collect()}
    parts = {
        name: [r.asDict() for r in table.orderBy("field_name").collect()]
        for name, table in (("new_fields", new_fields(profile, book)), ("variant_drift", variant_drift(profile, book)), ("type_conflicts", type_conflicts(profile, book)))
    }
    observed = profile.count()
    profile.unpersist()
    return {
        "run_date": run_date, "files_scanned": sum(counts.values()), "variant_counts": counts, "has_drift": any(parts.values()), **parts,
        "baseline_field_count": len(declared), "observed_field_count": observed,
    }


def to_json(diff: dict) -> str:
    return json.dumps(diff, indent=2, ensure_ascii=False)


def read_json(spark: SparkSession, path: str) -> dict:
    """A drift document as to_json wrote it, from any file system that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"not one document: {path}")
    diff = json.loads(rows[0][0])
    missing = {"run_date", "has_drift", "new_fields"} - diff.keys()
    if missing:
        raise ValueError(f"no drift document, it lacks {', '.join(sorted(missing))}: {path}")
    return diff


def to_markdown(diff: dict) -> str:
    """The drift document for people."""
    variants = ", ".join(f"{k} {v}" for k, v in diff["variant_counts"].items()) or "none"
    out = [f"# Schema drift, {diff['run_date']}", "", f"{diff['files_scanned']} documents ({variants}); drift: {'yes' if diff['has_drift'] else 'no'}", ""]
    tables = {
        "New fields": ("new_fields", ("field_name", "observed_type", "parents", "variants", "occurrence_count", "example_values")),
        "Fields in new variants": ("variant_drift", ("field_name", "baseline_variants", "new_variants", "example_values")),
        "Type conflicts": ("type_conflicts", ("field_name", "baseline_type", "observed_type", "example_values")),
    }
    for title, (key, columns) in tables.items():
        out += [f"## {title}", ""]
        if not diff[key]:
            out += ["none", ""]
            continue
        out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        for row in diff[key]:
            out.append("| " + " | ".join(", ".join(v) if isinstance(v, list) else str(v) for v in (row[c] for c in columns)) + " |")
        out.append("")
    return "\n".join(out)
