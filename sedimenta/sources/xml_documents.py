"""XML documents as one row a file, parsed under an explicit schema made from the path configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.config import DEFAULT, ROOT, VARIANTS, Field, Profile
from sedimenta.functions.scalars import clean, typed

#: What may stand before the root element, and the root's start tag up to its end, its attributes' values whatever they hold.
_BEFORE = r"(?s)^\x{FEFF}?\s*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)\s*)*"
_START = r"<(?:([\w.-]+):)?([\w.-]+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
#: The name of the first element below the root.
_CHILD = _BEFORE + _START + r"(?:\s|<!--.*?-->|<\?.*?\?>)*<(?:[\w.-]+:)?([\w.-]+)"
_ATTRIBUTE = r"[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')"
#: The first child of the root that is a variant, for documents that have something else before it.
_VARIANT_PATH = "name(/*/*[" + " or ".join(f"name()='{v}' or substring-after(name(),':')='{v}'" for v in VARIANTS) + "][1])"


def _tree(paths: list[str]) -> dict:
    """Nested dict of element names; attributes are leaves named @name."""
    tree: dict = {}
    for path in paths:
        steps, _, attribute = path.partition("@")
        at = tree
        for step in steps.split("/"):
            at = at.setdefault(step, {})
        if attribute:
            at["@" + attribute] = {}
    return tree


def _type(tree: dict) -> T.DataType:
    """Every element is an array, so that the first of repeated ones can be taken; all text is string."""
    if not tree:
        return T.StringType()
    out = T.StructType()
    if all(k.startswith("@") for k in tree):
        out.add("_VALUE", T.StringType())
    for name, below in tree.items():
        out.add("_" + name[1:], T.StringType()) if name.startswith("@") else out.add(name, T.ArrayType(_type(below)))
    return out


def document_schema(profile: Profile = DEFAULT) -> T.StructType:
    """Schema of the root element under a profile; of what the profile has no columns for, only what rows and skips depend on."""
    def under(prefix: str, known: tuple[Field, ...]) -> list[str]:
        return [f"{prefix}/{p}" for f in known for p in f.paths]

    body = (
        under("DocumentHeader", profile.header) + under("DocumentHeader/Party", profile.party) + ["DocumentHeader/Party@PartyRole"] * bool(profile.party)
        + ["DocumentHeader/DocumentNumber"] * (not profile.header and not profile.party)
        + ["DocumentLines/LineEntry/LineNumber"] + under("DocumentLines/LineEntry", profile.line)
        + under("DocumentLines/Allocation", profile.allocation) + under("DocumentLines/LineEntry/Allocation", profile.allocation)
    )
    tree = _tree(body)
    bodies = [T.StructField(v, T.ArrayType(_type(tree))) for v in VARIANTS]
    # The parser takes the corrupt-record field to be the last one.
    return T.StructType([T.StructField("_invoice_id", T.StringType()), *bodies, T.StructField("_corrupt_record", T.StringType())])


def at_path(element: Column, path: str, schema: T.StructType) -> Column:
    """Text at a path below an element: the first match at each step, NULL where a step is missing."""
    steps, _, attribute = path.partition("@")
    here, kind = element, schema
    for step in [s for s in steps.split("/") if s]:
        kind = kind[step].dataType.elementType
        here = F.get(here.getField(step), F.lit(0))
    if attribute:
        return here.getField("_" + attribute)
    return clean(here.getField("_VALUE") if isinstance(kind, T.StructType) else here)


def flat(element: Column, known: tuple[Field, ...], schema: T.StructType, prefix: str = "") -> list[Column]:
    """The configured columns of an element; alternative paths are tried in order."""
    return [typed(F.coalesce(*[at_path(element, p, schema) for p in f.paths]), f.type).alias(prefix + f.name) for f in known]


def read_texts(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(source_file, xml), one row for each matching file; many small files share a task."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("xml"))


def _variant(xml: Column, doc: Column) -> Column:
    """The first child of the root that is a variant element; NULL if there is none. Malformed texts aren't looked at."""
    child = F.regexp_extract(xml, _CHILD, 4)
    some = xml.rlike("|".join(VARIANTS)) & doc.isNotNull() & doc.getField("_corrupt_record").isNull()
    further = F.when(some, F.regexp_replace(F.xpath_string(xml, F.lit(_VARIANT_PATH)), "^.*:", ""))
    return F.nullif(F.when(child.isin(*VARIANTS), child).otherwise(further), F.lit(""))


def _namespace(xml: Column) -> Column:
    """The namespace of the root element, under its own prefix if it has one; empty without one."""
    prefix = F.regexp_extract(xml, _BEFORE + _START, 1)
    declared = F.when(prefix == "", "xmlns").otherwise(F.concat(F.lit("xmlns:"), prefix))
    attributes = F.regexp_extract_all(F.regexp_extract(xml, _BEFORE + _START, 3), F.lit(_ATTRIBUTE), 0)
    own = F.filter(attributes, lambda a: F.regexp_extract(a, r"^([\w.:-]+)", 1) == declared)
    return F.coalesce(F.regexp_extract(F.get(own, F.lit(0)), r"""(?s)=\s*["'](.*)["']$""", 1), F.lit(""))


def _document(xml: Column, profile: Profile) -> Column:
    return F.from_xml(
        xml, document_schema(profile),
        {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )


def is_document(xml: Column) -> Column:
    """Whether a text is well-formed for parse() and has the root element of documents."""
    doc = _document(xml, DEFAULT.only())
    return F.coalesce(doc.isNotNull() & doc.getField("_corrupt_record").isNull() & (F.regexp_extract(xml, _BEFORE + _START, 2) == ROOT), F.lit(False))


def parse(texts: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """(source_file, xml, variant, doc, skip_reason) of documents given as text.

    variant is the first child of the root that is a variant element. skip_reason says why a document gives no rows: it
    is malformed, its root is another element, it has no variant, its root's namespace is not the profile's (if the
    profile names one), or it has no header. A NULL text is malformed.
    """
    doc = _document(F.col("xml"), profile)
    # Generated from arrays of one, the parsed document and its variant are made once and not again for each use.
    once = texts.select("source_file", "xml", F.explode(F.array(doc)).alias("doc"))
    once = once.select("source_file", "xml", "doc", F.explode(F.array(_variant(F.col("xml"), F.col("doc")))).alias("variant"))
    root = F.regexp_extract("xml", _BEFORE + _START, 2)
    header = F.when(F.col("variant") == VARIANTS[0], F.get(F.get(F.col(f"doc.{VARIANTS[0]}"), F.lit(0)).getField("DocumentHeader"), F.lit(0)).isNotNull()).otherwise(
        F.get(F.get(F.col(f"doc.{VARIANTS[1]}"), F.lit(0)).getField("DocumentHeader"), F.lit(0)).isNotNull()
    )
    foreign = F.lit(False) if profile.namespace is None else _namespace(F.col("xml")) != profile.namespace
    reason = (
        F.when(F.col("xml").isNull() | F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), "malformed")
        .when(root != ROOT, "other root")
        .when(F.col("variant").isNull(), "unknown variant")
        .when(foreign, "foreign namespace")
        .when(~header, "no header")
    )
    return once.select("source_file", "xml", "variant", "doc", reason.alias("skip_reason"))
