"""Mapping of new fields to known ones: pluggable suggestions, composite confidence, routing by tier."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import AUTO, CORPUS, POSITIONS, REVIEW, Target

UNKNOWN = "UNKNOWN"


class Mapper(Protocol):
    """Suggests a known field for a new one: mapped_to (or UNKNOWN), confidence from 0 to 1, reasoning."""

    name: str

    def suggest_mapping(self, new_field: dict) -> dict: ...


def build_prompt(new_field: dict, corpus: tuple[Target, ...] = CORPUS) -> str:
    """What a language model is asked about a field."""
    known = "\n".join(f"- {t.name} ({t.type}, {t.position}): {t.description}" for t in corpus)
    listed = {k: ", ".join(new_field.get(k) or []) or "none" for k in ("parents", "variants", "example_values")}
    return (
        f"A document has an element that the schema doesn't know.\nName: {new_field['field_name']}\nType: {new_field.get('observed_type', 'unknown')}\n"
        f"Below: {listed['parents']}\nVariants: {listed['variants']}\nExamples: {listed['example_values']}\n\nKnown columns:\n{known}\n\n"
        f"Name the one column that it means, minding abbreviations, type and place, or {UNKNOWN}. "
        'Answer with one JSON object: {"mapped_to": ..., "confidence": 0 to 1, "reasoning": one sentence}.'
    )


class TableMapper:
    """Answers from a table of field name -> (mapped_to, confidence, reasoning); UNKNOWN for all others."""

    def __init__(self, answers: dict[str, tuple[str, float, str]], name: str = "table"):
        self.answers, self.name = answers, name

    def suggest_mapping(self, new_field: dict) -> dict:
        to, confidence, why = self.answers.get(new_field["field_name"], (UNKNOWN, 0.0, "not in the table"))
        return {"mapped_to": to, "confidence": confidence, "reasoning": why}


class CallMapper:
    """Asks a function that answers a prompt with JSON, such as a client of a hosted or local model; any error is UNKNOWN."""

    def __init__(self, ask: Callable[[str], dict], name: str):
        self.ask, self.name = ask, name

    def suggest_mapping(self, new_field: dict) -> dict:
        try:
            answer = self.ask(build_prompt(new_field))
            return {"mapped_to": str(answer["mapped_to"]), "confidence": min(1.0, max(0.0, float(answer["confidence"]))), "reasoning": str(answer.get("reasoning", ""))}
        except Exception as error:  # a provider may fail in any way, and one field must not stop the run
            return {"mapped_to": UNKNOWN, "confidence": 0.0, "reasoning": f"provider failed: {error}"}


class NameMapper:
    """Offline: the known name of the least edit distance to the field's, if it is near enough."""

    name = "edit_distance"

    def __init__(self, corpus: tuple[Target, ...] = CORPUS, least: float = 0.5):
        self.corpus, self.least = corpus, least

    @staticmethod
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    def suggest_mapping(self, new_field: dict) -> dict:
        own = new_field["field_name"].lower()
        near = min(((self.distance(own, t.name.replace("_", "")) / max(len(own), len(t.name), 1), t.name) for t in self.corpus), default=(1.0, UNKNOWN))
        if 1 - near[0] < self.least:
            return {"mapped_to": UNKNOWN, "confidence": 0.0, "reasoning": "no known name is near"}
        return {"mapped_to": near[1], "confidence": round(1 - near[0], 4), "reasoning": "nearest known name"}


def nearest_names(fields: DataFrame, corpus: DataFrame, least: float = 0.5) -> DataFrame:
    """NameMapper for a table of fields (field_name): adds mapped_to and llm_confidence. corpus is that of corpus_table."""
    names = corpus.select("mapped_to")
    own, plain = F.lower("field_name"), F.replace(F.col("mapped_to"), F.lit("_"), F.lit(""))
    share = F.levenshtein(own, plain) / F.greatest(F.length("field_name"), F.length("mapped_to"), F.lit(1))
    # The corpus is configuration, some tens of rows.
    best = fields.select("field_name").distinct().crossJoin(F.broadcast(names)).groupBy("field_name").agg(F.min(F.struct(share.alias("share"), "mapped_to")).alias("best"))
    near = 1 - F.col("best.share") >= least
    return fields.join(best, "field_name", "left").select(
        *fields.columns, F.when(near, F.col("best.mapped_to")).otherwise(UNKNOWN).alias("mapped_to"), F.when(near, F.round(1 - F.col("best.share"), 4)).otherwise(0.0).alias("llm_confidence")
    )


class ChatMapper(CallMapper):
    """Asks a chat-completion service at a URL for JSON; key may be empty, as for a service on the own machine."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60.0):
        super().__init__(self._ask, f"chat:{model}")
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def _ask(self, prompt: str) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "stream": False}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as reply:
            told = json.load(reply)
        text = (told.get("message") or told["choices"][0]["message"])["content"]
        return json.loads(text[text.index("{") : text.rindex("}") + 1])


def mapper_named(name: str, settings: dict[str, str]) -> Mapper:
    """The provider of a name: edit_distance, table (SEDIMENTA_TABLE, a JSON file) or chat (SEDIMENTA_CHAT_URL, _MODEL, _KEY)."""
    if name == "edit_distance":
        return NameMapper()
    if name == "table":
        with open(settings["SEDIMENTA_TABLE"], encoding="utf-8") as f:
            return TableMapper({k: tuple(v) for k, v in json.load(f).items()})
    if name == "chat":
        return ChatMapper(settings["SEDIMENTA_CHAT_URL"], settings["SEDIMENTA_CHAT_MODEL"], settings.get("SEDIMENTA_CHAT_KEY", ""))
    raise ValueError(f"no such provider: {name}")


def corpus_table(spark: SparkSession, corpus: tuple[Target, ...] = CORPUS) -> DataFrame:
    return spark.createDataFrame([(t.name, t.type, t.position) for t in corpus], "mapped_to string, mapped_type string, mapped_position string")


def observed_position(parents: Column) -> Column:
    """Where a field is by its parents, the first of POSITIONS that has one of them."""
    out = F.lit("unknown")
    for name, triggers in reversed(POSITIONS):
        out = F.when(F.arrays_overlap(parents, F.array(*[F.lit(t) for t in triggers])), name).otherwise(out)
    return out


def score_confidence(suggested: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds confidence to (mapped_to, llm_confidence, observed_type, parents, ...).

    Half the suggestion's own confidence, 0.3 for the type (0.7 of that between integer and decimal) and 0.2 for the
    position (half of that if it differs), rounded to 4 places and 1 at most; 0 for UNKNOWN, and half the own
    confidence, not rounded, for what the corpus doesn't have.
    """
    numeric = ("integer", "decimal")
    type_match = F.when(F.col("mapped_type") == F.col("observed_type"), 1.0).when(F.col("mapped_type").isin(*numeric) & F.col("observed_type").isin(*numeric), 0.7).otherwise(0.0)
    place_match = F.when(F.col("mapped_position") == observed_position(F.col("parents")), 1.0).otherwise(0.5)
    full = F.round(F.least(F.col("llm_confidence") * 0.5 + type_match * 0.3 + place_match * 0.2, F.lit(1.0)), 4)
    score = F.when(F.col("mapped_to") == UNKNOWN, 0.0).when(F.col("mapped_type").isNull(), F.col("llm_confidence") * 0.5).otherwise(full)
    return suggested.join(F.broadcast(corpus), "mapped_to", "left").withColumn("confidence", score)


def with_tier(scored: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """Adds decision_type and status by confidence."""
    tier = F.when(F.col("confidence") >= auto, "auto_approved").when(F.col("confidence") >= review, "flagged_review").otherwise("pending_human")
    return scored.withColumn("decision_type", tier).withColumn("status", F.when(F.col("confidence") >= review, "active").otherwise("pending"))


def tier_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*[F.count_if(F.col("decision_type") == t).alias(t) for t in ("auto_approved", "flagged_review", "pending_human")], F.count_if(F.col("mapped_to") == UNKNOWN).alias("unknown"))


def decide(spark: SparkSession, diff: dict, mapper: Mapper, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """The decisions for a diff's new fields, one suggestion for each field: the columns a registry row needs."""
    rows = []
    for f in diff["new_fields"]:
        s = mapper.suggest_mapping(f)
        rows.append((f["field_name"], list(f["parents"]), f["observed_type"], s["mapped_to"], float(s["confidence"]), s["reasoning"]))
    table = spark.createDataFrame(rows, "source_field string, parents array<string>, observed_type string, mapped_to string, llm_confidence double, llm_reasoning string")
    scored = with_tier(score_confidence(table, corpus_table(spark)), auto, review)
    return scored.select(
        F.to_date(F.lit(diff["run_date"])).alias("run_date"), "source_field", F.array_join("parents", "/").alias("source_path"), F.col("observed_type").alias("source_type"),
        "mapped_to", "confidence", "decision_type", F.lit(mapper.name).alias("llm_provider"), "llm_reasoning", "status",
    )
