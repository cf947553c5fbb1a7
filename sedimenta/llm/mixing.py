"""Mixing sources to target weights by pivotal dependent rounding of fractional copies."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, text_columns, unused

#: Without explicit weights a source's weight is its size to this power, which lifts small sources.
TEMPERATURE = 0.7
SEED = 11
#: Documents that one leaf of the reduction tree rounds, and leaves that one inner node combines.
LEAF_ROWS = 20_000
FAN_IN = 16
_CLOSE = 1e-9
UNIT = "source string, doc_id long, leaf long, p double"


def pivot(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pivotal rounding: all entries become 0 or 1 but for one at most, which keeps the rest of the mass.

    Each step pairs the open entry with the next one and moves mass between them at random, so that one of the two
    becomes integral, the sum stays and each keeps its expectation. u are uniform random numbers, one for each step.
    """
    out = p.copy()
    open_at = -1
    for j in range(len(p)):
        b = out[j]
        if b <= _CLOSE or b >= 1 - _CLOSE:
            out[j] = round(b)
            continue
        if open_at < 0:
            open_at = j
            continue
        i, a = open_at, out[open_at]
        s = a + b
        if s < 1 - _CLOSE:
            gone, stays = (i, j) if u[j] * s < b else (j, i)
            out[gone], out[stays], open_at = 0.0, s, stays
        else:
            one, rest = (i, j) if u[j] * (2 - s) < 1 - b else (j, i)
            out[one], out[rest], open_at = 1.0, s - 1, rest
            if out[rest] <= _CLOSE:
                out[rest], open_at = 0.0, -1
    return out


def expected_copies(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, x): copies that each document of a source shall have on average.

    A source's size is the sum of n_chars, NULL counting as 1; its share of the output shall be as its weight, and
    the total is the least for which x is 1 or more everywhere, so mixing repeats documents and drops none. Weights
    are given by source name, 1 where absent, or follow TEMPERATURE. A NULL source is a source like others.
    """
    size = text_columns(docs, "source", "n_chars").groupBy("source").agg(F.sum(F.greatest(F.coalesce("n_chars", F.lit(1)), F.lit(1))).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), F.lit(1.0)).cast("double")
    ratio = size.select("source", (weight / F.col("size")).alias("r"))
    least = ratio.agg(F.min("r").alias("least"))
    return ratio.crossJoin(F.broadcast(least)).select("source", (F.col("r") / F.col("least")).alias("x"))


def _round(rows: pd.DataFrame, level: int, seed: int, by_source: bool) -> pd.DataFrame:
    rows = rows.assign(none=rows["source"].isna(), order=pd.util.hash_array(rows["doc_id"].fillna(-1).to_numpy(np.int64)))
    rows = rows.sort_values(["none", "source", "order", "doc_id"], kind="stable", ignore_index=True)
    p = rows["p"].to_numpy(np.float64).copy()
    name = rows["source"].fillna("").astype(str) if by_source else pd.Series("", index=rows.index)
    edge = np.flatnonzero(np.concatenate([[True], (name[1:].to_numpy() != name[:-1].to_numpy()) | (rows["none"][1:].to_numpy() != rows["none"][:-1].to_numpy()) & by_source, [True]]))
    for a, b in zip(edge, edge[1:]):
        key = f"{seed}|{level}|{rows['leaf'].iloc[0]}|{rows['none'].iloc[a]}|{name.iloc[a]}"
        p[a:b] = pivot(p[a:b], np.random.default_rng(zlib.crc32(key.encode())).random(b - a))
    rows["p"] = p
    rows["leaf"] = rows["leaf"] // FAN_IN
    return rows.loc[p > 0, ["source", "doc_id", "leaf", "p"]]


def winners(units: DataFrame, leaves: int, seed: int = SEED) -> DataFrame:
    """(source, doc_id) whose fractional copy becomes a whole one, of units (source, doc_id, p).

    Leaves round their documents source by source and pass one open document of each source up; inner nodes combine
    FAN_IN nodes; the root pairs what is left of the sources and draws the last open one. So a source's number of
    extra copies is within 1 of its expectation and the total is its own, rounded.
    """

    def node(level: int):
        return lambda rows: _round(rows, level, seed, True)

    leaf = F.pmod(F.xxhash64("doc_id", "source"), F.lit(leaves)).alias("leaf")
    now, level, won = units.select("source", "doc_id", leaf, "p"), 0, []
    while True:
        last = leaves <= 1
        now = cut(now.groupBy("leaf").applyInPandas(node(level), UNIT), "round")
        won.append(now.where(F.col("p") >= 1).select("source", "doc_id"))
        now = now.where(F.col("p") < 1)
        leaves, level = -(-leaves // FAN_IN), level + 1
        if last:
            break

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        left = _round(rows, -1, seed, False)
        draw = np.random.default_rng(seed).random(len(left))
        return left[(left["p"] >= 1 - _CLOSE) | (draw < left["p"])].assign(p=1.0)

    won.append(now.groupBy("leaf").applyInPandas(root, UNIT).select("source", "doc_id"))
    out = won[0]
    for more in won[1:]:
        out = out.unionByName(more)
    return out


def copies(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(expected, won): expected_copies and the winners among all (source, doc_id) of docs."""
    expected = cut(expected_copies(docs, weights), "expected")
    keys = text_columns(docs, "doc_id", "source").distinct()
    part = F.col("x") - F.floor(F.col("x") + _CLOSE)
    own = expected.select("source", part.alias("p")).where(F.col("p") > _CLOSE)
    units = cut(keys.join(own.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "p"), "units")
    return expected, cut(winners(units, max(1, -(-units.count() // LEAF_ROWS)), seed), "winners")


def _with_copies(docs: DataFrame, weights: dict[str, float] | None, seed: int, name: str) -> DataFrame:
    """docs with the number of copies as a further column of that name, which no column of docs may have."""
    expected, won = copies(docs, weights, seed)
    at_source, whole, won_source, won_id, one = unused(docs.withColumn(name, F.lit(0)), "at_source", "whole", "won_source", "won_id", "one")
    expected = expected.select(F.col("source").alias(at_source), F.floor(F.col("x") + _CLOSE).cast("int").alias(whole))
    won = won.select(F.col("source").alias(won_source), F.col("doc_id").alias(won_id), F.lit(1).alias(one))
    return (
        docs.join(expected, docs["source"].eqNullSafe(F.col(at_source)), "left")
        .join(won, docs["source"].eqNullSafe(F.col(won_source)) & docs["doc_id"].eqNullSafe(F.col(won_id)), "left")
        .withColumn(name, F.col(whole) + F.coalesce(one, F.lit(0))).select(*[docs[c] for c in docs.columns], name)
    )


def mixed_copies(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copies) for every row of docs.

    Rows that repeat source and doc_id share one decision, NULLs being values like others. An empty table gives an
    empty result. The outcome depends on the rows and the seed alone, not on their order or partitions.
    """
    return _with_copies(text_columns(docs, "doc_id", "source", "n_chars"), weights, seed, "copies").select("doc_id", "source", "copies")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, each as often as mixed_copies says."""
    (name,) = unused(docs, "copies")
    many = _with_copies(docs, weights, seed, name)
    return many.withColumn(name, F.explode(F.array_repeat(F.lit(0), F.col(name)))).drop(name)
