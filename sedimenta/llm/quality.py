"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, text_columns
from sedimenta.llm.words import mix, row_of, slices, tokens_of

#: Labelled documents that training reads at most, chosen by a hash of doc_id: the one bounded sample here.
TRAIN_ROWS = 12_000
BITS = 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
THRESHOLD = 0.5

_SAME = np.uint64(0x5BD1E9955BD1E995)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of the texts of a column, as (row, index, value) in order of row and index; value is log2(1 + count)."""
    row, index, count = counted(column, bits)
    return row, index, np.log2(1.0 + count)


def counted(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the texts of a column and how often they occur, as (row, index, count) in order of row and index.

    Features are hashed words and punctuation runs and their bigrams. A bigram of one token with itself is hashed as
    "repeats the token before it", whatever the token.
    """
    h, offsets = tokens_of(column)
    rows = row_of(offsets)
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(1)))
    two[h[:-1] == h[1:]] = _SAME
    within = rows[:-1] == rows[1:]
    key = np.concatenate([mix(h), two[within]]) >> np.uint64(64 - bits)
    key |= np.concatenate([rows, rows[:-1][within]]).astype(np.uint64) << np.uint64(bits)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64(2**bits - 1)).astype(np.int64), count


class Ftrl:
    """FTRL-proximal for logistic loss, per coordinate; coordinate 2**bits is the bias and has no L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
        self.l1 = np.full(2**bits + 1, l1)
        self.l1[-1] = 0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        at, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(rows: pa.Table) -> pa.Table:
    model = Ftrl()
    rows = rows.select(["ord", "doc_id", "text", "good"]).sort_by([(c, "ascending") for c in ("ord", "doc_id", "text")])
    data = []
    for part in (p for batch in rows.to_batches() for p in slices(batch, "text")):
        row, index, count = counted(part.column("text"))
        ends = np.searchsorted(row, np.arange(part.num_rows + 1))
        # The vectors of the whole sample are held, so in half the bytes.
        index, count = index.astype(np.int32), count.astype(np.int32)
        data += [(index[a:b], count[a:b], float(y)) for a, b, y in zip(ends, ends[1:], part.column("good").to_pylist())]
    del rows
    for _ in range(EPOCHS):
        for index, count, label in data:
            model.learn(index, np.log2(1.0 + count), label)
    del data
    return pa.table({"weights": pa.array([zlib.compress(model.weights().astype("<f4").tobytes(), 1)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights fitted on labelled documents; good is quality 1 and not toxic.

    At most `rows` labelled documents of docs are used, the ones of lowest hash of doc_id. Rows with a NULL doc_id,
    quality or text teach nothing; NULL toxic counts as not toxic; a doc_id labelled more than once is good only
    if every label of it is. Without labelled documents all weights are 0. Training is one task of bounded input.
    """
    lab = (
        text_columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")).alias("good"))
        .select("doc_id", "good", F.xxhash64("doc_id").alias("ord"))
    )
    # Labels of documents that aren't there take no room in the sample.
    there = text_columns(docs, "doc_id", "text").where("text is not null").select("doc_id")
    lab = cut(lab.join(there, "doc_id", "left_semi"), "labelled")
    # Of a large table the ordering needs to see only the lowest hashes, about twice as many as it takes.
    share = 2 * rows / max(1, lab.count())
    lab = (lab.where(F.col("ord") < int(-(2**63) + share * 2**64)) if share < 1 else lab).orderBy("ord", "doc_id").limit(rows)
    # `lab` has at most `rows` rows, so it is broadcast whatever the size of the tables; one text is taken for a doc_id.
    fit = (
        text_columns(docs, "doc_id", "text").where("text is not null").join(F.broadcast(lab), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"), F.first("ord").alias("ord"))
        .groupBy(F.lit(1).alias("all_rows")).applyInArrow(_train, "weights binary").collect()
    )
    return np.frombuffer(zlib.decompress(bytes(fit[0]["weights"])), "<f4") if fit else np.zeros(2**BITS + 1, "<f4")


def scorer(docs: DataFrame, weights: np.ndarray):
    """Vectorised UDF text -> probability of good; NULL for a text that is NULL or has no token."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        for column in texts:
            parts = []
            for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                row, index, value = features(part.column("text"))
                dot = np.bincount(row, w[index] * value, part.num_rows) + float(w[-1])
                seen = np.bincount(row, minlength=part.num_rows) > 0
                parts.append(pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))), pa.float64(), mask=~seen))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for every row of docs.

    keep is false only below the threshold: a text that is NULL, empty or without tokens has a NULL score and is
    kept. Repeated rows are scored alike, one row each; an empty table gives an empty result.
    """
    score = scorer(docs, train(docs, labels))
    return (
        text_columns(docs, "doc_id", "text").select("doc_id", score("text").alias("score"))
        .select("doc_id", "score", F.coalesce(F.col("score") >= THRESHOLD, F.lit(True)).alias("keep"))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps; see classify for NULL and empty texts."""
    score = scorer(docs, train(docs, labels))
    return docs.where(F.coalesce(score(docs["text"]) >= THRESHOLD, F.lit(True)))
