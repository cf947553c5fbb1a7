"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.pretokens import TOKENIZERS, VOCABULARY, HashTable, encoding, pretokens, worker_tokenizer
from sedimenta.llm.shared import text_columns
from sedimenta.llm.words import hash_spans, slices

#: About so many texts, chosen by hash, have their pre-tokens counted to choose the frequent ones, and so many are
#: chosen. What is chosen decides how often the first tier answers, never what the answer is.
SAMPLE_ROWS = 1_000
FREQUENT = 1 << 16
TIER_BYTES = 64
_TIER_BITS = 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, start, end, _ = pretokens(part.column("text"))
            h, c = hash_spans(data, start, end), hash_spans(data, start, end, 1)
            _, first, count = np.unique(h, return_index=True, return_counts=True)
            short = end[first] - start[first] <= TIER_BYTES
            first, count = first[short], count[short]
            tokens = [data[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(h[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(count)], ["token", "h", "c", "n"])


def frequent_lengths(docs: DataFrame, folder: str, vocabulary: str, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact first tier: two hashes and the token count of the most frequent pre-tokens of a sample.

    The sample's pre-tokens are counted where its texts are; only the FREQUENT ones of up to TIER_BYTES bytes come to
    the driver.
    """
    every = max(1, docs.count() // rows)
    chosen = text_columns(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    found = chosen.select("text").mapInArrow(_counted, "token binary, h long, c long, n long").groupBy("token", "h", "c").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    enc = encoding(folder, vocabulary)
    size = [len(enc.encode_ordinary(t.decode("utf-8", "replace"))) for t in top.column("token").to_pylist()]
    return top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().view(np.uint64), np.array(size, np.int32)


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs, in one pass without a shuffle of texts or pre-tokens.

    Pre-tokens are looked up in a broadcast table of fixed size, misses in the worker's own cache, and what that
    lacks is encoded and cached. A NULL text has NULL tokens, an empty one 0; repeated rows are counted one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, folder, vocabulary, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, c1, size1 = sent.value
        tier = HashTable(_TIER_BITS)
        tier.add(h1, c1, size1)
        rest = worker_tokenizer(folder, vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                data, start, end, offsets = pretokens(part.column("text"))
                h, c = hash_spans(data, start, end), hash_spans(data, start, end, 1)
                size = tier.find(h, c).astype(np.int64)
                miss = np.flatnonzero(size < 0)
                if len(miss):
                    size[miss] = rest.size[rest.entries(data, start[miss], end[miss], h[miss], c[miss])]
                total = np.concatenate([[0], np.cumsum(size)])[offsets]
                counted = pa.array(np.diff(total), pa.int64(), mask=part.column("text").is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), counted], ["doc_id", "n_tokens"])

    return text_columns(docs, "doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")
