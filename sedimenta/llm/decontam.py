"""Benchmark decontamination: BM25 over the test items with block-max WAND bounds, then overlap checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, text_columns
from sedimenta.llm.words import distinct, grams_of, row_of, slices, summed, words_of

K1, B = 1.2, 0.75
#: Least score, as a share of the score that the item itself would get.
SCORE = 0.5
#: Least share of the 3-grams of the question, and of the answer, that the passage must have.
OVERLAP = 0.5
GRAM = 3
#: Items have the question first and the answer last: the last quarter of the words is taken for the answer.
ANSWER_SHARE = 0.25
#: Items of fewer words have no question and answer: all of their words must stand next to one another.
LEAST_WORDS = 5
#: Words of the passages in which items of up to half as many are searched; for items of up to twice as many words they
#: are twice as long, and so on. Passages overlap by half, so an item that stands in one piece is whole in one.
PASSAGE = 128
BLOCK_ITEMS = 8
#: Benchmark words that one pass over the documents searches; a larger benchmark takes several.
INDEX_WORDS = 4_000_000
#: Postings that are opened at once, about; a passage of more comes alone. It bounds memory and decides nothing else.
OPEN_POSTINGS = 1 << 18


class Index:
    """Inverted index of normalised BM25 impacts with block maxima.

    Impacts are divided by the item's score against itself, so that one threshold serves all items and bounds.
    """

    def __init__(self, ids: list, words: list[np.ndarray], document_frequency: dict[int, int] | None, items: int, mean: float, passage: int = PASSAGE):
        self.ids, self.words, self.passage = ids, words, passage
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.terms = np.unique(flat)
        pair, tf = np.unique(np.searchsorted(self.terms, flat) * max(1, len(words)) + owner, return_counts=True)
        term, item = np.divmod(pair, max(1, len(words)))
        df = np.bincount(term, minlength=len(self.terms))
        if document_frequency is not None:
            df = np.array([document_frequency[t] for t in self.terms.view(np.int64).tolist()])
        idf = np.log1p((items - df + 0.5) / (df + 0.5))
        size = np.array([len(w) for w in words])
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(mean, 1e-9)))
        own = np.bincount(item, impact, len(words))
        impact = impact / own[item]
        self.item, self.impact = item, impact
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(impact, self.at[:-1]) if len(impact) else np.zeros(0)
        blocks, first = np.unique(term * (len(words) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS, return_index=True)
        self.block_term, self.block = np.divmod(blocks, len(words) // BLOCK_ITEMS + 1)
        self.block_most = np.maximum.reduceat(impact, first) if len(impact) else np.zeros(0)
        self.block_at = np.searchsorted(self.block_term, np.arange(len(self.terms) + 1))
        self.blocks = len(words) // BLOCK_ITEMS + 1
        # The other terms have long lists and little impact: search() opens them only where their bounds call for it.
        self.essential = df <= max(1, items // 4)
        self.parts = []
        for w in words:
            if len(w) < LEAST_WORDS:
                self.parts.append([(len(w), grams_of(w, np.array([0, len(w)]), len(w))[0])] * 2)
                continue
            at = len(w) - max(1, int(len(w) * ANSWER_SHARE))
            # Question and answer, each as the words of its grams and the distinct grams.
            self.parts.append([(min(GRAM, len(p)), distinct(grams_of(p, np.array([0, len(p)]), GRAM)[0])) for p in (w[:at], w[at:])])

    @staticmethod
    def _expand(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the postings of each term, and which of the terms each is of."""
        size = at[term + 1] - at[term]
        before = np.cumsum(size) - size
        which = np.repeat(np.arange(len(term)), size)
        return np.arange(len(which)) - before[which] + at[term][which], which

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items that score SCORE or more for passages given, in order, as distinct terms.

        Bounds as in block-max WAND, for all passages at once: a passage is left if the sum of its lists' maxima is
        too small, a block of items if the sum of the block's maxima is; the rest is scored in full. Terms that are
        not essential open no block as long as the sum of their lists' maxima is below SCORE in the passage, so that no
        item can reach SCORE by them alone; those of the greatest maxima beyond that count as essential there. What the
        lists' maxima leave is opened for runs of passages of about OPEN_POSTINGS postings, so memory follows neither the
        texts at hand nor the benchmark, but for the list of one passage.
        """
        slack = SCORE - 1e-9
        alive = np.bincount(passage, self.most[term], n) >= slack
        keep = alive[passage]
        passage, term = passage[keep], term[keep]
        ess = self.essential[term]
        other = np.flatnonzero(~ess)
        other = other[np.lexsort((self.most[term[other]], passage[other]))]
        total = np.cumsum(self.most[term[other]])
        begin = np.searchsorted(passage[other], passage[other])
        ess[other[total - (total[begin] - self.most[term[other]][begin]) >= slack - 1e-9]] = True
        rest = np.bincount(passage[~ess], self.most[term[~ess]], n)
        keep = (np.bincount(passage[ess], self.most[term[ess]], n) + rest >= slack)[passage]
        passage, term, ess = passage[keep], term[keep], ess[keep]
        found, opened, i = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], np.cumsum(self.at[term + 1] - self.at[term]), 0
        while i < len(passage):
            # Whole passages: those that end within the postings, or else the next one.
            j = int(np.searchsorted(opened, (opened[i - 1] if i else 0) + OPEN_POSTINGS, "right"))
            j = int(np.searchsorted(passage, passage[j])) if j < len(passage) else j
            j = j if j > i else int(np.searchsorted(passage, passage[i], "right"))
            found.append(self._opened(passage[i:j], term[i:j], ess[i:j], rest))
            i = j
        return tuple(np.concatenate(x) for x in zip(*found))

    def _opened(self, passage: np.ndarray, term: np.ndarray, ess: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search() for whole passages that the lists' maxima leave; rest: for each passage, the maxima's sum of terms that open no block."""
        slack, start = SCORE - 1e-9, int(passage[0])
        passage, rest, n = passage - start, rest[start:], int(passage[-1]) - start + 1
        at, which = self._expand(self.block_at, term[ess])
        cell = passage[ess][which] * self.blocks + self.block[at]
        cells, bound = summed(cell, self.block_most[at], n * self.blocks)
        cells = cells[bound + rest[cells // self.blocks] >= slack]
        chosen = np.zeros(n, bool)
        chosen[cells // self.blocks] = True
        wanted = chosen[passage]
        at, which = self._expand(self.at, term[wanted])
        where, item = passage[wanted][which], self.item[at]
        open_block = np.isin(where * self.blocks + item // BLOCK_ITEMS, cells)
        pair, score = summed(where[open_block] * len(self.words) + item[open_block], self.impact[at[open_block]], n * len(self.words))
        good = score >= slack
        return start + pair[good] // len(self.words), pair[good] % len(self.words), score[good]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, offsets = words_of(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), lists], ["item_id", "words"])


def indexes(benchmark: DataFrame, index_words: int = INDEX_WORDS) -> Iterator[list[Index]]:
    """The indexes of a benchmark for each pass over the documents.

    There is one for the items of each length of passages, in parts where it has more than index_words words. Document
    frequencies and the mean length are those of the whole benchmark, so what is found of an item depends neither on
    the cut nor on what else is in its index.
    """
    items = text_columns(benchmark, "item_id", "text").where("text is not null").mapInArrow(_items, "item_id long, words array<long>")
    items, half = items.where(F.size("words") > 0), PASSAGE // 2
    scale = F.when(F.size("words") <= half, 0).otherwise(F.length(F.bin(F.floor((F.size("words") - 1) / half).cast("long")))).alias("scale")
    keyed = items.select("item_id", "words", scale)
    sizes = [tuple(r) for r in keyed.groupBy("scale").agg(F.count(F.lit(1)), F.sum(F.size("words"))).orderBy("scale").collect()]
    count, total = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    parts = [(scale, k, -(-words // index_words), words / -(-words // index_words)) for scale, _, words in sizes for k in range(-(-words // index_words))]
    frequency = None
    if len(parts) > 1:
        keyed = cut(keyed, "items")
        frequency = cut(keyed.select(F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    ready, size = [], 0
    for scale, k, shards, words in parts:
        if ready and size + words > index_words:
            yield ready
            ready, size = [], 0
        own = keyed.where((F.col("scale") == scale) & (F.pmod(F.xxhash64("words"), F.lit(shards)) == k))
        rows = own.orderBy(F.col("item_id").asc_nulls_last(), "words").collect()
        df = None
        if frequency is not None:
            df = {r["t"]: r["df"] for r in frequency.join(own.select(F.explode("words").alias("t")).distinct(), "t", "left_semi").collect()}
        if rows:
            ready.append(Index([r["item_id"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows], df, count, total / count, PASSAGE << scale))
            size += words
    if ready:
        yield ready


def _matches(index: Index, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score, question overlap, answer overlap) of each passage that holds an item; words as of words_of."""
    empty = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 3
    if len(h) == 0 or len(index.terms) == 0:
        return empty
    place = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == h)
    row, half = row_of(offsets), index.passage // 2
    # Passage k of a row has its half windows k and k + 1; a row of one half window has one passage.
    halves = np.maximum(1, -(-np.diff(offsets) // half))
    first = np.concatenate([[0], np.cumsum(np.maximum(1, halves - 1))])
    mine = (known - offsets[row[known]]) // half
    last = np.maximum(1, halves - 1)[row[known]] - 1
    base = first[row[known]]
    passage = np.concatenate([(base + mine)[mine <= last], (base + mine - 1)[mine >= 1]])
    term = np.concatenate([place[known][mine <= last], place[known][mine >= 1]])
    pair = distinct(passage * len(index.terms) + term)
    where, item, score = index.search(pair // len(index.terms), pair % len(index.terms), int(first[-1]))
    owner = np.searchsorted(first, where, "right") - 1
    begin = offsets[owner] + (where - first[owner]) * half
    q, a = np.zeros(len(where)), np.zeros(len(where))
    for i, (b, r, t) in enumerate(zip(begin.tolist(), owner.tolist(), item.tolist())):
        words = h[b : min(b + 2 * half, int(offsets[r + 1]))]
        for out, (n, part) in zip((q, a), index.parts[t]):
            out[i] = np.isin(part, grams_of(words, np.array([0, len(words)]), n)[0]).mean()
    good = (q >= OVERLAP) & (a >= OVERLAP)
    return owner[good], item[good], score[good], q[good], a[good]


def contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row for each document row and item it holds.

    Every passage of every document is a query. score is the best passage's BM25 as a share of the item's own. An
    item of fewer than LEAST_WORDS words is held where all its words stand in order next to one another. NULL and
    empty texts and texts without words hold nothing, nor do such items; repeated rows are reported each, and so are
    repeated items; a NULL doc_id or item_id stays NULL. Empty tables give an empty result.
    """
    out = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], out)
    for ready in indexes(benchmark, index_words):
        sent = docs.sparkSession.sparkContext.broadcast(ready)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    h, offsets = words_of(part.column("text"))
                    for index in sent.value:
                        row, item, score, q, a = _matches(index, h, offsets)
                        order = np.lexsort((-score, item, row))
                        row, item, score, q, a = (x[order] for x in (row, item, score, q, a))
                        best = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]) if len(row) else np.zeros(0, bool)
                        items = pa.array([index.ids[i] for i in item[best]], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(row[best])), items, pa.array(score[best]), pa.array(q[best]), pa.array(a[best])],
                            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        found = found.unionByName(text_columns(docs, "doc_id", "text").mapInArrow(look, out))
    return found


def _clean(sent):
    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            ok, done = np.ones(len(column), bool), 0
            for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                h, offsets = words_of(part.column("text"))
                for index in sent.value:
                    ok[done + _matches(index, h, offsets)[0]] = False
                done += part.num_rows
            yield pa.array(ok)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item; see contaminated for the cases."""
    for ready in indexes(benchmark, index_words):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(ready))
        docs = docs.where(clean(docs["text"]))
    return docs
