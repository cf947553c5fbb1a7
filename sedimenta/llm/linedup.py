"""Line dedup by pairwise alignment: shared rare lines find the pairs, patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, text_columns, text_key
from sedimenta.llm.words import CLASS, hash_spans, mix, raw, row_of, slices

#: A line is rare if so many distinct texts have it at most; all pairs of them are aligned.
RARE = 8
#: Words that a common block has at least to be deleted: one full line of boilerplate is enough.
LEAST_WORDS = 5
_LAST = 2**63 - 1


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word counts, row offsets) of the lines of each text; lines end at line feeds, empty ones hash to 0."""
    data, offsets = raw(column)
    n = len(data)
    feed = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    start = np.sort(np.concatenate([offsets[:-1][full], feed + 1]))
    end = np.sort(np.concatenate([offsets[1:][full], feed]))
    word = np.zeros(n + 1, np.int64)
    if n:
        solid = CLASS[data] != 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[offsets[:-1][full]] |= solid[offsets[:-1][full]]
        np.cumsum(begins, out=word[1:])
    h = hash_spans(data, start, end) if n else np.zeros(0, np.uint64)
    h[start == end] = 0
    rows = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([full, np.searchsorted(offsets, feed, "right") - 1]), minlength=len(column)))])
    return h, word[end] - word[start], rows


def runs_of(h: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the shortest runs of lines of `least` words or more from each line on, within rows.

    Two texts have a common block of so many words if and only if they share such a run.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + least)
    row = row_of(offsets)
    good = np.flatnonzero((stop <= offsets[1:][row]) & (words > 0))
    out = np.zeros(len(good), np.uint64)
    length = stop[good] - good
    for i in range(int(length.max()) if len(good) else 0):
        more = np.flatnonzero(length > i)
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[good[more] + i] + np.uint64(1))
    return out, row[good]


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, length) of two sequences, in order.

    Items that occur once in each are matched and the longest chain of them in both orders is kept; each is extended
    over equal neighbours, and the gaps between are aligned in the same way. In a gap without such an item the first
    occurrences of each match one another, the second ones, and so on.
    """
    out: list[tuple[int, int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        if alo >= ahi or blo >= bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at_b = {x: j for j, x in enumerate(b[blo:bhi], blo) if in_b[x] == 1}
        found = [(i, at_b[x]) for i, x in enumerate(a[alo:ahi], alo) if in_a[x] == 1 and x in at_b]
        if not found:
            nth: Counter = Counter()
            numbered = {}
            for j in range(blo, bhi):
                numbered[b[j], nth[b[j]]] = j
                nth[b[j]] += 1
            nth = Counter()
            for i in range(alo, ahi):
                if (a[i], nth[a[i]]) in numbered:
                    found.append((i, numbered[a[i], nth[a[i]]]))
                nth[a[i]] += 1
            if not found:
                continue
        tops: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(found):
            at = bisect_left(tops, j)
            back.append(last[at - 1] if at else -1)
            if at == len(tops):
                tops.append(j)
                last.append(k)
            else:
                tops[at], last[at] = j, k
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(found[k])
            k = back[k]
        ai, bi = alo, blo
        for i, j in reversed(chain):
            if i < ai or j < bi:
                continue
            i0, j0 = i, j
            while i0 > ai and j0 > bi and a[i0 - 1] == b[j0 - 1]:
                i0, j0 = i0 - 1, j0 - 1
            i1, j1 = i + 1, j + 1
            while i1 < ahi and j1 < bhi and a[i1] == b[j1]:
                i1, j1 = i1 + 1, j1 + 1
            out.append((i0, j0, i1 - i0))
            stack.append((ai, i0, bi, j0))
            ai, bi = i1, j1
        stack.append((ai, ahi, bi, bhi))
    out.sort()
    merged: list[tuple[int, int, int]] = []
    for i, j, n in out:
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
        else:
            merged.append((i, j, n))
    return merged


def common_lines(earlier: list, later: list, words: list, least: int = LEAST_WORDS) -> list[int]:
    """Lines of the later text that are in an aligned common block of `least` words or more."""
    return [k for _, j, n in patience(earlier, later) if sum(words[j : j + n]) >= least for k in range(j, j + n)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, words, offsets = lines_of(part.column("text"))
            runs, row = runs_of(h, words, offsets)
            order = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("key"), pa.ListArray.from_arrays(order, pa.array(h.view(np.int64))),
                    pa.ListArray.from_arrays(order, pa.array(words, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()), pa.array(runs.view(np.int64))),
                ],
                ["doc_id", "key", "lines", "words", "runs"],
            )


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, gone = [], []
        columns = [batch.column(c).to_pylist() for c in ("node", "a_lines", "b_lines", "b_words")]
        for node, a, b, words in zip(*columns):
            lines = common_lines(a, b, words)
            nodes += [node] * len(lines)
            gone += lines
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(gone, pa.int32())], ["node", "line"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, rank, key, doc_id, copies, lines, words, runs), one row for each distinct text."""
    rows = text_columns(docs, "doc_id", "text").where("text is not null").withColumn("key", text_key())
    printed = rows.mapInArrow(_prints, "doc_id long, key binary, lines array<long>, words array<int>, runs array<long>")
    one = printed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("lines", "words", "runs")])
    return cut(one.withColumn("node", F.monotonically_increasing_id()).withColumn("rank", F.coalesce("doc_id", F.lit(_LAST))), "texts")


def overlapping(texts: DataFrame) -> DataFrame:
    """(early, node): pairs of texts to be aligned.

    All texts of a rare line are paired with one another. Blocks whose lines are all frequent are covered by their
    runs: each text is paired with the RARE earliest ones that have the same run, so pairs grow with the texts and not
    with their square, and every common block long enough to be deleted is in some pair. It stays only where it
    crosses longer common blocks in all of these pairs.
    """
    # Only the first rows of each hash are ranked, which Spark limits before the shuffle too, so a line or a run of very
    # many texts is never sorted in one task.
    first = lambda rows, n: rows.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("own"))).where(F.col("nth") <= n)
    line = texts.select(F.struct("rank", "node").alias("own"), F.explode(F.array_distinct("lines")).alias("h")).where("h <> 0")
    group = first(line, RARE + 1).groupBy("h").agg(F.sort_array(F.collect_list("own")).alias("m")).where(F.size("m").between(2, RARE))
    one = group.select(F.posexplode("m").alias("i", "one"), "m").select("one", F.explode(F.slice("m", F.lit(1), F.col("i"))).alias("other"))
    rare = one.select(F.col("other.node").alias("early"), F.col("one.node").alias("node"))
    run = texts.select(F.struct("rank", "node").alias("own"), F.explode(F.array_distinct("runs")).alias("h"))
    stars = cut(first(run, RARE + 1).groupBy("h").agg(F.sort_array(F.collect_list("own")).alias("m")).where(F.size("m") > 1), "stars")
    known = stars.select(F.posexplode("m").alias("i", "one"), "m").where(F.col("i") < RARE).select("one", F.explode(F.slice("m", F.lit(1), F.col("i"))).alias("other"))
    known = known.select(F.col("other.node").alias("early"), F.col("one.node").alias("node"))
    # The texts of a run beyond its first ones meet these in a join, which splits hashes of very many texts.
    full = stars.where(F.size("m") > RARE).select("h", F.slice("m", 1, RARE).alias("m"))
    later = run.join(full, "h").where(F.col("own") > F.col("m")[RARE - 1]).select(F.explode("m.node").alias("early"), F.col("own.node").alias("node"))
    return rare.union(known).union(later).distinct()


def deduped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed_lines) for every row of docs, the text without the blocks that an earlier one has.

    Earlier is the lesser doc_id, a NULL doc_id being later than all. A block is a run of lines that the patience
    alignment of two texts matches, of LEAST_WORDS words or more; it stays in the earlier text. Of equal texts the
    one of the least doc_id counts as the earlier one, and if they have LEAST_WORDS words the others lose all their
    lines; rows that repeat doc_id and text are one document and treated alike. A NULL text stays NULL and an empty
    one empty, with 0 lines removed. An empty table gives an empty result.
    """
    texts = distinct_texts(docs)
    pairs = overlapping(texts)
    sides = pairs.join(texts.select(F.col("node").alias("early"), F.col("lines").alias("a_lines")), "early")
    sides = sides.join(texts.select("node", F.col("lines").alias("b_lines"), F.col("words").alias("b_words")), "node")
    gone = sides.select("node", "a_lines", "b_lines", "b_words").mapInArrow(_align, "node long, line int").groupBy("node").agg(F.collect_set("line").alias("gone"))
    enough = F.aggregate("words", F.lit(0), lambda s, x: s + x) >= LEAST_WORDS
    known = texts.select("node", "key", F.col("doc_id").alias("first_id"), (enough & (F.col("copies") > 1)).alias("copied")).join(gone, "node", "left")
    known = cut(known.where("copied or gone is not null").select("key", "first_id", "copied", "gone"), "blocks")
    # The table of blocks grows with the texts, so it is merged with them at any size and never broadcast.
    rows = text_columns(docs, "doc_id", "text").withColumn("key", text_key()).join(known.hint("merge"), "key", "left")
    later = F.coalesce(F.col("copied") & ~F.col("doc_id").eqNullSafe(F.col("first_id")), F.lit(False))
    line = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("line", i)), "\n")
    rows = rows.withColumn("line", line)
    return rows.select(
        "doc_id",
        F.when(later, F.lit("")).when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(later, F.size("line")).when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).alias("removed_lines"),
    )
