"""Suffix-array dedup: passages of SPAN words or more that occur before, found by linear grouping construction.

Every passage of SPAN words belongs to the least GRAM of words in it, its home. All passages of one home go to one
task, where the suffix array of their regions puts equal ones side by side; the common prefixes of neighbours there
are all that decides. So each passage is looked at in one place, and suffix arrays stay small at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, text_columns, text_key
from sedimenta.llm.suffixes import suffix_array
from sedimenta.llm.words import _run, distinct, mix, row_of, slices, words_of

SPAN = 50
#: Words of the grams of which the least of a passage is its home.
GRAM = 25
#: Words of regions that one suffix array is built of, about. A home of more is cut, and what the parts found meets.
BLOCK_WORDS = 150_000
#: Passages of a run at most, so that one of a very long text of few words is cut as well.
RUN = 50_000
#: Words of regions that are sent on at once, about.
_SEND = 1 << 20
_LAST = 2**63 - 1


def homes(h: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM, longest: int = RUN) -> tuple[np.ndarray, ...]:
    """(start, length, home, twice): runs of starts of the passages of span words within rows that have one home.

    Equal passages have equal homes. twice says that the home is at several places of the row, without which no two
    passages of the run are equal.
    """
    n = len(h) - gram + 1
    if n <= span - gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    gram_hash = _run(h, slice(None), gram, n)
    least = gram_hash
    width, have = span - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    rows = row_of(offsets)
    row = rows[: len(least)]
    inside = np.arange(len(least)) + span <= offsets[1:][row]
    edge = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])])
    at = np.arange(len(least))
    edge |= (at - np.maximum.accumulate(np.where(edge, at, 0))) % longest == 0
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(least)))
    good = inside[start]
    start, length = start[good], length[good]
    salt = mix(np.arange(len(offsets), dtype=np.uint64))
    seen = np.sort(gram_hash ^ salt[rows[:n]])
    again = distinct(seen[1:][seen[1:] == seen[:-1]])
    home = least[start]
    if not len(again):
        return start, length, home, np.zeros(len(start), bool)
    own = home ^ salt[row[start]]
    return start, length, home, again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the number of words and its homes, with the words of their regions, negative for homes at several places."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, offsets = words_of(part.column("text"), marks=True)
            start, length, home, twice = homes(h, offsets)
            row = row_of(offsets)[start]
            order = np.lexsort((home, row))
            row, home, twice, size = row[order], home[order], twice[order], (length + SPAN - 1)[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (home[1:] != home[:-1])])) if len(row) else np.zeros(0, np.int64)
            size = np.add.reduceat(size, first) if len(first) else size
            ends = pa.array(np.searchsorted(row[first], np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (home[first].view(np.int64), np.where(twice[first], -size, size))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(np.diff(offsets), pa.int32()), *lists], ["doc_id", "key", "words", "homes", "sizes"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of passages of a wanted home: the home, its part, and the hashes of the words that the run covers."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, offsets = words_of(part.column("text"), marks=True)
            start, length, home, _ = homes(h, offsets)
            cut_at = np.searchsorted(start, offsets)
            used, share = [], []
            for i, (wanted, parts) in enumerate(zip(part.column("homes"), part.column("parts"))):
                wanted, parts = wanted.values.to_numpy().view(np.uint64), parts.values.to_numpy()
                order = np.argsort(wanted)
                own = home[cut_at[i] : cut_at[i + 1]]
                at = order[np.minimum(np.searchsorted(wanted[order], own), len(wanted) - 1)]
                hit = np.flatnonzero(wanted[at] == own)
                used.append(cut_at[i] + hit)
                share.append(parts[at[hit]])
            used, share = np.concatenate(used), np.concatenate(share)
            total = np.cumsum(length[used] + SPAN - 1)
            lo = 0
            while lo < len(used):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _SEND, "right")))
                runs, parts = used[lo:hi], share[lo:hi]
                begin, size = start[runs], length[runs] + SPAN - 1
                place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                ends = pa.array(np.concatenate([[0], np.cumsum(size * 8)]), pa.int32())
                region = pa.BinaryArray.from_buffers(pa.binary(), len(runs), [None, ends.buffers()[1], pa.py_buffer(h[place].tobytes())])
                row = row_of(offsets)[begin]
                node, at = part.column("node").take(pa.array(row)), begin - offsets[row]
                # Any cut of a home into parts will do: what is equal in several of them meets later.
                spread = mix(node.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)) % parts.astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home[runs].view(np.int64)), pa.array(spread.astype(np.int64)), pa.array(parts > 1), part.column("rank").take(pa.array(row)), node, pa.array(at, pa.int32()), region],
                    ["home", "part", "open", "rank", "node", "at", "region"],
                )
                lo = hi


def suffix_groups(regions: list[np.ndarray], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, offset, group) of every passage of span words of the regions; equal passages have equal groups.

    Groups are runs of the suffix array in which neighbours have common prefixes of span words or more.
    """
    size = np.array([len(r) for r in regions], np.int64)
    h = np.concatenate(regions)
    n, k = len(h), len(regions)
    region = np.repeat(np.arange(k), size)
    # A separator of its own, below all words, ends each region.
    slot, ends = np.arange(n) + region, np.cumsum(size) + np.arange(k)
    order = np.argsort(h, kind="stable")
    symbols = np.empty(n + k, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (np.diff(h[order]) != 0).astype(np.int64)]))
    symbols[slot], symbols[ends] = rank + k, np.arange(k)
    suffix = suffix_array(symbols)
    of = np.repeat(np.arange(k), size + 1)
    suffix = suffix[ends[of[suffix]] - suffix >= span]
    same = np.arange(max(0, len(suffix) - 1))
    for i in range(span):
        same = same[symbols[suffix[same] + i] == symbols[suffix[same + 1] + i]]
    new = np.ones(len(suffix), bool)
    new[same + 1] = False
    return of[suffix], suffix - (ends - size)[of[suffix]], np.cumsum(new) - 1


_FOUND = "node long, start int, stop int, first_node long, first_rank long, first_at int, open boolean, home long, words binary"


def _first(group: np.ndarray, rank: np.ndarray, node: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each element the one of the least (rank, node, at) of its group; groups count from 0."""
    order = np.lexsort((at, node, rank, group))
    own = group[order]
    return order[np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))][group]


def _search(table: pa.Table) -> pa.RecordBatch:
    """Repeats among regions of whole homes, or of whole parts of homes that have several.

    Of the former all passages but the first of their group, as runs of starts that have one first text. Of the
    latter all passages one by one with the first of the part, and that one's words.
    """
    # Rows that repeat doc_id and text give the same places again.
    node, at = table.column("node").to_numpy(), table.column("at").to_numpy()
    order = np.lexsort((at, node))
    table = table.take(pa.array(order[np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(at[order]) != 0)])]))
    home, rank, node, at, is_open = (table.column(c).to_numpy() for c in ("home", "rank", "node", "at", "open"))
    known: dict[bytes, int] = {}
    kind = np.array([known.setdefault(r, len(known)) for r in table.column("region").to_pylist()])
    regions = [np.frombuffer(r, np.uint64) for r in known]
    region, offset, group = suffix_groups(regions)
    # The least place of each region is the only one that can be the first of a group.
    least = _first(kind, rank, node, at)
    of_kind = np.empty(len(regions), np.int64)
    of_kind[kind] = least
    lead = of_kind[region]
    place = at[lead] + offset
    first = _first(group, rank[lead], node[lead], place)
    order = np.lexsort((offset, region))
    region, offset, first = region[order], offset[order], first[order]
    first_rank, first_node, first_at = rank[lead][first], node[lead][first], place[first]
    itself = first == order
    closed = ~is_open[of_kind][region]
    edge = np.concatenate([[True], (region[1:] != region[:-1]) | (first_node[1:] != first_node[:-1]) | (itself[1:] != itself[:-1]) | ~closed[1:]])
    run = np.flatnonzero(edge)
    begin, end = offset[run], offset[run] + np.diff(np.append(run, len(region)))
    at_run = np.searchsorted(region[run], np.arange(len(regions) + 1))
    # Each place of a region has the runs of the region.
    runs = np.diff(at_run)[kind]
    who = np.repeat(np.arange(len(kind)), runs)
    which = np.arange(len(who)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(at_run[kind], runs)
    spot = run[which]
    keep = ~closed[spot] | ~(itself[spot] & (least[who] == who))
    who, which, spot = who[keep], which[keep], spot[keep]
    one = ~closed[spot] & itself[spot] & (least[who] == who)
    words = [regions[region[s]][offset[s] : offset[s] + SPAN].tobytes() if o else None for s, o in zip(spot.tolist(), one.tolist())] if one.any() else [None] * len(spot)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(node[who]), pa.array(at[who] + begin[which], pa.int32()), pa.array(at[who] + end[which], pa.int32()), pa.array(first_node[spot]),
            pa.array(first_rank[spot]), pa.array(first_at[spot], pa.int32()), pa.array(~closed[spot]), pa.array(home[who]), pa.array(words, pa.binary()),
        ],
        [c.split()[0] for c in _FOUND.split(", ")],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by home and part, which no block cuts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        home, share = batch.column("home").to_numpy(), batch.column("part").to_numpy()
        new = np.concatenate([[not held or held[-1].column("home")[-1].as_py() != home[0] or held[-1].column("part")[-1].as_py() != share[0]], (home[1:] != home[:-1]) | (share[1:] != share[:-1])])
        words = np.cumsum(pc.binary_length(batch.column("region")).to_numpy() // 8)
        begin, before = 0, 0
        for i in np.flatnonzero(new):
            done = (words[i - 1] if i else 0) - before
            if size + done >= BLOCK_WORDS:
                yield _search(pa.Table.from_batches([*held, batch.slice(begin, i - begin)]))
                held, size, begin, before = [], 0, i, before + done
        held.append(batch.slice(begin))
        size += words[-1] - before
    if size:
        yield _search(pa.Table.from_batches(held))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, key, doc_id, words, homes, sizes), one row for each distinct text: exact copies are repeats as a whole."""
    rows = text_columns(docs, "doc_id", "text").where("text is not null").withColumn("key", text_key())
    printed = rows.mapInArrow(_prints, "doc_id long, key binary, words int, homes array<long>, sizes array<long>")
    one = printed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("words", "homes", "sizes")])
    return cut(one.withColumn("node", F.monotonically_increasing_id()), "texts")


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, start_word, end_word, first_node): what of each distinct text occurs before, in order of doc_id."""
    flat = texts.select("node", F.explode(F.arrays_zip("homes", "sizes")).alias("p")).select("node", F.col("p.homes").alias("home"), F.col("p.sizes").alias("size"))
    often = flat.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("size")).alias("words"), F.min("size").alias("least")).where("n > 1 or least < 0")
    parts = often.select("home", F.ceil(F.col("words") / F.lit(BLOCK_WORDS)).cast("long").alias("parts"))
    wanted = flat.join(parts, "home").groupBy("node").agg(F.collect_list(F.struct("home", "parts")).alias("p"))
    wanted = wanted.select("node", F.col("p.home").alias("homes"), F.col("p.parts").alias("parts"))
    wanted = cut(wanted.join(texts.select("node", "key", F.col("doc_id").alias("least_id")), "node"), "candidates")
    source = text_columns(docs, "doc_id", "text").where("text is not null").withColumn("key", text_key())
    found = source.join(wanted, (source["key"] == wanted["key"]) & source["doc_id"].eqNullSafe(wanted["least_id"]))
    found = found.select(F.coalesce("doc_id", F.lit(_LAST)).alias("rank"), "node", "homes", "parts", "text")
    regions = found.mapInArrow(_regions, "home long, part long, open boolean, rank long, node long, at int, region binary")
    local = cut(regions.repartition("home", "part").sortWithinPartitions("home", "part").mapInArrow(_blocks, _FOUND), "repeats")
    # Parts of a home meet: of the firsts of each, those of equal words have the least one for first.
    least = F.min(F.struct("first_rank", "first_node", "first_at"))
    met = local.where("words is not null").groupBy("home", "words").agg(least.alias("first"), F.collect_list(F.struct("first_node", "first_at")).alias("firsts"))
    met = met.select(F.explode("firsts").alias("own"), "first").select(F.col("own.first_node").alias("own_node"), F.col("own.first_at").alias("own_at"), "first.first_node", "first.first_at")
    still = local.where("open").select("node", "start", F.col("first_node").alias("own_node"), F.col("first_at").alias("own_at")).join(met, ["own_node", "own_at"])
    still = still.where("node <> first_node or start <> first_at").select("node", "start", (F.col("start") + 1).alias("stop"), "first_node")
    runs = local.where("not open").select("node", "start", "stop", "first_node").unionByName(still)
    order = Window.partitionBy("node", "first_node").orderBy("start")
    step = runs.withColumn("fresh", (F.col("start") > F.lag("stop", 1, -1).over(order)).cast("int"))
    spans = step.withColumn("span", F.sum("fresh").over(order)).groupBy("node", "first_node", "span")
    return spans.agg(F.min("start").alias("start_word"), (F.max("stop") + SPAN - 1).alias("end_word")).drop("span")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): the words [start_word, end_word) of a document that occur before.

    Every passage of SPAN words or more is reported wherever it occurs but for its first place, which is the one in
    the least doc_id and the leftmost there; a NULL doc_id is greater than all. Passages that first occur in
    different documents are reported apart, and what a document has twice is reported too. Words are what ASCII white
    space ends; their case and ASCII punctuation don't count, but what is nothing but punctuation is a word as well. Of
    texts that are equal the first row is compared with other texts and the others are repeats from end to end.
    NULL and empty texts and texts of fewer words have no passage; an empty table gives an empty result.
    """
    texts = distinct_texts(docs)
    spans = cut(repeated_spans(docs, texts), "spans")
    named = texts.select(F.col("node").alias("first_node"), F.col("doc_id").alias("first_doc_id"))
    spans = spans.join(named, "first_node").join(texts.select("node", "doc_id"), "node").select("doc_id", "start_word", "end_word", "first_doc_id")
    # Of copies all rows but one of the least doc_id are repeats; rows that repeat doc_id and text are counted first.
    rows = text_columns(docs, "doc_id", "text").where("text is not null").groupBy(text_key().alias("key"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    long = texts.where(F.col("words") >= SPAN).select("key", "words", F.col("doc_id").alias("first_doc_id"))
    later = rows.join(long, "key").withColumn("n", F.col("n") - F.col("doc_id").eqNullSafe(F.col("first_doc_id")).cast("long")).where("n > 0")
    whole = later.select("doc_id", F.lit(0).alias("start_word"), F.col("words").alias("end_word"), "first_doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")
    return spans.unionByName(whole)
