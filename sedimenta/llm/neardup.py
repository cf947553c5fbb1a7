"""MinHash near-duplicate groups: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.graph import components
from sedimenta.llm.shared import cut, text_columns, text_key, unused
from sedimenta.llm.words import distinct, grams_of, mix, slices, words_of

SHINGLE = 3
BINS = 128
ROWS = 4
THRESHOLD = 0.55
#: Texts of a band that one task compares, about; it decides how the work is cut and nothing else.
TASK_TEXTS = 1_000
#: Elements of up to so many sets of a task are counted pair by pair, others by matrix products.
FEW = 32

_NONE = np.uint64(2**64 - 1)


def sketch(values: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of n sets given as flat elements and owners: an (n, bins) array of uint64.

    Rounds 0..bins-1 throw every element into a hashed bin, rounds bins..2*bins-1 into bin (round - bins); a bin
    keeps the least (round, hash). A set is done once its bins are all filled, so a set of many elements takes one
    or two rounds and a set of one element at most 2 * bins. Bins of two sets agree with probability their Jaccard
    similarity. An empty set keeps the value 2**64 - 1 in every bin.
    """
    out = np.full(n * bins, _NONE, np.uint64)
    for r in range(2 * bins):
        if len(values) == 0:
            break
        h = mix(values + np.uint64((0xD6E8FEB86659FD93 * (r + 1)) % 2**64))
        at = (h & np.uint64(bins - 1)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(out, owner * bins + at, (np.uint64(r) << np.uint64(56)) | (h >> np.uint64(8)))
        open_rows = (out.reshape(n, bins) == _NONE).any(axis=1)
        left = open_rows[owner]
        values, owner = values[left], owner[left]
    return out.reshape(n, bins)


def band_hashes(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of `rows` bins; the band's number is part of it."""
    n, bins = sketches.shape
    out = np.tile(np.arange(1, bins // rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (n, 1))
    for r in range(rows):
        out = mix(out ^ sketches[:, r::rows])
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, owner = grams_of(*words_of(part.column("text")), SHINGLE)
            n = part.num_rows
            hashes = band_hashes(sketch(values, owner, n)).view(np.int64)
            some = np.bincount(owner, minlength=n) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * hashes.shape[1])]), pa.int32()), pa.array(hashes[some].ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), bands], ["doc_id", "key", "bands"])


def _sets(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
        values, owner = grams_of(*words_of(part.column("text")), SHINGLE)
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
        cut_at = np.searchsorted(owner, np.arange(part.num_rows + 1))
        out += [distinct(values[a:b]) for a, b in zip(cut_at, cut_at[1:])]
    return out


def similar_pairs(sets: list[np.ndarray], ones: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sorted sets i among `ones` and j among all that have at least that Jaccard similarity, i <> j.

    Sizes of intersections are added up over the elements that several sets have: one by one those of few sets, and
    as a matrix product those of many.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = (np.concatenate(sets), np.repeat(np.arange(n), size)) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    term = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1 if len(flat) else np.zeros(0, np.int64)
    df = np.bincount(term)
    at_one = np.full(n, -1)
    at_one[ones] = np.arange(len(ones))
    both = np.zeros((len(ones), n), np.float32)
    few = np.flatnonzero((df[term] > 1) & (df[term] <= FEW) & (at_one[owner] >= 0))
    begin = np.cumsum(df) - df
    for k in range(0, len(few), 1 << 18):
        part = few[k : k + (1 << 18)]
        own, times = term[part], df[term[part]]
        other = owner[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[own], times)]
        both += np.bincount(np.repeat(at_one[owner[part]], times) * n + other, minlength=len(ones) * n).reshape(both.shape)
    many = np.flatnonzero(df > FEW)
    for k in range(0, len(many), 2048):
        used = many[k : k + 2048]
        column = np.full(len(df), -1)
        column[used] = np.arange(len(used))
        here = np.flatnonzero(column[term] >= 0)
        has = np.zeros((n, len(used)), np.float32)
        has[owner[here], column[term[here]]] = 1
        both += has[ones] @ has.T
    near = (both > 0) & (both >= threshold * (size[ones][:, None] + size[None, :] - both))
    near[np.arange(len(ones)), ones] = False
    i, j = np.nonzero(near)
    return ones[i], j


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = _sets(part.column("text"))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "grams"])


def _stars_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = _lists(batch.column("grams_a")), _lists(batch.column("grams_b"))
        keep = [(n := len(np.intersect1d(x, y, True))) > 0 and n >= THRESHOLD * (len(x) + len(y) - n) for x, y in zip(one, two)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tasks_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; emits the pairs of groups (a, b) that a similar pair of texts of a task joins."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        task, node, own, one = (table.column(c).to_numpy() for c in ("task", "node", "own", "one"))
        sets = _lists(table.column("grams").chunk(0))
        edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
        found = [np.zeros((0, 2), np.int64)]
        for i, j in zip(edge, edge[1:]):
            a, b = similar_pairs(sets[i:j], np.flatnonzero(one[i:j]))
            a, b = own[i + a], own[i + b]
            found.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0))
        both = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        task = batch.column("task").to_numpy()
        split = int(np.searchsorted(task, task[-1]))
        if held and (split > 0 or held[0].column("task")[0].as_py() != task[0]):
            yield done(pa.Table.from_batches([*held, batch.slice(0, split)]))
            held = []
        elif split > 0:
            yield done(pa.Table.from_batches([batch.slice(0, split)]))
        held.append(batch.slice(split))
    if held:
        yield done(pa.Table.from_batches(held))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, key, doc_id, bands), one row for each distinct text: the exact copies are collapsed before banding."""
    rows = text_columns(docs, "doc_id", "text").where("text is not null").withColumn("key", text_key())
    banded = rows.mapInArrow(_bands, "doc_id long, key binary, bands array<long>")
    one = banded.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    return cut(one.withColumn("node", F.monotonically_increasing_id()), "texts")


def near_groups(docs: DataFrame, task_texts: int = TASK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(texts, groups): distinct_texts and (node, root) of the texts that are in a group of two or more.

    Groups are the components of the graph that joins two texts if they share a band and have the threshold's
    similarity, whatever the sizes of bands and groups and whatever task_texts. First each text is compared with the
    least of each of its bands; what that joins needs no further comparison. In bands that are left with several
    groups the texts outside the largest one are compared with all, in tasks of a part of the ones and a part of the
    others, about task_texts each.
    """
    texts = distinct_texts(docs)
    in_band = texts.select("node", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1").select("band", "lead")
    member = cut(in_band.join(shared, "band").select("band", "node", "lead"), "bands")
    wanted = member.select("node").distinct().join(texts.select("node", "key", F.col("doc_id").alias("least_id")), "node")
    source = text_columns(docs, "doc_id", "text").where("text is not null").withColumn("key", text_key())
    found = source.join(wanted, (source["key"] == wanted["key"]) & source["doc_id"].eqNullSafe(wanted["least_id"])).select("node", "text")
    # Rows that repeat doc_id and text are one text.
    sets = cut(found.mapInArrow(_grams, "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams")), "sets")
    edges = member.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = edges.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    own = cut(components(pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(_stars_similar, "a long, b long")), "groups")
    more = cut(_between_groups(member, own, sets, task_texts), "links")
    linked = components(more).select(F.col("node").alias("own"), F.col("root").alias("top"))
    known = own.join(linked, own["root"] == linked["own"], "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = linked.join(own, linked["own"] == own["node"], "left_anti").select(F.col("own").alias("node"), F.col("top").alias("root"))
    return texts, known.unionByName(alone)


def _between_groups(member: DataFrame, own: DataFrame, sets: DataFrame, task_texts: int) -> DataFrame:
    """(a, b): groups that a similar pair of texts joins, of all pairs that share a band and are in different groups."""
    placed = member.select("band", "node").join(own, "node", "left").select("band", "node", F.coalesce("root", "node").alias("own"))
    parts = placed.groupBy("band", "own").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print"))
    bands = parts.groupBy("band").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "own")).alias("main"), F.sum("print").alias("print"), F.count(F.lit(1)).alias("groups")
    ).where("groups > 1")
    # Bands of the same texts are looked at once.
    bands = bands.groupBy("n", "print").agg(F.min(F.struct("band", F.col("main.own").alias("main"), F.col("main.n").alias("most"))).alias("b"))
    tasks = lambda n: F.ceil(n / F.lit(task_texts)).cast("long")
    bands = bands.select("b.band", "b.main", tasks(F.col("n") - F.col("b.most")).alias("few"), tasks(F.col("n")).alias("all"))
    rows = placed.join(bands, "band").withColumn("i0", F.pmod(F.xxhash64("node"), "few")).withColumn("j0", F.pmod(F.xxhash64("node", "band"), "all"))
    other = F.col("own") != F.col("main")
    every = rows.select("band", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).alias("i"), F.col("j0").alias("j"), (other & (F.col("i") == F.col("i0"))).alias("one"))
    again = rows.where(other).select("band", "node", "own", F.col("i0").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"), "j0").where("j <> j0")
    meet = every.unionByName(again.drop("j0").withColumn("one", F.lit(True))).select(F.xxhash64("band", "i", "j").alias("task"), "node", "own", "one")
    return meet.join(sets, "node").repartition("task").sortWithinPartitions("task").mapInArrow(_tasks_similar, "a long, b long").distinct()


def keepers(docs: DataFrame) -> DataFrame:
    """(key, keep_key, keep_id) for each distinct text: the text and doc_id that stay for its group.

    The text of the least doc_id of a group stays, a NULL doc_id being greater than all; the digest breaks ties.
    """
    texts, groups = near_groups(docs)
    grouped = texts.select("node", "key", "doc_id").join(groups, "node")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    chosen = grouped.join(best, "root").select("node", "best")
    single = F.col("best").isNull()
    return texts.select("node", "key", "doc_id").join(chosen, "node", "left").select(
        "key", F.when(single, F.col("key")).otherwise(F.col("best.key")).alias("keep_key"), F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, keep) for every row of docs: the document that stays for its group, and whether it is this one.

    Two documents are joined if their sketches share a band and the Jaccard similarity of their word 3-grams is
    THRESHOLD or more; groups are what is joined directly or through others. Exact copies are always grouped. Of rows that repeat both
    doc_id and text one is kept. Texts without a word have exact copies only. A NULL text is in no group: its row is
    kept with keep_id its own doc_id. An empty table gives an empty result.
    """
    rows = text_columns(docs, "doc_id", "text").select("doc_id", text_key().alias("key"))
    # Copies of one text are rows of one key only as long as their doc_ids differ: those that repeat are counted.
    own = rows.where("key is not null").groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(keepers(docs), "key")
    best = (F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = own.select("doc_id", "keep_id", best.alias("best"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    kept = each.select("doc_id", "keep_id", (F.col("best") & (F.col("nth") == 1)).alias("keep"))
    return kept.unionByName(rows.where("key is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(True).alias("keep")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each group; see near_duplicates for the cases."""
    key, best_key, best_id = unused(docs, "near_key", "best_key", "best_id")
    best = keepers(docs).where("key = keep_key").select(F.col("key").alias(best_key), F.col("keep_id").alias(best_id))
    marked = docs.withColumn(key, F.unhex(F.md5(F.encode(docs["text"], "UTF-8"))))
    joined = marked.join(best, (marked[key] == best[best_key]) & marked["doc_id"].eqNullSafe(best[best_id]), "left")
    kept = joined.where(F.col(key).isNull() | F.col(best_key).isNotNull())
    again = text_columns(docs, "doc_id", "text").where("text is not null").groupBy("doc_id", text_key().alias("k")).count().where("count > 1")
    if again.limit(1).count():
        # Rows that repeat doc_id and text: one stays; NULL texts are no duplicates of one another.
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
    return kept.select(*[kept[c] for c in docs.columns])
