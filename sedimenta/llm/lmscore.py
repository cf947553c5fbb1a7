"""LM scoring: cross-entropy difference of a target and a background bigram model over one shared vocabulary.

Both models count every word and every bigram of the corpus. The texts are written once as parts of tokens; what a part
asks of the corpus (the ids and counts of its words, the counts of its bigrams) goes by hash to shards, whose number
grows with the tokens, and the sums come back to the part. So no task and no driver holds a table of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, text_columns
from sedimenta.llm.words import distinct, mix, slices, words_of

#: Tokens of a part, and of the parts for which there is one shard of words and of bigrams.
PART_TOKENS = 2_000_000
#: Ids of target documents up to so many bytes are sent to the workers; more are joined.
BROADCAST_BYTES = 64 << 20
#: Symbols of the start of a text and, if the vocabulary is bounded, of the words outside.
_START, _UNKNOWN = np.uint64(0x5A17C0DE5EED0001), np.uint64(0x5A17C0DE5EED0003)
_ASKED = "part long, shard long, a binary, b binary"


def packed(x: np.ndarray) -> bytes:
    """The array compressed, its bytes ordered by place; see unpacked."""
    body = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if size == 0:
        return np.zeros(0, kind)
    body = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(body.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            h = np.sort(words_of(part.column("text"))[0])
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            merged = distinct(np.concatenate([words, h[first]]))
            total = np.zeros(len(merged), np.int64)
            total[np.searchsorted(merged, words)] = counts
            total[np.searchsorted(merged, h[first])] += n
            words, counts = merged, total
    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])


def vocabulary(docs: DataFrame, symbols: int) -> np.ndarray:
    """Sorted hashes of the symbols - 2 most frequent words of all texts; equal counts are ordered by hash."""
    counted = text_columns(docs, "text").mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(symbols - 2).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def target_ids_of(target_ids: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> np.ndarray | None:
    """The sorted distinct ids of the target documents, None if they are too many to be sent to the workers."""
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct()
    if ids.count() * 8 > broadcast_bytes:
        return None
    return np.sort(ids.toArrow().column("doc_id").to_numpy())


def _among(column: pa.Array, ids: np.ndarray) -> np.ndarray:
    own = column.fill_null(0).to_numpy(zero_copy_only=False)
    if len(ids) == 0:
        return np.zeros(len(own), bool)
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    return (ids[at] == own) & ~column.is_null().to_numpy(zero_copy_only=False)


def parts_of(docs: DataFrame, target_ids: DataFrame, vocab: np.ndarray | None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Parts of texts of about PART_TOKENS tokens: (part, tokens, ids, known, sizes, target, words, at).

    The columns are packed arrays: of each row doc_id, whether it has one, its number of words and whether it is a
    target; the sorted distinct words of the part, the start among them, and the place of each token in them.
    """
    ids = target_ids_of(target_ids, broadcast_bytes)
    rows = text_columns(docs, "doc_id", "text")
    if ids is None:
        marked = target_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
        rows = rows.join(marked, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    sent = docs.sparkSession.sparkContext.broadcast((vocab, ids))
    most = PART_TOKENS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, ids = sent.value
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            word, own, known, sizes, target = (np.concatenate(x) for x in zip(*held))
            words = distinct(np.append(word, _START))
            at = np.searchsorted(words, word).astype(np.int32)
            packs = [packed(x) for x in (own, known, sizes, target, words, at)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(word)], pa.int64()), *[pa.array([x], pa.binary()) for x in packs]], ["part", "tokens", "ids", "known", "sizes", "target", "words", "at"])

        for batch in batches:
            for part in slices(batch, "text"):
                h, offsets = words_of(part.column("text"))
                if vocab is not None:
                    h = np.where(np.isin(h, vocab), h, _UNKNOWN)
                column = part.column("doc_id")
                target = part.column("target").to_numpy(zero_copy_only=False) if ids is None else _among(column, ids)
                held.append((h, column.fill_null(0).to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False), np.diff(offsets), target))
                size += len(h)
                if size >= most:
                    yield done()
                    held, size, number = [], 0, number + 1
        if held:
            yield done()

    return cut(rows.mapInArrow(write, "part long, tokens long, ids binary, known binary, sizes binary, target binary, words binary, at binary"), "tokens")


def _asked(part: int, shard: np.ndarray, shards: int, columns: list[np.ndarray]) -> tuple[np.ndarray, pa.Table]:
    """The order of the elements by shard, and a row of packed columns for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    used = np.flatnonzero(np.diff(edge))
    packs = [[packed(c[..., order[edge[s] : edge[s + 1]]]) for s in used] for c in columns]
    return order, pa.table([pa.array(np.full(len(used), part), pa.int64()), pa.array(used, pa.int64()), *[pa.array(p, pa.binary()) for p in packs]], ["part", "shard", "a", "b"])


def _answer(table: pa.Table, kind: int) -> np.ndarray:
    """Columns of the answers of all shards to one part, in the order of the shards."""
    own = sorted((r for r in table.select(["kind", "shard", "a", "rows"]).to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
    return np.concatenate([unpacked(r["a"], np.int64).reshape(r["rows"], -1) for r in own], axis=1) if own else np.zeros((8, 0), np.int64)


def _answers(table: pa.Table, size: list[int], kind: int, values: np.ndarray) -> pa.Table:
    """A row for each row that asked: its own columns of values, which are those of all rows one after another."""
    edge = np.concatenate([[0], np.cumsum(size)]).astype(int)
    packs = [packed(values[:, a:b]) for a, b in zip(edge, edge[1:])]
    n = len(packs)
    return pa.table([table["part"], table["shard"], pa.array([kind] * n, pa.int64()), pa.array([len(values)] * n, pa.int64()), pa.array(packs, pa.binary())], ["part", "shard", "kind", "rows", "a"])


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, history, word, row, target) of a part: places of each token and the one before, and its row's number."""
    words, at, sizes, target = (unpacked(table[c][0].as_py(), k) for c, k in (("words", np.uint64), ("at", np.int32), ("sizes", np.int64), ("target", np.bool_)))
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = np.searchsorted(words, _START)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return words, before, at.astype(np.int64), row, target[row]


def _pairs(table: pa.Table, answers: pa.Table, shards: int) -> tuple:
    """(word answers by place, distinct bigrams of ids, their shards, the bigram of each token) and what _tokens has."""
    tokens = _tokens(table)
    known = _answer(answers, 0)
    words = np.empty_like(known)
    words[:, np.argsort((tokens[0] % np.uint64(shards)).astype(np.int64), kind="stable")] = known
    key = (words[0][tokens[1]].astype(np.uint64) << np.uint64(32)) | words[0][tokens[2]].astype(np.uint64)
    pair, which = np.unique(key, return_inverse=True)
    return words, pair, (mix(pair) % np.uint64(shards)).astype(np.int64), which, tokens


def score(docs: DataFrame, target_ids: DataFrame, symbols: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, score) for every row of docs; score is the mean loss difference of its words in nats.

    A low score means closer to the target documents, which are those of target_ids; the background model is that of
    all documents. Counts are over all texts in full, of every word; symbols bounds the vocabulary to the symbols - 2
    most frequent words, one symbol for all others and the start. A NULL text and one without words have 0 words and a
    NULL score. A NULL doc_id is never a target; repeated rows count and are scored each. Without target documents the
    target model is uniform. An empty table gives an empty result.
    """
    parts = parts_of(docs, target_ids, None if symbols is None else vocabulary(docs, symbols), broadcast_bytes)
    shards = max(1, -(-(parts.agg(F.sum("tokens")).first()[0] or 0) // PART_TOKENS))
    answer = "part long, shard long, kind long, rows long, a binary"

    # Words: each gets an id, whose remainder by the shards is its shard, and its counts as word and as history.
    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                words, before, at, _, target = _tokens(table)
                n = np.stack([np.bincount(x, minlength=len(words)) for x in (at[target], at, before[target], before)])
                yield from _asked(table["part"][0].as_py(), (words % np.uint64(shards)).astype(np.int64), shards, [words, n])[1].to_batches()

    def add_words(table: pa.Table) -> pa.Table:
        words = [unpacked(x, np.uint64) for x in table["a"].to_pylist()]
        n = np.concatenate([unpacked(x, np.int64).reshape(4, -1) for x in table["b"].to_pylist()], axis=1)
        one, which = np.unique(np.concatenate(words), return_inverse=True)
        if len(one) * shards >= 2**32:
            raise ValueError("more words than ids of 32 bits")
        total = np.stack([np.bincount(which, x, len(one)).astype(np.int64) for x in n])
        out = _answers(table, [len(w) for w in words], 0, np.concatenate([[np.arange(len(one)) * shards + table["shard"][0].as_py()], total])[:, which])
        first = np.arange(table.num_rows) == 0
        plain = int((~np.isin(one, [_START, _UNKNOWN])).sum())
        for name, x in (("words", plain), ("target", int(total[0].sum())), ("background", int(total[1].sum()))):
            out = out.append_column(name, pa.array(np.where(first, x, 0), pa.int64()))
        return out

    asked = parts.select("part", "sizes", "target", "words", "at").mapInArrow(ask_words, _ASKED)
    words = cut(asked.groupBy("shard").applyInArrow(add_words, answer + ", words long, target long, background long"), "words")
    sums = words.agg(*[F.sum(c) for c in ("words", "target", "background")]).first()
    kinds_of_words, *model_tokens = (x or 0 for x in sums)
    size = symbols or kinds_of_words + 2
    words = words.select("part", "shard", "kind", "rows", "a")

    # Bigrams: the counts of each, and for each history the number of different words after it (shard: of the word).
    def ask_pairs(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, pair, shard, which, (*_, target) = _pairs(table, answers, shards)
        n = np.stack([np.bincount(which[target], minlength=len(pair)), np.bincount(which, minlength=len(pair))]).astype(np.int32)
        return _asked(table["part"][0].as_py(), shard, shards, [pair, n])[1]

    def add_pairs(table: pa.Table) -> pa.Table:
        pairs = [unpacked(x, np.uint64) for x in table["a"].to_pylist()]
        n = np.concatenate([unpacked(x, np.int32).reshape(2, -1) for x in table["b"].to_pylist()], axis=1)
        one, which = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.stack([np.bincount(which, x, len(one)).astype(np.int64) for x in n])
        out = _answers(table, [len(p) for p in pairs], 1, total[:, which])
        h, at = np.unique((one >> np.uint64(32)).astype(np.int64), return_inverse=True)
        kinds = np.stack([h, *[np.bincount(at, x > 0, len(h)).astype(np.int64) for x in total]])
        asks = _asked(-1, h % shards, shards, [kinds, np.zeros(len(h), np.uint8)])[1]
        n = asks.num_rows
        return pa.concat_tables([out, pa.table([asks["part"], asks["shard"], pa.array([2] * n, pa.int64()), pa.array([3] * n, pa.int64()), asks["a"]], out.column_names)])

    tokens = parts.groupBy("part")
    asked = tokens.cogroup(words.groupBy("part")).applyInArrow(ask_pairs, _ASKED)
    pairs = cut(asked.groupBy("shard").applyInArrow(add_pairs, answer), "bigrams")

    def add_kinds(table: pa.Table, kinds: pa.Table) -> pa.Table:
        ids = [unpacked(r["a"], np.int64).reshape(r["rows"], -1)[0] for r in table.select(["a", "rows"]).to_pylist()]
        own = np.concatenate([np.zeros((3, 0), np.int64), *[unpacked(x, np.int64).reshape(3, -1) for x in kinds["a"].to_pylist()]], axis=1)
        flat = np.concatenate(ids) // shards
        total = np.stack([np.bincount(own[0] // shards, x, flat.max() + 1).astype(np.int64) for x in own[1:]])
        return _answers(table, [len(x) for x in ids], 3, total[:, flat])

    kinds = words.groupBy("shard").cogroup(pairs.where("kind = 2").groupBy("shard")).applyInArrow(add_kinds, answer)

    def rate(table: pa.Table, answers: pa.Table) -> pa.Table:
        words, pair, shard, which, (_, before, at, row, _) = _pairs(table, answers, shards)
        kinds, count = np.empty((2, words.shape[1]), np.int64), np.empty((2, len(pair)), np.int64)
        kinds[:, np.argsort((unpacked(table["words"][0].as_py(), np.uint64) % np.uint64(shards)).astype(np.int64), kind="stable")] = _answer(answers, 3)[:2]
        count[:, np.argsort(shard, kind="stable")] = _answer(answers, 1)[:2]
        loss = []
        for m in (0, 1):
            base = (words[1 + m][at] + 1) / (model_tokens[m] + size)
            k = kinds[m][before]
            # Witten-Bell interpolation with the add-one unigram model; a history without bigrams has that alone.
            loss.append(-np.log(np.where(k > 0, (count[m][which] + k * base) / np.maximum(words[3 + m][before] + k, 1), base)))
        ids, known, sizes = (unpacked(table[c][0].as_py(), k) for c, k in (("ids", np.int64), ("known", np.bool_), ("sizes", np.int64)))
        mean = np.bincount(row, loss[0] - loss[1], len(sizes)) / np.maximum(sizes, 1)
        return pa.table([pa.array(ids, pa.int64(), mask=~known), pa.array(sizes, pa.int64()), pa.array(mean, pa.float64(), mask=sizes == 0)], ["doc_id", "n_words", "score"])

    back = words.unionByName(pairs.where("kind = 1")).unionByName(kinds)
    return tokens.cogroup(back.groupBy("part")).applyInArrow(rate, "doc_id long, n_words long, score double")
