"""Token-ID output: interleaved static range asymmetric numeral coding under one shared frequency table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.pretokens import TOKENIZERS, VOCABULARY, worker_tokenizer
from sedimenta.llm.shared import cut, text_columns
from sedimenta.llm.words import slices

#: Id that ends each document; free in the rank files.
END = 50256
SYMBOLS = 50257
SCALE_BITS = 20
LANES = 32
BLOCK_TOKENS = 1 << 16
CHECKPOINT_STEPS = 256
#: Blocks that are coded side by side, which widens the numpy operations.
TOGETHER = 32
_LOW = np.uint64(1 << 31)

SCHEMA = (
    "block_id long, n_tokens int, doc_ids array<long>, doc_starts array<int>, doc_offsets array<long>, payload binary, "
    "checkpoints binary, payload_crc long, tokens_crc long, table_crc long"
)


def quantise(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits, at least 1 for every symbol that occurs."""
    counts = np.asarray(counts, np.float64)
    total, seen = counts.sum(), counts > 0
    if total == 0:
        raise ValueError("no symbol occurs")
    freq = np.where(seen, np.maximum(1, np.floor(counts * 2.0**bits / total)), 0).astype(np.int64)
    rest = (1 << bits) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        take = min(-rest, int(freq[i]) - 1)
        freq[i] -= take
        rest += take
    return freq.astype(np.uint32)


def encode_blocks(tokens: np.ndarray, freq: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(payload, checkpoints) of each row of an array (blocks, tokens); the number of tokens is a multiple of LANES.

    Token i of a block belongs to lane i mod LANES. A payload is the lanes' 32-bit words in the order the decoder
    wants them. A checkpoint, one for every CHECKPOINT_STEPS steps from 0 on, is the lanes' states before the step
    and the place in the payload, so decoding can begin at any of them.
    """
    blocks, n = tokens.shape
    steps = n // LANES
    symbol = np.ascontiguousarray(tokens.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, blocks * LANES)
    f64 = freq.astype(np.uint64)
    start = np.cumsum(f64) - f64
    x = np.full(blocks * LANES, _LOW, np.uint64)
    word, used = np.empty((steps, blocks * LANES), np.uint32), np.empty((steps, blocks * LANES), bool)
    states = []
    shift, scale = np.uint64(32), np.uint64(SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        f = f64[symbol[t]]
        full = x >= f << np.uint64(63 - SCALE_BITS)
        word[t], used[t] = x, full
        x = np.where(full, x >> shift, x)
        q = x // f
        x = (q << scale) + (x - q * f) + start[symbol[t]]
        if t % CHECKPOINT_STEPS == 0:
            states.append(x)
    states.reverse()
    out = []
    for b in range(blocks):
        own = slice(b * LANES, (b + 1) * LANES)
        mask = used[:, own]
        place = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])[:steps:CHECKPOINT_STEPS].astype("<u8")
        marks = np.concatenate([np.stack([s[own] for s in states]), place[:, None]], axis=1).astype("<u8")
        out.append((word[:, own][mask].astype("<u4").tobytes(), marks.tobytes()))
    return out


def decode_block(payload: bytes, checkpoints: bytes, n_tokens: int, freq: np.ndarray) -> np.ndarray:
    """Tokens of a block: all stretches between its checkpoints are decoded side by side."""
    words = np.append(np.frombuffer(payload, "<u4"), np.zeros(LANES, "<u4")).astype(np.uint64)
    marks = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)
    f64 = freq.astype(np.uint64)
    start = np.cumsum(f64) - f64
    symbol_at = np.repeat(np.arange(len(freq)), freq)
    x, place = marks[:, :LANES].copy(), marks[:, LANES].astype(np.int64)
    steps = -(-n_tokens // LANES)
    out = np.zeros((len(marks), CHECKPOINT_STEPS, LANES), np.uint16)
    low = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(min(steps, CHECKPOINT_STEPS)):
        slot = x & low
        s = symbol_at[slot.astype(np.int64)]
        out[:, t] = s
        x = f64[s] * (x >> np.uint64(SCALE_BITS)) + slot - start[s]
        need = x < _LOW
        at = np.minimum(place[:, None] + np.cumsum(need, axis=1) - need, len(words) - 1)
        x = np.where(need, (x << np.uint64(32)) | words[at], x)
        place = place + need.sum(axis=1)
    return out.reshape(-1)[:n_tokens]


def tokenised(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) with the ids of each text as 16-bit little-endian integers, END last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(folder, vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = tokenizer.encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], END).astype("<u2")
                ends = (offsets + np.arange(len(offsets))) * 2
                binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary], ["doc_id", "tokens"])

    return text_columns(docs, "doc_id", "text").mapInArrow(encode, "doc_id long, tokens binary")


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u2"), (offsets - offsets[0]) // 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_binary(batch.column("tokens"))[0], minlength=SYMBOLS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["token", "n"])


def frequency_table(tokens: DataFrame) -> np.ndarray | None:
    """Quantised frequencies over the whole token table, None if it has no row; it has one entry per id."""
    rows = tokens.select("tokens").mapInArrow(_count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS)
    for row in rows:
        counts[row["token"]] = row["n"]
    return quantise(counts) if rows else None


def encode(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Coded blocks of the tokens of all rows of docs, and one row, of block_id -1, whose payload is the frequency table.

    doc_ids, doc_starts and doc_offsets of a block say which documents are in it, from which of its tokens on and
    from which token of the document; a document longer than the rest of a block goes on in the next one. A NULL
    text is coded as an empty one, of END alone; a NULL doc_id stays NULL; repeated rows are coded each. An empty
    table gives no row at all. payload_crc and tokens_crc are CRC-32 of the payload and of the 16-bit tokens,
    table_crc that of the frequency table.
    """
    spark = docs.sparkSession
    tokens = cut(tokenised(docs, folder, vocabulary), "tokens")
    freq = frequency_table(tokens)
    if freq is None:
        return spark.createDataFrame([], SCHEMA)
    table = freq.astype("<u4").tobytes()
    table_crc = zlib.crc32(table)
    sent = spark.sparkContext.broadcast(freq)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        starts = np.zeros(0, np.int64)
        pending, base = [], 0  # tokens not yet coded, and the place of the first of them in the partition
        held = 0

        def blocks(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, ids, starts, pending, base, held
            stream = np.concatenate(pending) if pending else np.zeros(0, "<u2")
            done = 0
            while held - done >= BLOCK_TOKENS or final and held > done:
                n = min(BLOCK_TOKENS, held - done)
                count = max(1, min(TOGETHER, (held - done) // BLOCK_TOKENS))
                part = stream[done : done + n * count]
                padded = np.concatenate([part, np.full(-n % LANES, END, "<u2")]) if n < BLOCK_TOKENS else part
                rows = []
                for i, (payload, marks) in enumerate(encode_blocks(padded.reshape(count, -1), sent.value)):
                    lo = base + done + i * n
                    first = int(np.searchsorted(starts, lo, "right")) - 1
                    last = int(np.searchsorted(starts, lo + n, "left"))
                    at = starts[first:last]
                    rows.append({
                        "block_id": number, "n_tokens": n, "doc_ids": ids[first:last], "doc_starts": np.maximum(at - lo, 0).tolist(),
                        "doc_offsets": np.maximum(lo - at, 0).tolist(), "payload": payload, "checkpoints": marks, "payload_crc": zlib.crc32(payload),
                        "tokens_crc": zlib.crc32(part[i * n : (i + 1) * n].tobytes()), "table_crc": table_crc,
                    })
                    number += 1
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                done += n * count
            pending, held, base = [stream[done:]], held - done, base + done
            keep = max(0, int(np.searchsorted(starts, base, "right")) - 1)
            ids, starts = ids[keep:], starts[keep:]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat, offsets = _binary(batch.column("tokens"))
            starts = np.concatenate([starts, base + held + offsets[:-1]])
            ids += batch.column("doc_id").to_pylist()
            pending.append(flat)
            held += len(flat)
            if held >= TOGETHER * BLOCK_TOKENS:
                yield from blocks(False)
        yield from blocks(True)

    header = spark.createDataFrame([(-1, 0, [], [], [], bytearray(table), bytearray(), table_crc, zlib.crc32(b""), table_crc)], SCHEMA)
    return tokens.mapInArrow(code, SCHEMA).unionByName(header)


ARROW = pa.schema([
    ("block_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())),
    ("doc_offsets", pa.list_(pa.int64())), ("payload", pa.binary()), ("checkpoints", pa.binary()), ("payload_crc", pa.int64()),
    ("tokens_crc", pa.int64()), ("table_crc", pa.int64()),
])


def decode(blocks: DataFrame) -> DataFrame:
    """(block_id, doc_ids, doc_starts, doc_offsets, tokens) of coded blocks; a checksum that fails is an error.

    Blocks are decoded independently of one another, each from all its checkpoints at once.
    """
    header = blocks.where("block_id = -1").select("payload").first()
    out = "block_id long, doc_ids array<long>, doc_starts array<int>, doc_offsets array<long>, tokens array<int>"
    if header is None:
        return blocks.sparkSession.createDataFrame([], out)
    sent = blocks.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(header["payload"]), "<u4"))

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["payload_crc"] or zlib.crc32(sent.value.tobytes()) != r["table_crc"]:
                    raise ValueError(f"block {r['block_id']}: payload or table is damaged")
                tokens = decode_block(r["payload"], r["checkpoints"], r["n_tokens"], sent.value)
                if zlib.crc32(tokens.astype("<u2").tobytes()) != r["tokens_crc"]:
                    raise ValueError(f"block {r['block_id']}: tokens don't match their checksum")
                rows.append({k: r[k] for k in ("block_id", "doc_ids", "doc_starts", "doc_offsets")} | {"tokens": tokens.tolist()})
            fields = [*ARROW][:1] + [*ARROW][2:5] + [pa.field("tokens", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return blocks.where("block_id >= 0").mapInArrow(undo, out)
