"""Exact dedup: binary-fuse filters of immutable snapshots screen digests, exact buckets check the bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.shared import cut, shared_dir, text_columns
from sedimenta.llm.words import mix

#: Digests that one filter shard holds on average.
SHARD_KEYS = 500_000
#: Text that one file of a snapshot's bucket holds, about.
FILE_BYTES = 32 << 20
#: Filters of up to so many bytes go to every worker; larger ones meet the digests shard by shard.
BROADCAST_BYTES = 64 << 20


class FuseFilter:
    """Three-wise binary fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, length: int, count: int, data: np.ndarray):
        self.seed, self.length, self.count, self.data = seed, length, count, data

    @staticmethod
    def places(keys: np.ndarray, seed: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64))
        low = np.uint64(length - 1)
        first = ((h >> np.uint64(32)) * np.uint64(count * length)) >> np.uint64(32)
        second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * length)) ^ (h & low)
        print8 = ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)
        return np.stack([first, second, third]).astype(np.int64), print8

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels slots that one key uses in rounds, all such slots at once; a new seed is tried if any key is left."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        length = int(min(1 << 18, 2 ** max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, -(-int(n * factor) // length) - 2)
        for seed in range(1, 1000):
            at, print8 = cls.places(keys, seed, length, count)
            slots = (count + 2) * length
            left, key_of = np.bincount(at.ravel(), minlength=slots), np.zeros(slots, np.int64)
            for row in at:
                np.bitwise_xor.at(key_of, row, np.arange(n))
            peeled, single = [], np.flatnonzero(left == 1)
            while len(single):
                which, pick = np.unique(key_of[single], return_index=True)
                peeled.append((which, single[pick]))
                for row in at[:, which]:
                    np.subtract.at(left, row, 1)
                    np.bitwise_xor.at(key_of, row, which)
                near = np.unique(at[:, which])
                single = near[left[near] == 1]
            if sum(len(w) for w, _ in peeled) == n:
                data = np.zeros(slots, np.uint8)
                for which, slot in reversed(peeled):
                    data[slot] = print8[which] ^ np.bitwise_xor.reduce(data[at[:, which]], axis=0)
                return cls(seed, length, count, data)
        raise RuntimeError("no seed gave a filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the filter, and for about one in 256 of all others."""
        at, print8 = self.places(keys.astype(np.uint64), self.seed, self.length, self.count)
        return np.bitwise_xor.reduce(self.data[at], axis=0) == print8


FILTER = "shard long, seed int, length int, count int, data binary"


def _load(row) -> FuseFilter:
    return FuseFilter(int(row["seed"]), int(row["length"]), int(row["count"]), np.frombuffer(bytes(row["data"]), np.uint8))


def snapshot_filter(digests: DataFrame, path: str) -> int:
    """Writes the filter of an immutable snapshot's distinct digests (d long) as a table of shards; their number."""
    shards = max(1, -(-digests.count() // SHARD_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(rows["d"].to_numpy().view(np.uint64))
        return pd.DataFrame([(rows["shard"].iloc[0], made.seed, made.length, made.count, made.data.tobytes())], columns=["shard", "seed", "length", "count", "data"])

    keyed = digests.select("d", F.pmod("d", F.lit(shards)).alias("shard"))
    keyed.groupBy("shard").applyInPandas(build, FILTER).withColumn("shards", F.lit(shards)).write.parquet(path)
    return shards


@dataclass(frozen=True)
class Snapshot:
    """An immutable batch as written once: the filter of its digests, and its rows in buckets by digest.

    A later batch reads the filter, and the buckets in which the filter finds one of its digests; never the documents.
    """

    spark: SparkSession
    path: str

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTER + ", shards int").parquet(f"{self.path}/filter")

    @property
    def buckets(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, text string, d long, bucket long").parquet(f"{self.path}/buckets")

    @property
    def shards(self) -> int:
        return self.filters.agg(F.max("shards")).first()[0] or 1


def _digested(docs: DataFrame, digest: Callable[[str], Column]) -> DataFrame:
    return text_columns(docs, "doc_id", "text").where("text is not null").withColumn("d", digest("text"))


def write_snapshot(docs: DataFrame, path: str, digest: Callable[[str], Column] = F.xxhash64) -> Snapshot:
    """Writes the filter and the buckets of docs below path.

    A bucket is a shard's digests in files of about FILE_BYTES of text, over which the copies of a text are spread as well.
    """
    rows = _digested(docs, digest)
    shards = snapshot_filter(rows.select("d").distinct(), f"{path}/filter")
    keyed = rows.withColumn("bucket", F.pmod("d", F.lit(shards)).cast("long"))
    # One small row for each shard, of which there is one for SHARD_KEYS digests.
    files = keyed.groupBy("bucket").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / F.lit(FILE_BYTES)).alias("files"))
    spread = keyed.join(F.broadcast(files), "bucket").withColumn("file", F.pmod(F.xxhash64("doc_id", "d"), "files"))
    spread = spread.repartition("bucket", "file").sortWithinPartitions("bucket", "d").select("doc_id", "text", "d", "bucket")
    spread.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/buckets")
    return Snapshot(docs.sparkSession, path)


def screen(digests: DataFrame, filters: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The digests (d long) that a snapshot's filter lets pass."""
    size = filters.agg(F.sum(F.length("data"))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = digests.sparkSession.sparkContext.broadcast([r.asDict() for r in filters.collect()])

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {r["shard"]: _load(r) for r in sent.value}
            for batch in batches:
                d = batch.column("d").to_numpy()
                hit, shard = np.zeros(len(d), bool), d % shards
                for s, f in loaded.items():
                    own = shard == s
                    hit[own] = f.contains(d[own].view(np.uint64))
                yield batch.filter(pa.array(hit))

        return digests.select("d").mapInArrow(test, "d long")

    def meet(key, own: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        hit = _load(shard.iloc[0]).contains(own["d"].to_numpy().view(np.uint64)) if len(shard) and len(own) else np.zeros(len(own), bool)
        return own.loc[hit, ["d"]]

    keyed = digests.select("d", F.pmod("d", F.lit(shards)).alias("shard"))
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(meet, "d long")


def screen_batch(batch: DataFrame, snapshots: list[Snapshot], broadcast_bytes: int = BROADCAST_BYTES, digest: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, keep) for every row of a new batch; keep_id is of the earliest snapshot that has the text.

    Digests that a snapshot's filter lets pass meet its buckets, where the bytes are compared; those that the batch
    has several times are grouped within it. See exact_duplicates for the cases.
    """
    part = len(snapshots)
    rows = _digested(batch, digest)
    digests = cut(rows.groupBy("d", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")
    own = digests.groupBy("d").agg(F.sum("n").alias("n"))
    suspects, old = [own.where("n > 1").select("d")], []
    rank = lambda k: F.struct(F.lit(k).alias("part"), F.col("doc_id").isNull().alias("none"), "doc_id")
    for k, snapshot in enumerate(snapshots):
        shards = snapshot.shards
        passed = cut(screen(own, snapshot.filters, shards, broadcast_bytes), "passed")
        hit = [r[0] for r in passed.select(F.pmod("d", F.lit(shards)).cast("long")).distinct().collect()]
        if hit:
            buckets = snapshot.buckets if len(hit) == shards else snapshot.buckets.where(F.col("bucket").isin(hit))
            old.append(buckets.join(passed, "d", "left_semi").select("d", "text", rank(k).alias("best")))
            suspects.append(passed)
    wanted = cut(reduce(DataFrame.union, suspects).distinct(), "suspects")
    # One row for each text of a suspect digest; equal texts are combined before the shuffle, so copies cost little.
    texts = rows.join(wanted, "d", "left_semi").select("d", "text", rank(part).alias("best"), F.lit(True).alias("new"))
    if old:
        texts = texts.unionByName(reduce(DataFrame.unionByName, old).withColumn("new", F.lit(False)))
    texts = texts.groupBy("d", "text").agg(F.min("best").alias("best"), F.max("new").alias("new")).where("new").drop("new")
    texts = cut(texts, "texts")
    several = cut(texts.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d"), "collisions")
    collide = several.limit(1).count() > 0
    plain = texts.select("d", "best")
    if collide:
        # Digests that different texts share: their rows are told apart by the text itself.
        apart = rows.join(several, "d", "left_semi").groupBy("d", "text", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        apart = apart.join(texts, ["d", "text"]).select("doc_id", "n", "best")
        plain, digests = plain.join(several, "d", "left_anti"), digests.join(several, "d", "left_anti")
    member = digests.join(plain, "d", "left").select("doc_id", "n", "best")
    if collide:
        member = member.unionByName(apart)
    first = F.col("best").isNull() | (F.col("best.part") == part) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    keep_id = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    each = member.select("doc_id", keep_id.alias("keep_id"), first.alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    none = text_columns(batch, "doc_id", "text").where("text is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(True).alias("keep"))
    return each.select("doc_id", "keep_id", (F.col("first") & (F.col("nth") == 1)).alias("keep")).unionByName(none)


def exact_duplicates(parts: list[DataFrame], broadcast_bytes: int = BROADCAST_BYTES, digest: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, keep) for every row of all parts: the row that stays for its text, and whether it is this one.

    The parts are batches in the order in which they came. Each is screened against the snapshots of those before it
    and, unless it is the last, becomes a snapshot itself, written once. Of equal texts the one in the earliest part
    stays, in it the one of the least doc_id, a NULL doc_id being greater than all; of rows that repeat doc_id and text
    in it, one stays. Equal means equal bytes. A NULL text equals nothing, an empty text every empty text. Empty parts
    and an empty table are fine.
    """
    decided, snapshots = [], []
    for i, part in enumerate(parts):
        decided.append(screen_batch(part, snapshots, broadcast_bytes, digest))
        if i < len(parts) - 1:
            snapshots.append(write_snapshot(part, f"{shared_dir(part.sparkSession)}/snapshot-{uuid.uuid4().hex}", digest))
    return reduce(DataFrame.unionByName, decided)
