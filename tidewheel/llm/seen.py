"""Has this key been seen before? Blocked Bloom filters, one a hash partition, queried and then fed in arrival order.

1. Within each Arrow batch only the first row of a key goes on; a later one has certainly been seen. A key that holds a
   third of all rows thus sends one row a batch.
2. Rows are partitioned by a 64-bit hash of their key and sorted by arrival; only the hash travels. There are as many
   partitions as it takes for ``keys_per_filter`` rows each, so a filter has a fixed size at any scale; one that fills up all
   the same is followed by another.
3. Each batch queries the filters, then is inserted. That is the answer: a negative one is certain, a positive one is wrong
   at the rate that the filters are sized for.
4. :func:`rates` reports that rate: by keys known to be absent, which each partition asks for at its end, and by an exact
   check of all answers, which needs the keys themselves and is no part of the answer.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The odd multipliers of Apache Parquet's split block filters; each chooses a bit in one of the eight words.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
_LANES = np.arange(8)
#: Wrong positive answers among new keys that the filters are sized for.
RATE = 1e-5


@cache
def keys_per_block(rate: float) -> float:
    """Mean keys a block at which a key that is absent is found at ``rate``: blocks fill as a Poisson variable says, and a
    block of i keys says yes with probability (1 - (31/32)^i)^8."""

    def wrong(mean: float) -> float:
        most = int(mean + 12 * math.sqrt(mean) + 30)
        return sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) * (1 - (31 / 32) ** i) ** 8 for i in range(most))

    low, high = 1e-3, 256.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if wrong(mid) <= rate else (low, mid)
    return low


class BlockedBloom:
    """A filter of blocks of eight 32-bit words, for ``capacity`` keys at ``rate`` false positives; keys are 64-bit hashes."""

    def __init__(self, capacity: int, rate: float):
        self.blocks = max(1, math.ceil(max(1, capacity) / keys_per_block(rate)))
        self.words = np.zeros((self.blocks, 8), np.uint32)
        self.capacity, self.count = capacity, 0

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return block, np.uint32(1) << ((low[:, None] * SALTS[None, :]) >> np.uint32(27))

    def query(self, h: np.ndarray) -> np.ndarray:
        block, mask = self._places(h)
        return ((self.words[block] & mask) == mask).all(axis=1)

    def insert(self, h: np.ndarray) -> None:
        block, mask = self._places(h)
        np.bitwise_or.at(self.words, (block[:, None], _LANES[None, :]), mask)
        self.count += len(h)


class Filters:
    """Filters in a row: when the last has its fill, another is begun, for half the remaining rate."""

    def __init__(self, capacity: int, rate: float):
        self.capacity, self.rate = capacity, rate
        self.all = [BlockedBloom(capacity, rate / 2)]

    def query(self, h: np.ndarray) -> np.ndarray:
        hit = self.all[0].query(h)
        for f in self.all[1:]:
            hit |= f.query(h)
        return hit

    def insert(self, h: np.ndarray) -> None:
        if self.all[-1].count + len(h) > self.capacity and self.all[-1].count:
            self.all.append(BlockedBloom(self.capacity, self.rate / 2 ** (len(self.all) + 1)))
        self.all[-1].insert(h)

    def query_then_insert(self, h: np.ndarray) -> np.ndarray:
        """Of hashes in order: whether each was there before it, earlier ones of the batch included."""
        _, first = np.unique(h, return_index=True)
        seen = np.ones(len(h), bool)
        fresh = h[first]
        hit = self.query(fresh)
        seen[first] = hit
        self.insert(fresh[~hit])
        return seen


def _first_of_batch(stream: int):
    def work(batches):
        for b in batches:
            seq, key, rank = (b.column(i) for i in range(3))
            codes = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.argsort(seq.to_numpy(zero_copy_only=False), kind="stable")
            _, at = np.unique(codes[order], return_index=True)
            first = np.zeros(len(b), bool)
            first[order[at]] = True
            keep = first | (rank.to_numpy(zero_copy_only=False) == stream)
            sure = pa.array(~first)
            out = pa.RecordBatch.from_arrays([seq, pc.if_else(sure, pa.scalar(None, pa.string()), key), rank, sure], names=["seq", "key", "rank", "sure"])
            yield out.filter(pa.array(keep))

    return work


_ASKED = "seq long, rank int, h long, maybe boolean, probes long, hits long"


def _ranked(earlier: list[DataFrame], stream: DataFrame) -> DataFrame:
    rows = None
    for i, df in enumerate([*earlier, stream]):
        part = df.where(F.col("key").isNotNull()).select(F.col("seq").cast("long"), F.col("key").cast("string"), F.lit(i).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def answers(earlier: list[DataFrame], stream: DataFrame, rate: float = RATE, keys_per_filter: int = 500_000, probes: int = 0) -> DataFrame:
    """(seq, rank, h, maybe, probes, hits): for each row of ``stream`` with a key, whether the filters say that it was seen.

    ``earlier`` and ``stream``: columns ``seq`` and ``key``; the tables of ``earlier`` come first, in order, then the
    stream by ``seq`` (unique there). Null keys give no row; the empty text is a key; keys of any length are hashed whole.
    ``probes``: keys known to be absent that each partition asks for at its end, given as one row of rank -1.
    """
    last = len(earlier)
    rows = _ranked(earlier, stream)
    total = max(1, rows.count())
    filters = max(1, math.ceil(total / keys_per_filter), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / 50_000)))
    capacity = max(1000, math.ceil(1.2 * total / filters))
    local = rows.mapInArrow(_first_of_batch(last), "seq long, key string, rank int, sure boolean")
    # rows that are sure need no filter and stay where they are
    sure = local.where("sure").select("seq", "rank", F.lit(None).cast("long").alias("h"), F.lit(True).alias("maybe"), F.lit(None).cast("long").alias("probes"), F.lit(None).cast("long").alias("hits"))
    spread = local.where("not sure").select("seq", "rank", F.xxhash64("key").alias("h")).repartition(filters, "h").sortWithinPartitions("rank", "seq")

    def ask(batches):
        known = Filters(capacity, rate)
        for b in batches:
            h = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            said = known.query_then_insert(h)
            ours = np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False) == last)
            none = pa.nulls(len(ours), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(ours)) for i in range(3)), pa.array(said[ours]), none, none], names=["seq", "rank", "h", "maybe", "probes", "hits"])
        if probes:
            p = TaskContext.get().partitionId()
            absent = np.array([xxhash.xxh64_intdigest(f"\x00absent {p} {i}", 42) for i in range(probes)], np.uint64)
            one = lambda v, t: pa.array([v], t)
            yield pa.RecordBatch.from_arrays(
                [one(-1 - p, pa.int64()), one(-1, pa.int32()), one(None, pa.int64()), one(False, pa.bool_()), one(probes, pa.int64()), one(int(known.query(absent).sum()), pa.int64())],
                names=["seq", "rank", "h", "maybe", "probes", "hits"],
            )

    return spread.mapInArrow(ask, _ASKED).unionByName(sure)


def exact(earlier: list[DataFrame], stream: DataFrame) -> DataFrame:
    """(seq, seen): the right answer for each row of ``stream`` with a key, by the keys' bytes.

    The first arrival of each key is found by a grouping that combines before it exchanges, and joined to the rows; adaptive
    execution splits a hot key's part of the join.
    """
    rows = _ranked(earlier, stream)
    first = rows.groupBy("key").agg(F.min(F.struct("rank", "seq")).alias("first"))
    ours = rows.where(F.col("rank") == len(earlier))
    return ours.join(first, "key").select("seq", (F.struct("rank", "seq") > F.col("first")).alias("seen"))


def rates(earlier: list[DataFrame], stream: DataFrame, rate: float = RATE, probes: int = 100_000, **options) -> DataFrame:
    """One row: what the filters answered, how much of it was wrong by the exact check, and the rate by absent keys.

    ``probes`` absent keys are asked of each partition's filters. Shares of nothing are 0.
    """
    asked = answers(earlier, stream, rate, probes=probes, **options)
    told = asked.where(F.col("rank") >= 0).join(exact(earlier, stream), "seq", "full")
    wrong = F.count_if(F.coalesce(F.col("maybe"), F.lit(False)) & ~F.col("seen"))
    missed = F.count_if(F.col("seen") & ~F.coalesce(F.col("maybe"), F.lit(False)))
    counted = told.agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("maybe")).alias("said_yes"), wrong.alias("wrong_yes"), missed.alias("wrong_no"),
        (wrong / F.greatest(F.count_if(~F.col("seen")), F.lit(1))).alias("wrong_share_of_new"), ((wrong + missed) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("wrong_share"),
    )
    absent = asked.where(F.col("rank") < 0).agg(F.coalesce(F.sum("probes"), F.lit(0)).alias("absent_asked"), F.coalesce(F.sum("hits") / F.sum("probes"), F.lit(0.0)).alias("absent_rate"))
    both = counted.unionByName(absent, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("target_rate", F.lit(rate))
