"""Cuckoo filters over digests, an exact index that they guard, and a stored, sharded index that takes insertions and
deletions. Everything works on batches: keys are rows of 64-bit words (a digest's bytes, so words are spread evenly)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh_path, rows, shuffle_partitions

SLOTS, KICKS, LOAD, BLOCKS = 4, 200, 0.8, 6
#: Keys that a shard is meant to hold.
SHARD_KEYS = 200_000


def words_of_keys(keys: pa.Array, width: int) -> np.ndarray:
    """Binary keys of `width` bytes (a multiple of 8) as rows of words."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, width // 8)


def bytes_of_words(words: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(words)]


def shard_count(keys: int, spark: SparkSession) -> int:
    """Shards for so many keys, so that a shard's size does not grow with the table."""
    return max(shuffle_partitions(spark), -(-keys // SHARD_KEYS))


class CuckooFilter:
    """16-bit fingerprints in buckets of four. `insert` gives the keys that found no place: the table is full, and its owner
    makes a larger one from the stored keys. `remove` must only be given keys that were inserted."""

    def __init__(self, capacity: int = 1024, table: bytes | None = None):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1.0, capacity / (LOAD * SLOTS))))))
        self.slots = np.zeros((self.buckets, SLOTS), np.uint16)
        if table is not None:
            self.slots = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
            self.buckets = len(self.slots)

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(words[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        first = (words[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(mark, first)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype(np.int64) * 0x5BD1E995 & (self.buckets - 1))

    def contains(self, words: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(words)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def _change(self, mark: np.ndarray, target: np.ndarray, left: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Turns a slot of each key's target bucket from old to new, one key of a bucket at a time; keys without such a slot."""
        open_, without = left, []
        while len(open_):
            own = open_[np.unique(target[open_], return_index=True)[1]]
            match = self.slots[target[own]] == old[own, None]
            some = match.any(1)
            self.slots[target[own[some]], match[some].argmax(1)] = new[own[some]]
            without.append(own[~some])
            open_ = np.setdiff1d(open_, own, assume_unique=True)
        return np.sort(np.concatenate(without)) if without else left

    def insert(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the keys that found no place: those from the first on for which moving others was of no use."""
        mark, a, b = self._places(words)
        none = np.zeros_like(mark)
        left = self._change(mark, a, np.arange(len(words)), none, mark)
        left = self._change(mark, b, left, none, mark)
        for n, k in enumerate(left):
            if not self._kick(mark[k], int(b[k])):
                return left[n:]
        return left[:0]

    def _kick(self, mark: np.uint16, at: int) -> bool:
        """Moves others from bucket to bucket until one has room; all go back if none has."""
        moved = []
        for kick in range(KICKS):
            slot = kick % SLOTS
            moved.append((at, slot, self.slots[at, slot]))
            mark, self.slots[at, slot] = self.slots[at, slot], mark
            at ^= int(mark) * 0x5BD1E995 & (self.buckets - 1)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        for bucket, slot, old in reversed(moved):
            self.slots[bucket, slot] = old
        return False

    def remove(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the keys that were not found."""
        mark, a, b = self._places(words)
        none = np.zeros_like(mark)
        left = self._change(mark, a, np.arange(len(words)), mark, none)
        return self._change(mark, b, left, mark, none)

    def __len__(self) -> int:
        return int((self.slots > 0).sum())


def filter_of(words: np.ndarray, capacity: int = 0) -> CuckooFilter:
    """A filter that holds all the keys, twice as large again until they have room."""
    size = max(capacity, len(words), 16)
    while True:
        made = CuckooFilter(size)
        if not len(made.insert(words)):
            return made
        size *= 2


def grouped(words: np.ndarray, columns: list[np.ndarray], merges: list[np.ufunc]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, with the columns of equal keys merged."""
    order = np.lexsort(words.T[::-1])
    words = words[order]
    start = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(1)])) if len(words) else np.zeros(0, np.int64)
    return words[start], [m.reduceat(c[order], start) if len(start) else c for m, c in zip(merges, columns, strict=True)]


class CuckooIndex:
    """Keys with merged columns behind a cuckoo filter. A miss of the filter is final: the key is new. A hit is verified
    against the stored keys, which lie in blocks sorted by key. A full filter is made anew, twice as large, from them."""

    def __init__(self, merges: list[np.ufunc], capacity: int = 1024):
        self.merges, self.filter, self.blocks, self.resized, self.count = merges, CuckooFilter(capacity), [], 0, 0

    @staticmethod
    def _find(block: tuple, words: np.ndarray) -> np.ndarray:
        """Row of each key in a block, or -1. Keys that share the first word lie side by side."""
        keys, at = block[0], np.searchsorted(block[0][:, 0], words[:, 0])
        out, open_ = np.full(len(words), -1), np.arange(len(words))
        while len(open_):
            open_ = open_[at[open_] < len(keys)]
            open_ = open_[keys[at[open_], 0] == words[open_, 0]]
            equal = (keys[at[open_]] == words[open_]).all(1)
            out[open_[equal]] = at[open_[equal]]
            open_ = open_[~equal]
            at[open_] += 1
        return out

    def get(self, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is held, and its columns (0 where it is not)."""
        held, columns = np.zeros(len(words), bool), [np.zeros(len(words), np.int64) for _ in self.merges]
        hits = np.flatnonzero(self.filter.contains(words))
        for block in self.blocks:
            row = self._find(block, words[hits])
            own = hits[row >= 0]
            held[own] = True
            for c, stored in zip(columns, block[1], strict=True):
                c[own] = stored[row[row >= 0]]
        return held, columns

    def put(self, words: np.ndarray, columns: list[np.ndarray]) -> None:
        words, columns = grouped(words, columns, self.merges)
        new = ~self.filter.contains(words)
        hits = np.flatnonzero(~new)
        for block in self.blocks:
            row = self._find(block, words[hits])
            own, row = hits[row >= 0], row[row >= 0]
            for stored, c, m in zip(block[1], columns, self.merges, strict=True):
                stored[row] = m(stored[row], c[own])
            hits = np.setdiff1d(hits, own, assume_unique=True)
        new[hits] = True  # the filter's false positives
        if new.any():
            self.blocks.append((words[new], [c[new] for c in columns]))
            self.count += int(new.sum())
            if len(self.blocks) > BLOCKS:
                merged = grouped(np.concatenate([b[0] for b in self.blocks]), [np.concatenate(c) for c in zip(*(b[1] for b in self.blocks), strict=True)], self.merges)
                self.blocks = [merged]
            if self.count > LOAD * self.filter.slots.size or len(self.filter.insert(words[new])):
                self.resized += 1
                self.filter = filter_of(np.concatenate([b[0] for b in self.blocks]), 2 * self.count)

    def delete(self, words: np.ndarray) -> np.ndarray:
        """Takes out the keys that are held; says which those were."""
        gone, _ = self.get(words)
        for k, block in enumerate(self.blocks):
            row = self._find(block, words[gone])
            keep = np.ones(len(block[0]), bool)
            keep[row[row >= 0]] = False
            self.blocks[k] = (block[0][keep], [c[keep] for c in block[1]])
        self.filter.remove(np.unique(words[gone], axis=0))
        self.count = sum(len(b[0]) for b in self.blocks)
        return gone

    def drain(self):
        """(keys, columns) of all that is held, in parts."""
        for words, columns in self.blocks:
            for k in range(0, len(words), 50_000):
                yield words[k : k + 50_000], [c[k : k + 50_000] for c in columns]


class ShardedIndex:
    """Postings (key, doc_id) in a stored log, and beside it a cuckoo filter per shard of the keys that are live.

    Each change appends signed postings to the folders of the shards it hits and writes these shards' filters anew; other
    shards are neither read nor written. A lookup passes the filters first; only what they let through is verified against
    the live postings of its shards. A folder per change is written whole or not at all, and counts once it is noted."""

    def __init__(self, spark: SparkSession, width: int, path: str | None = None, shards: int = 64):
        self.spark, self.width, self.shards, self.path, self.version = spark, width, shards, path or fresh_path(spark, "cuckoo"), 0
        self.filters: dict[int, int] = {}  # shard -> the change that wrote its filter
        self.written: dict[int, list[int]] = {}  # shard -> the changes that wrote postings
        self.places: dict[int, str] = {}  # change -> where its filters are

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _log(self, shards: list[int]) -> DataFrame:
        """Signed postings of the shards."""
        paths = [f"{self.path}/log/v{v}/shard={s}" for s in shards for v in self.written.get(s, [])]
        empty = self.spark.createDataFrame([], "key binary, doc_id long, sign int")
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def live(self, shards: list[int] | None = None) -> DataFrame:
        """(key, doc_id) that are live, each once."""
        return self._log(sorted(self.written) if shards is None else shards).groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0").select("key", "doc_id")

    def change(self, postings: DataFrame, sign: int) -> list[int]:
        """Inserts (sign 1) or deletes (-1) postings; gives the shards that were touched. A posting that is live is not
        inserted again, one that is not is not deleted."""
        asked = postings.select("key", "doc_id").distinct().withColumn("shard", self._shard())
        touched = sorted(r.shard for r in asked.select("shard").distinct().collect())
        before = self.live(touched).withColumn("was", F.lit(True))
        asked = asked.join(before, ["key", "doc_id"], "left").filter(F.col("was").isNull() if sign > 0 else F.col("was").isNotNull()).drop("was")
        self.version += 1
        log = f"{self.path}/log/v{self.version}"
        asked.withColumn("sign", F.lit(sign)).write.partitionBy("shard").parquet(log)
        new = self.spark.read.schema("key binary, doc_id long, sign int, shard int").parquet(log)
        shards = sorted(r.shard for r in new.select("shard").distinct().collect())
        # keys that come to life, or whose last posting goes
        n_new = new.groupBy("shard", "key").agg(F.sum("sign").alias("d"))
        n_old = before.groupBy("key").agg(F.count("*").alias("o"))
        moved = n_new.join(n_old, "key", "left").withColumn("o", F.coalesce("o", F.lit(0))).filter((F.col("o") == 0) | (F.col("o") + F.col("d") == 0)).select("shard", "key")
        self._refilter(moved, sign, shards)
        self.written |= {s: [*self.written.get(s, []), self.version] for s in shards}
        self.filters |= {s: self.version for s in shards}
        return shards

    def _refilter(self, moved: DataFrame, sign: int, shards: list[int]) -> None:
        """The shards' filters with the moved keys put in or taken out; one that overflows is made anew from its live keys."""
        width, fields = self.width, [("shard", pa.int32()), ("table", pa.binary()), ("full", pa.bool_())]
        schema = pa.schema(fields)

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            words = words_of_keys(left["key"], width) if left.num_rows else np.zeros((0, width // 8), np.uint64)
            own = CuckooFilter(table=right["table"][0].as_py()) if right.num_rows else filter_of(words[:0], max(16, len(words)))
            full = bool(len(own.insert(words))) if sign > 0 else bool(len(own.remove(words)))
            return pa.Table.from_batches([rows({"shard": [key[0].as_py()], "table": [own.slots.tobytes()], "full": [full]}, schema)])

        ddl = "shard int, table binary, full boolean"
        made = moved.groupBy("shard").cogroup(self._tables(shards).groupBy("shard")).applyInArrow(lambda k, l, r: run(k, l, r), ddl)  # noqa: E741
        at = f"{self.path}/filters/v{self.version}"
        made.write.parquet(at)
        full = [r.shard for r in self.spark.read.schema(ddl).parquet(at).filter("full").select("shard").collect()]
        if full:

            def anew(key: tuple, own: pa.Table) -> pa.Table:
                words = words_of_keys(own["key"], width)
                return pa.Table.from_batches([rows({"shard": [key[0].as_py()], "table": [filter_of(words, 2 * len(words)).slots.tobytes()], "full": [False]}, schema)])

            log = self.spark.read.schema("key binary, doc_id long, sign int, shard int").parquet(f"{self.path}/log/v{self.version}").filter(F.col("shard").isin(full)).select("key", "doc_id", "sign")
            keys = self._log(full).unionByName(log).groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0").select("key").distinct().withColumn("shard", self._shard())
            keys.groupBy("shard").applyInArrow(anew, ddl).write.parquet(f"{at}-anew")
            rest = self.spark.read.schema(ddl).parquet(at).filter(~F.col("shard").isin(full))
            rest.unionByName(self.spark.read.schema(ddl).parquet(f"{at}-anew")).write.parquet(f"{at}-whole")
        self.places[self.version] = f"{at}-whole" if full else at

    def _tables(self, shards: list[int] | None = None) -> DataFrame:
        """The current filters of the shards."""
        ddl, out = "shard int, table binary", self.spark.createDataFrame([], "shard int, table binary")
        own = {s: v for s, v in self.filters.items() if shards is None or s in shards}
        for v in sorted(set(own.values())):
            out = out.unionByName(self.spark.read.schema(ddl).parquet(self.places[v]).filter(F.col("shard").isin([s for s in own if own[s] == v])))
        return out

    def passing(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key, ...) that the filters let through: all that are live, and few others."""
        width, names = self.width, keys.columns
        asked = keys.withColumn("shard", self._shard())

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            hit = CuckooFilter(table=right["table"][0].as_py()).contains(words_of_keys(left["key"], width)) if left.num_rows and right.num_rows else np.zeros(left.num_rows, bool)
            return left.select(names).filter(pa.array(hit))

        return asked.groupBy("shard").cogroup(self._tables().groupBy("shard")).applyInArrow(lambda l, r: run(l, r), keys.schema)  # noqa: E741

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, refs, first_id, last_id of the distinct keys that are live."""
        hits = self.passing(keys.select("key").distinct()).withColumn("shard", self._shard())
        shards = [r.shard for r in hits.select("shard").distinct().collect()]
        held = self.live([s for s in shards if s in self.written]).join(hits.select("key"), "key", "left_semi")
        return held.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def through_index(fields: list[tuple], width: int, merges: list[np.ufunc], flush_at: int | None, keep: Callable | None = None):
    """For mapInArrow: rows (key, columns) merged by key through an index; drained whenever it holds flush_at keys."""
    schema = pa.schema(fields)

    def drained(index: CuckooIndex):
        for words, columns in index.drain():
            some = np.arange(len(words)) if keep is None else np.flatnonzero(keep(*columns))
            if len(some):
                yield rows({schema.names[0]: bytes_of_words(words[some])} | {n: c[some] for n, c in zip(schema.names[1:], columns, strict=True)}, schema)

    def run(batches):
        index = CuckooIndex(merges)
        for b in batches:
            if b.num_rows:
                index.put(words_of_keys(b.column(0), width), [b.column(k).to_numpy().copy() for k in range(1, len(merges) + 1)])
            if flush_at and index.count >= flush_at:
                yield from drained(index)
                index = CuckooIndex(merges)
        yield from drained(index)

    return run
