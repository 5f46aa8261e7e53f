"""Helpers shared by the training-data operators: shared-folder tables, Arrow text kernels and skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many bytes, so a worker's memory does not follow the Arrow batch.
SLICE_BYTES = 4 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
_SCOPES: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one of our own only in local mode, if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and any executor can reread it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that no later result reads."""
    for df in frames:
        path, spark = getattr(df, "_factloom_path", None), df.sparkSession
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch():
    """Tables that are materialized within are deleted at the end, but for those that are handed to the yielded function."""
    spared: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield lambda df: spared.append(df) or df
    finally:
        paths = {x._factloom_path for x in spared}
        discard(*[x for x in _SCOPES.pop() if x._factloom_path not in paths])


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs' rows as one struct column `row`, whatever their columns are called, beside columns of its fields; a select of
    `row.*` gives them back."""
    return docs.select(F.struct("*").alias("row")).select("row", *[c.alias(n) for n, c in columns.items()])


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1, ...: for functions that cannot take all names."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def spread_lookup(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int, by: Column) -> DataFrame:
    """Left join to `right` (unique on keys). Groups of at least total/1000 rows - so at most 1000 of them, which
    bounds the broadcast - are split over all partitions by a hash of `by`; the others join as they are."""
    spark = left.sparkSession
    salts, bound = shuffle_partitions(spark), max(64, total // 1000)
    hot = right.filter(F.col(size) >= bound).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    many = F.when(F.col(size) >= bound, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    b = right.withColumn("__salt", F.explode(many))
    return a.join(b, [*keys, "__salt"], "left").drop("__salt")


# ---- Arrow kernels -------------------------------------------------------------------------------------------------


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text; a longer single text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part, start = np.cumsum(sizes) // limit, 0
    for cut in [*(np.flatnonzero(np.diff(part)) + 1), len(part)]:
        if cut > start:
            yield batch.slice(start, cut - start)
            start = cut


def filled(column: pa.Array) -> pa.Array:
    """Null as empty, with 64-bit offsets that start at 0 (kernels differ on how they take slices)."""
    out = pc.fill_null(column.cast(pa.large_string()), "")
    data, at = raw(out)
    if not len(out) or not at[0] and not out.offset:
        return out
    return pa.LargeStringArray.from_buffers(len(out), pa.py_buffer(at - at[0]), pa.py_buffer(data[at[0] : at[-1]]))


def raw(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes and the offsets of each string in them."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return memoryview(data if data is not None else b""), at


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of lower-cased (A-Z) texts, flat, with each text's bounds in them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[bounds]


def running_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Running sums (64-bit, wrapping) of a polynomial in the bytes of each string, and the strings' bounds in them: the
    difference of two sums within a string stands for the bytes from its first on, if it begins there."""
    data, at = raw(strings)
    b, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    size = np.diff(at)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, PRIME))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(b)) - np.repeat(at[:-1], size)])]), at


def spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * PRIME
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    sums, at = running_hashes(strings)
    return spread_bits(sums[at[1:]] - sums[at[:-1]])


def rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


# ---- fixed-size arrays summed over tasks ---------------------------------------------------------------------------


def blocks_of(values: np.ndarray, size: int) -> pa.RecordBatch:
    """An array as rows (block, data) of `size` elements each, without those that are all zero."""
    parts = values.reshape(-1, size)
    some = [k for k in range(len(parts)) if parts[k].any()]
    return rows({"block": some, "data": [parts[k].tobytes() for k in some]}, pa.schema([("block", pa.int32()), ("data", pa.binary())]))


def reduced(blocks: DataFrame, count: int, size: int, kind: str = "sum") -> np.ndarray:
    """All tasks' blocks added up ("sum": uint32, "float": float32, "double": float64) or or-ed ("bits": uint32). Each
    block is a stream through one task; the result has a fixed size, whatever the input's."""
    dtype = {"float": np.float32, "double": np.float64}.get(kind, np.uint32)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                got = np.frombuffer(data.as_buffer(), dtype)
                sums[k] = got.copy() if k not in sums else sums[k] | got if kind == "bits" else sums[k] + got
        yield rows({"block": list(sums), "data": [x.tobytes() for x in sums.values()]}, pa.schema([("block", pa.int32()), ("data", pa.binary())]))

    out = np.zeros((count, size), dtype)
    for r in blocks.repartition("block").mapInArrow(run, "block int, data binary").collect():
        out[r.block] = np.frombuffer(bytes(r.data), dtype)
    return out.ravel()
