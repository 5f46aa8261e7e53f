"""Similarities. Hash embeddings are kept as bucket counts, so dot products and norms are exact integers: the cosine of
equal texts is exactly 1, and results do not depend on the order of summation.

Where every row must meet every other, `in_blocks` deals both sides into cells of bounded size; a cell's similarities are
matrix products, and only its best rows leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.functions.text import bucket, hash_tokens, norm_text


def buckets(strings: DataFrame, column: str, dim: int = 512) -> DataFrame:
    """One row per distinct string and bucket: column, bucket, n and norm2 (sum of the squared counts). Only the
    distinct strings are shuffled; counting happens within the row."""
    each = strings.select(column).distinct().withColumn("__all", F.transform(hash_tokens(F.col(column)), lambda t: bucket(t, dim)))
    each = each.withColumn("__own", F.transform(F.array_distinct("__all"), lambda b: F.struct(b.alias("bucket"), F.size(F.filter("__all", lambda x: x == b)).cast("long").alias("n"))))
    norm = F.aggregate("__own", F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"])
    return each.select(column, norm.alias("norm2"), F.explode("__own").alias("__b")).select(column, "__b.bucket", "__b.n", "norm2")


def cosines(left: DataFrame, a: str, right: DataFrame, b: str, name: str, dim: int = 512) -> DataFrame:
    """Pairs (a, b) of distinct strings whose hash cosine is not 0, found by an equi-join on buckets."""
    x = buckets(left, a, dim)
    y = buckets(right, b, dim).withColumnsRenamed({"n": "m", "norm2": "norm2_b"})
    dots = x.join(y, "bucket").groupBy(a, b).agg(F.sum(F.col("n") * F.col("m")).alias("dot"), F.first("norm2").alias("x2"), F.first("norm2_b").alias("y2"))
    return dots.select(a, b, (F.col("dot") / F.sqrt((F.col("x2") * F.col("y2")).cast("double"))).alias(name))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: str = "zero", epsilon: float = 0.0) -> Column:
    """Cosine of double arrays, summed from left to right. guard: 'zero' gives 0 where a norm is 0, 'null' null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(epsilon)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0) if guard == "zero" else F.lit(None))


def sha_embed(c: Column) -> Column:
    """The 32 bytes of SHA-256 of the lower-cased text, each over 255."""
    h = F.sha2(F.lower(c).cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def sha_bytes(c: Column) -> Column:
    """The same 32 bytes as one binary value; cosines of the bytes are those of the embeddings."""
    return F.unhex(F.sha2(F.lower(c).cast("binary"), 256))


def hash_bag(c: Column, dim: int = 512) -> Column:
    """The hash embedding as the buckets of all tokens, repeated as often as they occur."""
    return F.transform(hash_tokens(c), lambda t: bucket(t, dim))


def no_encoding() -> Column:
    """What stands for an embedding where there is no encoder; such embeddings have no similarity and are never scored."""
    return F.array(F.lit(0.0))


def in_blocks(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: tuple[int, int] = (1024, 4096)) -> DataFrame:
    """run(left rows, right rows) for every pair of blocks of about so many rows: each row of one side meets each of the
    other, in cells that are small enough for one task however large the tables are."""
    a, b = (max(1, -(-side.count() // n)) for side, n in zip((left, right), rows, strict=True))
    at = lambda side, n: F.pmod(F.xxhash64(*side.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = left.withColumn("__a", at(left, a)).withColumn("__b", every(b))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, should both be one table
    y = right.withColumn("__b", at(right, b)).withColumn("__a", every(a))
    none = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()
    return x.groupBy("__a", "__b").cogroup(y.groupBy("__a", "__b")).applyInArrow(lambda l, r: run(l, r) if l.num_rows and r.num_rows else none, schema)  # noqa: E741


def byte_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.float64)


def bag_matrix(column: pa.ChunkedArray, dim: int = 512) -> np.ndarray:
    flat = column.combine_chunks()
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), dim))
    np.add.at(out, (np.repeat(np.arange(len(flat)), size), flat.flatten().to_numpy()), 1.0)
    return out


def vector_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def integer_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of whole numbers (0 where a row is all zero); the products and squares are exact."""
    norms = (x * x).sum(1)[:, None] * (y * y).sum(1)
    return np.divide(x @ y.T, np.sqrt(norms), out=np.zeros(norms.shape), where=norms > 0)


def string_ratios(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Ratcliff-Obershelp ratios of all pairs of strings; equal strings are compared once."""
    left, right = a.combine_chunks().dictionary_encode(), b.combine_chunks().dictionary_encode()
    known = np.array([[SequenceMatcher(None, x, y).ratio() for y in right.dictionary.to_pylist()] for x in left.dictionary.to_pylist()])
    return known[left.indices.to_numpy()[:, None], right.indices.to_numpy()]


def best_columns(scores: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row that are at least `least`; of equal ones the first columns."""
    scores, found = scores.copy(), []
    for _ in range(min(k, scores.shape[1])):
        best = scores.argmax(1)
        own = np.flatnonzero(scores[np.arange(len(scores)), best] >= max(least, np.finfo(np.float64).min))
        found.append((own, best[own]))
        scores[own, best[own]] = -np.inf
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@F.pandas_udf(T.DoubleType())
def string_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two normalised strings; Spark has no such function."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def text_ratio(a: Column, b: Column) -> Column:
    return string_similarity(norm_text(a), norm_text(b))
