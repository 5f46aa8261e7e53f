"""The external knowledge base as a mirror of tables: items by label, their values, and verification through a cache that
pins the first result of a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import cache_key
from factloom.operators.strategies import external_verify
from factloom.sources import io

INVENTORS = "item_label string, value_label string, row_seq long"
CACHE = "cache_key string, claim string, status string, confidence double, reason string"
VALUES_LIMIT = 10


def inventors(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The mirror's inventor facts as stored at a path; none if there is nothing."""
    return io.load(spark, path, INVENTORS, kind)


def load_cache(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return io.load(spark, path, CACHE, kind)


def search_items(names: DataFrame, items: DataFrame) -> DataFrame:
    """name and item_id: the first item (item_id, label, row_seq) of that label regardless of case, null if none is."""
    first = items.groupBy(F.lower("label").alias("k")).agg(F.min_by("item_id", "row_seq").alias("item_id"))
    return names.select("name").distinct().withColumn("k", F.lower("name")).join(first, "k", "left").select("name", "item_id")


def item_values(asked: DataFrame, values: DataFrame, limit: int = VALUES_LIMIT) -> DataFrame:
    """item_id, property, rank, value_label: the first values (row_seq) of each asked item (item_id) and property."""
    own = values.join(asked.select("item_id", "property").distinct(), ["item_id", "property"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("item_id", "property").orderBy("row_seq"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= limit).select("item_id", "property", "rank", "value_label")


def verify_cached(calls: DataFrame, key: str, seq: str, facts: DataFrame, cache: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Results of the calls (key, status, confidence, reason, hit) and the cache after them. A claim that is in the cache,
    or that an earlier call settled, takes that result; texts that cannot be parsed are not cached."""
    c = calls.withColumn("cache_key", cache_key(F.col(column)))
    first = c.groupBy("cache_key").agg(F.min(seq).alias("first"), F.min_by(F.col(column), seq).alias("claim")).join(cache, "cache_key", "left_anti")
    new = first.join(external_verify(first, "cache_key", facts, "claim"), "cache_key")
    pinned = new.filter("confidence > 0")
    known = cache.select("cache_key", "status", "confidence", "reason", F.lit(None).cast("long").alias("first")).unionByName(new.select("cache_key", "status", "confidence", "reason", F.col("first").cast("long").alias("first")))
    hit = (F.col("confidence") > 0) & F.coalesce(F.col(seq) > F.col("first"), F.lit(True))
    done = c.select(key, seq, "cache_key").join(known, "cache_key").select(key, "status", "confidence", "reason", hit.alias("hit"))
    return done, cache.unionByName(pinned.select("cache_key", "claim", "status", "confidence", "reason"))
