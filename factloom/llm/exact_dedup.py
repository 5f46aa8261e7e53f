"""Exact dedup (4): sharded cuckoo-filter index of live text digests.

Two texts are equal when they are identical after lower-casing A-Z; null counts as empty. A shard is a range of digest
hashes, and there are as many as the table's size asks for; a shard's filter answers the misses, and each hit is verified
against the full SHA-256 and byte length kept in the shard's sorted blocks. Rows are combined by digest within each scan
task before they are dealt to shards, so a group of copies of any size reaches its shard as one row a task.

Null doc_id: the row counts in group_size and is never chosen unless all ids of its group are null (keep_id null, kept
false). Repeated rows (same id and text) all count and share the same flag; there are no other ties. Very long texts are
hashed whole. Empty table: empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import filled, materialize, raw, rows, spread_lookup, table
from factloom.llm.cuckoo import SHARD_KEYS, ShardedIndex, shard_count, through_index

DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64())])
WIDTH = 40  # bytes of a key: a SHA-256 and the text's length
GROUPS = [("key", pa.binary()), ("keep", pa.int64()), ("known", pa.int64()), ("size", pa.int64())]
MERGES = [np.maximum, np.maximum, np.add]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text) and n_bytes of every row."""

    def run(batches):
        for b in batches:
            data, at = raw(pc.ascii_lower(filled(b.column("text"))))
            yield rows({"doc_id": b.column("doc_id"), "digest": [hashlib.sha256(data[i:j]).digest() for i, j in zip(at[:-1], at[1:], strict=True)], "n_bytes": at[1:] - at[:-1]}, DIGESTS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, n_bytes long")


def _key() -> Column:
    return F.concat("digest", F.unhex(F.lpad(F.hex("n_bytes"), 16, "0")))


def groups(digest_rows: DataFrame, total: int | None = None) -> DataFrame:
    """One row per distinct text: digest, n_bytes, keep_id, group_size, through the sharded index."""
    ddl = "key binary, keep long, known long, size long"
    total = digest_rows.count() if total is None else total
    single = digest_rows.select(_key().alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("keep"), F.col("doc_id").isNotNull().cast("long").alias("known"), F.lit(1).cast("long").alias("size"))
    met = single.mapInArrow(through_index(GROUPS, WIDTH, MERGES, SHARD_KEYS), ddl).repartition(shard_count(total, digest_rows.sparkSession), F.col("key"))
    found = met.mapInArrow(through_index(GROUPS, WIDTH, MERGES, None), ddl)
    return found.select(F.substring("key", 1, 32).alias("digest"), F.conv(F.hex(F.substring("key", 33, 8)), 16, 10).cast("long").alias("n_bytes"), F.when(F.col("known") > 0, F.col("keep")).alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    each = materialize(digests(docs), "digests")
    total = each.count()
    found = materialize(groups(each, total), "digest-groups")
    out = spread_lookup(each, found, ["digest", "n_bytes"], "group_size", total, F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


class LiveDigestIndex:
    """A stored index of live digests, for feeds that add and withdraw documents: the digests' shards have a cuckoo filter
    each, which insertions and deletions change. `lookup` answers for new documents which live document holds the same text
    (the largest doc_id, null if none)."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64):
        self.index = ShardedIndex(spark, WIDTH, path, shards)

    def insert(self, docs: DataFrame) -> list[int]:
        """The shards that were touched. Documents without an id are not held."""
        return self.index.change(digests(docs).filter("doc_id IS NOT NULL").select(_key().alias("key"), "doc_id"), 1)

    def delete(self, ids: DataFrame) -> list[int]:
        """Withdraws documents by doc_id; with their text too (doc_id, text), only the texts' shards are read."""
        if "text" in ids.columns:
            return self.index.change(digests(ids).select(_key().alias("key"), "doc_id"), -1)
        return self.index.change(self.index.live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), -1)

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id and copy_of of every row of docs."""
        asked = digests(docs).select("doc_id", _key().alias("key"))
        return asked.join(self.index.lookup(asked).select("key", F.col("last_id").alias("copy_of")), "key", "left").select("doc_id", "copy_of")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op4_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
