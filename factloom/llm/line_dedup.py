"""Line dedup (7): sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. A key of at least
`min_chars` code points that at least two documents hold loses all its lines, except in the smallest doc_id that holds
it. The reference table keeps, for each key, the number of documents and the smallest and largest of them; it is
derived from postings (key, doc_id), so inserting and deleting documents are both reversible.

Null or empty text: one empty line. Very long texts are cut whole. Null doc_id: holds no references, and its lines stay.
Rows repeated with one doc_id are one document; there are no other ties. Keys are compared by 128-bit BLAKE2b digests.
Empty table: empty result. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialize, rows, spread_lookup, table
from factloom.llm.cuckoo import SHARD_KEYS, ShardedIndex, shard_count, through_index

SPACE, MIN_CHARS = " \t\n\x0b\x0c\r", 10
REFS = [("key", pa.binary()), ("refs", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]
REFS_DDL, MERGES, WIDTH = "key binary, refs long, first_id long, last_id long", [np.add, np.minimum, np.maximum], 16


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    line = line.strip(SPACE)
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= min_chars else None


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (key, doc_id) of the lines that count."""

    def run(batches):
        schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])
        for b in batches:
            keys, ids = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if i is not None:
                    own = {line_key(x, min_chars) for x in (text.as_py() or "").split("\n")} - {None}
                    keys += own
                    ids += [i] * len(own)
                if len(keys) > 100_000:
                    yield rows({"key": keys, "doc_id": ids}, schema)
                    keys, ids = [], []
            yield rows({"key": keys, "doc_id": ids}, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "key binary, doc_id long")


def references(post: DataFrame, least: int = 1, total: int | None = None) -> DataFrame:
    """key, refs, first_id, last_id of keys held by at least `least` postings. Rows meet in their scan task first."""
    total = post.count() if total is None else total
    single = post.select("key", F.lit(1).cast("long").alias("refs"), F.col("doc_id").alias("first_id"), F.col("doc_id").alias("last_id"))
    met = single.mapInArrow(through_index(REFS, WIDTH, MERGES, SHARD_KEYS), REFS_DDL).repartition(shard_count(total, post.sparkSession), F.col("key"))
    return met.mapInArrow(through_index(REFS, WIDTH, MERGES, None, lambda refs, *_: refs >= least), REFS_DDL)


def drop_lines(docs: DataFrame, shared: DataFrame | None = None, min_chars: int = MIN_CHARS, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and kept_text) for every row of docs. shared: references of their lines, if
    they come from an index; else those of docs themselves."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    post = materialize(postings(docs, min_chars), "line-postings")
    total = post.count()
    shared = materialize((references(post, 2, total) if shared is None else shared).filter("first_id <> last_id"), "line-refs")
    hits = spread_lookup(post, shared, ["key"], "refs", total, F.col("doc_id")).filter(F.col("first_id") < F.col("doc_id"))
    drops = hits.select("doc_id", "key").groupBy("doc_id").agg(F.collect_set("key").alias("drops"))
    fields = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text

    def run(batches):
        schema = pa.schema(fields)
        for b in batches:
            out = {f: [] for f in schema.names}
            for i, text, gone in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("drops"), strict=True):
                text, gone = text.as_py() or "", gone.as_py()
                lines = text.split("\n")
                if gone:
                    gone = set(gone)
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                    text = "\n".join(kept)
                else:
                    kept = lines
                values = (i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text)
                for f, v in zip(schema.names, values, strict=False):
                    out[f].append(v)
            yield rows(out, schema)

    ddl = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.join(drops, "doc_id", "left").mapInArrow(run, ddl)


class LineIndex:
    """A stored index of lines: shards of postings, each with a cuckoo filter, that documents enter and leave. `clean` answers
    by what is live; a document's own lines need not be in the index."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, shards: int = 64):
        self.index, self.min_chars = ShardedIndex(spark, WIDTH, path, shards), min_chars

    def insert(self, docs: DataFrame) -> list[int]:
        """The shards that were touched."""
        return self.index.change(postings(docs, self.min_chars), 1)

    def delete(self, ids: DataFrame) -> list[int]:
        """Withdraws documents by doc_id; with their text too (doc_id, text), only the lines' shards are read."""
        if "text" in ids.columns:
            return self.index.change(postings(ids, self.min_chars), -1)
        return self.index.change(self.index.live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), -1)

    def clean(self, docs: DataFrame) -> DataFrame:
        held = self.index.lookup(postings(docs, self.min_chars).select("key"))
        return drop_lines(docs, held, self.min_chars)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = {
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(r.first_id < k.doc_id, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
}
QUERIES = {"op7_line_dedup": op7_line_dedup}
