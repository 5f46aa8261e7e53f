"""Streaming forms of the stateful operators: the semantic cache and the claim memory. State is a log of numbered batches
in shared storage: a batch only adds its own folder, so a repeated batch writes the same again, and nothing is rewritten."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.text import cache_key
from factloom.operators.memory import upsert
from factloom.operators.strategies import CACHE_DISCOUNT

PINNED = "cache_key string, verdict string, confidence double, batch long"


def first_calls(calls: DataFrame, column: str = "text", time: str = "ts", within: str = "1 day") -> DataFrame:
    """The calls of a stream that miss a cache whose entries expire: the first of each key within the watermark."""
    return calls.withColumn("cache_key", cache_key(F.col(column))).withWatermark(time, within).dropDuplicatesWithinWatermark(["cache_key"])


def windowed_verdicts(verdicts: DataFrame, time: str = "ts", size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Verdict counts by tumbling window; later rows than the watermark are left out."""
    return verdicts.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "verdict").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "verdict", "n")


def _logged(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All batches of a log, or those before a number; None if it has none yet."""
    try:
        log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return log if before is None else log.filter(F.col("batch") < before)


def cached_calls(calls: DataFrame, pins: str, out: str, checkpoint: str, key: str = "call_id", seq: str = "seq", column: str = "text") -> StreamingQuery:
    """The semantic cache over a stream of calls (key, seq, text, verdict and confidence as judged), without expiry: the
    first call of a text pins its verdict in the log `pins`; later ones, in this batch or any other, get that verdict at
    a discount. Results go to the log `out`: key, verdict, hit, confidence, external_calls."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("cache_key", cache_key(F.col(column))).persist()
        old = _logged(spark, pins, number)
        old = spark.createDataFrame([], PINNED) if old is None else old.select(*[x.split()[0] for x in PINNED.split(", ")])
        first = own.groupBy("cache_key").agg(F.min_by(F.struct(F.col(seq).alias("s"), "verdict", "confidence"), seq).alias("f"))
        new = first.join(old, "cache_key", "left_anti").select("cache_key", "f.verdict", "f.confidence", F.col("f.s").alias("s"))
        known = new.unionByName(old.select("cache_key", "verdict", "confidence", F.lit(None).cast(dict(new.dtypes)["s"]).alias("s")))
        j = own.select(key, seq, "cache_key").join(known, "cache_key").withColumn("hit", F.coalesce(F.col(seq) > F.col("s"), F.lit(True)))
        done = j.select(key, "verdict", "hit", F.when(F.col("hit"), F.col("confidence") * CACHE_DISCOUNT).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("hit"), 0).otherwise(1).alias("external_calls"))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.drop("s").write.mode("overwrite").parquet(f"{pins}/batch={number}")
        own.unpersist()

    return calls.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_claims(claims: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add a stream of claims (claim_id, seq, ...) to the log at `path`, a row per claim and batch."""

    def add(batch: DataFrame, number: int) -> None:
        first = F.min("seq").alias("first_seq")
        last = batch.groupBy("claim_id").agg(F.max_by(F.struct("*"), "seq").alias("c"), first)
        last.select("c.*", "first_seq").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return claims.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_claims(spark: SparkSession, path: str) -> DataFrame | None:
    """The claim memory as the log has it: each claim's last values at its first place. None before the first batch."""
    log = _logged(spark, path)
    if log is None:
        return None
    places = log.groupBy("claim_id").agg(F.min("first_seq").alias("place"))
    return upsert(log.drop("batch", "first_seq")).drop("seq").join(places, "claim_id").withColumnRenamed("place", "seq")
