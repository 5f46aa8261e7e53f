"""Inputs that the queries share: facts and generated claims over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.kb import build_facts

THRESHOLD = 0.7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work on rows that costs far more than moving them: dealt to all cores if it is read in fewer parts than
    there are. A table of many files is left as it is."""
    df, cores = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are located in nations, nations are part of regions."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    s = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    located = s.select((F.col("s_suppkey") + 1000).alias("fact_seq"), F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"))
    part = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("fact_seq"), F.col("n_name").alias("subject"), F.lit("is part of").alias("predicate"), F.col("r_name").alias("object"))
    return part.unionByName(located)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_facts(fact_rows(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per supplier: true, wrong nation, unlisted supplier, no claim, or all unknown, by the key."""
    s = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    text = (
        F.when(k == 0, F.concat(name, F.lit(" is located in "), "n_name", F.lit(".")))
        .when(k == 1, F.concat(name, F.lit(" is located in NATION_"), ((F.col("s_nationkey") + 1) % 25).cast("string"), F.lit(".")))
        .when(k == 2, F.concat(F.lit("Supplier#9"), F.substring(name, 11, 20), F.lit(" is located in "), "n_name", F.lit(".")))
        .when(k == 3, F.concat(F.lit("Hello there, "), name, F.lit("!")))
        .otherwise(F.concat(F.lit("Depot "), F.col("s_suppkey").cast("string"), F.lit(" is located in Atlantis"), F.col("s_suppkey").cast("string"), F.lit(".")))
    )
    return s.select(F.col("s_suppkey").alias("text_id"), text.alias("text"))


def judged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, sample, reply: synthetic replies of three samples, some of them errors or malformed."""
    t = texts(spark, sf_dir).select("text_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample"))
    k = (F.col("text_id") * 7 + F.col("sample") * 3) % 6
    reply = (
        F.when(k == 0, "VERDICT: TRUE\nCONFIDENCE: 0.9\nREASONING: It holds: see the list.")
        .when(k == 1, "VERDICT: FALSE\nCONFIDENCE: high\nREASONING: No.")
        .when(k == 2, "verdict: true and false\nCONFIDENCE: 0.4")
        .when(k == 3, "I cannot tell")
        .when(k == 4, F.lit(None).cast("string"))
        .otherwise("VERDICT: FALSE\nCONFIDENCE: 0.75\nREASONING: Wrong place.")
    )
    return t.select("text_id", "sample", reply.alias("reply"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as stored claims; status and confidence by the key."""
    b = read(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    status = F.when(k % 4 == 0, "refuted").when(k % 4 == 1, "cached").otherwise("verified")
    return b.select(F.concat(F.lit("c"), F.lpad(k.cast("string"), 6, "0")).alias("claim_id"), k.alias("seq"), "text", status.alias("status"), ((k % 10 + 1) / 10.0).alias("confidence"), F.concat(F.lit("item "), k.cast("string")).alias("subject"), F.lit("is").alias("predicate"), F.lit("a passage").alias("object"))


def inventors(spark: SparkSession) -> DataFrame:
    """The external verifier's mirror for the evaluation corpus, with an unlabelled row."""
    rows = [("telephone", "Alexander Graham Bell", 0), ("the telephone", "Antonio Meucci", 1), ("light bulb", "Thomas Edison", 2), ("radio", "Guglielmo Marconi", 3), ("the radio", "Guglielmo Marconi", 4), ("radium", "Marie Curie", 5), ("radium", "Pierre Curie", 6), ("World Wide Web", "Tim Berners-Lee", 7), ("printing press", "Johannes Gutenberg", 8), ("gravity", None, 9), ("theory of relativity", "Albert Einstein", 10)]
    return spark.createDataFrame(rows, "item_label string, value_label string, row_seq long")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, label, row_seq: nations and customers as items of an external knowledge base."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("item_id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("row_seq"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("item_id"), F.col("c_name").alias("label"), (F.col("c_custkey") + 1000).alias("row_seq"))
    return n.unionByName(c)


def item_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, property, value_label, row_seq: the customers of each nation, richest first, and each one's segment."""
    c = read(spark, sf_dir, "customer")
    lives = c.select(F.concat(F.lit("N"), "c_nationkey").alias("item_id"), F.lit("inhabitant").alias("property"), F.col("c_name").alias("value_label"), F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey").alias("row_seq"))
    works = c.select(F.concat(F.lit("C"), "c_custkey").alias("item_id"), F.lit("segment").alias("property"), F.col("c_mktsegment").alias("value_label"), F.struct(F.lit(0.0).alias("b"), "c_custkey").alias("row_seq"))
    return lives.unionByName(works)


def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, text, reply: JSON lists of claims, empty lists, malformed ones and plain words."""
    e = dealt(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    k = F.col("event_id") % 5
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    reply = (
        F.when(k == 0, F.concat(F.lit('Sure: [{"subject": "'), user, F.lit('", "predicate": "made", "object": "a '), "event_type", F.lit('", "confidence": 0.9}]')))
        .when(k == 1, F.concat(F.lit('[{"subject": "'), user, F.lit('"}, {"subject": "x", "predicate": "created", "object": "'), "event_type", F.lit('"}]')))
        .when(k == 2, "[]").when(k == 3, "[not json").otherwise("no list here")
    )
    return e.select("event_id", F.concat(user, F.lit(" created a "), "event_type", F.lit(". It was on a list.")).alias("text"), reply.alias("reply"))
