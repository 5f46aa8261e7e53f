"""The concept store as tables: concepts in versions, weighted associations, search by similarity, history, and verified
claims with their provenance. Identifiers come from the rows' own numbers; timestamps are given."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import best_columns, byte_matrix, in_blocks, integer_cosines, sha_bytes
from factloom.functions.text import percent

TOP_K, LEAST, LEAST_RETRIEVED = 5, 0.7, 0.5
CONCEPTS = "uuid string, version int, prototype string, text string, props map<string,string>"
LINKS = "from string, to string, type string, weight double"


def add_concepts(concepts: DataFrame | None, new: DataFrame) -> DataFrame:
    """concepts with the rows of new (seq, uuid, prototype, text, props) as their next versions, in order of seq."""
    own = Window.partitionBy("uuid")
    if concepts is None:
        concepts = new.sparkSession.createDataFrame([], CONCEPTS)
    known = concepts.groupBy("uuid").agg(F.max("version").alias("last"))
    added = new.withColumn("n", F.row_number().over(own.orderBy("seq"))).join(known, "uuid", "left")
    return concepts.unionByName(added.select("uuid", (F.col("n") + F.coalesce("last", F.lit(0))).cast("int").alias("version"), "prototype", "text", "props"))


def latest(concepts: DataFrame) -> DataFrame:
    """Each concept in its last version."""
    return concepts.groupBy("uuid").agg(F.max_by(F.struct("version", "prototype", "text", "props"), "version").alias("c")).select("uuid", "c.*")


def history(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """All versions of the asked concepts (uuid), with what each replaced."""
    before = F.lag("text").over(Window.partitionBy("uuid").orderBy("version"))
    return concepts.join(asked.select("uuid").distinct(), "uuid", "left_semi").select("uuid", "version", "prototype", "text", before.alias("replaced"))


def associations_of(asked: DataFrame, links: DataFrame, kind: str | None = None) -> DataFrame:
    """uuid, type, to, weight of the asked concepts' associations, of one type if it is given."""
    own = links if kind is None else links.filter(F.col("type") == kind)
    return asked.select("uuid").distinct().join(own.withColumnRenamed("from", "uuid"), "uuid")


def search(queries: DataFrame, key: str, concepts: DataFrame, column: str = "text", top_k: int = TOP_K, least: float = LEAST) -> DataFrame:
    """key, uuid, similarity, rank: the most similar concepts (hash embeddings of whole texts, so all meet), ties by uuid."""
    asked = queries.select(key, sha_bytes(F.col(column)).alias("v"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("uuid")
        sim = integer_cosines(byte_matrix(left["v"]), byte_matrix(right["v"]))
        i, j = best_columns(sim, top_k, least)
        return pa.table({key: left[key].take(i), "uuid": right["uuid"].take(j), "similarity": sim[i, j]})

    found = in_blocks(asked, concepts.select("uuid", sha_bytes(F.col("text")).alias("v")), best, f"{key} {dict(asked.dtypes)[key]}, uuid string, similarity double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "uuid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def _concept(kind: str, props: list[tuple[str, Column]], shown: list[str]) -> Column:
    values = {n: c.cast("string") for n, c in props}
    return F.struct(F.concat(F.lit(kind.split("_")[0].lower() + "_"), F.col("seq").cast("string")).alias("uuid"), F.lit(kind).alias("prototype"), F.concat_ws(" ", *[values[n] for n in shown]).alias("text"), F.create_map(*[x for n, c in values.items() for x in (F.lit(n), c)]).alias("props"))


def store_verified(claims: DataFrame, concepts: DataFrame | None = None, timestamp: float = 0.0) -> dict[str, DataFrame]:
    """claims: seq, subject, predicate, object, raw_text, status, confidence, source_type, source_id. The store's tables:
    for each claim its own concept, one of the verification and one of the source, and the links to both."""
    c = F.col
    claim = _concept("Claim", [(n, c(n)) for n in ("subject", "predicate", "object", "raw_text", "confidence")], ["subject", "predicate", "object"])
    verification = _concept("Verification_result", [("status", c("status")), ("confidence", c("confidence")), ("method", c("source_type")), ("timestamp", F.lit(float(timestamp)))], ["status", "confidence", "method", "timestamp"])
    source = _concept("Source", [("type", c("source_type")), ("identifier", c("source_id")), ("trust_score", c("confidence"))], ["type", "identifier", "trust_score"])
    new = claims.select("seq", F.explode(F.array(claim, verification, source)).alias("c")).select("seq", "c.*")
    link = lambda to, kind: F.struct(F.concat(F.lit("claim_"), F.col("seq").cast("string")).alias("from"), F.concat(F.lit(to + "_"), F.col("seq").cast("string")).alias("to"), F.lit(kind).alias("type"), F.col("confidence").alias("weight"))
    links = claims.select(F.explode(F.array(link("verification", "verified_by"), link("source", "derived_from"))).alias("l")).select("l.*")
    return {"concepts": add_concepts(concepts, new), "associations": links}


def retrieve(queries: DataFrame, key: str, tables: dict[str, DataFrame], column: str = "text", top_k: int = TOP_K, least: float = LEAST_RETRIEVED) -> DataFrame:
    """key, rank, uuid, similarity, props and provenance (type, to, weight) of the concepts that are found."""
    now = latest(tables["concepts"])
    found = search(queries, key, now, column, top_k, least).join(now.select("uuid", "props"), "uuid")
    why = associations_of(found, tables["associations"]).groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("type", "to", "weight"))).alias("provenance"))
    return found.join(why, "uuid", "left").select(key, "rank", "uuid", "similarity", "props", "provenance")


def context(found: DataFrame, key: str) -> DataFrame:
    """key and context: a heading and a line per found concept, in rank order; what a concept lacks is a question mark."""
    part = lambda n: F.coalesce(F.try_element_at("props", F.lit(n)), F.lit("?"))
    line = F.concat(F.lit("- "), F.concat_ws(" ", part("subject"), part("predicate"), part("object")), F.lit(" (similarity: "), percent(F.col("similarity")), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return found.groupBy(key).agg(F.concat(F.lit("Verified facts from knowledge graph:\n"), F.array_join(lines, "\n")).alias("context"))


def healthy(tables: dict[str, DataFrame]) -> bool:
    """Whether both tables are there with the store's columns."""
    need = {"concepts": CONCEPTS, "associations": LINKS}
    return all(name in tables and {x.split()[0] for x in ddl.split(", ")} <= set(tables[name].columns) for name, ddl in need.items())
