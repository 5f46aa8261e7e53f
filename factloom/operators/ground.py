"""The ground-truth store: propositions with entities, predicates and associations, and checking against them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.similarity import best_columns, byte_matrix, in_blocks, integer_cosines, sha_bytes
from factloom.operators.extract import GROUND_VERBS, parse_triple
from factloom.operators.order import cut, openers

# Association types with their inverses.
ASSOCIATIONS = {"has_subject": "subject_of", "has_predicate": "predicate_of", "has_object": "object_of", "derived_from": "source_of", "verified_by": "verifies", "contradicts": "contradicted_by", "supports": "supported_by"}
TRUST, SOURCE = 0.8, "external"
CANDIDATE, SUBJECT, PREDICATE, OBJECT, OTHER_SUBJECT, SAME_ENTITY = 0.7, 0.8, 0.7, 0.8, 0.5, 0.9


def store(propositions: DataFrame) -> dict[str, DataFrame]:
    """propositions: seq, subject, predicate, object, raw_text, confidence. The store's four tables; names are unique
    regardless of case, and the first spelling stays (batch semantics: all names are resolved by equality)."""
    names = propositions.select(F.explode(F.array(F.struct((F.col("seq") * 2).alias("at"), F.col("subject").alias("name")), F.struct((F.col("seq") * 2 + 1).alias("at"), F.col("object").alias("name")))).alias("n")).select("n.*")
    first = lambda df: df.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))
    entities = first(names).select(F.concat(F.lit("entity_"), "at").alias("uuid"), "name", F.lit("thing").alias("entity_type"), "at")
    predicates = first(propositions.select(F.col("seq").alias("at"), F.col("predicate").alias("name"))).select(F.concat(F.lit("predicate_"), "at").alias("uuid"), "name", F.concat("name", F.lit("_by")).alias("inverse_name"), "at")
    ids = lambda df, c: df.select(F.lower("name").alias(f"k_{c}"), F.col("uuid").alias(f"{c}_uuid"))
    p = propositions.withColumns({"k_subject": F.lower("subject"), "k_object": F.lower("object"), "k_predicate": F.lower("predicate")})
    p = p.join(ids(entities, "subject"), "k_subject").join(ids(entities, "object"), "k_object").join(ids(predicates, "predicate"), "k_predicate")
    p = p.select("seq", F.concat(F.lit("prop_"), "seq").alias("uuid"), "subject_uuid", "predicate_uuid", "object_uuid", "subject", "predicate", "object", "raw_text", F.lit("verified").alias("status"), "confidence")
    links = p.select(F.col("uuid").alias("from"), F.lit(SOURCE).alias("to"), F.lit("derived_from").alias("type"), F.lit(TRUST).alias("weight"))
    return {"propositions": p, "entities": entities, "predicates": predicates, "associations": links}


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows - and the verified propositions."""
    out = None
    for name in ("propositions", "entities", "predicates", "associations"):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.union(one)
    return out.union(tables["propositions"].agg(F.sum((F.col("status") == "verified").cast("long")).alias("rows")).select(F.lit("verified").alias("table"), "rows"))


def check(claims: DataFrame, key: str, propositions: DataFrame, column: str = "text") -> DataFrame:
    """key, status, confidence, matched (raw text) and reason. A contradiction wins over a match; the most similar
    proposition is named, the first of equals. A hash of a text says nothing of its parts, so every claim meets every
    proposition: each is hashed once, blocks of them are compared by matrix products, and a block's best goes on."""
    c = cut(claims.select(key, F.col(column).alias("text"), parse_triple(F.col(column), GROUND_VERBS).alias("t")))
    parsed = c.filter("t IS NOT NULL").select(key, *[sha_bytes(F.col(x)).alias(n) for n, x in zip("espo", ("text", "t.subject", "t.predicate", "t.object"), strict=True)])
    props = propositions.select("seq", "subject", "predicate", "object", "raw_text")
    held = props.select("seq", *[sha_bytes(F.col(x)).alias(n) for n, x in zip("espo", ("raw_text", "subject", "predicate", "object"), strict=True)])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("seq")
        sim, s, p, o = (integer_cosines(byte_matrix(left[n]), byte_matrix(right[n])) for n in "espo")
        near = (sim > CANDIDATE) & (p > PREDICATE) & (o > OBJECT)
        against = near & (s < OTHER_SUBJECT)
        rank = np.where(against, sim + 4.0, np.where(near & (s > SUBJECT), sim, -np.inf))
        i, j = best_columns(rank, 1)
        return pa.table({key: left[key].take(i), "against": against[i, j], "sim": sim[i, j], "seq": right["seq"].take(j)})

    schema = f"{key} {dict(claims.dtypes)[key]}, against boolean, sim double, seq {dict(props.dtypes)['seq']}"
    found = in_blocks(parsed, held, best, schema).groupBy(key).agg(F.max(F.struct("against", "sim", (-F.col("seq")).alias("o"))).alias("b"))
    found = found.select(key, "b.against", "b.sim", (-F.col("b.o")).alias("seq")).join(props, "seq")
    j = c.join(found, key, "left")
    none = F.col("seq").isNull()
    status = F.when(F.col("t").isNull() | none, "unverified").when(F.col("against"), "refuted").otherwise("verified")
    confidence = F.when(F.col("t").isNull(), 0.0).when(none, 0.5).otherwise(F.col("sim"))
    reason = (
        F.when(F.col("t").isNull(), "Could not extract subject-predicate-object from claim").when(none, "No matching ground truth found")
        .when(F.col("against"), F.concat(F.lit("Ground truth shows "), F.concat_ws(" ", "subject", "predicate", "object"), F.lit(", not "), F.col("t.subject")))
        .otherwise(F.concat(F.lit("Ground truth confirms: "), F.col("raw_text")))
    )
    return j.select(key, status.alias("status"), confidence.alias("confidence"), F.col("raw_text").alias("matched"), reason.alias("reason"))


def decompose(claims: DataFrame, key: str, tables: dict[str, DataFrame], column: str = "text") -> DataFrame:
    """key, part, subject, object, status, confidence: whether each part of a parsed claim is known by name."""
    t = claims.select(key, parse_triple(F.col(column), GROUND_VERBS).alias("t")).filter("t IS NOT NULL")
    part = lambda k, c, kind: F.struct(F.lit(k).alias("part"), F.col(f"t.{c}").alias("subject"), F.lit(kind).alias("object"))
    rows = t.select(key, F.explode(F.array(part(0, "subject", "Entity"), part(1, "predicate", "Predicate"), part(2, "object", "Entity"))).alias("r")).select(key, "r.*").withColumn("k", F.lower("subject"))
    names = tables["entities"].select(F.lower("name").alias("k"), F.lit("Entity").alias("object")).union(tables["predicates"].select(F.lower("name").alias("k"), F.lit("Predicate").alias("object"))).distinct().withColumn("known", F.lit(True))
    j = rows.join(names, ["k", "object"], "left")
    return j.select(key, "part", "subject", F.lit("is_a").alias("predicate"), "object", F.when(F.col("known"), "verified").otherwise("unverified").alias("status"), F.when(F.col("known"), 1.0).otherwise(0.5).alias("confidence"))


def resolve_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name and uuid: the first entity, in order, that is named so, has the name as an alias or is more similar than
    0.9; null where a new one is needed. entities: uuid, name, at, aliases."""
    asked = names.select("name").distinct().withColumn("k", F.lower("name"))
    spelled = entities.select("uuid", "at", F.explode(F.array_union(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)))).alias("k"))
    equal = asked.join(spelled, "k").select("name", "uuid", "at")

    def similar(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at")
        sim = integer_cosines(byte_matrix(left["v"]), byte_matrix(right["v"]))
        i, j = best_columns((sim > SAME_ENTITY).astype(np.float64), 1, 1.0)
        return pa.table({"name": left["name"].take(i), "uuid": right["uuid"].take(j), "at": right["at"].take(j)})

    kinds = dict(entities.dtypes)
    near = in_blocks(asked.select("name", sha_bytes(F.col("name")).alias("v")), entities.select("uuid", "at", sha_bytes(F.col("name")).alias("v")), similar, f"name string, uuid {kinds['uuid']}, at {kinds['at']}")
    best = equal.union(near).groupBy("name").agg(F.min_by("uuid", "at").alias("uuid"))
    return asked.select("name").join(best, "name", "left")


def resolve_in_order(names: DataFrame, entities: DataFrame) -> DataFrame:
    """seq, name, uuid, created of names (seq, name) that are resolved one after another: each takes the first entity, in
    order, that it equals or resembles, be it given or made for an earlier name; else one is made for it."""
    given = cut(resolve_entities(names, entities).filter("uuid IS NOT NULL"))
    left = names.join(given.select("name"), "name", "left_anti").select("seq", "name", F.lower("name").alias("k"))
    heads = cut(left.groupBy("k").agg(F.min("seq").alias("seq")))
    sides = heads.select("seq", sha_bytes(F.col("k")).alias("v"))

    def alike(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = np.nonzero((integer_cosines(byte_matrix(a["v"]), byte_matrix(b["v"])) > SAME_ENTITY) & (a["seq"].to_numpy()[:, None] < b["seq"].to_numpy()))
        return pa.table({"a": a["seq"].take(i), "b": b["seq"].take(j)})

    kind = dict(heads.dtypes)["seq"]
    pairs = cut(in_blocks(sides, sides, alike, f"a {kind}, b {kind}"))
    made = openers(heads.select(F.col("seq").alias("n")), pairs).select(F.col("n").alias("maker"))
    near = pairs.join(made, pairs["a"] == made["maker"]).groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("maker"))
    of = heads.join(near, "seq", "left").select("k", F.coalesce("maker", "seq").alias("maker"))
    new = left.join(of, "k").select("seq", "name", F.concat(F.lit("entity_new_"), F.col("maker").cast("string")).alias("uuid"), (F.col("seq") == F.col("maker")).alias("created"))
    return names.select("seq", "name").join(given, "name").select("seq", "name", "uuid", F.lit(False).alias("created")).unionByName(new)
