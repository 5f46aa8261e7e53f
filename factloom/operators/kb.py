"""The knowledge base: facts as a table, and its entity, relation and edge views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import canon_predicate, norm_text


def build_facts(rows: DataFrame, confidence: float = 1.0, source: str = "kb") -> DataFrame:
    """rows: fact_seq, subject, predicate, object (confidence, source optional). Adds what matching goes by; an entity
    is shown by its first spelling. p_canon is the stored predicate, p_canon2 the one compared (canonical once more)."""
    for name, value in (("confidence", float(confidence)), ("source", source)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    f = rows.withColumns({"s_norm": norm_text(F.col("subject")), "o_norm": norm_text(F.col("object")), "p_canon": canon_predicate(F.col("predicate"))})
    f = f.withColumn("p_canon2", canon_predicate(F.col("p_canon"))).withColumn("rel_id", F.concat(F.lit("rel:"), F.substring(F.md5(F.concat_ws("|", F.col("fact_seq").cast("string"), "subject", "predicate", "object").cast("binary")), 1, 12)))
    names = entities(f).select("entity", "label")
    f = f.join(names.withColumnsRenamed({"entity": "s_norm", "label": "s_label"}), "s_norm").join(names.withColumnsRenamed({"entity": "o_norm", "label": "o_label"}), "o_norm")
    return f.select("fact_seq", "rel_id", "subject", "predicate", "object", "confidence", "source", "s_norm", "p_canon", "p_canon2", "o_norm", "s_label", "o_label")


def entities(facts: DataFrame) -> DataFrame:
    """entity (normalised name) and label (its first spelling; a fact's subject comes before its object)."""
    spelled = facts.select(F.explode(F.array(F.struct(F.col("s_norm").alias("entity"), (F.col("fact_seq") * 2).alias("at"), F.col("subject").alias("label")), F.struct(F.col("o_norm").alias("entity"), (F.col("fact_seq") * 2 + 1).alias("at"), F.col("object").alias("label")))).alias("e"))
    return spelled.select("e.*").groupBy("entity").agg(F.min_by("label", "at").alias("label"))


def edges(facts: DataFrame) -> DataFrame:
    """src, dst, role: subject to relation, relation to object."""
    pair = F.array(F.struct(F.concat(F.lit("ent:"), "s_norm").alias("src"), F.col("rel_id").alias("dst"), F.lit("subj").alias("role")), F.struct(F.col("rel_id").alias("src"), F.concat(F.lit("ent:"), "o_norm").alias("dst"), F.lit("obj").alias("role")))
    return facts.select(F.explode(pair).alias("e")).select("e.*")


def add_facts(facts: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """Facts with rows appended; nothing is deduplicated, and first spellings are taken over all of them."""
    keep = ["fact_seq", "subject", "predicate", "object", "confidence", "source"]
    new = build_facts(rows, **options).select(*keep)
    return build_facts(facts.select(*keep).unionByName(new))


def kb_stats(facts: DataFrame) -> DataFrame:
    """entities, relations, edges."""
    n = entities(facts).agg(F.count("*").alias("entities"))
    r = facts.agg(F.count("*").alias("relations"), (F.count("*") * 2).alias("edges"))
    return n.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k").drop("k")


def proof(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """src, dst, role of the relations (rel_id) and their neighbours."""
    return edges(facts.join(relations.select("rel_id").distinct(), "rel_id", "left_semi"))


def proof_json(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """rel_id and json: nodes and edges of each relation's proof."""
    own = facts.join(relations.select("rel_id").distinct(), "rel_id", "left_semi")
    node = lambda i, kind, label: F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    s, o = F.concat(F.lit("ent:"), "s_norm"), F.concat(F.lit("ent:"), "o_norm")
    nodes = F.array(node(s, "entity", F.col("s_label")), node(F.col("rel_id"), "relation", F.col("p_canon")), node(o, "entity", F.col("o_label")))
    edge = lambda a, b, role: F.struct(a.alias("source"), b.alias("target"), F.lit(role).alias("role"))
    both = F.array(edge(s, F.col("rel_id"), "subj"), edge(F.col("rel_id"), o, "obj"))
    return own.select("rel_id", F.to_json(F.struct(nodes.alias("nodes"), both.alias("edges"))).alias("json"))
