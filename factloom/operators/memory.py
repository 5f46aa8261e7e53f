"""Verified claims: proving, storing, retrieving, and the verification agent. Timestamps are always given, never read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import best_columns, in_blocks, vector_matrix
from factloom.functions.text import claim_id, keywords, percent
from factloom.operators.probe import probe_texts

REUSABLE = ["verified", "cached"]


def status_of(verdict: Column) -> Column:
    return F.when(verdict.isin("PASS", "SOFT_PASS"), "verified").when(verdict.isin("FAIL", "CONTRADICT"), "refuted").otherwise("unverifiable")


def confidence_of(verdict: Column, score: Column) -> Column:
    against = F.when(score > 0, 1.0 - score).otherwise(0.9)
    return F.when(verdict == "PASS", 1.0).when(verdict == "SOFT_PASS", score).when(verdict.isin("FAIL", "CONTRADICT"), against).otherwise(0.5)


def prove(texts: DataFrame, facts: DataFrame, key: str, column: str = "text", threshold: float = 0.7, timestamp: float = 0.0, similar: str = "hash") -> DataFrame:
    """The first claim of each text as a verified claim: key, text, subject, predicate, object, status, confidence,
    provenance, verdict, score, reason, claim_id."""
    found = probe_texts(texts, facts, key, column, threshold, similar=similar).filter("claim_idx = 0")
    found = found.join(texts.select(key, F.col(column).alias("text")), key)
    found = found.withColumn("status", status_of(F.col("verdict"))).withColumn("confidence", confidence_of(F.col("verdict"), F.col("score")))
    details = F.to_json(F.struct("verdict", "score", "matched_facts", "reason"))
    prov = F.struct(F.lit("kb_probe").alias("method"), F.lit("knowledge_base_lookup").alias("source"), F.lit(float(timestamp)).alias("timestamp"), F.col("confidence").alias("confidence"), details.alias("details"))
    return found.select(key, "text", "subject", "predicate", "object", "status", "confidence", prov.alias("provenance"), "verdict", "score", "reason", claim_id(F.col("subject"), F.col("predicate"), F.col("object")).alias("claim_id"))


def kb_strategy(probed: DataFrame, key: str) -> DataFrame:
    """key, verdict, confidence of the first claim of each probed text: the knowledge base as a strategy of its own."""
    return probed.filter("claim_idx = 0").select(key, "verdict", confidence_of(F.col("verdict"), F.col("score")).alias("confidence"))


def upsert(claims: DataFrame, key: str = "claim_id", seq: str = "seq") -> DataFrame:
    """One row per key: the last row's values at the first row's place (seq)."""
    others = [c for c in claims.columns if c not in (key, seq)]
    found = claims.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("last"), F.min(seq).alias(seq))
    return found.select(key, seq, *[F.col(f"last.{c}").alias(c) for c in others])


def claim_keywords(claims: DataFrame, column: str = "text") -> DataFrame:
    """keyword, claim_id: the index that retrieval joins."""
    return claims.select(F.explode(keywords(F.col(column))).alias("keyword"), "claim_id")


def eligible(claims: DataFrame, min_confidence: float, statuses: list[str]) -> DataFrame:
    return claims.filter(F.col("status").isin(statuses) & (F.col("confidence") >= min_confidence))


def retrieve_keyword(queries: DataFrame, query_key: str, claims: DataFrame, top_k: int = 5, min_confidence: float = 0.5, statuses: list[str] | None = None) -> DataFrame:
    """query_key, claim_id, score (share of the query's keywords that the claim holds) and rank."""
    asked = queries.select(query_key, keywords(F.col("text")).alias("__q"))
    index = claim_keywords(eligible(claims, min_confidence, statuses or REUSABLE))
    hits = asked.select(query_key, F.size("__q").alias("__n"), F.explode("__q").alias("keyword")).join(index, "keyword").groupBy(query_key, "__n", "claim_id").agg(F.count("*").alias("overlap"))
    scored = hits.select(query_key, "claim_id", (F.col("overlap") / F.col("__n")).alias("score")).join(claims.select("claim_id", "seq"), "claim_id")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select(query_key, "claim_id", "score", "rank")


def retrieve_vector(queries: DataFrame, query_key: str, claims: DataFrame, top_k: int = 5) -> DataFrame:
    """query_key, claim_id, score and rank by cosine of `embedding` columns (vectors of one length, none null). Each query
    meets every claim, in blocks; a block's candidates by matrix product are scored again from left to right, so equal
    vectors have equal scores wherever they lie, and its best top_k go on. A zero vector's cosines are null, and last."""
    asked, own = queries.select(query_key, F.col("embedding").cast("array<double>").alias("v")), claims.select("claim_id", F.col("embedding").cast("array<double>").alias("v"))
    fold = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("claim_id")
        x, y = vector_matrix(left["v"]), vector_matrix(right["v"])
        nx, ny = np.sqrt(fold(x, x)), np.sqrt(fold(y, y))
        norms = nx[:, None] * ny
        rough = np.divide(x @ y.T, norms, out=np.full(norms.shape, -2.0), where=norms > 0)
        kth = np.partition(rough, -top_k, axis=1)[:, [-top_k]] if top_k < rough.shape[1] else np.full((len(x), 1), -2.0)
        i, j = np.nonzero(rough >= kth - 1e-9)
        exact = np.full(rough.shape, -np.inf)
        for a in range(0, len(i), 65536):
            r, c = i[a : a + 65536], j[a : a + 65536]
            exact[r, c] = np.where(norms[r, c] > 0, fold(x[r], y[c]) / np.where(norms[r, c] > 0, norms[r, c], 1.0), -2.0)
        i, j = best_columns(exact, top_k)
        return pa.table({query_key: left[query_key].take(i), "claim_id": right["claim_id"].take(j), "score": pa.array(exact[i, j], mask=exact[i, j] == -2.0)})

    schema = f"{query_key} {dict(asked.dtypes)[query_key]}, claim_id {dict(own.dtypes)['claim_id']}, score double"
    order = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("score"), "claim_id")
    return in_blocks(asked, own, best, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select(query_key, "claim_id", "score", "rank")


def memory_stats(claims: DataFrame) -> DataFrame:
    return claims.groupBy("status").agg(F.count("*").alias("claims"))


def json_verdict(reply: Column) -> Column:
    """verified, confidence and reason of a JSON reply; an unreadable one verifies nothing."""
    got = F.from_json(reply, "verified boolean, confidence double, reason string")
    bad = F.struct(F.lit(False).alias("verified"), F.lit(None).cast("double").alias("confidence"), F.lit("LLM verification failed").alias("reason"))
    return F.when(got.isNull() | (got["verified"].isNull() & got["confidence"].isNull() & got["reason"].isNull()), bad).otherwise(F.struct(F.coalesce(got["verified"], F.lit(False)).alias("verified"), got["confidence"].alias("confidence"), got["reason"].alias("reason")))


def agent_verify(texts: DataFrame, facts: DataFrame, claims: DataFrame, key: str, replies: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """key, status, confidence, summary, audit (the steps taken) and stored (claim_id of what enters the memory).
    replies: key, reply - asked for only where the knowledge base knows nothing."""
    cached = retrieve_keyword(texts, key, claims, 3, 0.8).groupBy(key).agg(F.count("*").alias("cached"))
    out = prove(texts, facts, key, threshold=threshold).join(cached, key, "left")
    if replies is not None:
        out = out.join(replies.select(key, json_verdict(F.col("reply")).alias("llm")), key, "left")
    else:
        out = out.withColumn("llm", F.lit(None).cast("struct<verified:boolean,confidence:double,reason:string>"))
    asked = (F.col("status") == "unverifiable") & F.col("llm").isNotNull()
    taken = asked & F.coalesce(F.col("llm.verified"), F.lit(False))
    status = F.when(taken, "verified").otherwise(F.col("status"))
    confidence = F.when(taken, F.coalesce("llm.confidence", F.lit(0.7))).otherwise(F.col("confidence"))
    method = F.when(taken, "llm_verification").otherwise("kb_probe")
    summary = F.when(status == "verified", F.concat(F.lit("Verified with "), percent(confidence), F.lit(" confidence via "), method)).when(status == "refuted", F.concat(F.lit("Refuted: "), F.col("reason"))).otherwise("Could not verify - insufficient evidence")
    stored = F.when(F.col("status") == "verified", F.col("claim_id"))
    step = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    audit = F.concat(step(F.col("cached") > 0, F.concat(F.lit("cache_check: "), F.col("cached").cast("string"))), F.array(F.concat(F.lit("kb_probe: "), F.col("status"))), step(stored.isNotNull(), F.concat(F.lit("memory_store: "), stored)), step(asked, F.lit("llm_fallback")))
    return out.select(key, status.alias("status"), confidence.alias("confidence"), summary.alias("summary"), audit.alias("audit"), stored.alias("stored"))


def rag_context(hits: DataFrame, query_key: str, claims: DataFrame) -> DataFrame:
    """query_key and context: a heading and a line per retrieved claim, in rank order."""
    line = F.concat(F.lit("- "), F.concat_ws(" ", "subject", "predicate", "object"), F.lit(" (confidence: "), percent(F.col("confidence")), F.lit(")"))
    each = hits.join(claims.select("claim_id", "subject", "predicate", "object", "confidence"), "claim_id").select(query_key, F.struct("rank", line.alias("line")).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"])
    return each.groupBy(query_key).agg(F.concat(F.lit("Verified facts:\n"), F.array_join(lines, "\n")).alias("context"))


# ---- provenance and consensus --------------------------------------------------------------------------------------


def trusted(status: Column, confidence: Column) -> Column:
    return status.isin("verified", "derived") & (confidence >= 0.9)


def provenance_chain(records: Column) -> Column:
    """records: array of struct(source_type, source_id, confidence)."""
    return F.array_join(F.transform(records, lambda r: F.concat(F.lit("["), r["source_type"], F.lit("] "), r["source_id"], F.lit(" (conf="), F.format_string("%.2f", r["confidence"]), F.lit(")"))), " → ")


def agreed(extractions: DataFrame, models: int) -> DataFrame:
    """subject, predicate, object, agree of the claims that more than half of the models state (model, subject, ...)."""
    n = extractions.groupBy("subject", "predicate", "object").agg(F.count_distinct("model").alias("agree"))
    return n.filter(F.col("agree") * 2 > models)


def consensus(claims: DataFrame, graph: DataFrame, initial: float = 0.5, source: str = "batch", models: int = 1) -> DataFrame:
    """claims: subject, predicate, object; graph: the same key (the first object by name of a repeated one) with object,
    confidence, status. Unknown keys enter as generated; equal objects gain 0.1; others make the key contested. Adds the
    provenance record (source_type, source_id, confidence) that the claim brings."""
    g = graph.groupBy("subject", "predicate").agg(F.min(F.struct(F.col("object").alias("o"), F.col("confidence").alias("c"), F.col("status").alias("s"))).alias("g"))
    g = g.select("subject", "predicate", F.col("g.o").alias("g_object"), F.col("g.c").alias("g_confidence"), F.col("g.s").alias("g_status"))
    j = claims.join(g, ["subject", "predicate"], "left")
    new, same = F.col("g_object").isNull(), F.col("g_object") == F.col("object")
    record = lambda kind, of, c: F.struct(F.lit(kind).alias("source_type"), F.lit(of).alias("source_id"), F.lit(c).alias("confidence"))
    provenance = F.when(new, record("llm_consensus", f"{models} LLMs agreed", initial)).when(same, record("confirmation", source, 0.9)).otherwise(record("llm_consensus", source, initial))
    return j.select("subject", "predicate", "object", F.when(new, "llm_generated").when(same, F.col("g_status")).otherwise("contested").alias("status"), F.when(new, F.lit(initial)).when(same, F.least(F.lit(1.0), F.col("g_confidence") + 0.1)).otherwise(F.col("g_confidence")).alias("confidence"), F.when(~new & ~same, F.col("object")).alias("alternative"), provenance.alias("provenance"))


def trust_report(claims: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    out = claims.agg(F.count("*").alias("total_claims"), F.coalesce(n("verified"), F.lit(0)).alias("verified"), F.coalesce(n("contested"), F.lit(0)).alias("contested"))
    return out.select("*", (F.col("total_claims") - F.col("verified") - F.col("contested")).alias("llm_generated"), F.when(F.col("total_claims") > 0, F.col("verified") / F.col("total_claims")).otherwise(0.0).alias("trust_ratio"))


def verbalize(claims: DataFrame, key: str, seq: str) -> DataFrame:
    """key, text (a sentence per claim, in order) and the smallest confidence."""
    line = F.concat(F.concat_ws(" ", "subject", "predicate", "object"), F.lit("."))
    each = claims.select(key, F.struct(F.col(seq), line.alias("line")).alias("l"), "confidence")
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), " ").alias("text"), F.min("confidence").alias("confidence"))
