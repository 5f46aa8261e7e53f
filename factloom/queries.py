"""The queries that the driver runs, each over its whole tables, with DuckDB oracles in factloom.plans.oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import similarity as sim
from factloom.functions import text as tx
from factloom.operators import evaluate, extract, ground, kb, memory, mirror, probe, store, strategies
from factloom.plans import slices
from factloom.plans.oracles import ORACLE
from factloom.plans.slices import THRESHOLD, dealt, read
from factloom.sources import fixtures, io

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- functions -----------------------------------------------------------------------------------------------------


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return dealt(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("idx", "sentence"))


@query
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", tx.norm_text(F.col("text")).alias("norm"))


@query
def canon_predicate(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.element_at(F.array(F.lit("is "), F.lit("Was_"), F.lit("be "), F.lit("has ")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", tx.canon_predicate(c).alias("predicate"))


@query
def claim_keys(spark: SparkSession, d: str) -> DataFrame:
    f = slices.fact_rows(spark, d)
    return f.select("fact_seq", tx.claim_id(F.col("subject"), F.col("predicate"), F.col("object")).alias("claim_id"), tx.signature(F.col("subject"), F.col("predicate"), F.col("object")).alias("sig"), tx.cache_key(F.col("subject")).alias("cache_key"))


@query
def hash_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.array_join(tx.hash_tokens(F.concat_ws(" ", "p_name", "p_type")), ",").alias("tokens"))


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    b = sim.buckets(read(spark, d, "part"), "p_name")
    return b.select("p_name", "bucket", F.round(F.col("n") / F.sqrt(F.col("norm2").cast("double")), 6).alias("v"))


@query
def hash_cosines(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    out = sim.cosines(p.withColumnRenamed("p_name", "a"), "a", p.withColumnRenamed("p_type", "b").withColumn("b", F.concat_ws(" ", "p_name", "b")), "b", "cos")
    return out.select("a", "b", F.round("cos", 6).alias("cos"))


@query
def sha_embed(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "nation").select("n_nationkey", F.posexplode(sim.sha_embed(F.col("n_name"))).alias("i", "v"))
    return e.select("n_nationkey", "i", F.round("v", 6).alias("v"))


@query
def string_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", F.round(sim.text_ratio(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("ratio"))


@query
def no_encoding(spark: SparkSession, d: str) -> DataFrame:
    """What stands for embeddings where there is no encoder, and what is compared instead."""
    return read(spark, d, "part").select("p_partkey", F.element_at(sim.no_encoding(), 1).alias("encoded"), tx.norm_text(F.col("p_name")).alias("compared"))


@query
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    heads = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("h"))
    j = e.join(F.broadcast(heads), "label")
    return j.select("vec_id", F.round(sim.cosine(F.col("v"), F.col("h")), 6).alias("cos"), F.round(sim.cosine(F.col("v"), F.col("h"), epsilon=1e-9), 6).alias("cos_eps"))


# ---- extraction ----------------------------------------------------------------------------------------------------


@query
def extract_claims_documents(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_claims(dealt(spark, d, "documents"), "doc_id")


@query
def extract_claims_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = dealt(spark, d, "conversations").withColumn("key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return extract.extract_claims(c, "key")


@query
def extract_claims_generated(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_claims(slices.texts(spark, d), "text_id")


@query
def json_extract_claims(spark: SparkSession, d: str) -> DataFrame:
    return extract.with_fallback(slices.json_replies(spark, d), "event_id", "text", "reply")


@query
def hybrid_extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.hybrid_claims(slices.json_replies(spark, d), "event_id", "text", "reply")


@query
def parse_triples(spark: SparkSession, d: str) -> DataFrame:
    t = slices.texts(spark, d)
    return t.select("text_id", extract.parse_triple(F.col("text"), extract.EXTERNAL_VERBS, True).alias("e"), extract.parse_triple(F.col("text"), extract.GROUND_VERBS).alias("g")).select("text_id", F.concat_ws("|", "e.subject", "e.predicate", "e.object").alias("external"), F.concat_ws("|", "g.subject", "g.predicate", "g.object").alias("ground"))


# ---- knowledge base and probing ------------------------------------------------------------------------------------


@query
def kb_facts(spark: SparkSession, d: str) -> DataFrame:
    return slices.facts(spark, d)


@query
def kb_entities(spark: SparkSession, d: str) -> DataFrame:
    return kb.entities(slices.facts(spark, d))


@query
def kb_edges(spark: SparkSession, d: str) -> DataFrame:
    return kb.edges(slices.facts(spark, d))


@query
def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return kb.kb_stats(slices.facts(spark, d))


@query
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    c = extract.extract_claims(slices.texts(spark, d), "text_id")
    return probe.exact_matches(c, slices.facts(spark, d)).select("text_id", "claim_idx", "rel_id")


@query
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    c = extract.extract_claims(slices.texts(spark, d), "text_id")
    found = probe.contradictions(c, slices.facts(spark, d), ["text_id", "claim_idx"])
    return found.select("text_id", "claim_idx", F.array_join(F.transform("contradicting", lambda x: F.concat_ws("|", x["subject"], x["predicate"], x["object"])), ";").alias("facts"))


@query
def soft_match_topk(spark: SparkSession, d: str) -> DataFrame:
    c = extract.extract_claims(slices.texts(spark, d), "text_id")
    m = probe.soft_matches(c, slices.facts(spark, d), THRESHOLD, 3)
    return m.select("subject", "predicate", "object", "rank", "fact_seq", F.round("score", 6).alias("score"))


@query
def closest_fact(spark: SparkSession, d: str) -> DataFrame:
    c = extract.extract_claims(slices.texts(spark, d), "text_id")
    return probe.closest(c, slices.facts(spark, d)).select("subject", "predicate", "object", "rel_id", F.round("score", 6).alias("score"))


def _probed(spark: SparkSession, d: str) -> DataFrame:
    return probe.probe_texts(slices.texts(spark, d), slices.facts(spark, d), "text_id", threshold=THRESHOLD)


@query
def probe_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _probed(spark, d).select("text_id", "claim_idx", "subject", "predicate", "object", "verdict", F.round("score", 6).alias("score"), F.array_join(F.transform("matched_facts", lambda x: F.concat_ws("|", x["subject"], x["predicate"], x["object"])), ";").alias("matched"), "reason")


@query
def probe_report(spark: SparkSession, d: str) -> DataFrame:
    return probe.report(_probed(spark, d), "text_id")


@query
def proof_subgraph(spark: SparkSession, d: str) -> DataFrame:
    found = _probed(spark, d).filter("proof_rel IS NOT NULL").select(F.col("proof_rel").alias("rel_id"))
    return kb.proof(slices.facts(spark, d), found)


@query
def proof_json(spark: SparkSession, d: str) -> DataFrame:
    found = _probed(spark, d).filter("proof_rel IS NOT NULL").select(F.col("proof_rel").alias("rel_id"))
    return kb.proof_json(slices.facts(spark, d), found)


@query
def proof_gexf(spark: SparkSession, d: str) -> DataFrame:
    found = _probed(spark, d).filter("proof_rel IS NOT NULL").select(F.col("proof_rel").alias("rel_id"))
    return io.proof_gexf(slices.facts(spark, d), found)


@query
def report_text(spark: SparkSession, d: str) -> DataFrame:
    found = _probed(spark, d)
    return io.report_text(found, probe.report(found, "text_id"), slices.texts(spark, d), "text_id")


# ---- memory --------------------------------------------------------------------------------------------------------


@query
def prove(spark: SparkSession, d: str) -> DataFrame:
    p = memory.prove(slices.texts(spark, d), slices.facts(spark, d), "text_id")
    return p.select("text_id", "status", F.round("confidence", 6).alias("confidence"), "verdict", "claim_id")


@query
def claim_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("claim_id"), F.col("event_id").alias("seq"), "value")
    return memory.upsert(e)


@query
def claim_keywords(spark: SparkSession, d: str) -> DataFrame:
    return memory.claim_keywords(slices.memory(spark, d))


@query
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.memory_stats(slices.memory(spark, d))


@query
def memory_retrieve_keyword(spark: SparkSession, d: str) -> DataFrame:
    hits = memory.retrieve_keyword(dealt(spark, d, "documents").select("doc_id", "text"), "doc_id", slices.memory(spark, d))
    return hits.select("doc_id", "claim_id", F.round("score", 6).alias("score"), "rank")


@query
def memory_retrieve_vector(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    hits = memory.retrieve_vector(asked, "query_id", e.withColumnRenamed("vec_id", "claim_id"))
    return hits.select("query_id", "claim_id", F.round("score", 6).alias("score"), "rank")


@query
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    m = slices.memory(spark, d)
    asked = read(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text")
    return memory.rag_context(memory.retrieve_keyword(asked, "key", m), "key", m)


@query
def agent_verify(spark: SparkSession, d: str) -> DataFrame:
    t = slices.texts(spark, d)
    reply = F.when(F.col("text_id") % 2 == 0, '{"verified": true, "confidence": 0.8, "reason": "known"}').otherwise("not json")
    out = memory.agent_verify(t, slices.facts(spark, d), slices.memory(spark, d), "text_id", t.select("text_id", reply.alias("reply")))
    return out.select("text_id", "status", F.round("confidence", 6).alias("confidence"), F.col("stored"), F.size("audit").alias("steps"))


@query
def consensus_ingest(spark: SparkSession, d: str) -> DataFrame:
    r = slices.fact_rows(spark, d)
    known = r.filter("fact_seq % 3 <> 0").select("subject", "predicate", F.when(F.col("fact_seq") % 3 == 1, F.col("object")).otherwise("elsewhere").alias("object"), F.when(F.col("fact_seq") % 2 == 0, 0.95).otherwise(0.6).alias("confidence"), F.lit("verified").alias("status"))
    return memory.consensus(r.select("subject", "predicate", "object"), known).select("subject", "predicate", "object", "status", F.round("confidence", 6).alias("confidence"), "alternative")


@query
def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    """Three models state the facts, each with its own gaps and errors; what most of them state meets a graph."""
    r, seq = slices.fact_rows(spark, d), F.col("fact_seq")
    said = r.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("model"), "subject", "predicate", "object", "fact_seq")
    said = said.filter((seq + F.col("model")) % 4 != 0).select("model", "subject", "predicate", F.when((seq * 5 + F.col("model") * 2) % 7 == 0, "nowhere").otherwise(F.col("object")).alias("object"))
    known = r.filter("fact_seq % 3 <> 0").select("subject", "predicate", F.when(seq % 3 == 1, F.col("object")).otherwise("elsewhere").alias("object"), F.lit(0.6).alias("confidence"), F.lit("verified").alias("status"))
    out = memory.consensus(memory.agreed(said, 3), known, source="vote", models=3)
    return out.select("subject", "predicate", "object", "status", F.round("confidence", 6).alias("confidence"), "alternative", memory.provenance_chain(F.array("provenance")).alias("provenance"))


@query
def trust_report(spark: SparkSession, d: str) -> DataFrame:
    return memory.trust_report(consensus_ingest(spark, d)).withColumn("trust_ratio", F.round("trust_ratio", 6))


@query
def verbalize(spark: SparkSession, d: str) -> DataFrame:
    r = slices.facts(spark, d)
    return memory.verbalize(r.withColumn("confidence", F.lit(1.0) / (F.col("fact_seq") % 7 + 1)), "object", "fact_seq").select(F.col("object").alias("place"), "text", F.round("confidence", 6).alias("confidence"))


@query
def provenance(spark: SparkSession, d: str) -> DataFrame:
    m = slices.memory(spark, d)
    rec = lambda kind, c: F.struct(F.lit(kind).alias("source_type"), F.col("claim_id").alias("source_id"), c.alias("confidence"))
    return m.select("claim_id", memory.provenance_chain(F.array(rec("kb", F.col("confidence")), rec("review", F.lit(0.5)))).alias("chain"), memory.trusted(F.col("status"), F.col("confidence")).alias("trusted"))


# ---- ground truth --------------------------------------------------------------------------------------------------


def _propositions(spark: SparkSession, d: str) -> DataFrame:
    r = slices.fact_rows(spark, d)
    return r.select(F.col("fact_seq").alias("seq"), "subject", "predicate", "object", F.concat_ws(" ", "subject", F.replace(F.col("predicate"), F.lit("_"), F.lit(" ")), "object").alias("raw_text"), F.lit(1.0).alias("confidence"))


@query
def ground_truth_store(spark: SparkSession, d: str) -> DataFrame:
    return ground.store(_propositions(spark, d))["propositions"].drop("seq")


@query
def ground_truth_stats(spark: SparkSession, d: str) -> DataFrame:
    return ground.store_stats(ground.store(_propositions(spark, d)))


@query
def ground_truth_check(spark: SparkSession, d: str) -> DataFrame:
    return ground.check(slices.texts(spark, d), "text_id", _propositions(spark, d)).select("text_id", "status", F.round("confidence", 6).alias("confidence"), "matched")


@query
def ground_truth_decompose(spark: SparkSession, d: str) -> DataFrame:
    return ground.decompose(slices.texts(spark, d), "text_id", ground.store(_propositions(spark, d)))


@query
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    entities = n.select(F.concat(F.lit("entity_"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("at"), F.array(F.concat(F.lit("Land "), "n_nationkey")).alias("aliases"))
    asked = n.select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit("LAND "), "n_nationkey"), F.concat(F.lit("Isle "), "n_nationkey"))).alias("name"))
    return ground.resolve_entities(asked, entities)


@query
def entity_resolve_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names meet the nations as entities; every second one comes again in another spelling."""
    c, k = read(spark, d, "supplier"), F.col("s_suppkey")
    seen = c.select((k * 2).alias("seq"), F.col("s_name").alias("name")).unionByName(c.filter("s_suppkey % 2 = 0").select((k * 2 + 1).alias("seq"), F.upper("s_name").alias("name")))
    s = read(spark, d, "nation").select(F.concat(F.lit("entity_"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("at"), F.array(F.concat(F.lit("Supplier#"), F.lpad((F.col("n_nationkey") * 3).cast("string"), 9, "0"))).alias("aliases"))
    return ground.resolve_in_order(seen, s)


def _stored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = _propositions(spark, d)
    return store.store_verified(r.select("seq", "subject", "predicate", "object", "raw_text", F.lit("verified").alias("status"), ((F.col("seq") % 10 + 1) / 10.0).alias("confidence"), F.lit("kb").alias("source_type"), F.concat(F.lit("src"), (F.col("seq") % 7).cast("string")).alias("source_id")))


def _asked_nations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit(" is part of somewhere")).alias("text"))


@query
def concept_store(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)["concepts"].select("uuid", "version", "prototype", "text", F.try_element_at("props", F.lit("confidence")).alias("confidence"))


@query
def concept_links(spark: SparkSession, d: str) -> DataFrame:
    t = _stored(spark, d)
    asked = t["concepts"].filter("prototype = 'Claim'")
    return store.associations_of(asked, t["associations"]).select("uuid", "type", "to", F.round("weight", 6).alias("weight"))


@query
def concept_history(spark: SparkSession, d: str) -> DataFrame:
    """Every third claim is stored again, as refuted, and all versions are read."""
    t = _stored(spark, d)
    again = t["concepts"].filter("prototype = 'Verification_result'").withColumn("seq", F.regexp_extract("uuid", r"(\d+)$", 1).cast("long")).filter("seq % 3 = 0")
    grown = store.add_concepts(t["concepts"], again.select("seq", "uuid", "prototype", F.replace("text", F.lit("verified"), F.lit("refuted")).alias("text"), "props"))
    return store.history(grown, again)


@query
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    return store.search(_asked_nations(spark, d), "n_nationkey", store.latest(_stored(spark, d)["concepts"])).withColumn("similarity", F.round("similarity", 6))


@query
def concept_context(spark: SparkSession, d: str) -> DataFrame:
    return store.context(store.retrieve(_asked_nations(spark, d), "n_nationkey", _stored(spark, d)), "n_nationkey")


# ---- strategies ----------------------------------------------------------------------------------------------------


@query
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    r = slices.judged_texts(spark, d).withColumn("key", F.concat_ws(":", F.col("text_id").cast("string"), F.col("sample").cast("string")))
    return strategies.judge(r, "key")


@query
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    return strategies.self_consistency(slices.judged_texts(spark, d), "text_id").withColumn("confidence", F.round("confidence", 6))


@query
def cross_model(spark: SparkSession, d: str) -> DataFrame:
    return strategies.cross_model(slices.judged_texts(spark, d), "text_id").withColumn("confidence", F.round("confidence", 6))


@query
def mock_judge(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.cases(spark).select("case_id", strategies.mock_judge(F.col("text")).alias("reply"))


def _by_sample(df: DataFrame) -> DataFrame:
    """A row per text and sample of the judge's replies, keyed text_id:sample."""
    each = df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return each.withColumn("key", F.concat_ws(":", F.col("text_id").cast("string"), F.col("sample").cast("string"))).drop("text_id", "sample")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return strategies.judge(slices.judged_texts(spark, d).withColumn("key", F.concat_ws(":", F.col("text_id").cast("string"), F.col("sample").cast("string"))), "key")


@query
def kb_strategy(spark: SparkSession, d: str) -> DataFrame:
    return memory.kb_strategy(_probed(spark, d), "text_id").withColumn("confidence", F.round("confidence", 6))


@query
def hybrid_strategy(spark: SparkSession, d: str) -> DataFrame:
    own = _by_sample(memory.kb_strategy(_probed(spark, d), "text_id"))
    return strategies.hybrid(own, _judged(spark, d), "key").withColumn("confidence", F.round("confidence", 6))


@query
def external_verify(spark: SparkSession, d: str) -> DataFrame:
    return strategies.external_verify(fixtures.cases(spark), "case_id", slices.inventors(spark))


@query
def external_cached(spark: SparkSession, d: str) -> DataFrame:
    """The labelled cases asked twice, against a cache that holds a third of them."""
    cases, inv = fixtures.cases(spark), slices.inventors(spark)
    before = cases.filter("case_id % 3 = 0").select(F.col("case_id").alias("call_id"), "text")
    _, cache = mirror.verify_cached(before, "call_id", "call_id", inv, spark.createDataFrame([], mirror.CACHE))
    calls = cases.select(F.explode(F.array(F.struct(F.col("case_id").alias("call_id"), "text"), F.struct((F.col("case_id") + 100).alias("call_id"), F.concat(F.lit(" "), F.lower("text")).alias("text")))).alias("c")).select("c.*")
    return mirror.verify_cached(calls, "call_id", "call_id", inv, cache)[0].select("call_id", "status", "confidence", "hit")


@query
def external_cache_after(spark: SparkSession, d: str) -> DataFrame:
    cases = fixtures.cases(spark).select(F.col("case_id").alias("call_id"), "text")
    return mirror.verify_cached(cases, "call_id", "call_id", slices.inventors(spark), spark.createDataFrame([], mirror.CACHE))[1].select("cache_key", "claim", "status", "confidence")


@query
def item_search(spark: SparkSession, d: str) -> DataFrame:
    items = slices.items(spark, d)
    names = read(spark, d, "customer").select(F.upper("c_name").alias("name")).unionByName(read(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit("x")).alias("name"))).unionByName(items.select(F.col("label").alias("name")))
    return mirror.search_items(names, items)


@query
def item_values(spark: SparkSession, d: str) -> DataFrame:
    asked = slices.items(spark, d).filter("item_id LIKE 'N%'").select("item_id", F.lit("inhabitant").alias("property"))
    return mirror.item_values(asked, slices.item_values(spark, d))


@query
def cascade(spark: SparkSession, d: str) -> DataFrame:
    local = _by_sample(memory.prove(slices.texts(spark, d), slices.facts(spark, d), "text_id").select("text_id", "status", "confidence"))
    ext = _by_sample(strategies.external_verify(slices.texts(spark, d), "text_id", slices.inventors(spark)))
    return strategies.cascade(local, ext, _judged(spark, d), "key").withColumn("confidence", F.round("confidence", 6))


@query
def semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    calls = e.select("event_id", F.concat(F.lit(" User "), F.col("user_id").cast("string"), F.lit(" "), F.upper("event_type")).alias("text"), F.when(F.col("value") > 50, "PASS").otherwise("FAIL").alias("verdict"), F.lit(0.8).alias("confidence"))
    return strategies.semantic_cache(calls, "event_id", "event_id").withColumn("confidence", F.round("confidence", 6))


@query
def semantic_cache_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    calls = e.select("vec_id", "embedding", F.when(F.col("label") % 2 == 0, "PASS").otherwise("FAIL").alias("verdict"), F.lit(0.8).alias("confidence"))
    return strategies.semantic_cache_vectors(calls, "vec_id").withColumn("confidence", F.round("confidence", 6))


# ---- evaluation ----------------------------------------------------------------------------------------------------


def _results(spark: SparkSession) -> DataFrame:
    """The labelled cases under the algorithms that have an SQL form; latencies are parameters, not measured."""
    cases, facts = fixtures.cases(spark), kb.build_facts(fixtures.evaluation_facts(spark))
    lat = lambda x: F.lit(x).alias("latency_ms")
    samples = cases.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))), strategies.mock_judge(F.col("text")).alias("reply"))
    con = strategies.self_consistency(samples, "case_id").select(F.lit("self_consistency").alias("algo"), "case_id", "verdict", evaluate.as_bool(F.col("verdict"), "self_consistency").alias("actual"), lat(500.0))
    kbp = probe.probe_texts(cases, facts, "case_id", threshold=THRESHOLD).filter("claim_idx = 0").select(F.lit("kb_probe").alias("algo"), "case_id", "verdict", evaluate.as_bool(F.col("verdict"), "kb_probe").alias("actual"), lat(1.0))
    jud = strategies.judge(cases.select("case_id", strategies.mock_judge(F.col("text")).alias("reply")), "case_id").select(F.lit("judge").alias("algo"), "case_id", "verdict", evaluate.as_bool(F.col("verdict"), "judge").alias("actual"), lat(200.0))
    ext = strategies.external_verify(cases, "case_id", slices.inventors(spark)).select(F.lit("external").alias("algo"), "case_id", F.col("status").alias("verdict"), evaluate.as_bool(F.col("status"), "external").alias("actual"), lat(130.0))
    return evaluate.judged_cases(cases, kbp.union(jud).union(ext).union(con))


def evaluated(spark: SparkSession) -> DataFrame:
    """The results of all algorithms, the memory's too."""
    cases, facts = fixtures.cases(spark), kb.build_facts(fixtures.memory_facts(spark))
    got = memory.prove(cases, facts, "case_id", similar="ratio").select(F.lit("memory").alias("algo"), "case_id", F.col("status").alias("verdict"), evaluate.as_bool(F.col("status"), "memory").alias("actual"), F.lit(0.6).alias("latency_ms"))
    return _results(spark).unionByName(evaluate.judged_cases(cases, got))


@query
def eval_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark).select("algo", "case_id", "verdict", "passed")


@query
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(_results(spark)).select("algo", "level_of", "set_key", "h_type", "tested", "passed", F.round("rate", 6).alias("rate"), "latency_ms")


@query
def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.coverage(evaluate.metrics(_results(spark)))


@query
def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failures(_results(spark))


@query
def eval_priorities(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.priorities(_results(spark), evaluate.statuses(spark))


@query
def eval_statuses(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.statuses(spark)


@query
def eval_memory(spark: SparkSession, d: str) -> DataFrame:
    """The memory algorithm: its own facts, and string ratios in place of embeddings; the ratio has no SQL form."""
    return evaluated(spark).filter("algo = 'memory'").select("case_id", "verdict", "passed")


@query
def label_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as cases: does 'no claim was extracted' tell low quality?"""
    lab = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    has = F.exists(tx.sentences(F.col("text")), lambda s: s.rlike(r"(?i)\s(is|was|are|were)\s"))
    r = lab.select(F.lit("verbs").alias("algo"), F.col("lang").alias("set_key"), F.when(F.col("quality") == 1, "true_fact").otherwise("fabrication").alias("h_type"), (F.coalesce(has, F.lit(False)) == (F.col("quality") == 1)).alias("passed"), F.lit(1.0).alias("latency_ms"))
    return evaluate.metrics(r).select("level_of", "set_key", "h_type", "tested", "passed", F.round("rate", 6).alias("rate"))
