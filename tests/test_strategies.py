"""Memory, strategies, streaming, and every query against its DuckDB oracle."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import ground, memory, mirror, store, strategies
from factloom.operators.order import openers
from factloom.streaming import caches

SF = "/root/testdata/sf0.001"


def test_upsert_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z")], "claim_id string, seq long, v string")
    assert {tuple(r) for r in memory.upsert(df).collect()} == {("a", 0, "z"), ("b", 1, "y")}


def test_retrieval(spark):
    claims = spark.createDataFrame([("c1", 0, "red fish swims", "verified", 0.9), ("c2", 1, "red fish", "verified", 0.4), ("c3", 2, "red fish", "refuted", 0.9), ("c4", 3, "red fish", "cached", 0.5)], "claim_id string, seq long, text string, status string, confidence double")
    q = spark.createDataFrame([(0, "Red fish"), (1, "blue")], "q int, text string")
    got = [(r.claim_id, r.score) for r in memory.retrieve_keyword(q, "q", claims, 2).orderBy("q", "rank").collect()]
    assert got == [("c1", 1.0), ("c4", 1.0)]
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0])], "claim_id string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.1])], "q int, embedding array<double>")
    assert [r.claim_id for r in memory.retrieve_vector(q, "q", e, 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_judge_edges(spark):
    replies = ["VERDICT: FALSE, not TRUE\nCONFIDENCE: x", "verdict: false\nverdict: maybe\nconfidence: 0.3\nREASONING: a:b", None, "free words"]
    df = spark.createDataFrame(list(enumerate(replies)), "k int, reply string")
    got = {r.k: (r.verdict, r.confidence, r.reasoning) for r in strategies.judge(df, "k").collect()}
    assert got == {0: ("PASS", 0.5, replies[0]), 1: ("UNKNOWN", 0.3, "a:b"), 2: ("UNKNOWN", 0.0, None), 3: ("UNKNOWN", 0.5, "free words")}


def test_votes(spark):
    rows = [(0, "TRUE"), (0, "TRUE"), (0, "true."), (1, "TRUE or FALSE"), (1, "FALSE"), (1, None), (2, None), (2, None), (2, None), (3, "TRUE"), (3, "FALSE"), (3, None)]
    df = spark.createDataFrame(rows, "k int, reply string")
    got = {r.k: (r.verdict, round(r.confidence, 3)) for r in strategies.self_consistency(df, "k").collect()}
    assert got == {0: ("PASS", 1.0), 1: ("FAIL", 0.667), 2: ("UNKNOWN", 0.5), 3: ("UNKNOWN", 0.5)}
    got = {r.k: (r.verdict, r.confidence) for r in strategies.cross_model(df, "k").collect()}
    assert got == {0: ("PASS", 1.0), 1: ("UNKNOWN", 0.0), 2: ("UNKNOWN", 0.0), 3: ("UNKNOWN", 0.0)}


def test_external_variants(spark):
    inv = spark.createDataFrame([("the lamp", "Ann Lee", 0), ("lamp", "Bob", 1), ("orb", None, 2)], "item_label string, value_label string, row_seq long")
    texts = ["Lee invented lamp.", "Lee invented the lamp.", "Zed invented the lamp.", "Zed invented orb.", "Zed invented moon.", "Zed wrote it.", "nothing"]
    got = {r.k: r.status for r in strategies.external_verify(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", inv).collect()}
    assert got == {0: "refuted", 1: "verified", 2: "refuted", 3: "verified", 4: "unverifiable", 5: "unverifiable", 6: "unverifiable"}


def test_ground_store_keeps_first_spelling(spark):
    p = spark.createDataFrame([(0, "Ann", "knows", "Bob", "Ann knows Bob", 1.0), (1, "BOB", "Knows", "Cy", "BOB Knows Cy", 1.0)], "seq long, subject string, predicate string, object string, raw_text string, confidence double")
    t = ground.store(p)
    assert {r.name for r in t["entities"].collect()} == {"Ann", "Bob", "Cy"} and t["predicates"].count() == 1
    got = {(r.part, r.status) for r in ground.decompose(spark.createDataFrame([(0, "ann is nobody")], "k int, text string"), "k", t).collect()}
    assert got == {(0, "verified"), (1, "unverified"), (2, "unverified")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("A x", "2024-01-01 00:00:00", 0), ("a x ", "2024-01-01 00:01:00", 1), ("b", "2024-01-01 00:02:00", 2)]
    df = spark.createDataFrame(rows, "text string, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = caches.first_calls(stream).writeStream.format("memory").queryName("first_calls").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.cache_key for r in spark.sql("SELECT * FROM first_calls").collect()} == {"a x", "b"} and spark.sql("SELECT * FROM first_calls").count() == 2
    claims = stream.select(F.lower(F.trim("text")).alias("claim_id"), "seq", "text")
    store = str(tmp_path / "claims")
    assert caches.current_claims(spark, store) is None
    caches.store_claims(claims, store, str(tmp_path / "cp")).awaitTermination(60)
    now = lambda: {(r.claim_id, r.seq, r.text) for r in caches.current_claims(spark, store).collect()}
    assert now() == {("a x", 0, "a x "), ("b", 2, "b")}
    first = sorted(os.listdir(store))
    spark.createDataFrame([("B ", "2024-01-02 00:00:00", 7)], "text string, ts string, seq long").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    caches.store_claims(claims, store, str(tmp_path / "cp")).awaitTermination(60)
    assert now() == {("a x", 0, "a x "), ("b", 2, "B ")} and first == ["batch=0"] and len(os.listdir(store)) == 2


def test_cached_calls_are_pinned_and_discounted(spark, tmp_path):
    src, pins, out = (str(tmp_path / x) for x in ("in", "pins", "out"))
    schema = "call_id long, seq long, text string, verdict string, confidence double"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        caches.cached_calls(spark.readStream.schema(schema).parquet(src), pins, out, str(tmp_path / "cp")).awaitTermination(60)

    run([(1, 1, "A x", "PASS", 0.8), (2, 2, " a X", "FAIL", 0.5), (3, 3, "b", "FAIL", 0.6)])
    run([(4, 4, "B", "PASS", 0.9), (5, 5, "c", "PASS", 0.4)])
    got = {r.call_id: (r.verdict, r.hit, round(r.confidence, 3), r.external_calls) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("PASS", False, 0.8, 1), 2: ("PASS", True, 0.76, 0), 3: ("FAIL", False, 0.6, 1), 4: ("FAIL", True, 0.57, 0), 5: ("PASS", False, 0.4, 1)}


def test_openers_take_the_earliest(spark):
    rng = random.Random(4)
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a < b}
    want: list[int] = []
    for n in range(60):
        if not any((m, n) in pairs for m in want):
            want.append(n)
    got = openers(spark.range(60).withColumnRenamed("id", "n"), spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert sorted(r.n for r in got.collect()) == want


def test_vector_cache_follows_the_order(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 6))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25, base + rng.normal(size=base.shape) * 0.35, base[:3], np.zeros((2, 6))])
    v = v[rng.permutation(len(v))]
    judged, want = [], {}
    for n, x in enumerate(v):
        sims = [(round(float(x @ v[m] / (np.linalg.norm(x) * np.linalg.norm(v[m]) or np.inf)), 12), -m) for m in judged]
        best = max(sims, default=(0, 0))
        want[n] = -best[1] if best[0] >= 0.9 else n
        judged += [n] * (want[n] == n)
    calls = spark.createDataFrame([(n, list(map(float, x)), f"v{n}", 0.8) for n, x in enumerate(v)], "n long, embedding array<double>, verdict string, confidence double")
    got = {r.n: (r.of, r.verdict, r.hit) for r in strategies.semantic_cache_vectors(calls, "n").collect()}
    assert got == {n: (m, f"v{m}", m != n) for n, m in want.items()} and len(judged) < len(v)


def test_store_versions_links_and_context(spark):
    claims = spark.createDataFrame([(0, "Ann", "knows", "Bob", "Ann knows Bob", "verified", 0.9, "kb", "s1")], "seq long, subject string, predicate string, object string, raw_text string, status string, confidence double, source_type string, source_id string")
    t = store.store_verified(claims)
    assert store.healthy(t) and {r.uuid for r in t["concepts"].collect()} == {"claim_0", "verification_0", "source_0"}
    assert {(r.type, r.to) for r in store.associations_of(t["concepts"], t["associations"]).collect()} == {("verified_by", "verification_0"), ("derived_from", "source_0")}
    assert store.associations_of(t["concepts"], t["associations"], "derived_from").count() == 1
    again = t["concepts"].filter("uuid = 'claim_0'").select(F.lit(0).cast("long").alias("seq"), "uuid", "prototype", F.lit("Ann knows Cy").alias("text"), "props")
    grown = store.add_concepts(t["concepts"], again)
    assert [(r.version, r.text, r.replaced) for r in store.history(grown, again).orderBy("version").collect()] == [(1, "Ann knows Bob", None), (2, "Ann knows Cy", "Ann knows Bob")]
    assert {r.text for r in store.latest(grown).filter("uuid = 'claim_0'").collect()} == {"Ann knows Cy"}
    q = spark.createDataFrame([(1, "ann KNOWS bob"), (2, "verified 0.9 kb 0.0")], "q int, text string")
    found = store.retrieve(q, "q", t, top_k=1, least=0.99).collect()
    assert {(r.q, r.uuid, round(r.similarity, 6), len(r.provenance or [])) for r in found} == {(1, "claim_0", 1.0, 2), (2, "verification_0", 1.0, 0)}
    lines = {r.q: r.context.split("\n")[1] for r in store.context(store.retrieve(q, "q", t, top_k=1, least=0.99), "q").collect()}
    assert lines == {1: "- Ann knows Bob (similarity: 100%)", 2: "- ? ? ? (similarity: 100%)"}


def test_mirror_cache_pins_the_first_result(spark):
    inv = spark.createDataFrame([("lamp", "Ann Lee", 0)], "item_label string, value_label string, row_seq long")
    calls = spark.createDataFrame([(1, "Lee invented lamp."), (2, " lee INVENTED lamp."), (3, "nothing"), (4, "nothing"), (5, "Bo invented lamp.")], "k long, text string")
    done, cache = mirror.verify_cached(calls, "k", "k", inv, spark.createDataFrame([("bo invented lamp.", "x", "verified", 0.95, "pinned")], mirror.CACHE))
    assert {r.k: (r.status, r.hit) for r in done.collect()} == {1: ("verified", False), 2: ("verified", True), 3: ("unverifiable", False), 4: ("unverifiable", False), 5: ("verified", True)}
    assert {r.cache_key for r in cache.collect()} == {"lee invented lamp.", "bo invented lamp."}


def test_command_line_writes_the_report(spark, tmp_path):
    from factloom.__main__ import main

    path = tmp_path / "report.md"
    text = main(["--verbose", "--export", str(path)])
    assert path.read_text() == text and "| kb_probe | available | 67% | MODERATE | 69/100 |" in text and "ground_store | unavailable | N/A" in text
    assert "Fix false attribution" in text and "### Sets: memory" in text and "- judge: " in text


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["sentence_split", "hash_cosines", "kb_facts", "claim_upsert", "memory_retrieve_keyword", "json_extract_claims", "judge_parse", "semantic_cache", "ground_truth_check", "external_verify", "probe_verdicts", "memory_retrieve_vector", "entity_resolve", "entity_resolve_in_order", "semantic_cache_vectors", "external_cached", "concept_context", "report_text", "proof_gexf", "consensus_vote", "eval_priorities"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ["region", "nation", "supplier", "customer", "part", "events", "documents", "embeddings", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(queries.ORACLE[name]).fetchdf())
