"""Probing: the unit cases, the labelled corpus' golden figures, and the bucket plan against scoring all pairs."""

import math

import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import kb, memory, probe
from factloom.sources import fixtures, io

FACTS = [("Albert Einstein", "discovered", "the theory of relativity"), ("Albert Einstein", "born_in", "Germany"), ("Marie Curie", "discovered", "radium"), ("Alexander Graham Bell", "invented", "the telephone"), ("The Eiffel Tower", "located_in", "Paris"), ("Paris", "is_capital_of", "France")]


@pytest.fixture(scope="module")
def facts(spark):
    return kb.build_facts(spark.createDataFrame([(k, *f) for k, f in enumerate(FACTS)], "fact_seq long, subject string, predicate string, object string")).persist()


def verdicts(spark, facts, texts, threshold=0.7, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: r for r in probe.probe_texts(df, facts, "k", threshold=threshold, **options).filter("claim_idx = 0").collect()}


def test_unit_cases(spark, facts):
    texts = ["The Eiffel Tower is located in Paris.", "Einstein discovered relativity.", "Albert Einstein was born in France.", "The Eiffel Tower is located in London.", "Marie Curie invented pizza.", "Hello there!", "Paris is the capital of France.", "Thomas Edison invented the internet."]
    got = verdicts(spark, facts, texts)
    assert [got[k].verdict for k in range(8)] == ["PASS", "SOFT_PASS", "CONTRADICT", "CONTRADICT", "FAIL", "UNKNOWN", "PASS", "FAIL"]
    assert got[1].score == pytest.approx(0.30 / math.sqrt(3) + 0.45 + 0.25 / math.sqrt(7))
    assert got[7].score == pytest.approx(0.45 + 0.25 / 3)
    assert verdicts(spark, facts, texts[1:2], 0.75)[0].verdict == "FAIL"
    assert verdicts(spark, facts, texts[2:3], contradiction_check=False)[0].verdict != "CONTRADICT"


def test_empty_kb(spark):
    empty = kb.build_facts(spark.createDataFrame([], "fact_seq long, subject string, predicate string, object string"))
    got = verdicts(spark, empty, ["Bell invented the telephone."])[0]
    assert (got.verdict, got.score, got.matched_facts) == ("FAIL", 0.0, [])


def test_scores_equal_all_pairs(spark, facts):
    """closest over bucket pairs = closest over the full cross product."""
    from tests.test_text import plain_buckets

    def cos(a, b):
        p, q = plain_buckets(a), plain_buckets(b)
        dot = sum(p[x] * q[x] for x in p)
        return dot / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values())) if dot else 0.0

    triples = [("Newton", "discovered", "light"), ("xyz", "abc", "qqq"), ("Paris", "invented", "the radio"), ("Marie Curie", "located_in", "Paris")]
    got = {(r.subject, r.predicate, r.object): (r.rel_id, r.score) for r in probe.closest(spark.createDataFrame(triples, "subject string, predicate string, object string"), facts).collect()}
    rows = facts.orderBy("fact_seq").collect()
    for s, p, o in triples:
        scored = [0.30 * cos(s, f.s_label) + 0.45 * cos(p, f.p_canon2) + 0.25 * cos(o, f.o_label) for f in rows]
        best = max(range(len(rows)), key=lambda k: (scored[k], -k))
        assert got[s, p, o] == (rows[best].rel_id, pytest.approx(scored[best], abs=1e-12))


def test_labelled_corpus(spark):
    """44 of 66, by set 10/16/12/3/3, by type 21/5/9/9, score 69.1, level MODERATE."""
    m = {(r.algo, r.level_of, r.set_key or r.h_type): r.passed for r in queries.QUERIES["eval_metrics"](spark, "").collect()}
    assert m["kb_probe", "all", None] == 44
    assert [m["kb_probe", "set", s] for s in fixtures.CASES] == [10, 16, 12, 3, 3]
    assert [m["kb_probe", "type", t] for t in ("true_fact", "false_attr", "contradiction", "fabrication")] == [21, 5, 9, 9]
    c = {r.algo: r for r in queries.QUERIES["coverage_score"](spark, "").collect()}
    assert round(c["kb_probe"].score, 1) == 69.1 and c["kb_probe"].level == "MODERATE"
    assert m["judge", "all", None] == 5 and round(c["judge"].score, 1) == 7.3 and c["judge"].level == "MINIMAL"


def test_proof_and_io(spark, facts, tmp_path):
    rel = facts.filter("fact_seq = 4").select("rel_id")
    assert {r.role for r in kb.proof(facts, rel).collect()} == {"subj", "obj"}
    keep = facts.select("fact_seq", "subject", "predicate", "object", "confidence", "source")
    io.save(keep, str(tmp_path / "kb"))
    assert io.load(spark, str(tmp_path / "kb"), io.FACTS).count() == len(FACTS)
    assert io.load(spark, str(tmp_path / "none"), io.FACTS).count() == 0
    assert kb.kb_stats(facts).first().edges == 2 * len(FACTS)
    grown = kb.add_facts(facts, spark.createDataFrame([(99, "PARIS", "is in", "Europe")], "fact_seq long, subject string, predicate string, object string"))
    assert grown.filter("fact_seq = 99").first().s_label == "Paris"  # the first spelling stays
    res = probe.probe_texts(spark.createDataFrame([(0, "Paris is the capital of France.")], "k int, text string"), facts, "k")
    assert '"verdict":"PASS"' in io.report_json(res, probe.report(res, "k"), "k").first().json


def test_prove_and_agent(spark, facts):
    texts = spark.createDataFrame([(0, "The Eiffel Tower is located in Paris."), (1, "Albert Einstein was born in France."), (2, "Hello there!")], "k int, text string")
    got = {r.k: (r.status, r.confidence) for r in memory.prove(texts, facts, "k").collect()}
    assert got == {0: ("verified", 1.0), 1: ("refuted", 0.9), 2: ("unverifiable", 0.5)}
    claims = spark.createDataFrame([("c1", 0, "eiffel tower is in paris", "s", "p", "o", "verified", 0.9)], io.CLAIMS)
    replies = texts.select("k", F.lit('{"verified": true, "confidence": 0.6}').alias("reply"))
    out = {r.k: r for r in memory.agent_verify(texts, facts, claims, "k", replies).collect()}
    assert out[0].summary == "Verified with 100% confidence via kb_probe" and out[0].stored and out[0].audit[0] == "cache_check: 1"
    assert out[1].summary.startswith("Refuted: Contradicts 1") and out[2].status == "verified" and out[2].confidence == 0.6
