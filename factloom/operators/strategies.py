"""Verdict strategies over reply tables: judging, voting, cascades, the external verifier and the semantic cache.

Replies of models are rows (claim key, model or sample, reply; a null reply is an error), so nothing here calls out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import best_columns, in_blocks, vector_matrix
from factloom.functions.text import cache_key, strip
from factloom.operators.extract import EXTERNAL_VERBS, parse_triple
from factloom.operators.order import cut, openers

ROUTED = ["invented", "discovered", "created"]
DISCOUNT, CACHE_DISCOUNT = 0.8, 0.95

# The deterministic judge's cases - words that must both occur, and its reply.
MOCK = [
    (("eiffel", "paris"), "VERDICT: TRUE\nCONFIDENCE: 0.95\nREASONING: The Eiffel Tower is indeed in Paris."),
    (("einstein", "relativity"), "VERDICT: TRUE\nCONFIDENCE: 0.90\nREASONING: Einstein developed the theory of relativity."),
    (("edison", "telephone"), "VERDICT: FALSE\nCONFIDENCE: 0.85\nREASONING: Alexander Graham Bell invented the telephone, not Edison."),
    (("eiffel", "london"), "VERDICT: FALSE\nCONFIDENCE: 0.95\nREASONING: The Eiffel Tower is in Paris, not London."),
]
MOCK_ELSE = "VERDICT: UNCERTAIN\nCONFIDENCE: 0.50\nREASONING: Cannot verify this claim."


def mock_judge(text: Column) -> Column:
    low, out = F.lower(text), F
    for (a, b), reply in MOCK:
        out = out.when(low.contains(a) & low.contains(b), reply)
    return out.otherwise(MOCK_ELSE)


def parse_judgement(reply: Column) -> Column:
    """struct(verdict, confidence, reasoning). A line counts for the first of VERDICT:, CONFIDENCE:, REASONING: that it
    holds; the last line of a kind wins, and an unreadable confidence is passed over."""
    lines = F.split(strip(reply), "\n")
    has = lambda x, word: F.contains(F.upper(x), F.lit(word))
    verdicts = F.filter(lines, lambda x: has(x, "VERDICT:"))
    numbers = F.filter(F.transform(F.filter(lines, lambda x: has(x, "CONFIDENCE:") & ~has(x, "VERDICT:")), lambda x: strip(F.get(F.split(x, ":"), F.lit(1))).try_cast("double")), lambda x: x.isNotNull())
    reasons = F.filter(lines, lambda x: has(x, "REASONING:") & ~has(x, "CONFIDENCE:") & ~has(x, "VERDICT:"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    v = last(verdicts)
    verdict = F.when(v.isNull(), "UNKNOWN").when(has(v, "TRUE"), "PASS").when(has(v, "FALSE"), "FAIL").otherwise("UNKNOWN")
    reasoning = F.coalesce(strip(F.regexp_extract(last(reasons), r"(?s)^[^:]*:(.*)$", 1)), reply)
    return F.when(reply.isNull(), F.struct(F.lit("UNKNOWN").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("reasoning"))).otherwise(F.struct(verdict.alias("verdict"), F.coalesce(last(numbers), F.lit(0.5)).alias("confidence"), reasoning.alias("reasoning")))


def judge(replies: DataFrame, key: str) -> DataFrame:
    return replies.select(key, parse_judgement(F.col("reply")).alias("j")).select(key, "j.*")


def self_consistency(replies: DataFrame, key: str) -> DataFrame:
    """key, verdict, confidence, samples: a vote of the samples; a reply that holds both words votes twice."""
    r = F.upper(strip(F.coalesce("reply", F.lit("ERROR"))))
    n = replies.groupBy(key).agg(F.sum(r.contains("TRUE").cast("long")).alias("t"), F.sum(r.contains("FALSE").cast("long")).alias("f"), F.count("*").alias("samples"))
    t, f, s = F.col("t"), F.col("f"), F.col("samples")
    verdict = F.when(t == s, "PASS").when(f == s, "FAIL").when(t > f, "SOFT_PASS").when(f > t, "FAIL").otherwise("UNKNOWN")
    confidence = F.when((t == s) | (f == s), 1.0).when(t > f, t / s).when(f > t, f / s).otherwise(0.5)
    return n.select(key, verdict.alias("verdict"), confidence.alias("confidence"), "samples")


def cross_model(replies: DataFrame, key: str) -> DataFrame:
    """key, verdict, confidence, valid: models that failed do not count."""
    yes = F.upper("reply").contains("TRUE").cast("double")
    n = replies.groupBy(key).agg(F.avg(yes).alias("a"), F.count("reply").alias("valid"))
    a = F.col("a")
    return n.select(key, F.when(a >= 0.8, "PASS").when(a <= 0.2, "FAIL").otherwise("UNKNOWN").alias("verdict"), F.when(a.isNull(), 0.0).otherwise(F.abs(a - 0.5) * 2).alias("confidence"), "valid")


def hybrid(probed: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """probed and judged: key, verdict, confidence. The knowledge base decides where it passes or contradicts; else the
    judge, at a discount."""
    j = judged.select(key, F.col("verdict").alias("j_verdict"), F.col("confidence").alias("j_confidence"))
    out = probed.join(j, key, "left")
    own = F.col("verdict").isin("PASS", "SOFT_PASS", "CONTRADICT") | F.col("j_verdict").isNull()
    return out.select(key, F.when(own, F.col("verdict")).otherwise(F.col("j_verdict")).alias("verdict"), F.when(own, F.col("confidence")).otherwise(F.col("j_confidence") * DISCOUNT).alias("confidence"), F.when(own, "kb").otherwise("judge").alias("decided_by"))


def external_verify(claims: DataFrame, key: str, inventors: DataFrame, column: str = "text") -> DataFrame:
    """key, status, confidence, reason by a mirror of inventor facts (item_label, value_label, row_seq): the item is
    looked up as given, then with 'the ' in front, then without any 'the '; up to five rows count."""
    c = claims.select(key, parse_triple(F.col(column), EXTERNAL_VERBS, True).alias("t"))
    routed = c.filter(F.col("t.predicate").isin(ROUTED)).select(key, F.col("t.subject").alias("subject"), F.col("t.object").alias("object"))
    variants = F.array("object", F.concat(F.lit("the "), "object"), F.replace(F.col("object"), F.lit("the "), F.lit("")))
    tried = routed.select(key, "subject", F.posexplode(variants).alias("variant", "item_label")).join(inventors.select("item_label", "value_label", "row_seq"), "item_label")
    tried = tried.withColumn("first", F.min("variant").over(Window.partitionBy(key))).filter("variant = first")
    tried = tried.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("row_seq"))).filter("r <= 5")
    label, subject = F.lower(F.coalesce("value_label", F.lit(""))), F.lower("subject")
    hit = label.contains(subject) | subject.contains(label)
    found = tried.groupBy(key).agg(F.min(F.when(hit, F.struct("r", label.alias("label")))).alias("hit"), F.min(F.struct("r", "value_label")).alias("top"))
    j = c.join(found, key, "left")
    t, handled = F.col("t"), F.col("t.predicate").isin(ROUTED)
    status = F.when(F.col("hit").isNotNull(), "verified").when(F.col("top").isNotNull(), "refuted").otherwise("unverifiable")
    confidence = F.when(t.isNull(), 0.0).when(F.col("hit").isNotNull(), 0.95).when(F.col("top").isNotNull(), 0.9).otherwise(0.5)
    reason = (
        F.when(t.isNull(), "Could not parse claim structure")
        .when(~handled, F.concat(F.lit("Predicate '"), F.col("t.predicate"), F.lit("' not yet supported")))
        .when(F.col("hit").isNotNull(), F.concat(F.lit("The mirror confirms: "), F.col("hit.label"), F.lit(" invented "), F.col("t.object")))
        .when(F.col("top").isNotNull(), F.concat(F.lit("The mirror shows "), F.coalesce("top.value_label", F.lit("Unknown")), F.lit(" invented "), F.col("t.object"), F.lit(", not "), F.col("t.subject")))
        .otherwise(F.concat(F.lit("Could not find '"), F.col("t.object"), F.lit("' in the mirror")))
    )
    return j.select(key, status.alias("status"), confidence.alias("confidence"), reason.alias("reason"))


def cascade(local: DataFrame, external: DataFrame, judged: DataFrame | None, key: str, tidy: bool = True) -> DataFrame:
    """key, status, confidence, source: the local base if it verifies or refutes, else the external verifier unless it
    does not know, else the judge. tidy gives the judge's verdicts the same words as the others' (else lower-cased)."""
    e = external.select(key, F.col("status").alias("e_status"), F.col("confidence").alias("e_confidence"))
    j = local.select(key, "status", "confidence").join(e, key, "left")
    if judged is not None:
        words = F.when(F.col("verdict") == "PASS", "verified").when(F.col("verdict") == "FAIL", "refuted").otherwise("unverifiable") if tidy else F.lower("verdict")
        j = j.join(judged.select(key, words.alias("j_status"), F.col("confidence").alias("j_confidence")), key, "left")
    else:
        j = j.withColumns({"j_status": F.lit(None).cast("string"), "j_confidence": F.lit(None).cast("double")})
    own, ext, llm = F.col("status").isin("verified", "refuted"), F.col("e_status") != "unverifiable", F.col("j_status").isNotNull()
    pick = lambda a, b, c, d: F.when(own, a).when(ext, b).when(llm, c).otherwise(d)
    return j.select(key, pick(F.col("status"), F.col("e_status"), F.col("j_status"), F.lit("unverifiable")).alias("status"), pick(F.col("confidence"), F.col("e_confidence"), F.col("j_confidence"), F.lit(0.0)).alias("confidence"), pick(F.lit("local_kb"), F.lit("external"), F.lit("llm_judge"), F.lit(None)).alias("source"))


def semantic_cache(calls: DataFrame, key: str, seq: str, column: str = "text") -> DataFrame:
    """calls with verdict and confidence as judged: hit, confidence (a hit's is discounted) and external_calls. The
    first call of a text judges it; its verdict is pinned for the later ones."""
    first = calls.groupBy(cache_key(F.col(column)).alias("k")).agg(F.min_by(F.struct(F.col(seq).alias("s"), F.col("verdict").alias("v"), F.col("confidence").alias("c")), seq).alias("first"))
    j = calls.withColumn("k", cache_key(F.col(column))).join(first, "k")
    hit = F.col(seq) > F.col("first.s")
    return j.select(key, F.col("first.v").alias("verdict"), hit.alias("hit"), F.when(hit, F.col("first.c") * CACHE_DISCOUNT).otherwise(F.col("first.c")).alias("confidence"), F.when(hit, 0).otherwise(1).alias("external_calls"))


def semantic_cache_vectors(calls: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """calls: key (their order), embedding (one length), verdict, confidence as judged. Each call takes the result of the
    most similar of the earlier calls that were judged themselves, at a discount, if its cosine is at least `least` (the
    first of equals); else it is judged. key, verdict, hit, of (the call that was judged), confidence, external_calls."""
    kind = dict(calls.dtypes)[key]
    own = cut(calls.select(F.col(key).alias("n"), F.col("embedding").cast("array<double>").alias("v")))
    heads = own.groupBy("v").agg(F.min("n").alias("n"))  # calls of one vector are judged at their first, if at all

    def cosines(left: pa.Table, right: pa.Table) -> np.ndarray:
        x, y = vector_matrix(left["v"]), vector_matrix(right["v"])
        norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
        sim = np.divide(x @ y.T, norms, out=np.zeros(norms.shape), where=norms > 0)
        return np.where(right["n"].to_numpy() < left["n"].to_numpy()[:, None], np.round(sim, 12), -1.0)

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = np.nonzero(cosines(left, right) >= least)
        return pa.table({"a": right["n"].take(j), "b": left["n"].take(i)})

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("n")
        sim = cosines(left, right)
        i, j = best_columns(sim, 1, least)
        return pa.table({"n": left["n"].take(i), "of": right["n"].take(j), "sim": sim[i, j]})

    judged = openers(heads.select("n"), in_blocks(heads, heads, alike, f"a {kind}, b {kind}"))
    held = own.join(judged, "n", "left_semi")
    best = in_blocks(own, held, nearest, f"n {kind}, of {kind}, sim double").groupBy("n").agg(F.max(F.struct("sim", (-F.col("of")).alias("o"))).alias("b")).select(F.col("n").alias(key), (-F.col("b.o")).alias("of"))
    results = calls.select(F.col(key).alias("of"), "verdict", "confidence")
    j = calls.select(key).join(best, key, "left").withColumn("hit", F.col("of").isNotNull()).withColumn("of", F.coalesce("of", key))
    return j.join(results, "of").select(key, "verdict", "hit", "of", F.when(F.col("hit"), F.col("confidence") * CACHE_DISCOUNT).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("hit"), 0).otherwise(1).alias("external_calls"))
