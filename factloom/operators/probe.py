"""Probing claims against facts: exact match, contradiction, soft match, and the verdict that follows.

Exact matches and contradictions are equi-joins. A soft score is .30 s + .45 p + .25 o of three cosines of hash embeddings;
names share common words, so a join on shared buckets would meet nearly all pairs in a few hot buckets. Instead the claims
that are still open are dealt with the facts into cells of bounded size, where the three cosines are matrix products of
bucket counts (exact whole numbers), and only each cell's best facts of a claim go on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.similarity import bag_matrix, best_columns, hash_bag, in_blocks, integer_cosines, string_ratios
from factloom.functions.text import canon_predicate, norm_text
from factloom.operators.extract import extract_claims
from factloom.operators.order import cut

WEIGHTS, THRESHOLD = (0.30, 0.45, 0.25), 0.75
TRIPLE = ["subject", "predicate", "object"]


def keyed(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"c_s": norm_text(F.col("subject")), "c_p": canon_predicate(F.col("predicate")), "c_o": norm_text(F.col("object"))})


def fact_struct() -> Column:
    return F.struct(F.col("s_label").alias("subject"), F.col("p_canon").alias("predicate"), F.col("o_label").alias("object"))


def exact_matches(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims with the rel_id of the first equal fact, null if there is none."""
    first = facts.groupBy(F.col("s_norm").alias("c_s"), F.col("p_canon2").alias("c_p"), F.col("o_norm").alias("c_o")).agg(F.min_by("rel_id", "fact_seq").alias("rel_id"))
    return keyed(claims).join(first, ["c_s", "c_p", "c_o"], "left").drop("c_s", "c_p", "c_o")


def contradictions(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and contradicting: all facts with the claim's subject and predicate but another object, in order."""
    f = facts.select(F.col("s_norm").alias("c_s"), F.col("p_canon2").alias("c_p"), "o_norm", "fact_seq", fact_struct().alias("fact"))
    found = keyed(claims).join(f, ["c_s", "c_p"]).filter(F.col("o_norm") != F.col("c_o"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_seq", "fact"))), lambda x: x["fact"]).alias("contradicting"))


def ranked(triples: DataFrame, facts: DataFrame, top_k: int, least: float, similar: str = "hash") -> DataFrame:
    """subject, predicate, object, rank, rel_id, fact_seq, fact, score: the top_k facts of each distinct triple among
    those of at least the score `least`, best first, ties in order of the facts. similar: cosines of hash embeddings, or
    "ratio", the strings' ratios."""
    t = cut(triples.select(*TRIPLE).distinct())
    form = hash_bag if similar == "hash" else norm_text
    measure = (lambda a, b: integer_cosines(bag_matrix(a), bag_matrix(b))) if similar == "hash" else string_ratios
    asked = t.select(*TRIPLE, form(F.col("subject")).alias("s"), form(canon_predicate(F.col("predicate"))).alias("p"), form(F.col("object")).alias("o"))
    known = facts.select("fact_seq", form(F.col("s_label")).alias("s"), form(F.col("p_canon2")).alias("p"), form(F.col("o_label")).alias("o"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right, parts = right.sort_by("fact_seq"), []
        for a in range(0, left.num_rows, 256):
            part = left.slice(a, 256)
            s, p, o = (measure(part[n], right[n]) for n in "spo")
            score = WEIGHTS[0] * s + WEIGHTS[1] * p + WEIGHTS[2] * o
            i, j = best_columns(score, top_k, least)
            parts.append(pa.table({c: part[c].take(i) for c in TRIPLE} | {"fact_seq": right["fact_seq"].take(j), "score": score[i, j]}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.string()) for c in TRIPLE} | {"fact_seq": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    order = Window.partitionBy(*TRIPLE).orderBy(F.desc("score"), "fact_seq")
    found = in_blocks(asked, known, best, "subject string, predicate string, object string, fact_seq long, score double")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return found.join(facts.select("fact_seq", "rel_id", fact_struct().alias("fact")), "fact_seq").select(*TRIPLE, "rank", "rel_id", "fact_seq", "fact", "score")


def soft_matches(triples: DataFrame, facts: DataFrame, threshold: float = THRESHOLD, top_k: int = 3) -> DataFrame:
    """The top_k facts of at least the threshold, best first, ties in order: adds rank from 1."""
    return ranked(triples, facts, top_k, threshold)


def closest(triples: DataFrame, facts: DataFrame, similar: str = "hash") -> DataFrame:
    """The best fact of each triple, whatever its score."""
    return ranked(triples, facts, 1, 0.0, similar).select(*TRIPLE, "rel_id", "fact", "score")


def probe_claims(claims: DataFrame, facts: DataFrame, keys: list[str], threshold: float = THRESHOLD, contradiction_check: bool = True, similar: str = "hash") -> DataFrame:
    """claims with verdict, score, matched_facts, rel_id (the proof's relation) and reason. Scores are worked out once,
    for the claims that neither match nor contradict."""
    return _probed(cut(claims), cut(facts), keys, threshold, contradiction_check, similar)


def _probed(claims: DataFrame, facts: DataFrame, keys: list[str], threshold: float, contradiction_check: bool, similar: str) -> DataFrame:
    """probe_claims of tables that are worked out."""
    c = exact_matches(claims, facts)
    if contradiction_check:
        c = c.join(contradictions(claims, facts, keys), keys, "left")
    else:
        c = c.withColumn("contradicting", F.lit(None).cast("array<struct<subject:string,predicate:string,object:string>>"))
    open_ = c.filter("rel_id IS NULL AND contradicting IS NULL")
    near = closest(open_, facts, similar).withColumnsRenamed({"rel_id": "near_rel", "fact": "near_fact", "score": "near_score"})
    c = c.join(near, TRIPLE, "left")
    exact, against, soft = F.col("rel_id").isNotNull(), F.col("contradicting").isNotNull(), F.coalesce(F.col("near_score") >= threshold, F.lit(False))
    own = F.array(F.struct(*TRIPLE))
    verdict = F.when(exact, "PASS").when(against, "CONTRADICT").when(soft, "SOFT_PASS").otherwise("FAIL")
    score = F.when(exact, 1.0).when(against, 0.0).otherwise(F.coalesce("near_score", F.lit(0.0)))
    matched = F.when(exact, own).when(against, F.col("contradicting")).when(F.col("near_fact").isNotNull(), F.array("near_fact")).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))
    reason = (
        F.when(exact, "Exact match found in KB.")
        .when(against, F.concat(F.lit("Contradicts "), F.size("contradicting").cast("string"), F.lit(" fact(s) in KB.")))
        .when(soft, F.concat(F.lit("Soft match (score="), F.format_string("%.3f", "near_score"), F.lit(f") above threshold={threshold}.")))
        .otherwise("No supporting fact found in KB.")
    )
    proof = F.when(exact, F.col("rel_id")).when(~against & soft, F.col("near_rel"))
    return c.select(*claims.columns, verdict.alias("verdict"), score.alias("score"), matched.alias("matched_facts"), proof.alias("proof_rel"), reason.alias("reason"))


def probe_texts(texts: DataFrame, facts: DataFrame, key: str, column: str = "text", threshold: float = THRESHOLD, contradiction_check: bool = True, similar: str = "hash") -> DataFrame:
    """Probe every claim of every text; a text without claims gives one UNKNOWN row."""
    claims = cut(extract_claims(texts, key, column))
    found = _probed(claims, cut(facts), [key, "claim_idx"], threshold, contradiction_check, similar)
    empty = texts.join(claims.select(key).distinct(), key, "left_anti")
    unknown = empty.select(key, F.lit(0).alias("claim_idx"), F.lit("").alias("subject"), F.lit("unknown").alias("predicate"), F.lit("").alias("object"), F.col(column).alias("raw"), F.lit(1.0).alias("confidence"), F.lit("UNKNOWN").alias("verdict"), F.lit(0.0).alias("score"), F.array().cast("array<struct<subject:string,predicate:string,object:string>>").alias("matched_facts"), F.lit(None).cast("string").alias("proof_rel"), F.lit("No claims could be extracted from text.").alias("reason"))
    return found.unionByName(unknown)


def report(results: DataFrame, key: str) -> DataFrame:
    """key, claims_extracted, overall_score, pass_rate."""
    known = F.col("verdict") != "UNKNOWN"
    passed = F.col("verdict").isin("PASS", "SOFT_PASS").cast("double")
    return results.groupBy(key).agg(F.sum(known.cast("long")).alias("claims_extracted"), F.round(F.avg("score"), 4).alias("overall_score"), F.round(F.avg(passed), 4).alias("pass_rate"))
