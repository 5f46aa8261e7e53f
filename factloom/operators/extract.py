"""Claim extraction: from text to (subject, predicate, object) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import SPACE, json_array, sentences, signature, strip
# Predicates and the verb phrases that state them, in the order in which they are tried.
VERBS = [
    ("located_in", r"(?:is|are|was|were)\s+(?:located|situated)\s+in"),
    ("founded_in", r"(?:was|were)\s+founded\s+in"),
    ("born_in", r"(?:was|were)\s+born\s+in"),
    ("died_in", r"died\s+in"),
    ("discovered", "discovered"),
    ("invented", "invented"),
    ("proposed", "proposed"),
    ("developed", "developed"),
    ("created", "created"),
    ("wrote", "wrote"),
    ("published", "published"),
    ("capital_of", r"is\s+the\s+capital\s+of"),
    ("part_of", r"is\s+(?:a\s+)?part\s+of"),
    ("member_of", r"is\s+(?:a\s+)?member\s+of"),
    ("has", "has"),
    ("contains", "contains"),
    ("announced", "announced"),
    ("increased_by", r"(?:increased|rose|went\s+up)\s+by"),
    ("decreased_by", r"(?:decreased|fell|went\s+down)\s+by"),
    ("is_a", r"(?:is|are)\s+(?:a|an|the)"),
    ("is", r"(?:is|are)"),
    ("was", r"(?:was|were)"),
]
# The verbs that the external verifier and the ground-truth store parse, in the order tried.
EXTERNAL_VERBS = ["invented|discovered|created|founded|wrote", "was born in|is located in|is the capital of", "is|was"]
GROUND_VERBS = ["invented|discovered|created|wrote|founded|born in|located in|is", "is|was|are|were"]

CONFIDENCE, JSON_CONFIDENCE, JSON_PREDICATE, LEAST_LENGTH = 0.7, 0.8, "unknown", 2


def verb_pattern(verb: str) -> str:
    """The leftmost verb splits a sentence: subject before it, object after it."""
    return rf"^(.+?)\s+{verb}\s+(.+?)$"


def states_something(sentence: Column) -> Column:
    """Whether any verb stands between white space: the cheap test before the cuts."""
    return sentence.rlike("(?i)" + SPACE + "(?:" + "|".join(verb.replace(r"\s", SPACE) for _, verb in VERBS) + ")" + SPACE)


def triple(sentence: Column) -> Column:
    """(predicate, subject, object) by the first verb, in order, whose subject and object are long enough; null if there
    is none. A verb is only tried where those before it gave nothing."""
    s = strip(F.regexp_replace(strip(sentence), r"[.!?]+$", ""))
    tried = []
    for predicate, verb in VERBS:
        pattern = "(?idU)" + verb_pattern(verb)
        subject, object_ = (strip(F.regexp_extract(s, pattern, k)) for k in (1, 2))
        fits = s.rlike(pattern) & (F.length(subject) >= LEAST_LENGTH) & (F.length(object_) >= LEAST_LENGTH)
        tried.append(F.when(fits, F.struct(F.lit(predicate).alias("predicate"), subject.alias("subject"), object_.alias("object"))))
    return F.when(states_something(sentence), F.coalesce(*tried))


def rule_claims(text: Column) -> Column:
    """Array of (subject, predicate, object, raw, confidence), one per sentence that states a claim."""
    each = F.transform(sentences(text), lambda x: F.struct(x.alias("raw"), triple(x).alias("t")))
    return F.transform(F.filter(each, lambda x: x["t"].isNotNull()), lambda x: F.struct(x["t"]["subject"].alias("subject"), x["t"]["predicate"].alias("predicate"), x["t"]["object"].alias("object"), x["raw"].alias("raw"), F.lit(CONFIDENCE).alias("confidence")))


def extract_claims(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, claim_idx, subject, predicate, object, raw, confidence: one row per sentence that states a claim. A text's
    sentences are cut and numbered within its row, so nothing is shuffled."""
    return texts.select(key, F.posexplode(rule_claims(F.col(column))).alias("claim_idx", "c")).select(key, "claim_idx", "c.*")


def reply_claims(reply: Column, text: Column) -> Column:
    """Array of the claims of a model's JSON reply, as those of the rules; raw is the whole text."""
    items = F.from_json(json_array(reply), "array<struct<subject:string,predicate:string,object:string,confidence:double>>", {"mode": "PERMISSIVE"})
    fill = lambda c, name, d: F.coalesce(c[name], F.lit(d)).alias(name)
    return F.transform(items, lambda c: F.struct(fill(c, "subject", ""), fill(c, "predicate", JSON_PREDICATE), fill(c, "object", ""), text.alias("raw"), fill(c, "confidence", JSON_CONFIDENCE)))


def valid_reply(reply: Column) -> Column:
    """Whether a reply holds a list of objects; an empty list is valid."""
    found = F.from_json(json_array(reply), "array<struct<subject:string>>")
    return (json_array(reply) != "") & found.isNotNull() & F.coalesce(F.forall(found, lambda x: x.isNotNull()), F.lit(True))


def with_fallback(replies: DataFrame, key: str, text: str, reply: str) -> DataFrame:
    """Model claims where the reply is valid, else the rules' claims, in one pass."""
    ok = F.coalesce(valid_reply(F.col(reply)), F.lit(False))
    claims = F.when(ok, reply_claims(F.col(reply), F.col(text))).otherwise(rule_claims(F.col(text)))
    return replies.select(key, F.posexplode(claims).alias("claim_idx", "c")).select(key, "claim_idx", "c.*")


def hybrid_claims(replies: DataFrame, key: str, text: str, reply: str) -> DataFrame:
    """Model claims first (repeats kept), then rule claims whose signature is new to the text, each once."""
    sig = signature(F.col("subject"), F.col("predicate"), F.col("object"))
    model = with_fallback(replies, key, text, reply).withColumn("sig", sig)
    rules = extract_claims(replies, key, text).withColumn("sig", sig).join(model.select(key, "sig"), [key, "sig"], "left_anti")
    once = rules.groupBy(key, "sig").agg(F.min_by(F.struct("claim_idx", "subject", "predicate", "object", "raw", "confidence"), "claim_idx").alias("c")).select(key, "c.*")
    sized = model.groupBy(key).agg(F.count("*").alias("before"))
    ordered = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim_idx", "subject", "predicate", "object", "raw", "confidence"))).alias("c")).select(key, F.posexplode("c").alias("k", "c"))
    after = ordered.join(sized, key, "left").select(key, (F.col("k") + F.coalesce("before", F.lit(0))).cast("int").alias("claim_idx"), "c.subject", "c.predicate", "c.object", "c.raw", "c.confidence")
    return model.drop("sig").withColumn("source", F.lit("model")).unionByName(after.withColumn("source", F.lit("rules")))


def parse_triple(text: Column, verbs: list[str], lower_predicate: bool = False) -> Column:
    """subject, predicate, object by the first list of verbs that fits; null if none does."""
    tried = []
    for verb in verbs:
        pattern = rf"(?idU)^(.+?)\s+({verb})\s+(.+?)\.?$"
        part = lambda k: strip(F.regexp_extract(text, pattern, k))  # noqa: B023, E731
        predicate = F.lower(part(2)) if lower_predicate else part(2)
        tried.append(F.when(text.rlike(pattern), F.struct(part(1).alias("subject"), predicate.alias("predicate"), part(3).alias("object"))))
    return F.coalesce(*tried)
