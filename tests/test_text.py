"""String functions, extraction and similarity against plain Python."""

import hashlib
import math
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from factloom.functions import similarity as sim
from factloom.functions import text as tx
from factloom.operators import extract

TEXTS = ["  Hello,  World! ", "a . b", "Paris .", "", "É tat [x] {y}", "Dr. Who met Mr. X. He ran! Did he? Yes", "A\nB. C"]


def column(spark, values, c):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").coalesce(1).orderBy("i").select(c).collect()]


def plain_norm(s):
    return re.sub(r"[\"'`,.;:!?()\[\]{}]", "", re.sub(r"\s+", " ", s.strip().lower()))


def test_norm_and_canon(spark):
    assert column(spark, TEXTS, tx.norm_text(F.col("c"))) == [plain_norm(t) for t in TEXTS]
    assert column(spark, ["is a", "is", "is_was_x", "Was born", "be_"], tx.canon_predicate(F.col("c"))) == ["a", "is", "was_x", "born", ""]


def test_sentences(spark):
    got = column(spark, TEXTS, tx.sentences(F.col("c")))
    assert got[5] == ["Dr. Who met Mr. X.", "He ran!", "Did he?", "Yes"] and got[3] == [] and got[6] == ["A\nB.", "C"]


def plain_buckets(t):
    words = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_ ]+", " ", t.lower())).strip().split()
    return Counter(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 512 for x in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:]))])


def test_hash_cosine(spark):
    a, b = ["the theory of relativity", "Albert Einstein", "gravity", ""], ["relativity", "Einstein", "the theory of relativity", "gravity"]
    got = {(r.a, r.b): r.c for r in sim.cosines(spark.createDataFrame([(x,) for x in a], "a string"), "a", spark.createDataFrame([(x,) for x in b], "b string"), "b", "c").collect()}
    for x in a:
        for y in b:
            p, q = plain_buckets(x), plain_buckets(y)
            dot = sum(p[k] * q[k] for k in p)
            want = dot / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values())) if dot else 0
            assert got.get((x, y), 0) == want
    assert got["gravity", "gravity"] == 1.0


def test_string_similarity_and_sha(spark):
    df = spark.createDataFrame([("The Light Bulb!", "light bulb"), ("a", "")], "a string, b string")
    got = [r[0] for r in df.select(sim.text_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, plain_norm(a), plain_norm(b)).ratio() for a, b in [("The Light Bulb!", "light bulb"), ("a", "")]]
    assert column(spark, ["NATION_1"], sim.sha_embed(F.col("c")))[0] == [x / 255.0 for x in hashlib.sha256(b"nation_1").digest()]


def claims(spark, text):
    df = spark.createDataFrame([(0, text)], "k int, text string")
    return [(r.subject, r.predicate, r.object) for r in extract.extract_claims(df, "k").orderBy("claim_idx").collect()]


def test_extraction(spark):
    assert claims(spark, "The Eiffel Tower is located in Paris.") == [("The Eiffel Tower", "located_in", "Paris")]
    assert claims(spark, "Paris is the capital of France.") == [("Paris", "capital_of", "France")]
    assert claims(spark, "Marie Curie was born in Poland. She discovered radium!") == [("Marie Curie", "born_in", "Poland"), ("She", "discovered", "radium")]
    assert claims(spark, "Hello world!") == [] and claims(spark, "") == []
    assert claims(spark, "Python was created by Guido.") == [("Python was", "created", "by Guido")]
    # a cut with too short a side falls through to the next verb
    assert claims(spark, "X has it and he was there") == [("X has it and he", "was", "there")]
    assert len(claims(spark, ". ".join(f"Thing {k} is part of set {k}" for k in range(30)) + ".")) == 30


def test_json_claims(spark):
    rows = [(0, "A is a B.", '[{"subject": "s"}]'), (1, "Ann wrote Bob.", "[oops"), (2, "Ann wrote Bob.", "[]"), (3, "Ann wrote Bob.", None)]
    df = spark.createDataFrame(rows, "k int, text string, reply string")
    got = {(r.k, r.subject, r.predicate, r.object, r.confidence) for r in extract.with_fallback(df, "k", "text", "reply").collect()}
    assert got == {(0, "s", "unknown", "", 0.8), (1, "Ann", "wrote", "Bob", 0.7), (3, "Ann", "wrote", "Bob", 0.7)}


def test_every_verb(spark):
    """One sentence per verb, in the order tried, with the triple that is expected of it."""
    want = {
        "The mill is situated in Ghent.": ("The mill", "located_in", "Ghent"),
        "Acme was founded in 1901.": ("Acme", "founded_in", "1901"),
        "Ann was born in Rome.": ("Ann", "born_in", "Rome"),
        "Ann died in Oslo.": ("Ann", "died_in", "Oslo"),
        "Ann discovered radon.": ("Ann", "discovered", "radon"),
        "Ann invented a lamp.": ("Ann", "invented", "a lamp"),
        "Ann proposed a law.": ("Ann", "proposed", "a law"),
        "Ann developed an engine.": ("Ann", "developed", "an engine"),
        "Ann created Loom.": ("Ann", "created", "Loom"),
        "Ann wrote Hamlet.": ("Ann", "wrote", "Hamlet"),
        "Ann published it all.": ("Ann", "published", "it all"),
        "Rome is the capital of Italy.": ("Rome", "capital_of", "Italy"),
        "Gent is part of Flanders.": ("Gent", "part_of", "Flanders"),
        "Ann is a member of the club.": ("Ann", "member_of", "the club"),
        "Ann has a cat.": ("Ann", "has", "a cat"),
        "Milk contains fat.": ("Milk", "contains", "fat"),
        "Ann announced a plan.": ("Ann", "announced", "a plan"),
        "Prices went up by 3%.": ("Prices", "increased_by", "3%"),
        "Prices fell by 4 points.": ("Prices", "decreased_by", "4 points"),
        "Water is a liquid.": ("Water", "is_a", "liquid"),
        "Snow is white.": ("Snow", "is", "white"),
        "Snow was white.": ("Snow", "was", "white"),
    }
    assert [p for _, p, _ in want.values()] == [p for p, _ in extract.VERBS]
    got = {r.raw: (r.subject, r.predicate, r.object) for r in extract.extract_claims(spark.createDataFrame([(0, " ".join(want))], "k int, text string"), "k").collect()}
    assert got == want


def test_white_space_is_unicode(spark):
    assert column(spark, ["\u00a0 a\u2003b \u3000\n", "\x0b\x85x"], tx.strip(F.col("c"))) == ["a\u2003b", "x"]
    assert column(spark, ["One.\u00a0Two!\u2003 Three?Four"], tx.sentences(F.col("c"))) == [["One.", "Two!", "Three?Four"]]
