"""Sources and sinks: knowledge bases and claim memories on disk, reports as JSON, proofs as GEXF."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "fact_seq long, subject string, predicate string, object string, confidence double, source string"
CLAIMS = "claim_id string, seq long, text string, subject string, predicate string, object string, status string, confidence double"


def tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str, kind: str = "json") -> None:
    """Whole-table save; `kind` is any of Spark's writers."""
    df.write.mode("overwrite").format(kind).save(path)


def load(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """The table, or an empty one if there is nothing at the path. Rows that cannot be read are left out with a warning
    that says how many."""
    try:
        if kind not in ("json", "csv"):
            return spark.read.format(kind).schema(schema).load(path)
        each = spark.read.format(kind).schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").load(path).persist()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    bad = each.filter("__bad IS NOT NULL").count()
    each.unpersist()
    if bad:
        warnings.warn(f"{bad} rows of {path} could not be read and are left out", stacklevel=2)
    return spark.read.format(kind).schema(schema).option("mode", "DROPMALFORMED").load(path)


def report_json(results: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """key and json: the report with its results in order; scores rounded to 4 places."""
    one = F.struct("claim_idx", F.struct("subject", "predicate", "object").alias("claim"), "verdict", F.round("score", 4).alias("score"), "matched_facts", "reason")
    lists = results.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("results"))
    return reports.join(lists, key).select(key, F.to_json(F.struct("claims_extracted", "overall_score", "pass_rate", "results")).alias("json"))


def report_text(results: DataFrame, reports: DataFrame, texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key and report: a heading, the text (its first 100 characters), the totals and a paragraph per claim, in order."""
    rule = lambda c: F.lit(c * 80)
    triple = lambda t: F.concat(F.lit("("), F.concat_ws(", ", t["subject"], t["predicate"], t["object"]), F.lit(")"))
    one = F.concat_ws("\n", F.concat(F.lit("[Claim "), (F.col("claim_idx") + 1).cast("string"), F.lit("]")), F.concat(F.lit("  Raw: "), "raw"), F.concat(F.lit("  Triple: "), triple(F.struct("subject", "predicate", "object"))), F.concat(F.lit("  Verdict: "), "verdict", F.format_string(" (score=%.3f)", "score")), F.when(F.size("matched_facts") > 0, F.concat(F.lit("  Matched: "), triple(F.get("matched_facts", F.lit(0))))), F.concat(F.lit("  Reason: "), "reason"))
    lists = results.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_idx", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("claims"))
    short = F.when(F.length(column) > 100, F.concat(F.substring(column, 1, 100), F.lit("..."))).otherwise(F.col(column))
    j = reports.join(lists, key).join(texts.select(key, column), key)
    return j.select(key, F.concat_ws("\n", rule("="), F.lit("CONSISTENCY REPORT"), rule("="), F.concat(F.lit("Text: "), short), F.concat(F.lit("Claims extracted: "), F.col("claims_extracted").cast("string")), F.format_string("Overall score: %.3f", "overall_score"), F.concat(F.format_string("Pass rate: %.1f", F.col("pass_rate") * 100), F.lit("%")), rule("-"), "claims", rule("=")).alias("report"))


def proof_gexf(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """rel_id and xml: each relation's proof as a whole GEXF document of three nodes and two edges."""
    own = facts.join(relations.select("rel_id").distinct(), "rel_id", "left_semi")
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    s, o = F.concat(F.lit("ent:"), "s_norm"), F.concat(F.lit("ent:"), "o_norm")
    node = lambda i, label, kind: F.concat(F.lit('<node id="'), safe(i), F.lit('" label="'), safe(label), F.lit(f'"><attvalues><attvalue for="0" value="{kind}"/></attvalues></node>'))
    edge = lambda k, a, b, role: F.concat(F.lit(f'<edge id="{k}" source="'), safe(a), F.lit('" target="'), safe(b), F.lit(f'"><attvalues><attvalue for="1" value="{role}"/></attvalues></edge>'))
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed" mode="static"><attributes class="node" mode="static"><attribute id="0" title="kind" type="string"/></attributes><attributes class="edge" mode="static"><attribute id="1" title="role" type="string"/></attributes>'
    rel = F.col("rel_id")
    return own.select("rel_id", F.concat(F.lit(head + "<nodes>"), node(s, F.col("s_label"), "entity"), node(rel, F.col("p_canon"), "relation"), node(o, F.col("o_label"), "entity"), F.lit("</nodes><edges>"), edge(0, s, rel, "subj"), edge(1, rel, o, "obj"), F.lit("</edges></graph></gexf>")).alias("xml"))


def save_gexf(proofs: DataFrame, path: str) -> None:
    """One document a line, in Spark's text files."""
    proofs.select("xml").write.mode("overwrite").text(path)
