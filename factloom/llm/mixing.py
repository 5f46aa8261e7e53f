"""Mixing sources to target weights (2), in DataFrame operations only.

Token counts are summed into (source, lang, topic) cells; iterative proportional fitting rakes the cells' weights to
the source, language and topic marginals in turn; a document's inclusion probability is its cell's weight per token,
scaled so that `SHARE` of all tokens is expected. A cell that would need more than it has is taken whole, the others are
raked to what is left of the marginals, so a rare cell shrinks no other; marginals that the corpus can't fill are missed
by what it lacks. Without a share (op2_mixing, whose SQL says so) the largest probability is 1 and no cell is clipped: the
marginals are met exactly, at a size that the rarest cell sets. Sampling compares the probability with a hash of doc_id, so a rerun or a lost executor draws the same sample.

Targets: for each dimension either an exponent (shares are tempered: share^a, normalised) or a dict value -> weight
(values that it lacks keep no weight). topic is the document's form, by marks found anywhere in the whole text. Null
source or lang: the value '(none)'. Null or empty text: 0 tokens; such a document carries no weight and is drawn with its
cell's probability (1 in a cell without tokens). Null doc_id: drawn as the empty id. Repeated rows share one decision; ties cannot occur. Very long texts
are counted whole. Empty table: empty result. Columns other than doc_id, text, source and lang are not read; `mixed_sample`
gives all columns back, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize, packed, spread_lookup, table

DIMS = ("source", "lang", "topic")
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SWEEPS, SWEEPS_A_JOB = 10, 2
#: Expected share of all tokens in a sample.
SHARE = 0.5
#: Up to this many cells are broadcast; more go through a shuffle.
BROADCAST_CELLS = 50_000


def topic_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table").when(t.contains("!!"), "shout").when(t.contains("###") | t.contains("***"), "symbols")
        .when(F.lower(t).contains("licens"), "licensed").when(t.contains("\n"), "paragraphs").otherwise("line")
    )


def dims_of(row: str = "") -> dict[str, Column]:
    """The columns that mixing goes by."""
    none = lambda c: F.coalesce(F.col(row + c).cast("string"), F.lit("(none)"))
    return {"source": none("source"), "lang": none("lang"), "topic": topic_of(F.col(row + "text"))}


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rake(cells: DataFrame, targets: dict | None = None, sweeps: int = SWEEPS, share: float | None = None) -> DataFrame:
    """cells: source, lang, topic, tokens, n_docs, one row per cell. Adds weight (raked, sums to 1) and prob. With a share,
    no weight is more than the cell's part of such a sample if it is taken whole."""
    targets = TARGETS | (targets or {})
    for dim in DIMS:
        by = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("__m"))
        if isinstance(targets[dim], dict):
            given = F.create_map(*[F.lit(x) for kv in targets[dim].items() for x in (kv[0], float(kv[1]))])
            by = by.withColumn("__t", F.coalesce(F.try_element_at(given, F.col(dim)), F.lit(0.0)))
        else:
            by = by.withColumn("__t", F.pow("__m", F.lit(float(targets[dim]))))
        whole = by.agg(F.sum("__t")).first()[0] or 1.0
        cells = cells.join(by.select(dim, (F.col("__t") / F.lit(whole)).alias(f"__t_{dim}")), dim)
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    whole_cell = F.col("tokens") / F.lit(whole * (share or 1.0))
    cells = materialize(cells.withColumn("weight", F.col("tokens") / F.lit(whole)), "mix-cells")
    for k in range(sweeps):
        for dim in DIMS:
            by, target = Window.partitionBy(dim), F.col(f"__t_{dim}")
            margin = F.sum("weight").over(by)
            scaled = F.col("weight") * target / margin
            if share is not None:
                loose = F.sum(F.when(F.col("weight") < whole_cell, F.col("weight")).otherwise(0.0)).over(by)
                more = F.when(F.col("weight") < whole_cell, F.least(whole_cell, F.col("weight") * (target - margin + loose) / loose)).otherwise(whole_cell)
                scaled = F.when(target <= margin, scaled).otherwise(more)
            cells = cells.withColumn("weight", F.when(margin > 0, scaled).otherwise(F.lit(0.0)))
        if k % SWEEPS_A_JOB == SWEEPS_A_JOB - 1 or k == sweeps - 1:
            cells = materialize(cells, "mix-cells")
    if share is not None:
        prob = F.least(F.lit(1.0), F.col("weight") * F.lit(_scale(cells, whole_cell)) / whole_cell)
        return cells.withColumn("prob", F.when(F.col("tokens") > 0, prob).otherwise(F.lit(1.0))).drop(*[f"__t_{d}" for d in DIMS])
    rate = F.col("weight") / F.col("tokens")
    top = cells.filter("tokens > 0").agg(F.max(rate)).first()[0] or 1.0
    return cells.withColumn("prob", F.when(F.col("tokens") > 0, rate / F.lit(top)).otherwise(F.lit(1.0))).drop(*[f"__t_{d}" for d in DIMS])


def _scale(cells: DataFrame, whole_cell: Column) -> float:
    """The factor by which the weights, each up to its whole cell, add up to 1 (or to all that has weight)."""
    scale, taken = 1.0, -1
    while True:
        full = F.col("weight") * F.lit(scale) >= whole_cell
        r = cells.filter("weight > 0").agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, whole_cell)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("loose")).first()
        if r["n"] == taken or not r["loose"]:
            return scale
        scale, taken = max(scale if taken >= 0 else 0.0, (1.0 - (r["fixed"] or 0.0)) / r["loose"]), r["n"]


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def cells_of(each: DataFrame) -> DataFrame:
    return each.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def weighed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[c.alias(d) for d, c in dims_of().items()], token_count(F.col("text")).alias("n_tokens"))


def mix(docs: DataFrame, targets: dict | None = None, sweeps: int = SWEEPS, share: float | None = SHARE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob and sampled for every row of docs."""
    each = materialize(weighed(docs), "mix-docs")
    raked = materialize(rake(cells_of(each), targets, sweeps, share), "mix-raked")
    out = _with_cells(each, raked, each.count())
    return out.select("doc_id", *DIMS, "n_tokens", F.round("prob", 6).alias("prob"), (draw(F.col("doc_id")) < F.col("prob")).alias("sampled"))


def _with_cells(each: DataFrame, raked: DataFrame, total: int) -> DataFrame:
    """each with its cell's probability. Few cells are broadcast; many are joined with the large ones spread."""
    keys = list(DIMS)
    if raked.count() <= BROADCAST_CELLS:
        return each.join(F.broadcast(raked.select(*keys, "prob")), keys, "left")
    return spread_lookup(each, raked.select(*keys, "prob", "n_docs"), keys, "n_docs", total, F.col("doc_id"))


def mixed_sample(docs: DataFrame, targets: dict | None = None, sweeps: int = SWEEPS, share: float | None = SHARE) -> DataFrame:
    """The sampled rows of docs, with docs' own columns, whatever they are called."""
    light = materialize(weighed(docs), "mix-docs")
    raked = materialize(rake(cells_of(light), targets, sweeps, share), "mix-raked")
    out = _with_cells(packed(docs, doc_id=F.col("row.doc_id"), **dims_of("row.")), raked, light.count())
    return out.filter(draw(F.col("doc_id")) < F.col("prob")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), share=None)


def _oracle() -> str:
    sql = r"""
WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
 CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '!!') THEN 'shout' WHEN contains(t, '###') OR contains(t, '***') THEN 'symbols'
 WHEN contains(lower(t), 'licens') THEN 'licensed' WHEN contains(t, chr(10)) THEN 'paragraphs' ELSE 'line' END AS topic FROM d),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL),
"""
    for dim in DIMS:
        sql += f"t_{dim} AS (SELECT {dim}, pow(sum(tokens), {TARGETS[dim]}) AS p FROM c GROUP BY {dim}),\n"
    parts = ", ".join(f"t_{d}.p / (SELECT sum(p) FROM t_{d}) AS t{d}" for d in DIMS)
    sql += f"w0 AS (SELECT c.*, tokens / (SELECT sum(tokens) FROM c) AS weight, {parts} FROM c " + " ".join(f"JOIN t_{d} USING ({d})" for d in DIMS) + ")"
    n = 0
    for _ in range(SWEEPS):
        for dim in DIMS:
            sql += f",\nw{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN m > 0 THEN weight * t{dim} / m ELSE 0 END AS weight) EXCLUDE (m) FROM (SELECT *, sum(weight) OVER (PARTITION BY {dim}) AS m FROM w{n}))".replace("SELECT * REPLACE (CASE", "SELECT * EXCLUDE (m) REPLACE (CASE").replace(" EXCLUDE (m) FROM (", " FROM (")
            n += 1
    return sql + f""",
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens / (SELECT max(weight / tokens) FROM w{n} WHERE tokens > 0) ELSE 1.0 END AS prob FROM w{n})
SELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS prob, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < prob AS sampled FROM e JOIN p USING (source, lang, topic)
"""


ORACLE = {"op2_mixing": _oracle()}
QUERIES = {"op2_mixing": op2_mixing}
