"""Tables that are worked out once, and decisions that depend on earlier ones, made for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df worked out once: a checkpoint in the cluster's folder (spark.checkpoint.dir), or kept in the session where none
    is set, as in local runs."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def openers(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of nodes (n, in order) those that open a group when each joins an earlier opener that it is paired with, if there is
    one. pairs: a, b with a before b. A round settles every node whose earlier partners are settled, so as many rounds
    are run as the longest chain of pairs needs."""
    nodes, pairs = cut(nodes.select("n").distinct()), cut(pairs.select("a", "b").distinct())
    found = None
    while True:
        free = cut(nodes.join(pairs.select(F.col("b").alias("n")), "n", "left_anti"))
        found = free if found is None else found.unionByName(free)
        joined = pairs.join(free.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        settled = free.unionByName(joined)
        nodes = cut(nodes.join(settled, "n", "left_anti"))
        if nodes.isEmpty():
            return found
        pairs = cut(pairs.join(settled.withColumnRenamed("n", "a"), "a", "left_anti").join(joined.withColumnRenamed("n", "b"), "b", "left_anti"))
