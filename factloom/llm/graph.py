"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialize, rows

PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one block as (node, smallest node of its component), for nodes that are not that smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    """Links of a task's batches, each batch contracted to stars."""
    for t in batches:
        if t.num_rows:
            a, b = stars(t.column("a").to_numpy(), t.column("b").to_numpy())
            yield rows({"a": a, "b": b}, PAIR)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: a, b (ids, any order). Returns node, component_id (smallest id reachable) for nodes of links.

    Each step takes the minimum of every node's neighbours (combined before the shuffle) and joins it back; both sides
    of that join are dealt anew, so the adaptive planner may split a node that holds many links."""
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = materialize(tidy.mapInArrow(_contract, "a long, b long").distinct(), "cc")
    seen = _state(edges)
    while True:  # every step that changes a link moves it to smaller ids
        # large star: each node hands its larger neighbours to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "cc-large")
        # small star: each node hands its smaller neighbours to the smallest of them
        low2 = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "cc")
        discard(edges, low, large, low2)
        edges, now = new, _state(new)
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component_id"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(roots)
