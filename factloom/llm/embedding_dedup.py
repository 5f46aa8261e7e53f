"""Embedding near-dedup (9): product quantisation with coarse inverted lists.

Vectors that are equal after scaling to length 1 form a class. Each class is indexed in its nearest coarse list as
codes of the residual in `SUBSPACES` subspaces, and asks its nearest lists: asymmetric table look-ups give an approximate
cosine with every code of the list, candidates within the index's own error bound go on, and exact cosines in double
precision decide. A pair counts for both ends, whichever of them found it. Lists are cut into chunks of at most `CHUNK`
codes and asked in blocks, so no group is held by one task; links within a block are emitted as counts and as stars,
never as all pairs.

The coarse centroids are fitted by k-means steps in the executors on about `SAMPLE_A_LIST` vectors a list, drawn by a hash,
the codebooks on at most `CODE_SAMPLE` of them (documented bounds); every vector is indexed. The number of lists follows
the square root of the number of vectors. How many lists are asked is measured in each run: a sample of at most `ASKED`
vectors is compared with all vectors by brute force, and the lists asked are at least those that find `RECALL` of the
links so found (and at least `probes_of` the lists); the tests compare whole tables with brute force.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; components are scaled by the
largest before lengths are taken, so no finite vector over- or underflows. Vectors of different lengths don't link with
each other; each length has its own index. Ties are links as any other. Repeated rows (same vec_id and vector) are one
vector; a vec_id that comes with different vectors is several, and where it is the smallest id of several classes, their
links are added up. Null vec_id: returned alone, with a null component. Empty table: empty result. Columns other than
vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, discard, materialize, reduced, rows, spread_lookup, table
from factloom.llm.graph import components, stars

THRESHOLD = 0.9
LINKS = "a long, n long, b long"
LISTS_PER_ROOT, SAMPLE_A_LIST, PROBES, SUBSPACES, CODES, CHUNK = 2.0, 64, 8, 16, 64, 2048
CODE_SAMPLE, ROUNDS, ASKED, RECALL = 20_000, 6, 1000, 0.98
#: Up to so many lists (those of 20,000 vectors), PROBES of them are asked; from there on the number grows with GROWTH.
FEW_LISTS, GROWTH = 282, 0.5


def probes_of(lists: int, probes: int = PROBES) -> int:
    return min(lists, math.ceil(probes * max(1.0, lists / FEW_LISTS) ** GROWTH))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of c for each row of x, in blocks."""
    out, half = [], (c * c).sum(1) / 2
    k = min(k, len(c))
    for i in range(0, len(x), 2048):
        d = half - x[i : i + 2048] @ c.T
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


class Quantizer:
    """Coarse centroids and, for each subspace, codewords of the sample's residuals."""

    def __init__(self, coarse: np.ndarray, sample: np.ndarray, subspaces: int = SUBSPACES, codes: int = CODES):
        self.coarse = coarse
        residual = sample - self.coarse[_nearest(sample, self.coarse, 1)[:, 0]]
        m = max(d for d in range(1, subspaces + 1) if sample.shape[1] % d == 0)
        self.books = [_kmeans(r, codes, ROUNDS, 2 + k) for k, r in enumerate(np.split(residual, m, axis=1))]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.coarse[lists]
        return np.stack([_nearest(r, b, 1)[:, 0] for r, b in zip(np.split(residual, len(self.books), axis=1), self.books, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists] + np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)

    def approximate(self, q: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of q with the coded vectors of one list, by look-ups in tables of q."""
        out = np.repeat((q @ self.coarse[list_id])[:, None], len(codes), axis=1)
        for part, b, c in zip(np.split(q, len(self.books), axis=1), self.books, codes.T, strict=True):
            out += (part @ b.T)[:, c]
        return out


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, key) with the key of the unit vector (null if it links with nothing), and one row per key:
    key, rep_id (smallest id), size (distinct ids), v (unit vector, 64-bit)."""

    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])
        for b in batches:
            column = b.column("embedding")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start, flat = np.cumsum(size) - size, pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
            out: list[bytes | None] = [None] * len(column)
            for n in np.unique(size[size > 0]):
                own = np.flatnonzero(size == n)
                x = flat[start[own][:, None] + np.arange(n)]
                largest = np.abs(x).max(1)
                ok = np.isfinite(largest) & (largest > 0)
                x = x[ok] / largest[ok, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                for k, v in zip(own[ok], x, strict=True):
                    out[k] = v.tobytes()
            yield rows({"vec_id": b.column("vec_id"), "v": out}, schema)

    unit = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v binary")
    unit = materialize(unit.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.sha2("v", 256))), "unit")
    groups = unit.filter("key IS NOT NULL").groupBy("key", F.col("vec_id")).agg(F.first("v").alias("v")).groupBy("key").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("size"), F.first("v").alias("v"))
    return unit.select("vec_id", "key"), materialize(groups, "vector-classes")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def links(groups: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """Of classes (rep_id, size, v): rows (rep_id, n) that add up to the vectors linked with a class's own (of other
    classes), and (rep_id, to) that join its component; one of n, to is null."""
    lengths = groups.groupBy(F.length("v").alias("k")).count().filter("count > 1").orderBy("k").collect()
    out = groups.sparkSession.createDataFrame([], LINKS)
    for r in lengths:
        out = out.unionByName(_links(groups.filter(F.length("v") == r["k"]), r["k"] // 8, r["count"], threshold, probes))
    return out


def fitted(groups: DataFrame, dim: int, count: int, lists: int) -> Quantizer:
    """The quantizer of `count` classes. A k-means step is a pass over the sample that sums each centroid's vectors."""
    spark, at = groups.sparkSession, F.pmod(F.xxhash64("rep_id", F.lit(1)), F.lit(1 << 30))
    share = min(1.0, lists * SAMPLE_A_LIST / count)
    sample = materialize(groups.select("v", at.alias("at")).filter(F.col("at") < F.lit(share * (1 << 30))), "vector-sample")
    some = sample.orderBy("at", "v").limit(max(lists, min(CODE_SAMPLE, lists * SAMPLE_A_LIST))).toPandas()["v"]
    some = np.frombuffer(b"".join(some), np.float64).reshape(-1, dim) if len(some) else np.ones((1, dim))
    coarse = some[:lists].copy()
    step = max(1, (1 << 16) // (dim + 1))
    padded = -(-len(coarse) // step) * step
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(coarse)

        def sums(batches, held=held):
            out = np.zeros((padded, dim + 1))
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("v"), dim)
                    near = _nearest(x, held.value, 1)[:, 0]
                    np.add.at(out.reshape(-1), ((near * (dim + 1))[:, None] + np.arange(dim)).ravel(), x.ravel())
                    out[:, dim] += np.bincount(near, minlength=padded)
            yield blocks_of(out, step * (dim + 1))

        got = reduced(sample.select("v").mapInArrow(sums, "block int, data binary"), padded // step, step * (dim + 1), "double").reshape(padded, dim + 1)[: len(coarse)]
        coarse = np.where(got[:, dim:] > 0, got[:, :dim] / np.maximum(got[:, dim:], 1.0), coarse)
        held.unpersist()
    discard(sample)
    return Quantizer(coarse, some[:CODE_SAMPLE])


def asked_lists(groups: DataFrame, dim: int, model, threshold: float) -> int:
    """How many lists each vector must ask so that RECALL of the links of a sample is found from one of their ends."""
    taken = groups.select("rep_id", "v", F.xxhash64("rep_id", F.lit(2)).alias("at")).orderBy("at", "rep_id").limit(ASKED).toPandas()
    ids, x = taken["rep_id"].to_numpy(), np.frombuffer(b"".join(taken["v"]), np.float64).reshape(-1, dim)
    held = groups.sparkSession.sparkContext.broadcast((ids, x))

    def ranks(batches):
        """How often the better rank of a link's lists, one by the distances of the other end, is how much."""
        (ids, x), coarse = held.value, model.value.coarse
        half, counts = (coarse * coarse).sum(1) / 2, np.zeros(len(coarse), np.int64)
        far = half - x @ coarse.T
        own = far.argmin(1)
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                y = _matrix(part.column("v"), dim)
                i, j = np.nonzero((y @ x.T >= threshold) & (part.column("rep_id").to_numpy()[:, None] != ids))
                for a in range(0, len(i), 4096):
                    r, c = i[a : a + 4096], j[a : a + 4096]
                    away = half - y[r] @ coarse.T
                    lists = away.argmin(1)
                    one = (away < np.take_along_axis(away, own[c][:, None], 1)).sum(1)
                    two = (far[c] < far[c, lists][:, None]).sum(1)
                    counts += np.bincount(np.minimum(one, two), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield rows({"rank": some, "n": counts[some]}, pa.schema([("rank", pa.int64()), ("n", pa.int64())]))

    found = groups.select("rep_id", "v").mapInArrow(ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").toPandas()
    held.unpersist()
    if not len(found):
        return 1
    reached = found["n"].cumsum().to_numpy() >= RECALL * found["n"].sum()
    return int(found["rank"].to_numpy()[reached.argmax()]) + 1


def _links(groups: DataFrame, dim: int, count: int, threshold: float, probes: int) -> DataFrame:
    """links() of `count` classes whose vectors have `dim` components."""
    spark = groups.sparkSession
    lists = max(1, int(LISTS_PER_ROOT * math.sqrt(count)))
    model = spark.sparkContext.broadcast(fitted(groups, dim, count, lists))
    probes = max(probes_of(lists, probes), asked_lists(groups, dim, model, threshold))
    schema = pa.schema([("list", pa.int32()), ("near", pa.list_(pa.int32())), ("rep_id", pa.int64()), ("size", pa.int64()), ("v", pa.binary()), ("codes", pa.binary())])

    def index(batches):
        q = model.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dim)
                near = _nearest(x, q.coarse, probes)
                own = near[:, 0]
                yield rows({"list": own, "near": list(near), "rep_id": b.column("rep_id"), "size": b.column("size"), "v": b.column("v"), "codes": [c.tobytes() for c in q.encode(x, own)]}, schema)

    indexed = materialize(groups.select("rep_id", "size", "v").mapInArrow(index, "list int, near array<int>, rep_id long, size long, v binary, codes binary"), "lists")
    counts = indexed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row per list
    asked = indexed.select(F.explode("near").alias("list"), F.array("list").alias("near"), "rep_id", "size", "v")
    chunk = F.pmod(F.xxhash64("rep_id"), F.col("chunks")).cast("int")
    sides = F.broadcast(counts)
    stored = indexed.join(sides, "list").select("list", chunk.alias("chunk"), F.lit(0).alias("asks"), "near", "rep_id", "size", "v", "codes")
    queries = asked.join(sides, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("asks"), "near", "rep_id", "size", "v", F.lit(None).cast("binary").alias("codes"))
    # A chunk is asked by many queries where vectors crowd: its copies share them, each with a part of the queries.
    crowd = asked.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("int").alias("parts"))
    stored = stored.join(F.broadcast(crowd), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    queries = queries.join(F.broadcast(crowd), "list").withColumn("part", F.pmod(F.xxhash64("rep_id", F.lit(7)), F.col("parts")).cast("int")).drop("parts")

    def answer(batches):
        q, out = model.value, pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])
        key, held, waiting = None, [], []

        def settle():
            if not held or not waiting:
                return
            ids, sizes = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            near = np.array([h[4] for h in held], np.int32)
            x = np.frombuffer(b"".join(h[2] for h in held), np.float64).reshape(-1, dim)
            codes = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(len(held), -1)
            # |<q, x> - <q, decoded>| <= |x - decoded| for a unit q
            slack = np.linalg.norm(x - q.decode(codes, np.full(len(ids), key[0])), axis=1)
            edges_a, edges_b = [], []
            for i in range(0, len(waiting), 512):
                block = waiting[i : i + 512]
                own, own_sizes, own_list = (np.array([w[k] for w in block]) for k in (0, 2, 3))
                y = np.frombuffer(b"".join(w[1] for w in block), np.float64).reshape(-1, dim)
                r, c = np.nonzero(q.approximate(y, key[0], codes) + slack >= threshold)
                for j in range(0, len(r), 200_000):
                    rj, cj = r[j : j + 200_000], c[j : j + 200_000]
                    ok = (np.einsum("ij,ij->i", y[rj], x[cj]) >= threshold) & (own[rj] != ids[cj])
                    rj, cj = rj[ok], cj[ok]
                    # and for those found that do not ask this vector's list, so do not find it
                    one = ~(near[cj] == own_list[rj, None]).any(1)
                    for of, n in ((own, np.bincount(rj, sizes[cj], minlength=len(own))), (ids, np.bincount(cj[one], own_sizes[rj[one]], minlength=len(ids)))):
                        some = np.flatnonzero(n)
                        if len(some):
                            yield rows({"a": of[some], "n": n[some].astype(np.int64), "b": [None] * len(some)}, out)
                    if len(rj):
                        a, b = stars(own[rj], ids[cj])
                        edges_a.append(a)
                        edges_b.append(b)
            if edges_a:
                a, b = stars(np.concatenate(edges_a), np.concatenate(edges_b))
                yield rows({"a": a, "n": [None] * len(a), "b": b}, out)

        for t in batches:
            cols = [t.column(c).to_pylist() for c in ("list", "chunk", "part", "asks", "near", "rep_id", "size", "v", "codes")]
            for li, ch, pt, asks, to, ident, size, v, codes in zip(*cols, strict=True):
                if (li, ch, pt) != key:
                    yield from settle()
                    key, held, waiting = (li, ch, pt), [], []
                if asks:
                    waiting.append((ident, v, size, to[0]))
                else:
                    held.append((ident, size, v, codes, to))
        yield from settle()

    both = stored.select("list", "chunk", "part", "asks", "near", "rep_id", "size", "v", "codes").unionByName(queries.select("list", "chunk", "part", "asks", "near", "rep_id", "size", "v", "codes"))
    return both.repartition("list", "chunk", "part").sortWithinPartitions("list", "chunk", "part", "asks").mapInArrow(answer, LINKS)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors."""
    each, groups = classes(vectors)
    found = materialize(links(groups, threshold, probes), "vector-links")
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep_id")).agg(F.sum("n").alias("others"))
    comps = components(found.filter("b IS NOT NULL").select("a", "b"))
    done = groups.select("key", "rep_id", "size").join(counts, "rep_id", "left").join(comps.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    done = materialize(done.select("key", "size", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep_id").alias("root")), "vector-done")
    out = spread_lookup(each, done, ["key"], "size", each.count(), F.col("vec_id"))
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLE: dict[str, str] = {}
QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
