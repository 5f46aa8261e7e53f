"""Toxicity (1): nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index.

Terms are words (lower-cased letter by letter, outer punctuation off) and their first four, five and seven letters. Labelled training rows -
at most `PER_CLASS` of each class, the documented bound of the fit, drawn by a hash of the id - are the examples; every
term of an example is indexed, as a 64-bit hash. Document frequencies of these terms are counted over all documents.
Terms that no example has are in no vector. Examples are unit TF-IDF vectors in an inverted index; ids are cut into
blocks, and each term keeps the largest weight of each block in which it occurs. A query adds up its terms' block maxima,
visits the blocks of largest bound and then all others that can reach its k-th neighbour: the neighbours are exact.

Neighbours vote by cosine, weighted back to the class rates before the draw and smoothed by the prior; a monotone map
fitted on leave-one-out votes of the examples (pool adjacent violators) turns votes into calibrated scores. The three
nearest examples are the evidence.

Ties between neighbours: cosines equal to 12 decimals go by the examples' order (class, rarest term, doc_id). Very long
texts are read whole, a slice of their own. Columns other than doc_id, text and toxic are not read.

Null or empty text, and texts without a term of any example: the calibrated score of an empty vector. Rows without a label, or
with a null one, teach nothing; repeated labels count as the largest. Without labels of both classes every score is the
rate that is known (0 without any). Null doc_id: never held out, scored. Repeated rows are scored alike.
"""

from __future__ import annotations

import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, discard, filled, held_out, materialize, raw, reduced, rows, running_hashes, spread_bits, table, text_slices, words_of

PER_CLASS, NEIGHBOURS, EVIDENCE, BLOCK, PRIOR_WEIGHT, STEMS = 3000, 25, 3, 64, 0.05, (4, 5, 7)
#: Of the search: postings of terms in one of so many examples are a matrix; blocks that a query visits first; queries at once.
HEAVY, FIRST_BLOCKS, QUERIES_AT_ONCE = 16, 4, 128
#: Bytes of text that a worker holds as terms at a time; document frequencies travel in blocks of so many.
SLICE, STEP = 2 << 20, 4096
_OUTER = string.punctuation + "“”„«»¿¡…–—"


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of all ranges (start, n), one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + n, n)


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' terms, flat, and the number of each word's. A term's hash is a polynomial of its bytes, so
    those of a word's first letters are read off its running sums."""
    trimmed = filled(pc.utf8_trim(pc.utf8_lower(words), _OUTER))
    sums, at = running_hashes(trimmed)
    b = np.frombuffer(raw(trimmed)[0], np.uint8)[: at[-1]]
    letter = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    first = np.searchsorted(letter, at)
    letters, parts, word = np.diff(first), [], []
    for n in (0, *STEMS):
        own = np.flatnonzero(letters >= max(n, 1))
        end = letter[first[own] + n] if n else at[1:][own]
        parts.append(spread_bits(sums[end] - sums[at[:-1][own]] + np.uint64(n > 0)))
        word.append(own)
    word = np.concatenate(word)
    return np.concatenate(parts)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def _term_rows(texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the wanted terms (sorted hashes), ordered by text and term."""
    flat, bounds = words_of(texts)
    coded = flat.dictionary_encode()
    if not len(wanted) or not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, n = _hashed(coded.dictionary)
    place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    known = wanted[place] == h
    first = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(n)])]
    codes = coded.indices.to_numpy()
    n = np.diff(first)[codes]
    key = np.repeat(np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(wanted), n) + place[known][_ranges(first[codes], n)]
    key.sort()
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return key[start] // len(wanted), key[start] % len(wanted), np.diff(start, append=len(key))


class BlockMaxIndex:
    """Unit vectors by term, cut into blocks of ids; each term keeps its largest weight in each block. Terms that at
    least one in `HEAVY` examples has are kept as rows of a matrix, the others as lists of postings."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int, terms: int):
        self.blocks = max(1, -(-count // BLOCK))
        heavy = np.bincount(term, minlength=terms) * HEAVY >= max(count, HEAVY)
        self.row = np.where(heavy, np.cumsum(heavy) - 1, -1).astype(np.int32)
        many = heavy[term]
        dense = np.zeros((int(heavy.sum()), self.blocks * BLOCK))
        dense[self.row[term[many]], owner[many]] = weight[many]
        # like examples share blocks: their places go by the leading components of the matrix
        self.example = self._by_likeness(dense, count)
        place = np.empty(len(self.example), np.int32)
        place[self.example] = np.arange(len(self.example), dtype=np.int32)
        self.dense = dense[:, self.example]
        del dense
        self.dense_top = self.dense.reshape(len(self.dense), self.blocks, BLOCK).max(2)
        order = np.flatnonzero(~many)
        order = order[np.argsort(term[order], kind="stable")]
        self.place, self.weight = place[owner[order]], weight[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1)).astype(np.int32)

    @staticmethod
    def _by_likeness(dense: np.ndarray, count: int, components: int = 5) -> np.ndarray:
        """All places in an order that keeps like columns together: by which side of the median they lie on in each of
        the leading components, then along the last. Empty places come last."""
        base = np.random.default_rng(3).normal(size=(dense.shape[1], components))
        for _ in range(8):
            base = np.linalg.qr(dense.T @ (dense @ base))[0] if len(dense) else base
        sides = [base[:, k] > np.median(base[:count, k]) for k in range(1, components - 1)]
        return np.lexsort((base[:, -1], *sides[::-1], np.arange(dense.shape[1]) >= count))

    def light(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the terms of one query that have lists add to the cosines of all examples."""
        n = self.start[term + 1] - self.start[term]
        at = _ranges(self.start[term], n)
        return np.bincount(self.place[at], self.weight[at] * np.repeat(weight, n), minlength=self.blocks * BLOCK)

    def place_of(self, example: np.ndarray) -> np.ndarray:
        return np.argsort(self.example)[example]

    def nearest(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int, k: int = NEIGHBOURS, skip: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of `count` queries (owner, term, weight): the k examples of largest cosine, to 12 decimals (ties: smaller number),
        only those above 0, as (query, example, cosine) by query and rank. Lists are added up whole; a block's bound is
        its largest sum so far and what its largest weights of the matrix's terms could add. Every query visits its
        blocks of largest bound first, then each whose bound reaches its k-th cosine. skip: pairs (query, example) left
        out."""
        row = self.row[term]
        some = row >= 0
        queries = np.zeros((count, len(self.dense)))
        queries[owner[some], row[some]] = weight[some]
        cuts = np.searchsorted(owner, np.arange(count + 1))
        scores = np.stack([self.light(term[i:j][~some[i:j]], weight[i:j][~some[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        bound = queries @ self.dense_top + scores.reshape(count, self.blocks, BLOCK).max(2)
        done = np.full(scores.shape, -1.0)
        first = min(self.blocks, FIRST_BLOCKS)
        visit = bound >= np.partition(bound, self.blocks - first, axis=1)[:, [self.blocks - first]]
        for again in (False, True):
            if again:
                least = np.partition(done, -k, axis=1)[:, [-k]] if k < done.shape[1] else 0.0
                visit = (bound >= least - 1e-9) & ~visit
            for b in np.flatnonzero(visit.any(0)):
                own, at = np.flatnonzero(visit[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                if 2 * len(own) > count:  # cheaper for all than for a copy of most
                    own = slice(None)
                done[own, at] = scores[own, at] + queries[own] @ self.dense[:, at]
            if skip is not None:
                done[skip[0], self.place_of(skip[1])] = -1.0
        done = np.round(done, 12)
        least = np.partition(done, -k, axis=1)[:, [-k]] if k < done.shape[1] else np.zeros((count, 1))
        q, e = np.nonzero((done >= least) & (done > 0))
        cos, e = done[q, e], self.example[e]
        order = np.lexsort((e, -cos, q))
        q, e, cos = q[order], e[order], cos[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], e[rank < k], cos[rank < k]


def _unit(owner: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(owner, weight * weight, minlength=count))
    return weight / norm[owner]


class Model:
    """The examples' terms and counts; the index over them is built where it is asked, and does not travel."""

    def __init__(self, terms: np.ndarray, frequency: np.ndarray, documents: float, ids: np.ndarray, toxic: np.ndarray, share: np.ndarray, prior: float, term: np.ndarray, count: np.ndarray, cuts: np.ndarray):
        self.wanted, self.frequency, self.documents, self.ids, self.toxic, self.share, self.prior = terms, frequency, documents, ids, toxic, share, prior
        self.term, self.count, self.cuts, self.built = term, count, cuts, False

    def __getstate__(self) -> dict:
        if self.built:
            raise ValueError("a model travels before its index is built")
        return vars(self)

    def build(self) -> None:
        owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.cuts))
        self.idf = np.log((1.0 + self.documents) / (1.0 + self.frequency)) + 1.0
        weight = np.log(self.count.astype(np.float64))
        weight += 1
        weight *= self.idf[self.term]
        self.index, self.order = BlockMaxIndex(owner, self.term, _unit(owner, weight, len(self.ids)), len(self.ids), len(self.wanted)), np.argsort(self.ids, kind="stable")
        self.term = self.count = None  # the index has them now
        self.built = True

    def votes(self, texts: pa.Array, own_ids: np.ndarray | None = None):
        """Each text's vote, and its neighbours as (text, example, cosine), a block of texts at a time. own_ids: examples of
        a text's own id are left out."""
        if not self.built:
            self.build()
        owner, term, count = _term_rows(texts, self.wanted)
        weight = _unit(owner, (1 + np.log(count)) * self.idf[term], len(texts))
        for a in range(0, len(texts), QUERIES_AT_ONCE):
            n = min(QUERIES_AT_ONCE, len(texts) - a)
            i, j = np.searchsorted(owner, (a, a + n))
            skip = None
            if own_ids is not None:
                low, high = (np.searchsorted(self.ids, own_ids[a : a + n], side=x, sorter=self.order) for x in ("left", "right"))
                skip = np.repeat(np.arange(n), high - low), self.order[_ranges(low, high - low)]
            q, found, cos = self.index.nearest(owner[i:j] - a, term[i:j], weight[i:j], n, skip=skip)
            w = cos * self.share[found]
            votes = (np.bincount(q, w * self.toxic[found], minlength=n) + PRIOR_WEIGHT * self.prior) / (np.bincount(q, w, minlength=n) + PRIOR_WEIGHT)
            yield votes, (q, found, cos)


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of y on x: knots and values."""
    stack: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        stack.append([v, v, float((y * w)[at].sum()), float(w[at].sum())])
        while len(stack) > 1 and stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3]:
            last = stack.pop()
            stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    knots = [(a, s / n) for lo, hi, s, n in stack for a in ((lo, hi) if lo < hi else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def fit(docs: DataFrame, labels: DataFrame) -> Fitted | float:
    """The model, or a constant score where the labels do not hold both classes."""
    spark = docs.sparkSession
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"), 5, 0))
    totals = {int(r.toxic > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return float(next(iter(totals), 0))
    cap = F.when(F.col("toxic") > 0, min(1.0, PER_CLASS / totals[1])).otherwise(min(1.0, PER_CLASS / totals[0]))
    drawn = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < cap * (1 << 20)).withColumn("toxic", (F.col("toxic") > 0).cast("int")).limit(3 * PER_CLASS))
    examples = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "text", "toxic")

    def present(batches):
        for b in batches:
            for part in text_slices(b, limit=SLICE):
                yield rows({"h": np.unique(_hashed(words_of(filled(part.column("text")))[0].unique())[0])}, pa.schema([("h", pa.int64())]))

    examples = materialize(examples, "toxicity-examples")
    sizes = {r.toxic: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return totals[1] / sum(totals.values())
    n1, n0 = float(sizes[1]), float(sizes[0])
    terms = np.sort(examples.mapInArrow(present, "h long").distinct().toArrow()["h"].to_numpy())
    wanted, pad = spark.sparkContext.broadcast(terms), -(-(len(terms) + 1) // STEP) * STEP

    def frequency(batches):
        df = np.zeros(pad, np.uint32)
        for b in batches:
            for part in text_slices(b, limit=SLICE):
                df[-1] += part.num_rows
                term = _term_rows(filled(part.column("text")), wanted.value)[1]
                df[: len(wanted.value)] += np.bincount(term, minlength=len(wanted.value)).astype(np.uint32)
        yield blocks_of(df, STEP)

    counted = reduced(docs.select(F.col("text").cast("string")).mapInArrow(frequency, "block int, data binary"), pad // STEP, STEP)
    idf = -np.log1p(counted[: len(terms)])

    def vectors(batches):
        fields = [("doc_id", pa.int64()), ("toxic", pa.int32()), ("term", pa.binary()), ("count", pa.binary())]
        for b in batches:
            for part in text_slices(b, limit=SLICE):
                owner, term, count = _term_rows(filled(part.column("text")), wanted.value)
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                cells = lambda x, kind: [x[i:j].astype(kind).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]  # noqa: B023, E731
                yield rows({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "term": cells(term, np.int32), "count": cells(count, np.uint32)}, pa.schema(fields))

    found = examples.mapInArrow(vectors, "doc_id long, toxic int, term binary, count binary").toArrow()
    part = [np.frombuffer(x.as_buffer(), np.int32) for c in found["term"].chunks for x in c]
    rarest = [int(x[np.argmax(idf[x])]) if len(x) else -1 for x in part]
    ids, toxic = found["doc_id"].to_numpy(), found["toxic"].to_numpy().astype(np.int64)
    order = np.lexsort((ids, rarest, toxic))  # like examples share blocks
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for c in found["count"].chunks for x in c]
    cuts = np.concatenate([[0], np.cumsum([len(part[k]) for k in order])])
    share = np.where(toxic[order] == 1, totals[1] / n1, totals[0] / n0)
    model = Model(terms, counted[: len(terms)], float(counted[-1]), ids[order], toxic[order], share, totals[1] / sum(totals.values()), np.concatenate([part[k] for k in order]), np.concatenate([counts[k] for k in order]), cuts)
    del found, part, counts, counted
    held = spark.sparkContext.broadcast(model)

    def own_votes(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("vote", pa.float64())])
        for b in batches:
            for part in text_slices(b, limit=SLICE):
                ids = part.column("doc_id").to_numpy()
                votes = [v for v, _ in held.value.votes(filled(part.column("text")), ids)]
                yield rows({"doc_id": ids, "toxic": part.column("toxic"), "vote": np.concatenate(votes)}, schema)

    own = examples.mapInArrow(own_votes, "doc_id long, toxic int, vote double").toArrow().sort_by([("doc_id", "ascending"), ("vote", "ascending")])
    discard(examples)
    y = own["toxic"].to_numpy().astype(np.float64)
    return Fitted(held, *_monotone(own["vote"].to_numpy(), y, np.where(y == 1, totals[1] / n1, totals[0] / n0)))


class Fitted(NamedTuple):
    """A model that the executors hold, and the map from votes to scores (knots and values)."""

    held: Broadcast
    steps: np.ndarray
    values: np.ndarray


def score(docs: DataFrame, model: Fitted | float) -> DataFrame:
    """doc_id, score, predicted and evidence (nearest examples) of every row of docs."""
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", near)])

    def run(batches):
        m = None if isinstance(model, float) else model.held.value
        for b in batches:
            for part in text_slices(b, limit=SLICE):
                if m is None:
                    n = part.num_rows
                    yield rows({"doc_id": part.column("doc_id"), "score": np.full(n, model), "predicted": np.full(n, model >= 0.5, np.int32), "evidence": [[]] * n}, schema)
                    continue
                at = 0
                for votes, (q, found, cos) in m.votes(filled(part.column("text"))):
                    n, first = len(votes), np.searchsorted(q, np.arange(len(votes)))
                    scores = np.clip(np.interp(votes, model.steps, model.values), 0, 1)
                    top = np.minimum(np.diff(first, append=len(q)), EVIDENCE)
                    e = _ranges(first, top)
                    flat = pa.StructArray.from_arrays([pa.array(m.ids[found[e]], pa.int64()), pa.array(cos[e]), pa.array(m.toxic[found[e]], pa.int32())], fields=list(near.value_type))
                    evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(top)]), pa.int32()), flat)
                    yield rows({"doc_id": part.column("doc_id").slice(at, n), "score": scores, "predicted": (scores >= 0.5).astype(np.int32), "evidence": evidence}, schema)
                    at += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "evidence")


ORACLE: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
