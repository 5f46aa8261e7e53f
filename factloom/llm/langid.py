"""Language ID (6): multilingual mixture inference.

Fitting: byte-trigram counts of every labelled training text, by language, in 2^16 hashed buckets (256 KB a language,
summed over tasks). Prediction: each word has a likelihood under each language from its trigrams; a document's words
are a mixture of languages whose proportions expectation-maximisation estimates. Sets of 1, 2, ... languages (the
leading ones by proportion) are compared by log-likelihood less a penalty of `penalty` * log(words) for each language
beyond the first; the best set's proportions are the answer, its largest the prediction.

Null text, or no letter (Unicode L) in it: lang_pred 'und', score 0. A table without labelled rows, or an empty one,
predicts 'und' throughout. Ties between languages go to the first in alphabetical order. Null doc_id: never held out.
Repeated rows are predicted alike. Whole texts are read, however long, in slices. Columns other than doc_id, text and lang
are not read; `accepted` gives all columns back, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import filled, held_out, numbered, raw, rows, table, text_slices

BUCKETS = 1 << 16
#: Bytes that are no letters in ASCII end a word.
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the letters' bytes of all texts, in order: trigram bucket, first position of each word, word's text, and
    the number of words of each text."""
    data, at = raw(pc.utf8_lower(texts))
    n = len(at) - 1
    buf = np.full(int(at[-1] - at[0]) + n + 2, 32, np.uint8)
    src = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(data) else np.zeros(0, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(at))
    buf[np.arange(len(src)) + doc + 1] = src
    letter = _WORD[buf].view(bool)
    buf[~letter] = 32
    spot = np.flatnonzero(letter)
    code = buf[spot - 1].astype(np.uint32) | buf[spot].astype(np.uint32) << np.uint32(8) | buf[spot + 1].astype(np.uint32) << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    first = np.flatnonzero(~letter[spot - 1])
    owner = np.searchsorted(at - at[0] + np.arange(n + 1) + 1, spot[first], side="right") - 1
    return bucket, first, owner, np.bincount(owner, minlength=n)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (bucket, language). docs: text, lang; rows that lack either are passed over."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part in text_slices(b):
                langs = part.column("lang").dictionary_encode()
                bucket, first, owner, _ = _grams(filled(part.column("text")))
                kind = langs.indices.to_numpy(zero_copy_only=False)[owner]
                per_byte = np.repeat(kind, np.diff([*first, len(bucket)]))
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    got = np.bincount(bucket[per_byte == k], minlength=BUCKETS)
                    sums[lang] = sums[lang] + got if lang in sums else got
        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
        for lang, got in sums.items():
            some = np.flatnonzero(got)
            yield rows({"lang": [lang] * len(some), "bucket": some, "n": got[some]}, schema)

    counted = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[found["bucket"], np.searchsorted(langs, found["lang"])] += found["n"]
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _em(p: np.ndarray, n_words: np.ndarray, mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (text, language) within mask and the log-likelihood; p: words by language, texts without a gap."""
    owner, first = np.repeat(np.arange(len(n_words)), n_words), np.concatenate([[0], np.cumsum(n_words)[:-1]])
    pi = mask / mask.sum(1, keepdims=True)
    for _ in range(rounds):
        r = p * pi[owner]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first) / n_words[:, None]
    return pi, np.add.reduceat(np.log((p * pi[owner]).sum(1)), first)


def infer(texts: pa.Array, logp: np.ndarray, penalty: float = 3.0, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (text, language), all zero where there is no word, of the set of languages that is chosen."""
    out = np.zeros((len(texts), logp.shape[1]))
    bucket, first, _, n_words = _grams(texts)
    if not len(first) or not logp.shape[1]:
        return out
    score = np.empty((len(first), logp.shape[1]), np.float32)
    for k in range(logp.shape[1]):
        score[:, k] = np.add.reduceat(logp[:, k][bucket], first)
    p = np.exp(score - score.max(1, keepdims=True)) + 1e-4
    has = np.flatnonzero(n_words)
    n = n_words[has]
    pi, _ = _em(p, n, np.ones((len(n), p.shape[1])), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(len(n)), n)
    best = np.zeros_like(pi)
    best[np.arange(len(n)), order[:, 0]] = 1
    value = np.add.reduceat(np.log(p[np.arange(len(p)), order[owner, 0]]), start)
    open_ = np.ones(len(n), bool)
    for k in range(2, p.shape[1] + 1):
        open_ &= pi[np.arange(len(n)), order[:, k - 1]] > 0.01
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        mask = np.zeros((len(at), p.shape[1]))
        np.put_along_axis(mask, order[at, :k], 1.0, 1)
        own, like = _em(p[open_[owner]], n[at], mask, rounds)
        gain = like - penalty * (k - 1) * np.log(n[at] + 1.0)
        up = gain > value[at]
        best[at[up]], value[at[up]] = own[up], gain[up]
    out[has] = best
    return out


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, penalty: float = 3.0) -> DataFrame:
    """docs' doc_id with lang_pred, score, and languages and proportions of the chosen set (largest first)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((langs, logp))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])

    def run(batches):
        langs, logp = model.value
        for b in batches:
            for part in text_slices(b):
                texts = filled(part.column("text"))
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                pi = infer(texts, logp, penalty)
                pred, score, sets, props = [], [], [], []
                for ok, row in zip(letters, pi, strict=True):
                    found = [k for k in np.argsort(-row, kind="stable") if row[k] > 0] if ok else []
                    pred.append(langs[found[0]] if found else "und")
                    score.append(min(1.0, float(row[found[0]])) if found else 0.0)
                    sets.append([langs[k] for k in found])
                    props.append([float(row[k]) for k in found])
                yield rows({"doc_id": part.column("doc_id"), "lang_pred": pred, "score": score, "languages": sets, "proportions": props}, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def accepted(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted language is not 'und'. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))
    plain, at = numbered(docs), docs.columns.index("text")

    def run(batches):
        langs, logp = model.value
        for b in batches:
            for part in text_slices(b, f"c{at}"):
                texts = filled(part.column(at))
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(letters & (infer(texts, logp).sum(1) > 0)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fit_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Fit on the rows of docs that are not held out (crc32 of the id mod 4 is not 2)."""
    return fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, *fit_documents(docs))
    return out.withColumn("held_out", held_out(F.col("doc_id"), 4, 2)).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_language_id": op6_language_id}
