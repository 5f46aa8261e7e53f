"""Toxicity, mixing, LM scoring, SentencePiece, language ID, WARC and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import langid, lm, mixing, pieces, queries, toxicity, warc
from factloom.llm.common import hashes
from tests.llm.test_dedup import az, components, plain_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n\t", "12345 !!", "x" * 100_000, "a", "😀 日本語 ▁ mixed", "É", "\x00\x01"]


def edge_docs(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(EDGE)] + [(None, "no id here", None, None, 0), (1, "", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("score", "n", "h", "prob", "digest")})


# ---- toxicity ------------------------------------------------------------------------------------------------------


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    dense = (rng.random((500, 40)) < 0.15) * rng.random((500, 40))
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    owner, term = np.nonzero(dense)
    for heavy in (1, 5, 10**9):  # all terms as lists, some, all as a matrix
        monkeypatch.setattr(toxicity, "HEAVY", heavy)
        index = toxicity.BlockMaxIndex(owner, term, dense[owner, term], 500, 40)
        asked, t = np.nonzero(dense[:60])
        q, e, cos = index.nearest(asked, t, dense[asked, t], 60, 10, skip=(np.arange(60), np.arange(60)))
        for k in range(60):
            want = np.round(dense @ dense[k], 12)
            want[k] = 0.0
            order = [i for i in np.lexsort((np.arange(500), -want))[:10] if want[i] > 0]
            assert e[q == k].tolist() == order and np.allclose(cos[q == k], want[order])


def test_toxicity_held_out(spark):
    d = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op1_toxicity"](spark, d).toPandas().set_index("doc_id")
    labels = spark.read.parquet(d + "/labels.parquet").toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all() and len(got) == 1000
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    j = got.join(labels, how="inner")
    assert j[j.toxic == 1].score.mean() > j[j.toxic == 0].score.mean() + 0.2


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs(spark), labels)
    out = toxicity.score(edge_docs(spark), model).collect()
    assert len(out) == len(EDGE) + 2 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(edge_docs(spark), labels.limit(0)) == 0.0
    assert toxicity.score(edge_docs(spark).limit(0), model).count() == 0


def terms_of(word):
    word = word.lower().strip(toxicity._OUTER)
    return [word, *("^" + word[:n] for n in (4, 5, 7) if len(word) >= n)] if word else []


def test_terms_are_told_apart():
    words = ["Haus", "haus!", "häuser", "häuserreihe", "haus", "...", "", "日本語の本", "x" * 5000, "abcd", "abcde", "«abcdefg»", "abcdefgh"]
    h, n = toxicity._hashed(pa.array(words))
    assert n.tolist() == [len(terms_of(w)) for w in words]
    assert len(set(h.tolist())) == len({t for w in words for t in terms_of(w)})
    names = dict(zip([t for w in words for t in terms_of(w)], h.tolist(), strict=True))
    assert all(names[t] == x for t, x in zip([t for w in words for t in terms_of(w)], h.tolist(), strict=True))


def test_toxicity_neighbours_go_by_every_term(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    terms = {r.doc_id: Counter(t for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for t in terms_of(w)) for r in docs.collect()}
    model_ = model.held.value
    known = {t for i in model_.ids for t in terms[int(i)]}
    df = Counter(t for c in terms.values() for t in c)
    weigh = lambda c: {t: (1 + np.log(n)) * (np.log((1 + len(terms)) / (1 + df[t])) + 1) for t, n in c.items() if t in known}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    examples = [weigh(terms[int(i)]) for i in model_.ids]
    assert len(known) == len(model_.wanted) > 1000
    out = toxicity.score(docs, model).collect()
    assert len({round(r.score, 9) for r in out}) > 5
    for r in out:
        v = weigh(terms[r.doc_id])
        cos = sorted((sum(x * e.get(t, 0) for t, x in v.items()) / (norm(v) * norm(e)) for e in examples if v and e), reverse=True)
        assert [e.similarity for e in r.evidence] == pytest.approx([c for c in cos[:3] if c > 0], abs=1e-9)


def test_monotone():
    x, v = toxicity._monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]), np.ones(4))
    assert (np.diff(v) >= 0).all() and np.interp(0.25, x, v) == 0.5


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_rake_meets_targets(spark):
    rng = random.Random(4)
    rows = [(s, lang, t, rng.randint(10, 500), 1) for s in "abc" for lang in "xy" for t in "uv"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n_docs long")
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"u": 0.5, "v": 0.5}}
    out = mixing.rake(cells, targets, 40).toPandas()
    for dim, want in targets.items():
        assert out.groupby(dim).weight.sum().to_dict() == pytest.approx(want, abs=1e-6)
    assert out.prob.max() == pytest.approx(1) and (out.prob > 0).all()
    share = (out.prob * out.tokens).groupby(out.source).sum()
    assert (share / share.sum()).to_dict() == pytest.approx(targets["source"], abs=1e-6)


def test_mixing_edges(spark):
    out = {(r.doc_id, r.n_tokens): r for r in mixing.mix(edge_docs(spark)).collect()}
    assert len(out) == len(EDGE) + 1 and all(0 < r.prob <= 1 for r in out.values()) and out[None, 3].source == "(none)"
    empty = edge_docs(spark).filter("text IS NULL")
    assert [(r.prob, r.sampled) for r in mixing.mix(empty).collect()] == [(1.0, True)]
    assert mixing.mix(edge_docs(spark).limit(0)).count() == 0
    kept = mixing.mixed_sample(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns


def test_mixing_shuffled_join_gives_the_same(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    a = rows(mixing.mix(d))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert rows(mixing.mix(d)) == a


def test_rare_cell_leaves_the_sample_its_size(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rare = spark.createDataFrame([(10**9, "five words of its own", "en", "a source of its own", 21)], DOCS).select(*d.columns)
    tokens = F.sum("n_tokens")
    for docs in (d, d.unionByName(rare)):
        out = mixing.mix(docs)
        assert out.agg(F.sum(F.col("prob") * F.col("n_tokens")) / tokens).first()[0] == pytest.approx(mixing.SHARE, abs=1e-3)
    assert out.filter("doc_id = 1000000000").first().prob == 1
    # the other cells still meet the language and topic marginals among what can be met
    got = {r.lang: r.m for r in out.groupBy("lang").agg(F.sum(F.col("prob") * F.col("n_tokens")).alias("m")).collect()}
    want = {r.lang: r.m ** mixing.TARGETS["lang"] for r in out.groupBy("lang").agg(tokens.alias("m")).collect()}
    assert all(got[x] / sum(got.values()) == pytest.approx(want[x] / sum(want.values()), abs=0.02) for x in want)


# ---- LM scoring ----------------------------------------------------------------------------------------------------


def test_attention_is_causal_and_proper():
    m = lm.AttentionLM(50)
    m.start_words(np.ones(3))
    m.ready(np.arange(50) % 2 == 0)
    rng = np.random.default_rng(1)
    ids, bounds = rng.integers(0, 50, 70).astype(np.int32), np.array([0, 40, 70])
    none = np.full(70, -1)
    a, *_ = m.log10(ids, bounds, none)
    changed = ids.copy()
    changed[20] = (changed[20] + 1) % 50
    b, *_ = m.log10(changed, bounds, none)
    assert np.allclose(a[:20], b[:20], atol=1e-6) and np.allclose(a[40:], b[40:], atol=1e-6) and abs(a[21] - b[21]) > 1e-6
    assert a[0] == 0 and a[40] == 0 and (a[1:40] < 0).all()
    # probabilities of the next id add up to 1, those of the ids that begin a word to what is said of them
    total = np.zeros(50)
    for x in range(50):
        ids[39] = x
        total[x] = 10 ** m.log10(ids, bounds, none)[0][39]
    assert total.sum() == pytest.approx(1, abs=1e-4) and np.log10(total[::2].sum()) == pytest.approx(m.log10(ids, bounds, none)[1][39], abs=1e-4)
    # the blocks do not matter, and the layout in strides gives what windows give
    at, inside, scored = m.windows(bounds)
    _, g, *_ = m.forward(ids[at], inside)
    want = np.zeros((70, lm.MIX))
    want[(at[:, lm.CONTEXT :] + 1)[scored]] = g[scored]
    for block in (1, 3, 1024):
        got = np.zeros((70, lm.MIX))
        for own, to in m.mixtures(ids, bounds, block):
            got[to] = own / own.sum(1, keepdims=True)
        assert np.allclose(got, want, atol=1e-5)


def test_spellings_of_all_words_add_up_to_one():
    """Ids 0 and 1 begin a word, 2 and 3 go on, 4 ends the text: words of up to 5 ids, the end, and what goes on."""
    m = lm.AttentionLM(5, seed=3)
    m.start_words(np.ones(1))
    starts = np.array([True, True, False, False, True])
    m.ready(starts)
    for lead in ([], [0, 2, 1, 3, 3]):
        total, open_ = 0.0, [[]]
        for n in range(6):
            more = [w + [i] for w in open_ for i in ((0, 1) if not w else (2, 3))]
            texts = [[4, *lead, *w, 4] for w in more]
            spelled, begins, _ = m.log10(np.array(sum(texts, []), np.int32), np.cumsum([0, *map(len, texts)]), np.full(sum(map(len, texts)), -1))
            ends = np.cumsum([len(t) for t in texts]) - 1
            chain = np.array([spelled[e - n - 1 : e].sum() - begins[e - n - 1] for e in ends])
            if not n:
                text = np.array([4, *lead, 4], np.int32)
                s, b, _ = m.log10(text, np.array([0, len(text)]), np.full(len(text), -1))
                total += 10 ** (s[-1] - b[-1])
            if n == 5:
                total += (10**chain).sum()  # whatever follows: the words of six ids and all that begin like them
            else:
                total += (10 ** (chain + begins[ends])).sum()
            open_ = more
        assert total == pytest.approx(1, abs=1e-4)


def test_words_encoded_together_are_as_alone():
    encoder = lm.Encoder(lm.load())
    for words in (["a", "Haus", "don't", "x1y2", "été,", "日本", "!!", "12345", "x" * 300], ["no\u00a0break", "a\u2003", "b"]):
        ids, first = encoder.words(pa.array(words))
        assert [ids[i:j].tolist() for i, j in zip(first[:-1], first[1:])] == [encoder.bpe.encode_ordinary(" " + w) for w in words]


def test_lm_base_and_score(spark):
    d = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op3_lm_scoring"](spark, d).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    words = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", az(r.text)), None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held[i])
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
    assert (got.score < 0).all() and got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_lm_score_equals_plain_loops(spark, monkeypatch):
    """The score of each text, from the fitted tables, one id and one word at a time."""
    rng = random.Random(9)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(40)]
    texts = [" ".join(rng.choices(pool, weights=range(40, 0, -1), k=n)) for n in (1, 3, 9, 25, 70, 140)] + ["", "é日本 zzzz Unseen"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fit, kept = lm.fit, {}
    monkeypatch.setattr(lm, "fit", lambda train, frequent, *a: kept.update(m=fit(train, frequent, *a), f=frequent) or kept["m"])
    monkeypatch.setattr(lm, "HOT", 20)  # so that some words are frequent and others are not
    train = d.filter("doc_id < 6")
    got = {r.doc_id: r for r in lm.score(d, train).collect()}
    m, frequent, encoder = kept["m"], kept["f"], lm.Encoder(lm.load())
    c = Counter(w for t in texts[:6] for w in t.split())
    n_all, ends = sum(c.values()) + 6, 6
    hot = {w: int(frequent.find(hashes(pa.array([w])))[0]) for w in c if c[w] >= max(2, n_all // 20)}
    assert 0 < len(hot) < len(c)
    unseen = min(0.5, max(1e-3, sum(x == 1 for x in c.values()) / n_all))
    share = (sum(c[w] for w in hot) + ends) / n_all
    begins = m.u[encoder.begins].sum(0)
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", az(t))
        ids, first = [encoder.end], []
        for w in words:
            first.append(len(ids))
            ids += encoder.bpe.encode_ordinary(" " + w)
        ids.append(encoder.end)
        g = [None]
        for to in range(1, len(ids)):
            j = to - 1
            keys = range(max(0, (j // lm.STRIDE - 1) * lm.STRIDE), j + 1)
            a = np.array([np.exp(float(m.q[ids[j]] @ m.k[ids[i]]) + float(m.distance[j - i])) for i in keys])
            z = (a[:, None] * np.stack([m.v[ids[i]] for i in keys])).sum(0) / a.sum() + m.r[ids[j]]
            g.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        total = 0.0
        for w, at, stop in zip([*words, None], [*first, len(ids) - 1], [*first[1:], len(ids) - 1, None], strict=False):
            spelled = np.prod([g[i] @ m.u[ids[i]] for i in range(at, stop if w else at + 1)]) / (g[at] @ begins) * (g[stop] @ begins if w else 1.0)
            whole = frequent.end if w is None else hot.get(w)
            counted = share * (g[at] @ m.w[whole]) if whole is not None else c[w] / n_all
            total += np.log10((1 - unseen) * counted + unseen * spelled)
        assert got[k].score == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_lm_edges(spark):
    d = edge_docs(spark).select("doc_id", "text")
    out = lm.score(d, d).collect()
    assert len(out) == len(EDGE) + 2 and all(np.isfinite([r.score, r.base_score]).all() for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (0, 1, 2)} == {1}
    none = lm.score(d, d.limit(0)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in none)


def test_lm_emissions_cover_every_word(spark, monkeypatch):
    texts = [" ".join(f"w{(k * j) % 50}" for j in range(n)) for k, n in ((1, 5), (3, 300), (7, 2000))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    emit, emit_words = lm.AttentionLM.emit, lm.AttentionLM.emit_words
    monkeypatch.setattr(lm.AttentionLM, "emit", lambda self, e, unigram, *a: (seen.update(expected=e.sum(), unigram=unigram), emit(self, e, unigram, *a))[1])
    monkeypatch.setattr(lm.AttentionLM, "emit_words", lambda self, e, *a: (seen.update(words=e.sum()), emit_words(self, e, *a))[1])
    c = Counter(" ".join(texts).split())
    words = list(c)
    lm.fit(d, lm.Frequent(hashes(pa.array(words)), np.array([c[w] for w in words]), 3))
    encoder = lm.Encoder(lm.load())
    ids = [i for t in texts for i in encoder.words(pa.array(t.split()))[0]]
    want = np.bincount(ids + [encoder.end] * 6, minlength=encoder.end + 1)
    assert (seen["unigram"] == want).all()
    # an id each and the ends are predicted, and every word is frequent here
    assert seen["expected"] == pytest.approx(len(ids) + 3, rel=1e-4) and seen["words"] == pytest.approx(2305 + 3, rel=1e-4)


def test_lm_weights_follow_every_text_and_window(spark):
    """The weights of each id move, wherever it is: 3500 texts, and one long text."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 6)))
    long = [word() for _ in range(3000)]
    texts = [f"{word()} {word()}" for _ in range(3500)] + [" ".join(long)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, encoder = lm.fit(d, lm.Frequent(np.zeros(0, np.int64), np.zeros(0, np.int64), len(texts))), lm.Encoder(lm.load())
    start = lm.AttentionLM(encoder.end + 1)
    ids = np.unique(encoder.words(pa.array(" ".join(texts).split()))[0])
    for name in "qkrv":
        moved = (getattr(got, name) != getattr(start, name)).any(1)
        assert moved[ids].all() and moved.sum() == len(ids) + 1, name  # and the start
    assert (got.distance != 0).all()


def test_lm_rounds_have_each_text_once(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"a{i % 7} b{i % 5}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(lm, "FIRST", 10)
    sizes, taught = [], lm.taught
    monkeypatch.setattr(lm, "taught", lambda texts, *a: (sizes.append(texts.count()), taught(texts, *a))[1])
    monkeypatch.setattr(lm, "PASSES", 1)
    seen, emit = {}, lm.AttentionLM.emit
    monkeypatch.setattr(lm.AttentionLM, "emit", lambda self, e, unigram: (seen.update(ends=unigram[-1]), emit(self, e, unigram))[1])
    lm.fit(d, lm.Frequent(np.zeros(0, np.int64), np.zeros(0, np.int64), 400), lm.VOCABULARY, 1200)
    assert len(sizes) == 3 and sum(sizes) == 400 and seen["ends"] == 800


def test_lm_step_follows_the_gradient(monkeypatch):
    m = lm.AttentionLM(20, seed=5)
    rng = np.random.default_rng(2)
    ids, bounds = rng.integers(0, 20, 90).astype(np.int32), np.array([0, 50, 51, 90])
    m.running = m.running * 100
    own = m.pupil(1)
    m.u = own.u.copy()
    m.start_words(np.ones(1))

    def loss():
        m.ready(np.ones(20, bool))
        return m.log10(ids, bounds, np.full(90, -1))[0].sum() * np.log(10)

    before = m.p.copy()
    own.learn(ids, bounds, np.full(90, -1))
    for i in (3, 11):
        for part in range(4):
            columns = np.arange(16 * part, 16 * part + 16)
            slope = np.zeros(16)
            for j, c in enumerate(columns):
                for step in (0.02, -0.02):
                    m.p[i, c] = before[i, c] + step
                    slope[j] += loss() * np.sign(step)
                m.p[i, c] = before[i, c]
            change = own.p[i, columns] - before[i, columns]
            assert change @ slope / np.linalg.norm(change) / np.linalg.norm(slope) > 0.995, (i, part)


def test_words_of_several_slices_are_encoded_once(monkeypatch):
    texts = ["one two three", "", "two  three FOUR", None, "four one " * 40, "one"]
    batch = pa.record_batch({"doc_id": pa.array(range(6)), "text": pa.array(texts)})
    encoder, known = lm.Encoder(lm.load()), lm.Frequent(hashes(pa.array(["two", "one"])), np.array([3, 5]), 6)
    asked, words = [], lm.Encoder.words
    monkeypatch.setattr(lm.Encoder, "words", lambda self, x: (asked.extend(x.to_pylist()), words(self, x))[1])
    monkeypatch.setattr(lm, "SLICE", 20)
    got = list(lm._encoded(encoder, known, batch))
    assert len(got) > 1 and sorted(asked) == ["four", "one", "three", "two"]
    k = 0
    for part, codes, bounds, h, place, ids, cuts, first in got:
        for i in range(part.num_rows):
            plain = az(texts[k] or "").split()
            spelled = [encoder.bpe.encode_ordinary(" " + w) for w in plain]
            assert ids[cuts[i] : cuts[i + 1]].tolist() == [encoder.end, *sum(spelled, []), encoder.end]
            own = slice(bounds[i], bounds[i + 1])
            assert (h[codes[own]] == hashes(pa.array(plain, pa.string()))).all() if plain else own.start == own.stop
            assert (place[codes[own]] == known.find(h[codes[own]])).all()
            assert ids[first[own]].tolist() == [x[0] for x in spelled]
            k += 1
    assert k == len(texts)


def test_sums_of_rows_in_groups():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 9, 200), rng.permutation(50), np.zeros(17, int), np.array([70_000, 1, 70_000])):
        values = rng.normal(size=(len(ids) + 1, 6)).astype(np.float32)
        values[-1] = 0.0
        at, sums = lm._row_sums(ids.astype(np.int32), values)
        assert at.tolist() == sorted(set(ids.tolist()))
        assert np.allclose(sums, [values[:-1][ids == i].sum(0) for i in at], atol=1e-5)


def test_blocks_leave_nothing_to_the_next_ones():
    """Blocks of other sizes work in the same arrays."""
    rng = np.random.default_rng(6)
    ids, whole = rng.integers(0, 30, 9000).astype(np.int32), rng.integers(-1, 2, 9000)
    kept, fresh = lm.AttentionLM(30, seed=2).pupil(2), lm.AttentionLM(30, seed=2).pupil(2)
    for bounds in (np.array([0, 8900, 9000]), np.array([0, 40, 41, 90]), np.array([0, 1]), np.array([0, 700])):
        n = bounds[-1]
        kept.learn(ids[:n], bounds, whole[:n])
        fresh.room = lm.Room(lm.BLOCK, fresh.p.shape[1])
        fresh.learn(ids[:n], bounds, whole[:n])
        for name in ("p", "fresh", "words", "grown", "distance"):
            assert (getattr(kept, name) == getattr(fresh, name)).all(), name


# ---- SentencePiece -------------------------------------------------------------------------------------------------


def plain_viterbi(m, unit):
    best, back = [0.0], [None]
    for e in range(1, len(unit) + 1):
        score, step = best[e - 1] + m.unknown, (1, None)
        for n in range(1, min(m.longest, e) + 1):
            p = m.plain.get(unit[e - n : e])
            if p and (best[e - n] + p[1] > score or (n == 1 and step[1] is None)):
                score, step = best[e - n] + p[1], (n, p[0])
        best.append(score)
        back.append(step)
    out, e = [], len(unit)
    while e:
        n, i = back[e]
        out.append([i] if i is not None else [int(m.bytes[x]) for x in unit[e - n : e].encode()])
        e -= n
    return [x for y in out[::-1] for x in y]


def test_viterbi_equals_brute_force_and_round_trips(spark):
    m = pieces.Pieces(pieces.load())
    texts = [t or "" for t in EDGE if t is None or len(t) < 1000] + ["  two  spaces ", " lead", "trail ", "a\nb\tc"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    # as a unigram model: some scores, and any piece after any other
    joins, m.joins = m.joins, None
    m.scores = -np.log(np.minimum(-m.scores, 1e6) + 300.0)
    m.plain = {w: (i, float(m.scores[np.flatnonzero(m.ids == i)[0]])) for w, (i, _) in m.plain.items()}
    m.unknown = float(m.scores.min()) - 10.0
    ids, bounds = pieces.encode(m, pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        want = [x for u in re.findall(" +[^ ]*", " " + t) for x in plain_viterbi(m, u)] if t else []
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want
    assert [x.decode() for x in pieces.decode(m, ids, bounds)] == texts


def test_bpe_ids_are_the_library_s(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.load())
    m = pieces.Pieces(pieces.load())
    assert m.joins is not None
    rng = random.Random(2)
    odd = ["".join(rng.choices("abcdeéß日  0123.,\n", k=rng.randint(1, 40))) for _ in range(300)]
    # (the library takes the character that stands for a space for one; here it is kept, as bytes)
    texts = [t.replace("▁", "_") for t in EDGE if t and len(t) < 1000] + ["  two  spaces ", " lead", "trail ", "a\nb\tc", "x" * 500] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text] + odd
    ids, bounds = pieces.encode(m, pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == sp.encode(t), t
    assert [x.decode() for x in pieces.decode(m, ids, bounds)] == texts


def test_encoding_edges(spark):
    out = pieces.encoded(edge_docs(spark)).collect()
    assert all(r.round_trip for r in out) and len(out) == len(EDGE) + 2
    assert {r.decoded_sha256 for r in out if r.doc_id == 0} == {hashlib.sha256(b"").hexdigest()}
    assert pieces.encoded(edge_docs(spark).limit(0)).count() == 0


# ---- language ID ---------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    d = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op6_language_id"](spark, d).toPandas().set_index("doc_id")
    lang = spark.read.parquet(d + "/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())
    assert (got.lang_pred == lang.reindex(got.index))[got.held_out].mean() > 0.97


def test_language_mixture_and_edges(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    langs, logp = langid.fit_documents(d)
    en, de = (d.filter(f"lang = '{x}' AND n_chars BETWEEN 500 AND 3000").first().text for x in ("en", "de"))
    pi = langid.infer(pa.array([en + " " + de, en], pa.large_string()), logp)
    both = dict(zip(langs, pi[0], strict=True))
    assert both["en"] > 0.1 and both["de"] > 0.1 and pi[0].sum() == pytest.approx(1) and pi[1][langs.index("en")] > 0.9
    out = {(r.doc_id): r for r in langid.predict(edge_docs(spark), langs, logp).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (0, 1, 2, 3)) and out[7].lang_pred in langs
    none, empty = langid.fit_documents(d.limit(0))
    assert none == [] and {r.lang_pred for r in langid.predict(edge_docs(spark), none, empty).collect()} == {"und"}
    kept = langid.accepted(edge_docs(spark), langs, logp)
    assert kept.columns == edge_docs(spark).columns and {r.doc_id for r in kept.collect()} >= {4, 5, None}


def plain_languages(text, logp, rounds=8, penalty=3.0):
    """Proportions by plain loops: words of letters' bytes, their trigrams, expectation-maximisation, penalised sets."""
    data = [x if chr(x).isascii() and chr(x).isalpha() or x >= 128 else 32 for x in text.lower().encode()]
    buf = [32, *data, 32]
    words, own = [], None
    for i in range(1, len(buf) - 1):
        if buf[i] == 32:
            own = None
            continue
        code = buf[i - 1] | buf[i] << 8 | buf[i + 1] << 16
        if own is None:
            own = np.zeros(logp.shape[1])
            words.append(own)
        own += logp[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 16]
    p = [np.exp(w - w.max()) + 1e-4 for w in words]

    def em(langs):
        pi = np.array([1.0 / len(langs) if k in langs else 0.0 for k in range(logp.shape[1])])
        for _ in range(rounds):
            pi = np.mean([x * pi / (x @ pi) for x in p], axis=0)
        return pi, sum(np.log(x @ pi) for x in p)

    start, _ = em(set(range(logp.shape[1])))
    order = sorted(range(logp.shape[1]), key=lambda k: (-start[k], k))
    best, value = np.eye(logp.shape[1])[order[0]], sum(np.log(x[order[0]]) for x in p)
    for k in range(2, logp.shape[1] + 1):
        if start[order[k - 1]] <= 0.01:
            break
        pi, like = em(set(order[:k]))
        gain = like - penalty * (k - 1) * np.log(len(p) + 1.0)
        if gain > value:
            best, value = pi, gain
    return best


def test_language_equals_plain_loops(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    langs, logp = langid.fit_documents(d)
    rows = d.filter("n_chars BETWEEN 50 AND 600").orderBy("doc_id").limit(12).collect()
    texts = [r.text for r in rows] + [rows[0].text + " " + rows[1].text, "Ünï còdé", "one", "a b c"]
    got = langid.infer(pa.array(texts, pa.large_string()), logp)
    for t, pi in zip(texts, got, strict=True):
        assert pi == pytest.approx(plain_languages(t, logp.astype(np.float64)), abs=1e-3)


def test_language_ties_go_to_the_first(spark):
    d = spark.createDataFrame([(k, "la la la", lang, "s", 0) for k, lang in enumerate(["b", "a"] * 8)], DOCS)
    langs, logp = langid.fit(d)
    assert langs == ["a", "b"] and {r.lang_pred for r in langid.predict(d, langs, logp).collect()} == {"a"}


def test_language_mixture_of_four(spark):
    d = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    langs, logp = langid.fit_documents(d)
    assert len(langs) >= 4
    texts = [d.filter(f"lang = '{x}' AND n_chars BETWEEN 500 AND 3000").orderBy("doc_id").first().text[:500] for x in langs[:4]]
    pi = langid.infer(pa.array([" ".join(texts)], pa.large_string()), logp)[0]
    assert (pi[:4] > 0.1).all() and pi.sum() == pytest.approx(1)


# ---- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long_ = "<p>" + "é" * 600 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/x y", long_), (2, None, long_), (3, "http://b\r\nX: y", "short"), (4, "http://b", "short"), (5, "u", None), (None, "u", long_), (7, "u", "z" * 300_000), (2, None, long_)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    path = warc.fresh_path(spark, "warc")
    warc.write_warc(pages, path)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(rows) and all(r.request and r.response and r.metadata for r in got)
    kinds = sorted((str(r.page_id), r.response.kind, str(r.response.refers_to), r.response.payload_bytes) for r in got)
    n = len(long_.encode())
    assert [k[:2] + k[3:] for k in kinds] == [("1", "revisit", n), ("2", "response", n), ("2", "response", n), ("3", "response", 5), ("4", "response", 5), ("5", "response", 0), ("7", "response", 300_000), ("None", "revisit", n)]
    assert {r.page_id: bytes(r.response.payload) for r in got if r.response.payload is not None} == {2: long_.encode(), 3: b"short", 4: b"short", 5: b"", 7: b"z" * 300_000}
    path = warc.fresh_path(spark, "warc")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_records(spark, path).count() == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------


def plain_sample(docs):
    """doc_ids that mixing keeps, by plain loops over cells."""

    def topic(t):
        marks = [(" | ", "table"), ("!!", "shout"), ("###", "symbols"), ("***", "symbols")]
        return next((n for m, n in marks if m in t), "licensed" if "licens" in t.lower() else "paragraphs" if "\n" in t else "line")

    of = {i: (r.source, r.lang, topic(r.text)) for i, r in docs.items()}
    tokens = Counter()
    for i, r in docs.items():
        tokens[of[i]] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    whole = sum(tokens.values())
    w, full = {c: n / whole for c, n in tokens.items()}, {c: n / whole / mixing.SHARE for c, n in tokens.items()}
    target = []
    for k, dim in enumerate(mixing.DIMS):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[k]] += n
        total = sum(x ** mixing.TARGETS[dim] for x in sums.values())
        target.append({v: x ** mixing.TARGETS[dim] / total for v, x in sums.items()})
    for _ in range(mixing.SWEEPS):
        for k in range(3):
            for v, t in target[k].items():
                own = [c for c in w if c[k] == v]
                margin, loose = sum(w[c] for c in own), sum(w[c] for c in own if w[c] < full[c])
                for c in own:
                    w[c] = w[c] * t / margin if t <= margin else min(full[c], w[c] * (t - margin + loose) / loose) if w[c] < full[c] else full[c]
    scale = 1.0
    for _ in range(200):
        scale *= (1.0 / sum(min(full[c], w[c] * scale) for c in w)) ** 0.5 if sum(full.values()) > 1 else 1.0
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    return {i for i in docs if draw(i) < min(1.0, w[of[i]] * scale / full[of[i]])}


def test_pipeline_equals_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    alive = {i: r for i, r in docs.items() if re.search(r"[^\W\d_]", r.text or "")}
    best = {}
    for i, r in alive.items():
        best[az(r.text)] = max(best.get(az(r.text), -1), i)
    ids = sorted(best.values())
    sets = dict(zip(ids, plain_sets([docs[i].text for i in ids], 5).values(), strict=True))
    links = [(a, b) for a in ids for b in ids if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    ids = [i for i, c in components(ids, links).items() if i == c]
    want = plain_sample({i: docs[i] for i in ids})
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    m = pieces.Pieces(pieces.load())
    for r in got[:20]:
        assert pieces.decode(m, np.array(r.ids, np.int32), np.array([0, len(r.ids)])) == [docs[r.doc_id].text.encode()]


def test_pipeline_stages_keep_columns(spark):
    """Columns of any name come through with their values, also those that look like an operator's own."""
    odd = ["a.b", "__sha", "__source", "row", "id", "sha", "c0", "text_sha256", "component_id", "topic", "Prob", "n_tokens", "sp ace", "back`tick"]
    docs = first = edge_docs(spark).select("*", *[F.concat(F.lit(f"{x} "), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(x) for x in odd if x.lower() not in ("prob",)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == first.columns, name
        for r in docs.collect():
            own = r.asDict()
            assert all(own[x] == f"{x} {-1 if r.doc_id is None else r.doc_id}" for x in odd if x in own), name
        assert stage(spark, first.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    assert {r.doc_id for r in docs.collect()} <= {4, 5, 6, 7, None}
