"""Exact dedup, line dedup, Jaccard join and embedding near-dedup against brute force, with their edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import embedding_dedup, exact_dedup, graph, jaccard_join, line_dedup
from factloom.llm.cuckoo import CuckooFilter, CuckooIndex, ShardedIndex, filter_of

DOCS = "doc_id long, text string, lang string, source string, digest string"
EDGE = ["Same Text", "same text", None, "", "é É", "É é", "x" * 200_000, "x" * 200_000, "Same Text", " \t\n"]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[k] if ids else k, t, "en", "s", "clash") for k, t in enumerate(texts)], DOCS).repartition(3)


def az(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_cuckoo_filter_and_index():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint64).reshape(-1, 4)
    f = CuckooFilter(8000)
    assert not len(f.insert(keys)) and f.contains(keys).all() and len(f) == 5000
    assert not len(f.remove(keys[:2500])) and f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).sum() < 50
    index = CuckooIndex([np.maximum, np.add], 4)
    for k in range(0, 5000, 700):
        index.put(keys[k : k + 700], [np.arange(k, min(k + 700, 5000)), np.ones(len(keys[k : k + 700]), np.int64)])
    index.put(keys[::2], [np.zeros(2500, np.int64), np.ones(2500, np.int64)])
    held, (most, times) = index.get(keys)
    assert index.resized and held.all() and (most == np.arange(5000)).all() and (times == 1 + (np.arange(5000) % 2 == 0)).all()
    assert index.delete(keys[:1]).all() and not index.delete(keys[:1]).any() and not index.get(keys[:1])[0].any() and index.count == 4999
    # keys that share a first word are told apart by the others
    twins = np.array([[7, 1, 1, k] for k in range(6)], np.uint64)
    index.put(twins, [np.arange(6), np.ones(6, np.int64)])
    assert index.get(twins)[1][0].tolist() == list(range(6)) and index.delete(twins[2:3]).all() and index.get(twins)[0].tolist() == [True, True, False, True, True, True]


def test_filter_overflow_keeps_what_it_holds():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(400)), np.uint64).reshape(-1, 4)
    f = CuckooFilter(64)
    lost = f.insert(keys)
    assert len(lost) and np.delete(f.contains(keys), lost).all()
    assert filter_of(keys).contains(keys).all()


def test_sharded_index_touches_only_its_shards(spark):
    key = lambda k: hashlib.blake2b(str(k).encode(), digest_size=16).digest()
    post = lambda pairs: spark.createDataFrame([(key(k), d) for k, d in pairs], "key binary, doc_id long")
    index = ShardedIndex(spark, 16, shards=8)
    first = index.change(post([(k, k % 7) for k in range(300)]), 1)
    assert len(first) == 8
    filters = dict(index.filters)
    one = index.change(post([(5, 900)]), 1)
    assert len(one) == 1 and [s for s in filters if index.filters[s] != filters[s]] == one
    found = lambda ks: {bytes(r.key): (r.refs, r.first_id, r.last_id) for r in index.lookup(post([(k, 0) for k in ks])).collect()}
    assert found([5, 6, 1000]) == {key(5): (2, 5, 900), key(6): (1, 6, 6)}
    assert index.change(post([(5, 5), (6, 6), (6, 1)]), -1) and found([5, 6]) == {key(5): (1, 900, 900)}
    # the filter itself has forgotten the key that is gone, and holds the other
    assert {bytes(r.key) for r in index.passing(post([(5, 0), (6, 0)]).select("key")).collect()} == {key(5)}
    assert index.change(post([(6, 6), (5, 900)]), 1) and found([5, 6]) == {key(5): (1, 900, 900), key(6): (1, 6, 6)}
    more = index.change(post([(k, 1) for k in range(1000, 4000)]), 1)  # overflows the small filters
    assert len(more) == 8 and len(found(range(1000, 4000))) == 3000 and found([5, 6])[key(6)] == (1, 6, 6)


def test_exact(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, EDGE)).collect()}
    groups = defaultdict(list)
    for k, t in enumerate(EDGE):
        groups[az(t)].append(k)
    for text, own in groups.items():
        for k in own:
            assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (max(own), len(own), k == max(own), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_null_and_repeated_ids(spark):
    got = exact_dedup.exact_dedup(docs(spark, ["a", "A", "b", "c", "c"], [None, 7, None, 3, 3])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("3", "3", 2, True), ("3", "3", 2, True), ("7", "7", 2, True), ("None", "7", 2, False), ("None", "None", 1, False)]


def test_exact_large_group(spark):
    """A group of a third of the rows is spread over all partitions and comes back whole."""
    texts = ["copy"] * 1000 + [f"own {k}" for k in range(2000)]
    got = exact_dedup.exact_dedup(docs(spark, texts)).toPandas()
    assert len(got) == 3000 and (got[got.group_size == 1000].keep_id == 999).all() and (got.group_size == 1000).sum() == 1000


def test_live_index(spark):
    index = exact_dedup.LiveDigestIndex(spark)
    index.insert(docs(spark, ["a", "b", "A"]))
    index.delete(spark.createDataFrame([(2,)], "doc_id long"))
    found = {r.doc_id: r.copy_of for r in index.lookup(docs(spark, ["B", "a", "new"], [10, 11, 12])).collect()}
    assert found == {10: 1, 11: 0, 12: None}


def plain_lines(rows):
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line.strip(space)) >= 10:
                holders[az(line.strip(space))].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(x.strip(space)) >= 10 and len(holders[az(x.strip(space))]) > 1 and min(holders[az(x.strip(space))]) < i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines(spark):
    rng = random.Random(3)
    pool = [f"A Shared line number {k}" for k in range(6)] + ["short", "", "  padded LINE here\t", "padded line here", "ééééééééé", "éééééééééé"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(80)] + [None, "", "\n\n", "only mine, long enough"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert got == plain_lines(list(enumerate(texts)))
    assert line_dedup.drop_lines(docs(spark, [])).count() == 0
    nulls = line_dedup.drop_lines(docs(spark, [pool[0], pool[0], pool[0]], [None, 5, 5])).collect()
    assert all(r.n_dropped == 0 for r in nulls)  # a null id holds nothing, and rows of one id are one document


def test_line_index_is_reversible(spark):
    index = line_dedup.LineIndex(spark)
    both = docs(spark, ["a line of some length\nx", "a line of some length\ny"])
    index.insert(both)
    assert {r.doc_id: r.n_dropped for r in index.clean(both).collect()} == {0: 0, 1: 1}
    index.delete(spark.createDataFrame([(0,)], "doc_id long"))
    assert {r.doc_id: r.n_dropped for r in index.clean(both).collect()}[1] == 0
    index.insert(both.filter("doc_id = 0"))
    assert {r.doc_id: r.n_dropped for r in index.clean(both).collect()} == {0: 0, 1: 1}


def plain_sets(texts, k=4):
    out = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", az(t))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "percent", "long_list"), [(4, 85, None), (5, 80, 2)])
def test_jaccard(spark, monkeypatch, k, percent, long_list):
    if long_list:  # nearly all lists are dealt out by cells, in small blocks
        monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
        monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = []
    for size in (8, 30, 120):
        base = [word() for _ in range(size)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own).title() if rng.random() < 0.3 else "  ".join(own))
    passage = " ".join(word() for _ in range(40))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(1, 30)))}" for _ in range(30)]
    texts += [None, "", " \n", "one", "One", "one two three", "same same same same same same", "same same same same", "w " * 3000, texts[0], texts[0]]
    sets = plain_sets(texts, k)
    links = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), k, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_long_lists_are_dealt_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rng = random.Random(3)
    rows = [(7, k, n := rng.randint(20, 400), rng.randint(0, n // 5), k) for k in range(3000)]
    post = spark.createDataFrame(rows, "h long, doc_id long, n long, pos int, comp long")
    out = jaccard_join.long_lists(post, 85).toPandas()
    sizes = out.groupby(["x", "y", "side"]).size()
    assert sizes.max() <= 3 * 32
    met = set()
    for _, own in out.groupby(["x", "y"]):
        left, right = own[own.side == 0].doc_id.tolist(), own[own.side == 1].doc_id.tolist()
        met |= {(min(a, b), max(a, b)) for a in left for b in (right or left) if a != b}
    could = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1 :] if min(a[2] - a[3], b[2] - b[3]) >= -(-85 * (a[2] + b[2]) // 185)}
    assert could and could <= met and len(met) < 3000 * 2999 / 2


def test_jaccard_null_ids_and_empty(spark):
    got = jaccard_join.jaccard_components(docs(spark, ["a b c d e", "a b c d e", "a b c d e", "a b c d e"], [None, 4, 4, 2])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("2", "2"), ("4", "2"), ("4", "2"), ("None", "None")]
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(7, 7)]
    got = {r.node: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = components({x for p in links for x in p}, links)
    assert all(got.get(i, i) == c for i, c in want.items())


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, 16))
    near = base[:60].repeat(4, 0) + rng.normal(size=(240, 16)) * 0.15
    dense = base[0] + rng.normal(size=(150, 16)) * 0.2
    return [list(map(float, v)) for v in np.concatenate([base, near, dense, base[:5], base[:5] * 3.0])]


def test_embeddings(spark):
    rows = vectors()
    special = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows + special)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T
    degree = (g >= 0.9).sum(1) - 1
    found = sum(got[k].n_links for k in range(len(rows)))
    assert found <= degree.sum() and found >= 0.9 * degree.sum()
    assert all(got[k].n_links <= degree[k] + 1e-9 for k in range(len(rows)))
    want = components(range(len(rows)), zip(*np.nonzero(g >= 0.9), strict=True))
    assert np.mean([got[k].component_id == want[k] for k in range(len(rows))]) >= 0.9
    for k in range(len(rows), len(rows) + len(special)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_links_count_for_both_ends(spark):
    rows = vectors()
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(3)
    groups = embedding_dedup.classes(df)[1]
    size = {r.rep_id: r["size"] for r in groups.collect()}
    # one list is asked, so many pairs are found from one side only; with equal classes as size 1, each adds to both
    found = embedding_dedup.links(groups, probes=1).collect()
    total = {}
    for r in found:
        if r.n is not None:
            total[r.a] = total.get(r.a, 0) + r.n
    linked = {x for r in found if r.b is not None for x in (r.a, r.b)}
    assert linked and all(total.get(x, 0) > 0 for x in linked)
    x = {r.rep_id: np.frombuffer(bytes(r.v)) for r in groups.collect()}
    most = {a: sum(size[b] for b in x if b != a and x[a] @ x[b] >= 0.9 - 1e-12) for a in linked}
    assert all(total[a] <= most[a] for a in linked)


def test_embeddings_of_each_length_link(spark):
    rows = [[1.0, 0.01 * k, 0.0, 0.0] for k in range(6)] + [[1.0, 0.01 * k, 0.0] for k in range(4)] + [[0.0, 0.0, 1.0], [1.0, 0.0]]
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {k: (5, 0) for k in range(6)} | {k: (3, 6) for k in range(6, 10)} | {10: (0, 10), 11: (0, 11)}


def test_embeddings_of_any_magnitude_link(spark):
    rows = [[1e200, 2e200, 3e200], [1e-200, 2e-200, 3e-200], [1.0, 2.0, 3.0], [1e-310, 2e-310, 3.0001e-310], [-1e300, 0.0, 0.0], [-1.0, 1e-9, 0.0]]
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {k: (3, 0) for k in range(4)} | {4: (1, 4), 5: (1, 4)}


def test_embedding_lists_asked_are_measured(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 16))
    rows = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25])
    df = spark.createDataFrame([(k, list(map(float, v)), 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    groups = embedding_dedup.classes(df)[1]
    lists = 40
    model = spark.sparkContext.broadcast(embedding_dedup.fitted(groups, 16, 1200, lists))
    asked = embedding_dedup.asked_lists(groups, 16, model, 0.9)
    x = {r.rep_id: np.frombuffer(bytes(r.v)) for r in groups.collect()}
    v = np.stack([x[k] for k in sorted(x)])
    i, j = np.nonzero(np.triu(v @ v.T >= 0.9, 1))
    near = embedding_dedup._nearest(v, model.value.coarse, asked)
    found = (near[i] == near[j, :1]).any(1) | (near[j] == near[i, :1]).any(1)
    assert 1 <= asked <= lists and found.mean() >= 0.95


def test_embedding_probes_keep_recall_as_lists_grow():
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for lists in (282, 900):
        base = unit(rng.normal(size=(lists * 64, 64)))
        coarse = embedding_dedup._kmeans(base, lists, 3, 1)
        a = base[:4000]
        away = rng.normal(size=a.shape)
        cos = rng.uniform(0.9, 1, (len(a), 1))
        b = cos * a + np.sqrt(1 - cos**2) * unit(away - (away * a).sum(1, keepdims=True) * a)
        near = [embedding_dedup._nearest(v, coarse, embedding_dedup.probes_of(lists)) for v in (a, b)]
        found = (near[0] == near[1][:, :1]).any(1) | (near[1] == near[0][:, :1]).any(1)
        assert found.mean() >= 0.97


def test_embedding_copies_count_as_links(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0, 3.0, 4.0], 1) for k in range(50)] + [(99, [-1.0, 0.0, 0.0, 0.0], 1), (None, [1.0, 2.0, 3.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert all(got[k] == (49, 0) for k in range(50)) and got[99] == (0, 99) and got[None] == (0, None)
