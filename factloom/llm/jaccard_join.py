"""N-gram Jaccard join (8): exact set-similarity join with set-relation skipping.

A document's set is its distinct `k`-word shingles (64-bit hashes). Equal sets form a class; classes are joined.

Order: shingles are ordered by a count sketch over all documents (a fixed 2^20 counters), then by hash, so rare ones
come first. The order decides only how many candidates there are, never the answer: prefixes are valid under any order.

Index skipping: prefix postings are grouped by shingle; a list whose entries all have one component is skipped. Lists are
cut into blocks of `BLOCK` entries of like size, ordered by position; a pair of blocks is skipped if their sizes, or the
elements that are left behind their best positions, cannot reach the threshold, and so is a pair of entries, by its own
sizes, positions and a parity bitmap (a lower bound of the symmetric difference). Lists that may be longer than `LONG_LIST`
are never gathered: their entries are counted by (size, position) cells, and the pairs of cells that are left are dealt out
in blocks.

Answer skipping: sets that share a minhash are first compared with the most central set of their group (the one with the
fewest rare shingles), which leads them if they are similar. A pair that is still open is answered from its leaders' pair:
that is compared once, and |a n b| differs from it by no more than a and b differ from their leaders. Only pairs that these
bounds leave open are compared themselves; sets that are known to be in one component are not compared again. Every filter
is lossless.

Null or wordless text: n_shingles 0, own component. Fewer than k words: the whole sequence is the one shingle. Null
doc_id: component null, no links. Rows repeated with one doc_id and text get one answer; ties are links like any other. Very
long texts are shingled whole. Empty table: empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import blocks_of, discard, filled, materialize, reduced, rows, spread_lookup, table, text_slices, words_of
from factloom.llm.graph import components

K, PERCENT = 4, 85
SKETCH_BITS, SKETCH_BLOCK, FILTER_BITS, SIG_WORDS, BLOCK = 20, 1 << 14, 24, 8, 512
#: Lists of shingles that more documents may hold than these are dealt out by cells; sizes and positions of a cell are within CELL.
LONG_LIST, CELL, PARTS = 4096, 1.1, 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_KEYS = [np.uint64(x) for x in (1, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, bounds = words_of(texts)
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    rolled = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        rolled = _mixed(rolled * _ODD[2] + words[j : len(words) - k + 1 + j])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        else:
            h = np.full(min(1, b - a), b - a, np.uint64)
            for w in words[a:b]:
                h = _mixed(h * _ODD[2] + w)
            out.append(h)
    return out


def _bucket(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, k: int = K) -> np.ndarray:
    """How many documents hold a shingle of each of 2^20 hash buckets."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for part in text_slices(b):
                total += np.bincount(_bucket(np.concatenate(shingle_sets(filled(part.column("text")), k))), minlength=1 << SKETCH_BITS)
        yield blocks_of(np.minimum(total, 2**31).astype(np.uint32), SKETCH_BLOCK)

    return reduced(docs.select("text").mapInArrow(run, "block int, data binary"), (1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Sets of n and at most n elements that reach the threshold share one of the first so many elements of either."""
    return n - -(-percent * n // 100) + 1


def described(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, digest (null for empty sets), keys (minhashes), rarity, prefix (ordered hashes), short (how many of them are
    in short lists only), sig (parity bits)."""
    counted = docs.sparkSession.sparkContext.broadcast(sketch(docs, k))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("rarity", pa.float64()), ("prefix", pa.list_(pa.int64())), ("short", pa.int32()), ("sig", pa.binary())])

    def run(batches):
        order = counted.value
        for b in batches:
            for part in text_slices(b):
                out = {c: [] for c in schema.names if c != "doc_id"}
                for s in shingle_sets(filled(part.column("text")), k):
                    out["n"].append(len(s))
                    if not len(s):
                        for c in ("digest", "keys", "rarity", "prefix", "short", "sig"):
                            out[c].append(None)
                        continue
                    c = order[_bucket(s)]
                    first = np.lexsort((s, c))[: prefix_length(len(s), percent)]
                    bits = np.bincount(((s * _ODD[3]) >> np.uint64(64 - 9)).astype(np.int64), minlength=SIG_WORDS * 64) & 1
                    out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    out["keys"].append(np.array([(s * m).min() for m in _KEYS], np.uint64).view(np.int64))
                    out["rarity"].append(float((1.0 / c).mean()))
                    # a bucket that counts one document holds no shared shingle
                    out["prefix"].append(np.where(c[first] > 1, s[first], np.uint64(0)).view(np.int64))
                    out["short"].append(int((c[first] <= LONG_LIST).sum()))
                    out["sig"].append(np.packbits(bits.astype(np.uint8)).tobytes())
                yield rows({"doc_id": part.column("doc_id")} | out, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, rarity double, prefix array<long>, short int, sig binary")


ANSWERS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("linked", pa.bool_())])


def verified(pairs: DataFrame, docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with both (elements in common), n_a, n_b and linked (whether they reach the threshold). Only documents that a fixed 2 MB bitmap of the pairs' ids may
    hold are read out; each pair meets its two sets by joins on the ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).cast("int")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()

    def mark(batches):
        bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        for b in batches:
            at = b.column("place").to_numpy()
            np.bitwise_or.at(bits, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        yield blocks_of(bits, SKETCH_BLOCK)

    words = 1 << (FILTER_BITS - 5)
    bitmap = docs.sparkSession.sparkContext.broadcast(reduced(ids.select(place.alias("place")).mapInArrow(mark, "block int, data binary"), words // SKETCH_BLOCK, SKETCH_BLOCK, "bits"))

    def read(batches):
        bits, schema = bitmap.value, pa.schema([("id", pa.int64()), ("s", pa.binary())])
        for b in batches:
            at = b.column("place").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            for part in text_slices(b):
                yield rows({"id": part.column("id"), "s": [s.tobytes() for s in shingle_sets(filled(part.column("text")), k)]}, schema)

    known = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").withColumn("place", place)
    sets = materialize(known.mapInArrow(read, "id long, s binary").dropDuplicates(["id"]), "sets")

    def compare(batches):
        held, own = None, None
        for b in batches:
            out = []
            for x, y, s, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("s"), b.column("t"), strict=True):
                if x != held:
                    held, own = x, np.frombuffer(s.as_buffer(), np.uint64)
                other = np.frombuffer(t.as_buffer(), np.uint64)
                small, large = (own, other) if len(own) < len(other) else (other, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                out.append((x, y, both, len(own), len(other), 100 * both >= percent * (len(own) + len(other) - both)))
            yield rows({f.name: [r[k] for r in out] for k, f in enumerate(ANSWERS)}, ANSWERS)

    one = pairs.join(sets.withColumnsRenamed({"id": "b", "s": "t"}), "b")
    two = one.join(sets.withColumnRenamed("id", "a"), "a")
    out = materialize(two.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long, both long, n_a long, n_b long, linked boolean"), "answers")
    discard(sets)
    return out


def star_pairs(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each set with the most central set among those that share a minhash with it, for each of four minhashes."""
    each = reps.select("doc_id", "n", "rarity", F.posexplode("keys").alias("k", "key"))
    lead = materialize(each.groupBy("k", "key").agg(F.min(F.struct("rarity", "doc_id", "n")).alias("lead"), F.count("*").alias("c")).filter("c > 1").select("k", "key", "lead"), "leaders")
    near = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    return materialize(each.join(lead, ["k", "key"]).filter((F.col("doc_id") != F.col("lead.doc_id")) & near).select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "star-pairs")


def long_lists(post: DataFrame, percent: int) -> DataFrame:
    """Of postings (h, doc_id, n, pos, comp) of long lists: entries in pairs of blocks (h, x, y, side, ...), as open_pairs
    has them. What is gathered are counts by cell; a block has about BLOCK entries of a cell."""
    behind, log = F.col("n") - F.col("pos"), lambda c: F.floor(F.log(c) / F.lit(float(np.log(CELL)))).cast("long")
    held = materialize(post.select("h", "doc_id", "n", "pos", "comp", (log(F.col("n")) * 1000 + log(behind)).alias("cell")), "long-lists")
    cells = materialize(held.groupBy("h", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(behind).alias("behind"), F.min("comp").alias("low"), F.max("comp").alias("high")), "cells")
    names = ("cell", "parts", "least", "most", "behind", "low", "high")
    a, b = (cells.select("h", *[F.col(c).alias(c + side) for c in names]) for side in "xy")
    need = F.ceil((F.col("leastx") + F.col("leasty")) * percent / F.lit(100 + percent))
    one = (F.least("lowx", "lowy") == F.greatest("highx", "highy"))
    fits = (F.col("cellx") >= F.col("celly")) & (F.least("behindx", "behindy") >= need) & (F.greatest("leastx", "leasty") * percent <= F.least("mostx", "mosty") * 100) & ~one
    part = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    pairs = a.join(b, "h").filter(fits).withColumn("px", part("partsx")).withColumn("py", part("partsy")).filter("cellx <> celly OR px >= py")
    pairs = materialize(pairs.select("h", (F.col("cellx") * PARTS + F.col("px")).alias("x"), (F.col("celly") * PARTS + F.col("py")).alias("y")), "cell-pairs")
    block = F.col("cell") * PARTS + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    dealt = held.join(cells.select("h", "cell", "parts"), ["h", "cell"]).select("h", block.alias("block"), "doc_id", "n", "pos", "comp")
    sides = [dealt.withColumnRenamed("block", own).join(of, ["h", own]).select("h", "x", "y", F.lit(k).alias("side"), "doc_id", "n", "pos", "comp") for k, (own, of) in enumerate((("x", pairs), ("y", pairs.filter("x <> y"))))]
    return sides[0].unionByName(sides[1])


def open_pairs(reps: DataFrame, comps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs of different components, through the prefix index."""
    own = F.coalesce("component_id", "doc_id").alias("comp")
    known = materialize(reps.select("doc_id", "n", "prefix", "short", "sig").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", "prefix", "short", "sig", own), "prefixes")
    post = known.select("doc_id", "n", "comp", "short", F.posexplode("prefix").alias("pos", "h")).filter("h <> 0")
    entry = pa.schema([("h", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("pos", pa.int32()), ("comp", pa.int64())])

    def lists(batches):
        """Entries of lists with more than one component, cut into pairs of blocks."""
        carry = None
        for b in batches:
            t = pa.Table.from_batches([b] if carry is None else [carry, b]).combine_chunks()
            h = t.column("h").to_numpy()
            cuts = np.flatnonzero(np.diff(h)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from emit(t.slice(0, last))
            carry = t.slice(last).to_batches()[0] if last < t.num_rows else None
        if carry is not None:
            yield from emit(pa.Table.from_batches([carry]))

    def emit(t):
        if not t.num_rows:
            return
        col = {c: t.column(c).to_numpy() for c in ("h", "doc_id", "n", "pos", "comp")}
        start = np.concatenate([[0], np.flatnonzero(np.diff(col["h"])) + 1])
        size = np.diff([*start, len(col["h"])])
        mixed = np.minimum.reduceat(col["comp"], start) != np.maximum.reduceat(col["comp"], start)
        for first, m in zip(start[mixed], size[mixed], strict=True):
            parts, at = -(-m // BLOCK), np.arange(first, first + m)
            if parts > 1:
                at = at[np.lexsort((col["pos"][at], (np.log(col["n"][at]) / np.log(CELL)).astype(np.int64)))]
            blocks = np.array_split(at, parts)
            least, most = (np.array([f(col["n"][k]) for k in blocks]) for f in (np.min, np.max))
            behind = np.array([(col["n"][k] - col["pos"][k]).max() for k in blocks])
            for x in range(parts):
                need = -(-percent * (least[x] + least[: x + 1]) // (100 + percent))
                fits = (np.minimum(behind[x], behind[: x + 1]) >= need) & (np.maximum(least[x], least[: x + 1]) * percent <= np.minimum(most[x], most[: x + 1]) * 100)
                for y in np.flatnonzero(fits):
                    for side, z in ((0, x), (1, y)) if x != y else ((0, x),):
                        k = blocks[z]
                        yield rows({"h": col["h"][k], "x": np.full(len(k), x), "y": np.full(len(k), y), "side": np.full(len(k), side)} | {c: col[c][k] for c in ("doc_id", "n", "pos", "comp")}, entry)

    def merged(it):
        held, count = [], 0
        for b in it:
            held.append(b)
            count += b.num_rows
            if count > 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    ordered = post.filter("pos < short").repartition("h").sortWithinPartitions("h", "n", "doc_id").select("h", "doc_id", "n", "pos", "comp")
    entries = ordered.mapInArrow(lambda it: merged(lists(it)), "h long, x long, y long, side int, doc_id long, n long, pos int, comp long")
    long_ones = post.filter("pos >= short")
    if not long_ones.isEmpty():
        entries = entries.unionByName(long_lists(long_ones, percent))
    entries = materialize(entries, "postings")
    full = entries.join(known.select("doc_id", "sig"), "doc_id").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "side")

    def pairs(batches):
        key, held = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("h", "x", "y", "side", "doc_id", "n", "pos", "comp", "sig")]
            for row in zip(*cols, strict=True):
                if row[:3] != key:
                    yield from found(held)
                    key, held = row[:3], []
                held.append(row[3:])
        yield from found(held)

    def found(held):
        if len(held) < 2:
            return
        side, ids, n, pos, comp = (np.array([r[k] for r in held]) for k in range(5))
        sig = np.frombuffer(b"".join(r[5] for r in held), np.uint64).reshape(len(held), -1)
        same = side.max() == 0
        right = np.arange(len(held)) if same else np.flatnonzero(side == 1)
        for i in np.arange(len(held)) if same else np.flatnonzero(side == 0):
            j = right[right < i] if same else right
            total = n[i] + n[j]
            need = -(-percent * total // (100 + percent))
            ok = (comp[j] != comp[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            j, need, total = j[ok], need[ok], total[ok]
            if len(j):
                j = j[np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64) <= total - 2 * need]
                if len(j):
                    yield rows({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def once(it):
        """Distinct pairs of a task, as far as a bounded buffer shows."""
        seen: set = set()
        for b in it:
            seen.update(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
            if len(seen) > 100_000:
                yield rows({"a": [x for x, _ in seen], "b": [y for _, y in seen]}, b.schema)
                seen = set()
        yield rows({"a": [x for x, _ in seen], "b": [y for _, y in seen]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    out = materialize(full.mapInArrow(lambda it: once(pairs(it)), "a long, b long").distinct(), "open-pairs")
    discard(known, entries)
    return out


def answers(pairs: DataFrame, near: DataFrame, comps: DataFrame, sizes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (a, b) among open pairs that join components. near: links of leaders (a) to the sets that they lead (b),
    with what they have in common; comps: the components that these make."""
    led = near.groupBy(F.col("b").alias("s")).agg(F.max(F.struct("both", "a", "n_a", "n_b")).alias("l"))
    led = led.select("s", F.col("l.a").alias("lead"), (F.col("l.n_b") - F.col("l.both")).alias("more"), (F.col("l.n_a") - F.col("l.both")).alias("less"))
    of = lambda c: led.withColumnsRenamed({"s": c, "lead": f"lead_{c}", "more": f"more_{c}", "less": f"less_{c}"})
    each = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    each = each.select("a", "b", F.coalesce("lead_a", "a").alias("p"), F.coalesce("lead_b", "b").alias("q"), *[zero(f"{x}_{c}") for x in ("more", "less") for c in "ab"])
    each = materialize(each.withColumns({"p": F.least("p", "q"), "q": F.greatest("p", "q")}), "pairs-and-leaders")
    led_pairs = verified(each.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), docs, k, percent)
    linked = led_pairs.filter("linked").select("a", "b")
    now = materialize(components(comps.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(linked)), "leaders-components")
    own = lambda c: now.select(F.col("node").alias(c), F.col("component_id").alias(f"c_{c}"))
    size = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"))
    rest = each.filter("NOT ((a = p AND b = q) OR (a = q AND b = p))").join(own("a"), "a", "left").join(own("b"), "b", "left")
    rest = rest.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).join(size("a"), "a").join(size("b"), "b")
    rest = rest.join(led_pairs.select(F.col("a").alias("p"), F.col("b").alias("q"), "both"), ["p", "q"])
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))
    most = F.least(F.col("both") + F.col("more_a") + F.col("more_b"), F.col("n_a"), F.col("n_b"))
    least = F.col("both") - F.col("less_a") - F.col("less_b")
    rest = materialize(rest.filter(most >= need).select("a", "b", (least >= need).alias("sure")), "undecided")
    out = linked.union(rest.filter("sure").select("a", "b"))
    open_ = rest.filter("NOT sure").select("a", "b")
    return out if open_.isEmpty() else out.union(verified(open_, docs, k, percent).filter("linked").select("a", "b"))


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base = materialize(described(docs, k, percent), "shingled")
    classes = materialize(base.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("size")), "set-classes")
    reps = materialize(base.join(classes.select(F.col("rep_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "set-reps")
    near = verified(star_pairs(reps, percent), docs, k, percent).filter("linked")
    first = materialize(components(near.select("a", "b")), "first-components")
    more = answers(open_pairs(reps, first, percent), near, first, reps.select("doc_id", "n"), docs, k, percent)
    whole = first.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(more)
    comps = components(whole).withColumnRenamed("node", "rep_id")
    found = materialize(classes.join(comps, "rep_id", "left").select("digest", "size", F.coalesce("component_id", "rep_id").alias("root")), "set-components")
    discard(reps)
    each = base.select("doc_id", "n", "digest")
    out = spread_lookup(each, found, ["digest"], "size", each.count(), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
