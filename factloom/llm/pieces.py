"""SentencePiece encoding and decoding (5): batched Viterbi over piece scores, in numpy.

A text is cut into units (a run of spaces and what follows up to the next space, after one space is put in front);
pieces never cross units, so units are segmented on their own. The distinct units of a slice are grouped by length, and
all units of one length advance together: rolling substring hashes probe the sorted hashes of the pieces (behind a
bitmap), and vectorised maxima keep the best score and a back-pointer per position. Characters that are in no piece
become byte pieces, so decoding gives back every text exactly, whatever it holds.

The segmentation maximises the sum of the model's piece scores and of what two pieces in a row allow. For a unigram model
any pieces may follow each other, and the scores decide (ties: the shorter last piece). A BPE model's scores are merge
ranks, no log probabilities: there a piece may follow another if merging the two pieces' text gives just these two, which
the library is asked once for each pair that occurs. A text has exactly one way through such pairs, the one that merging
finds (a prefix's merged pieces do not depend on what follows, but for the last), so the ids are the library's own - but
for the character that stands for a space in pieces, which the library turns into a space, and which is kept here.

Null or empty text: no pieces. Null doc_id and repeated rows: each row is encoded. Texts are taken whole, however long, in
slices. Empty table: empty result. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import filled, raw, rows, table, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, PRIME, BITS = "▁", np.uint64(0x9E3779B97F4A7C15), 20
BLOCK = 300_000
#: The pairs of pieces that a worker remembers are at most two to this power.
PAIR_BITS = 21
#: A character that no piece holds, so nothing merges with it.
BREAK = "\U000F0000"
_LOADED: dict[bytes, Pieces] = {}


def is_bpe(model: bytes) -> bool:
    """Whether the model's own training settings (field 2) call it BPE (their field 3 is 2)."""

    def fields(data: bytes):
        at = 0

        def varint():
            nonlocal at
            out = shift = 0
            while True:
                x = data[at]
                at, out, shift = at + 1, out | (x & 127) << shift, shift + 7
                if x < 128:
                    return out

        while at < len(data):
            tag = varint()
            if tag & 7 == 2:
                size = varint()
                yield tag >> 3, data[at : at + size]
                at += size
            elif tag & 7:
                at += 4 if tag & 7 == 5 else 8
            else:
                yield tag >> 3, varint()

    return any(n == 2 and any(k == 3 and v == 2 for k, v in fields(x)) for n, x in fields(model))


class Joins:
    """Which pieces of a BPE model may follow which: asked of the library once a pair, and remembered in a table of fixed
    size (a pair that has lost its place there is asked again)."""

    def __init__(self, sp, texts: list[str], ids: np.ndarray):
        self.sp, self.texts, self.ids = sp, texts, ids
        self.codes, self.values = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.lead = len(sp.encode(BREAK))
        if not all(sp.is_byte(i) for i in sp.encode(BREAK)[1:]) or self.lead != 5:
            raise ValueError(f"the model has a piece for {BREAK!r}")
        #: Pieces that merging can make at all.
        self.made = np.array([x[self.lead :] == [i] for x, i in zip(sp.encode([BREAK + t for t in texts], num_threads=1), ids.tolist(), strict=True)])

    def ok(self, prior: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether piece key may follow piece prior (places in the sorted pieces; prior below 0: nothing to merge with)."""
        out, asked = self.made[key], np.flatnonzero((prior >= 0) & self.made[key])
        code = prior[asked].astype(np.int64) * len(self.ids) + key[asked]
        slot = ((code.astype(np.uint64) * PRIME) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self.codes[slot] == code
        out[asked[known]] = self.values[slot[known]]
        if not known.all():
            new, back = np.unique(code[~known], return_inverse=True)
            a, b = np.divmod(new, len(self.ids))
            got = self.sp.encode([BREAK + self.texts[i] + self.texts[j] for i, j in zip(a, b, strict=True)], num_threads=1)
            value = np.array([x[self.lead :] == [i, j] for x, i, j in zip(got, self.ids[a].tolist(), self.ids[b].tolist(), strict=True)])
            at = ((new.astype(np.uint64) * PRIME) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            self.codes[at], self.values[at] = new, value
            out[asked[~known]] = value[back]
        return out


class Pieces:
    """Tables of a model: sorted hashes of its pieces with ids and scores, and each id's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.plain = {sp.id_to_piece(i).replace(SPACE, " "): (i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("the model needs byte pieces, else decoding would lose characters")
        if any(" " in p.lstrip(" ") for p in self.plain):
            raise ValueError("pieces that cross words are not supported")
        self.bytes = np.array([by_byte[x] for x in range(256)], np.int32)
        self.longest = max(map(len, self.plain))
        self.unknown = min(s for _, s in self.plain.values()) - 10.0
        words = list(self.plain)
        hashes = np.array([self.hash(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if len(self.keys) > 1 and (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.array([self.plain[w][0] for w in words], np.int32)[order]
        self.scores = np.array([self.plain[w][1] for w in words], np.float64)[order]
        self.joins = Joins(sp, [words[k] for k in order], self.ids) if is_bpe(model) else None
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.keys >> np.uint64(64 - BITS)] = True
        text = [b""] * len(ids)
        for w, (i, _) in self.plain.items():
            text[i] = w.encode()
        for x, i in by_byte.items():
            text[i] = bytes([x])
        self.sizes = np.array([len(x) for x in text], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.text = np.frombuffer(b"".join(text), np.uint8)

    @staticmethod
    def hash(word: str) -> int:
        h = 0
        for c in word:
            h = (h * int(PRIME) + ord(c) * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)
        return h

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h (flat) that hold a piece, and its index in the sorted keys."""
        maybe = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITS)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]


def _segment(m: Pieces, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cps: units of one length by code point. Ids of all units one after another (an unknown character as its code
    point's bytes), and the number of ids of each."""
    count, n = cps.shape
    best = np.full((n + 1, count), -np.inf)
    best[0] = 0.0
    back = np.zeros((n + 1, count), np.int16)
    last = np.full((n + 1, count), -1, np.int32)  # the last piece's place among the sorted ones, -1 for none
    step = cps.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    found, h = [], np.zeros((count, n), np.uint64)
    for size in range(1, min(m.longest, n) + 1):
        h = h[:, : n - size + 1] * PRIME + step[:, size - 1 :]
        flat, key = m.probe(h.ravel())
        unit, start = np.divmod(flat, n - size + 1)
        order = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[order], np.arange(n - size + 2))
        found.append((unit[order], key[order], cuts))
    for end in range(1, n + 1):
        score, prior, ident = best[end], back[end], last[end]
        score[:], prior[:] = best[end - 1] + m.unknown, 1
        own = [found[size - 1] + (size,) for size in range(1, min(m.longest, end) + 1)]
        own = [(unit[a:b], key[a:b], size) for unit, key, cuts, size in own if (a := cuts[end - size]) < (b := cuts[end - size + 1])]
        if not own:
            continue
        unit, key = (np.concatenate([x[k] for x in own]) for k in (0, 1))
        size = np.repeat([x[2] for x in own], [len(x[0]) for x in own])
        gain = best[end - size, unit] + m.scores[key]
        if m.joins is not None:
            gain = np.where(m.joins.ok(last[end - size, unit], key), 0.0, -np.inf)
        # of each unit the largest gain, the shortest piece of equals; a character that is a piece is no unknown one
        order = np.lexsort((size, -gain, unit))
        first = order[np.concatenate([[True], unit[order][1:] != unit[order][:-1]])]
        single = np.zeros(count, bool)
        single[unit[size == 1]] = True
        first = first[(gain[first] > score[unit[first]]) | single[unit[first]]]
        score[unit[first]], prior[unit[first]], ident[unit[first]] = gain[first], size[first], key[first]
    at, path = np.full(count, n), []
    units = np.arange(count)
    while (live := at > 0).any():
        ident = np.where(live, np.where(last[at, units] >= 0, m.ids[last[at, units]], -1), -2)
        char = np.where(ident == -1, cps[units, np.maximum(at - 1, 0)], 0)
        path.append((ident, char))
        at = np.where(live, at - back[at, units], 0)
    ident, char = (np.stack([p[k] for p in path[::-1]], 1) for k in (0, 1))
    width = np.where(ident >= 0, 1, 0) + np.where(ident == -1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 0)
    flat, flat_char = np.repeat(ident.ravel(), width.ravel()), np.repeat(char.ravel(), width.ravel())
    for k in np.flatnonzero(flat == -1):
        if flat[k] == -1:
            own = chr(flat_char[k]).encode()
            flat[k : k + len(own)] = m.bytes[list(own)]
    return flat, width.sum(1)


def _join(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) of values, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts, flat, and each text's bounds in them. The space in front of a unit is kept."""
    lists = pc.split_pattern(texts, " ")
    doubled = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    flat, bounds = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), lists.flatten(), pa.scalar(" ", pa.large_string())), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if not doubled.any() and not empty.any():
        return flat, bounds
    pieces, counts, run = [], np.diff(bounds), 0
    special = doubled | empty
    for k in np.flatnonzero(special):
        if bounds[k] > run:
            pieces.append(flat.slice(run, bounds[k] - run))
        own = re.findall(r" +[^ ]*", " " + texts[int(k)].as_py()) if not empty[k] else []
        pieces.append(pa.array(own, flat.type))
        counts[k], run = len(own), bounds[k + 1]
    pieces.append(flat.slice(run))
    return pa.concat_arrays(pieces), np.concatenate([[0], np.cumsum(counts)])


def encode(m: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and each text's bounds in them."""
    flat, bounds = units_of(texts)
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    data, at = raw(words)
    cps = np.frombuffer(bytes(data[at[0] : at[-1]]).decode().encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    parts, counts = [], np.zeros(len(words), np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        n = int(size[order[a]])
        for c in range(a, b, max(1, BLOCK // n)):
            own = order[c : min(b, c + max(1, BLOCK // n))]
            ids, counts[own] = _segment(m, cps[begin[own][:, None] + np.arange(n)])
            parts.append(ids)
    pool = np.concatenate(parts)
    start = np.empty(len(words), np.int64)
    start[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
    each = counts[codes]
    total = np.concatenate([[0], np.cumsum(each)])
    return _join(pool, start[codes], each).astype(np.int32), total[bounds]


def decode(m: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The texts (UTF-8) of flat ids; the space that encoding put in front is taken off."""
    sizes = m.sizes[ids]
    text = _join(m.text, m.starts[ids], sizes).tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    return [text[i + 1 : j] for i, j in zip(at[:-1], at[1:], strict=True)]


def loaded(model: bytes) -> Pieces:
    """The tables of a model; a worker makes them once."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def load(model: str = MODEL) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 and round_trip of every row."""
    proto = docs.sparkSession.sparkContext.broadcast(load(model))
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        m, schema = loaded(proto.value), pa.schema(fields)
        for b in batches:
            for part in text_slices(b):
                texts = filled(part.column("text"))
                ids, bounds = encode(m, texts)
                back = decode(m, ids, bounds)
                data, at = raw(texts)
                little = ids.astype("<i4").tobytes()
                yield rows({
                    "doc_id": part.column("doc_id"), "n_pieces": np.diff(bounds),
                    "ids_sha256": [hashlib.sha256(little[4 * i : 4 * j]).hexdigest() for i, j in zip(bounds[:-1], bounds[1:], strict=True)],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                    "round_trip": [x == bytes(data[i:j]) for x, i, j in zip(back, at[:-1], at[1:], strict=True)],
                    "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                }, schema)

    ddl = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), with_ids=False)


ORACLE: dict[str, str] = {}
QUERIES = {"op5_sentencepiece": op5_sentencepiece}
