"""LM scoring (3): a small causal self-attention model over subword ids, trained and applied in numpy.

Words (lower-cased A-Z, cut at ASCII white space) are encoded with a public byte-level BPE; a text is its words' ids and
one end id. The model is one attention head with relative positions over a window of `CONTEXT + STRIDE` ids; its output
mixes `MIX` emission distributions, so probabilities are exact without a large softmax:
P(next | context) = sum_k softmax(attention + current id)_k * U_k(next). Windows overlap by `CONTEXT`; each id is scored
once, by the window in whose last `STRIDE` places it falls.

A word is either emitted whole or spelled. Frequent words (and the end) are emitted by the same mixture, at the place of
their first id, from distributions W_k; other words of the training texts by their counts; and any word can be spelled:
its first id is drawn from those that begin a word, the others follow, and the word ends where the next id would begin
one, so the spellings of all words and the end add up to 1. The weight of spelling is the Good-Turing share of unseen
words; a word's probability is the sum.

Training has no sample: every window of every training text counts in the attention weights, the emissions U and W and
the word and subword counts. A task takes Adagrad steps over the windows of its texts and re-estimates U on the way (EM
over a running mean); the tasks' weights are then averaged, each id's by how often a task had it, and their expectations
added up. The texts are dealt to rounds by a hash, each `ROUND` times as large as the one before, so that tasks that
learn at a time start from what all have learnt so far; a pass has each text in one round. U and W are made from the
expectations of the whole last pass, each taken under the weights of its time. Small corpora are passed over as often as
`ENOUGH` words hold them (once at least, `PASSES` times at most). A task has about `LESSON` words or more, as far as
there are, since a few steps from different texts do not average well. The weights depend on how the rows are dealt to
tasks.

The base score is the add-one unigram model over words and ends. Words with at least 1/HOT of all tokens (so at most
`HOT` of them, whatever the corpus) are the frequent ones and are broadcast; all others are joined by a 64-bit hash.

Null text counts as empty: one token, the end. Very long texts are scored whole, a slice of their own. Null doc_id:
trained on, never held out. Repeated rows count and are scored each; ties cannot occur. No training rows: every count
is 0, and the model is untrained but proper. Empty table: empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import copy
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import filled, hashes, held_out, materialize, raw, rows, table, text_slices, words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CONTEXT, STRIDE, WIDTH, MIX, HOT = 16, 16, 16, 16, 150_000
#: Training: words of a task, growth of the rounds, words of a first round at most, words that several passes
#: together have at most, passes at most.
LESSON, ROUND, FIRST, ENOUGH, PASSES = 2 << 20, 16, 6 << 20, 2 << 20, 6
#: Strides of a step of training, steps between two estimates of U, rows of a block that is sent.
BLOCK, TURN, ROWS = 512, 16, 128
#: Numbers from one stride's attention to the next one's; rows that are added up at a time.
BAND, GROUP, ONES = 2 * STRIDE * STRIDE + STRIDE, 8, np.ones(MIX, np.float32)
#: Bytes of text that a worker holds as ids at a time, and of which it encodes each word once.
SLICE, ENCODED = 2 << 20, 8 << 20
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
OTHER_SPACE = re.compile(r"[^\S ]")


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def begins(ranks: dict[bytes, int]) -> np.ndarray:
    """Whether each id begins a word (or, the last one, ends a text)."""
    out = np.zeros(len(ranks) + 1, bool)
    out[[i for w, i in ranks.items() if w[:1] == b" "]] = out[-1] = True
    return out


class Encoder:
    """Ids of whole words, each with a space in front; the id after the last one is the end. Of a word's ids only the
    first begins with a space, so words are encoded together and told apart by that."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.bpe, self.end = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)
        self.begins = begins(ranks)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each word's first place."""
        data, at = raw(words)
        text = np.full(int(at[-1] - at[0]) + len(words), 32, np.uint8)
        body = np.ones(len(text), bool)
        body[at[:-1] - at[0] + np.arange(len(words))] = False
        text[body] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        encode, joined = self.bpe._core_bpe.encode_ordinary, text.tobytes().decode()
        if OTHER_SPACE.search(joined):  # the pattern may take it together with the next word's space
            ids = [encode(" " + w) for w in words.to_pylist()]
            return np.array(list(chain.from_iterable(ids)), np.int32), np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        ids = np.array(encode(joined), np.int32)
        return ids, np.append(np.flatnonzero(self.begins[ids]), len(ids))


def _spread(values: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of words, and each word's end in them."""
    n = np.diff(first)[codes]
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[codes] - ends + n, n)], ends


def _sums(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and the sum of each one's rows of values (an even number of float32 columns)."""
    if len(ids) and ids.max() < 1 << 16:
        ids = ids.astype(np.uint16)  # sorted by radix
    order = np.argsort(ids, kind="stable")
    own = ids[order].astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    # two columns at once, as the parts of a complex number
    return own[first], np.add.reduceat(np.take(values, order, axis=0).view(np.complex64), first, axis=0).view(np.float32)


def _row_sums(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_sums for wide rows, of which values has one more than there are ids, all zero: rows of an id are first added up in
    groups, filled up with that row."""
    order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")
    own = ids[order].astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    n = np.diff(first, append=len(own))
    groups = -(-n // GROUP)
    start = np.cumsum(groups) - groups
    place = np.full((GROUP, int(groups.sum())), len(ids))
    at = np.arange(len(own)) + np.repeat(start * GROUP - first, n)
    place[at % GROUP, at // GROUP] = order
    sums = np.take(values, place[0], axis=0)
    more = np.empty_like(sums)
    for p in place[1:]:
        sums += np.take(values, p, axis=0, out=more, mode="clip")
    return own[first], np.add.reduceat(sums.view(np.complex64), start, axis=0).view(np.float32)


class Room:
    """Arrays that blocks of at most `count` strides use in turn. Strides of a block have places 1 to n; 0 is the stride
    before them, n + 1 one that counts nothing. Attention is kept in bands: the weights of a stride's places on the places of
    the one before it and its own (`by_queries`), laid out so that the weights on a stride's places, by its own and the next
    one's places (`by_keys`), are as regular. Products read and write these arrays where they are, without copies."""

    def __init__(self, count: int, columns: int):
        self.rows, self.grad = np.zeros((2, count + 2, STRIDE, columns), np.float32)
        self.given, self.mixed, self.shared = np.zeros((3, count + 2, STRIDE, MIX), np.float32)
        self.attention, self.steps = np.zeros((2, (count + 2) * BAND + STRIDE), np.float32)
        view = np.lib.stride_tricks.as_strided
        self.pairs, self.shared_pairs = (view(x, (count + 1, 2 * STRIDE, x.shape[2]), x.strides) for x in (self.rows, self.shared))
        self.by_queries, self.steps_by_queries = (view(x, (count + 2, STRIDE, 2 * STRIDE), (4 * BAND, 8 * STRIDE, 4)) for x in (self.attention, self.steps))
        self.by_keys, self.steps_by_keys = (view(x[STRIDE:], (count + 1, STRIDE, 2 * STRIDE), (4 * BAND, 4, 8 * STRIDE)) for x in (self.attention, self.steps))

    def close(self, count: int) -> None:
        """Nothing is given by the places after stride count, nor to them."""
        self.by_queries[count + 1] = self.steps_by_queries[count + 1] = self.shared[count + 1] = self.grad[count + 1] = 0.0


class AttentionLM:
    """Queries, keys, mixture weights of the current id and values are columns of one table, whose last row stands for
    places outside a text."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda n, s: rng.normal(0, s, (size, n)).astype(np.float32)
        self.p = np.zeros((size + 1, 2 * WIDTH + 2 * MIX), np.float32)
        self.p[:-1] = np.concatenate([f(WIDTH, 0.1), f(WIDTH, 0.1), f(MIX, 0.3), f(MIX, 0.1)], 1)
        self.running = np.exp(f(MIX, 1.0))
        self.u = self.running / self.running.sum(0)
        self.running *= np.float32(0.05)
        span = CONTEXT + STRIDE
        self.distance = np.zeros(span, np.float32)
        self.back = np.arange(CONTEXT, span)[:, None] - np.arange(span)[None, :]
        self.grown, self.grown_distance = np.full((size + 1, 4), 1e-3, np.float32), np.full(span, 1e-3, np.float32)

    q = property(lambda self: self.p[:-1, :WIDTH])
    k = property(lambda self: self.p[:-1, WIDTH : 2 * WIDTH])
    r = property(lambda self: self.p[:-1, 2 * WIDTH : 2 * WIDTH + MIX])
    v = property(lambda self: self.p[:-1, 2 * WIDTH + MIX :])

    @staticmethod
    def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sequences between bounds, all windows: places of the inputs, whether each lies in its sequence, and
        whether each of the last STRIDE places predicts an id (the one after it)."""
        n = np.maximum(0, np.diff(bounds) - 1)
        count = -(-n // STRIDE)
        owner = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        low, high = bounds[:-1].astype(np.int32)[owner, None], bounds[1:].astype(np.int32)[owner, None]
        at = low + (nth * STRIDE).astype(np.int32)[:, None] + np.arange(-CONTEXT, STRIDE, dtype=np.int32)
        inside = (at >= low) & (at < high - 1)
        return np.clip(at, 0, max(0, bounds[-1] - 1), out=at), inside, inside[:, CONTEXT:]

    def forward(self, x: np.ndarray, inside: np.ndarray):
        """x: input ids of windows. Attention weights, mixture weights and what the gradient needs."""
        keys, values, queries = self.k[x], self.v[x], self.q[x[:, CONTEXT:]]
        bias = np.where(self.back >= 0, self.distance[np.maximum(self.back, 0)], -60.0).astype(np.float32)
        a = queries @ keys.transpose(0, 2, 1) + bias + np.where(inside, 0.0, -60.0).astype(np.float32)[:, None, :]
        np.exp(np.minimum(a, 30.0), out=a)
        a /= a.sum(2, keepdims=True) + np.float32(1e-20)
        g = a @ values + self.r[x[:, CONTEXT:]]
        g -= g.max(2, keepdims=True)
        np.exp(g, out=g)
        g /= g.sum(2, keepdims=True)
        return a, g, keys, values, queries

    def closeness(self) -> None:
        """The factor of each distance, for a stride of a band."""
        self.near = np.zeros(BAND, np.float32)
        self.near[:-STRIDE] = np.where(self.back >= 0, np.exp(self.distance)[np.maximum(self.back, 0)], 0.0).ravel()

    def ready(self, starts: np.ndarray) -> None:
        """For scoring: the factor of each distance, and each component's share of ids that begin a word (or end the text)."""
        self.closeness()
        self.begins = self.u[starts].sum(0)

    def strides(self, ids: np.ndarray, bounds: np.ndarray, block: int):
        """For sequences between bounds, block by block: input ids, places of the ids that they predict (-1: none), and
        which strides begin a text. Texts are laid out in strides, each after a stride of places that count nothing, so
        a window is a stride and the one before it, and neighbours share their rows."""
        n = np.maximum(0, np.diff(bounds) - 1)
        strides = -(-n // STRIDE)
        first = np.cumsum(strides + 1) - strides
        place = np.arange(int(n.sum())) + np.repeat(STRIDE * first - (np.cumsum(n) - n), n)
        target = np.arange(len(place)) + np.repeat(bounds[:-1] + 1 - (np.cumsum(n) - n), n)
        total, alone = int((strides + 1).sum()), np.zeros(int((strides + 1).sum()) + 1, bool)
        alone[first] = True
        x, to = np.full(total * STRIDE, len(self.u), np.int32), np.full(total * STRIDE, -1, np.int64)
        x[place], to[place] = ids[target - 1], target
        for i in range(1, total, block):
            own = x[(i - 1) * STRIDE : (i + block) * STRIDE]
            yield own, to[i * STRIDE : (i - 1) * STRIDE + len(own)], np.flatnonzero(alone[i : i - 1 + len(own) // STRIDE])

    def attend(self, own: np.ndarray, alone: np.ndarray, room: Room):
        """Leaves in the room the rows of strides that follow each other, attention (not yet divided by its sums), the values
        it gives and mixture weights (not yet divided by their sums). The sums of attention, these values and weights."""
        n = len(own) // STRIDE
        np.take(self.p, own, axis=0, out=room.rows[:n].reshape(len(own), -1), mode="clip")
        current, windows, given, g = room.rows[1:n], room.pairs[: n - 1], room.given[1:n], room.mixed[1:n]
        np.matmul(current[:, :, :WIDTH], windows[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1), out=room.by_queries[1:n])
        a = room.attention[BAND : n * BAND]
        if not a.max(initial=0.0) <= 30.0:
            np.minimum(a, 30.0, out=a)
        np.exp(a, out=a)
        a.reshape(-1, BAND)[:] *= self.near
        room.by_queries[1 + alone, :, :STRIDE] = 0.0
        halves = (a.reshape(-1, STRIDE) @ ONES).reshape(n - 1, -1)
        sums = (halves[:, :-1:2] + halves[:, 1:-1:2]).reshape(-1, 1) + np.float32(1e-20)
        np.matmul(room.by_queries[1:n], windows[:, :, 2 * WIDTH + MIX :], out=given)
        np.divide(given.reshape(-1, MIX), sums, out=given.reshape(-1, MIX))
        np.add(given, current[:, :, 2 * WIDTH : 2 * WIDTH + MIX], out=g)
        if not g.max(initial=0.0) <= 60.0:
            np.minimum(g, 60.0, out=g)
        return sums, given.reshape(-1, MIX), np.exp(g, out=g).reshape(-1, MIX)

    def mixtures(self, ids: np.ndarray, bounds: np.ndarray, block: int = 1024):
        """For sequences between bounds, block by block: mixture weights (not yet divided by their sum) and places of the
        ids that they predict."""
        room = Room(block, self.p.shape[1])
        for own, to, alone in self.strides(ids, bounds, block):
            some = np.flatnonzero(to >= 0)
            yield np.take(self.attend(own, alone, room)[2], some, axis=0), to[some]

    def log10(self, ids: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each id given what precedes it (0 for each start), the same of any id that begins a word
        there, and, where whole names a frequent word that begins at the place, the probability of that word."""
        spelled, begins, emitted = (np.zeros(len(ids)) for _ in range(3))
        for g, to in self.mixtures(ids, bounds):
            both = g @ np.stack([np.ones(MIX, np.float32), self.begins], 1)
            spelled[to] = np.einsum("ij,ij->i", g, np.take(self.u, ids[to], axis=0)) / both[:, 0]
            begins[to] = both[:, 1] / both[:, 0]
            names = whole[to]
            some = np.flatnonzero(names >= 0)
            emitted[to[some]] = np.einsum("ij,ij->i", np.take(g, some, axis=0), np.take(self.w, names[some], axis=0)) / both[some, 0]
        first = bounds[:-1]
        spelled[first] = begins[first] = 1.0
        return np.log10(spelled + 1e-30), np.log10(begins + 1e-30), emitted

    def pupil(self, words: int) -> AttentionLM:
        """A copy that learns, and counts what it has learnt from; words: how many frequent ones there are."""
        out = copy.copy(self)
        out.p, out.grown, out.distance, out.grown_distance, out.running = (x.copy() for x in (self.p, self.grown, self.distance, self.grown_distance, self.running))
        out.fresh, out.expected, out.words = np.zeros_like(self.u), np.zeros_like(self.u), np.zeros((words, MIX), np.float32)
        out.seen, out.steps, out.turns = np.zeros(len(self.u), np.int64), 0, 0
        out.room = Room(BLOCK, self.p.shape[1])
        out.closeness()
        out.turn()
        return out

    def turn(self) -> None:
        """U from a running mean of the expectations, in which later ones weigh more."""
        self.expected += self.fresh
        if self.steps:
            self.running *= np.float32(1 - 2 / (self.turns + 3))
            self.running += self.fresh
            self.turns += 1
        self.fresh[:] = 0.0
        u = self.running + np.float32(1e-3)
        self.u = u / u.sum(0)

    def learn(self, ids: np.ndarray, bounds: np.ndarray, whole: np.ndarray, rate: float = 0.15) -> None:
        """A step for each block of strides: the expected emissions are added up (ids; and frequent words, named by whole
        at the place of their first id), the weights follow the gradient of the log probability of the ids."""
        self.seen += np.bincount(ids, minlength=len(self.u))
        causal, room = self.back >= 0, self.room
        for own, to, alone in self.strides(ids, bounds, BLOCK):
            count, none = len(own) // STRIDE - 1, np.flatnonzero(to < 0)
            what, names = ids[to], whole[to]  # places that predict nothing have the last id
            room.close(count)
            sums, given, g = self.attend(own, alone, room)
            g /= (g @ ONES)[:, None]
            post = np.take(self.u, what, axis=0)
            post *= g
            post /= (post @ ONES)[:, None] + np.float32(1e-30)
            post[none] = 0.0
            at, total = _sums(what, post)
            self.fresh[at] += total
            names[none] = -1
            named = np.flatnonzero(names >= 0)
            at, total = _sums(names[named], np.take(g, named, axis=0))
            self.words[at] += total
            grad, shared, windows = room.grad, room.shared[1 : count + 1], room.pairs[:count]
            d = np.subtract(g, post, out=shared.reshape(-1, MIX))
            d[none] = 0.0
            grad[1 : count + 1, :, 2 * WIDTH : 2 * WIDTH + MIX] = shared
            d /= sums
            ds = np.matmul(shared, windows[:, :, 2 * WIDTH + MIX :].transpose(0, 2, 1), out=room.steps_by_queries[1 : count + 1])
            given *= d
            ds -= (given @ ONES).reshape(count, STRIDE, 1)
            band = slice(BAND, (count + 1) * BAND)
            room.steps[band] *= room.attention[band]
            np.matmul(ds, windows[:, :, WIDTH : 2 * WIDTH], out=grad[1 : count + 1, :, :WIDTH])
            here = slice(0, count + 1)
            np.matmul(room.steps_by_keys[here], room.pairs[here, :, :WIDTH], out=grad[here, :, WIDTH : 2 * WIDTH])
            np.matmul(room.by_keys[here], room.shared_pairs[here], out=grad[here, :, 2 * WIDTH + MIX :])
            at, total = _row_sums(own, grad[: count + 2].reshape(-1, self.p.shape[1])[: len(own) + 1])
            inner = slice(0, int(np.searchsorted(at, len(self.u))))  # without the places outside a text
            at, total = at[inner], total[inner].reshape(-1, 4, WIDTH)
            self.grown[at] += np.einsum("ijk,ijk->ij", total, total) / np.float32(WIDTH)
            self.p[at] -= (total * (np.float32(rate) / np.sqrt(self.grown[at]))[:, :, None]).reshape(len(at), -1)
            near = np.ones(count, np.float32) @ room.steps[band].reshape(count, BAND)
            near = np.bincount(self.back[causal], near[:-STRIDE].reshape(causal.shape)[causal], minlength=len(self.distance)).astype(np.float32)
            self.grown_distance += near * near
            self.distance -= np.float32(rate) * near / np.sqrt(self.grown_distance)
            self.closeness()
            self.steps += 1
            if self.steps % TURN == 0 or self.steps in (1, 2, 4, 8):
                self.turn()

    def start_words(self, counts: np.ndarray) -> None:
        """W before its expectation step: the same in every component, in proportion to the counts."""
        self.w = np.repeat((counts / counts.sum()).astype(np.float32)[:, None], MIX, axis=1)

    def emit_words(self, expected: np.ndarray, weight: float = 4.0) -> None:
        """W from expected emissions and a prior of `weight` occurrences a word, shared out as before."""
        w = expected + weight * self.w / self.w.sum(1, keepdims=True) * np.minimum(1.0, expected.sum(1, keepdims=True) + 0.05)
        self.w = (w / w.sum(0)).astype(np.float32)

    def emit(self, expected: np.ndarray, unigram: np.ndarray, weight: float = 50.0) -> None:
        """U from expected emissions and a prior of `weight` ids drawn from the unigram counts."""
        prior = (unigram + 0.05) / (unigram + 0.05).sum()
        u = expected + weight * prior[:, None]
        self.u = (u / u.sum(0)).astype(np.float32)


def _encoded(encoder: Encoder, frequent: Frequent, batch: pa.RecordBatch):
    """Texts of a batch slice by slice: the rows, codes of their words, bounds of texts in these, hashes of the words that
    codes stand for, their places among the frequent ones, ids with a start and an end, bounds of texts in the ids, and the
    place of each word's first id. A word is encoded once for all slices that hold ENCODED bytes together."""
    for large in text_slices(batch, limit=ENCODED):
        flat, bounds = words_of(filled(large.column("text")))
        coded = flat.dictionary_encode()
        codes, h, encoded, row = coded.indices.to_numpy(), hashes(coded.dictionary), encoder.words(coded.dictionary), 0
        del flat, coded
        place = frequent.find(h)
        for part in text_slices(large, limit=SLICE):
            n = part.num_rows
            low, high = bounds[row], bounds[row + n]
            own, cut, row = codes[low:high], bounds[row : row + n + 1] - low, row + n
            body, ends = _spread(*encoded, own)
            at = np.concatenate([[0], ends])[cut]
            ids, cuts = np.full(len(body) + 2 * n, encoder.end, np.int32), at + 2 * np.arange(n + 1)
            inner = np.ones(len(ids), bool)
            inner[cuts[:-1]] = inner[cuts[1:] - 1] = False
            ids[inner] = body
            first = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
            yield part, own, cut, h, place, ids, cuts, first + 2 * np.repeat(np.arange(n), np.diff(cut)) + 1


class Frequent:
    """Hashes of the frequent words in order, with their counts; the last place is the end's."""

    def __init__(self, h: np.ndarray, c: np.ndarray, ends: int):
        order = np.argsort(h)
        self.h, self.c, self.end = h[order], np.append(c[order], max(ends, 1)).astype(np.float64), len(h)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)

    def whole(self, n: int, words: np.ndarray, codes: np.ndarray, first: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """For each place of the ids, the frequent word (or end) that begins there, or -1."""
        out = np.full(n, -1, np.int32)
        out[first] = words[codes]
        out[cuts[1:] - 1] = self.end
        return out


def taught(texts: DataFrame, lm: AttentionLM, frequent: Frequent, ranks, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lets lm learn from the whole text of every row of texts, in `tasks` tasks at most. Expected emissions of ids and of
    frequent words, and how often each id is there."""
    spark = texts.sparkSession
    held, known = spark.sparkContext.broadcast(lm), spark.sparkContext.broadcast(frequent)
    size, whole, wide, last = len(lm.u), len(frequent.c), MIX + 1 + lm.grown.shape[1], 2**31 - 1
    id_blocks, word_blocks = -(-size // ROWS), -(-whole // ROWS)
    schema = pa.schema([("block", pa.int32()), ("data", pa.binary())])

    def run(batches):
        encoder, start, frequent = Encoder(ranks.value), held.value, known.value
        lm = start.pupil(whole)
        for b in batches:
            for _, codes, _, _, place, ids, cuts, starts in _encoded(encoder, frequent, b):
                lm.learn(ids, cuts, frequent.whole(len(ids), place, codes, starts, cuts))
        lm.turn()
        out = []
        for i in range(0, size, ROWS):
            own = slice(i, min(i + ROWS, size))
            if lm.seen[own].any():
                counted = np.concatenate([lm.expected[own], lm.seen[own, None], lm.grown[own] - start.grown[own]], 1, dtype=np.float32)
                out.append((i // ROWS, counted.tobytes() + (lm.p[own] - start.p[own]).astype(np.float16).tobytes()))
        out += [(id_blocks + i // ROWS, lm.words[i : i + ROWS].tobytes()) for i in range(0, whole, ROWS) if lm.words[i : i + ROWS].any()]
        n = float(lm.seen.sum())
        out.append((last, np.concatenate([[n], n * (lm.distance - start.distance), lm.grown_distance - start.grown_distance]).astype(np.float64).tobytes()))
        yield rows({"block": [k for k, _ in out], "data": [x for _, x in out]}, schema)

    def add(batches):
        """Sums of the blocks; the steps of an id's weights count as often as the task had the id."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                raw_, n = data.as_buffer(), (min(ROWS, size - k * ROWS) if k < id_blocks else 0)
                got = np.frombuffer(raw_, np.float64 if k == last else np.float32, n * wide if n else -1)
                if n:
                    counted, steps = got.reshape(n, wide), np.frombuffer(raw_, np.float16, offset=got.nbytes).reshape(n, -1)
                    got = np.concatenate([counted, steps * counted[:, MIX : MIX + 1]], 1, dtype=np.float32).ravel()
                sums[k] = sums[k] + got if k in sums else got.copy()
        yield rows({"block": list(sums), "data": [x.tobytes() for x in sums.values()]}, schema)

    counted, steps = np.zeros((id_blocks * ROWS, wide), np.float32), np.zeros((id_blocks * ROWS, lm.p.shape[1]), np.float32)
    words = np.zeros((word_blocks * ROWS, MIX), np.float32)
    ddl = "block int, data binary"
    for r in texts.select("text").coalesce(tasks).mapInArrow(run, ddl).repartition("block").mapInArrow(add, ddl).collect():
        if r.block == last:
            n, *more = np.frombuffer(bytes(r.data), np.float64)
            to, grown = np.array(more, np.float32).reshape(2, -1)
            lm.distance, lm.grown_distance = lm.distance + to / np.float32(max(n, 1.0)), lm.grown_distance + grown
        elif r.block < id_blocks:
            got = np.frombuffer(bytes(r.data), np.float32).reshape(-1, wide + lm.p.shape[1])
            own = slice(r.block * ROWS, r.block * ROWS + len(got))
            counted[own], steps[own] = got[:, :wide], got[:, wide:]
        else:
            got, i = np.frombuffer(bytes(r.data), np.float32).reshape(-1, MIX), (r.block - id_blocks) * ROWS
            words[i : i + len(got)] = got
    held.destroy()
    lm.p[:-1] += steps[:size] / np.maximum(counted[:size, MIX : MIX + 1], 1.0)
    lm.grown[:-1] += counted[:size, MIX + 1 :]
    return counted[:size, :MIX], words[:whole], counted[:size, MIX]


def fit(train: DataFrame, frequent: Frequent, vocabulary: str = VOCABULARY, tokens: int = 0) -> AttentionLM:
    """All weights, from the whole text of every row of train (doc_id, text); tokens: about how many it has, for the number
    of rounds and tasks."""
    ranks = train.sparkSession.sparkContext.broadcast(load(vocabulary))
    lm = AttentionLM(len(ranks.value) + 1)
    lm.start_words(frequent.c)
    levels = 0
    while tokens > FIRST * ROUND**levels:
        levels += 1
    dealt, bounds = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUND**levels)), [0, *(ROUND**k for k in range(levels + 1))]
    for _ in range(min(PASSES, max(1, ENOUGH // max(1, tokens)))):
        sums = None
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            texts = train.filter((dealt >= low) & (dealt < high)) if levels else train
            got = taught(texts, lm, frequent, ranks, max(1, round(tokens * (high - low) / ROUND**levels / LESSON)))
            sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
            if sums[0].any():
                lm.running = sums[0] * np.float32(min(1.0, (1 << 20) / sums[0].sum(dtype=np.float64)))
    if sums[0].any():
        lm.emit(sums[0], sums[2])
        lm.emit_words(sums[1])
    del lm.grown, lm.running  # scoring needs no training state
    lm.ready(begins(ranks.value))
    return lm


def word_counts(train: DataFrame) -> DataFrame:
    """h (64-bit hash of the word) and c for the words of all texts."""

    def run(batches):
        hs, cs = [], []
        for b in batches:
            for part in text_slices(b, limit=SLICE):
                flat, _ = words_of(filled(part.column("text")))
                coded = flat.dictionary_encode()
                hs.append(hashes(coded.dictionary))
                cs.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        if hs:
            h, back = np.unique(np.concatenate(hs), return_inverse=True)
            yield rows({"h": h, "c": np.bincount(back, np.concatenate(cs)).astype(np.int64)}, pa.schema([("h", pa.int64()), ("c", pa.int64())]))

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, train: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learning from train."""
    spark = docs.sparkSession
    counts = materialize(word_counts(train), "word-counts")
    ends = train.count()
    known, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_all, distinct = tokens + ends, known + (ends > 0)
    hot = counts.filter(F.col("c") >= max(2, n_all // HOT)).toPandas()
    frequent = Frequent(hot["h"].to_numpy(np.int64), hot["c"].to_numpy(np.int64), ends)
    once = counts.filter("c = 1").count()
    unseen = min(0.5, max(1e-3, once / max(1, n_all)))
    share = (frequent.c[:-1].sum() + ends) / max(1, n_all)
    known_words, ranks = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(load(vocabulary))
    model = spark.sparkContext.broadcast(fit(train, frequent, vocabulary, n_all))
    per_end = float(np.log10(ends + 1.0))
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("part", pa.float64()), ("score", pa.float64()), ("h", pa.int64())]
    ddl = "row long, doc_id long, n_tokens long, n_known long, part double, score double, h long"

    def run(batches):
        """A row per document with what its frequent words give, and a row (row, h, score: spelled) per other word."""
        encoder, lm, frequent, schema = Encoder(ranks.value), model.value, known_words.value, pa.schema(fields)
        row, logs = TaskContext.get().partitionId() << 33, np.append(np.log10(frequent.c[:-1] + 1), 0.0)
        for b in batches:
            for part, codes, bounds, h, place, ids, cuts, first in _encoded(encoder, frequent, b):
                n = part.num_rows
                spelled, begins, emitted = lm.log10(ids, cuts, frequent.whole(len(ids), place, codes, first, cuts))
                total = np.concatenate([[0.0], np.cumsum(spelled)])
                owner = np.repeat(np.arange(n), np.diff(bounds))
                stop = np.where(np.diff(owner, append=-1) != 0, cuts[1:][owner] - 1, np.append(first[1:], 0)) if len(first) else first
                spell = np.maximum(total[stop] - total[first] - begins[first] + begins[stop], -290.0)
                end, is_hot = cuts[1:] - 1, place[codes] >= 0
                sum_ = lambda e, s: np.log10((1 - unseen) * share * e + unseen * 10**s)
                by_word = np.where(is_hot, sum_(emitted[first], spell), 0.0)
                yield rows({
                    "row": row + np.arange(n), "doc_id": part.column("doc_id"), "n_tokens": np.diff(bounds) + 1,
                    "n_known": np.bincount(owner, is_hot, minlength=n).astype(np.int64) + (ends > 0),
                    "part": np.bincount(owner, np.where(is_hot, logs[place[codes]], 0.0), minlength=n) + per_end,
                    "score": np.bincount(owner, by_word, minlength=n) + sum_(emitted[end], spelled[end] - begins[end]), "h": pa.nulls(n, pa.int64()),
                }, schema)
                rare = np.flatnonzero(~is_hot)
                none = pa.nulls(len(rare), pa.int64())
                yield rows({"row": row + owner[rare], "doc_id": none, "n_tokens": none, "n_known": none, "part": pa.nulls(len(rare), pa.float64()), "score": spell[rare], "h": h[codes[rare]]}, schema)
                row += n

    done = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl), "lm-scores")
    c = F.coalesce("c", F.lit(0))
    word = F.log10(F.lit((1 - unseen) / max(1, n_all)) * c + F.lit(unseen) * F.pow(F.lit(10.0), F.col("score")))
    others = done.filter("h IS NOT NULL").select("row", "h", "score").join(counts, "h", "left")
    rest = others.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(c + 1)).alias("parts"), F.sum(word).alias("words"))
    each = done.filter("h IS NULL").select("row", "doc_id", "n_tokens", "n_known", "part", "score").join(rest, "row", "left")
    scale = float(np.log10(n_all + distinct + 1.0))
    zero = F.lit(0.0)
    base = F.col("part") + F.coalesce("parts", zero) - F.col("n_tokens") * scale
    return each.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("words", zero)).alias("score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 7, 2)
    return score(docs, docs.filter(~held)).withColumn("held_out", held)


ORACLE: dict[str, str] = {}
QUERIES = {"op3_lm_scoring": op3_lm_scoring}
