"""Language-model scoring with a gated recurrent network.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end per document. A head of
``HEAD`` frequent words is modelled one by one; every other word belongs to one of ``TAILS`` tail
classes, found from its spelling. The output is factored into classes: the network's state gives the
class, then the state gives the word within a head class, while a word within a tail class follows its
smoothed count in all training tokens (as in the base, all unseen words together are one type).

Learning covers all training documents, of any length: the head are the most frequent words of all of them
(by counts that lack one in ``SHARE * HEAD`` tokens at most; their counts in the model are exact), the spelling classes come from the profiles of all tail words, the output
starts from counts of all tokens, and every partition takes gradient steps over all its training tokens.
Partitions start from one network and their results are averaged, weighted by tokens; the average is the
model. The network they start from is trained on the driver (truncated backpropagation through time in
numpy) over ``TRAIN_TOKENS`` tokens of ``SAMPLE_ROWS`` documents of up to ``SAMPLE_CHARS`` characters,
drawn by a hash of the id. In a partition texts are learnt in groups of ``LEARN_BYTES``, laid end to end
and cut into streams; a document that is cut goes on with a fresh state. The average depends on which
documents share a partition, so the score (no other column) may change with the layout of the files.

Scoring reads whole documents. Documents are laid end to end in parallel streams and scored window by
window; the state is carried from window to window and is reset only where a document begins.

Counts of tail words grow with the corpus, so they are never gathered in one place: a task sends, for
each chunk of documents, the 64-bit hashes of its distinct tail words with their counts to buckets (ranges
of hashes) as packed blobs, a bucket sums up and answers every blob in the order asked, and answers meet
their chunk again. A word comes once from each chunk of ``CHUNK_BYTES``, however often it occurs, so what a
bucket holds is bounded by the number of chunks and of buckets, which follows the number of tail tokens. (Two different tail words share a hash with
probability below 1e-7 per billion of pairs; counts would then be added.) All intermediate tables lie
in the shared folder.

Defined results: null texts are empty and consist of the end only; without training documents every
count is zero and the network is uniform; repeated rows are scored each and, where they belong to the
training part, counted each. Rows with a null id count as id "".
"""

from __future__ import annotations

import copy
import io
import math
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches, bounded_sample, crc_mod5, shuffle_partitions, table, text_groups, text_of

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 20_000
TRAIN_TOKENS = 450_000
EPOCHS = 2
#: Words counted apart in a task before they are sent on; bytes of text, streams, steps and first rate of a partition's learning.
COUNTED, LEARN_BYTES, LEARN_STREAMS, LEARN_STEPS, LEARN_RATE = 200_000, 4 << 20, 256, 24, 0.004
#: A task sends words on that are as frequent there as one in SHARE * HEAD.
SHARE = 32
#: Words whose profiles describe a document, and the unit of a profile (whole numbers add up alike in any order).
ANCHORS, UNIT = 96, 1 << 20
#: Classes of head words, words in each, tail classes, size of the state.
HEAD_CLASSES, CLASS_SIZE, TAILS, STATE = 32, 64, 24, 24
HEAD = HEAD_CLASSES * CLASS_SIZE
#: Bytes of text that are scored together, and streams and steps of a window.
CHUNK_BYTES, STREAMS, STEPS = 24 << 20, 256, 32
#: Rows of outputs and parameters that are worked on together.
ROWS, PART = 1024, 8192
#: Tail tokens in a bucket, about.
BUCKET_TOKENS = 1_000_000
END = b"\n"  # no word holds a line feed
_ENDS = b".,;:!?%&*$#|\"')"


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


word_hash = xxhash.xxh3_64_intdigest


class Places:
    """Words by the order in which they come, so that what is known of a word is looked up once."""

    def __init__(self, words: list[bytes] | None = None):
        words = words or ()
        self.at: dict[bytes, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


@dataclass
class Vocab:
    """Head words by id (0 is the end) and the tail class of every other word."""

    words: list[bytes]
    ends: dict[bytes, int]

    def codes(self, words: Iterable[bytes]) -> list[int]:
        """Ids of words that are no head words."""
        of = {e: HEAD + k for e, k in self.ends.items()}.get
        return [of(w.rstrip(_ENDS)[-2:], HEAD) for w in words]


class Coder:
    """Ids of words: head words have their own, the others HEAD + their class. Words and, where asked for, the
    hashes of tail words are kept up to a bound, which ``trim`` enforces between groups of texts."""

    def __init__(self, vocab: Vocab, hashed: bool = False):
        self.vocab, self.hashed = vocab, hashed
        self.trim(0)

    def trim(self, most: int = 2 * COUNTED) -> None:
        if not most or len(self.places.at) > most:
            words = self.vocab.words
            self.places, self.codes, self.hashes = Places(words), array("h", range(len(words))), array("Q", [0] * len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        """Places of the words."""
        return self.places.of(words)

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and hashes (if any) by place, of all words so far."""
        fresh = list(islice(self.places.at, len(self.codes), None))
        self.codes.extend(self.vocab.codes(fresh))
        if self.hashed:
            self.hashes.extend(map(word_hash, fresh))
        return np.array(self.codes).astype(np.int64), np.array(self.hashes)

    def coded(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of every document's words, and the end."""
        self.trim()
        places = [self.of(words) for words in docs]
        ids = self.known()[0]
        return [np.append(ids[own], 0) for own in places]


def _clusters(rows: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """k-means on rows of unit length."""
    rng = np.random.default_rng(seed)
    x = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (own == j).any():
                c = x[own == j].mean(0)
                centres[j] = c / (np.linalg.norm(c) + 1e-9)
    return own


def choose_vocab(head: list[bytes], by_word: np.ndarray, seen: dict[bytes, int], by_end: dict[bytes, np.ndarray]) -> Vocab:
    """The head ordered so that words that occur in like documents share a class; the endings of the
    other words grouped in the same way."""
    if not head:
        return Vocab([END], {})
    own = _clusters(by_word, 8)
    order = sorted(range(len(head)), key=lambda i: (own[i], i))
    often = sorted(seen, key=lambda e: (-seen[e], e))[:600]
    ends = {}
    if often:
        groups = _clusters(np.stack([by_end[e] for e in often]), TAILS - 1)
        ends = {e: int(g) + 1 for e, g in zip(often, groups, strict=True)}
    return Vocab([END, *(head[i] for i in order)], ends)


class Adam:
    """Moments of a network's parameters, which from here on lie end to end, as their gradients do."""

    def __init__(self, params: dict[str, np.ndarray]):
        kind = params["U"].dtype
        self.p, self.m, self.v, self.g = np.zeros((4, sum(a.size for a in params.values())), kind)
        self.grads, self.n, at = {}, 0, 0
        for k, a in params.items():
            part = slice(at, at := at + a.size)
            self.p[part] = a.ravel("K")
            params[k], self.grads[k] = (x[part].reshape(a.T.shape).T if a.flags.f_contiguous else x[part].reshape(a.shape) for x in (self.p, self.g))

    def step(self, tokens: int, rate: float) -> None:
        self.n += 1
        scale = 1 / tokens
        norm = np.sqrt(float(self.g @ self.g)) * scale
        scale /= max(1.0, norm / 2)
        grow, rate = 1 / math.sqrt(1 - 0.998**self.n), rate / (1 - 0.9**self.n)
        for at in range(0, len(self.p), PART):  # parts that stay in the processor's cache
            p, m, v, g = (x[at : at + PART] for x in (self.p, self.m, self.v, self.g))
            g *= scale
            more = g - m
            more *= 0.1
            m += more
            np.multiply(g, g, out=more)
            more -= v
            more *= 0.002
            v += more
            np.sqrt(v, out=more)
            more *= grow
            more += 1e-6
            np.divide(m, more, out=more)
            more *= rate
            p -= more


class Room:
    """Arrays that are written over and over; none of them travels."""

    def __init__(self):
        self.held: dict[str | int, np.ndarray] = {}

    def __reduce__(self):
        return Room, ()

    def of(self, name: str | int, kind: np.dtype, *shape: int) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or held.size < size or held.dtype != kind:
            held = self.held[name] = np.empty(size, kind)
        return held[:size].reshape(shape)


class Network:
    """A gated recurrent unit and a class-factored output; float32 numpy, gradients by hand.

    Steps hold a stream in each column, so that the gates are whole blocks of memory; outputs hold a token in each row."""

    def __init__(self, n_head: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype("f4")
        s, classes = STATE, HEAD_CLASSES + TAILS
        self.n_head, self.room = n_head, Room()
        self.p = {
            "X": np.asfortranarray(draw(HEAD + TAILS + 1, 3 * s)),  # inputs: head words, tail classes, begin
            "U": draw(s, 3 * s) * np.float32(2),
            "W": draw(s, classes),
            "b": np.zeros(classes, "f4"),
            "V": draw(HEAD_CLASSES, s, CLASS_SIZE),
            "v": np.where(np.arange(HEAD).reshape(HEAD_CLASSES, -1) < n_head, 0, -1e9).astype("f4"),
        }
        # each bias of the output starts where the counts of the training tokens are
        self.p["b"][: HEAD_CLASSES][np.arange(HEAD_CLASSES) * CLASS_SIZE >= n_head] = -1e9

    def start_from(self, counts: np.ndarray, tails: np.ndarray) -> None:
        by_class = np.append(np.append(counts, np.zeros(HEAD - len(counts))).reshape(HEAD_CLASSES, -1).sum(1), tails)
        alive = self.p["b"] > -1e8
        self.p["b"][alive] = np.log(by_class[alive] + 0.5)
        flat = self.p["v"].reshape(-1)
        flat[: len(counts)] = np.log(counts + 0.5)

    def step(self, x: np.ndarray, h: np.ndarray, keep: np.ndarray, slot: int = 0):
        """One step for all streams, (state, streams); the state of a stream whose document begins is dropped
        first. What is returned lies in the room until the next step with the same slot."""
        s = STATE
        held = self.room.of(slot, h.dtype, 9 * s, len(x))
        a, g, hp, n, new = held[: 3 * s], held[3 * s : 6 * s], held[6 * s : 7 * s], held[7 * s : 8 * s], held[8 * s :]
        np.multiply(h, keep, out=hp)
        np.take(self.p["X"].T, x, axis=1, out=a, mode="clip")
        np.matmul(self.p["U"].T, hp, out=g)
        gates, gn = a[: 2 * s], g[2 * s :]
        gates += g[: 2 * s]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)  # where this is infinite, one over it is none, as it should be
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:s], gates[s:]
        np.multiply(r, gn, out=n)
        n += a[2 * s :]
        np.tanh(n, out=n)
        np.subtract(hp, n, out=new)
        new *= z
        new += n
        return new, (hp, z, r, gn, n)

    def _part(self, rows: np.ndarray, weights: np.ndarray, at: np.ndarray, grads: np.ndarray | None = None, d: np.ndarray | None = None):
        """log P at the given column of each row (states and a one) of the softmax of rows @ weights; adds the
        gradient of the weights and sets that of the states. The largest logit is subtracted only where the
        plain sum over- or underflows."""
        n, size = len(at), weights.shape[1]
        e = np.matmul(rows, weights, out=self.room.of("e", rows.dtype, n, size))
        flat, where = e.reshape(-1), np.arange(0, n * size, size) + at
        out = flat.take(where)
        np.exp(e, out=e)
        total = e @ np.ones(size, e.dtype)
        if not (total.min() > 1e-20 and total.max() < 1e30):
            odd = np.flatnonzero(~((total > 1e-20) & (total < 1e30)))
            logits = rows[odd] @ weights
            top = logits.max(1)
            e[odd] = np.exp(logits - top[:, None])
            total[odd] = e[odd].sum(1)
            out[odd] -= top
        out -= np.log(total)
        if grads is not None:
            np.reciprocal(total, out=total)
            e *= total[:, None]
            flat[where] -= 1
            grads += rows.T @ e
            np.matmul(e, weights[:-1].T, out=d)
        return out

    def outputs(self, rows: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """log P(class) + log P(word in class) of each target; tail targets (>= HEAD) have no word part.
        ``rows`` hold a state and a one each. With ``grads`` also the gradient of the summed negative logarithm."""
        s, kind, n = STATE, rows.dtype, len(targets)
        cls = np.where(targets < HEAD, targets // CLASS_SIZE, targets - HEAD + HEAD_CLASSES)
        order = np.argsort(cls.astype(np.uint8), kind="stable")  # rows of a class lie together from here on
        cls, words = cls[order], targets[order] % CLASS_SIZE
        rows = np.take(rows, order, axis=0, out=self.room.of("sorted", kind, n, s + 1), mode="clip")
        by_class, by_word = np.vstack([self.p["W"], self.p["b"]]), np.concatenate([self.p["V"], self.p["v"][:, None]], 1)
        found, d, more, g_class, g_word = np.empty(n, kind), None, None, None, [None] * HEAD_CLASSES
        if grads is not None:
            d, more = self.room.of("d", kind, n, s), self.room.of("more", kind, n, s)
            g_class, g_word = np.zeros_like(by_class), np.zeros_like(by_word)
        part = lambda x, at: None if x is None else x[at]
        for k in range(0, n, ROWS):
            at = slice(k, k + ROWS)
            found[at] = self._part(rows[at], by_class, cls[at], g_class, part(d, at))
        edges = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1)).tolist()
        for c in range(HEAD_CLASSES):
            for k in range(edges[c], edges[c + 1], ROWS):
                at = slice(k, min(k + ROWS, edges[c + 1]))
                found[at] += self._part(rows[at], by_word[c], words[at], g_word[c], part(more, at))
        out = np.empty_like(found)
        out[order] = found
        if grads is None:
            return out, None
        d[: edges[-1]] += more[: edges[-1]]
        grads["W"][...], grads["b"][...] = g_class[:-1], g_class[-1]
        grads["V"][...], grads["v"][...] = g_word[:, :-1], g_word[:, -1]
        d_states = self.room.of("d_states", kind, n, s)
        d_states[order] = d
        return out, d_states

    @np.errstate(over="ignore")
    def window(self, x: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray, grads: dict | None = None):
        """Loss, gradients (written to ``grads`` where given) and last state, (streams, state), of one window of
        (steps, streams): truncated backpropagation."""
        s, (steps, streams), kind = STATE, x.shape, self.p["U"].dtype
        grads = {k: np.empty_like(v) for k, v in self.p.items()} if grads is None else grads
        keep = keep.astype(kind, copy=False)
        rows, kept, now = self.room.of("rows", kind, steps, streams, s + 1), [], np.ascontiguousarray(h.T, kind)
        rows[:, :, s] = 1
        for t in range(steps):
            now, more = self.step(x[t], now, keep[t], t)
            rows[t, :, :s] = now.T
            kept.append(more)
        logp, d_states = self.outputs(rows.reshape(-1, s + 1), targets.ravel(), grads)
        d_states = d_states.reshape(steps, streams, s)
        d_x, d_h, d_u = self.room.of("d_x", kind, 3 * s, steps, streams), np.zeros((s, streams), kind), np.zeros((3 * s, s), kind)
        d_g, d_an, some = (self.room.of(k, kind, r * s, streams) for k, r in (("d_g", 3), ("d_an", 1), ("some", 1)))
        for t in reversed(range(steps)):
            hp, z, r, gn, n = kept[t]
            d_z, d_r, d_gn = d_g[:s], d_g[s : 2 * s], d_g[2 * s :]
            d_h += d_states[t].T
            np.subtract(1, z, out=some)
            np.multiply(d_h, some, out=d_an)
            np.subtract(hp, n, out=d_z)
            d_z *= d_an
            d_z *= z
            np.multiply(n, n, out=some)
            np.subtract(1, some, out=some)
            d_an *= some
            np.multiply(d_an, r, out=d_gn)
            np.subtract(1, r, out=d_r)
            d_r *= gn
            d_r *= d_gn
            d_x[: 2 * s, t], d_x[2 * s :, t] = d_g[: 2 * s], d_an
            d_u += d_g @ hp.T
            d_h *= z
            d_h += np.matmul(self.p["U"], d_g, out=some)
            d_h *= keep[t]
        grads["U"][...] = d_u.T
        symbols, size = x.ravel(), HEAD + TAILS + 1
        for own, d in zip(grads["X"].T, d_x.reshape(3 * s, -1), strict=True):
            own[...] = np.bincount(symbols, d, size)
        return -float(logp.sum()), grads, now.T.copy()

    def train(self, docs: list[np.ndarray], epochs: int = EPOCHS, streams: int = 32, steps: int = 24, rate: float = 0.01) -> None:
        """Adam over windows; ``docs`` hold ids that end with 0."""
        rng = np.random.default_rng(3)
        adam, total = Adam(self.p), None
        for epoch in range(epochs):
            flat = np.concatenate([docs[i] for i in rng.permutation(len(docs))])
            first = np.append(True, flat[:-1] == 0)
            inputs = np.where(first, HEAD + TAILS, np.append(0, flat[:-1]))
            width = min(streams, max(1, len(flat) // steps))
            size = len(flat) // width
            x, y, keep = (a[: width * size].reshape(width, size).T for a in (inputs, flat, (~first).astype("f4")))
            h = np.zeros((width, STATE), "f4")
            total = total or epochs * (-(-size // steps))
            for t in range(0, size, steps):
                _, _, h = self.window(x[t : t + steps], y[t : t + steps], keep[t : t + steps], h, adam.grads)
                adam.step(y[t : t + steps].size, rate * (1 - 0.9 * (adam.n + 1) / total))

    def learn(self, docs: list[np.ndarray], adam: Adam) -> int:
        """One pass over every token of ``docs`` (ids that end with 0); returns how many there were.

        Streams of equal length begin at even distances, so that neighbours share a token at most and none is left out."""
        flat = np.concatenate(docs)
        first = np.append(True, flat[:-1] == 0)
        inputs = np.where(first, HEAD + TAILS, np.append(0, flat[:-1]))
        width = min(LEARN_STREAMS, max(1, len(flat) // LEARN_STEPS))
        at = np.arange(width) * len(flat) // width + np.arange(-(-len(flat) // width))[:, None]
        h = np.zeros((width, STATE), "f4")
        for t in range(0, len(at), LEARN_STEPS):
            now = at[t : t + LEARN_STEPS]
            _, _, h = self.window(inputs[now], flat[now], (~first[now]).astype("f4"), h, adam.grads)
            adam.step(now.size, LEARN_RATE / math.sqrt(1 + adam.n / 64))
        return len(flat)

    @np.errstate(over="ignore")
    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log P of every token. ``ids`` holds documents end to end; document i is bounds[i]:bounds[i+1].

        Documents are dealt to parallel streams, longest first; a stream's state is carried from one
        window to the next and dropped where a document begins.
        """
        out = np.zeros(len(ids), "f4")
        lengths = np.diff(bounds)
        if not len(lengths):
            return out
        width = max(1, min(STREAMS, len(lengths)))
        order = np.argsort(-lengths, kind="stable")
        load, held = np.zeros(width, np.int64), [[] for _ in range(width)]
        for block in range(0, len(order), width):  # longest to the emptiest
            for d, s in zip(order[block : block + width], np.argsort(load, kind="stable"), strict=False):
                held[s].append(d)
                load[s] += lengths[d]
        by_load = np.argsort(-load, kind="stable")
        place = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for s in by_load for d in held[s]])
        load = load[by_load]
        start = np.concatenate([[0], np.cumsum(load)[:-1]])
        first = np.zeros(len(ids), bool)
        first[bounds[:-1]] = True
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        inputs = np.where(first, HEAD + TAILS, before)[place]
        keep, targets = (~first).astype("f4")[place], ids[place]
        h, done = np.zeros((STATE, width), "f4"), np.zeros(len(ids), "f4")
        rows = np.empty((STREAMS * STEPS, STATE + 1), "f4")
        rows[:, STATE] = 1
        for t in range(0, int(load[0]), STEPS):
            at = start[: np.searchsorted(-load, -t, side="left")] + np.arange(t, min(t + STEPS, load[0]))[:, None]
            runs = np.searchsorted(-load, -np.arange(t, t + len(at)), side="left").tolist()  # streams that still run
            last = np.minimum(at, len(ids) - 1)
            x, kept, waiting = inputs[last], keep[last], 0
            for k, now in enumerate(runs):
                h, _ = self.step(x[k, :now], np.ascontiguousarray(h[:, :now]), kept[k, :now], k % 2)
                rows[waiting : waiting + now, :STATE] = h.T
                waiting += now
            where = at[np.arange(at.shape[1]) < np.array(runs)[:, None]]
            done[where], _ = self.outputs(rows[:waiting], targets[where])
        out[place] = done
        return out


def sample_documents(docs: DataFrame, total: int, rows: int = SAMPLE_ROWS) -> list[list[bytes]]:
    """Tokens of at most so many training documents, in the order of a hash of their id, for the network that learning starts from."""
    fit = docs.where("not held_out").where(F.char_length("text") <= SAMPLE_CHARS)
    some = bounded_sample(fit, F.col("doc_id"), rows, 29, total).select(F.col("text").cast("binary").alias("text")).toArrow()
    return [tokens_of(t.as_py()) for t in some.column("text")]


def _merged(parts: DataFrame, add) -> dict[str, np.ndarray]:
    """Arrays of all tasks, (slot, blob) rows, put together 32 by 32 until 32 are left at most; ``add`` takes
    a list of them in the order of slots."""

    def up(group: pa.Table) -> pa.Table:
        blobs = group.sort_by("was").column("blob").to_pylist()
        return pa.table({"slot": group.column("slot")[:1], "blob": pa.array([_stored(add([_loaded(b) for b in blobs]))], pa.binary())})

    rounds = max(1, math.ceil(math.log(max(parts.rdd.getNumPartitions(), 1), 32)) - 1)
    for _ in range(rounds):
        parts = parts.select(F.shiftright("slot", 5).alias("slot"), F.col("slot").alias("was"), "blob").groupBy("slot").applyInArrow(up, _SLOTS)
    found = [_loaded(r["blob"]) for r in sorted(parts.collect(), key=lambda r: r["slot"])]
    return add(found) if found else {}


_SLOTS = "slot long, blob binary"


def _stored(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _loaded(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return dict(found)


def _slot(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": pa.array([_stored(arrays)], pa.binary())})


class _EndCodes(dict):
    """Numbers of endings, each worked out once."""

    def __missing__(self, end: bytes) -> int:
        code = self[end] = len(end) << 16 | int.from_bytes(end, "big")
        return code


def head_words(docs: DataFrame) -> list[bytes]:
    """Heavy hitters of all training documents, the HEAD - 1 most frequent words at most.

    A task counts its words and sends those that make up a share of 1 / (SHARE * HEAD) or more of what it
    has counted (in segments of COUNTED words apart); so a word's sum lacks at most that share of all
    tokens. The words with the highest sums are the head (equal sums: least word). Small inputs are
    counted to the last word, as every word is that frequent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts = Places(), np.zeros(0, np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            often = np.flatnonzero(counts >= counts.sum() / (SHARE * HEAD))
            names = list(places.at)
            found = pa.table({"word": pa.array([names[i] for i in often.tolist()], pa.binary()), "n": pa.array(counts[often])})
            yield from found.to_batches(max_chunksize=20_000)

        for group in text_groups(batches, 0):
            own = np.concatenate([places.of(tokens_of(t.as_py())) for t in group.column(0)])
            more = np.bincount(own, minlength=len(places.at))
            more[: len(counts)] += counts
            counts = more
            if len(places.at) >= COUNTED:
                yield from sent()
                places, counts = Places(), np.zeros(0, np.int64)
        yield from sent()

    slim = docs.where("not held_out").select(F.col("text").cast("binary"))
    found = slim.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in found.orderBy(F.desc("n"), "word").limit(HEAD - 1).collect()]


def word_profiles(docs: DataFrame, head: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict, dict, int, int]:
    """Over all training documents: the counts of the head words and the sums of their profiles (shares of
    the first ANCHORS head words in a document); counts and sums of profiles of the other words by their
    ending; the number of documents. Last the number of tail tokens of all documents."""
    anchors, shared = min(ANCHORS, len(head)), docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        places, ends = Places(shared.value), array("q", [0] * size)
        by_word, counts, place = np.zeros((size, anchors)), np.zeros(size, np.int64), np.full(3 << 16, -1, np.int64)
        codes, seen, by_end = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, anchors))
        n_docs, n_tail, end_codes = 0, 0, _EndCodes()
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            if len(places.at) > size + COUNTED:
                places, ends = Places(shared.value), array("q", [0] * size)
            held_out = np.array(batch.column(1).to_pylist(), bool)
            ids = [places.of(tokens_of(t.as_py())) for t in batch.column(0)]
            lengths, ids = np.array([len(own) for own in ids]), np.concatenate(ids)
            n_tail += int(np.count_nonzero(ids >= size))
            ends.extend([end_codes[w.rstrip(_ENDS)[-2:]] for w in islice(places.at, len(ends), None)])
            ids, lengths = ids[np.repeat(~held_out, lengths)], lengths[~held_out]
            rows = len(lengths)
            if not rows:
                continue
            n_docs += rows
            owners = np.repeat(np.arange(rows), lengths)
            often = ids < anchors
            profiles = np.bincount(owners[often] * anchors + ids[often], minlength=rows * anchors).reshape(rows, anchors)
            profiles = np.rint(profiles / np.maximum(lengths, 1)[:, None] * UNIT)
            inside = ids < size
            held = np.bincount(owners[inside] * size + ids[inside], minlength=rows * size).reshape(rows, size)
            counts += held.sum(0)
            by_word += held.T.astype(float) @ profiles
            kinds, which = np.unique(np.array(ends)[ids[~inside]], return_inverse=True)
            fresh = kinds[place[kinds] < 0]
            place[fresh] = len(codes) + np.arange(len(fresh))
            codes, seen = np.append(codes, fresh), np.append(seen, np.zeros(len(fresh), np.int64))
            by_end = np.concatenate([by_end, np.zeros((len(fresh), anchors))])
            held = np.bincount(owners[~inside] * len(kinds) + which, minlength=rows * len(kinds)).reshape(rows, len(kinds))
            seen[place[kinds]] += held.sum(0)
            by_end[place[kinds]] += held.T.astype(float) @ profiles
        yield _slot({"by_word": by_word, "counts": counts, "codes": codes, "seen": seen, "by_end": by_end, "n": np.array([n_docs, n_tail])})

    def add(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        codes, which = np.unique(np.concatenate([p["codes"] for p in parts]), return_inverse=True)
        seen, by_end = np.zeros(len(codes), np.int64), np.zeros((len(codes), anchors))
        np.add.at(seen, which, np.concatenate([p["seen"] for p in parts]))
        np.add.at(by_end, which, np.concatenate([p["by_end"] for p in parts]))
        return {k: sum(p[k] for p in parts) for k in ("by_word", "counts", "n")} | {"codes": codes, "seen": seen, "by_end": by_end}

    found = _merged(docs.select(F.col("text").cast("binary"), "held_out").mapInArrow(run, _SLOTS), add)
    if not found:
        return np.zeros(len(head), np.int64), np.zeros((len(head), anchors)), {}, {}, 0, 0
    names = [(c & 0xFFFF).to_bytes(c >> 16, "big") for c in found["codes"].tolist()]
    seen, by_end = dict(zip(names, found["seen"].tolist(), strict=True)), dict(zip(names, found["by_end"], strict=True))
    return found["counts"], found["by_word"], seen, by_end, *found["n"].tolist()


def learn_all(docs: DataFrame, vocab: Vocab, net: Network) -> int:
    """Every partition learns all its training documents from ``net``, which then becomes the average of
    what they found, weighted by tokens. Returns the number of tokens learnt from."""
    start = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, own = Coder(start.value[0]), copy.deepcopy(start.value[1])
        adam, tokens = Adam(own.p), 0
        for group in text_groups(batches, 0, LEARN_BYTES):
            tokens += own.learn(coder.coded([tokens_of(t.as_py()) for t in group.column(0)]), adam)
        if tokens:
            yield _slot({**own.p, "n": np.array([tokens])})

    def add(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        n = sum(p["n"] for p in parts)
        return {k: sum(p[k] * (p["n"] / n) for p in parts).astype("f4") for k in net.p} | {"n": n}

    slim = docs.where("not held_out").select(F.col("text").cast("binary"))
    found = _merged(slim.mapInArrow(run, _SLOTS), add)
    if not found:
        return 0
    net.p = {k: found[k] for k in net.p}
    return int(found["n"][0])


def _packed(table_: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table_)
    return out.getvalue()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


_ASKED = "chunk long, bucket int, payload binary"


def _score_chunks(docs: DataFrame, model, buckets: int) -> DataFrame:
    """For every chunk one row with its documents (bucket -1) and one blob for each bucket it asks."""

    def chunk(coder: Coder, rows: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        _, net, counts = model.value
        head_log = np.log10(counts + 0.5)
        n_tail = TAILS
        batch = pa.Table.from_batches(rows)
        held = np.array(batch.column("held_out").to_pylist(), bool)
        coder.trim()
        places = [coder.of(tokens_of(text.as_py())) for text in batch.column("text")]
        ids, all_hashes = coder.known()
        bounds = np.append(0, np.cumsum([len(p) + 1 for p in places]))
        flat = np.zeros(bounds[-1], np.int32)  # the end is id 0
        inside = np.ones(len(flat), bool)
        inside[bounds[1:] - 1] = False
        places = np.concatenate(places)
        flat[inside] = ids[places]
        odd = flat[inside] >= HEAD
        owners = np.repeat(np.arange(len(held), dtype=np.int32), np.diff(bounds) - 1)[odd]
        # each tail word of the chunk once, in the order of its hash, with its training count
        places, at = places[odd], np.zeros(len(ids), np.int64)
        at[places] = 1
        spelt = np.flatnonzero(at)
        at[spelt] = np.arange(len(spelt))
        places = at[places]
        by_tail = np.bincount(owners * n_tail + (ids[spelt] - HEAD)[places], minlength=len(held) * n_tail).astype(np.int32)
        order = np.argsort(all_hashes[spelt], kind="stable")
        hashes, kinds = all_hashes[spelt][order], (ids[spelt][order] - HEAD).astype(np.uint8)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        places = rank[places]
        trained = np.bincount(places, weights=~held[owners], minlength=len(order)).astype("<u8")
        logp = np.add.reduceat(net.score(flat, bounds).astype(float), bounds[:-1])
        base = np.add.reduceat(np.append(head_log, np.zeros(n_tail))[flat], bounds[:-1])
        known = np.add.reduceat(np.append(counts > 0, np.zeros(n_tail, bool)).astype(np.int64)[flat], bounds[:-1])
        where = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        asked, edges = np.unique(where, return_index=True)
        edges = np.append(edges, len(where))
        own = {
            "doc_id": batch.column("doc_id").combine_chunks(), "held_out": pa.array(held),
            "n_tokens": pa.array(np.diff(bounds)), "known": pa.array(known), "base": pa.array(base), "logp": pa.array(logp),
            "tails": pa.FixedSizeListArray.from_arrays(pa.array(by_tail), n_tail),
        }
        links = {"place": pa.array(places), "owner": pa.array(owners)}
        first = np.array([len(x := _packed(pa.table(own)))], "<i8").tobytes() + x + _packed(pa.table(links))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([number]), "bucket": pa.array([-1], pa.int32()), "payload": pa.array([first], pa.binary())})
        for k, b in enumerate(asked):
            part = slice(edges[k], edges[k + 1])
            blob = hashes[part].astype("<u8").tobytes() + trained[part].tobytes() + kinds[part].tobytes()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number]), "bucket": pa.array([int(b)], pa.int32()), "payload": pa.array([blob], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value[0], hashed=True)
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in text_groups(batches, 2, CHUNK_BYTES // 8):
            rows.append(batch)
            size += batch.column(2).nbytes
            if size >= CHUNK_BYTES:
                yield from chunk(coder, rows, number)
                number, rows, size = number + 1, [], 0
        if rows:
            yield from chunk(coder, rows, number)

    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(run, _ASKED)


def _count_bucket(group: pa.Table) -> pa.Table:
    """Answer the blobs of one bucket with counts; a row of totals by tail class comes along."""
    chunks, blobs = group.column("chunk").to_pylist(), group.column("payload").to_pylist()
    sizes = [len(b) // 17 for b in blobs]
    part = lambda kind, skip: np.concatenate([np.frombuffer(b, kind, n, skip * n) for b, n in zip(blobs, sizes, strict=True)])
    hashes, trained, kinds = part("<u8", 0), part("<u8", 8), part(np.uint8, 16)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=trained).astype("<u8")
    n = np.bincount(kinds, weights=trained, minlength=TAILS).astype("<i8")
    v = np.bincount(kinds[first], weights=counts > 0, minlength=TAILS).astype("<i8")
    answers, at = [], 0
    for size in sizes:
        answers.append(zlib.compress(counts[inverse[at : at + size]].tobytes(), 1))
        at += size
    bucket = group.column("bucket")[0].as_py()
    return pa.table(
        {
            "chunk": pa.array([*chunks, -1], pa.int64()),
            "bucket": pa.array([bucket] * (len(chunks) + 1), pa.int32()),
            "payload": pa.array([*answers, n.tobytes() + v.tobytes()], pa.binary()),
        }
    )


def score_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``held_out``: a Column that marks the rows nothing is learnt from (default: crc32 of the id modulo 5 is 1).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lm")
    out = crc_mod5(df[id_col]) == 1 if held_out is None else held_out
    docs = df.select(df[id_col].alias("doc_id"), out.alias("held_out"), text_of(df, text_col).alias("text"))
    sample = sample_documents(docs, df.count())
    head = head_words(docs)
    found, by_word, seen, by_end, n_docs, n_tail = word_profiles(docs, head)
    vocab, found = choose_vocab(head, by_word, seen, by_end), dict(zip(head, found.tolist(), strict=True))
    counts = np.zeros(HEAD, np.int64)
    counts[: len(vocab.words)] = [n_docs, *(found[w] for w in vocab.words[1:])]
    net = Network(len(vocab.words))
    if n_docs:
        tails = np.zeros(TAILS)
        for e, n in seen.items():
            tails[vocab.ends.get(e, 0)] += n
        net.start_from(counts[: len(vocab.words)].astype(float), tails)
        coded, size = [], 0
        for own in Coder(vocab).coded(sample):
            if size < TRAIN_TOKENS:
                coded.append(own)
                size += len(own)
        if coded:
            net.train(coded)
        del coded, sample
        learn_all(docs, vocab, net)
    model = spark.sparkContext.broadcast((vocab, net, counts))
    buckets = max(shuffle_partitions(spark), -(-n_tail // BUCKET_TOKENS))
    asked = scratch.write(_score_chunks(docs, model, buckets))
    answered = scratch.write(asked.where("bucket >= 0").groupBy("bucket").applyInArrow(_count_bucket, _ASKED))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                both = np.frombuffer(raw, "<i8")
                n, v = n + both[:TAILS], v + both[TAILS:]
        yield pa.RecordBatch.from_pydict({"kind": pa.array(range(TAILS), pa.int32()), "n": pa.array(n), "v": pa.array(v)})

    totals = (
        answered.where("chunk = -1").select("payload").mapInArrow(add, "kind int, n long, v long")
        .groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    )
    n_of, v_of = np.zeros(TAILS), np.zeros(TAILS)
    for r in totals:
        n_of[r["kind"]], v_of[r["kind"]] = r["n"], r["v"]
    n_all, v_all = int(counts.sum() + n_of.sum()), int((counts > 0).sum() + v_of.sum())
    base_of_all = np.log10(n_all + 0.5 * (v_all + 1))
    tail_of = np.log10(n_of + 0.5 * (v_of + 1))

    def finish(group: pa.Table) -> pa.Table:
        replies, docs_, links = {}, None, None
        for bucket, raw in zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True):
            if bucket < 0:
                cut = 8 + int(np.frombuffer(raw, "<i8", 1)[0])
                docs_, links = _unpacked(raw[8:cut]), _unpacked(raw[cut:])
            else:
                replies[bucket] = np.frombuffer(zlib.decompress(raw), "<u8")
        rows = docs_.num_rows
        found = np.concatenate([np.zeros(0, "<u8"), *(replies[b] for b in sorted(replies))])
        owner, found = links.column("owner").to_numpy(), found[links.column("place").to_numpy()]
        logs = np.bincount(owner, weights=np.log10(found + 0.5), minlength=rows)
        known = docs_.column("known").to_numpy() + np.bincount(owner, weights=found > 0, minlength=rows).astype(np.int64)
        tails = docs_.column("tails").combine_chunks().flatten().to_numpy().reshape(rows, TAILS)
        n_tokens = docs_.column("n_tokens").to_numpy()
        return pa.table(
            {
                "doc_id": docs_.column("doc_id"),
                "held_out": docs_.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(rows, n_all), pa.int64()),
                "base_score": pa.array(docs_.column("base").to_numpy() + logs - n_tokens * base_of_all),
                "score": pa.array(docs_.column("logp").to_numpy() / np.log(10) + logs - tails @ tail_of),
            }
        )

    # a chunk's own row and the answers to it; what a chunk holds is bounded by CHUNK_BYTES
    meet = asked.where("bucket < 0").unionByName(answered.where("chunk >= 0"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return meet.groupBy("chunk").applyInArrow(
        finish,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
