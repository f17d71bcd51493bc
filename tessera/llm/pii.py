"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF on top.

Base spans come from exact patterns (e-mail, IP, card, phone) over the whole text. The network tags
every character of the whole text and adds spans that the patterns miss; base spans always stay.

Model: characters are mapped to ``SYMBOLS``; one LSTM reads forwards, one backwards (softsign cells);
a linear layer scores the tags (none and one for each kind) and a CRF's transitions join them. It is
trained in numpy on the driver from labelled spans: base spans of a bounded sample of documents
(``SAMPLE_ROWS`` by a hash of the id; of longer ones a stretch of ``SAMPLE_CHARS`` characters) and spans written in other
usual forms into lines of these documents, with look-alikes that are no personal data.

Decoding: a text is cut into windows of ``WINDOW`` characters that overlap by ``OVERLAP``. Windows of
many texts run side by side through the network. They are then reconciled over the whole text: each
character takes its scores from the window in which it lies furthest from an edge, and one best path is
found over the joined scores, across all seams. All-none is the best path wherever no stretch can pay for
leaving it, which is checked exactly, so Viterbi runs over the rest only. A window none of whose
characters adds to a stretch parts its neighbours: a stretch over all of it is longer than a span may be.
An added span must not touch a base span and must hold what its
kind asks for (digits, checksum, an address' parts).

Memory is bounded by groups of whole texts (``GROUP_BYTES``) and tiles of windows; nothing is shuffled.
The model is some thousand numbers and is broadcast.

Defined results: null texts are empty and hold nothing; repeated rows are judged each; spans count code
points, end exclusive. Of base spans of different kinds that overlap all are reported; redaction then
covers their union under the kind that begins first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import bounded_batches, bounded_sample, table, text_groups, text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 16_000
WINDOW, OVERLAP, TILE, GROUP_BYTES = 1024, 64, 1024, 4 << 20
#: Characters that Viterbi takes side by side, about.
CELLS = 1 << 18
#: Size of each LSTM's state, and windows that it is trained on.
STATE, EXAMPLES = 8, 12_000

# ---------------------------------------------------------------- base spans

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, @, domain with a dot: the local part reaches back as far as it can, though not into
    the match before, which is where the leftmost match begins."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ip_ok(s: str) -> bool:
    # a part of more digits than three is over 255 unless it begins with zeros
    return all(int(p.lstrip("0")[:4] or "0") <= 255 for p in s.split("."))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start and then kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _ip_ok(m[0])]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() < 64 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------- symbols

_SINGLE = " \n@.+-_()[]%/:,;='\"#*&$!?|<>{}\\"
SYMBOLS = len(_SINGLE) + 9  # digit, a-f, g-z, A-F, G-Z, other white space, longer letters, other signs, edge
EDGE = SYMBOLS - 1


def _symbol_table() -> np.ndarray:
    n = len(_SINGLE)
    out = np.full(129, n + 7, np.uint8)
    out[128] = n + 6
    for i, c in enumerate(_SINGLE):
        out[ord(c)] = i
    for a, b, k in (("0", "9", 0), ("a", "f", 1), ("g", "z", 2), ("A", "F", 3), ("G", "Z", 4), ("\t", "\t", 5), ("\x0b", "\r", 5)):
        out[ord(a) : ord(b) + 1] = n + k
    return out


_TABLE = _symbol_table()


def symbols_of(text: str) -> np.ndarray:
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 128)]


# ---------------------------------------------------------------- the network


def _softsign(x: np.ndarray) -> np.ndarray:
    """In place x / (1 + |x|), with slope (1 - |result|) squared."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class Tagger:
    """Two LSTMs, a linear layer and CRF transitions; float32 numpy with gradients by hand."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype("f4")
        s, k = STATE, len(KINDS) + 1
        self.p = {"E": np.zeros((2 * s, k), "f4"), "e": np.zeros(k, "f4"), "T": np.zeros((k, k), "f4"), "S": np.zeros(k, "f4")}
        self.p["E"] = draw(2 * s, k)
        for side in "fb":
            # gates in the order input, forget, output, candidate; the forget gate starts open
            x = draw(SYMBOLS, 4 * s)
            x[:, s : 2 * s] += 1
            self.p["X" + side], self.p["U" + side] = x, draw(s, 4 * s)

    def lstm(self, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, STATE) of symbols (steps, windows), read in the order given."""
        s, (steps, width) = STATE, x.shape
        table_, u = self.p["X" + side], self.p["U" + side]
        h, c = np.zeros((width, s), "f4"), np.zeros((width, s), "f4")
        out, g = np.empty((steps, width, s), "f4"), np.empty((width, 4 * s), "f4")
        for t in range(steps):
            if keep is None:
                np.matmul(h, u, out=g)
                g += table_[x[t]]
            else:
                g = h @ u + table_[x[t]]
            _softsign(g)
            gates = g[:, : 3 * s] * np.float32(0.5)
            gates += np.float32(0.5)
            before = c
            c = gates[:, s : 2 * s] * c
            c += gates[:, :s] * g[:, 3 * s :]
            squashed = _softsign(c.copy())
            if keep is not None:
                keep.append((h, before, g, gates, squashed))
            h = gates[:, 2 * s :] * squashed
            out[t] = h
        return out

    def lstm_back(self, side: str, x: np.ndarray, keep: list, d_out: np.ndarray, grads: dict) -> None:
        s, (steps, width) = STATE, x.shape
        d_h, d_c = np.zeros((width, s), "f4"), np.zeros((width, s), "f4")
        d_x = np.empty((steps, width, 4 * s), "f4")
        for t in reversed(range(steps)):
            h, before, g, gates, squashed = keep[t]
            i, f, o = gates[:, :s], gates[:, s : 2 * s], gates[:, 2 * s :]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - np.abs(squashed)) ** 2
            d_g = np.hstack([0.5 * d_c * g[:, 3 * s :], 0.5 * d_c * before, 0.5 * d_h * squashed, d_c * i])
            d_g *= (1 - np.abs(g)) ** 2
            d_x[t] = d_g
            grads["U" + side] += h.T @ d_g
            d_h, d_c = d_g @ self.p["U" + side].T, d_c * f
        which = np.zeros((x.size, SYMBOLS), d_x.dtype)
        which[np.arange(x.size), x.ravel()] = 1
        grads["X" + side] += which.T @ d_x.reshape(-1, 4 * s)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (steps, windows, tags)."""
        s, (steps, width) = STATE, x.shape
        e = self.lstm("f", x).reshape(-1, s) @ self.p["E"][:s]
        e = e.reshape(steps, width, -1)
        e += (self.lstm("b", x[::-1])[::-1].reshape(-1, s) @ self.p["E"][s:]).reshape(e.shape)
        e += self.p["e"]
        return e

    def loss(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of tag paths (steps, windows) and its gradients."""
        s, (steps, width), k = STATE, x.shape, len(KINDS) + 1
        kf, kb = [], []
        f, b = self.lstm("f", x, kf), self.lstm("b", x[::-1], kb)[::-1]
        e = np.concatenate([f, b], 2) @ self.p["E"] + self.p["e"]
        trans, start, e64, cols = self.p["T"].astype(float), self.p["S"].astype(float), e.astype(float), np.arange(width)
        # forward and backward sums in probabilities, scaled step by step
        top, most, ones = e64.max(2), trans.max(), np.ones(k)
        emit, step = np.exp(e64 - top[:, :, None]), np.exp(trans - most)
        alpha, beta, scale = np.empty((steps, width, k)), np.ones((steps, width, k)), np.empty((steps, width))
        now = np.exp(start) * emit[0]
        for t in range(steps):
            if t:
                now = (now @ step) * emit[t]
            scale[t] = now @ ones
            now /= scale[t][:, None]
            alpha[t] = now
        for t in range(steps - 2, -1, -1):
            beta[t] = (emit[t + 1] * beta[t + 1]) @ step.T / scale[t + 1][:, None]
        z = np.log(scale).sum(0) + top.sum(0) + (steps - 1) * most
        path = start[tags[0]] + e64[np.arange(steps)[:, None], cols, tags].sum(0) + trans[tags[:-1], tags[1:]].sum(0)
        d_e = alpha * beta
        grads = {name: np.zeros_like(v) for name, v in self.p.items()}
        grads["S"] += d_e[0].sum(0) - np.bincount(tags[0], minlength=k)
        pair = alpha[:-1].reshape(-1, k).T @ (emit * beta / scale[:, :, None])[1:].reshape(-1, k) * step
        grads["T"] += pair - np.bincount(tags[:-1].ravel() * k + tags[1:].ravel(), minlength=k * k).reshape(k, k)
        d_e[np.arange(steps)[:, None], cols, tags] -= 1
        d_e = d_e.astype("f4")
        grads["e"] += d_e.sum((0, 1))
        grads["E"] += np.concatenate([f, b], 2).reshape(-1, 2 * s).T @ d_e.reshape(-1, k)
        d_s = d_e @ self.p["E"].T
        self.lstm_back("f", x, kf, d_s[:, :, :s], grads)
        self.lstm_back("b", x[::-1], kb, d_s[::-1, :, s:], grads)
        return float((z - path).sum()), grads

    def train(self, x: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 320, rate: float = 0.03) -> None:
        """Adam; x and tags are (examples, steps)."""
        rng, n = np.random.default_rng(11), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        total = epochs * max(1, len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, max(1, len(x) - batch + 1), batch):
                at = order[i : i + batch]
                n += 1
                _, grads = self.loss(np.ascontiguousarray(x[at].T), np.ascontiguousarray(tags[at].T))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / len(at)
                now = rate * (1 - 0.95 * n / total)
                for k, g in grads.items():
                    g = g / np.float32(len(at) * max(1.0, norm / 5))
                    m[k] += np.float32(0.1) * (g - m[k])
                    v[k] += np.float32(0.01) * (g * g - v[k])
                    self.p[k] -= np.float32(now / (1 - 0.9**n)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.99**n)) + np.float32(1e-6))

    def bounds(self) -> tuple[float, float]:
        """What a character of a stretch off none may gain by the transition into it from the one before,
        and what a stretch must gain in all that way to pay for the way in and out, against staying at none."""
        way = self.p["T"].astype(float) - float(self.p["T"][0, 0])
        stay, enter, leave = way[1:, 1:].max(), way[0, 1:].max(), way[1:, 0].max()
        return float(stay), float(stay - enter - leave)

    def above(self, e: np.ndarray) -> np.ndarray:
        """By how much the best tag of a character is above none, with the gain of staying off none."""
        best = reduce(np.maximum, (e[..., k] for k in range(1, len(KINDS) + 1)))
        return best - e[..., 0] + np.float32(self.bounds()[0])

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (windows, steps) of scores (steps, windows, tags)."""
        trans = self.p["T"]
        steps, width, k = e.shape
        best, back = self.p["S"] + e[0], np.zeros((steps, width, k), np.uint8)
        for t in range(1, steps):
            v = best[:, :, None] + trans
            back[t] = v.argmax(1)
            best = v.max(1) + e[t]
        paths, rows = np.zeros((width, steps), np.uint8), np.arange(width)
        paths[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            paths[:, t - 1] = back[t][rows, paths[:, t]]
        return paths

    def paying(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Runs of the characters (of scores (steps, tags)) that a stretch off none may hold on the best path.

        A stretch gains the sum of ``above`` over its characters at most, and must reach what ``bounds`` says.
        A character through which no stretch does is none on the best path."""
        s = self.above(e).astype(float)
        sums = np.concatenate([[0.0], np.cumsum(s)])
        ahead = sums[1:] - np.minimum.accumulate(sums[:-1])  # the best sum that ends at a character
        after = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]  # the best one that begins there
        pays = ahead + after - s >= self.bounds()[1] - 1e-3
        edges = np.flatnonzero(np.diff(pays.astype(np.int8), prepend=0, append=0))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def decode(self, scores: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """Stretches (start, end, tag) of the best path over each of the scores (steps, tags), with none before
        the first character and after the last."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in scores]
        runs = sorted(((i, lo, hi) for i, e in enumerate(scores) for lo, hi in self.paying(e)), key=lambda r: r[1] - r[2])
        none = np.zeros(len(KINDS) + 1, "f4")
        none[0] = 1e6
        at = 0
        while at < len(runs):  # side by side, the longest first
            steps = runs[at][2] - runs[at][1] + 2
            part = runs[at : at + max(1, CELLS // steps)]
            e = np.empty((steps, len(part), len(none)), "f4")
            e[:] = none
            for j, (i, lo, hi) in enumerate(part):
                e[1 : 1 + hi - lo, j] = scores[i][lo:hi]  # a character before a run is none, and so is one after it
            for (i, lo, _), tags in zip(part, self.viterbi(e), strict=True):
                cuts = np.flatnonzero(np.diff(tags, prepend=0, append=0))
                out[i] += [(lo + int(x) - 1, lo + int(y) - 1, int(tags[x])) for x, y in zip(cuts, cuts[1:], strict=False) if tags[x]]
            at += len(part)
        return [sorted(s) for s in out]


# ---------------------------------------------------------------- labelled spans


def _other_forms(rng: np.random.Generator) -> tuple[str, int]:
    """A span in a usual form that the patterns may miss (kind number), or a look-alike (-1)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    card = [int(c) for c in "4" + d(14)]
    check = next(str(c) for c in range(10) if luhn("".join(map(str, card)) + str(c)))
    card_ = "".join(map(str, card)) + check
    groups = [card_[i : i + 4] for i in range(0, 16, 4)]
    octets = [str(n) for n in rng.integers(1, 256, 4)]
    name, host = f"{w(int(rng.integers(2, 7)))}{d(int(rng.integers(0, 3)))}", w(int(rng.integers(3, 8)))
    end = ("com", "net", "org", "fr", "de")[rng.integers(5)]
    made = [
        (f"{name}.{w(4)}@mail{d(1)}.{host}.{end}", 0), (f"{name}@{host}.{end}", 0),
        (f"{name} [at] {host} [dot] {end}", 0), (f"{name} (at) {host}.{end}", 0), (f"{name} @ {host}.{end}", 0),
        (".".join(octets), 1), ("[.]".join(octets), 1), (" . ".join(octets), 1),
        (card_, 2), (" ".join(groups), 2), ("-".join(groups), 2), (".".join(groups), 2), ("/".join(groups), 2),
        (f"+{d(1)} ({d(3)}) 555-{d(4)}", 3), (f"({d(3)}) {d(3)}-{d(4)}", 3), (f"{d(3)}-{d(3)}-{d(4)}", 3),
        (f"+{d(2)} {d(3)} {d(3)} {d(3)}", 3), (f"00{d(2)} {d(3)} {d(6)}", 3), (f"{d(3)}.{d(3)}.{d(4)}", 3),
        (f'token = "{"".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40))}"', -1),
        (f"version {d(1)}.{d(1)}", -1), (f"{d(1)}.{d(1)}.{d(2)}", -1), (f"20{d(2)}-{d(2)}-{d(2)}", -1), (f"CC BY {d(1)}.0", -1),
        (f"{d(2)}:{d(2)}", -1), (d(int(rng.integers(1, 6))), -1), (f"{d(2)}.{d(2)} %", -1), (f"@{name}", -1), (f"a + b = {d(2)}", -1),
        (f"(see {w(4)})", -1), (f"{w(3)}-{w(4)}", -1), (f"${d(2)}.{d(2)}", -1), (f"#{d(4)}", -1), (f"{d(3)}/{d(4)}", -1),
        (f"{d(3)} {d(3)} {d(3)}", -1), (f"{d(4)}-{d(4)}", -1), (f"{d(3)}-{d(3)}", -1), (f"{w(4)} at {w(4)}.", -1), (f"{d(6)}", -1),
    ]
    return made[rng.integers(len(made))]


def examples(texts: list[str], steps: int = 96, most: int = EXAMPLES, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags: around base spans, around written-in forms, and anywhere."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans, at: int) -> None:
        start = max(0, at)
        x, y = np.full(steps, EDGE, np.uint8), np.zeros(steps, np.int64)
        part = symbols_of(text[start : start + steps])
        x[: len(part)] = part
        for a, b, k in spans:
            y[max(0, a - start) : max(0, b - start)] = k + 1
        xs.append(x)
        ys.append(y)

    pool = [t for t in texts if t] or [" "]
    found = [base_spans(t) for t in pool]
    for t, spans in zip(pool, found, strict=True):
        if len(xs) >= most // 3:
            break
        for a, _, _ in spans[:3]:
            add(t, spans, a - int(rng.integers(0, steps - 24)))
    for _ in range(most // 2):
        t = pool[rng.integers(len(pool))]
        at = int(rng.integers(len(t) + 1))
        at = max(t.rfind(" ", 0, at), t.rfind("\n", 0, at)) + 1
        form, kind = _other_forms(rng)
        before = t[max(0, at - steps) : at]
        tail = ("", " ", ". ", "%%% ", "!! ", ", ", ")")[rng.integers(7)] + t[at : at + steps]
        text = before + form + tail
        spans = [s for s in base_spans(text) if s[1] <= len(before) or s[0] >= len(before) + len(form)]
        if kind >= 0:
            spans.append((len(before), len(before) + len(form), kind))
        add(text, spans, len(before) - int(rng.integers(0, steps - 24)))
    while len(xs) < most:
        k = rng.integers(len(pool))
        add(pool[k], found[k], int(rng.integers(max(1, len(pool[k]) - steps))))
    return np.stack(xs), np.stack(ys)


def train_tagger(texts: list[str]) -> Tagger:
    tagger = Tagger()
    tagger.train(*examples(texts))
    return tagger


# ---------------------------------------------------------------- whole texts


@dataclass(frozen=True)
class Window:
    text: int
    start: int
    size: int


def windows_of(n: int, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, size) of overlapping windows over n characters."""
    out, at = [], 0
    while n:
        out.append((at, min(window, n - at)))
        if at + window >= n:
            break
        at += window - overlap
    return out


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind number) of the network over whole texts."""
    coded = [symbols_of(t) for t in texts]
    todo = [Window(i, a, n) for i, c in enumerate(coded) for a, n in windows_of(len(c))]
    todo.sort(key=lambda w: -w.size)
    parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for k in range(0, len(todo), TILE):
        tile = todo[k : k + TILE]
        x = np.full((tile[0].size + 2, len(tile)), EDGE, np.uint8)  # an edge before and after
        for j, w in enumerate(tile):
            x[1 : 1 + w.size, j] = coded[w.text][w.start : w.start + w.size]
        e = tagger.emissions(x)
        some = (tagger.above(e) > 0).any(0)
        for j in np.flatnonzero(some).tolist():
            w = tile[j]  # of two windows each owns its half of the overlap
            lo = OVERLAP // 2 if w.start else 0
            hi = w.size - (OVERLAP // 2 if w.start + w.size < len(coded[w.text]) else 0)
            parts.setdefault(w.text, []).append((w.start + lo, w.start + hi, e[1 + lo : 1 + hi, j].copy()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places, scores = [], []
    for i, found in parts.items():
        found.sort(key=lambda p: p[0])
        k = 0
        while k < len(found):  # scores of neighbouring windows are put together and decoded as one
            to = k + 1
            while to < len(found) and found[to][0] == found[to - 1][1]:
                to += 1
            places.append((i, found[k][0]))
            scores.append(np.concatenate([p[2] for p in found[k:to]]))
            k = to
    for (i, at), spans in zip(places, tagger.decode(scores), strict=True):
        out[i] += [(at + a, at + b, tag - 1) for a, b, tag in spans]
    return out


#: Characters by which an added span's edge may be off.
SNAP = 4
_AROUND = " \t\r\n.,;:!?\"'*%&$#|=<>{}"
_PARTS = re.compile(r"[0-9]+")
_AT = re.compile(r"@|\bat\b")


def accept(text: str, start: int, end: int, kind: int, taken: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """An added span without what surrounds it, if it holds what its kind asks for and is free. An edge
    inside a run of letters and digits moves to the run's end, up to SNAP characters."""
    while start < end and text[start] in _AROUND:
        start += 1
    while end > start and text[end - 1] in _AROUND:
        end -= 1
    for _ in range(SNAP):
        if 0 < start < end and text[start - 1].isalnum() and text[start].isalnum():
            start -= 1
        if start < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
    if any(a < end and start < b for a, b, _ in taken):
        return None
    said = text[start:end]
    digits = _digits(said)
    if KINDS[kind] == "email":
        good = "." in said.rpartition("at")[2] or "dot" in said
        good = good and len(said) <= 100 and _AT.search(said) is not None and sum(c.isalnum() for c in said) >= 6
    elif KINDS[kind] == "ip":
        parts = _PARTS.findall(said)
        good = len(parts) == 4 and len(said) <= 32 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
        good = good and not any(c.isalpha() for c in said)
    elif KINDS[kind] == "card":
        good = 14 <= len(digits) <= 19 and len(said) <= 30 and luhn(digits) and not any(c.isalpha() for c in said)
    else:
        good = 9 <= len(digits) <= 15 and len(said) <= 24 and len(_PARTS.findall(said)) >= 3 and not any(c.isalpha() for c in said)
    # a span cut out of a longer number or word is none
    inside = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return (start, end, kind) if good and not inside else None


def spans_of(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans, by start and then kind."""
    out = []
    for text, tagged in zip(texts, tag_texts(tagger, texts), strict=True):
        base = base_spans(text)
        every = list(base)
        for a, b, k in tagged:
            more = accept(text, a, b, k, every)
            if more:
                every.append(more)
        out.append((base, sorted(every, key=lambda s: (s[0], s[2]))))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans) -> str:
    """Every span becomes its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sample_texts(docs: DataFrame, ident, text) -> list[str]:
    begin = F.pmod(F.xxhash64(ident.cast("string"), F.lit(43)), F.greatest(F.char_length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    rows = docs.select(ident.alias("i"), F.substring(text, begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).where("text <> ''")
    return bounded_sample(rows, F.col("i"), SAMPLE_ROWS, 41, docs.count()).select("text").toArrow().column("text").to_pylist()


def find_pii(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the kept columns, counts of base spans by kind, n_added, base_sha256, spans (text form)
    and, if asked for, the redacted text."""
    spark = df.sparkSession
    bounded_batches(spark)
    tagger = spark.sparkContext.broadcast(train_tagger(sample_texts(df, df[id_col], text_of(df, text_col))))
    slim = df.select(df[id_col].alias("doc_id"), *[df[c] for c in keep], text_of(df, text_col).alias("_text"))
    own = slim.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, len(own), GROUP_BYTES):
            texts = batch.column(len(own)).to_pylist()
            found = spans_of(tagger.value, texts)
            out = dict(zip(own, batch.columns, strict=False))
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64())
            out["n_added"] = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
            out["spans"] = pa.array([joined(every) for _, every in found])
            if redacted:
                out["redacted"] = pa.array([redact(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    counts = "".join(f"n_{kind} long, " for kind in KINDS)
    return slim.mapInArrow(run, f"{kept}{counts}n_added long, base_sha256 string, spans string{', redacted string' * redacted}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
