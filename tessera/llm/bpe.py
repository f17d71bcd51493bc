"""Byte-level BPE by a traversal of a trie of distinct words that share prefixes.

For a fixed list of merges every prefix of a word has one encoding, and that encoding is the encoding
of a shorter prefix followed by one last token. So a word is encoded by finding, for each of its
prefixes, the last token: the token that ends there and that may follow the last token of the prefix
before it (two tokens may follow each other when no merge would have joined bytes across their border).

The distinct words of a group of texts form a trie. It is walked depth first in sorted order, with the
last token of every prefix on the path at hand, so a prefix that many words share is encoded once. The
encoding of a word is read off by stepping back through last tokens.

Texts are handled in groups of bounded size inside each task; nothing is shuffled, and the table of
words already encoded is emptied when it reaches ``MAX_WORDS``. Very long words are linear in time.

Defined results: null texts are empty and have no ids; a text that holds a special token's string gives
that token's id there. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import bounded_batches, table, text_groups, text_of

#: How the byte-level tokenizer parts a text into words; fixed.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, as letter -> byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, ids and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.id_of = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in self.id_of.items():
            self.bytes_of[i] = s
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        self.rank = [0] * size
        for n, pair in enumerate(model["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            left, right, whole = self.id_of[a], self.id_of[b], self.id_of[a + b]
            if self.parts[whole] is None:
                self.parts[whole] = (left, right)
                self.rank[whole] = n + 1
            self.joined[left, right] = whole
        self.longest = max(map(len, self.id_of))
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None


class TrieEncoder:
    """Encodes sets of words; keeps what two tokens may stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between the tokens a and b open.

        The border closes at the first merge that joins a token ending there with one starting there.
        What ends there goes from a's last byte up to a along right parts, in the order of merges; what
        starts there likewise for b. Each pair that stands side by side at some time must not merge
        before one of the two is taken up into a longer token.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._open(a, b)
            if len(self.fits) > 2_000_000:
                self.fits.clear()
        return known

    def _open(self, a: int, b: int) -> bool:
        parts, rank, joined, never = self.v.parts, self.v.rank, self.v.joined, 1 << 60
        ends, starts = [a], [b]
        while parts[ends[-1]] is not None:
            ends.append(parts[ends[-1]][1])
        while parts[starts[-1]] is not None:
            starts.append(parts[starts[-1]][0])
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            left = rank[ends[i - 1]] if i else never
            right = rank[starts[j - 1]] if j else never
            across = joined.get((ends[i], starts[j]))
            # of equal ranks the merge further left is done first
            if across is not None and (rank[across] < left and rank[across] <= right):
                return False
            if left == right == never:
                return True
            if left <= right:
                i -= 1
            else:
                j -= 1

    def stands_alone(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merge(self.v.bytes_of[token]) == [token]
        return known

    def merge(self, word: bytes) -> list[int]:
        """The merges one by one; used on single tokens only."""
        ids = [self.v.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            found = [(self.v.rank[w], i, w) for i in range(len(ids) - 1) if (w := self.v.joined.get((ids[i], ids[i + 1]))) is not None]
            if not found:
                break
            _, i, whole = min(found)
            ids[i : i + 2] = [whole]
        return ids

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Every distinct word with its ids, in sorted order, which is the trie's depth-first order."""
        id_of, bytes_of, longest = self.v.id_of, self.v.bytes_of, self.v.longest
        get, known, follow, alone = id_of.get, self.fits, self.may_follow, self.stands_alone
        last: list[int] = [-1]  # by depth on the path from the root; the root has no token
        path = b""
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for size in range(min(depth, longest), 0, -1):
                    token = get(word[depth - size : depth])
                    if token is None:
                        continue
                    if size == depth:
                        fits = alone(token)
                    else:
                        fits = known.get(last[depth - size] << 20 | token)
                        if fits is None:
                            fits = follow(last[depth - size], token)
                    if fits:
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            path = word
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= len(bytes_of[last[at]])
            ids.reverse()
            yield word, ids


class TextCodec:
    """Whole texts to ids and back; words already encoded are kept up to a bound."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.trie = TrieEncoder(self.v)
        self.split = regex.compile(SPLIT)
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}
        self.marks = {s: np.array([i], "<u4").tobytes() for s, i in self.v.special.items()}

    def words(self, text: str) -> list[str]:
        if self.v.marks is not None and any(s in text for s in self.v.special):
            out: list[str] = []
            for k, part in enumerate(self.v.marks.split(text)):
                out += [part] if k % 2 else self.split.findall(part)
            return out
        return self.split.findall(text)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids_of]
        if len(self.ids_of) + len(fresh) > MAX_WORDS:
            self.ids_of.clear()
            self.text_of.clear()
            fresh = list(words)
        back = {w.encode(): w for w in fresh}
        for special in self.v.special:
            if special in words:
                back.pop(special.encode(), None)
                self.ids_of[special] = self.marks[special]
                self.text_of[special] = special.encode()
        for word, ids in self.trie.encode_words(list(back)):
            at = back[word]
            self.ids_of[at] = np.array(ids, "<u4").tobytes()
            self.text_of[at] = self.decode(ids)

    def decode(self, ids) -> bytes:
        return b"".join([self.v.bytes_of[i] for i in ids])

    def encode_group(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (little-endian unsigned 32-bit) and the bytes they decode to."""
        words = [self.words(t) for t in texts]
        distinct: set[str] = set()
        for w in words:
            distinct.update(w)
        self.learn(distinct)
        for w in words:
            yield b"".join([self.ids_of[x] for x in w]), b"".join([self.text_of[x] for x in w])


_codecs: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    """One codec for each file and worker process."""
    if path not in _codecs:
        _codecs[path] = TextCodec(path)
    return _codecs[path]


def encode_texts(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids (array, if asked for), ids_sha256 and decoded_sha256 of every row."""
    bounded_batches(df.sparkSession)
    where = path or default_vocabulary()
    slim = df.select(df[id_col].alias("doc_id"), text_of(df, text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(where)
        for batch in text_groups(batches, 1):
            n, ids, a, b = [], [], [], []
            for raw, decoded in own.encode_group(batch.column(1).to_pylist()):
                n.append(len(raw) // 4)
                if with_ids:
                    ids.append(np.frombuffer(raw, "<u4").astype("i4"))
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out | {"ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)})

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), with_ids=False)
