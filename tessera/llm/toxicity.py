"""Toxicity by weak supervision.

Many voters look at a text: one for each entry of a lexicon (general words of abuse, and stems of words
that the labelled training rows single out, in whatever language) and several patterns over how many
findings there are and how dense they lie. A generative model with a hidden class estimates, by
expectation maximisation, how often each voter fires in either class and how voters are correlated;
correlated voters share their weight. A given label is one more voter of limited accuracy, so wrong
labels are outvoted. A linear classifier is then trained on the posterior labels and scores every text.

Learning reads a bounded sample of labelled rows (``SAMPLE_ROWS``, in the order of a hash of the id; a
row without a document, or with one over ``SAMPLE_CHARS`` characters, is not drawn and takes no place). Scoring reads the whole text of every row; labels,
language, source and id are never inputs of a score. The model (a few hundred numbers) is broadcast.

Defined results: null texts are empty; an empty text fires no voter and gets the score of a text
without findings. Without labelled rows of both classes a fixed rule stands in (``FALLBACK``). Several
labels of one id count as their mean; a label for an id that doesn't occur is ignored; repeated rows
are scored each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import bounded_batches, crc_mod5, table, text_groups, text_of

SAMPLE_ROWS = 6000
SAMPLE_CHARS = 16_000
#: Words that the training rows add to the lexicon at most.
INDUCED = 64
#: The least share of wrong labels that is reckoned with.
LABEL_ERROR = 0.02
#: Voters whose residuals are correlated by more than this share their weight.
CORRELATED = 0.3
#: Bias and weight of "two findings" when nothing can be learnt.
FALLBACK = (-3.0, 6.0)

#: Words of abuse, fixed.
SEEDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "crap", "degenerate", "dimwit", "disgusting", "dumbass",
    "filth", "filthy", "garbage", "idiot", "idiotic", "idiots", "imbecile", "jerk", "loser", "losers", "lowlife",
    "moron", "moronic", "morons", "pathetic", "pig", "scum", "scumbag", "shit", "stupid", "trash", "vermin",
    "wanker", "worthless",
)

_LETTERS = bytes(range(ord("a"), ord("z") + 1))


def _byte_table(also: dict[str, str]) -> bytes:
    """Lower-case letters and bytes of longer characters stay; other bytes part words."""
    out = bytearray(b" " * 256)
    for b in range(128, 256):
        out[b] = b
    for b in _LETTERS:
        out[b] = b
        out[b - 32] = b
    for a, b in also.items():
        out[ord(a)] = ord(b)
    return bytes(out)


_PLAIN = _byte_table({})
#: Signs that stand in for letters, fixed.
_VEILED = _byte_table({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
_SIGNS = frozenset(b"013457$@!")

#: Findings in all, kinds of findings, and findings per word (with two findings at least) that fire a voter.
TOTALS, KINDS, RATES = (2, 3, 6), (2, 3), (0.003, 0.006, 0.010, 0.014, 0.020, 0.040)
#: Findings of one lexicon entry per word that fire its voter.
OWN_RATE = 0.001
MORE = ("veiled", "addressed")
N_PATTERNS = len(TOTALS) + len(KINDS) + len(RATES) + len(MORE)
#: Of address, fixed.
_YOU = frozenset(w.encode() for w in ("you", "your", "yours", "ur", "du", "dich", "dein", "tu", "toi", "vous", "usted", "eres"))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Lexicon:
    """Whole words and stems (which stand for every word that begins with them)."""

    def __init__(self, words: list[bytes], stems: list[bytes]):
        self.entries = [*words, *stems]
        self.words = {w: i for i, w in enumerate(words)}
        self.stems = {w: len(words) + i for i, w in enumerate(stems)}
        self.sizes = sorted({len(w) for w in stems}, reverse=True)
        self.heads = {w[:3] for w in self.entries}

    def __len__(self) -> int:
        return len(self.entries)

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(position, entry) of the words found."""
        heads, out = self.heads, []
        for i, w in enumerate(words):
            if w[:3] in heads:
                k = self.words.get(w)
                if k is None:
                    k = next((self.stems[w[:n]] for n in self.sizes if w[:n] in self.stems), None)
                if k is not None:
                    out.append((i, k))
        return out


def measure(text: bytes, lexicon: Lexicon) -> tuple[np.ndarray, int, int, int, int]:
    """Findings by entry, in all, veiled ones, ones near a word of address; number of words."""
    words = words_of(text)
    found = lexicon.find(words)
    own = np.bincount([k for _, k in found], minlength=len(lexicon))
    near = sum(any(x in _YOU for x in words[max(0, i - 3) : i + 4]) for i, _ in found)
    veiled = 0
    if any(s in text for s in _SIGNS):
        veiled = max(0, len(lexicon.find(text.translate(_VEILED).split())) - len(found))
    return own, len(found) + veiled, veiled, near, len(words)


def votes_of(measured: tuple[np.ndarray, int, int, int, int]) -> np.ndarray:
    """Which voters fire: the lexicon's entries, then the patterns."""
    own, total, veiled, near, n = measured
    rate = total / max(n, 1)
    patterns = [
        *(total >= t for t in TOTALS),
        *(np.count_nonzero(own) >= k for k in KINDS),
        *(total >= 2 and rate >= r for r in RATES),
        veiled > 0,
        near > 0,
    ]
    return np.concatenate([own > OWN_RATE * n, patterns])


def votes(text: bytes, lexicon: Lexicon) -> np.ndarray:
    return votes_of(measure(text, lexicon))


def induce_stems(rows: list[list[bytes]], toxic: np.ndarray) -> list[bytes]:
    """Beginnings of words that are many times as dense in toxic rows as in others.

    Near copies of one text would vouch for every word in it, so support counts distinct rows by the
    least hash of their words, which near copies share. Of beginnings that stand for nearly the same
    words the longest is taken.
    """
    kinds = [min((hash_word(w) for w in set(ws)), default=0) for ws in rows]
    same = Counter(kinds)
    weight = np.array([1 / same[k] for k in kinds])
    size = [weight[~toxic].sum(), weight[toxic].sum()]
    least = max(6, 0.03 * size[1])

    def collect(of: bool, only: set[str] | None) -> tuple[dict[str, float], dict[str, set[int]]]:
        """Density and support of beginnings over the rows of one label."""
        dense: dict[str, float] = defaultdict(float)
        support: dict[str, set[int]] = defaultdict(set)
        for ws, y, k, own in zip(rows, toxic, kinds, weight, strict=True):
            if bool(y) != of:
                continue
            heads = Counter()
            for w, n in Counter(ws).items():
                t = w.decode("utf-8", "replace")
                for m in range(3, min(len(t), 12) + 1):
                    if only is None or t[:m] in only:
                        heads[t[:m]] += n
            for h, n in heads.items():
                dense[h] += own * n / len(ws)
                support[h].add(k)
        return dense, support

    # toxic rows name the candidates; the many other rows are then asked for those only
    dense1, support1 = collect(True, None)
    candidates = {h for h, s in support1.items() if len(s) >= least and dense1[h] / size[1] > 2e-4}
    dense0, support0 = collect(False, candidates)
    good = {
        h: dense1[h]
        for h in candidates
        if len(support1[h]) / size[1] > 5 * len(support0.get(h, ())) / size[0]
        and dense1[h] / size[1] > 8 * dense0.get(h, 0.0) / size[0]
    }
    longer: dict[str, float] = defaultdict(float)
    for h, d in good.items():
        longer[h[:-1]] = max(longer[h[:-1]], d)
    kept = [h for h, d in good.items() if longer.get(h, 0.0) < 0.9 * d]
    kept = [h for h in kept if not any(h[:m] in set(kept) for m in range(3, len(h)))]
    return [h.encode() for h in sorted(kept, key=lambda h: (-good[h], h))[:INDUCED]]


def hash_word(word: bytes) -> int:
    h = 1469598103934665603
    for b in word:
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 29)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


@dataclass
class LabelModel:
    """A hidden class with a firing rate per voter and class; correlated voters share weight."""

    prior: float = 0.1
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def log_odds(self, fired: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0])
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        return np.log(self.prior / (1 - self.prior)) + np.where(fired, on, off) @ self.weight

    def fit(self, fired: np.ndarray, start: np.ndarray, rounds: int = 20) -> np.ndarray:
        """Returns the posterior of each row; ``start`` is where it begins. The last voter is the given
        label: it keeps its whole weight, and its accuracy is held within LABEL_ERROR."""
        post, n = start.astype(float), len(fired)
        x = fired.astype(float)
        for _ in range(rounds):
            self.prior = float(np.clip(post.mean(), 0.005, 0.995))
            n1 = post.sum()
            self.rates = np.stack([((1 - post) @ x + 0.1) / (n - n1 + 1), (post @ x + 0.1) / (n1 + 1)])
            self.rates[:, -1] = np.clip(self.rates[:, -1], LABEL_ERROR, 1 - LABEL_ERROR)
            left = x - np.outer(post, self.rates[1]) - np.outer(1 - post, self.rates[0])
            scale = left.std(0) + 1e-6
            self.correlation = (left - left.mean(0)).T @ (left - left.mean(0)) / n / np.outer(scale, scale)
            alike = np.abs(self.correlation) - np.eye(x.shape[1])
            self.weight = 1 / (1 + np.where(alike > CORRELATED, alike, 0).sum(1))
            self.weight[-1] = 1.0
            post = 1 / (1 + np.exp(-np.clip(self.log_odds(fired), -30, 30)))
        return post


def features(text: bytes, lexicon: Lexicon) -> np.ndarray:
    """Inputs of the classifier: the votes, and two measures of how much there is."""
    measured = measure(text, lexicon)
    _, total, _, _, n = measured
    return np.concatenate([votes_of(measured), [np.log1p(total), min(1.0, 20 * total / max(n, 1))]]).astype(float)


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 2.0, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the bias comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, own = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    own[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(own), x.T @ (target - p) - own * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    label_model: LabelModel | None = None

    def score(self, text: bytes) -> float:
        z = self.weights[0] + features(text, self.lexicon) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], toxic: np.ndarray) -> ToxicityModel:
    toxic = np.asarray(toxic, float) >= 0.5
    seeds = [w.encode() for w in SEEDS]
    if toxic.sum() < 5 or (~toxic).sum() < 5:
        lexicon = Lexicon(seeds, [])
        weights = np.zeros(1 + len(lexicon) + N_PATTERNS + 2)
        weights[0], weights[1 + len(lexicon)] = FALLBACK
        return ToxicityModel(lexicon, weights)
    rows = [words_of(t) for t in texts]
    known = set(seeds)
    lexicon = Lexicon(seeds, [s for s in induce_stems(rows, toxic) if s not in known])
    seen = np.stack([np.append(votes(t, lexicon), y) for t, y in zip(texts, toxic, strict=True)])
    model = LabelModel()
    post = model.fit(seen, np.where(toxic, 0.9, 0.05))
    return ToxicityModel(lexicon, fit_linear(np.stack([features(t, lexicon) for t in texts]), post), model)


def training_sample(documents: DataFrame, labels: DataFrame, *, id_col: str, text_col: str) -> pd.DataFrame:
    """At most SAMPLE_ROWS labelled rows of the training folds (text, toxic): the first, by a hash of the
    id, whose document exists and is short enough.

    Hashes are bounded, so that a few times as many labels as are wanted are looked up; where too few of
    these have a document, the bound is raised.
    """
    order = F.xxhash64(F.col("key"), F.lit(17))
    text = text_of(documents, text_col)
    docs = documents.select(documents[id_col].cast("string").alias("key"), text.alias("text")).where(
        F.char_length("text") <= SAMPLE_CHARS
    )
    known = labels.select(labels["doc_id"].cast("string").alias("key"), labels["toxic"].cast("double").alias("toxic"))
    known = known.where("key is not null and toxic is not null").where(crc_mod5(F.col("key")) != 0)
    total = labels.count()
    share = 1.0 if total <= 8 * SAMPLE_ROWS else 4 * SAMPLE_ROWS / total
    while True:
        marked = known if share >= 1 else known.where(order <= F.lit(int(-(2**63) + 2**64 * share)))
        marked = marked.groupBy("key").agg(F.avg("toxic").alias("toxic"))
        # by the hash that many labels at most, about; where more are asked, the join is left to the engine
        few = F.broadcast(marked) if share * total <= 64 * SAMPLE_ROWS else marked
        rows = docs.join(few, "key").orderBy(order, "key", "text").limit(SAMPLE_ROWS).select("text", "toxic").toPandas()
        if len(rows) >= SAMPLE_ROWS or share >= 1:
            return rows
        share = min(1.0, 8 * share)


def score_toxicity(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the kept columns, held_out, score and predicted for every row of ``documents``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = training_sample(documents, labels, id_col=id_col, text_col=text_col)
    model = spark.sparkContext.broadcast(train([t.encode() for t in rows["text"]], rows["toxic"].to_numpy()))
    slim = documents.select(
        documents[id_col].alias("doc_id"),
        *[documents[c] for c in keep],
        (crc_mod5(documents[id_col]) == 0).alias("held_out"),
        text_of(documents, text_col).cast("binary").alias("_text"),
    )
    names = slim.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in text_groups(batches, len(names)):
            scores = [m.score(t.as_py()) for t in batch.column(len(names))]
            more = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*names, "score", "predicted"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    return slim.mapInArrow(score, kept + "score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
