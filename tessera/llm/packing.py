"""Best-fit packing of documents into sequences, after a reduction by dominance.

A document's tokens and one end token make its length. Longer documents than a sequence are cut into
pieces of full length, of which the first may be shorter. Lengths are whole numbers up to the size of
a sequence, so the instance is a table of counts by length, however many documents there are: that
table (``size`` rows at most) is all the driver sees.

Reduction (Martello and Toth): a set of pieces that fills a sequence at least as well as any other
feasible set with its first piece dominates the others, and some best packing holds it. So it is fixed
for good and the instance shrinks: a piece to which nothing can be added stands alone, two pieces that
fill a sequence exactly stand together, and a piece that takes one more at most, or for which no pair
beats the best single piece, takes the largest that fits. What remains is packed best-fit, longest
pieces first, again on counts.

The plan is a list of runs: of the pieces of one length, the ranks from ``lo`` on go to consecutive
sequences at one offset. There are fewer than 64 * 2 * ``size`` runs whatever the input, so the plan is
broadcast. Ranks come from counters in the tasks that cut the documents plus offsets by task, so no
group, however common its length, meets in one place.

Defined results: null texts are empty and have length 1 (the end token); repeated rows are packed
each; an empty table gives no sequences. Runs of white space and words may be of any length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches, table, text_groups, text_of
from .bpe import SPLIT, Vocabulary, codec, default_vocabulary

SIZE = 2048
END_ID = 0
#: The encoder's pattern gives up on runs of white space of about a million characters; texts with runs
#: of this length go to the trie encoder instead.
LONG_BLANKS = re.compile(r"\s{100000}")

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary file as an encoder, one for each worker process."""
    if path not in _encodings:
        v = Vocabulary(path)
        _encodings[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=v.id_of, special_tokens=v.special)
    return _encodings[path]


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text of any length, without the end."""
    if len(text) >= 100_000 and LONG_BLANKS.search(text):
        raw, _ = next(codec(path).encode_group([text]))
        return np.frombuffer(raw, "<u4")
    return encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full ones but for the first."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


class Plan:
    """Runs by length: ranks lo.. go to sequence first + (rank - lo) // per, at offset + (rank - lo) % per * length."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0

    def place(self, length: int, n: int, first: int, offset: int, per: int = 1) -> None:
        self.runs[length].append((self.used[length], first, offset, per))
        self.used[length] += n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces of one length by rank."""
        runs = np.array(self.runs[length], np.int64).reshape(-1, 4)
        lo, first, offset, per = runs[np.searchsorted(runs[:, 0], ranks, side="right") - 1].T
        return first + (ranks - lo) // per, offset + (ranks - lo) % per * length


def reduce_by_dominance(counts: dict[int, int], size: int, plan: Plan) -> dict[int, int]:
    """Fix dominating sets in ``plan`` and return what is left of the counts."""
    left = {k: n for k, n in counts.items() if n}
    changed = True
    while changed and left:
        changed = False
        for length in sorted(left, reverse=True):
            n = left.get(length, 0)
            if not n:
                continue
            room, small = size - length, min(left)
            if small > room or (small == length and n == 1 and len(left) == 1):  # nothing can be added
                plan.place(length, n, plan.open(n), 0)
                del left[length]
                changed = True
                continue
            partner = room if room in left else None  # an exact fill dominates
            if partner is None and 3 * small > room:  # two more pieces at most
                others = sorted(k for k in left if k <= room and (k != length or n > 1))
                if others:
                    single = others[-1]
                    pair, hi = 0, len(others) - 1
                    for a in others:
                        while hi >= 0 and others[hi] + a > room:
                            hi -= 1
                        if hi < 0:
                            break
                        b = others[hi]
                        if a != b or left[a] - (a == length) > 1:
                            pair = max(pair, a + b)
                        elif hi and a + others[hi - 1] <= room:
                            pair = max(pair, a + others[hi - 1])
                    if single >= pair:
                        partner = single
            if partner is None:
                continue
            pairs = n // 2 if partner == length else min(n, left[partner])
            if not pairs:
                continue
            first = plan.open(pairs)
            plan.place(length, pairs, first, 0)
            plan.place(partner, pairs, first, length)
            for k in (length, partner):
                left[k] -= pairs
            for k in {length, partner}:
                if not left[k]:
                    del left[k]
            changed = True
    return left


def best_fit(counts: dict[int, int], size: int, plan: Plan) -> None:
    """Best fit, longest first, on counts. Open sequences are ranges with equal contents, by room left."""
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if not ranges[room]:
                bisect.insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-todo // (size // length))
                add(size, plan.open(n), n)
                continue
            room = rooms[at]
            first, n = ranges[room].pop()
            if not ranges[room]:
                rooms.pop(at)
            per = room // length  # the tightest sequence stays the tightest while it takes more
            full = min(n, todo // per)
            if full:
                plan.place(length, full * per, first, size - room, per)
                add(room - per * length, first, full)
                todo -= full * per
            if full < n:
                rest = todo if todo < per else 0
                if rest:
                    plan.place(length, rest, first + full, size - room, rest)
                    add(room - rest * length, first + full, 1)
                    full, todo = full + 1, todo - rest
                add(room, first + full, n - full)


def plan_packing(counts: dict[int, int], size: int = SIZE) -> Plan:
    plan = Plan()
    best_fit(reduce_by_dominance(counts, size, plan), size, plan)
    return plan


def least_sequences(counts: dict[int, int], size: int = SIZE) -> int:
    """A lower bound: what the lengths fill, or the pieces over half a sequence if they are more."""
    filled = -(-sum(k * n for k, n in counts.items()) // size)
    return max(filled, sum(n for k, n in counts.items() if 2 * k > size))


def pieces_of(df: DataFrame, *, id_col: str, text_col: str, size: int, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for ranks, the task and the rank within it."""
    slim = df.select(df[id_col].alias("doc_id"), text_of(df, text_col).alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in text_groups(batches, 1):
            rows, piece, start, length, crc, rank = ([] for _ in range(6))
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text, path), np.uint32(END_ID))
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].astype("<u4").tobytes()))
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array(rows, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "task": pa.array([task] * len(rows), pa.int32()),
                    "rank": pa.array(rank, pa.int64()),
                }
            )

    return slim.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )


def pack(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    bounded_batches(spark)
    pieces = Scratch(spark, "pieces").write(
        pieces_of(df, id_col=id_col, text_col=text_col, size=size, path=path or default_vocabulary())
    )
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_packing(counts, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(starts, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                sequence[own], offset[own] = plan.value.find(int(n), ranks[own])
            names = [*batch.schema.names[:5], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=names)

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
