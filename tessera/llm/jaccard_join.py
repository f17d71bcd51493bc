"""N-gram Jaccard self-join by chosen paths.

A text is the set of its runs of ``N`` words (lower-cased, between white space; a shorter text is one
run of all its words), held as hashes. Texts of the same words form a class, and one text stands for
its class; the join links classes whose sets have a Jaccard similarity of ``threshold`` or more.

Search: the tokens of a set are sampled by min-hashing, so two sets share a sampled token with the
probability of their similarity. A run splits all sets on one sampled token; buckets of one are done,
buckets of up to ``LEAF`` sets are brute-forced, and larger ones are split on the next sampled token of
the run, up to ``DEPTH``. Runs are repeated until a pair at the threshold that is split every time is
found with probability ``RECALL`` (fewer splits, or a higher similarity, make it likelier). A bucket
that is still large after ``DEPTH`` tokens holds sets that are alike, and is kept whole.

Brute force: in a leaf all pairs are compared by sketches of ``SIGNATURE`` min-hashes, with a margin
that loses one pair at the threshold in ten thousand; those that may be similar connect. Each connected
component is then verified on its whole sets (32-bit hashes of the runs), every pair once: components of
up to ``SMALL`` sets in one task each, with every set sent once; larger ones in ``BLOCKS`` blocks, or as
many as blocks of ``BLOCK_SETS`` sets and ``BLOCK_HASHES`` hashes need, each pair of blocks in a task of
its own, with every set sent once for each block. So up to ``BLOCKS * BLOCK_SETS`` members the rows sent
grow in proportion to the members; beyond, a set is sent once for each ``BLOCK_SETS`` members, which is
what a task's bounded memory asks for, as every pair has to meet somewhere to be counted. A verified
block returns how many links each set has and a spanning forest of them, never pairs. There is no cap on
members, partners or candidates.

Result, one row per document: class_id (least doc_id of its class), class_size, n_links (other classes
that are similar to its own), group_id (least doc_id among documents connected by links or class),
group_size and kept (one document of each group: the one with the least doc_id).

Defined results: null texts are empty; texts without words form one class without links; repeated rows
are members of one class, of which one is kept; null ids come after all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches, join_back, shuffle_partitions, table, text_groups, text_of
from .components import connected_components

N, THRESHOLD, RECALL = 5, 0.8, 0.999
SIGNATURE, LEAF, DEPTH = 64, 128, 4
#: Members of a component that one task verifies; blocks of a larger one; sets and hashes of a block at most.
SMALL, BLOCKS, BLOCK_SETS, BLOCK_HASHES = 512, 4, 2048, 1 << 20
_ODD = np.random.default_rng(23).integers(0, 1 << 63, 64 + SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(threshold: float, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold that is split at every depth is found with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * _ODD[k]
    out += np.uint64(size)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """SIGNATURE minima under multiplications by odd numbers, as 32-bit integers."""
    best = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):  # bounded memory for long texts
        best = np.minimum(best, (hashes[at : at + 4096, None] * _ODD[64:]).min(0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def features(df: DataFrame, row: Column, ident: Column, text: Column, n: int = N) -> DataFrame:
    """row, doc_id, key (128 bits of the words), size, mins and the set's hashes of every row."""
    slim = df.select(row.cast("long").alias("row"), ident.alias("doc_id"), text.alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, 2):
            key, size, mins, sets = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                own = shingles(words, n)
                key.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace")))
                size.append(len(own))
                mins.append(min_hashes(own) if len(own) else None)
                sets.append((own >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column(0),
                    "doc_id": batch.column(1),
                    "key": pa.array(key, pa.binary()),
                    "size": pa.array(size, pa.int32()),
                    "mins": pa.array(mins, pa.list_(pa.int32())),
                    "hashes": pa.array(sets, pa.binary()),
                }
            )

    return slim.mapInArrow(run, f"row long, doc_id {kind}, key binary, size int, mins array<int>, hashes binary")


def choose_paths(sets: DataFrame, scratch: Scratch, *, threshold: float, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(path, row) of leaves, and (path, row) of buckets that are large at the last depth."""
    token = lambda run, level: (run * 5 + level * 11) % SIGNATURE  # noqa: E731  distinct within a run
    n_runs = runs_for(threshold, depth=depth)
    slim = sets.select("row", "mins")
    first = F.array(*[F.xxhash64(F.lit(r), F.col("mins")[token(r, 0)]) for r in range(n_runs)])
    rows = slim.select("row", F.posexplode(first).alias("run", "path"))
    leaves: DataFrame | None = None
    for level in range(1, depth + 1):
        counts = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        known = scratch.write(join_back(rows, counts, ["path"], "inner").select("run", "path", "row", "n"))
        small = known.where(F.col("n") <= leaf).select("path", "row")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = known.where(F.col("n") > leaf)
        if level == depth or large.isEmpty():
            return leaves, large.select("path", "row")
        at = (F.col("run") * 5 + F.lit(level * 11)) % SIGNATURE
        rows = large.join(slim, "row").select("row", "run", F.xxhash64("path", F.get("mins", at)).alias("path"))
    raise AssertionError


class Forest:
    """Union of integers, least first."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.find(a) for a in nodes]


def least_agreement(threshold: float) -> int:
    """Sketch positions that must agree: four standard deviations under what the threshold makes likely."""
    return max(1, math.floor(SIGNATURE * threshold - 4 * math.sqrt(SIGNATURE * threshold * (1 - threshold))))


def connect_leaves(leaves: DataFrame, sets: DataFrame, *, threshold: float, partitions: int) -> DataFrame:
    """(u, v): a forest, for each task, of the pairs in leaves whose sketches may be similar."""
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def compare(paths: np.ndarray, rows: np.ndarray, sketch: np.ndarray) -> None:
            for k in range(1, len(paths)):
                at = np.flatnonzero(paths[k:] == paths[:-k])  # the members of a path lie together
                if not len(at):
                    break
                for part in np.array_split(at, 1 + len(at) // 65536):
                    good = part[(sketch[part] == sketch[part + k]).sum(1) >= least]
                    for i in good.tolist():
                        forest.join(int(rows[i]), int(rows[i + k]))

        for batch in batches:
            now = [
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy(),
                batch.column(2).flatten().to_numpy().astype(np.uint8).reshape(-1, SIGNATURE),
            ]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))  # the last path may go on
            compare(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None:
            compare(*held)
        u, v = forest.edges()
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    dealt = (
        leaves.join(sets.select("row", "mins"), "row").select("path", "row", "mins")
        .repartition(partitions, "path").sortWithinPartitions("path")
    )
    return dealt.mapInArrow(run, "u long, v long")


def link_matrix(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    """Which sets are similar (the diagonal is empty); with ``split`` which of the sets before that position
    are similar to which of the others."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del values
    codes, owners = codes.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), sizes)
    shared = counts[codes] > 1
    column = (np.cumsum(counts > 1) - 1).astype(np.int32)
    owners, codes = owners[shared], column[codes[shared]]
    order = np.argsort(codes, kind="stable")
    owners, codes = owners[order], codes[order]
    del order, shared, column, counts
    width = max(64, min(8192, (8 << 20) // max(1, n)))
    cut = n if split is None else split
    both = np.zeros((cut, n if split is None else n - cut), np.float32)
    for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        lo, hi = np.searchsorted(codes, [at, at + width])
        dense = np.zeros((n, width), np.float32)
        dense[owners[lo:hi], codes[lo:hi] - at] = 1
        both += dense[:cut] @ (dense if split is None else dense[cut:]).T
    others, similar = sizes if split is None else sizes[cut:], np.zeros(both.shape, bool)
    for at in range(0, cut, 256):  # in strips, as what a comparison makes is large
        part = both[at : at + 256]
        similar[at : at + 256] = part >= (threshold - 1e-9) * (sizes[:cut][at : at + 256, None] + others[None, :] - part)
    if split is None:
        np.fill_diagonal(similar, False)
    return similar


def spread(links: np.ndarray, split: int | None = None) -> np.ndarray:
    """The least position of each position's component, of the links that ``link_matrix`` gives."""

    def least(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
        parts = [np.where(rows[at : at + 256], label[None, :], none).min(1, initial=none) for at in range(0, len(rows), 256)]
        return np.concatenate([np.zeros(0, np.int64), *parts])

    none = sum(links.shape)
    label = np.arange(len(links) if split is None else none)
    while True:
        found = least(links, label) if split is None else np.concatenate([least(links, label[split:]), least(links.T, label[:split])])
        new = np.minimum(label, found)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def deal(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, comp) to the rows that verification reads: task, comp, own block, whether that block is alone
    in the task, row and hashes."""
    # both sides grow with the corpus, so neither is ever broadcast
    sized = scratch.write(sets.select("row", "size", "hashes").hint("merge").join(members, "row"))
    n, hashes = F.count("*"), F.sum("size")
    parts = F.greatest(F.lit(BLOCKS), F.ceil(n / BLOCK_SETS), F.ceil(hashes / BLOCK_HASHES))
    parts = F.when((n <= SMALL) & (hashes <= BLOCK_HASHES), F.lit(1)).otherwise(parts)
    count = sized.groupBy("comp").agg(parts.cast("int").alias("blocks"))
    dealt = join_back(sized, count, ["comp"], "inner").withColumn("own", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    dealt = dealt.select("row", "comp", "hashes", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(
        F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        "comp", "own", (F.col("own") == F.col("other")).alias("alone"), "row", "hashes",
    )


def verify(members: DataFrame, sets: DataFrame, scratch: Scratch, *, threshold: float, partitions: int) -> DataFrame:
    """(row, comp) to (u, v, n): n links of u where v is null, and forest edges (u, v)."""
    dealt = deal(members, sets, scratch).repartition(partitions, "task").sortWithinPartitions("task", "comp", "own", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            rows = np.array([r[4] for r in held])
            blocks = np.array([r[2] for r in held])
            # a task across two blocks has none of its sets alone; its links within a block are found elsewhere
            split = None if held[0][3] else int((blocks == blocks[0]).sum())
            links = link_matrix([np.frombuffer(r[5], "<u4") for r in held], threshold, split)
            some = links.sum(1) if split is None else np.concatenate([links.sum(1), links.sum(0)])
            label = spread(links, split)
            a, b = np.flatnonzero(some), np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_pydict(
                {
                    "u": pa.array(np.concatenate([rows[a], rows[b]]), pa.int64()),
                    "v": pa.array([None] * len(a) + rows[label[b]].tolist(), pa.int64()),
                    "n": pa.array(np.concatenate([some[a], np.zeros(len(b), np.int64)]), pa.int64()),
                }
            )

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and (r[0], r[1]) != held[0][:2]:
                    yield done()
                    held = []
                held.append(r)
        if held:
            yield done()

    return dealt.mapInArrow(run, "u long, v long, n long")


def similarity_join(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    n: int = N,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, class_id, class_size, n_links, group_id, group_size, kept of every row, and its row number
    (from ``row_col``; numbers made here say nothing to another job that reads the same input)."""
    spark = df.sparkSession
    bounded_batches(spark)
    scratch, partitions = Scratch(spark, "join"), shuffle_partitions(spark)
    every = scratch.write(features(df, F.monotonically_increasing_id() if row_col is None else df[row_col], df[id_col], text_of(df, text_col), n))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = every.groupBy("key").agg(first.alias("first"), F.count("*").alias("class_size"))
    docs = join_back(every.select("row", "doc_id", "key"), classes, ["key"], "inner").select(
        "row", "doc_id", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("class_id"), "class_size"
    )
    docs = scratch.write(docs)
    reps = docs.where("row = rep").select("row")
    # the search reads sketches only; the sets themselves travel once, those of members of components
    sketches = scratch.write(every.where("size > 0").select("row", "mins").hint("merge").join(reps, "row"))
    leaves, large = choose_paths(sketches, scratch, threshold=threshold)
    stars = join_back(large, large.groupBy("path").agg(F.min("row").alias("v")), ["path"], "inner")
    near = connect_leaves(leaves, sketches, threshold=threshold, partitions=partitions)
    near = scratch.write(near.unionByName(stars.select(F.col("row").alias("u"), "v").where("u <> v")))
    members = connected_components(near, scratch).select(F.col("node").alias("row"), F.col("label").alias("comp"))
    found = scratch.write(verify(members, every, scratch, threshold=threshold, partitions=partitions))
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n_links"))
    groups = connected_components(found.where("v is not null").select("u", "v"), scratch)
    groups = groups.select(F.col("node").alias("rep"), F.col("label").alias("root"))
    docs = join_back(docs, links.join(groups, "rep", "left"), ["rep"], "left").withColumn("root", F.coalesce("root", "rep"))
    docs = scratch.write(docs)
    scratch.keep_only(docs)
    whole = docs.groupBy("root").agg(first.alias("first"), F.count("*").alias("group_size"))
    return join_back(docs, whole, ["root"], "inner").select(
        "doc_id",
        "class_id",
        "class_size",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("first.doc_id").alias("group_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "row",
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).drop("row")
