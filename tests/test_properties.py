"""Random frames: round trips and brute force."""

import random
from collections import Counter, defaultdict

import pytest

from tessera.functions import aggs as A
from tessera.functions import selectors as S
from tessera.operators import grouping as G
from tessera.operators import reshape as R
from tessera.operators import verbs as V


def counted(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("seed", range(3))
def test_spread_and_gather_undo_each_other(spark, seed):
    rng = random.Random(seed)
    cells = {(i, k): rng.choice([None, *range(9)]) for i in range(8) for k in "xyz" if rng.random() < 0.8}
    df = spark.createDataFrame([(i, k, v) for (i, k), v in cells.items()], "id int, k string, v int")
    wide = R.spread(df, "k", "v")
    back = R.gather(wide, "k", "v", ~S.one_of("id"))
    want = Counter((i, k, cells.get((i, k))) for i in {i for i, _ in cells} for k in {k for _, k in cells})
    assert counted(back, "id", "k", "v") == want


@pytest.mark.parametrize("seed", range(3))
def test_nesting_undone(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b"]), rng.randint(0, 3), rng.choice([None, 1.5])) for _ in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    assert counted(R.unnest(R.nest(G.group_by(df, "k")), "data"), "k", "i", "x") == Counter(rows)
    assert counted(R.unnest(R.nest(G.group_by(df, "k", "i")), "data"), "k", "i", "x") == Counter(rows)


@pytest.mark.parametrize("seed", range(3))
def test_united_parts_come_apart(spark, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), rng.randint(0, 99)) for _ in range(30)]
    df = spark.createDataFrame(rows, "a string, b int")
    again = R.separate(R.unite(df, "ab", ["a", "b"], sep=":"), "ab", ["a", "b"], sep=":", convert=True)
    assert counted(again, "a", "b") == Counter(rows)


@pytest.mark.parametrize("seed", range(3))
def test_summaries_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(6)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, v int")
    out = G.summarize(G.group_by(df, "k"), n=A.n(), na=A.n_na("v"), s=A.total("v", True), m=A.median("v", True), sd=A.sd("v", True), lo=A.minimum("v", True))
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    for r in out.collect():
        have = [v for v in groups[r["k"]] if v is not None]
        assert (r["n"], r["na"], r["s"]) == (len(groups[r["k"]]), len(groups[r["k"]]) - len(have), sum(have))
        assert r["m"] == (A.list_median(have) if have else None) and r["lo"] == (min(have) if have else None)
        assert r["sd"] == (pytest.approx(A.list_sd(have)) if len(have) > 1 else None)


@pytest.mark.parametrize("seed", range(3))
def test_completed_frames_hold_every_pair(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randint(0, 4), rng.choice("uvw")) for _ in range(8)}
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a int, b string, i int")
    full = R.complete(df, "a", "b")
    assert full.count() == len({a for a, _ in pairs}) * len({b for _, b in pairs})
    assert V.filter_not_null(full).count() == len(pairs)
