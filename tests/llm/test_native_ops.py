"""Exact deduplication, chat formatting, fingerprints, URL filter."""

import hashlib
import os
import random
import time
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format as C
from tessera.llm import exact_dedup as D
from tessera.llm import fingerprints as P
from tessera.llm import url_filter as U

WHITE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("block", [7, 4096])
def test_dedup_against_a_dict(edge_docs, edge_rows, block):
    got = D.duplicates(edge_docs, block_bytes=block).collect()
    groups = defaultdict(list)
    for i, t in edge_rows:
        groups[WHITE.sub(" ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = (min(known) if known else None), hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), sha) for i in ids]
    key = lambda r: (str(r[0]), r[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_dedup_of_nothing(no_docs):
    assert D.duplicates(no_docs).count() == 0


LOG = [
    # conversation, turn, message, sequence, role, kind, text
    (1, 0, 0, 0, "user", "delta", "Hel"), (1, 0, 0, 1, "user", "delta", "lo"),
    (1, 1, 0, 2, "assistant", "delta", "bad"), (1, 1, 0, 3, "assistant", "regenerate", None),
    (1, 1, 0, 5, "assistant", "delta", " there"), (1, 1, 0, 4, "assistant", "delta", "Hi"),
    (1, 2, 0, 6, "user", "delta", "tyop"), (1, 2, 0, 7, "user", "edit", "typo"), (1, 2, 0, 8, "user", "delta", "!"),
    (1, 3, 0, 9, "assistant", "delta", "gone"), (1, 3, 0, 10, "assistant", "delete", None),
    (2, 0, 0, 0, None, "delta", None), (None, 0, 0, 0, "a:b\\", "delta", "\\### x: </turn>\n<\\/turn> \\\\ ####"),
    (3, 0, 0, 0, "user", "delete", None),
]


def test_folding_and_round_trip(spark):
    log = spark.createDataFrame(LOG, "conv_id long, turn long, msg int, seq int, role string, kind string, text string")
    out = C.format_chats(log.withColumn("out", F.lit(1)))
    rows = {r.conv_id: r for r in out.withColumn("turns", C.read_back(F.col("formatted"))).collect()}
    read = {k: [tuple(t) for t in r.turns] for k, r in rows.items()}
    assert read[1] == [("user", "Hello"), ("assistant", "Hi there"), ("user", "typo!")]
    assert read[2] == [("", "")]
    assert read[None] == [("a:b\\", LOG[-2][6])]
    assert 3 not in read and rows[None].formatted.count("</turn>") == 1


def _folded(events):
    """What a log of one conversation comes to, by a loop."""
    out = {}
    for turn, msg, seq, role, kind, text in sorted(events, key=lambda e: (e[0], e[1], e[2], e[4], e[5] is not None, e[5] or "")):
        said, first, _ = out.get((turn, msg), ("", role, ""))
        said = {"delta": said + (text or ""), "edit": text or "", "regenerate": "", "delete": ""}[kind]
        out[turn, msg] = (said, first, kind)
    return [(r, t) for _, (t, r, k) in sorted(out.items()) if k != "delete"]


def test_logs_against_a_loop(spark):
    """Edits, regenerations, equal sequence numbers, repeated events, long texts; the mask covers the trained role's texts."""
    rng, logs = random.Random(21), {}
    for conv in range(40):
        logs[conv] = [
            (t, rng.randint(1, 2), rng.randint(1, 4), "assistant" if t % 2 else "user", rng.choice(["delta", "delta", "delta", "edit", "regenerate"]),
             rng.choice([None, "", "a</turn>\\", "### x: ", "ünï 😀 #", "\n"])) for t in range(6) for _ in range(rng.randint(0, 6))
        ]
        logs[conv] += logs[conv][:2]
    logs[99] = [(0, 1, 1, "user", "delta", "long " * 60_000), (1, 1, 1, "assistant", "delta", "😀#" * 50_000), (1, 1, 2, "assistant", "delta", "</turn>"), (2, 1, 1, "user", "delete", None), (3, 1, 1, "assistant", "edit", "end")]
    rows = [(c, *e) for c, es in logs.items() for e in es]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, turn int, msg int, seq int, role string, kind string, text string").repartition(5)
    out = C.format_chats(log).withColumn("turns", C.read_back(F.col("formatted"))).withColumn("loss", C.under_mask(F.col("formatted"), F.col("loss_mask")))
    got = {r.conv_id: r for r in out.collect()}
    for conv, events in logs.items():
        want = _folded(events)
        if not want:
            assert conv not in got
            continue
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss == [t for r, t in want if r == "assistant"]
        marked = [got[conv].formatted[m.start : m.start + m.length] for m in got[conv].loss_mask]
        assert [re.sub(r"(?s)\\(.)", r"\1", m) for m in marked] == got[conv].loss


def test_turns_come_back_from_their_log(spark):
    turns = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("user", "hi"), ("assistant", f"text {c} 😀 </turn> done"), ("user", None), ("assistant", "")])]
    turns += [(1, 1, "assistant", "a repeated turn"), (1, 1, "assistant", "a repeated turn")]
    log = C._as_log(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in C.fold_events(log).collect())
    assert got == sorted((c, t, r, x or "") for c, t, r, x in turns)


def test_any_text_survives(spark):
    rng = random.Random(1)
    pieces = ["\\", "#", "###", "</turn>", "<\\/turn>", ":", ": ", "\n", "a", "</turn", "### user: ", "é😀"]
    rows = [(i, j, 0, 0, rng.choice(pieces), "delta", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(60) for j in range(3)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, msg int, seq int, role string, kind string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in C.format_chats(log).withColumn("turns", C.read_back(F.col("formatted"))).collect()}
    assert got == {i: [(r[4], r[6]) for r in rows[3 * i : 3 * i + 3]] for i in range(60)}
    assert C.format_chats(log.where("false")).count() == 0


PARTS = re.compile(P.PARAGRAPH)


def _units(t):
    return {p for p in PARTS.split(t) if p}


def test_fingerprints_against_sets(spark, edge_docs, edge_rows, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op9_fingerprints(spark, str(tmp_path)).collect()
    docs = sorted(((i, t or "") for i, t in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(_units(t), _units(edited)), 9), round(like(_units(t), _units(nxt)), 9)))
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    prints = defaultdict(set)
    by_id = defaultdict(list)
    for i, t in edge_rows:
        by_id[i].append(t or "")
    for r in got:
        if len(by_id[r.doc_id]) == 1:
            prints[by_id[r.doc_id][0]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_peeling_recovers_digests(spark):
    rng = random.Random(7)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(42)]
    a, b = keys[:39], keys[4:]
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    found = df.select(P.peel(P.subtract(P.sketch(F.col("a")), P.sketch(F.col("b")))).alias("d"), P.differing(F.col("a"), F.col("b")).alias("n")).first()
    assert {(x.key, x.n) for x in found.d} == {(k, 1) for k in keys[:4]} | {(k, -1) for k in keys[39:]}
    assert found.n == 7
    far = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
    far = spark.createDataFrame([(far[:200], far[200:])], "a array<bigint>, b array<bigint>")
    row = far.select(P.peel(P.subtract(P.sketch(F.col("a")), P.sketch(F.col("b")))).alias("d"), P.differing(F.col("a"), F.col("b")).alias("n")).first()
    assert row.d is None and row.n == 400


def test_fingerprints_of_one_long_paragraph(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(600))) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op9_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r.near_edited > 0.15 and r.near_next == 0 for r in got)  # half is kept


@pytest.mark.parametrize("kind", ["text", "one id", "no id", "2000 partitions"])
def test_fingerprints_of_any_ids(spark, tmp_path, kind):
    rng = random.Random(14)
    ids = {"text": lambda i: f"d{i:03}", "one id": lambda i: 7, "no id": lambda i: None}.get(kind, lambda i: i)
    texts = [" ".join(f"w{rng.randrange(500)}" + "." * (k % 4 == 3) for k in range(rng.randint(0, 40))) for _ in range(120)]
    rows = [(ids(i), t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, f"doc_id {'string' if kind == 'text' else 'long'}, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000" if kind[0] == "2" else "8")
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        ranges = P.with_next(docs)[0].where("not guest").groupBy("range").count().collect()
        assert len(ranges) > 20 and max(r["count"] for r in ranges) < 20
        got = P.op9_fingerprints(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]), reverse=True)
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_fingerprints_of_little(spark, tmp_path):
    one = spark.createDataFrame([(5, "Only one. Here.")], "doc_id long, text string")
    one.write.parquet(str(tmp_path / "one" / "documents.parquet"))
    row = P.op9_fingerprints(spark, str(tmp_path / "one")).first()
    assert row.near_next == 1.0
    one.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.op9_fingerprints(spark, str(tmp_path / "none")).count() == 0


def test_url_filter(spark):
    urls = [
        ("http://a.example.org/es/x", "example.org/es/", "block"), ("https://EXAMPLE.org/en/1", "example.org/en/1", "block"),
        ("https://example.org/en/17?q#f", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"), ("http://org/", "org/", "allow"),
        ("http://x.com/fr/1", "com/fr/", "allow"), ("http://x.com/de/", "com/de/", "block"), ("http://x.com/de", None, "allow"), ("http://example.org", None, "allow"),
        ("http://badexample.org/es/", "org/", "allow"), (None, None, "allow"), ("no url", None, "allow"), ("", None, "allow"), ("http://x.com?/fr/", None, "allow"),
        ("http://example.org:80/es/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)], "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"))
    got = {r.page_id: r for r in U.filter_urls(df, U.RULES, keep=["page_id"]).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [(r, v) for _, r, v in urls]
    assert (got[2].host, got[2].path) == ("example.org", "/en/17") and (got[10].host, got[10].path) == ("", "")
    assert U.filter_urls(df.where("false"), U.RULES, keep=["page_id"]).count() == 0


def test_trie_against_all_rules():
    rng = random.Random(3)
    hosts = ["a.b", "b", "x.a.b", "c", "a.c"]
    paths = ["/", "/p", "/p/", "/p/q", "/p/qr", "/q/"]
    rules = [U.Rule(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.5]
    trie = U.UrlTrie(rules)
    for h in [*hosts, "y.x.a.b", "ab"]:
        for p in ["", "/", "/p", "/pp", "/p/", "/p/q", "/p/q/", "/p/qrs", "/q", "/q/1", "p"]:
            fit = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
            best = max(fit, key=lambda r: (len(r.text), r.verdict == "block"), default=None)
            assert trie.find(h, p) == ((best.text, best.verdict) if best else None), (h, p)


def test_long_segments_take_no_longer():
    trie = U.UrlTrie([*U.RULES, U.Rule("block", "example.org", "/x/yy")])
    began = time.perf_counter()
    assert trie.find("example.org", "/en/" + "1" * 1_000_000) == ("example.org/en/1", "block")
    assert trie.find("example.org", "/" + "x" * 1_000_000) == ("org/", "allow")
    assert trie.find("a." * 1000 + "org", "/x" * 500_000) == ("org/", "allow")
    assert time.perf_counter() - began < 0.5


def test_many_rules_take_several_tries(spark, monkeypatch):
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.org", "b.a.org", "c.com") for p in ("/", "/p/1", "/q/", "/p"))]
    rules = [U.Rule("allow", "org", "/"), U.Rule("block", "a.org", "/p"), U.Rule("allow", "b.a.org", "/p/"), U.Rule("block", "c.com", "/q"), U.Rule("allow", "a.org", "/p")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    want = sorted(map(tuple, U.filter_urls(df, rules, keep=["page_id"]).collect()))
    monkeypatch.setattr(U, "TRIE_RULES", 2)
    assert sorted(map(tuple, U.filter_urls(df, rules, keep=["page_id"]).collect())) == want
    assert {r[3] for r in want} == {None, "org/", "a.org/p", "b.a.org/p/", "c.com/q"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_registered_sql(spark):
    import glob

    import duckdb

    from tessera.llm.registry import ORACLES, QUERIES

    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, d), db.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        at = [want.columns.index(n) for n in names]
        assert sorted([str(tuple(r[n] for n in names)) for r in got.collect()]) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
