"""BPE, packing, toxicity, personal data, language model, n-gram join, pipeline."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe as B
from tessera.llm import jaccard_join as J
from tessera.llm import language_model as L
from tessera.llm import packing as K
from tessera.llm import pii as P
from tessera.llm import toxicity as T
from tessera.llm.components import connected_components
from tessera.llm._util import Scratch

from .conftest import prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_vocabulary())


# ------------------------------------------------------------ BPE


def test_bpe_against_the_library(library):
    rng = random.Random(1)
    signs = " \t\n\r\x0b\x1c\x85\xa0'sredvmtlaaaeeeAB09!?.,-_<|>éèüß中文😀٣Ⅷ²​́="
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 2000 + "x", "=-" * 300, "foo<|endoftext|> bar<|endoftext|>", "  <|endoftext|>  x", "don't I'LL we've", ""]
    codec = B.TextCodec(B.default_vocabulary())
    for text, (raw, decoded), want in zip(texts, codec.encode_group(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == want.ids, text
        assert decoded.decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)


def test_trie_equals_merging():
    rng = random.Random(2)
    trie = B.TrieEncoder(B.Vocabulary(B.default_vocabulary()))
    words = list({"".join(rng.choice("aeibtrns ") for _ in range(rng.randint(1, 14))).encode() for _ in range(2000)})
    for word, ids in trie.encode_words(words):
        assert ids == trie.merge(word)


def test_encoding_of_edges(edge_docs, edge_rows, no_docs, library):
    got = B.encode_texts(edge_docs).collect()
    want = Counter()
    for i, t in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert B.encode_texts(no_docs).count() == 0


# ------------------------------------------------------------ packing


def _checked(counts, size):
    plan, held = K.plan_packing(counts, size), defaultdict(list)
    for length, n in counts.items():
        assert plan.used[length] == n
        for s, o in zip(*plan.find(length, np.arange(n)), strict=True):
            held[s].append((int(o), length))
    for parts in held.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= size
    assert len(held) == plan.sequences
    return plan


def _fewest(lengths, size):
    """Fewest sequences by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[k]:
                go(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, size - lengths[k]])

    go(0, [])
    return best[0]


def test_plans_are_feasible_and_near_the_bound():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([10, 50, 128])
        counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        assert _checked(counts, size).sequences >= K.least_sequences(counts, size)


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(2, 12) for _ in range(rng.randint(1, 9))]
        plan = K.Plan()
        left = K.reduce_by_dominance(dict(Counter(lengths)), 12, plan)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert plan.sequences + (_fewest(rest, 12) if rest else 0) == _fewest(lengths, 12), lengths


def test_cut():
    assert K.cut(5, 2048) == [(0, 5)] and K.cut(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert K.cut(4100, 2048) == [(0, 4), (4, 2048), (2052, 2048)]


def test_packing_of_edges(edge_docs, edge_rows, no_docs, library):
    got = K.pack(edge_docs).collect()
    want = Counter()
    for i, t in edge_rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(K.cut(len(ids), K.SIZE)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= K.SIZE
    assert len(held) <= K.least_sequences(Counter(r.length for r in got)) + 1
    assert K.pack(no_docs).count() == 0


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 1_200_000, " \t\n" * 400_000, "\u3000 " * 100_000])
def test_long_white_space(library, run):
    text = "a word" + run + "next ones"
    ids = K.encode(text, B.default_vocabulary())
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------ toxicity


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(700):
        words = prose(rng, rng.randint(40, 120)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vrogna", "vrogni", "moron", "Idiot,"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad) if rng.random() > 0.02 else 1 - int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(docs, labels).collect()}
    out = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    assert sum(got[i].predicted == (i % 6 == 0) for i in out) >= 0.98 * len(out)
    # labels of the held-out part have no say
    other = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    again = {r.doc_id: r.score for r in T.score_toxicity(docs, other).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_of_edges(edge_docs, edge_rows, no_docs, labels):
    rows = T.score_toxicity(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert T.score_toxicity(no_docs, labels).count() == 0
    assert T.score_toxicity(edge_docs, labels.where("false")).count() == len(edge_rows)


def test_labels_without_documents_take_no_place(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_ROWS", 50)
    docs = spark.range(20_000, 20_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    marks = spark.range(20_300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    rows = T.training_sample(docs, marks, id_col="doc_id", text_col="text")
    fit = [r.doc_id for r in docs.where(T.crc_mod5(F.col("doc_id")) != 0).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))).limit(50).collect()]
    assert sorted(rows["text"]) == sorted(f"text {i}" for i in fit)
    assert all(int(t.split()[1]) % 2 == y for t, y in zip(rows["text"], rows["toxic"], strict=True))


def test_posterior_against_loops():
    """The last round of expectation maximisation, one row and voter at a time."""
    rng = np.random.default_rng(8)
    truth = rng.random(300) < 0.3
    fired = np.stack([np.where(truth, rng.random(300) < p, rng.random(300) < q) for p, q in ((0.8, 0.1), (0.7, 0.05), (0.6, 0.2), (0.9, 0.04))], 1)
    fired = np.hstack([fired[:, :1], fired])  # the first voter twice: these two are correlated
    start = np.where(fired[:, -1], 0.9, 0.05)
    before = T.LabelModel().fit(fired, start, rounds=6)
    model = T.LabelModel()
    got = model.fit(fired, start, rounds=7)
    n, k = fired.shape
    n1, rates = before.sum(), np.zeros((2, k))
    for v in range(k):
        rates[1, v] = (sum(p for p, f in zip(before, fired[:, v], strict=True) if f) + 0.1) / (n1 + 1)
        rates[0, v] = (sum(1 - p for p, f in zip(before, fired[:, v], strict=True) if f) + 0.1) / (n - n1 + 1)
    rates[:, -1] = np.clip(rates[:, -1], T.LABEL_ERROR, 1 - T.LABEL_ERROR)
    left = [[fired[i, v] - before[i] * rates[1, v] - (1 - before[i]) * rates[0, v] for v in range(k)] for i in range(n)]
    weight = []
    for v in range(k):
        others = [abs(np.corrcoef([r[v] for r in left], [r[u] for r in left])[0, 1]) for u in range(k) if u != v]
        weight.append(1 / (1 + sum(c for c in others if c > T.CORRELATED)))
    weight[-1] = 1.0
    assert weight[0] == pytest.approx(weight[1]) and weight[0] < 0.55
    for i in range(n):
        odds = np.log(before.mean() / (1 - before.mean()))
        for v in range(k):
            odds += weight[v] * np.log(rates[1, v] / rates[0, v] if fired[i, v] else (1 - rates[1, v]) / (1 - rates[0, v]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-4)


def test_label_model_outvotes_wrong_labels():
    rng = np.random.default_rng(1)
    truth = rng.random(800) < 0.3
    fired = np.stack([np.where(truth, rng.random(800) < hit, rng.random(800) < 0.02) for hit in (0.9, 0.8, 0.85)], 1)
    given = np.where(rng.random(800) < 0.1, ~truth, truth)
    model = T.LabelModel()
    post = model.fit(np.hstack([fired, given[:, None]]), np.where(given, 0.9, 0.05))
    assert ((post > 0.5) == truth).mean() > 0.985 and model.correlation.shape == (4, 4)


# ------------------------------------------------------------ personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _base(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("ab1.@-_+ 90()\n") for _ in range(rng.randint(0, 80)))
        assert P.base_spans(t) == _base(t), t
    for t in ("1" * 400, "+1" + " 2" * 40, "a@b.c.d_x@e.f.g@h.i", "a@b@c.d", "00255.1.1.1 0256.1.1.1"):
        assert P.base_spans(t) == _base(t), t


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(8)
    return P.train_tagger([prose(rng, 200) + f" +1 ({rng.randint(100, 999)}) 555-1234 x{k}@mail.example.com 10.0.0.{k}" for k in range(40)])


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    t = P.Tagger()
    t.p = {k: v.astype("f8") for k, v in t.p.items()}
    x, y = rng.integers(0, P.SYMBOLS, (9, 4)), rng.integers(0, 5, (9, 4))
    _, grads = t.loss(x, y)
    for k, v in t.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        if k[0] == "X":
            at = (int(x[3, 2]), 5)
        old = v[at]
        v[at] = old + 1e-4
        up = t.loss(x, y)[0]
        v[at] = old - 1e-4
        down = t.loss(x, y)[0]
        v[at] = old
        assert grads[k][at] == pytest.approx((up - down) / 2e-4, abs=1e-3), k


def test_decoding_against_all_paths(tagger):
    rng = np.random.default_rng(2)
    e = rng.normal(0, 2, (5, 30, 5)).astype("f4")
    e[:, :, 0] += 1
    import itertools

    for w in range(30):
        best = max(
            itertools.product(range(5), repeat=5),
            key=lambda p: sum(e[t, w, k] for t, k in enumerate(p)) + sum(tagger.p["T"][a, b] for a, b in zip((0, *p), (*p, 0), strict=True)),
        )
        path = np.zeros(5, int)
        for a, b, tag in tagger.decode([e[:, w]])[0]:
            path[a:b] = tag
        assert tuple(path) == best
    long = rng.normal(0, 1, (400, 5)).astype("f4")
    long[:, 0] += rng.choice([0, 6], 400)
    path = np.zeros(400, int)
    for a, b, tag in tagger.decode([long])[0]:
        path[a:b] = tag
    none = np.array([[1e6, 0, 0, 0, 0]], "f4")
    assert (path == tagger.viterbi(np.concatenate([none, long, none])[:, None])[0][1:-1]).all() and path.any() and not path.all()


def test_windows_are_reconciled(tagger):
    rng = random.Random(5)
    text = prose(rng, 600)
    marks = [m.start() for m in re.finditer(" ", text)]
    for at in sorted(rng.sample(marks, 12), reverse=True):
        text = text[:at] + " (743) 555-3824" + text[at:]
    whole = [(m.start(), m.end()) for m in re.finditer(r"\(743\) 555-3824", text)]
    (base, every), = P.spans_of(tagger, [text])
    assert not base and sum((a, b) in {s[:2] for s in every} for a, b in whole) >= 11
    plain = P.spans_of(tagger, [prose(rng, 3000)])[0]
    assert plain == ([], [])


def _written_forms(rng):
    """(name, text, kind) of the forms that the patterns miss."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = "4" + d(14)
    card += next(str(k) for k in range(10) if P.luhn(card + str(k)))
    return [
        ("(at)", f"{rng.choice(['jo', 'anna', 'max'])} (at) {rng.choice(['mail', 'web'])}.{rng.choice(['com', 'org'])}", 0), ("spaced", " . ".join(str(rng.randint(1, 255)) for _ in range(4)), 1),
        ("dashed", f"{d(3)}-555-{d(4)}", 3), ("bracketed", f"({d(3)}) 555-{d(4)}", 3), ("dotted", ".".join(card[i : i + 4] for i in range(0, 16, 4)), 2),
    ]


def test_other_forms_are_found(spark):
    """Twenty places each, and look-alikes, in prose of the sample tables that the network hasn't seen."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 200 and 16000").orderBy("doc_id").collect()]
    tagger, rng = P.train_tagger(texts[: len(texts) // 2]), random.Random(3)
    docs, want = [], []
    for _ in range(20):
        for name, form, kind in _written_forms(rng):
            t = rng.choice(texts[len(texts) // 2 :])
            at = t.rfind(" ", 0, rng.randrange(len(t))) + 1
            docs.append(t[:at] + form + " " + t[at:])
            want.append((name, (at, at + len(form), kind)))
    hits = Counter(name for (name, span), (_, every) in zip(want, P.spans_of(tagger, docs), strict=True) if span in every)
    assert len(hits) == 5 and min(hits.values()) >= 18, hits
    looks = ["version 1.2.34", "2024-05-17", "pages 120-134", "12.50 %", "order 123456", "10:45 am", "1914-1918", "room 12, floor 3", "@name", "$12.50", "#1234", "call at five."]
    docs = []
    for look in looks * 5:
        t = rng.choice(texts[len(texts) // 2 :])
        at = t.rfind(" ", 0, rng.randrange(len(t))) + 1
        docs.append(t[:at] + look + " " + t[at:])
    assert sum(len(every) - len(base) for base, every in P.spans_of(tagger, docs)) == 0


def test_seams_change_nothing(tagger, monkeypatch):
    rng = random.Random(6)
    text = prose(rng, 400)
    for shift in range(0, 60, 4):
        own = ("x " * 30)[: 2 * (shift % 8)] + text[: 900 + shift] + " (743) 555-3824 " + text[900 + shift :]
        split = P.tag_texts(tagger, [own])
        with monkeypatch.context() as m:
            m.setattr(P, "windows_of", lambda n: [(0, n)])
            assert split == P.tag_texts(tagger, [own])


def test_pii_of_edges(edge_docs, edge_rows, no_docs):
    extra = [(200, "Mail me: a.b@c.example.com, 10.1.2.3 or +1 (017) 555-7713! ü 4556 7375 8689 9855")]
    docs = edge_docs.unionByName(edge_docs.sparkSession.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = P.find_pii(docs, redacted=True).collect()
    assert len(rows) == len(edge_rows) + 1
    row = next(r for r in rows if r.doc_id == 200)
    want = _base(extra[0][1])
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest()
    assert all(s in row.spans.split(",") for s in P.joined(want).split(","))
    assert row.redacted == "Mail me: <EMAIL>, <IP> or <PHONE>! ü <CARD>"
    blank = [r for r in rows if r.doc_id in (100, 101)]
    assert all(r.spans == "" and r.redacted == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in blank)
    assert P.find_pii(no_docs).count() == 0


# ------------------------------------------------------------ language model


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = L.Network(L.HEAD)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, y = rng.integers(0, L.HEAD + L.TAILS, (5, 3)), rng.integers(0, L.HEAD + L.TAILS, (5, 3))
    keep, h = (rng.random((5, 3)) > 0.2).astype(float), rng.normal(0, 0.3, (3, L.STATE))
    _, grads, _ = net.window(x, y, keep, h)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        if k == "X":
            at = (int(x[2, 1]), 4)
        if k in "Vv":
            head = y[y < L.HEAD][0]
            at = (head // L.CLASS_SIZE, 3, head % L.CLASS_SIZE) if k == "V" else (head // L.CLASS_SIZE, head % L.CLASS_SIZE)
        old = v[at]
        v[at] = old + 1e-4
        up = net.window(x, y, keep, h)[0]
        v[at] = old - 1e-4
        down = net.window(x, y, keep, h)[0]
        v[at] = old
        assert grads[k].dtype == v.dtype and grads[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-4), k


def test_windows_write_to_arrays_that_are_there():
    rng = np.random.default_rng(2)
    net, shape = L.Network(L.HEAD), (L.LEARN_STEPS, L.LEARN_STREAMS)
    x, y = rng.integers(0, L.HEAD + L.TAILS, shape), rng.integers(0, L.HEAD + L.TAILS, shape)
    keep, h = (rng.random(shape) > 0.01).astype("f4"), np.zeros((shape[1], L.STATE), "f4")
    first = net.window(x, y, keep, h)
    tracemalloc.start()
    again = net.window(x, y, keep, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # gradients and small arrays; what steps and outputs leave would be over twice that
    assert again[0] == first[0] and all((again[1][k] == g).all() for k, g in first[1].items())


def test_words_that_are_learnt_have_no_hashes():
    vocab, docs = L.Vocab([L.END, b"head"], {b"ab": 3}), [[b"xab,", b"head", b"xab,", b"ab"], [], [b"other"]]
    coder = L.Coder(vocab)
    assert [d.tolist() for d in coder.coded(docs)] == [[L.HEAD + 3, 1, L.HEAD + 3, L.HEAD + 3, 0], [0], [L.HEAD, 0]]
    assert not any(coder.hashes)
    hashed = L.Coder(vocab, hashed=True)
    assert [hashed.of(d).tolist() for d in docs] == [[2, 1, 2, 3], [], [4]]
    assert hashed.known()[1].tolist() == [0, 0, *map(L.word_hash, (b"xab,", b"ab", b"other"))]


def test_outputs_are_softmax_where_exponentials_overflow():
    rng = np.random.default_rng(4)
    net = L.Network(L.HEAD)
    net.p["b"] += rng.normal(0, 200, net.p["b"].shape).astype("f4")
    net.p["v"] += rng.normal(0, 200, net.p["v"].shape).astype("f4")
    states, y = rng.normal(0, 0.5, (2500, L.STATE)).astype("f4"), rng.integers(0, L.HEAD + L.TAILS, 2500)
    y[:1300] %= L.CLASS_SIZE  # one class of over ROWS rows
    with np.errstate(over="ignore"):
        got, _ = net.outputs(np.append(states, np.ones((len(y), 1), "f4"), 1), y)
    log_softmax = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
    p = {k: v.astype("f8") for k, v in net.p.items()}
    for state, target, found in zip(states.astype("f8"), y, got, strict=True):
        c, k = divmod(int(target), L.CLASS_SIZE)
        tail = target >= L.HEAD
        want = log_softmax(state @ p["W"] + p["b"])[target - L.HEAD + L.HEAD_CLASSES if tail else c]
        want += 0 if tail else log_softmax(state @ p["V"][c] + p["v"][c])[k]
        assert found == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_streams_score_as_single_documents():
    rng = np.random.default_rng(1)
    net = L.Network(500)
    lengths = [1, 7, 300, 2, 40, 1, 1, 90]
    docs = [np.append(rng.integers(1, 500, n - 1), 0) for n in lengths]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    together = net.score(np.concatenate(docs), bounds)
    for d, a, b in zip(docs, bounds, bounds[1:], strict=False):
        alone = net.score(d, np.array([0, len(d)]))
        assert np.allclose(alone, together[a:b], atol=1e-4)


def test_scores_are_probabilities():
    net = L.Network(130)
    ids = np.array([5, 0])
    total = 0.0
    for w in [*range(130), *range(L.HEAD, L.HEAD + L.TAILS)]:
        total += math.exp(net.score(np.array([5, w]), np.array([0, 2]))[1])
    assert total == pytest.approx(1.0, abs=1e-3) and len(net.score(ids, np.array([0, 2]))) == 2


def _brute(rows):
    tokens = [((t or "").encode().lower().split() + [b"\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, t in rows]
    counts = Counter(w for ws, out in tokens if not out for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, out, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))
        for (i, _), (ws, out) in zip(rows, tokens, strict=True)
    ]


def test_language_model_of_edges(edge_docs, edge_rows, no_docs):
    got = L.score_documents(edge_docs).collect()
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert Counter(map(str, mine)) == Counter(map(str, _brute(edge_rows)))
    assert all(r.score < 0 for r in got)
    assert L.score_documents(no_docs).count() == 0
    alone = L.score_documents(edge_docs, held_out=F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and all(math.isfinite(r.score) for r in alone)


def test_language_model_learns_from_every_training_document(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40)) for i in range(L.SAMPLE_ROWS + 300)]
    rows += [(5000 + i, " ".join(f"long{rng.randrange(40)}" for _ in range(L.SAMPLE_CHARS // 5))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("held_out", F.lit(False))
    counts = Counter(w for _, t in rows for w in t.encode().split())
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: L.HEAD - 1]
    head = L.head_words(docs)
    found, by_word, seen, by_end, n_docs, n_tail = L.word_profiles(docs, head)
    assert list(zip(head, found.tolist(), strict=True)) == want and b"long7" in head  # only texts of over SAMPLE_CHARS have it
    tails = Counter()
    for w, n in counts.items():
        tails[w.rstrip(L._ENDS)[-2:]] += n * (w not in head)
    assert seen == {e: n for e, n in tails.items() if n} and n_docs == len(rows) and n_tail == sum(seen.values())
    net = L.Network(len(head) + 1)
    before = {k: v.copy() for k, v in net.p.items()}
    assert L.learn_all(docs, L.choose_vocab(list(head), by_word, seen, by_end), net) == sum(counts.values()) + len(rows)
    assert all((net.p[k] != before[k]).any() for k in before)


def test_language_model_learns_from_long_documents_only(spark):
    text = " ".join(f"{a} {b}" for a, b in [("aa", "bb"), ("cc", "dd"), ("ee", "ff")] * 1500)
    rows = [(i, text) for i in range(8)]
    assert len(text) > L.SAMPLE_CHARS
    got = L.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), held_out=F.col("doc_id") == 0).where("held_out").first()
    assert got.score > got.base_score  # a network that has learnt nothing is worse than counts


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_language_model_beats_the_base(spark):
    rows = L.op1_lm_scoring(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# ------------------------------------------------------------ n-gram join


def _sets(rows):
    first, sets = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = tuple((t or "").lower().split())
        if w not in first:
            first[w] = i
            sets[w] = {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()
    return first, sets


def _brute_join(rows, threshold=0.8):
    first, sets = _sets(rows)
    keys = list(sets)
    links = {k: [m for m in keys if m != k and sets[k] and len(sets[k] & sets[m]) >= threshold * len(sets[k] | sets[m]) - 1e-9] for k in keys}
    return first, links


def near_copies(seed=9, groups=25):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        words = prose(rng, rng.randint(6, 90)).split()
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((len(rows), " ".join(own)))
    return rows


def _compare(spark, rows, got):
    first, links = _brute_join(rows)
    by_id = {i: tuple((t or "").lower().split()) for i, t in rows}
    for r in got:
        w = by_id[r.doc_id]
        assert r.class_id == first[w] and r.n_links == len(links[w]), r
    group = {r.doc_id: r.group_id for r in got}
    for w, others in links.items():
        assert all(group[first[w]] == group[first[o]] for o in others)
    assert sum(r.kept for r in got) == len(set(group.values()))
    assert all(r.doc_id == r.group_id for r in got if r.kept)


def test_join_against_all_pairs(spark):
    rows = near_copies() + [(900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (904, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _compare(spark, rows, J.similarity_join(docs).collect())


def test_large_groups_are_split(spark, monkeypatch):
    """Buckets, leaves and blocks far smaller than a group of near copies."""
    monkeypatch.setattr(J, "BLOCK_SETS", 16)
    monkeypatch.setattr(J, "SMALL", 20)
    rng = random.Random(12)
    words = prose(rng, 80).split()
    rows = []
    for i in range(120):
        own = list(words)
        own[rng.randrange(len(own))] = f"w{i % 60}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    every = scratch.write(J.features(docs, F.monotonically_increasing_id(), docs["doc_id"], docs["text"]))
    leaves, large = J.choose_paths(every.select("row", "mins"), scratch, threshold=0.8, leaf=8)
    assert large.count() > 0
    _compare(spark, rows, J.similarity_join(docs).collect())


def test_rows_sent_grow_with_the_members(spark):
    """Two groups of near copies, the second four times as large: four times the rows, and links as by all pairs."""
    rng, rows = random.Random(5), []
    for n in (2000, 8000):
        words = prose(rng, 60).split()
        for i in range(n):
            own = list(words)
            own[i % 60] = f"w{i // 60}x{n}"
            rows.append((len(rows), " ".join(own)))
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    every = scratch.write(J.features(docs, docs["doc_id"], docs["doc_id"], docs["text"]))
    members = every.select("row", (F.col("row") >= 2000).cast("long").alias("comp"))
    sent = {r["comp"]: (r["n"], r["most"]) for r in J.deal(members, every, scratch).groupBy("comp", "task").count()
            .groupBy("comp").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}
    assert sent[0][0] == J.BLOCKS * 2000 and sent[1][0] == J.BLOCKS * 8000 and sent[1][1] <= 2.2 * J.BLOCK_SETS  # blocks are dealt by a hash
    found = J.verify(members, every, scratch, threshold=0.8, partitions=8).where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    # 56 runs each: two texts that differ in one word share at least 46 of 66, in the same place 51 of 61
    sets = [{tuple(t[k : k + 5]) for k in range(56)} for t in (r[1].split() for r in rows)]
    picked = rng.sample(range(2000), 10) + rng.sample(range(2000, 10000), 10)
    got = {r["u"]: r["n"] for r in found.where(F.col("u").isin(picked)).collect()}
    for i in picked:
        group = range(2000) if i < 2000 else range(2000, 10000)
        assert got.get(i, 0) == sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in group)


def test_join_of_edges(edge_docs, edge_rows, no_docs):
    rows = J.similarity_join(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    first, links = _brute_join(edge_rows)
    want = Counter((i, first[tuple((t or "").lower().split())], len(links[tuple((t or "").lower().split())])) for i, t in edge_rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == want
    assert J.similarity_join(no_docs).count() == 0


def test_runs_reach_the_recall():
    n = J.runs_for(0.8)
    assert 1 - (1 - 0.8**J.DEPTH) ** n >= J.RECALL


def test_components_against_union(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    forest = J.Forest()
    for u, v in edges:
        forest.join(u, v)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: forest.find(x) for x in nodes}


# ------------------------------------------------------------ pipeline


@pytest.mark.parametrize("stage", ["exact_dedup", "jaccard_join"])
def test_pipeline_rows_keep_their_numbers(spark, tmp_path, stage):
    """Other splits of the files between two scans, as when executors come or go."""
    import corpus_pipeline as C

    rng = random.Random(12)
    rows = [(i, prose(rng, 30), f"r{i}") for i in range(160)]
    rows += [(1000 + i, rows[i][1], f"r{1000 + i}") for i in range(0, 160, 2)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(16).write.parquet(f"{tmp_path}/docs")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        got = dict(C.STAGES)[stage](spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        assert got.columns == ["doc_id", "text", "_row"]
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] < 1000)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(10)
    rows, marks = [], []
    for i in range(260):
        words = prose(rng, rng.randint(40, 90)).split()
        if i % 5 == 0:
            for k in (3, 9, 15):
                words[k] = rng.choice(["moron", "scum", "trash"])
        rows.append((i, " ".join(words), "en", "src", 0))
        marks.append((i, int(i % 5 == 0)))
    rows.append((300, rows[1][1].replace(" ", "\n", 2), "en", "src", 0))
    changed = rows[2][1].split()
    changed[0] = "other"
    rows += [(301, " ".join(changed), "en", "src", 0), (302, "mail a@b.example.com now", "en", "src", 0), (303, None, "en", "src", 0), rows[7]]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).repartition(3)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = [r[0] for r in rows if r[0] % 5 or r[0] >= 300]
    after = docs
    for k, want in enumerate([clean, [i for i in sorted(set(clean)) if i != 300], [i for i in sorted(set(clean)) if i not in (300, 301)]]):
        before, after = after, C.STAGES[k][1](spark, after, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.columns == before.columns and ids(after) == sorted(want), k
    masked = {r.doc_id: r for r in C.pii(spark, after, str(tmp_path)).collect()}
    assert masked[302].text == "mail <EMAIL> now" and masked[302].n_chars == 16 and masked[303].text == ""
    assert masked[1].text == rows[1][1]
    assert ids(C.packing(spark, after, str(tmp_path))) == ids(after)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
