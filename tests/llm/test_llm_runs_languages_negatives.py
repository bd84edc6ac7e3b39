"""Periodic runs, language identification and hard negatives against plain versions."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from corpus import frame, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st

from verdance.llm import language, negatives, periodic, queries
from verdance.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id", ignore_index=True)


# ---- periodic runs


def plain_runs(w, least=24, times=3):
    """Every lag on its own, and every smaller period tried."""
    known: dict = {}
    w, out = np.array([known.setdefault(x, len(known)) for x in w], int), []
    for q in range(1, len(w) // times + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False])).astype(int)
        for a, b in zip(*(np.flatnonzero(np.diff(same) == d).tolist() for d in (1, -1)), strict=True):
            start, length = a, b - a + q
            part = w[start : start + length]
            smaller = any((part[d:] == part[:-d]).all() for d in range(1, q)) if length >= max(least, times * q) else True
            if not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    w = words(text)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    w = plain_planted(doc_id, text)
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, exponent, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.lists(
            st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=20), st.floats(1, 6), st.integers(0, 9)), max_size=4
        ),
        max_size=3,
    )
)
def test_runs_of_any_words(texts):
    laid = [[x for part, times, more in t for x in (part * 16)[: int(len(part) * times) + more]] for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in laid]))).astype(np.int64)
    got = list(zip(*(c.tolist() for c in periodic.find(np.array(sum(laid, []), np.int64), offsets)), strict=True))
    assert got == [(s + int(at), n, q) for t, at in zip(laid, offsets, strict=False) for s, n, q in plain_runs(t)]


def test_long_periods_and_a_million_equal_words():
    r = np.random.default_rng(3)
    parts = [r.integers(0, 5, 700), np.tile(r.integers(0, 50, 333), 4), np.tile([1, 1, 2, 1, 1, 2, 1, 1, 3], 40)]
    w = np.concatenate(parts)
    got = list(zip(*(c.tolist() for c in periodic.find(w, np.array([0, len(w)]))), strict=True))
    assert (700, 4 * 333, 333) in got or any(q == 333 for _, _, q in got)
    assert got == plain_runs(w.tolist())
    one = [c.tolist() for c in periodic.find(np.zeros(1_000_000, np.int64), np.array([0, 1_000_000]))]
    assert one == [[0], [1_000_000], [1]]


def run_rows():
    said = " ".join(["a b c"] * 30)
    rows = [(i, said, "en", "a") for i in (20, 20, 21, None)]
    rows += [(30, "x " * 5000, "en", "a"), (31, " ".join(f"w{k % 900}" for k in range(5000)), None, None)]
    # ids whose CRC is a multiple of ten get planted runs
    ids = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"u{(i * k * k) % 97}" for k in range(5 * i)), "de", "b") for i in ids]
    rows += [(ids[0] + 10_000 * k, text, "de", "b") for k, text in enumerate(["", "   ", "one", None])]
    return odd_rows() + rows


def test_runs_of_odd_rows(spark):
    rows = run_rows()
    got = periodic.digest(periodic.planted(frame(spark, rows).repartition(3)))
    kinds = ["bigint"] * 6 + ["string"] * 2
    assert [t for _, t in got.dtypes] == kinds
    want = sorted((plain_digest(i, t) for i, t, *_ in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert periodic.digest(periodic.planted(frame(spark, []))).collect() == []


def test_collapsed_texts_and_spans(spark):
    text = "see " + "a b c " * 12 + "end"
    got = periodic.periodic_runs(frame(spark, [(1, text, None, None), (2, None, None, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(1, 36, 3)]
    assert [r["collapsed"] for r in got] == ["see a b c end", ""]
    assert got[1]["runs"] == []


def test_runs_of_documents(spark, sf_dir, documents):
    got = queries.QUERIES["op13_periodic_runs"](spark, sf_dir).toPandas().sort_values("doc_id", ignore_index=True)
    assert len(got) == len(documents)
    for k in range(len(documents)):
        want = plain_digest(int(documents.doc_id[k]), documents.text[k])
        own = tuple(None if isinstance(x, float) and np.isnan(x) else x for x in got.iloc[k])
        assert own == want
    assert (got.n_runs > 0).mean() > 0.05


# ---- languages


def pieces(rows):
    return [[t.encode()[:96], t.encode()[96:192]] for t, _ in rows], [la for _, la in rows]


def plain_state(net, data, way):
    """One direction, a byte and a unit at a time."""
    units, h, out = net.turn.shape[-1], [0.0] * net.turn.shape[-1], []
    squash = lambda x: x / (1 + abs(x))
    for byte in data:
        pull = [[sum(h[j] * float(net.turn[way, g, j, k]) for j in range(units)) for k in range(units)] for g in range(3)]
        add = net.bytes[way, :, max(ord(chr(byte).lower()) if byte < 128 else byte, 1)].astype(float)
        new = []
        for k in range(units):
            update, reset = (0.5 + 0.5 * squash(add[g, k] + pull[g][k]) for g in (0, 1))
            candidate = squash(add[2, k] + reset * pull[2][k])
            new.append(candidate + update * (h[k] - candidate))
        h = new
        out.append(h)
    return np.array(out)


def test_positions_as_by_a_plain_network():
    net = language.Net.fresh(["x", "y", "z"], units=3)
    texts = ["Ein kurzer Text.".encode(), "ü".encode(), b"", b"some more bytes \x00 of it"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, own in zip(texts, got, strict=True):
        if not text:
            assert not own.any()
            continue
        both = np.concatenate((plain_state(net, text, 0), plain_state(net, text[::-1], 1)[::-1]), axis=1)
        logits = both @ net.out + net.bias
        shares = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        assert np.allclose(own, shares.mean(axis=0), atol=1e-5)


def test_gradients_are_slopes_of_the_loss():
    net = language.Net.fresh(["x", "y"], units=3)
    for k, v in net.parts().items():
        setattr(net, k, v.astype(np.float64))
    r = np.random.default_rng(1)
    laid, lengths, target = r.integers(1, 5, (6, 3)).astype(np.uint8), np.array([6, 4, 2]), np.array([0, 1, 1])
    for k, n in enumerate(lengths):
        laid[n:, k] = 0
    _, grads = language.gradients(net, laid, lengths, target)
    for name, part in net.parts().items():
        for at in map(tuple, np.argwhere(np.abs(grads[name]) > 1e-5)[:40]):
            held, loss = part[at], []
            for side in (1e-4, -1e-4):
                part[at] = held + side
                loss.append(language.gradients(net, laid, lengths, target)[0])
            part[at] = held
            assert abs((loss[0] - loss[1]) / 2e-4 - grads[name][at]) < 1e-3 * abs(grads[name][at]) + 1e-5


def test_windows_don_t_change_a_long_text(monkeypatch):
    rows = [("the cat sat on the mat and the dog ran " * 5, "en"), ("der Hund und die Katze sind nicht hier " * 5, "de")] * 40
    net = language.fit(*pieces(rows))
    text = ("the dog sat on the mat " * 400).encode()
    whole = net.pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(language, "CORE", 1 << 14)
    once = net.pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert whole.argmax() == once.argmax() == net.languages.index("en")
    assert np.abs(whole - once).max() < 0.05


def language_rows():
    en, de = "the cat sat on the mat and the dog ran ", "der Hund und die Katze sind nicht hier "
    rows = [(k, (en if k % 2 else de) * (1 + k % 9), "en" if k % 2 else "de", "a") for k in range(300)]
    odd = [(1000, None, "en", "a"), (1001, "", "de", "a"), (1002, "12 3.4 !? \n", "en", None), (1003, en * 3000, None, None)]
    return rows + odd + [(1004, "12 " + de, "en", "a"), (1004, "12 " + de, "en", "a"), (None, en, None, "a"), (None, None, None, None)]


def test_languages_of_odd_rows(spark):
    rows = language_rows()
    docs = frame(spark, rows).repartition(3)
    net = language.trained(docs)
    assert net.languages == ["de", "en"]
    got = language.predicted(docs, net)
    assert dict(got.dtypes)["score"] == "double" and got.count() == len(rows)
    seen = {(r["doc_id"], r["text"]): r for r in got.collect()}
    for i, text, lang, _ in rows:
        r = seen[i, text]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == ("en" if "the" in text else "de")


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "word", None, None), (2, None, "en", None)])
    net = language.trained(docs)
    assert net.languages == []
    assert {(r["lang_pred"], r["score"]) for r in language.predicted(docs, net).collect()} == {("und", 0.0)}
    assert [r["spans"] for r in language.spans(docs, net).collect()] == [[], []]
    empty = frame(spark, [])
    assert language.predicted(empty, language.trained(empty)).collect() == []


def test_spans_cover_every_byte(spark):
    docs = frame(spark, language_rows())
    net = language.trained(docs)
    both = "the cat sat on the mat and the dog ran " * 8 + "der Hund und die Katze sind nicht hier " * 8
    asked = frame(spark, [(1, both, None, None), (2, "12", None, None), (3, "ü", None, None)])
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in language.spans(asked, net).collect()}
    assert got[2] == [] and sum(n for _, n, _ in got[3]) == 2
    at = 0
    for start, length, _ in got[1]:
        assert start == at
        at += length
    assert at == len(both)
    assert got[1][0][2] == "en" and got[1][-1][2] == "de"


def test_held_out_accuracy(spark, sf_dir, documents):
    got = queries.QUERIES["op11_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    own = documents.set_index("doc_id").join(got)
    asked = own[own.held_out & own.lang.notna() & own.text.notna()]
    assert len(asked) > 200 and (asked.lang_pred == asked.lang).mean() > 0.99
    assert own.score.between(0, 1).all()


# ---- hard negatives


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 64, 65, 200]), st.sampled_from([1, 100, 10**4, 2**26]))
def test_scores_are_exact(seed, dim, most):
    r = np.random.default_rng(seed)
    a, b = (r.integers(-most, most + 1, (n, dim)) for n in (5, 7))
    assert (negatives.scores(a, b) == a @ b.T).all()


def test_scores_at_the_edge_of_the_range():
    for most in (1, 125, 126, 2**20, 2**28):
        a = np.full((2, 64), most)
        a[1] = -most
        assert (negatives.scores(a, a) == a @ a.T).all()
    assert (negatives.scores(np.zeros((1, 4), np.int64), np.zeros((1, 4), np.int64)) == 0).all()


def plain_mined(rows, every, positives, wanted, low, high):
    own = sorted({(i, la, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, la, v in rows
                  if i is not None and la is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for i, la, v in own:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, lb) for j, lb, w in own if j != i and len(w) == len(v)]
        for rank, (p, j, _) in enumerate(sorted(s for s in scored if s[2] == la)[:positives]):
            fit = sorted(s for s in scored if s[2] != la and low * -p <= 100 * -s[0] <= high * -p)[:wanted]
            out += [(i, j, k + 1, n, -p, -s, rank + 1) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def check_mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' AS rank", "1 AS v")
    from pyspark.sql import functions as F

    got = negatives.mined(negatives.labelled(df.repartition(3), F.col("label")), **how)
    kinds = ["bigint", "bigint", "int", "bigint", "bigint", "bigint", "int"]
    assert [t for _, t in got.dtypes] == kinds
    default = {"every": 100, "positives": 5, "negatives": 10, "low": 30, "high": 90} | how
    want = plain_mined(rows, default["every"], default["positives"], default["negatives"], default["low"], default["high"])
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def test_mined_with_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    r = np.random.default_rng(5)
    rows = [(k, int(r.integers(0, 3)), [float(x) for x in r.normal(size=4)]) for k in range(150)]
    rows += [(200 + k, k % 2, [1.0, 0.5, 0.25, 0.125]) for k in range(40)]
    rows += [(300 + k, 7, [0.5, 0.5, 0.5, float(k)]) for k in range(30)]
    rows += rows[:40]
    rows += [(400, 1, None), (410, None, [1.0] * 4), (420, 1, [1.0, None, 1.0, 1.0]), (430, 1, [float("nan")] * 4)]
    rows += [(440, 1, []), (450, 1, [1.0, 2.0]), (451, 1, [2.0, 2.0]), (452, 2, [0.9, 1.0]), (None, 1, [1.0] * 4), (-10, 1, [1.0] * 4)]
    rows += [(0, 2, [9.0, 9.0, 9.0, 9.0]), (460, 99, [0.0] * 4)]
    assert len(check_mined(spark, rows, every=10)) > 200


def test_mined_of_large_and_no_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(k, k % 2, [float(x) for x in r.normal(size=5) * 3e5]) for k in range(60)]
    assert check_mined(spark, rows, every=20, positives=2, negatives=3)
    check_mined(spark, [])


def test_mined_embeddings_as_by_sql(spark, sf_dir):
    got = queries.QUERIES["op12_hard_negatives"](spark, sf_dir)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        want = db.sql(negatives.ORACLE)
        assert want.columns == got.columns
        assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
