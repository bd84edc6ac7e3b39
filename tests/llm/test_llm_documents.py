"""Operators over documents: odd rows, empty tables, and plain versions of the same."""

import hashlib
import tempfile
import tracemalloc
import zlib
from random import Random

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from corpus import frame, linked_groups, odd_rows, repeat_mask, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdance.llm import bytenet, lines, minhash, mixing, packing, repeats, robust, tokens
from verdance.llm import textbytes as tb

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id", ignore_index=True)


def rows_of(df):
    return [tuple(r) for r in df.toPandas().itertuples(index=False)]


# ---- line dedup


def plain_line_dedup(rows, least):
    """Deleted (document, line) pairs by looking at every run."""
    docs = [(i, t.split("\n")) for i, t in rows if t is not None]
    first, gone = {}, set()
    for i, ls in docs:
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(ls[a:b])
                if sum(len(words(x)) for x in run) < least:
                    continue
                if run in first and first[run] != (i, a):
                    gone |= {(i, k) for k in range(a, b)}
                first.setdefault(run, (i, a))
    return gone


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b", "a b c", "x y z u v", "p q"]), max_size=9), min_size=1, max_size=6))
def test_line_dedup_like_all_runs(spark, texts):
    rows = [(k, "\n".join(t)) for k, t in enumerate(texts)]
    gone = plain_line_dedup(rows, 5)
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text", "n_removed")
    want = []
    for i, t in rows:
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        want.append((i, "\n".join(left), len(t.split("\n")) - len(left)))
    assert sorted(rows_of(got)) == want


def test_line_dedup_of_a_repeated_row(spark):
    run = "a b\nc d\ne f"
    rows = [(1, f"x1\n{run}\ny1"), (2, f"x2\n{run}\ny2"), (2, f"x2\n{run}\ny2"), (3, f"x3\n{run}\ny3")]
    rows += [(None, f"x0\nm n\no p\nq r\n{k}") for k in (8, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, rows[0][1], 5, 0), *[(k, f"x{k}\ny{k}", 5, 3) for k in (2, 2, 3)]]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.deduplicated(df).select("row.doc_id", "text", "n_lines", "n_removed").collect()]
    assert sorted(g for g in got if g[0]) == want
    # one of the two texts without an id is the first
    left = sorted((g[3], g[1][-1]) for g in got if g[0] is None)
    assert left in ([(0, "8"), (0, "8"), (4, "9")], [(0, "9"), (4, "8"), (4, "8")])
    # the same where the repeated row holds the first copy
    df = spark.createDataFrame([rows[1], rows[1], rows[3]], "doc_id long, text string")
    assert sorted(r.n_removed for r in lines.deduplicated(df).collect()) == [0, 0, 3]


def test_line_dedup_odd_rows(odd, none):
    out = lines.without_copies(odd)
    assert out.columns == odd.columns and set(out.select("d", "row").distinct().collect()) == {("x", "x")}
    left = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert {i for i, _, _ in left} >= {2, 4, 5, 6, 7, 8, 9, 11, 12}
    # a null doc_id comes first, so of the copies its text stays
    assert not any(i in (1, 3) for i, _, _ in left)
    assert (14, "line one has six words here\n\nshort\nshort", 40) in left
    assert lines.digest(none).collect() == [] and lines.digest(odd).count() == odd.count()


# ---- packing


def test_packing_of_documents(spark, documents):
    rows = documents[["doc_id", "text"]]
    got = packing.pack(spark.createDataFrame(rows), WORDS, ids=True).toPandas()
    own = Tokenizer.from_file(WORDS)
    want = {}
    for i, t in rows.itertuples(index=False):
        ids = own.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[i, k] = (at, len(part) // 4, zlib.crc32(part), part)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.ids) for r in got.itertuples()} == want
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        ends = x["length"].cumsum().to_list()
        assert x["offset"].to_list() == [0, *ends[:-1]] and ends[-1] <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8))
def test_bins_hold_everything_once(counts):
    out = packing.bins(counts, 30)
    held = {}
    for inside, times in out:
        assert sum(inside) <= 30 and times > 0
        for x in inside:
            held[x] = held.get(x, 0) + times
    assert held == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 25))
def test_fullest_is_the_best_subset(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    got = packing.fullest(counts, room)
    assert sum(got) == max(s for s in sums if s <= room)
    assert all(got.count(x) <= counts[x] for x in got)


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd, WORDS).toPandas()
    assert len(got[got.doc_id.isin([5, 6, 7])]) == 3 and (got[got.doc_id.isin([5, 6, 7])]["length"] == 1).all()
    assert (got["doc_id"] == 8).sum() == 2
    assert packing.pack(none, WORDS).collect() == []


# ---- tokens

PIECES = ["a", "the", " ", "  ", "\n", "'", "re", "'s", "'ll", "é", "é", "\t", "12", "<|endoftext|>", "<|", "!!", "\x1c", "\xa0", "中", "²", "Σ", "İ", "\r\n"]
own_bytes, own_words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10))
def test_prefix_counts_like_the_library(parts):
    text, own = "".join(parts), tokens.counter(BYTE)
    counts = own.prefix_counts(text)
    for k in range(1, len(text) + 1):
        prefix = text[:k]
        assert counts[len(prefix.encode()) - 1] == len(own_bytes.encode(prefix, add_special_tokens=False).ids)
    assert own.count(text) == len(own_bytes.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "<|startoftext|>", "Abc"]), max_size=10))
def test_word_ids_like_the_library(parts):
    text = "".join(parts)
    got = np.frombuffer(tokens.word_ids(WORDS).encode([text])[0], "<u4").tolist()
    assert got == own_words.encode(text, add_special_tokens=False).ids


def test_a_word_of_a_megabyte_and_bounded_tables(monkeypatch):
    import random

    r = random.Random(4)
    word = "".join(r.choice("abcdefghijklmnop") for _ in range(1_000_000))
    own = tokens.WordIds(WORDS)
    texts = [word, word[:300] + " " + word[:256] + "12,;" + "!" * 700, "short words stay", "é" * 400 + "Σ" * 300]
    assert own.encode(texts) == [own.by_library(t) for t in texts]
    assert word not in own.known and "short" in own.known
    monkeypatch.setattr(tokens, "KEEP", 30 * tokens.ENTRY)
    own, counter = tokens.WordIds(WORDS), tokens.PrefixCounter(BYTE)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(9)) for _ in range(300)) for _ in range(4)]
    assert own.encode(texts) == [own.by_library(t) for t in texts]
    library = Tokenizer.from_file(BYTE)
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(own.known) <= 31 and len(counter.words) + len(counter.tables) + len(counter.stay) <= 60



def _peak(call) -> float:
    """MB that a call holds at once, NumPy's arrays included."""
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_of_the_pipeline_holds_little():
    own = tokens.WordIds(WORDS)
    texts = [" ".join(f"w{k * j}" for j in range(200)) for k in range(2500)]
    assert own.encode(texts[:50]) and "tokenizer" not in vars(own)
    tb._kept.cache_clear()
    column = pa.array(texts)
    assert _peak(lambda: [len(grams) for _, grams in minhash.shingles(column, 5)]) < 20
    assert _peak(lambda: minhash._minima(np.arange(5000, dtype=np.uint64), 2048)) < 6


def test_token_counts_of_documents(spark, documents, odd, none):
    got = tokens.token_counts(spark.createDataFrame(documents), BYTE).toPandas().set_index("doc_id")
    for i, t in documents[["doc_id", "text"]].itertuples(index=False):
        assert tuple(got.loc[i]) == (len(t.encode()), len(own_bytes.encode(t, add_special_tokens=False).ids))
    many = tokens.token_counts(odd, BYTE, prefixes=True).toPandas()
    assert len(many) == odd.count()
    assert all(r.n_tokens == (r.prefix_tokens[-1] if r.n_bytes else 0) for r in many.itertuples())
    assert tokens.token_counts(none, BYTE).collect() == []


# ---- quality rules


def plain_statistics(text):
    w = words(text)
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {k + j for p in places.values() if len(p) > 1 for k in p for j in range(5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_statistics(spark, documents, odd, none):
    both = [(i, t) for i, t, *_ in odd_rows() if i is not None] + [(100 + i, t) for i, t in documents[["doc_id", "text"]].itertuples(index=False)]
    df = frame(spark, [(i, t, "en", "a") for i, t in both])
    got = {r["doc_id"]: tuple(r[s] for s in robust.STATS) for r in robust.statistics(df).collect()}
    assert got == {i: plain_statistics(t) for i, t in both}
    assert robust.judged(none).collect() == []
    assert robust.judged(odd).count() == odd.count()


def test_outliers_like_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, robust.P)) * robust.FLOOR * 3
    x[:40] += 40 * robust.FLOOR
    df = spark.createDataFrame([("g", [float(v) for v in row]) for row in x], "group string, x array<double>")
    model = robust.estimates(df).collect()[0]
    white = np.array(model["white"]).reshape(robust.P, robust.P)
    far = (((x - np.array(model["centre"])) @ white.T) ** 2).sum(axis=1)
    # concentration: the nearest three quarters give the estimate back
    core = x[np.argsort(far)[: int(0.75 * len(x))]]
    assert np.abs(core.mean(axis=0) - np.array(model["centre"])).max() < 0.1 * robust.FLOOR.max()
    assert (far[:40] > robust.CUTOFF).all() and (far[40:] <= robust.CUTOFF).mean() > 0.99


def test_quality_rules_keep_good_documents(spark, sf_dir, documents):
    out = robust.judged(spark.createDataFrame(documents)).toPandas()
    base = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
    assert (out.base_failed == base).all() and not (out.base_failed & out.kept).any()
    known = out.merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    good = known[(known.quality == 1) & ~known.base_failed]
    assert good.kept.mean() > 0.99
    assert known[known.quality == 0].kept.mean() < 0.6


def test_an_outlier_in_each_single_statistic(spark):
    r = Random(5)

    def prose(n, least=3, most=7):
        return ["".join(r.choices("abcdefghijkl", k=r.randint(least, most))) for _ in range(n)]

    texts = [" ".join(prose(r.randint(150, 250))) for _ in range(100)]
    short, long = " ".join(prose(12)), " ".join(prose(5000))
    wide = " ".join(prose(200, 14, 18))
    symbols = " ".join(w + "#" * (k % 4 == 0) for k, w in enumerate(prose(200)))
    line = prose(2)
    dup_lines = "\n".join([" ".join(prose(1) + line[:1])] + [" ".join(prose(6)) + "\n" + line[1] for _ in range(28)])
    # 38 of 200 words in repeated windows of five
    again = prose(19)
    repeated = " ".join(again + prose(162) + again)
    odd = [short, long, wide, symbols, dup_lines, repeated]
    df = frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts + odd)])
    out = robust.judged(df).toPandas().set_index("doc_id").sort_index()
    assert not out.base_failed.any() and out.loc[105, "n_repeat_words"] == 38
    assert out.loc[:99, "kept"].mean() > 0.98 and not out.loc[100:, "kept"].any()


# ---- repeated strings


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_like_all_windows(spark, seed):
    random = Random(seed)

    def prose(n):
        return " ".join("".join(random.choices("abcdeéf", k=random.randint(1, 9))) for _ in range(n))

    shared = [prose(random.randint(40, 200)) for _ in range(3)]
    texts = [None, "", "ab " * 300, "x" * 399, "x" * 400, prose(300), prose(300)]
    for _ in range(14):
        parts = [prose(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            s = random.choice(shared)
            a = random.randint(0, len(s) // 2)
            parts += [s[a : a + random.randint(200, 1200)], prose(random.randint(0, 40))]
        texts.append(" ".join(parts))
    texts.append(texts[-1])
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "x" * 500), (None, texts[-2]), (None, None)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    want = []
    for (i, t), mask in zip(rows, repeat_mask([t for _, t in rows], 400), strict=True):
        data = (t or "").encode()
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(1 for part in bytes(mask).split(b"\0") if part)
        want.append((-1 if i is None else i, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(tuple(r) for r in got.itertuples(index=False)) == sorted(want)


def test_repeats_of_documents_and_nothing(spark, documents, none):
    some = documents[["doc_id", "text"]].iloc[:300]
    got = repeats.without_repeats(spark.createDataFrame(some), text=True).toPandas().set_index("doc_id")
    for (i, t), mask in zip(some.itertuples(index=False), repeat_mask(some["text"], 400), strict=True):
        assert got.loc[i, "n_removed"] == sum(mask)
        assert bytes(got.loc[i, "kept"]) == bytes(b for b, m in zip(t.encode(), mask, strict=True) if not m)
    assert repeats.without_repeats(none).collect() == []


def test_a_long_text_goes_in_stretches(monkeypatch):
    r = np.random.default_rng(1)
    buf = r.integers(97, 123, 20_000).astype(np.uint8)
    whole = repeats.anchors(buf, np.array([0, len(buf)]))
    monkeypatch.setattr(repeats, "_SLICE", 3000)
    parts = list(repeats._of_slice(buf, np.array([0, len(buf)])))
    owned = lambda f: {(s, p) for a, b, p in zip(f["a"], f["b"], f["p"], strict=True) for s in range(a, b + 1)}
    assert set().union(*map(owned, parts)) == owned(whole)


def test_anchors_are_found_once(spark, documents, tmp_path, monkeypatch):
    found, seen = repeats.sampled, str(tmp_path)

    def noted(batches):
        with tempfile.NamedTemporaryFile(dir=seen, delete=False):
            yield from batches

    def counted(docs):
        made = found(docs)
        return made.mapInArrow(noted, made.schema)

    monkeypatch.setattr(repeats, "sampled", counted)
    some = spark.createDataFrame(documents[["doc_id", "text"]].iloc[:60]).coalesce(1)
    assert len(repeats.without_repeats(some).collect()) == 60
    assert len(list(tmp_path.iterdir())) == 1


def test_anchors_of_many_texts_are_those_of_each():
    r = np.random.default_rng(2)
    sizes = [0, 399, 400, 5000, 0, 401, 3, 2500, 1200, 0]
    texts = [r.integers(97, 100, n).astype(np.uint8) for n in sizes]
    texts[8][:] = 97
    together = repeats.anchors(np.concatenate(texts), np.cumsum([0, *sizes]))
    for k, text in enumerate(texts):
        alone = repeats.anchors(text, np.array([0, len(text)]))
        own = together["row"] == k
        assert own.any() == (alone is not None)
        for name in "abpgc" if alone else "":
            assert together[name][own].tolist() == alone[name].tolist()
        # every window has one anchor, the first of the least 32-byte strings in it
        owned = [s for a, b in zip(together["a"][own], together["b"][own], strict=True) for s in range(a, b + 1)]
        assert owned == list(range(len(text) - 399))
    assert together["p"][together["row"] == 8].tolist() == together["a"][together["row"] == 8].tolist()


# ---- quality classifier


def test_classifier_on_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = bytenet.trained(docs, labels)
    out = bytenet.scored(docs, net).select("doc_id", bytenet.held_out().alias("held_out"), "score", "predicted").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    known = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    rank = known.score.rank()
    good = known.quality == 1
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.9 and known[good].predicted.mean() > 0.95


def test_classifier_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (8, 1, 0), (12, 0, 0), (9, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    net = bytenet.trained(odd, labels)
    out = bytenet.scored(odd, net)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    empty = {r["score"] for r in out.where("text is null or text = ''").collect()}
    assert len(empty) == 1 and bytenet.scored(none, net).collect() == []
    assert bytenet.accepted(odd, net).columns == odd.columns
    unlabelled = bytenet.trained(odd, labels.limit(0))
    assert {r["score"] for r in bytenet.scored(odd, unlabelled).collect()} == {0.5}


def test_a_pattern_at_any_place_is_seen():
    net = bytenet.Net.fresh()
    for j, b in enumerate(b"needle"):
        net.table[j, :, 0] = -5
        net.table[j, b, 0] = 5
    net.weight[:] = 0
    net.weight[0] = 1
    texts = [b"." * k + b"needle" + b"." * 100 for k in range(0, 200, 7)] + [b"." * 300, b"xxxx", b""]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    score = net.score(np.frombuffer(b"".join(texts), np.uint8), at)
    assert (score[:-3] > 0.99).all() and (score[-3:] == 0.5).all()


# ---- mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        share = {s: most * sizes[s] if s in capped else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in capped and share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share
        capped |= over


def test_mixing_of_documents(spark, documents):
    docs = spark.createDataFrame(documents)
    out = mixing.plan(docs).toPandas()
    assert (out["size"] == out["doc_id"].map({i: len(words(t)) for i, t in zip(documents.doc_id, documents.text, strict=True)})).all()
    per = out.groupby("source").agg(size=("size", "sum"), one=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    want = plain_targets(per["size"].to_dict())
    assert (per["size"] == per["one"]).all() and np.allclose(per["target"], per.index.map(want))
    assert (abs(per["taken"] - per["target"]) <= 0.02 * per["target"]).all()
    assert (out["taken"] <= 3 * out["size"]).all() and (abs(out["copies"] - out["rate"]) < 1).all()
    # the tilt is exponential: logarithms of rates are a line through the origin in the size
    for _, x in out[(out["rate"] < 2.99) & (out["rate"] > 0.01) & (out["size"] > 0)].groupby("source"):
        slope = np.log(x["rate"]) / x["size"]
        heavy = slope[x["size"] > 100]
        assert heavy.max() - heavy.min() < 0.02 * abs(heavy).max() + 1e-6
    again = mixing.plan(docs.repartition(5)).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    mixed = mixing.mixed(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert mixed == {r.doc_id: r.copies for r in out.itertuples() if r.copies}


def test_mixing_odd_rows(odd, none):
    out = mixing.plan(odd).toPandas()
    assert len(out) == odd.count() and (out["taken"] <= 3 * out["size"]).all()
    sizes = out.assign(source=out["source"].astype(object).where(out["source"].notna(), None)).groupby("source", dropna=False)["size"].sum()
    want = plain_targets({None if pd.isna(k) else k: int(v) for k, v in sizes.items()})
    got = {None if pd.isna(r.source) else r.source: r.target for r in out.itertuples()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert mixing.plan(none).collect() == [] and mixing.mixed(none).collect() == []
    assert mixing.mixed(odd).columns == odd.columns


# ---- near duplicates


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates_of_documents(spark, documents, n, percent):
    got = minhash.near_duplicates(spark.createDataFrame(documents), minhash.Near(words=n, percent=percent)).toPandas()
    want = linked_groups(documents[["doc_id", "text"]].itertuples(index=False), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()


def test_chains_and_large_buckets(spark):
    """A chain of small edits is one group although its ends differ; a bucket is larger than a block."""
    r = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows, text = [], list(r.choice(vocabulary, 120))
    for k in range(60):
        rows.append((k, " ".join(text)))
        text[(7 * k) % 120] = f"n{k}"
    base = list(r.choice(vocabulary, 100))
    for k in range(400):
        own = base.copy()
        for at in r.integers(0, 100, r.integers(0, 9)):
            own[at] = f"e{k}-{at}"
        rows.append((1000 + k, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Near(3, 85)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked_groups(rows, 3, 85)


def test_estimate_from_bit_counts(spark):
    near = minhash.Near(3, 85)
    a = np.unique(tb.mix(np.arange(1000, dtype=np.uint64)))
    for share in (0.3, 0.6, 0.9):
        b = np.concatenate((a[: int(1000 * share)], tb.mix(np.arange(5000, 6000 - int(1000 * share), dtype=np.uint64))))
        packed = [minhash._signature(x, near)[1].tolist() for x in (a, b)]
        df = spark.createDataFrame([tuple(packed)], "p array<long>, q array<long>")
        got = df.select(near.estimate(minhash._equal_low_bits(near, "p", "q"))).first()[0]
        true = share * 1000 / (2000 - share * 1000)
        assert abs(got - true) < 0.13


def test_near_duplicates_odd_rows(odd, none):
    out = minhash.near_duplicates(odd, minhash.Near(3, 85)).toPandas()
    assert len(out) == odd.count()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.dropna(subset=["doc_id"]).itertuples()}
    assert by_id[1][1:] == (1, True) and by_id[3][1:] == (1, False) and by_id[4][1:] == (1, False)
    assert by_id[2][1:] == (1, False) and by_id[9] == (1, 8, False) and by_id[8] == (1, 8, True)
    assert by_id[5] == (0, 5, True) and by_id[6] == (0, 6, True) and by_id[7] == (0, 7, True)
    kept = minhash.first_of_each(odd, minhash.Near(3, 85))
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 1
    assert minhash.near_duplicates(none).collect() == []
