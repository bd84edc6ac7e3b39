"""Exact top-k against all products, page extraction against known pages, and the pipeline stage by stage."""

import re

import numpy as np
import pandas as pd
import pytest
from corpus import frame, linked_groups, odd_rows

import corpus_pipeline
from verdance.llm import minhash, queries, topk, wrapper

# ---- exact top-k


def plain_top_k(rows, every, k):
    """rows: (vec_id, vector or None)."""
    own = {
        (i, tuple(np.floor(np.float32(v).astype(float) * 256).astype(int).tolist()))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    }
    best = {}
    for i, v in own:
        if i % every:
            continue
        for j, w in own:
            if j != i and len(v) == len(w):
                best.setdefault(i, set()).add((-sum(a * b for a, b in zip(v, w, strict=True)), j))
    return sorted((i, r + 1, j, -s) for i, found in best.items() for r, (s, j) in enumerate(sorted(found)[:k]))


def check_top_k(spark, rows, every=50, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df.repartition(3), every, k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(rows, every, k)


def test_top_k_of_embeddings(spark, sf_dir):
    df = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    check_top_k(spark, [(int(i), [float(x) for x in v]) for i, v in zip(df.vec_id, df.embedding, strict=True)])


def test_top_k_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(2)
    same = [0.5, -0.25, 1.0]
    rows = [(k, same) for k in range(0, 60)] + [(k, same) for k in range(0, 60, 7)]
    rows += [(100 + k, [float(x) for x in r.normal(size=3)]) for k in range(80)]
    rows += [(200, None), (210, [1.0, None, 2.0]), (220, [float("nan"), 1.0, 1.0]), (230, [float("inf"), 0.0, 0.0])]
    rows += [(240, []), (250, [1.0, 2.0]), (251, [3.0, -1.0]), (260, [0.0, 0.0, 0.0]), (None, same), (-10, [-9.0, 3.0, 1.0])]
    check_top_k(spark, rows, every=10)


def test_top_k_of_huge_and_no_vectors(spark):
    rows = [(k, [float(x) for x in np.random.default_rng(k).normal(size=4) * 4e4]) for k in range(30)]
    check_top_k(spark, rows, every=10, k=3)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pruning_keeps_what_matters():
    r = np.random.default_rng(4)
    v = np.floor(256 * r.normal(size=(3000, 16)) * np.geomspace(1, 0.01, 16)).astype(float)
    v = v[np.argsort(-(v**2).sum(axis=1))]
    ids, q = np.arange(3000), v[::100]
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    best = topk._search(ids[::100], q, np.full(len(q), -np.inf), ids, v, turn, 5)
    for k in range(len(q)):
        score = v @ q[k]
        want = [i for i in np.lexsort((ids, -score)) if i != 100 * k][:5]
        assert best.id[best.q == k].tolist() == want


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies</div><header><a href="/">Site</a></header>
<ul class="menu"><li><a href="/a">A{k}</a><li><a href="/b">B</a></ul>
<{tag} class="content"><h1>Title &amp; {k}</h1><p>First <b>bold{k}<br>line<p>Second&nbsp;one &lt;{k}&gt;
  wraps <script>var a = "</p>";</script>on<ul><li>x{k}<li>y{k}</ul><div class="share">Share this</div>
<p class="boiler">Read our terms</p><pre>a{k}
b</pre></{tag}><div class="ad">Buy {k}</div><section id="comments"><article class="comment"><p>nice {k}</article></section>
<form><label>Mail</label><input></form><aside>other</aside><!-- <p>no</p> --><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_pages_of_one_host(spark, tag):
    rows = [(k, f"https://www.Host.org:80/p/{k}?x", PAGE.format(k=k, tag=tag)) for k in range(30)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    for r in got.itertuples():
        k = r.page_id
        want = f"Title & {k}\nFirst bold{k} line\nSecond one <{k}> wraps on\nx{k}\ny{k}\na{k} b"
        assert r.text == want and r.n_chars == len(want) and r.url == rows[k][1]


def test_pages_of_the_table(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = wrapper.main_text(spark.createDataFrame(pages)).toPandas().set_index("page_id")
    import html

    for r in pages.itertuples():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got.loc[r.page_id, "text"] == "\n".join(b for b in blocks if b)


def test_odd_pages(spark):
    article = "<article><p>same text on all pages</p></article>"
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/1", "no markup"), (4, "http://h/2", "<p>a < b & c <p>d <"), (4, "http://h/2", "<p>a < b & c <p>d <")]
    rows += [(10 + k, f"http://copies/{k}", article) for k in range(6)] + [(None, None, "<p>x</p>"), (20, "http://l/", "<div>" * 400 + "deep")]
    rows += [(30, "http://u/", "<article><p>open <!-- never closed <p>gone"), (31, "http://u/", "<article><p>q<a title='x>y</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = wrapper.main_text(df).toPandas()
    text = {int(r.page_id): r.text for r in got.dropna(subset=["page_id"]).itertuples()}
    assert len(got) == len(rows) and text[1] == text[2] == "" and text[3] == "no markup" and text[4] == "a < b & c\nd <"
    assert all(text[10 + k] == "same text on all pages" for k in range(6))
    assert text[20] == "deep" and text[30] == "open"
    assert wrapper.main_text(df.limit(0)).collect() == []


def extracted(spark, rows):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in wrapper.main_text(df).orderBy("page_id").collect()]


def test_a_constant_paragraph_among_varying_ones(spark):
    rows, want = [], []
    for tag, least in (("article", 20), ("div", 4)):
        for n in (4, 19, 20, 30):
            for k in range(n):
                rows.append((f"http://{tag}{n}/{k}", f"<{tag}><p>one {k}<p>Read our terms<p>two {k}</{tag}>"))
                want.append(f"one {k}\nRead our terms\ntwo {k}" if n < least else f"one {k}\ntwo {k}")
    # mostly copies
    for k in range(40):
        rows.append(("http://copies/", f"<div><p>text {max(k, 36)}<p>Read our terms</div>"))
        want.append(f"text {max(k, 36)}")
    # many constant ones, and others that rotate
    for k in range(40):
        rows.append(("http://many/", "<div>" + "".join(f"<p>terms {c}" for c in range(9)) + f"<p>buy {k % 4}<p>text {k}</div>"))
        want.append(f"buy {k % 4}\ntext {k}")
    assert extracted(spark, rows) == want


@pytest.mark.parametrize("n", [1, 3, 30])
def test_hints_do_not_cut_most_of_a_page(spark, n):
    wraps = ["<form>{}</form>", '<div class="with-sidebar">{}</div>', '<div id="widget-page">{}</div>', '<form><div class="no-comments">{}</div></form>']
    wraps += ['<article><h1>a</h1><div class="has-sidebar">{}</div></article>', '<div style="display:none">{}</div>']
    rows, want = [], []
    for w, wrap in enumerate(wraps):
        for k in range(n):
            body = f"<p>a first long text with the number {k} in it<p>the second with {k}<nav>to {k}</nav><div class=ad>buy {k}</div>"
            rows.append((f"http://w{w}/{k}", wrap.format(body)))
            title = "a\n" * (w == 4 and n < 20)
            want.append(f"{title}a first long text with the number {k} in it\nthe second with {k}")
    for k in range(n):  # mostly links, and groups none of which holds most
        rows.append((f"http://links/{k}", f"<ul><li><a>the one {k}</a><li><a>another {k}</a></ul><p>see {k}"))
        want.append(f"the one {k}\nanother {k}\nsee {k}")
        rows.append((f"http://parts/{k}", f"<form>same {k}</form><aside>size {k}</aside>"))
        want.append(f"same {k}\nsize {k}")
    assert extracted(spark, rows) == want


def test_thousands_of_nested_elements(spark):
    opened = ["<div>" * 5000, "<blockquote>" * 5000, "<article>" + "<section>" * 5000, "<form>" * 5000, "<div class=menu>" * 5000]
    rows = [("http://deep/", f"{tags}deep {k}") for k, tags in enumerate(opened)]
    rows += [("http://deep/", "<div>" * 4990 + "<p>x" + "<div>" * 20 + "end")]
    assert extracted(spark, rows) == [f"deep {k}" for k in range(5)] + ["x\nend"]


def test_tree_matching_is_the_largest():
    assert wrapper.aligned("a(b(c d) e)", "a(b(d) x e)") == [0, 1, -1, 2, 4]
    assert wrapper.aligned("a(x b)", "a(b x(y z))") in ([0, 2, -1], [0, -1, 1])
    assert wrapper.aligned("a(b)", "c(b)") == [-1, -1]


# ---- pipeline


def stages(spark, docs, sf_dir, tmp_path):
    out, docs = [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_a_stage_gives_back_the_disk_of_those_before(spark, sf_dir, tmp_path):
    """Tables behind a written result go when a later stage begins; those of the same stage stay."""
    import os

    docs = frame(spark, odd_rows())
    folders = {}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        twice = [stage(spark, docs, sf_dir) for _ in range(2)]
        folders[name] = [p.removeprefix("file:") for p in corpus_pipeline._written[name]]
        for k, out in enumerate(twice):
            out.write.parquet(str(tmp_path / f"{name}{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{name}0"))
    assert all(folders.values())
    for name in ("line_dedup", "near_dedup"):
        assert not any(os.path.exists(p) for p in folders[name]) and name not in corpus_pipeline._written
    assert all(os.path.exists(p) for p in folders["mix"])


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "pack"]


def test_pipeline_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good, lined, single, mixed, packed = stages(spark, docs, sf_dir, tmp_path)
    assert good.columns == lined.columns == single.columns == mixed.columns == docs.columns
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    clean = set(labels[labels.quality == 1].doc_id)
    assert len(clean & ids) > 0.97 * len(clean) and len(set(labels[labels.quality == 0].doc_id) & ids) < 12
    # near dedup: the smallest doc_id of each group of its own input
    rows = [(r["doc_id"], r["text"]) for r in lined.collect()]
    want = {i for i, (_, top) in linked_groups(rows, 5, 80).items() if i == top}
    assert {r["doc_id"] for r in single.collect()} == want
    copies = mixed.groupBy("doc_id").count().toPandas()
    assert set(copies.doc_id) <= want and copies["count"].max() <= 3
    pieces = packed.toPandas()
    assert set(pieces.doc_id) == set(copies.doc_id)
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096


def test_pipeline_odd_rows_and_nothing(spark, sf_dir, tmp_path):
    odd = frame(spark, odd_rows())
    assert len(stages(spark, odd, sf_dir, tmp_path / "odd")) == 5
    assert stages(spark, odd.limit(0), sf_dir, tmp_path / "none")[-1].count() == 0


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 14))
    assert minhash.Near().words == 5 and minhash.Near().percent == 80
