"""Learned operators: gradients, held-out accuracy on small corpora, and the defined cases."""

import numpy as np
from pyspark.sql import functions as F

from evidence_engine.llm import html, mtree, quality, toxicity
from evidence_engine.llm import nets as N


def corpus(rows=240, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "the an er on in".split() for b in "ly ed ing st".split()]
    out = []
    for i in range(rows):
        w = list(rng.choice(words, int(rng.integers(20, 90))))
        bad, junk = i % 4 == 0, i % 3 == 0
        if bad:
            w.insert(int(rng.integers(len(w))), str(rng.choice(["idiotly", "idioted", "scum"])))
        out.append((i, " ".join(x + "!!" if junk else x for x in w), int(bad), int(not junk)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(9001, None), (9002, ""), (9003, "x " * 4000), (9003, "x " * 4000), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows] + [(9001, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_rules(spark):
    docs, labels = frames(spark, corpus())
    model = quality.trained(docs, labels)
    assert 0 < len(model[1]) < 60
    got = quality.scored(docs.withColumn("words", F.lit("clash")), model).withColumn("held", quality.S.crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    want = {i: q for i, _, _, q in corpus()}
    held = [(r.score >= 0.7) == want[r.doc_id] for r in got if r.held and r.doc_id in want]
    assert len(held) > 20 and np.mean(held) == 1.0
    assert len({r.score for r in got if r.doc_id == 9003}) == 1
    x = quality.with_statistics(docs).toPandas()[[quality.PREFIX + s for s in quality.STATS]].to_numpy()
    one = np.full(len(x), model[0])
    for w, rule in model[1]:
        one += w * quality.holds(rule, x)
    assert np.allclose(sorted(1 / (1 + np.exp(-one))), sorted(r.score for r in got))


def test_quality_without_labels(spark):
    docs, labels = frames(spark, corpus(20))
    assert {r.score for r in quality.scored(docs, quality.trained(docs, labels.limit(0))).collect()} == {0.5}
    assert len({r.score for r in quality.scored(docs, quality.trained(docs, labels.where("quality = 1"))).collect()}) == 1
    assert quality.scored(docs.limit(0), (0.0, [])).isEmpty()


def test_toxicity_learns_words_and_stems(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    model = toxicity.fitted(docs, labels)
    got = toxicity.scored(docs.withColumn("score", F.lit("clash")), model).withColumn("held", quality.S.crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    want = {i: t for i, _, t, _ in rows}
    held = [(r.score >= 0.3) == want[r.doc_id] for r in got if r.held and r.doc_id in want]
    assert len(held) > 40 and np.mean(held) > 0.95
    assert toxicity.scored(docs.limit(0), model).isEmpty()
    late = "the anly " * 3000 + "idiotly"
    data = late.encode()
    assert model.scores(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] > 0.3  # whole texts, to the last window
    assert {r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0))).collect()} == {0.5}


def test_toxicity_gradients(monkeypatch):
    monkeypatch.setattr(N, "F4", np.float64)
    rng = np.random.default_rng(0)
    m = toxicity.Network(rng)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    raw = [b"the idiot said hello to abc", "déjà vu of words".encode(), b"xy"]
    w = toxicity.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    _, begin, length = toxicity.windows(w.first)
    y = np.array([1.0, 0, 1])

    def forward(kc=None, kw=None):
        x = np.zeros((len(w.hash), toxicity.INPUTS))
        x[:, : toxicity.CHAR_OUT] = m.chars(w.bytes, w.length, kc)
        x[:, toxicity.CHAR_OUT :] = m.p["we"][(w.hash % np.uint64(toxicity.BUCKETS)).astype(int)]
        return m.windows(x, w.place, begin, length, kw)

    loss = lambda: float((np.log1p(np.exp(z := forward())) - y * z).sum())
    kc, kw, g = {}, {}, {}
    dx = m.windows_back(N.sigmoid(forward(kc, kw)) - y, kw, g)
    m.chars_back(dx[:, : toxicity.CHAR_OUT], kc, g)
    for n, grad in g.items():
        i = tuple(int(rng.integers(s)) for s in m.p[n].shape)
        i = (ord("i"), i[1]) if n == "ce" else i
        old = m.p[n][i]
        m.p[n][i] = old + 1e-5
        up = loss()
        m.p[n][i] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - grad[i]) < 1e-6
        m.p[n][i] = old


def test_blocks_of_broken_markup():
    page = "<!doctype html><title>t</title><style>p{}</style><script>var a='</p>';</script><body><nav><ul><li><a href='/x>y'>Menu<li>Two</ul></nav><!-- c --><article><h1>Head&amp;line</h1><p>One <b>bold<br>line<p>T&#119;o\n  x</p><table><tr><td>c1<td>c2</table></article><footer>&copy; f"
    assert [b.text for b in html.blocks(page)] == ["Menu", "Two", "Head&line", "One bold line", "Two x", "c1", "c2", "© f"]
    assert html.blocks("") == [] and html.blocks("<<<") != [] and html.blocks("plain")[0].text == "plain"
    deep = "<div>" * 5000 + "x"
    assert html.blocks(deep)[0].text == "x"


def test_main_text(spark, sf):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = pages.limit(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("html")).unionByName(pages.limit(1).select(F.lit(-2).cast("long").alias("page_id"), "url", F.lit("<nav><a href=x>Menu</a></nav>").alias("html")))
    got = {r.page_id: r.text for r in html.extracted(pages.unionByName(more).withColumn("text", F.lit("clash"))).collect()}
    assert html.extracted(pages.limit(0)).isEmpty()
    assert got[-1] == "" and got[-2] == ""

    def truth(h):
        a = h[h.index("<article>") + 9 :]
        a = a[: a.find("</article>")] if "</article>" in a else a
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("<p>|</p>|<h1>|</h1>", a))
        return "\n\n".join(p for p in parts if p)

    same = [got[r.page_id] == truth(r.html) for r in pages.collect()]
    assert np.mean(same) == 1.0


def test_main_text_of_other_layouts():
    rng = np.random.default_rng(77)
    model = html.trained([], generated_pages=400, epochs=5)
    pages = [html.generated(rng, ["alpha", "beta", "gamma", "delta"]) for _ in range(100)]
    hits = [a == b for out, (_, want) in zip(model.label([p for p, _ in pages]), pages) for a, b in zip(out, want)]
    assert np.mean(hits) > 0.96


def test_main_text_of_hard_pages(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(50).collect()]
    model = html.trained(pages)
    body = "<h1>Head of it</h1><p>First paragraph of the text, of some length.</p><p>Second one, of some length too.</p>"
    want = ["Head of it", "First paragraph of the text, of some length.", "Second one, of some length too."]

    def text(page):
        found = html.blocks(page)
        return [b.text for b, yes in zip(found, model.label([found])[0]) if yes]

    nav, foot = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>", "<footer>© 2020 someone</footer>"
    for out, within in ((5, 11), (8, 11), (30, 11), (0, 0), (40, 40)):
        assert text(f"<body>{nav}{'<div>' * out}<article>{'<div>' * within}{body}{'</div>' * within}</article>{'</div>' * out}{foot}") == want
    assert text(f"<body>{nav}<article>{body}<div class=comments><p>I do not agree at all.</p><div><div><p>Nor do I, said another.</p></div></div></div></article>{foot}") == want
    deep = f"<body>{nav}<article>{body}<section class='comments'>{'<div>' * 30}<p>A deep reply.</p>{'</div>' * 30}</section></article>{foot}"
    assert text(deep) == want
    assert text(f"<body>{nav}<article>{body}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds here.</p><select><option>pick</select></article>{foot}") == [*want, "So x=1 holds here."]
    assert text(f"<body>{nav}<main>{body}</main>{foot}") == want
    assert [b.text for b in html.blocks("İİİİ<script>if (a</b) x</SCRIPT>after<style>p</style> it")] == ["İİİİafter it"]
    many = html.blocks("<article>" + "<p>word after word</p>" * 100_000)
    assert len(many) == 100_000 and np.mean(model.label([many])[0]) > 0.99
    long = "<div class=" + "z" * 100_000 + "><p>x"
    assert html.blocks(long)[0].text == "x"
    out = model.label([[], html.blocks(body)])
    assert out[0] == [] and len(out[1]) == 3


def test_toxic_passages_across_window_borders():
    rng = np.random.default_rng(4)
    texts, y = zip(*((t, bad) for _, t, bad, _ in corpus(400)))
    model = toxicity.trained(list(texts), np.array(y))
    for at in range(0, 70, 3):
        w = list(rng.choice(["the", "anly", "oned", "ering"], 80))
        w[at : at + 2] = ["idiotly", "scum"]
        raw = " ".join(w).encode()
        assert model.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] >= 0.3
    row, begin, length = toxicity.windows(np.array([0, 100]))
    assert begin.tolist() == [0, 16, 32, 48, 64, 80] and (begin + length).max() == 100  # each window begins in the middle of the one before


def test_mtree_is_exact(spark):
    rng = np.random.default_rng(2)
    v = [[float(x) for x in rng.standard_normal(6)] for _ in range(150)]
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(200 + i, v[3], 0) for i in range(60)] + [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (350, [0.5, 0.25], 1), (351, [], 1), (0, v[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit("clash")).withColumn("block", F.lit(1))
    points = mtree.quantised(df)
    got = {}
    for r in mtree.top_k(points, points.where("id % 50 = 0"), 5, block=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(256 * c)) for c in x] for i, x, _ in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert mtree.top_k(points.limit(0), points.limit(0), 5).isEmpty()
