"""Hard negatives, whitening and page extraction against brute force and on small tables."""

import html
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import dom, extract, negatives, queries, whitening

SF = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")
KIND = "vec_id long, embedding array<float>, label int, anchor string, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], KIND)


def random_rows(n, size, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=size) / 4], int(rng.integers(0, 3))) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 3) for i in range(copies)]


ODD = [(None, [0.5, 0.25, 0.0], 1), (900, None, 1), (1000, [0.5, None, 0.1], 1), (1100, [0.5, NAN, 0.1], 1), (1200, [INF, 0.1, 0.1], 1), (1300, [0.5, 0.1, 0.1], None), (1400, [], 2), (1500, [1.0], 2)]


def hardest(rows, size):
    """(anchor, positive, rank, negative, both scores) by comparing all."""
    kept = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if k is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for anchor, a, k in kept:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v, strict=True)), last(i), i, own == k) for i, v, own in kept if i != anchor), key=lambda s: s[:2])
        for p, _, positive, _ in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(anchor, positive, rank, s[2], -p, -s[0]) for rank, s in enumerate(fits[:5], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [200, 8_000_000])
@pytest.mark.parametrize(("n", "copies"), [(450, 0), (230, 150)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, copies, block):
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "HELD", 100)
    rows = random_rows(n, 3, n, copies) + ODD
    found = negatives.index(vectors(spark, rows), F.col("vec_id") % 100 == 0, pivots=4, sample=50)
    out = negatives.mine(found, block_bytes=block).collect()
    got = [(r.anchor_id, None if r.positive_id == negatives.NO_ID else r.positive_id, r["rank"], None if r.negative_id == negatives.NO_ID else r.negative_id, r.positive_score, r.negative_score) for r in out]
    assert sorted(got, key=repr) == hardest(rows, 3) and got


def test_brackets_hold(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (400, 6))
    top = int((x * x).sum(1).max())
    pivots = negatives.choose_pivots(x[:50], top, 5)
    far = np.sqrt(np.maximum(2.0 * (top - x @ pivots.T - np.sqrt((top - (x * x).sum(1)).astype(float))[:, None] * np.sqrt((top - (pivots * pivots).sum(1)).astype(float))), 0))
    block = negatives.Anchors(np.arange(30), np.zeros(30, int), x[:30], pivots, top)
    exact = x[:30] @ x.T
    low, high = block.bounds(np.arange(30), far)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < exact.max(1, keepdims=True)).any()  # they do rule rows out
    low, high = block.run_bounds(far[:40].min(0), far[:40].max(0))
    assert (low <= exact[:, :40].min(1)).all() and (exact[:, :40].max(1) <= high).all()


def test_negatives_of_repeated_rows_and_empty_tables(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 2), (3, [0.8, 0.0], 2), (200, [-1.0, 0.0], 3)]
    out = negatives.mine(negatives.index(vectors(spark, rows), F.col("vec_id") % 100 == 0)).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in out) == [(100, 1, 1, 2), (100, 1, 1, 2), (100, 1, 2, 3), (100, 1, 2, 3)]
    assert negatives.index(vectors(spark, []), F.lit(True)) is None
    assert negatives.mine(negatives.index(vectors(spark, rows), F.lit(False))) is None
    with pytest.raises(Exception, match="beyond"):
        negatives.index(vectors(spark, [(1, [1e9], 1)]), F.lit(True))


def whitened(rows):
    """n, deviations by place, variances and whitened components by numpy."""
    x = np.floor(1024 * np.array([v for _, v, _ in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    deviation = [sum(int(e) ** 2 for e in row) for row in (n * x - sums)]
    c = (n * x - sums) / n
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    return n, deviation, values[::-1], c @ vectors_[:, ::-1]


@pytest.mark.parametrize("fan", [2, 16])
@pytest.mark.parametrize(("n", "size"), [(300, 12), (300, 3), (5, 12)])
def test_whitening_equals_eigenvectors(spark, n, size, fan):
    rows = random_rows(n, size, size)
    odd = [x for x in ODD if x[1] is None or any(e is None or not math.isfinite(e) for e in x[1])]
    found, model, d = whitening.fit(vectors(spark, rows + odd + [(7, [], 1)]).repartition(9), fan=fan)
    n_, deviation, e, projected = whitened(rows)
    assert model.n == n_ and d == size and whitening.identity_error(found, model, d) < 1e-4
    out = {r.vec_id: r for r in whitening.whiten(found, model, d).collect()}
    assert len(out) == n and "cell" in out[0].asDict()
    real = min(8, size, n - 1)
    got = np.array([[x if x is not None else NAN for x in out[i]._tw_whitened] for i in range(n)])
    assert got.shape[1] == min(8, size) and np.isnan(got[:, real:]).all()
    want = projected[:, :real] / np.sqrt(e[:real])
    assert all(min(np.abs(got[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-6 for k in range(real))
    assert [int(out[i]._tw_deviation) for i in range(n)] == deviation
    assert np.abs(model.explained[:real] - (e / e.sum())[:real]).max() < 1e-9


def test_whitening_of_one_row_equal_rows_and_none(spark):
    for rows in ([(1, [0.1, 0.2], 0)], [(i, [0.1, 0.2], 0) for i in range(4)]):
        found, model, d = whitening.fit(vectors(spark, rows))
        assert whitening.identity_error(found, model, d) is None
        assert all(list(r._tw_whitened) == [None, None] and r._tw_deviation == 0 for r in whitening.whiten(found, model, d).collect())
    found, model, d = whitening.fit(vectors(spark, []))
    assert model is None and d == 0 and whitening.whiten(found, model, d).count() == 0


def test_op12_whitens_the_table(spark):
    out = queries.QUERIES["op12_tsqr_whitening"](spark, SF)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, e, projected = whitened([(r.vec_id, r.embedding, r.label) for r in table])
    place = {r.vec_id: i for i, r in enumerate(table)}
    got = np.full((n, 8), NAN)
    for r in out.collect():
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[place[r.vec_id]] and abs(r.explained * e.sum() / e[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-4
    assert all(min(np.abs(got[:, k] - s * projected[:, k] / np.sqrt(e[k])).max() for s in (1, -1)) < 1e-8 for k in range(8))


def article(page):
    """The blocks of a test page's article, by its known template."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_op13_extracts_every_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.QUERIES["op13_boosted_extraction"](spark, SF).collect()
    assert len(out) == len(pages) and {r.page_id: r.text for r in out} == {i: article(r.html) for i, r in pages.items()}
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in out)


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


PROSE = "The river carries sand and stones from the hills, and it leaves them where the water is slow. "


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div class=wrap>%s</div></main>", "<div class='post entry-content'>%s</div>", "<div id=main-content><section>%s</section></div>"])
def test_pages_of_other_layouts(model, wrap):
    body = f"<h1>Rivers &amp; sand</h1><p>{PROSE * 2}<p>{PROSE}<br>More\n of it.</p><aside class=related><h3>Related</h3><ul><li><a href=1>Lakes</a><li><a href=2>Seas</a></ul></aside><p>{PROSE}</p>"
    page = (
        "<!doctype html><html><head><title>no</title><style>p{}</style></head><body><header class=site-header><a href=/>Name</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>"
        "<div class=cookie-notice><p>We use cookies, as all do, to learn what you read.</p><button>Fine</button></div>" + wrap % body + "<div class=sidebar><h3>Most read</h3><ul><li><a href=/c>C</a></li></ul></div>"
        f"<section id=comments><h2>Comments</h2><div class=comment><p>{PROSE}I agree.</p></div></section><form class=search><label>Find<input></label></form><footer><p>&copy; Name</p></footer><script>if (a < b) x('</p>')</script></body></html>"
    )
    want = "\n".join(["Rivers & sand", (PROSE * 2).strip(), f"{PROSE.strip()} More of it.", PROSE.strip()])
    assert extract.texts([page], model) == [want]


def test_odd_pages(spark, model):
    odd = [None, "", "   ", "just text", "<p>a<p>b", "<div" * 5000, "</p></div>text</b>", "<p>x &am &lt;b&gt; &#233;&nbsp;&nbsp;y</p>", "<!-- never closed <p>x</p>", "<p title='a > b'>in</p>", "<div>" * 3000 + "deep", "<script>only"]
    df = spark.createDataFrame([(i, "u", x, "clash") for i, x in enumerate(odd)], "page_id long, url string, html string, text string")
    out = {r.page_id: r._tw_text for r in extract.extract(df, model).collect()}
    assert [out[i] for i in (0, 1, 2, 5, 8, 11)] == [""] * 6
    tree = dom.Tree()
    for x in odd:
        tree.add(x or "")
    assert [t for t in tree.text if t] == ["just text", "a", "b", "text", "x &am <b> é y", "in", "deep"]
    # Without a paragraph anywhere only what tags say is left.
    assert extract.train(df.limit(4)) is None and extract.texts(["<nav>m</nav><p>t</p><footer>f</footer>"], None) == ["t"]
    assert extract.extract(df.limit(0), None).count() == 0


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(3)
    for _ in range(200):
        tree = dom.Tree()
        tree.add("".join(rng.choice(["<div>", "</div>", "<p>a", "<ul><li>b", "</ul>", "text"]) for _ in range(rng.integers(1, 12))))
        odds = rng.normal(size=len(tree.parent)) * 3
        kept = extract.decode(tree, odds)
        n = len(kept)

        def allowed(k):
            for i in range(n):
                if k[i] and i and not k[tree.parent[i]]:
                    return False
                if k[i] and tree.text[i] is None and not any(k[j] for j in range(i + 1, n) if tree.parent[j] == i):
                    return False
            return True

        runs = [False] * n  # nodes with a run below them; the others count for nothing
        for i in range(n - 1, -1, -1):
            runs[i] = runs[i] or tree.text[i] is not None
            if runs[i] and i:
                runs[tree.parent[i]] = True
        assert allowed(kept)
        if sum(runs) <= 12:
            free = [i for i in range(n) if runs[i]]
            value = lambda k: sum(-np.logaddexp(0, -odds[i] if k[i] else odds[i]) for i in free)
            every = ([bool(m >> free.index(i) & 1) if runs[i] else False for i in range(n)] for m in range(1 << len(free)))
            assert value(kept) >= max(value(k) for k in every if allowed(k)) - 1e-9


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = extract.Boosted().fit(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) > 0) == y[2000:]).mean() > 0.95
