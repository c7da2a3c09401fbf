"""Vector and page operators against brute force."""

import collections
import math

import numpy as np
import pytest

from pulsepanel.llm import pivots, templates, vafile

SCHEMA = "vec_id long, embedding array<float>, label int, h1 long, v string, id long, rank int, file string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, "f") for r in rows], SCHEMA).repartition(3)


def vectors(n=400, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, (base[i] / np.linalg.norm(base[i])).tolist(), int(i % 3)) for i in range(n)]
    for i in range(0, 60):  # near copies, more and less near
        rows.append((1000 + i, (base[i] + rng.normal(size=dim) * 0.06 * (i % 5)).astype(np.float32).tolist(), int(i % 3)))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(50)]
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [1.0, None] + [0.5] * (dim - 2), 1), (3003, [float("nan")] * dim, 1),
             (3004, [float("inf")] + [1.0] * (dim - 1), 1), (3005, [], 1), (3006, rows[0][1], None), (None, rows[0][1], 0), (3007, [1.0, 0.0], 0), (3020, [2.0, 0.0], 0),
             (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    return rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("options", [{}, {"file_rows": 100, "query_rows": 7, "bits": 2}])
def test_top_k(spark, options):
    rows = vectors()
    whole = frame(spark, rows)
    got = collections.defaultdict(list)
    for r in vafile.top_k(whole, whole.where("vec_id % 20 = 0"), **options).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = [(i, [math.floor(64 * float(x)) for x in v]) for i, v, _ in rows if i is not None and good(v)]
    for q in {i for i, _ in ints if i % 20 == 0}:
        v = next(v for i, v in ints if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:20]
        assert sorted(got.pop(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert not got


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-90, 90, (300, 8))
    file = vafile.VAFile(np.arange(300), x, bits=3)
    q = rng.integers(-90, 90, (20, 8))
    low, high = file.bounds(q.astype(float))
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all() and (high - low).mean() < 8 * 90 * 30


@pytest.mark.parametrize("block, pivot_count", [(2048, 128), (16, 128), (16, 1)])
def test_near_duplicates(spark, block, pivot_count):
    rows = vectors()
    got = pivots.near_duplicates(frame(spark, rows), pivots=pivot_count, block=block).collect()
    assert len(got) == len(rows)
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and good(v) and any(v)]
    links = [[0.93 <= a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) if a[2] == b[2] and len(a[1]) == len(b[1]) and k != m else False
              for m, b in enumerate(ok)] for k, a in enumerate(ok)]
    n = {}
    for (i, _, _), row in zip(ok, links):
        n[i] = sum(row)
    found = {r.vec_id: r.n_links for r in got}
    assert all(found[i] <= n[i] for i in n)
    assert sum(found[i] for i in n) >= 0.9 * sum(n.values()) > 2000
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in n)
    assert {r.component_id for r in got if r.vec_id is not None and r.vec_id >= 2000 and r.vec_id < 2050} == {5}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x = pivots.unit(np.array([r.embedding for r in rows], float))
    label = np.array([r.label for r in rows])
    n = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df).collect()}
    found = np.array([got[r.vec_id] for r in rows])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()


def test_empty_vectors(spark):
    none = frame(spark, vectors(80)).where("vec_id < 0")
    assert vafile.top_k(none, none).count() == 0 and pivots.near_duplicates(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
<body class="ad-free header"><form action=x><header>Site</header><nav><ul><li><a href="/a">A<li>B</ul></nav><div class="cookie-notice">Cookies!</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One  <b>bold\n text<br>after</b> 5 &lt; 6 &copy; x<p>Two&nbsp;words</p><!-- <p>hidden</p> -->
<div class="advert box">Buy</div><table><tr><td>c1<td>c2</table><ul><li>i<li>j</ul><section id=comments>Nice!</section><form>x</form></article>
<aside>Side</aside></main><footer>&copy; Foot</footer></form></body></html>"""


def test_article():
    assert templates.main_text(PAGE) == "Title & more\n\nOne bold text after 5 < 6 © x\n\nTwo words\n\nc1\n\nc2\n\ni\n\nj"


@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain &amp text", "plain & text"), ("a < b", "a < b"), ("<p>cut &am", "cut &am"), ("<p>cut <b", "cut"), ("<p>x<!-- open", "x"),
    ("<script>x", ""), ("<p a='>'>q</p>", "q"), ("</p></div>z", "z"), ("<p a=\"open>x</p>", "x"), ("<div hidden>h</div>v", "v")])
def test_broken_markup(source, text):
    assert templates.main_text(source) == text


def test_long_page_is_linear():
    deep = "<div>" * 3000 + "x" + "<p>y" * 20_000
    assert templates.main_text(deep).startswith("x\n\ny")


def test_site_template(spark):
    shell = "<body><div><div>Acme portal home</div><span>menu one</span></div><div>{}</div><div>Call us {}</div></body>"
    rows = [(i, f"https://www.a.example/{i}", shell.format(f"<p>Story {i} text</p>", "now"), 1, "x") for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", shell.format(f"<p>Other {i}</p>", i), 1, "x") for i in range(3)]
    rows += [(200, None, shell.format("<p>No host</p>", "now"), 1, "x"), (201, "https://a.example/n", None, 1, "x"), (None, "https://a.example/e", "", 1, "x")]
    rows += [(300 + i, "https://c.example/same", "<body><p>All the same</p></body>", 1, "x") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long, template string")
    got = {r.page_id: r for r in templates.extract(pages).collect()}
    assert all(got[i].text == f"Story {i} text" for i in range(30))
    assert got[101].text == "Acme portal home\n\nmenu one\n\nOther 1\n\nCall us 1"  # too few pages for a template
    assert got[200].text.startswith("Acme") and got[201].text == "" and got[None].text == ""
    assert all(got[300 + i].text == "All the same" for i in range(9))
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    assert templates.extract(pages.where("page_id < 0")).count() == 0


def test_template_acts_inside_articles(spark):
    """A notice of neutral class inside every article goes, whatever its place; a paragraph that some articles share, and copied articles, stay."""
    page = "<body><article><h1>T{i}</h1><div>Read <b>our</b> terms</div><p>{body}</p><section>{shared}</section></article><div>Beside {i}</div></body>"
    shared = lambda i: "<p>A saying that a third of them share, word by word</p>" if i % 3 == 0 else f"<p>Last {i}</p>"
    body = lambda i: f"Story {i} " + "told at length " * 5
    rows = [(i, f"http://n.example/{i}", page.format(i=i, body=body(i), shared=shared(i))) for i in range(24)]
    rows += [(100 + i, f"http://copy.example/{i}", page.format(i=0, body=body(0), shared=shared(1))) for i in range(7)]
    rows += [(200 + i, f"http://near.example/{i}", page.format(i=0, body=body(0), shared=f"<p>{i}</p>")) for i in range(7)]
    got = {r.page_id: r.text.split("\n\n") for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    on_pages = lambda text: sum(f">{text}<" in html for k, _, html in rows if k < 100)  # noqa: E731  brute force over the first host
    for i in range(24):
        parts = [f"T{i}", body(i).strip(), shared(i)[3:-4]]
        assert all(2 * on_pages(p) < 24 for p in parts) and got[i] == parts
    assert got[100] == ["T0", "Read our terms", body(0).strip(), "Last 1"]
    assert got[203] == ["T0", "Read our terms", body(0).strip(), "3"]


def test_root_by_text():
    body = "long text of the body " * 20
    assert templates.main_text(f"<article>Teaser</article><div><p>{body}</p></div>") == "Teaser\n\n" + body.strip()
    assert templates.main_text("<main><article>One one</article><article>Two</article><p>End</p></main>") == "One one\n\nTwo\n\nEnd"
    assert templates.main_text(f"<article>{body}</article><main>short</main><div>x</div>") == body.strip()
