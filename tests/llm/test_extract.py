import html
import re
import tracemalloc

import numpy as np
import pytest

from opsweave.llm import extract, queries
from opsweave.llm.blocks import blocks, vectors
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def article(page):
    """The given pages' article: what stands in <article>, cut at its p and h1 tags."""
    inner = re.sub(r"</?b>", "", page[page.index("<article>") : page.index("</article>")]).replace("<br>", " ")
    cut = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|article)>", inner))
    return "\n\n".join(b for b in cut if b)


def test_query_against_brute_force(spark):
    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op10_html_extract"](spark, SF).collect():
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])


def test_held_out_layouts(model):
    pages = list(extract.made_pages(200, seed=77))
    got = model.labels([vectors(f) for f, _ in pages])
    right = np.concatenate([g == (y > 0) for g, (_, y) in zip(got, pages)])
    assert right.mean() >= 0.995


def test_gradients():
    model = extract.Labeller(hidden=3, seed=1)
    pages = [(f, y) for f, y in extract.made_pages(3, seed=2)]
    x, y = [vectors(f).astype(float) for f, _ in pages], [y for _, y in pages]
    _, grads = model.step(x, y)
    rng = np.random.default_rng(0)
    for k, g in enumerate(grads):
        for at in rng.integers(0, g.size, 6):
            was = model.w[k].flat[at]
            model.w[k].flat[at] = was + 1e-5
            up = model.step(x, y)[0]
            model.w[k].flat[at] = was - 1e-5
            down = model.step(x, y)[0]
            model.w[k].flat[at] = was
            assert abs((up - down) / 2e-5 - g.flat[at]) < 1e-5


def test_parts_of_pages(model):
    def text(page):
        found = blocks(page)
        return "\n\n".join(b.text for b, good in zip(found, model.labels([vectors(found)])[0]) if good)

    prose = "<p>The first paragraph says a lot of things about the matter.</p><p>So does\n the  second &amp; last one.</p>"
    want = "The first paragraph says a lot of things about the matter.\n\nSo does the second & last one."
    around = [
        ("<header class=site-header><p>My site</p></header><nav><ul><li><a href=/>Home</a></ul></nav>", "<footer>&copy; x</footer>"),
        ('<div id="sidebar"><p>About the author and other things.</p></div>', '<div class="comments"><p>Great post, I read it twice.</p></div>'),
        ('<div class="cookie-notice">We use cookies to serve you.</div>', "<form><label>Mail</label><input><button>Send</button></form>"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> -->", '<div class="ad">Buy now and save a lot.</div>'),
        ("<noscript>Turn it on</noscript><div hidden><p>secret part</p></div>", "<aside><p>Related reading for you.</p></aside>"),
    ]
    for before, after in around:
        assert text(f"<html><body>{before}<article>{prose}</article>{after}</body></html>") == want
        assert text(f"<html><body><article>{before}{prose}{after}</article></body></html>") == want


def test_blocks():
    got = [b.text for b in blocks("a<b>b</b> c<p>d<br>e &lt;x&gt;<div>f</div><li>g<li>h &amp;lt; 1 < 2</ul></i>")]
    assert got == ["ab c", "d e <x>", "f", "g", "h &lt; 1 < 2"]
    for odd in ("<", "<!--", "<p", '<a href="', "<script>x", "</", "<!x", "<p>" * 50_000, "<div>t" * 20_000):
        blocks(odd)


def test_edges(spark, model):
    long = "<article>" + "".join(f"<p>Sentence number {i} of a very long page.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None, 1, "x"), (2, None, "", 1, "x"), (3, "u", "<nav>only</nav>", 1, "x"), (4, "u", long, 1, "x"), (4, "u", long, 1, "x"), (None, "u", "<p>", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = extract.extract(df, model=model).collect()
    assert len(got) == 6 and [r["n_chars"] for r in got if r["page_id"] != 4] == [0] * 4
    assert all(r["text"].count("\n\n") == 19_999 for r in got if r["page_id"] == 4)
    assert extract.extract(df.limit(0)).count() == 0


def test_memory_of_a_long_page_among_short_ones():
    """63 short pages and one of 50,000 blocks: the short ones are not padded to the long one."""
    rng = np.random.default_rng(1)
    model = extract.Labeller()
    for k in range(len(model.w)):
        model.w[k] = model.w[k] + rng.normal(0, 0.3, model.w[k].shape)
    pages = [rng.random((n, extract.SIZE), dtype=np.float32) for n in [0, *rng.integers(1, 40, 62), 50_000]]
    tracemalloc.start()
    got = model.labels(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for one, z in zip(got[:-1], model.logits(pages[:-1])):
        assert (one == (z > 0)).all()
    assert (got[-1][:300] == (model.logits([pages[-1]])[0] > 0)[:300]).all()
