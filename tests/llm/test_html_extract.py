import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.llm import html_extract as H
from gustline.llm import queries
from gustline.llm.html_blocks import blocks

SF = "/root/testdata/sf0.01"
WORD = "alpha beta gamma delta epsilon zeta eta theta".split()


@pytest.fixture(scope="module")
def labeller(spark):
    return H.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_blocks_of_awkward_markup():
    page = ("<!DOCTYPE html><title>t</title><script>var a='</p>';</script><style>p{}</style><nav><a href='x>y'>one</a>"
            "</nav><!-- <p>no</p> --><p class=\"x y\">a <b>bo</b>ld<br>line &amp; &lt;tag&gt; &#233;&nbsp;z<p>next</b> < 3"
            "<div id=side><ul><li>l1<li>l2</ul></div><P>last <img src='q.png'/> <textarea>no</textarea>end<p cut='")
    got = [(b.text, [t for t, _ in b.path]) for b in blocks(page)]
    assert got == [("one", ["nav", "a"]), ("a bold line & <tag> é z", ["p"]), ("next < 3", ["p"]),
                   ("l1", ["div", "ul", "li"]), ("l2", ["div", "ul", "li"]), ("last", ["p"]), ("end", ["p"])]
    assert blocks(page)[0].linked == 3 and blocks(page)[1].path == (("p", ("x", "y")),)


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "<!--", "</p></p>", "<script>x", "a" * 100_000, "<b>" * 3000,
                                  "plain &amp text", "<p>" * 2000 + "x", "&" * 1000, "<a href='" + "x" * 10_000])
def test_blocks_of_broken_pages(page):
    blocks(page)


@pytest.mark.parametrize("name", ["svg", "canvas", "object", "select", "template"])
def test_text_behind_an_unclosed_element_stays(name):
    def texts(page):
        return [b.text for b in blocks(page)]

    own = f"<{name} id='x'>"
    assert texts(f"<p>one</p>{own}<p>two</p><p>three</p>") == ["one", "two", "three"]
    assert texts(f"{own}<p>one</p>{own}no</{name}><p>two</p>") == ["one", "two"]
    assert texts(f"<p>one</p>{own}no{own}no</{name}>no</{name.upper()} ><p>two</p><{name}/><p>three") == [
        "one", "two", "three"]


@pytest.mark.parametrize("name", ["script", "style", "textarea", "title", "iframe", "noscript"])
def test_unclosed_raw_text_reaches_the_end(name):
    assert [b.text for b in blocks(f"<p>one</p><{name}><p>two</p>")] == ["one"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    model = H.Labeller.fresh()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = rng.normal(0, 1, (5, 2, H.INPUT))
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0.0]])
    x *= mask[:, :, None]
    y = (rng.random((5, 2)) > 0.5).astype(float)

    def loss():
        p, _ = model.forward(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = model.gradients(x, mask, y, mask)
    for name in ("wf", "uf", "cf", "wb", "ub", "cb", "out"):
        w = model.weights[name]
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5, name


def test_padding_does_not_change_a_page(labeller):
    page = blocks("<nav>x</nav><article><p>one two three.</p><p>four five.</p></article><footer>f</footer>")
    x, mask = labeller.padded([H.vectors(page)])
    wide, wide_mask = labeller.padded([H.vectors(page), H.vectors(page * 5)])
    a, b = labeller.forward(x, mask)[0][:, 0], labeller.forward(wide, wide_mask)[0][:len(page), 0]
    assert np.allclose(a, b, atol=1e-5)


def plain_article(page):
    """The article's text cut out by its own tags."""
    body = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not body:
        return ""
    out = []
    for b in blocks(body[1]):
        out.append(b.text)
    return " ".join(out)


def test_held_out_pages_give_the_article(spark, labeller):
    """Pages that the labeller hasn't seen: those of another scale."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(600)
    got = H.extract(pages, labeller).collect()
    same = sum(r["text"] == plain_article(r["html"]) for r in got)
    assert same / len(got) >= 0.999


def _page(rng, wrap, first, last):
    def say(n):
        return " ".join(rng.choice(WORD) for _ in range(n)) + "."
    text = [say(int(rng.integers(20, 60))) for _ in range(int(rng.integers(4, 9)))]
    body = "".join(f"<p>{t}</p>" for t in text)
    return f"<html><body>{first(say)}{wrap[0]}{body}{wrap[1]}{last(say)}</body></html>", " ".join(text)


def test_other_layouts(labeller):
    """Layouts that no page of the sample has."""
    rng = np.random.default_rng(11)
    wraps = [("<main>", "</main>"), ('<div class="post-content">', "</div>"), ("<article>", "</article>")]
    firsts = [lambda say: f"<header><h1>{say(3)}</h1></header><nav><ul><li><a href=/>{say(1)}</a></li></ul></nav>",
              lambda say: f'<div class="cookie-notice"><p>{say(12)}</p></div><ul class="menu"><li><a>{say(1)}</a></ul>']
    lasts = [lambda say: f'<aside class="sidebar"><p>{say(8)}</p></aside><footer><p>{say(5)}</p></footer>',
             lambda say: f'<div id="comments"><div class="comment"><p>{say(25)}</p></div></div><footer>{say(3)}</footer>',
             lambda say: f'<form><label>{say(2)}</label><button>{say(1)}</button></form><div class="related">{say(4)}</div>']
    right = total = 0
    for wrap in wraps:
        for first in firsts:
            for last in lasts:
                for _ in range(4):
                    page, want = _page(rng, wrap, first, last)
                    cut = blocks(page)
                    label = labeller.label([cut])[0]
                    right += " ".join(b.text for b, k in zip(cut, label) if k) == want
                    total += 1
    assert right / total >= 0.9, right / total


def test_rows_nulls_repeats_and_clashing_columns(spark, labeller):
    rows = [(1, "u", "<article><p>some words here.</p></article>"), (1, "u", "<article><p>some words here.</p></article>"),
            (2, None, None), (None, "u", ""), (3, "u", "<nav>a</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "Text", F.lit(1)).withColumn("_main_text", F.lit("m"))
    got = H.extract(pages, labeller).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["_main_text"]) for r in got) == [
        (0, "", 0, "m"), (1, "some words here.", 16, "m"), (1, "some words here.", 16, "m"), (2, "", 0, "m"), (3, "", 0, "m")]
    empty = pages.limit(0)
    assert H.extract(empty, H.fit(empty)).collect() == []


def test_query_over_the_whole_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries.op10_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    same = sum(r["text"] == plain_article(pages[r["page_id"]]) for r in got)
    assert same / len(got) >= 0.999


def test_repetitive_paragraphs_are_text_where_the_markup_says_so(labeller):
    for words, times in ((["so"], 400), (["le", "la"], 300), (["ein", "Wort", "noch", "einmal"], 200), (["Menu"], 60)):
        many = " ".join(words * times)
        page = (f"<body><nav><a>{words[0]}</a></nav><article><h1>One title</h1><p>First come a few words.</p><p>{many}</p>"
                f"<p>{many}.</p><p>Then it ends.</p></article><form><p>{many}</p></form><div class='comments'><p>{many}</p></div></body>")
        cut = blocks(page)
        label = labeller.label([cut])[0]
        assert " ".join(b.text for b, k in zip(cut, label) if k) == (
            f"One title First come a few words. {many} {many}. Then it ends."), words


def test_without_pages_to_learn_from_the_markup_decides(spark):
    """No page is short enough, or none says anything: no random weights."""
    schema = "page_id long, html string"
    long = "<article><p>" + "some text " * 20_000 + "</p></article>"
    pages = spark.createDataFrame([(1, long + "<footer>f</footer>")], schema)
    learned = H.fit(pages)
    assert learned.weights == {} and H.extract(pages, learned).collect()[0]["text"] == ("some text " * 20_000).strip()
    plain = spark.createDataFrame([(1, "<nav>n</nav><p>a</p><p>b</p><div class=cookie-notice>c</div>"), (2, None), (3, "")], schema)
    learned = H.fit(plain)
    got = {r["page_id"]: r["text"] for r in H.extract(plain, learned).collect()}
    assert learned.weights == {} and got == {1: "a b", 2: "", 3: ""}


def test_short_pages_are_learned_from_whatever_stands_beside_them(spark):
    """Long pages don't take the places of the sample."""
    rows = [(i, "x" * 70_000) for i in range(300)] + [(1000 + i, f"<nav>m{i}</nav><article><p>text {i} here.</p></article>") for i in range(20)]
    assert H.fit(spark.createDataFrame(rows, "page_id long, html string"), sample=10).weights


def test_long_pages_are_labelled_as_short_ones_are(labeller, monkeypatch):
    rng = np.random.default_rng(4)
    page, _ = _page(rng, ("<article>", "</article>"), lambda say: f"<nav>{say(2)}</nav>", lambda say: f"<footer>{say(3)}</footer>")
    cut = blocks(page) * 30
    whole = labeller.label([cut])[0]
    monkeypatch.setattr(H, "BLOCKS_PER_RUN", 50)
    monkeypatch.setattr(H, "BLOCKS_PER_PART", 64)
    assert (labeller.label([cut])[0] == whole).all() and whole.any() and not whole.all()


def test_memory_of_a_very_long_page(labeller):
    """Beyond its blocks a page takes memory for one part and a number per block."""
    import tracemalloc

    cut = blocks("<nav>m</nav><article><p>a few words.</p></article>") * 50_000
    tracemalloc.start()
    label = labeller.label([cut])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(label) == 100_000 and most < 30_000_000
