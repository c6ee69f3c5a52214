import itertools
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import html_text as H
from tests.llm.helpers import SF


@pytest.fixture(scope="module")
def model():
    return H.train()


def texts(html):
    return [b.text for b in H.leaf_blocks(html)]


def test_leaf_blocks():
    assert texts("<p>one <b>two</b>\n three<p>four<div>five</div>six") == ["one two three", "four", "five", "six"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>after") == ["1", "2", "3", "after"]
    assert texts("x<br>y<hr>z") == ["x y", "z"]
    assert texts("a &amp; b &lt;i&gt; &eacute;&#233;&nbsp;c &amp d") == ["a & b <i> éé c & d"]
    assert texts("<title>t</title><style>p{}</style><script>var a='<p>x</p>';</script><!-- <p>c --><p title='a>b'>y</p>") == ["y"]
    assert texts("<!--><p>a<!---><p>b<!-- open <p>c") == ["a", "b"]
    assert texts("<h2>head</h3>text 1 < 2 <3") == ["head", "text 1 < 2 <3"]
    assert texts("<script>never closed <p>x") == [] and texts("") == [] and texts("plain") == ["plain"]
    assert texts('<p class="open>x<p>y') == ["x", "y"]


def test_ancestors_links_and_elements():
    blocks = H.leaf_blocks('<div class="postBody main-text" id=c><p>a <a href=x>link</a></p></div><nav><a>b</a></nav>')
    assert {"in:div", "in:p", "word:post", "word:body", "word:main", "word:text", "word:c"} <= blocks[0].inside
    assert 0.5 < blocks[0].linked < 1 and blocks[1].linked == 1 and "in:div" not in blocks[1].inside
    same = H.relations(H.leaf_blocks("<div><p>a</p><p>b</p><h2>c</h2></div><p>d</p>"))
    assert same.tolist() == [2, 1, 0]


@pytest.mark.parametrize("html", ["<div>" * 200_000 + "x", "<ul>" + "<li>" * 200_000, '<a href="' * 100_001, "<" * 500_000, "<!--" * 200_000, "<b>" * 100_000 + "</i>" * 100_000,
                                  "&" * 300_000, "<p>a" * 100_000, "<p " + "a= " * 200_000 + ">x", "<li><ul>" + "<div>" * 600 + "<li></li>" * 50_000])
def test_hostile_pages_take_linear_time(html):
    began = time.time()
    H.leaf_blocks(html)
    assert time.time() - began < 20


def _all(e, same, pairs):
    """Score of every labelling of one page."""
    return {y: sum(e[i] * y[i] for i in range(len(e))) + sum(pairs[same[i], y[i - 1], y[i]] for i in range(1, len(e))) for y in itertools.product((0, 1), repeat=len(e))}


def test_expectations_and_viterbi_equal_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        e, same, pairs = rng.normal(size=n), rng.integers(0, 3, n), rng.normal(size=(3, 2, 2))
        score = _all(e, same, pairs)
        z = np.log(sum(np.exp(v) for v in score.values()))
        one, two, got_z = H._expectations(np.r_[e, np.zeros(2)][None], np.r_[same, 0, 0][None], np.r_[np.ones(n, bool), False, False][None], pairs)
        assert got_z[0] == pytest.approx(z)
        p = {y: np.exp(v - z) for y, v in score.items()}
        assert one[0, :n] == pytest.approx([sum(v for y, v in p.items() if y[i]) for i in range(n)])
        want = np.zeros((3, 2, 2))
        for y, v in p.items():
            for i in range(1, n):
                want[same[i], y[i - 1], y[i]] += v
        assert two == pytest.approx(want)
        assert H.viterbi(e, same[1:], pairs).tolist() == list(max(score, key=score.get))


def test_held_out_pages(model):
    wrong = total = 0
    for html in H.labelled_pages(200, seed=12_345):
        blocks, labels = H.labelled_blocks(html)
        got = H.viterbi(H.Scorer(model.weights).scores(blocks), H.relations(blocks), model.pairs)
        wrong += int((got != np.array(labels, dtype=np.int64)).sum())
        total += len(labels)
    assert wrong < 0.01 * total


def test_pages_in_other_markup(model):
    html = """<html><body><div class="site-header"><h2>Daily Paper</h2><ul class="menu"><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></div>
    <div class="cookie-banner">We use cookies to make this site work.</div>
    <div id="content" class="post-content"><h1>A long road home</h1><p>The first paragraph tells, in some words, what has happened here today. It has two sentences.</p>
    <div class="ad">Buy one, get one. Only this week!</div><p>The second one goes on with the story, and it ends as it began.</p><p>Why?</p></div>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Another story about something</a></li></ul></div>
    <form class="newsletter"><label>Your email</label><button>Subscribe</button></form>
    <section id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with any of this, as I have said before. Not at all.</p></div></section>
    <div class="footer">&copy; 2020 Daily Paper. All rights reserved.</div></body></html>"""
    assert [b.text for b in H.main_blocks(html, model)] == [
        "A long road home", "The first paragraph tells, in some words, what has happened here today. It has two sentences.",
        "The second one goes on with the story, and it ends as it began.", "Why?"]


def _article(html):
    """The text between the article's tags, for pages that have one and close their paragraphs by the next."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = (" ".join(unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_pages_of_the_tables(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    out = H.extract(pages, model).collect()
    assert len(out) == len(html)
    assert sum(r["text"] != _article(html[r["page_id"]]) for r in out) <= 0.005 * len(out)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_odd_rows_and_clashing_columns(spark, model):
    long = "<article>" + "<p>One more sentence, of the same kind as before.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (3, "u", "<p></p>"), (None, "u", "<nav><a>x</a></nav>"), (4, "u", long), (4, "u", long), (5, "u", "\x00<p>퟿&#xD800;&#0;")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    out = H.extract(df, model).collect()
    got = [(r["page_id"], r["text"]) for r in out]
    assert len(got) == len(rows) and [t for i, t in got if i in (1, 2, 3, None)] == [""] * 5
    assert [t.count("\n\n") for i, t in got if i == 4] == [19_999] * 2
    assert H.extract(df.limit(0), model).count() == 0
