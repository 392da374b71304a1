"""Blocks of odd pages; the field against sums over all labellings; whole
tables against their own markup; held-out layouts."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from conftest import SF_SMALL
from pulsepanel.llm import html_crf as hc
from pulsepanel.llm.html_blocks import blocks

PAGES = "page_id long, url string, html string, text string, n_chars string"


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("  \n ") == []
    assert texts("a <b>b</b>c<br>d&nbsp;&amp;&lt;p&gt; e") == ["a bc d &<p> e"]
    assert texts("<p><b>one<br><p>two</p>three<div>four") == ["one", "two", "three", "four"]
    assert texts("<script>var t='</p>';</script>x<style>p{}</style><!-- <p>no</p> -->y") == ["xy"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("1 < 2 <3 </> <?x?> <!DOCTYPE q> & &bogus; &#x41;") == ["1 < 2 <3 & &bogus; A"]
    assert texts('<p title="a>b" data-x=\'c>d\' hidden>in</p>') == ["in"]
    assert texts("<p class=\"open>text</p> more") == ["text", "more"]  # a quote that nothing closes
    assert texts("<P>UP</P><Script>x</SCRIPT >down") == ["UP", "down"]
    assert texts("<h1>a</h2>b<button>no</button><select><option>no</select><noscript>no</noscript>") == ["a", "b"]
    assert texts("<title>no</title>x<script>never closed <p>y") == ["x"]
    assert texts("<!-- never closed <p>y") == []


def test_marks():
    b = blocks("<div id='main-Content' class='a postBody'><article><p role=x>t <a href=q>u</a></p></article>")[0]
    assert (b.tag, b.own) == ("p", ("x",)) and b.linked == pytest.approx(1 / 3)
    assert {"t:div", "k:main", "k:content", "k:post", "k:body", "b:div>article", "b:article>p"} <= set(b.above)


@pytest.mark.parametrize("page", [
    "<div>" * 30_000 + "x", "<a b='" * 30_000, "<p><" * 50_000, "<ul><li>" * 20_000, "<p " + "x=\"" * 50_000,
    "<button>" * 20_000 + "x", "</div>" * 50_000, "&" * 100_000, "<li>" * 50_000])
def test_time_follows_the_page(page):
    t = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - t < 5


def chains(size):
    return itertools.product((0, 1), repeat=size)


def score(field, marks, edges, labels):
    s = field.start[labels[0]] + field.end[labels[-1]]
    s += sum(field.weights.get(m, 0) for ms, y in zip(marks, labels) for m in ms if y)
    return s + sum(field.moves[edges[t], labels[t - 1], labels[t]] for t in range(1, len(labels)))


def some_pages(rng, count):
    out = []
    for _ in range(count):
        n = rng.randint(1, 6)
        out.append(([rng.sample("abcdefg", rng.randint(0, 4)) for _ in range(n)],
                    [rng.randint(0, 1) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]))
    return out


def random_field(rng):
    return hc.Field({c: rng.normal() for c in "abcdefg"}, rng.normal(size=2), rng.normal(size=2),
                    rng.normal(size=(2, 2, 2)))


def test_viterbi_is_the_best_of_all_labellings():
    field = random_field(np.random.default_rng(1))
    for marks, edges, _ in some_pages(random.Random(1), 60):
        got = field.decode(marks, edges)
        best = max(chains(len(marks)), key=lambda y: score(field, marks, edges, y))
        assert score(field, marks, edges, got) == pytest.approx(score(field, marks, edges, best))
    assert field.decode([], []) == []


def test_likelihood_and_gradient():
    """The loss is the share of the labelling among all; the gradient its slope."""
    field, pages = random_field(np.random.default_rng(2)), some_pages(random.Random(2), 12)
    vocabulary = {c: i for i, c in enumerate("abcdefg")}
    batch = hc.Batch(pages, vocabulary)
    w = np.array([field.weights[c] for c in "abcdefg"])
    values = [w, field.start, field.end, field.moves]
    loss, grads = hc.loss_and_gradient(batch, *values)
    want = np.mean([np.log(sum(np.exp(score(field, m, e, c)) for c in chains(len(m)))) - score(field, m, e, y)
                    for m, e, y in pages])
    assert loss == pytest.approx(want)
    for v, g in zip(values, grads):
        for at in np.ndindex(v.shape):
            held = v[at]
            v[at] = held + 1e-5
            up = hc.loss_and_gradient(batch, *values)[0]
            v[at] = held - 1e-5
            down = hc.loss_and_gradient(batch, *values)[0]
            v[at] = held
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def article_of(page):
    """Text of the article element of the test pages, by their own markup."""
    a = page[page.index("<article>") + 9:page.index("</article>")]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", a))).split())


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in hc.extract_main(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_of(r.html) and got[r.page_id].url == r.url
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.fixture(scope="module")
def composed():
    """A field that has seen composed pages alone."""
    return hc.fit_field(hc.training_pages([], seed=3, composed=900))


def test_held_out_layouts(composed):
    rng, right, count = random.Random(77), 0, 0
    for _ in range(200):
        page = hc.labelled_blocks(hc.Layout(rng, hc.WORDS).page())
        got = composed.decode(*hc.features([b for b, _ in page]))
        right += sum(a == b for a, (_, b) in zip(got, page))
        count += len(page)
    assert right / count > 0.95


def test_pages_written_by_hand(composed):
    long = "The first large paragraph of the text explains how a river flows, and why people live near it."
    short = "And then it turned to the north."
    page = (f"<div class='cookie-notice'><p>We use cookies. {long}</p></div><header><a href='/'>Site</a></header>"
            f"<nav><ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul></nav>"
            f"<main><article><h1>A river</h1><p>{long}</p><div class='ad'>{short}</div><p>{short}</p>"
            f"<ul><li>Upper part</li><li>Lower part</li></ul></article>"
            f"<section class='comments'><h2>Comments</h2><div class='comment'><p>{long}</p></div></section></main>"
            f"<aside class='sidebar'><p>{short}</p></aside><form><p>{short}</p></form><footer>{short}</footer>")
    assert hc.main_text(page, composed) == f"A river {long} {short} Upper part Lower part"


def test_odd_rows(spark, composed):
    rows = [(1, "u", None, "t", "n"), (2, None, "", "t", "n"), (None, None, "  ", "t", "n"),
            (3, "u", "<script>x</script>", "t", "n"),
            (4, "u", "<article><p>" + "Long text of many words, all of it kept. " * 20_000 + "</p></article>", "t", "n"),
            (4, "u", "<article><p>The same page id once more, with another text.</p></article>", "t", "n")]
    got = hc.extract_main(spark.createDataFrame(rows, PAGES), field=composed)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(got.collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.text) for r in got[:4]] == [(None, ""), (1, ""), (2, ""), (3, "")]
    assert got[4].text == "The same page id once more, with another text."
    assert got[5].n_chars == 20_000 * 41 - 1


def test_no_pages(spark):
    assert hc.extract_main(spark.createDataFrame([], PAGES), field=hc.fit_field([])).count() == 0
    assert hc.main_text("<p>all</p>", hc.fit_field([])) == "all"
