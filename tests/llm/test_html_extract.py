"""Main text of pages: against a plain reading of the given pages, and on templates written out here."""

import html
import re
import time

import pytest

from shelfspark.llm import html_extract as x
from shelfspark.llm.registry import table


def plain(page):
    """Text of the given pages' article element, block by block."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    lines = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
    return "\n".join(line for line in lines if line)


@pytest.fixture(scope="module")
def weights(spark, sf):
    return x.train(table(spark, sf, "pages"))


def test_given_pages_read_plainly(spark, sf, weights):
    rows = x.extract(table(spark, sf, "pages"), weights).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    assert len(rows) == len(pages) and all(r["text"] == plain(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize("mark", ["div", "section", "td"])
def test_given_pages_without_their_mark(spark, sf, weights, mark):
    """The weights carry over to pages that mark nothing."""
    for r in table(spark, sf, "pages").collect():
        assert x.main_text(re.sub(r"(</?)article>", rf"\1{mark}>", r["html"]), weights) == plain(r["html"])


ARTICLE = "<h1>On  rivers &amp; seas</h1><p>Water runs <b>down</b>hill,<br>always.</p><ul><li>one</li><li>two <a href=/x>linked</a> words</li></ul><p>It ends&nbsp;here.</p>"
TEXT = "On rivers & seas\nWater runs downhill, always.\none\ntwo linked words\nIt ends here."
AROUND = [
    "<nav><ul><li><a href=/>Home page</a></li><li><a href=/n>News and views</a></li></ul></nav>",
    "<header><div class=logo>The Daily Example</div><p>All that is fit</p></header>",
    "<div id='site-header'><p>The Daily Example writes every day</p></div>",
    "<footer><p>All rights reserved by the Example company of old</p></footer>",
    "<aside><h3>Most read</h3><p>A long tale of other things that nobody asked for</p></aside>",
    "<div class='col sidebar-right'><p>Another long tale of other things entirely</p></div>",
    "<div class=\"cookie-notice\"><p>We use cookies on this page to serve you better.</p><button>Accept all</button></div>",
    "<div class=adSlot data-x='a>b'><p>Buy cheap things today, only today, at our shop</p></div>",
    "<form action=/s><label>Search the site <input name=q></label><select><option>All of it</option></select></form>",
    "<script>document.write('<p>never shown to anybody at all</p>')</script>",
    "<style>p > b { color: red } /* <p>never</p> */</style>",
    "<noscript><p>Please switch on scripts to read this page</p></noscript>",
    "<section id=comments><h2>Comments</h2><p>First! What a great page, I read it all day long.</p><article class=comment><p>Me too, indeed.</p></article></section>",
    "<!-- <p>hidden words of the page's author</p> -->",
    "<div hidden><p>Words that are not shown to anybody here</p></div><div style='display: none'><p>nor are these</p></div>",
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div role=main>{}</div>"])
@pytest.mark.parametrize("k", range(len(AROUND)))
def test_parts_around_are_left_out(weights, shell, k):
    head = "<!DOCTYPE html><html><head><title>On rivers</title><meta charset=utf-8></head><body class='with-sidebar'>"
    body = shell.format(ARTICLE)
    for page in (head + AROUND[k] + body + "</body></html>", head + body + AROUND[k] + "</body></html>"):
        assert x.main_text(page, weights) == TEXT


@pytest.mark.parametrize("k", [0, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14])
def test_parts_within_are_left_out(weights, k):
    page = f"<html><body><article>{ARTICLE}{AROUND[k]}<p>And more after it.</p></article></body></html>"
    assert x.main_text(page, weights) == TEXT + "\nAnd more after it."


def test_broken_markup(weights):
    assert x.main_text("<article><p>One<p>two <b>three<p>four</i></div></span><p>five", weights) == "One\ntwo three\nfour\nfive"
    assert x.main_text("<article><p>a < b and c > d &lt;p&gt; &amp;amp; &am</p></article>", weights) == "a < b and c > d <p> &amp; &am"
    assert x.main_text("<article><p>whole</p></article><footer>cut off <a hre", weights) == "whole"
    assert x.main_text("<article><p title=it's>x</p><p>y</p><!-- open", weights) == "x\ny"
    assert x.main_text("<article><p>x</p><script>if (a</b) '<p>no</p>'", weights) == "x"


@pytest.mark.parametrize("page", ["", " ", "<html></html>", "<article></article>", "<nav><a href=/>Home</a></nav>", "</", "<!--", "<a"])
def test_pages_without_an_article(weights, page):
    assert x.main_text(page, weights) == ""


def test_short_and_plain_pages(weights):
    assert x.main_text("<article>Word</article>", weights) == "Word"
    assert x.main_text("Just a line of text", weights) == "Just a line of text"
    assert x.main_text("<html><body><div><div><p>Word</p></div></div></body></html>", weights) == "Word"


@pytest.mark.parametrize("part", ["<p>word and word</p>", "<div>word", "<li>", "<a href='/'>w</a>", '<b ="', "<p <p ", "&amp; ", "</div>", "<span class=ad>x</span>", "<!-", "<table><td>x"])
def test_time_is_linear_in_the_page(weights, part):
    spent = []
    for n in (4_000, 32_000):
        start = time.perf_counter()
        x.main_text("<article><p>Start of it.</p>" + part * n, weights)
        spent.append(time.perf_counter() - start)
    assert spent[1] < 30 * spent[0] + 0.5  # eight times the text


def test_long_page_is_whole(weights):
    words = " ".join(f"w{k}" for k in range(300_000))
    assert x.main_text(f"<nav><a href=/>x</a></nav><article><p>{words}</p><p>end</p></article>", weights) == words + "\nend"


@pytest.mark.parametrize("scores", [[1, -2, 3, 0, -1, 2, -5, 1], [-1, -1], [], [0, 1, 0], [2, -1, 2, -9, 3]])
def test_best_stretch_is_the_best(scores):
    s, e = x.best_stretch(scores)
    best = max([sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)], default=0)
    assert sum(scores[s:e]) == max(best, 0)


def test_weights_follow_the_labels(spark):
    """Labelled pages whose articles are tables and whose paragraphs are boilerplate turn the weights round."""
    page = "<p>Buy this now and here and there</p>" * 4 + "<main><table><tr><td>Real words of the article</td></tr></table></main>"
    rows = spark.createDataFrame([(k, "u", page) for k in range(300)], "page_id long, url string, html string")
    w = x.train(rows)
    assert w.of_word("td", False, None, "") > 0 > w.of_word("p", False, None, "") and w.of_tag("td", None, "") > w.of_tag("p", None, "")
    assert x.main_text(page.replace("main>", "div>"), w) == "Real words of the article"


def test_nulls_repeats_clashes_and_none(spark, weights):
    from pyspark.sql import functions as F

    rows = [(1, "u", "<article><p>x</p></article>")] * 2 + [(None, None, None), (3, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("text", "n_chars", "name", "part")])
    got = sorted([tuple(r) for r in x.extract(pages, weights).collect()], key=str)
    assert got == sorted([(1, "u", "x", 1)] * 2 + [(None, None, "", 0), (3, None, "", 0)], key=str)
    empty = pages.limit(0)
    assert x.extract(empty, x.train(empty)).collect() == []
