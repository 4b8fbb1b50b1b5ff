import time

import pyarrow as pa
import pytest

from corpuslens.operators import extract as E
from corpuslens.operators.extract import _page_text, extract_pages
from plans import plan

LONG = " ".join(f"word{i}" for i in range(120))


@pytest.mark.parametrize("html, text", [
    ("<article><p>a</p></article><main><p>b</p></main>", "a"),
    ("<main><p>b</p></main><div class='content'><p>c</p></div>", "b"),
    ("<div class='x'><p>n</p></div><div class='Post-Body main'><p>c</p></div>", "c"),
    ("<div class='x'><p>n</p></div><p>d</p>", "n d"),
    ("<p>before</p><article><h1>T</h1><h5>no</h5><ul><li>x</li><li>y</ul></article><p>after", "T x y"),
    # The first article counts, later ones do not.
    ("<article><p>a</p></article><article><p>b</p></article>", "a"),
    ("<article><p>a<article><p>in</p></article></p><p>b</p></article>", "a in b"),
    # Boilerplate goes wherever it stands, also an article inside a header.
    ("<header><article><p>h</p></article></header><article><p>a<script>var t='</p>';</script>b</p></article>", "a b"),
    ("<article><nav><p>n</p></nav><p>a</p><aside>s</aside><form><p>f</p></form></article>", "a"),
    ("<article><p>a</p><nav><p>n</article><p>x</p>", "a"),
    # The text of a block inside a block is given once.
    ("<article><blockquote>q<p>a</p>r</blockquote></article>", "q a r"),
    # A broken declaration is text.
    ("<article><p>a</p><![if x]><p>b</p></article>", "a b"),
    # Unclosed paragraphs end at the next block, inline tags do not close blocks.
    ("<article><p><b>one<br><p>two</p><p>three</b> more</p></article>", "one two three more"),
    ("<article><p>a <i>b</i>&amp;<!-- no --> c &lt;x&gt;</p></article>", "a b & c <x>"),
    ("<article><p>3 < 4 and é</p></article>", "3 < 4 and é"),
    ("<article><p>ﬁx</p></article>", "fix"),
    ("plain", ""),
    ("", ""),
])
def test_main_text(html, text):
    assert _page_text(html) == text


def _pages(spark, *rows):
    return spark.createDataFrame(
        [(u, "C", "t", h) for u, h in rows], "url string, crawl string, fetch_time string, html string"
    )


def test_thin_pages_and_pages_without_host_go(spark):
    pages = _pages(
        spark, ("http://www.h.org/1", f"<p>{LONG}"), ("http://h.org/2", "<p>thin</p>"), ("nohost", f"<p>{LONG}"),
        (None, f"<p>{LONG}"), ("http://h.org/3", None),
    )
    rows = extract_pages(pages).collect()
    assert [(r.url, r.domain, r.word_count, r.text) for r in rows] == [("http://www.h.org/1", "h.org", 120, LONG)]


@pytest.mark.parametrize("part", ["<b>x", "<blockquote>word ", "<b></i>", "<i><p></b>", "<ul><li>x", "</p>", "<p>x"])
def test_hostile_pages_take_linear_time_and_give_no_more_than_they_hold(part):
    page = "<article>" + part * (500_000 // len(part))
    start = time.perf_counter()
    assert len(_page_text(page)) <= len(page)
    assert time.perf_counter() - start < 10


def test_long_text_is_whole_unless_asked_to_be_cut(spark):
    text = "x" * 99 + (" " + "y" * 99) * 400
    pages = _pages(spark, ("http://h/1", f"<p>{text}</p>"))
    assert len(extract_pages(pages, max_chars=20_000).first().text) == 20_000
    whole = extract_pages(pages).first()
    assert (whole.text, whole.word_count) == (text, 401)


def test_parser_runs_once_and_gets_only_the_html(spark):
    p = plan(extract_pages(_pages(spark, ("http://h/1", "<p>x"))).filter("word_count > 150"))
    assert p.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in p


def test_pages_become_strings_a_few_at_a_time(monkeypatch):
    held, whole = [], E._page_text
    monkeypatch.setattr(E, "_page_text", lambda h: held.append(h) or whole(h))
    pages = pa.array([f"<p>page {i}</p>" for i in range(2 * E.PAGES + 1)] + [None])
    got = E._main_text.func(pages)
    assert got.to_pylist() == [f"page {i}" for i in range(2 * E.PAGES + 1)] + [None]
    assert len(held) == 2 * E.PAGES + 1
