"""Main text of HTML pages."""

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.defaults import (
    BOILERPLATE_TAGS,
    CONTENT_CLASS_PATTERN,
    MIN_PAGE_WORDS,
    TEXT_TAGS,
)
from corpuslens.functions.text import head, tidy_spaces, word_count
from corpuslens.functions.urls import url_domain
from corpuslens.schemas import require_columns

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose start ends an open paragraph. Sectioning elements do not, as in the HTML 4
# rules of the usual tree parsers.
_PARAGRAPH_ENDS = frozenset(
    "address blockquote body dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot "
    "th thead tr ul".split()
)
# Elements that an inline end tag does not reach across.
_BLOCKS = _PARAGRAPH_ENDS | frozenset("article aside figure footer header html main nav section".split())
#: Pages that a task holds as Python strings at once.
PAGES = 64
_RANKS = ("article", "main", "div", "body")


class _MainText(HTMLParser):
    """Collects the text of block elements inside the preferred container of one page.

    Every step takes a bounded time, whatever is open, and every text is kept once for each kind of
    container, so time and output grow with the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Name, whether its text counts, container kind.
        self.stack: list[tuple[str, bool, str | None]] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.hidden = 0
        self.open_blocks = 0
        self.texts: dict[str, list[str]] = {"body": []}
        self.inside = {"body"}
        self.pending: list[str] = []

    def _flush(self) -> None:
        text = "".join(self.pending).strip()
        self.pending.clear()
        if text and self.open_blocks and not self.hidden:
            for kind in self.inside:
                self.texts[kind].append(text)

    def _push(self, tag: str, is_block: bool, container: str | None) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append((tag, is_block, container))
        self.hidden += tag in BOILERPLATE_TAGS
        self.open_blocks += is_block

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, is_block, container = self.stack.pop()
            self.places[tag].pop()
            if tag in _BLOCKS:
                self.block_places.pop()
            self.hidden -= tag in BOILERPLATE_TAGS
            self.open_blocks -= is_block
            self.inside.discard(container)

    def _close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph; a new list item ends the item before it."""
        if self.block_places:
            name = self.stack[self.block_places[-1]][0]
            if name == "p" or name == tag == "li":
                self._pop_to(self.block_places[-1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in _VOID:
            return
        if tag in _PARAGRAPH_ENDS:
            self._close_implied(tag)
        hidden = self.hidden or tag in BOILERPLATE_TAGS
        container = None if hidden else self._container(tag, attrs)
        if container:
            self.texts[container] = []
            self.inside.add(container)
        self._push(tag, not hidden and tag in TEXT_TAGS, container)

    def _container(self, tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        """The container kind that this element is the first of."""
        if tag not in ("article", "main", "div") or tag in self.texts:
            return None
        if tag == "div" and not re.search(CONTENT_CLASS_PATTERN, dict(attrs).get("class") or "", re.I):
            return None
        return tag

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        # An inline end tag does not reach across a block.
        if tag in _BLOCKS or tag in BOILERPLATE_TAGS or not self.block_places or at > self.block_places[-1]:
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def text(self) -> str:
        self._flush()
        return " ".join(self.texts[next(k for k in _RANKS if k in self.texts)])


def _page_text(html: str) -> str:
    for page in (html, html.replace("<!", "&lt;!")):
        parser = _MainText()
        try:
            parser.feed(page)
            parser.close()
        except (AssertionError, ValueError):
            continue  # a broken declaration; the second time they are text
        return unicodedata.normalize("NFKC", parser.text())
    raise ValueError("a page without declarations cannot fail")


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    # A batch has a fixed number of pages, whatever their size: only a few are Python strings at a time.
    parts = [
        pa.array([None if h is None else _page_text(h) for h in pages.slice(at, PAGES).to_pylist()], pa.string())
        for at in range(0, len(pages), PAGES)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


# Spark would otherwise run the parser once for a filter and again for the projection.
_main_text_once = _main_text.asNondeterministic()


def extract_pages(
    pages: DataFrame,
    min_words: int = MIN_PAGE_WORDS,
    max_chars: int | None = None,
    html_col: str = "html",
) -> DataFrame:
    """Pages as (url, domain, crawl, fetch_time, text, word_count); thin pages and pages without host go.

    The text is that of headings, paragraphs, list items and quotes in the first ``article``,
    else ``main``, else ``div`` of a content class, else the body, without boilerplate
    elements. The text of a block inside another block is given once. Only the HTML goes to Python.
    """
    require_columns(pages, "url", "crawl", "fetch_time", html_col)
    sited = pages.withColumn("domain", url_domain(F.col("url"))).filter(F.col("domain").isNotNull())
    raw = sited.select(
        "url", "domain", "crawl", "fetch_time", _main_text_once(F.col(html_col)).alias("_raw")
    )
    sized = F.transform(
        F.array(head(tidy_spaces(F.col("_raw")), max_chars)),
        lambda t: F.struct(t.alias("text"), word_count(t).alias("word_count")),
    )
    long_enough = F.filter(sized, lambda s: (s["text"] != "") & (s["word_count"] >= min_words))
    return raw.select("url", "domain", "crawl", "fetch_time", F.inline(long_enough))
