"""Lines of text of one HTML page, each with what the markup says about it. One pass, linear in the page."""

import html
import re
from bisect import bisect_right

# Attribute text ends at the next tag, and a quote that is not closed soon counts as a character,
# so that broken markup cannot make a scan start over and over.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+'|["'])*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_WORD = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
# Elements that end where the next of their kind begins.
_OPTIONAL_END = frozenset("p li dt dd option tr td th".split())
_BOILERPLATE = frozenset(
    "nav header footer aside form menu dialog noscript template button select svg canvas object audio video map "
    "datalist fieldset head".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
# Words of a class or id that mark page furniture.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion "
    "promoted cookie cookies consent gdpr notice notices notification banner popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations widget "
    "widgets pagination pager toolbar login searchbox searchform copyright disclaimer skip".split()
)
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names that tell how a page is laid out or what is allowed on it, such as has-sidebar and comments-open.
_LAYOUT_STARTS = tuple(f"{w}{c}" for w in ("no", "has", "with", "without") for c in "-_")
_LAYOUT_ENDS = tuple(f"{c}{w}" for w in ("open", "closed", "enabled", "disabled") for c in "-_")


FURNITURE, OPEN, ARTICLE = 0, 1, 2


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(text)} if text.strip() else {}


def _is_furniture(name: str, attrs: dict[str, str]) -> bool:
    if name in ("html", "body"):
        return False
    if name in _BOILERPLATE or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs:
        return True
    if attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return False


def _is_named_furniture(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether words of the class or id say so; ids of headings and paragraphs of an article are anchors."""
    if name in ("html", "body"):
        return False
    own = "" if in_article and (name == "p" or name in _HEADINGS) else attrs.get("id", "")
    named = [n for n in f"{attrs.get('class', '')} {own}".lower().split()
             if not n.startswith(_LAYOUT_STARTS) and not n.endswith(_LAYOUT_ENDS)]
    return not _NAMES.isdisjoint(_WORD.findall(" ".join(named)))


def _tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag; comments and declarations have no name."""
    found, at = [], 0
    while m := _TOKEN.search(page, at):
        closing, name, attrs = m[1] == "/", (m[2] or "").lower(), m[3] or ""
        at = m.end()
        if name in _RAW and not closing and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[^<>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            name = ""
        found.append((m.start(), at, closing, name, attrs))
    return found


def _ends(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, int]:
    """For each start tag the index of the tag that ends its element, where there is one."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (_, _, closing, name, _) in enumerate(tags):
        if not name or name in _VOID:
            continue
        mine = opened.setdefault(name, [])
        if closing:
            if mine:
                ends[mine.pop()] = i
        else:
            if name in _OPTIONAL_END and mine:
                ends[mine.pop()] = i
            mine.append(i)
    return ends


def lines(page: str) -> list[tuple[int, str]]:
    """(state, text) of each block with text, in page order.

    FURNITURE: menus, headers, footers, forms, adverts, comments and the like. ARTICLE: what else
    stands in an ``article`` or ``main`` element. OPEN: all the rest. Scripts, styles and the title
    are no text. Class and id do not make furniture of an article or main that is in no article, nor
    of what holds all of these on the page, unless all are named as furniture. A heading in the header of an article belongs to the article.
    """
    tags = _tags(page)
    ends = _ends(tags)
    mains = [i for i, t in enumerate(tags) if t[3] in _MAIN and not t[2]]
    declared = any(not _is_named_furniture(tags[i][3], _attributes(tags[i][4]), False) for i in mains)
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    skip_to = nested_to = article_to = header_to = heading_to = -1
    state = OPEN

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((state, text))

    at = 0
    for i, (start, end, closing, name, attrs) in enumerate([*tags, (len(page), len(page), False, "", "")]):
        if start > at:
            text = page[at:start]
            parts.append(html.unescape(text) if "&" in text else text)
        at = end
        if name in _INLINE and (closing or skip_to > i or not attrs.strip()):
            continue
        known = _attributes(attrs) if not closing and name and skip_to <= i else {}
        furniture = not closing and bool(name) and skip_to <= i and name not in _VOID and _is_furniture(name, known)
        if not closing and name and skip_to <= i and name not in _VOID and not furniture:
            spared = name in _MAIN and i >= nested_to
            if declared and i < mains[0] and ends.get(i, 0) > mains[-1]:
                spared = True
            furniture = not spared and _is_named_furniture(name, known, i < article_to)
        if name in _INLINE and not furniture:
            continue
        if name or i == len(tags):
            flush()
        if name and not closing and skip_to <= i:
            # An element without an end reaches to the next article, or else to the end of the page.
            k = bisect_right(mains, i)
            stop = ends.get(i, mains[k] if k < len(mains) and name not in _MAIN else len(tags))
            if name == "header" and i < article_to:
                header_to = max(header_to, stop)
            elif furniture:
                skip_to = stop
            elif name in _MAIN:
                article_to = max(article_to, stop)
                if name == "article":
                    nested_to = max(nested_to, stop)
        if name in _HEADINGS and not closing:
            heading_to = ends.get(i, i + 1)
        if i < skip_to or (i < header_to and i >= heading_to):
            state = FURNITURE
        else:
            state = ARTICLE if i < article_to else OPEN
    return out
