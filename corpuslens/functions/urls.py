"""URL and crawl-name expressions."""

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import bind

_SCHEME = r"^([a-z][a-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-cased authority of a URL, port included; null when there is none or its brackets do not match."""
    host = F.regexp_extract(F.lower(url), _AUTHORITY, 1)
    balanced = host.contains("[") == host.contains("]")
    return F.when((host != "") & balanced, host)


def url_domain(url: Column) -> Column:
    """Host without one leading ``www.``; null when the URL has no host."""
    domain = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.when(domain != "", domain)


def in_domains(url: Column, domains: Iterable[str]) -> Column:
    """True when the host is one of ``domains`` or below one of them.

    A host lies at or below a domain of n labels exactly when its last n labels
    equal it, so one set lookup per distinct label count covers the whole list.
    """
    by_labels: dict[int, list[str]] = {}
    for d in sorted(set(domains)):
        by_labels.setdefault(d.count(".") + 1, []).append(d)
    if not by_labels:
        return F.lit(False)

    def among(host: Column) -> Column:
        return reduce(or_, [F.substring_index(host, ".", -n).isin(names) for n, names in by_labels.items()])

    # A filter evaluates each mention of an expression anew, so the host is bound once.
    return F.coalesce(bind(url_domain(url), among), F.lit(False))


def has_url_keyword(url: Column, keywords: Iterable[str]) -> Column:
    """True when any keyword is a substring of the lower-cased URL."""
    words = list(keywords)

    def among(lowered: Column) -> Column:
        return reduce(or_, [lowered.contains(k) for k in words], F.lit(False))

    return F.coalesce(bind(F.lower(url), among), F.lit(False))


def canonical_url(url: Column) -> Column:
    """URL without query, fragment, last-segment parameters and trailing slashes.

    ``http`` is cut out of the scheme, so an http and an https address of one page stay two pages.
    """
    u = F.lower(url)
    scheme = F.replace(F.regexp_extract(u, _SCHEME, 1), F.lit("http"), F.lit(""))
    host = F.regexp_extract(u, _AUTHORITY, 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _PATH, 1), r";[^/]*$", ""), r"/+$", "")
    joined = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        path,
    )
    return F.when((u != "") & (host.contains("[") == host.contains("]")), joined)


def url_fingerprint(url: Column, unify_scheme: bool = False) -> Column:
    """md5 of the canonical URL; ``unify_scheme`` also merges http with https."""
    canonical = canonical_url(url)
    if unify_scheme:
        canonical = F.regexp_replace(canonical, "^s:", "")
    return F.md5(canonical)


def crawl_month(crawl: Column) -> Column:
    """Month ``yyyy-MM`` of the Monday of the ISO week named in a crawl id such as ``X-2024-10``."""
    year = F.regexp_extract(crawl, r"(\d{4})-(\d{2})", 1)
    week = F.regexp_extract(crawl, r"(\d{4})-(\d{2})", 2)
    valid = (year != "") & (year != "0000") & (week != "00")
    y = F.when(valid, year).cast("int")
    w = F.when(valid, week).cast("int")
    # 4 January always lies in ISO week 1.
    week_one = F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date")
    return F.date_format(F.date_add(week_one, (w - 1) * 7), "yyyy-MM")
