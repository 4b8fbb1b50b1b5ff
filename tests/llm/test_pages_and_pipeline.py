import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import check
import corpus_pipeline
from corpuslens.llm import pages, revisits, stages
from corpuslens.llm.markup import ARTICLE, FURNITURE, OPEN, lines
from corpuslens.llm.oracles import llm_oracles
from corpuslens.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def test_states_of_lines():
    page = (
        "<html><head><title>T</title></head><body class='has-sidebar'><header><h1>Site</h1></header>"
        "<div class='cookie-notice'>We use</div><main><article class=post><header><h1>Head &amp; er</h1><span>by me</span></header>"
        "<p>One<p class='ad'>AD<p>Two <b>bo</b>ld\n x<script>var a = '</p>';</script><aside>side</aside><form><label>F</label></form>"
        "<footer>foot</footer></article><section id=comments><article class=comment><p>nice</p></article></section></main>"
    )
    assert lines(page) == [
        (FURNITURE, "Site"), (FURNITURE, "We use"), (ARTICLE, "Head & er"), (FURNITURE, "by me"), (ARTICLE, "One"), (FURNITURE, "AD"),
        (ARTICLE, "Two bold x"), (FURNITURE, "side"), (FURNITURE, "F"), (FURNITURE, "foot"), (FURNITURE, "nice"),
    ]
    assert lines("<nav><a>menu<article><p>text") == [(FURNITURE, "menu"), (ARTICLE, "text")]
    assert lines("plain &lt; text<br>more") == [(OPEN, "plain < text"), (OPEN, "more")] and lines("") == []


@pytest.mark.parametrize("page", [
    "<div id=content class='has-sidebar'><div class='sidebar'>S</div><article><p>text</p></article></div>",
    "<div id=page class='widget'><article><p>text</p></article></div>",
    "<article class='post no-sidebar comments-open'><p>text</p></article>",
    "<main class='related'><p>text</p></main>",
    "<article><h2 id='related-work'>text</h2></article>", "<article><p id='notice-1'>text</p></article>",
])
def test_names_do_not_delete_an_article(page):
    assert [t for s, t in lines(page) if s == ARTICLE] == ["text"]


def test_names_still_mark_furniture_around_articles():
    page = "<div class=sidebar><article>teaser</article></div><article>text<article class=comment>nice</article></article>"
    assert lines(page) == [(FURNITURE, "teaser"), (ARTICLE, "text"), (FURNITURE, "nice")]
    assert lines("<div>open</div><div id=comments><article class=comment>nice</article></div>") == [(OPEN, "open"), (FURNITURE, "nice")]


@pytest.mark.parametrize("part", ["<b>x", "<blockquote>word", "<a ", '<a "', "<nav>", "</p>", "<!--", "<script>"])
def test_hostile_pages_take_linear_time(part):
    page = part * (500_000 // len(part))
    assert sum(len(t) for _, t in lines(page)) <= len(page)


@pytest.mark.parametrize("a,b", [("abcdef", "xbcyef"), ("aabbaabb", "abab"), ("", "abc"), ("abc", "abc"), ("xay", "bac")])
def test_shared_lines_are_a_common_subsequence(a, b):
    places = pages.shared_lines([ord(c) for c in a], [ord(c) for c in b])
    rest = iter(b)
    assert all(a[i] in rest for i in places) and places == sorted(set(places))
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(places) == best[-1][-1]


@pytest.mark.parametrize("most", [pages.TABLE_BITS, 20])
def test_shared_lines_are_a_longest_common_subsequence_with_repeats(monkeypatch, most):
    monkeypatch.setattr(pages, "TABLE_BITS", most)
    assert pages.shared_lines([1, 2, 1, 3], [2, 1, 4]) == [1, 2]
    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(25))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places, rest = pages.shared_lines(a, b), iter(b)
        assert len(places) == best[-1][-1] and places == sorted(set(places)) and all(a[i] in rest for i in places)


def test_template_lines_go_where_markup_is_silent(spark):
    def page(body):
        return f"<body><div>Welcome to the site</div><p>{body}</p><div>All rights kept</div></body>"

    rows = [
        (1, "http://h.org/a/1", page("first story")), (2, "http://h.org/a/2", page("second story")),
        (3, "http://h.org/z", "<article><p>Welcome to the site</p></article>"), (4, "http://alone.org/", page("third")),
        (5, None, page("fourth")), (6, "http://h.org/a/3", None), (7, "http://copy.org/1", page("same")), (8, "http://copy.org/2", page("same")),
        (None, "http://h.org/a/10", page("tenth")),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS key", "2 AS text", "3 AS host")
    got = {r.page_id: r.text for r in pages.extract_text(df.repartition(3)).collect()}
    whole = "Welcome to the site {} All rights kept"
    assert got[1] == "first story" and got[2] == "second story" and got[3] == "Welcome to the site"
    assert got[4] == whole.format("third") and got[5] == whole.format("fourth") and got[6] == "" and got[None] == "tenth"
    # Copies differ in nothing, which tells nothing about their template.
    assert got[7] == got[8] == whole.format("same")
    assert pages.extract_text(df.limit(0)).collect() == []


def test_extracted_pages_of_the_tables(spark):
    got = LLM_QUERIES["op9_extract"](spark, SF).collect()
    assert all(r.n_chars == len(r.text) and "var t=" not in r.text and "</" not in r.text for r in got)
    want = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert sorted(r.page_id for r in got) == sorted(i for i, _ in want)


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, url string, captured bigint, kind string, headers map<string,string>")


def test_revisits(spark):
    full = {"ETag": 'W/"a"', "Content-Length": "9", "Cache-Control": "x", "Last-Modified": "m"}
    rows = [
        (1, "http://WWW.h.org:80/p/", 100, "response", full), (2, "https://h.org/p#x", 200_000, "response", {"etag": '"b"'}),
        (3, "http://h.org/p?utm_source=f", 150_000, "revisit", {"etag": '"a"', "content-length": "0", "CACHE-CONTROL": "y"}),
        (4, "http://h.org/p", 200_000, "revisit", {"etag": '"zzz"'}), (5, "http://h.org/p", 300_000, "revisit", {"last-modified": "m"}),
        (6, "http://h.org/p", 100, "revisit", {}), (7, None, 5, "revisit", None), (8, "http://h.org/p", None, "revisit", {}),
        (9, "http://h.org/p", 300_001, "request", {}), (10, "http://h.org/p", 150_000, "revisit", {"last-modified": "m"}),
    ]
    df = records(spark, rows)
    got = {r.record_id: r for r in revisits.resolve_revisits(df, block_seconds=1000).collect()}
    assert {k: (r.response_id, r.status) for k, r in got.items()} == {
        3: (1, "resolved"), 4: (1, "mismatch"), 5: (2, "no_validator"), 6: (None, "no_response"), 7: (None, "no_response"),
        8: (None, "no_response"), 10: (1, "resolved"),
    }
    assert got[3].headers == {"etag": '"a"', "content-length": "9", "cache-control": "y", "last-modified": "m"}
    payloads = df.withColumn("payload", F.concat(F.lit("body "), "record_id"))
    filled = {r.record_id: r.payload for r in revisits.fill_payloads(revisits.resolve_revisits(df), payloads).collect()}
    assert filled[3] == "body 1" and filled[4] is None
    assert revisits.resolve_revisits(df.limit(0)).collect() == []


def test_revisits_of_one_hot_url_as_by_looking_through_all(spark):
    """Most records of one URL within an hour, many in the same second; ids that repeat with other headers."""
    r = random.Random(8)
    rows = []
    for k in range(900):
        url = "http://hot.org/" if r.random() < 0.8 else f"http://h{r.randrange(3)}.org/"
        captured = r.choice([None, *[1000 + r.randrange(60) for _ in range(20)], r.randrange(10**6)])
        rows.append((r.choice([k, k // 2]), url, captured, r.choice(["response", "revisit"]), {"etag": str(r.randrange(3))}))
    got = sorted(((x.record_id, x.url, x.captured, x.response_id) for x in revisits.resolve_revisits(records(spark, rows), 3600).collect()), key=str)
    want = []
    for i, url, t, kind, _ in rows:
        if kind == "revisit":
            before = [(c, j) for j, u, c, k, _ in rows if k == "response" and u == url and c is not None and t is not None and c < t]
            want.append((i, url, t, max(before)[1] if before else None))
    assert got == sorted(want, key=str)
    full = {}
    for i, _, _, kind, h in rows:
        if kind == "response":
            full[i] = max(full.get(i, ""), h["etag"])
    own = {}
    for i, u, t, kind, h in rows:
        if kind == "revisit":
            own[i, u, t] = max(own.get((i, u, t), ""), h["etag"])
    for x in revisits.resolve_revisits(records(spark, rows).repartition(7), 3600).collect():
        if x.response_id is not None:
            assert x.status == ("resolved" if full[x.response_id] == own[x.record_id, x.url, x.captured] else "mismatch")


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_same_result_in_both_engines(spark, name):
    assert check.compare(spark, check.database(SF), name, SF)[0] == "same"


def test_stages_keep_their_columns_and_survive_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    # The few shingles of documents 6 and 7 occur 20,000 times in either: their fingerprints are equal.
    assert sorted(r.doc_id for r in docs.collect() if r.doc_id) == [1, 6, 9]
    mixed = stages.mix(spark, docs, SF)
    assert mixed.columns == [*docs.columns, "copy"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_rows_with_null_and_repeated_ids_get_their_own_decisions(spark):
    ((item,),) = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY length(text) DESC LIMIT 1").fetchall()
    clean = [f"{w} some clean words of a text that no benchmark holds at all" for w in ("one", "two", "three")]
    kinds = "doc_id bigint, text string, lang string, source string"
    docs = spark.createDataFrame([(i, t, "en", "a") for i in (None, 7) for t in (item, clean[0])], kinds)
    got = stages.decontaminate(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, clean[0]), (7, clean[0])]
    docs = spark.createDataFrame([(None, "12 34", "en", "a"), (None, clean[0], "en", "a"), (7, "!!", "en", "a"), (7, clean[1], "en", "a")], kinds)
    assert {r.text for r in stages.language(spark, docs, SF).collect()} <= set(clean)
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in ((None, "x"), (None, "x"), (7, "y"), (7, "y"), (None, "y"), (8, "z"), (7, "z"))], kinds)
    got = stages.exact_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x"), (7, "y"), (7, "z")]
    long = [" ".join(f"{k}w{n}" for n in range(100)) for k in (0, 1)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in ((None, long[0]), (None, long[0].upper()), (7, long[1]), (7, long[1] + "\n"))], kinds)
    got = stages.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "0"), (7, "1")]


def test_stages_learn_from_rows_without_ids(spark):
    """More rows without ids than are sampled of a language: all have the same id, so rows tell them apart."""
    texts = {"en": "the quick brown fox number {} jumps over the lazy dog", "fr": "le renard brun numéro {} saute par dessus le chien"}
    rows = [(None, texts[lang].format(n), lang, "a") for n in range(1500) for lang in texts] + [(None, "12 34", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert stages.language(spark, docs, SF).count() == 3000


def test_columns_of_the_documents_stay(spark):
    """Names that stages use themselves, next to ids that differ and to ids that do not."""
    rows = [(1, "one two three four", "en", "a"), (1, "five six seven eight", "en", "a"), (None, "nine ten", "en", "b")]
    for some in (rows, [(k, *r[1:]) for k, r in enumerate(rows)]):
        docs = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string")
        docs = docs.selectExpr("*", *[f"{k} AS {c}" for k, c in enumerate(("stage_row", "kept_row", "mixed_row", "n_taken", "component_id", "row", "copy"))])
        want = sorted(map(tuple, docs.collect()), key=str)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            assert sorted(map(tuple, stage(spark, docs, SF).collect()), key=str) == want, name
        got = stages.mix(spark, docs, SF)
        assert got.columns == docs.columns
        assert {tuple(r)[:-1] for r in got.collect()} <= {w[:-1] for w in want} and got.filter("copy < 1").isEmpty()


def test_stored_numbers_give_the_rows_that_ids_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "' ' AS text", "lang", "source", "n_chars"))
    twice = odd.unionByName(odd.filter("doc_id = -1"))
    for name, stage in corpus_pipeline.STAGES[1:3]:
        a, b = ({tuple(r) for r in stage(spark, d, SF).collect()} for d in (odd, twice))
        assert a == b, name


def test_pipeline_over_the_tables(spark):
    """Row for row against a plain computation on what language identification keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoken = stages.language(spark, docs, SF).collect()
    # Exact copies.
    kept = {}
    for r in sorted(spoken, key=lambda r: r.doc_id):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    # Fingerprints of three-word shingles link at three bits; the smallest of a component stays.
    rows = sorted(kept.values(), key=lambda r: r.doc_id)
    fps = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    rows = [r for i, r in enumerate(rows) if top(i) == i]
    # Windows of the benchmark.
    bench = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        bench |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(b) for b in bench}
    rows = [r for r in rows if not any(tuple(w[k : k + n]) in bench for w in [words(r.text or "")] for n in sizes for k in range(len(w) - n + 1))]
    # The mix, by its SQL.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    copies = {d: taken // size for d, size, *_, taken in con.sql(llm_oracles()["op10_mix"]).fetchall() if size}
    want = sorted((r.doc_id, k, r.text) for r in rows for k in range(1, copies.get(r.doc_id, 0) + 1))
    got = sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len({d for d, *_ in got}) > 100


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
