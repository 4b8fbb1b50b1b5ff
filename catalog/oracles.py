"""DuckDB SQL with the same result as each registered query, over the same whole tables."""

from catalog import inputs as I
from catalog.queries import DIGITS
from catalog.stopwords import ENGLISH
from corpuslens.defaults import (
    DOMAINS,
    EXTRA_STOP_WORDS,
    FEATURES,
    FIVE_LABELS,
    LEFT_PHRASES,
    NUM_TOPICS,
    RIGHT_PHRASES,
    TOP_TERMS,
    URL_KEYWORDS,
)
from corpuslens.operators.bootstrap import REPLICATES, THRESHOLDS

R = DIGITS


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_str(w) for w in words) + ")"


# Scalar expressions


def domain(url: str) -> str:
    return rf"nullif(regexp_replace(regexp_extract(lower({url}), '^[a-z]+://([^/?#]*)', 1), '^www\.', ''), '')"


def url_fp(url: str) -> str:
    u = f"lower({url})"
    path = rf"regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
    return (
        rf"md5(concat(CASE WHEN {u} LIKE 'https:%' THEN 's:' ELSE '' END, '//', "
        rf"regexp_extract({u}, '^https?://([^/?#]*)', 1), "
        rf"regexp_replace(regexp_replace({path}, ';[^/]*$', ''), '/+$', '')))"
    )


def squeeze(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def text_fp(t: str, n: int | None = None) -> str:
    return f"md5({squeeze(f'lower({t})' if n is None else f'lower(substring({t}, 1, {n}))')})"


def ratio(t: str) -> str:
    return rf"(length(regexp_replace({t}, '[\x00-\x7F]', '', 'g')) / length({t}))"


def words(t: str) -> str:
    return rf"cast(len(regexp_split_to_array({t}, '\s+')) AS INTEGER)"


def cleaned(t: str) -> str:
    s = rf"regexp_replace(lower({t}), 'https?://\S+', ' ', 'g')"
    s = squeeze(rf"regexp_replace({s}, '\S+@\S+\.\S+', ' ', 'g')")
    return s


def month(crawl: str) -> str:
    y = rf"cast(regexp_extract({crawl}, '(\d{{4}})-(\d{{2}})', 1) AS INTEGER)"
    w = rf"cast(regexp_extract({crawl}, '(\d{{4}})-(\d{{2}})', 2) AS INTEGER)"
    return f"strftime(date_trunc('week', make_date({y}, 1, 4)) + to_days(7 * ({w} - 1)), '%Y-%m')"


def phrases(t: str, ps: list[str]) -> str:
    low = f"lower({t})"
    return "(" + " + ".join(
        f"cast((length({low}) - length(replace({low}, {_str(p)}, ''))) / {len(p)} AS INTEGER)" for p in ps
    ) + ")"


def slant(t: str, left: list[str] = I.LEFT, right: list[str] = I.RIGHT) -> str:
    left, right = phrases(t, left), phrases(t, right)
    return f"(CASE WHEN {left} + {right} > 0 THEN ({right} - {left}) / ({left} + {right}) ELSE 0.0 END)"


# Common table expressions, in order of dependency

CTES: dict[str, str] = {
    "fx_docs": I.DOCS_SQL,
    "fx_pages": I.PAGES_SQL,
    "fx_index": I.INDEX_SQL,
    "clean_pages": f"SELECT *, {words('text')} AS word_count FROM fx_docs",
}


def _first_by(source: str, key: str) -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY crawl, {key} "
        f"ORDER BY fetch_time, url) AS rn FROM {source}) WHERE rn = 1"
    )


CTES["by_url"] = _first_by("clean_pages", url_fp("url"))
CTES["by_text"] = _first_by("by_url", text_fp("text"))
CTES["corpus"] = f"""
    SELECT doc_id, url, domain, crawl, fetch_time, word_count, c AS text, {month('crawl')} AS year_month
    FROM (SELECT *, {cleaned('text')} AS c FROM by_text WHERE {ratio('text')} <= 0.15)
    WHERE len(string_split(c, ' ')) >= 50"""


def _boost(word: str) -> str:
    cases = " ".join(f"WHEN {_str(w)} THEN {v}" for w, v in I.BOOSTERS.items())
    return f"(CASE {word} {cases} ELSE 0.0 END)"


def _negated(word: str) -> str:
    return f"(coalesce({word}, '') IN {_list(I.NEGATORS)} OR coalesce({word}, '') LIKE '%n''t%')"


def sentiment(source: str, key: str, n_chars: int | None) -> dict[str, str]:
    """CTEs ending in ``sentiment``: scores by ``key`` of the texts in ``source``."""
    text = "text" if n_chars is None else f"substring(text, 1, {n_chars})"
    punctuation = _str("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    steps = {
        "lex": "SELECT * FROM (VALUES " + ", ".join(f"({_str(t)}, {v}::DOUBLE)" for t, v in I.TERMS.items())
        + ") AS t(term, valence)",
        "heads": f"SELECT {key}, {text} AS t FROM {source}",
        "raw_words": rf"""SELECT {key}, unnest(ws) AS raw, generate_subscripts(ws, 1) AS i FROM (
            SELECT {key}, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS ws FROM heads)""",
        "stripped": f"""SELECT {key}, i, CASE WHEN length(trim(raw, {punctuation})) <= 2 THEN raw
            ELSE trim(raw, {punctuation}) END AS x FROM raw_words""",
        "cased": f"""SELECT {key}, i, lower(x) AS w, loud AND bool_or(NOT loud) OVER (PARTITION BY {key}) AS loud
            FROM (SELECT *, x = upper(x) AND x <> lower(x) AS loud FROM stripped)""",
        "near": f"""SELECT *, lag(loud, 1) OVER o AS l1, lag(loud, 2) OVER o AS l2, lag(loud, 3) OVER o AS l3, lead(w, 2) OVER o AS nxt2, lag(w, 1) OVER o AS p1, lag(w, 2) OVER o AS p2, lag(w, 3) OVER o AS p3,
            lead(w, 1) OVER o AS nxt, min(CASE WHEN w = 'but' THEN i END) OVER (PARTITION BY {key}) AS but
            FROM cased WINDOW o AS (PARTITION BY {key} ORDER BY i)""",
        "known": """SELECT n.*, l.valence, l1.term IS NOT NULL AS in1, l2.term IS NOT NULL AS in2,
            l3.term IS NOT NULL AS in3, ln.term IS NOT NULL AS innxt
            FROM near n LEFT JOIN lex l ON n.w = l.term LEFT JOIN lex l1 ON n.p1 = l1.term
            LEFT JOIN lex l2 ON n.p2 = l2.term LEFT JOIN lex l3 ON n.p3 = l3.term
            LEFT JOIN lex ln ON n.nxt = ln.term""",
        "v0": """SELECT *, a0 + CASE WHEN NOT loud OR valence IS NULL THEN 0 WHEN a0 > 0 THEN 0.733 ELSE -0.733 END AS a FROM (SELECT *, CASE WHEN valence IS NULL THEN 0.0
            WHEN coalesce(p1, '') = 'no' OR coalesce(p2, '') = 'no'
              OR (coalesce(p3, '') = 'no' AND coalesce(p1, '') IN ('or', 'nor')) THEN valence * -0.74
            WHEN w = 'no' AND innxt THEN 0.0 ELSE valence END AS a0 FROM known)""",
    }
    extra = {
        1: "",
        2: "WHEN coalesce(p2, '') = 'never' AND coalesce(p1, '') IN ('so', 'this') THEN 1.25 "
           "WHEN coalesce(p2, '') = 'without' AND coalesce(p1, '') = 'doubt' THEN 1.0 ",
        3: "WHEN (coalesce(p3, '') = 'never' AND coalesce(p2, '') IN ('so', 'this')) "
           "OR coalesce(p1, '') IN ('so', 'this') THEN 1.25 "
           "WHEN coalesce(p3, '') = 'without' AND (coalesce(p2, '') = 'doubt' OR coalesce(p1, '') = 'doubt') THEN 1.0 ",
    }
    for d, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
        louder = f"CASE WHEN NOT l{d} THEN 0 WHEN a > 0 THEN 0.733 ELSE -0.733 END"
        boost = f"(CASE WHEN p{d} NOT IN {_list(I.BOOSTERS)} THEN 0.0 WHEN a < 0 THEN -{_boost(f'p{d}')} + {louder} ELSE {_boost(f'p{d}')} + {louder} END * {damping})"
        steps[f"v{d}"] = f"""SELECT * REPLACE (CASE WHEN valence IS NOT NULL AND p{d} IS NOT NULL AND NOT in{d}
            THEN (a + {boost}) * CASE {extra[d]}WHEN {_negated(f'p{d}')} THEN -0.74 ELSE 1.0 END
            ELSE a END AS a) FROM v{d - 1}"""
    around = ["w || ' ' || nxt || ' ' || nxt2", "w || ' ' || nxt", "p1 || ' ' || w", "p2 || ' ' || p1 || ' ' || w", "p2 || ' ' || p1",
              "p3 || ' ' || p2 || ' ' || p1", "p3 || ' ' || p2"]
    idiom = " ".join(f"WHEN {_str(p)} THEN {v}::DOUBLE" for p, v in I.IDIOMS.items())
    steps["vi"] = f"""SELECT * REPLACE (CASE WHEN valence IS NOT NULL AND p3 IS NOT NULL AND NOT in3
        THEN coalesce({', '.join(f"CASE {x} {idiom} END" for x in around)}, a) + {' + '.join(_boost(around[k]) for k in (5, 6, 4))}
        ELSE a END AS a) FROM v3"""
    steps["v4"] = f"""SELECT *, CASE WHEN w IN {_list(I.BOOSTERS)} OR (w = 'kind' AND coalesce(nxt, '') = 'of') THEN 0.0
        ELSE CASE WHEN coalesce(p1, '') = 'least' AND NOT in1 AND coalesce(p2, '') NOT IN ('at', 'very')
            THEN a * -0.74 ELSE a END END
        * CASE WHEN but IS NULL THEN 1.0 WHEN i < but THEN 0.5 WHEN i > but THEN 1.5 ELSE 1.0 END AS v FROM vi"""
    steps["sums"] = f"""SELECT {key}, round(sum(v), 9) AS s, round(sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END), 9) AS up,
        round(sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END), 9) AS down, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS calm
        FROM v4 GROUP BY {key}"""
    bangs = "(length(t) - length(replace(t, '!', '')))"
    marks = "(length(t) - length(replace(t, '?', '')))"
    steps["emphasis"] = f"""SELECT {key}, least({bangs}, 4) * 0.292 + CASE WHEN {marks} <= 1 THEN 0.0
        WHEN {marks} <= 3 THEN {marks} * 0.18 ELSE 0.96 END AS amp FROM heads"""
    steps["loud"] = f"""SELECT e.{key}, s.s + CASE WHEN s.s > 0 THEN amp WHEN s.s < 0 THEN -amp ELSE 0 END AS total,
        up + CASE WHEN up > down THEN amp ELSE 0 END AS up, down + CASE WHEN down > up THEN amp ELSE 0 END AS down,
        calm FROM emphasis e LEFT JOIN sums s ON e.{key} = s.{key}"""
    steps["sentiment"] = f"""SELECT {key},
        coalesce(round(greatest(-1.0, least(1.0, total / sqrt(total * total + 15))), 4), 0.0) AS sentiment_compound,
        coalesce(round(up / (up + down + calm), 3), 0.0) AS sentiment_pos,
        coalesce(round(down / (up + down + calm), 3), 0.0) AS sentiment_neg,
        coalesce(round(calm / (up + down + calm), 3), 0.0) AS sentiment_neu FROM loud"""
    return steps


CTES |= sentiment("corpus", "doc_id", None)
CTES["scored"] = f"""
    SELECT c.* EXCLUDE (text), {slant('text')} AS partisan_score,
      s.sentiment_compound, s.sentiment_pos, s.sentiment_neg, s.sentiment_neu
    FROM corpus c JOIN sentiment s ON c.doc_id = s.doc_id"""
CTES["mixes"] = """
    SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS mix,
      list_transform(range(0, 64), lambda i: -1 + 2 * i / 63) AS labels FROM embeddings"""
CTES["topic_scores"] = """
    SELECT vec_id, mix, cast(list_position(mix, list_max(mix)) - 1 AS INTEGER) AS dominant_topic,
      CASE WHEN list_sum(mix) <> 0 THEN list_inner_product(mix, labels) / list_sum(mix) ELSE 0.0 END
        AS topic_ideology_score FROM mixes"""
CTES["doc_topics"] = f"""
    SELECT doc_id, crawl, url, domain, {month('crawl')} AS year_month, mix, dominant_topic, topic_ideology_score
    FROM fx_docs JOIN topic_scores ON doc_id = vec_id"""
CTES["joined"] = """
    SELECT t.crawl, t.url, t.domain, t.year_month, t.dominant_topic, t.topic_ideology_score, s.sentiment_compound,
      s.partisan_score, s.sentiment_pos, s.sentiment_neg,
      (s.partisan_score + t.topic_ideology_score) / 2 AS composite_ideology
    FROM doc_topics t JOIN scored s ON t.crawl = s.crawl AND t.url = s.url"""
CTES["modes"] = """
    SELECT domain, year_month, dominant_topic AS modal_topic FROM (
      SELECT domain, year_month, dominant_topic,
        row_number() OVER (PARTITION BY domain, year_month ORDER BY count(*) DESC, dominant_topic) AS rn
      FROM joined GROUP BY domain, year_month, dominant_topic) WHERE rn = 1"""
CTES["panel"] = f"""
    SELECT j.domain, j.year_month, count(*) AS doc_count, avg(composite_ideology) AS ideology_score,
      stddev_samp(composite_ideology) AS ideology_std, avg(sentiment_compound) AS avg_sentiment,
      avg(sentiment_pos) AS avg_pos_sentiment, avg(sentiment_neg) AS avg_neg_sentiment,
      avg(topic_ideology_score) AS avg_topic_ideology, avg(partisan_score) AS avg_partisan_score,
      percentile_disc(0.5) WITHIN GROUP (ORDER BY dominant_topic) AS median_topic,
      any_value(m.modal_topic) AS modal_topic
    FROM joined j JOIN modes m ON j.domain = m.domain AND j.year_month = m.year_month
    GROUP BY j.domain, j.year_month HAVING count(*) >= {I.PANEL_DOCS}"""
_AVERAGES = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
CTES["features"] = f"""
    SELECT domain, {_AVERAGES}, cast(sum(doc_count) AS BIGINT) AS total_docs FROM panel
    GROUP BY domain HAVING sum(doc_count) >= {I.DOMAIN_DOCS}"""
CTES["clusters"] = f"SELECT *, {I.CLUSTER} FROM features"
CTES["summary"] = """
    SELECT cluster, avg(ideology_score) AS ideology_score_mean, avg(avg_sentiment) AS avg_sentiment_mean,
      cast(sum(total_docs) AS BIGINT) AS doc_count_sum, count(domain) AS domain_count FROM clusters GROUP BY cluster"""
_LABELS = " ".join(f"WHEN {i} THEN {_str(n)}" for i, n in enumerate(FIVE_LABELS))
CTES["labelled"] = f"""
    SELECT *, CASE rk {_LABELS} ELSE concat('Cluster ', cast(rk AS VARCHAR)) END AS ideology_label FROM (
      SELECT *, row_number() OVER (ORDER BY ideology_score_mean, cluster) - 1 AS rk FROM summary)"""
CTES["labelled_domains"] = """
    SELECT c.*, l.ideology_label FROM clusters c LEFT JOIN labelled l ON c.cluster = l.cluster"""
_CRAWL_OF_MONTH = "CASE year_month " + " ".join(
    f"WHEN {month(_str(c))} THEN {_str(c)}" for c in I.CRAWLS
) + " END"
CTES["crawl_panel"] = f"SELECT *, {_CRAWL_OF_MONTH} AS crawl FROM panel"
CTES["crawl_clusters"] = f"""
    SELECT crawl, domain, {_AVERAGES}, cast(sum(doc_count) AS BIGINT) AS total_docs, {I.CLUSTER}
    FROM crawl_panel GROUP BY crawl, domain HAVING sum(doc_count) >= {I.PANEL_DOCS}"""


def polarization(source: str, crawl: str) -> str:
    return f"""
    SELECT crawl, round(CASE WHEN b + w > 0 THEN b / (b + w) ELSE 0.0 END, 4) AS polarization_index,
      round(b, 4) AS between_cluster_var, round(w, 4) AS within_cluster_var, n_clusters, n_domains FROM (
      SELECT crawl, sum(n * power(m - g, 2)) / sum(n) AS b, sum(n * v) / sum(n) AS w,
        count(*) AS n_clusters, cast(sum(n) AS BIGINT) AS n_domains FROM (
        SELECT crawl, cluster, count(*) AS n, avg(ideology_score) AS m, any_value(g) AS g,
          coalesce(var_samp(ideology_score), 0.0) AS v FROM (
          SELECT *, avg(ideology_score) OVER (PARTITION BY crawl) AS g
          FROM (SELECT {crawl} AS crawl, cluster, ideology_score FROM {source}))
        GROUP BY crawl, cluster) GROUP BY crawl)"""


CTES["metrics"] = polarization("clusters", "'all'")
CTES["crawl_metrics"] = polarization("crawl_clusters", "crawl")
_TIMES = " + ".join(f"(u >= {t})::INT" for t in THRESHOLDS)
CTES["replicates"] = f"""
    SELECT crawl, replicate, CASE WHEN b + w > 0 THEN b / (b + w) ELSE 0.0 END AS idx FROM (
      SELECT crawl, replicate, sum(n * power(m - g, 2)) / sum(n) AS b, sum(n * v) / sum(n) AS w FROM (
        SELECT *, sum(n * m) OVER (PARTITION BY crawl, replicate) / sum(n) OVER (PARTITION BY crawl, replicate) AS g FROM (
          SELECT crawl, replicate, cluster, sum(t) AS n, any_value(m) AS m,
            CASE WHEN sum(t) > 1 THEN sum(t * power(ideology_score - m, 2)) / (sum(t) - 1) ELSE 0.0 END AS v FROM (
            SELECT *, sum(t * ideology_score) OVER c / sum(t) OVER c AS m FROM (
              SELECT *, CASE WHEN replicate = 0 THEN 1 ELSE {_TIMES} END AS t FROM (
                SELECT crawl, cluster, ideology_score, replicate,
                  cast('0x' || substring(md5('42:' || domain || ':' || replicate), 1, 8) AS BIGINT) AS u
                FROM crawl_clusters, (SELECT unnest(range({REPLICATES + 1})) AS replicate) WHERE ideology_score IS NOT NULL)) WHERE t > 0
            WINDOW c AS (PARTITION BY crawl, replicate, cluster)) GROUP BY crawl, replicate, cluster)) GROUP BY crawl, replicate)"""
CTES["blocks"] = r"""
    SELECT page_id, list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
      '<(?:h1|p)>'), lambda b: regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        b, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')) AS parts FROM pages"""
CTES["page_text"] = r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(parts, lambda b: b <> ''), ' '),
      '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM blocks"""


def extracted(n_chars: int | None) -> str:
    text = "text" if n_chars is None else f"substring(text, 1, {n_chars})"
    return f"""
    SELECT url, domain, crawl, fetch_time, text, word_count FROM (
      SELECT url, {domain('url')} AS domain, crawl, fetch_time, {text} AS text, {words(text)} AS word_count
      FROM fx_pages p JOIN page_text t ON p.page_id = t.page_id)
    WHERE domain IS NOT NULL AND word_count >= 100"""


CTES["tokens"] = r"""
    SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 3) AS ws
    FROM documents"""
_STOP = "[" + ", ".join(_str(w) for w in [*ENGLISH, *EXTRA_STOP_WORDS]) + "]"
CTES["kept_tokens"] = (
    f"SELECT doc_id, lang, list_filter(ws, lambda w: NOT list_contains({_STOP}, w)) AS ws FROM tokens"
)
CTES["counts"] = """
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM kept_tokens) GROUP BY doc_id, term"""
CTES["vocab"] = """
    SELECT term, count(*) AS df, cast(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term HAVING count(*) >= 5"""


def _needed(sql: str, known: dict[str, str]) -> set[str]:
    """Names of the CTEs that a statement uses, directly or through others."""
    import re

    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text):
            if name in known and name not in used:
                used.add(name)
                todo.append(known[name])
    return used


def statement(sql: str, **more: str) -> str:
    known = CTES | more
    used = _needed(sql, known)
    parts = [f"{n} AS ({known[n]})" for n in known if n in used]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def _rounded(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, {R}) AS {c}" for c in columns)


_SENTIMENT = ["sentiment_compound", "sentiment_pos", "sentiment_neg", "sentiment_neu"]
_PANEL = [
    "ideology_score", "ideology_std", "avg_sentiment", "avg_pos_sentiment", "avg_neg_sentiment",
    "avg_topic_ideology", "avg_partisan_score",
]
_PANEL_SELECT = f"domain, year_month, doc_count, {_rounded(_PANEL)}, median_topic, modal_topic"
_SUMMARY_SELECT = (
    f"cluster, {_rounded(['ideology_score_mean', 'avg_sentiment_mean'])}, doc_count_sum, domain_count"
)
_METRICS = "polarization_index, between_cluster_var, within_cluster_var, n_clusters, n_domains"
def _domain_hit(domains: list[str]) -> str:
    return " OR ".join(f"{domain('url')} = {_str(d)} OR {domain('url')} LIKE {_str('%.' + d)}" for d in domains)


_DOMAIN_HIT = _domain_hit(I.DOMAIN_LIST)
_WANTED = f"content_mime_detected = 'text/html' AND ({_DOMAIN_HIT} OR contains(lower(url), '/en/'))"
_Z = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), {R}) AS z_{c}" for c in FEATURES
)


def _documents(column: str) -> str:
    return f"SELECT doc_id, {column} FROM documents"


def _far(a: str, b: str) -> str:
    return " + ".join(f"power({a}[{j}] - {b}[{j}], 2)" for j in range(1, len(FEATURES) + 1))


CTES["lang_terms"] = """
    SELECT topic, term FROM (SELECT lang AS topic, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rn
      FROM (SELECT lang, unnest(ws) AS term FROM kept_tokens) GROUP BY lang, term) WHERE rn <= 20"""
CTES["token_windows"] = """
    SELECT doc_id, s, ws[s:s + 9] AS w FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM kept_tokens WHERE len(ws) > 0)"""
CTES["window_terms"] = """
    SELECT DISTINCT doc_id, s, term FROM (SELECT doc_id, s, unnest(w) AS term FROM token_windows) WHERE term IN (SELECT term FROM lang_terms)"""
CTES["window_pairs"] = """
    SELECT l.term AS a, r.term AS b, count(*) AS n FROM window_terms l JOIN window_terms r ON l.doc_id = r.doc_id AND l.s = r.s AND l.term <= r.term
    GROUP BY l.term, r.term"""
_SCALED = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in FEATURES)
CTES["scaled"] = f"SELECT domain, [{_SCALED}] AS z, row_number() OVER (ORDER BY domain) - 1 AS place FROM features"
CTES["assigned"] = f"""
    SELECT domain, k::INT AS k, cluster::INT AS cluster FROM (
      SELECT s.domain, k, c.place AS cluster, row_number() OVER (PARTITION BY s.domain, k ORDER BY {_far('s.z', 'c.z')}, c.place) AS rn
      FROM scaled s, (SELECT unnest({I.GIVEN_K}) AS k), scaled c WHERE c.place < k) WHERE rn = 1"""
_NUMBER = " ".join(f"WHEN {_str(x)} THEN {i}" for i, x in enumerate(I.LANGS))
CTES["halves"] = f"""
    SELECT half, CASE WHEN half = 0 THEN t ELSE {len(I.LANGS) - 1} - t END AS topic, term, count(*)::DOUBLE AS w FROM (
      SELECT doc_id % 2 AS half, CASE lang {_NUMBER} END AS t, unnest(ws) AS term FROM kept_tokens) WHERE t IS NOT NULL GROUP BY half, t, term"""
CTES["cosines"] = """
    SELECT l.topic, e.topic AS other, sum(l.w * e.w) / any_value(ln.n * en.n) AS cosine
    FROM halves l JOIN halves e ON l.term = e.term AND l.half = 1 AND e.half = 0
    JOIN (SELECT half, topic, sqrt(sum(w * w)) AS n FROM halves GROUP BY half, topic) ln ON ln.half = 1 AND ln.topic = l.topic
    JOIN (SELECT half, topic, sqrt(sum(w * w)) AS n FROM halves GROUP BY half, topic) en ON en.half = 0 AND en.topic = e.topic
    GROUP BY l.topic, e.topic"""


def oracles() -> dict[str, str]:
    whole = sentiment("documents", "doc_id", None)
    first = sentiment("documents", "doc_id", None)
    return {
        "partisan_panel": statement(f"""
            SELECT domain, year_month, count(*) AS doc_count, round(avg({slant('text')}), {R}) AS avg_partisan_score
            FROM corpus GROUP BY domain, year_month"""),
        "stage_roundtrip": statement("SELECT * EXCLUDE (doc_id) FROM clean_pages"),
        "crawl_rows": statement("SELECT url, fetch_time, crawl FROM fx_index WHERE crawl = 'CC-MAIN-2024-10'"),
        "parse_records": statement("SELECT url, crawl, fetch_time, html FROM fx_pages"),
        "fetch_records": statement("SELECT url, crawl, fetch_time, html FROM fx_pages"),
        # The body of a record goes on to the blank lines before the next record.
        "read_archive": statement(
            "SELECT url, crawl, fetch_time, concat(html, chr(13), chr(10), chr(13), chr(10)) AS html FROM fx_pages"
        ),
        "archive_types": statement(
            f"SELECT crawl, record_type, count(*) AS n FROM fx_pages, (VALUES ('request'), ('response')) t(record_type) "
            f"WHERE crawl IN {_list(I.CRAWLS[:3])} GROUP BY crawl, record_type"
        ),
        "topic_labels": """
            SELECT cast(i - 1 AS INTEGER) AS topic, round(greatest(-1.0, least(1.0, avg(x::DOUBLE) * 10)), 6) AS label
            FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i""",
        "summary_csv": statement(f"SELECT {_SUMMARY_SELECT} FROM summary"),
        "read_metrics": statement(f"SELECT crawl, {_METRICS} FROM crawl_metrics"),
        "read_panel": statement(f"SELECT {_PANEL_SELECT}, crawl FROM crawl_panel"),
        "stage_counts": statement(
            f"""SELECT stage, row_count FROM (
              SELECT 'segments' AS stage, (SELECT count(*) FROM picked) AS row_count
              UNION ALL SELECT 'fetched', (SELECT count(*) FROM picked)
              UNION ALL SELECT 'rejects', 0
              UNION ALL SELECT 'raw-html', (SELECT count(*) FROM picked)
              UNION ALL SELECT 'clean-text', (SELECT count(*) FROM thick)
              UNION ALL SELECT 'corpus', (SELECT count(*) FROM last))""",
            picked=f"SELECT url FROM fx_index WHERE {_WANTED}",
            thick=f"SELECT x.* FROM ({extracted(None)}) x JOIN picked ON x.url = picked.url",
            once=_first_by("thick", url_fp("url")),
            twice=_first_by("once", text_fp("text")),
            last=f"""SELECT * FROM (SELECT *, {cleaned('text')} AS c FROM twice WHERE {ratio('text')} <= 0.15)
                WHERE len(string_split(c, ' ')) >= 50""",
        ),
        "filter_domains": f"SELECT page_id, url FROM pages WHERE {_DOMAIN_HIT}",
        "filter_url_keywords": statement("SELECT doc_id, url FROM fx_docs WHERE contains(lower(url), '/politics/')"),
        "filter_index": statement(f"""
            SELECT url, fetch_time, warc_filename, content_mime_detected, crawl FROM fx_index
            WHERE crawl = 'CC-MAIN-2024-10' AND {_WANTED}"""),
        "sample_index_by_url": statement("""
            SELECT url, crawl FROM fx_index
            WHERE cast('0x' || substring(md5(concat('42:', url)), 1, 8) AS BIGINT) < 2147483648"""),
        "url_domain": f"SELECT page_id, {domain('url')} AS domain FROM pages",
        "url_fingerprint": f"SELECT page_id, {url_fp('url')} AS url_fp FROM pages",
        "crawl_month": statement(f"SELECT doc_id, {month('crawl')} AS year_month FROM fx_docs"),
        # The given texts hold no character that NFKC would change.
        "normalize_text": _documents(
            r"trim(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), "
            "' ' || chr(10)) AS text"
        ),
        "word_count": _documents(f"{words('text')} AS word_count"),
        "text_fingerprint": _documents(f"{text_fp('text')} AS text_fp"),
        "text_fingerprint_whole": _documents(f"{text_fp('text', None)} AS text_fp"),
        "non_ascii_ratio": _documents(f"round({ratio('text')}, {R}) AS ratio"),
        "clean_for_nlp": f"""
            SELECT doc_id, CASE WHEN len(string_split(c, ' ')) >= 50 THEN c END AS text
            FROM (SELECT doc_id, {cleaned('text')} AS c FROM documents)""",
        "phrase_counts": _documents(
            f"{phrases('text', I.LEFT)} AS left_count, {phrases('text', I.RIGHT)} AS right_count"
        ),
        "default_phrases": statement(
            f"SELECT doc_id, cast({phrases('text', LEFT_PHRASES)} AS BIGINT) AS left_count, cast({phrases('text', RIGHT_PHRASES)} AS BIGINT) AS right_count, "
            f"round({slant('text', LEFT_PHRASES, RIGHT_PHRASES)}, {R}) AS score FROM ({I.PHRASED_SQL})"
        ),
        "default_index": statement(
            f"SELECT page_id, url, 'domain' AS kept_by FROM ({I.LISTED_SQL}) WHERE {_domain_hit(DOMAINS)} UNION ALL "
            f"SELECT page_id, url, 'keyword' AS kept_by FROM ({I.LISTED_SQL}) "
            f"WHERE {' OR '.join(f'contains(lower(url), {_str(k)})' for k in URL_KEYWORDS)}"
        ),
        "partisan_score": _documents(f"round({slant('text')}, {R}) AS score"),
        "lexicon_sentiment": statement(f"SELECT doc_id, {_rounded(_SENTIMENT)} FROM sentiment", **first),
        "lexicon_sentiment_whole": statement(f"SELECT doc_id, {_rounded(_SENTIMENT)} FROM sentiment", **whole),
        "extract_pages": statement(extracted(None)),
        "extract_pages_whole": statement(extracted(None)),
        "min_words_filter": statement(f"SELECT doc_id, url FROM fx_docs WHERE {words('text')} >= 100"),
        "non_ascii_filter": statement(f"SELECT doc_id, url FROM fx_docs WHERE {ratio('text')} <= 0.15"),
        "dedup_url": statement("SELECT doc_id, url, fetch_time FROM by_url"),
        "dedup_text": statement(
            "SELECT doc_id, url, fetch_time FROM first", first=_first_by("fx_docs", text_fp("text"))
        ),
        "dedup_text_whole": statement(
            "SELECT doc_id, url, fetch_time FROM first", first=_first_by("fx_docs", text_fp("text", None))
        ),
        "build_corpus": statement("SELECT * FROM corpus"),
        "corpus_by_instalments": statement("SELECT * FROM corpus"),
        "score_documents": statement(f"""
            SELECT * EXCLUDE (partisan_score, sentiment_compound, sentiment_pos, sentiment_neg, sentiment_neu),
              {_rounded(['partisan_score', *_SENTIMENT])} FROM scored"""),
        "sentiment_panel": statement(f"""
            SELECT domain, year_month, count(*) AS doc_count, round(cast(sum(cast(sentiment_compound AS DECIMAL(20,4))) AS DOUBLE) / count(sentiment_compound), {R}) AS avg_sentiment,
              round(stddev_samp(sentiment_compound), {R}) AS std_sentiment,
              round(avg(partisan_score), {R}) AS avg_partisan_score,
              round(stddev_samp(partisan_score), {R}) AS std_partisan_score,
              round(cast(sum(cast(sentiment_pos AS DECIMAL(20,4))) AS DOUBLE) / count(sentiment_pos), {R}) AS avg_pos, round(cast(sum(cast(sentiment_neg AS DECIMAL(20,4))) AS DOUBLE) / count(sentiment_neg), {R}) AS avg_neg
            FROM scored GROUP BY domain, year_month HAVING count(*) >= 5"""),
        "ideology_panel": statement(f"SELECT {_PANEL_SELECT} FROM panel"),
        # The parts of six crawls add up to the panel of all documents.
        "merged_sentiment_panel": statement(f"""
            SELECT domain, count(*) AS doc_count, round(cast(sum(cast(sentiment_compound AS DECIMAL(20,4))) AS DOUBLE) / count(sentiment_compound), {R}) AS avg_sentiment,
              round(stddev_samp(sentiment_compound), {R}) AS std_sentiment, round(avg(partisan_score), {R}) AS avg_partisan_score,
              round(stddev_samp(partisan_score), {R}) AS std_partisan_score,
              round(cast(sum(cast(sentiment_pos AS DECIMAL(20,4))) AS DOUBLE) / count(sentiment_pos), {R}) AS avg_pos,
              round(cast(sum(cast(sentiment_neg AS DECIMAL(20,4))) AS DOUBLE) / count(sentiment_neg), {R}) AS avg_neg
            FROM scored GROUP BY domain HAVING count(*) >= 5"""),
        "merged_ideology_panel": statement(f"""
            SELECT domain, doc_count, {_rounded(_PANEL)}, median_topic, modal_topic FROM (
              SELECT j.domain, count(*) AS doc_count, avg(composite_ideology) AS ideology_score,
                stddev_samp(composite_ideology) AS ideology_std, avg(sentiment_compound) AS avg_sentiment,
                avg(sentiment_pos) AS avg_pos_sentiment, avg(sentiment_neg) AS avg_neg_sentiment,
                avg(topic_ideology_score) AS avg_topic_ideology, avg(partisan_score) AS avg_partisan_score,
                percentile_disc(0.5) WITHIN GROUP (ORDER BY dominant_topic) AS median_topic, any_value(m.modal_topic) AS modal_topic
              FROM joined j JOIN (
                SELECT domain, dominant_topic AS modal_topic, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, dominant_topic) AS rn
                FROM joined GROUP BY domain, dominant_topic) m ON j.domain = m.domain AND rn = 1
              GROUP BY j.domain HAVING count(*) >= {I.PANEL_DOCS})"""),
        "domain_features": statement(f"SELECT domain, {_rounded(FEATURES)}, total_docs FROM features"),
        "domain_features_weighted": statement(
            "SELECT domain, " + ", ".join(
                f"round(sum({c} * doc_count) / sum(doc_count), {R}) AS {c}" for c in FEATURES
            ) + f""", cast(sum(doc_count) AS BIGINT) AS total_docs FROM panel
            GROUP BY domain HAVING sum(doc_count) >= {I.DOMAIN_DOCS}"""
        ),
        "cluster_summary": statement(f"SELECT {_SUMMARY_SELECT} FROM summary"),
        "label_clusters": statement("SELECT cluster, domain_count, ideology_label FROM labelled"),
        "visible_domains": statement(f"""
            SELECT domain, cluster, total_docs, ideology_label FROM labelled_domains
            WHERE total_docs >= {I.VIEW_DOCS}"""),
        "label_summary": statement(f"""
            SELECT ideology_label, count(domain) AS domains, round(avg(ideology_score), {R}) AS avg_ideology,
              round(avg(avg_sentiment), {R}) AS avg_sentiment, cast(sum(total_docs) AS BIGINT) AS total_docs
            FROM labelled_domains WHERE total_docs >= {I.VIEW_DOCS} GROUP BY ideology_label"""),
        "polarization_index": statement(f"SELECT {_METRICS} FROM metrics"),
        "polarization_interval": statement("""
            SELECT crawl, round(max(CASE WHEN replicate = 0 THEN idx END), 4) AS polarization_index,
              round(quantile_cont(CASE WHEN replicate > 0 THEN idx END, 0.025), 4) AS low,
              round(quantile_cont(CASE WHEN replicate > 0 THEN idx END, 0.975), 4) AS high FROM replicates GROUP BY crawl"""),
        "polarization_changes": statement("""
            SELECT crawl, round(max(CASE WHEN replicate = 0 THEN d END), 4) AS change,
              round(quantile_cont(CASE WHEN replicate > 0 THEN d END, 0.025), 4) AS low,
              round(quantile_cont(CASE WHEN replicate > 0 THEN d END, 0.975), 4) AS high
            FROM (SELECT *, idx - lag(idx) OVER (PARTITION BY replicate ORDER BY crawl) AS d FROM replicates)
            GROUP BY crawl HAVING max(CASE WHEN replicate = 0 THEN d END) IS NOT NULL"""),
        "topic_shares": statement(
            f"SELECT url, crawl, {NUM_TOPICS} AS n_topics, 1.0::DOUBLE AS total, true AS first_largest, true AS none_negative FROM corpus"
        ),
        "topic_ranks": statement(
            f"SELECT unnest(range({NUM_TOPICS}))::INT AS topic, {TOP_TERMS}::BIGINT AS n_terms, {TOP_TERMS}::BIGINT AS n_different, "
            f"{TOP_TERMS}::BIGINT AS last_rank, {TOP_TERMS}::BIGINT AS n_known, true AS falling"
        ),
        "polarization_trend": statement(f"""
            SELECT count(*) AS n_crawls, min(crawl) AS earliest_crawl,
              round(arg_min(polarization_index, crawl), {R}) AS earliest_index, max(crawl) AS latest_crawl,
              round(arg_max(polarization_index, crawl), {R}) AS latest_index,
              round(arg_max(polarization_index, crawl) - arg_min(polarization_index, crawl), {R}) AS delta,
              round(arg_max(between_cluster_var, crawl), {R}) AS latest_between_var,
              round(arg_max(within_cluster_var, crawl), {R}) AS latest_within_var FROM crawl_metrics"""),
        "domain_trend": statement(f"""
            SELECT domain, year_month, round(avg_sentiment, {R}) AS avg_sentiment FROM panel
            WHERE domain IN {_list(I.DOMAIN_LIST)}"""),
        "topic_prevalence": statement(f"""
            SELECT year_month, cast(i - 1 AS INTEGER) AS topic, round(avg(x), {R}) AS avg_share FROM (
              SELECT year_month, unnest(mix) AS x, generate_subscripts(mix, 1) AS i FROM doc_topics)
            GROUP BY year_month, i"""),
        "join_scores": statement(f"""
            SELECT crawl, url, domain, year_month, dominant_topic,
              {_rounded(['topic_ideology_score', 'sentiment_compound', 'partisan_score', 'sentiment_pos', 'sentiment_neg'])}
            FROM joined"""),
        "build_panel": statement(f"SELECT {_PANEL_SELECT}, crawl FROM crawl_panel"),
        "tokenize": statement(
            "SELECT doc_id, cast(len(ws) AS INTEGER) AS n_tokens, array_to_string(ws, ' ') AS tokens FROM tokens"
        ),
        "remove_stop_words": statement(
            "SELECT doc_id, cast(len(ws) AS INTEGER) AS n_tokens, array_to_string(ws, ' ') AS tokens FROM kept_tokens"
        ),
        "vocabulary": statement("SELECT term, df, total FROM vocab"),
        "tfidf": statement(
            f"""SELECT doc_id, c.term, tf, round(idf, {R}) AS idf, round(tf * idf, {R}) AS tfidf
            FROM counts c JOIN weighted w ON c.term = w.term""",
            weighted="SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS idf FROM vocab",
        ),
        "rank_weights": statement(f"""
            SELECT lang AS topic, cast(rn AS INTEGER) AS rank, term, round(1.0::DOUBLE / rn, {R}) AS weight FROM (
              SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rn
              FROM (SELECT lang, unnest(ws) AS term FROM kept_tokens) GROUP BY lang, term)
            WHERE rn <= 20"""),
        "dominant_topic": statement("SELECT vec_id, dominant_topic FROM topic_scores"),
        "topic_ideology": statement(
            f"SELECT vec_id, round(topic_ideology_score, {R}) AS topic_ideology_score FROM topic_scores"
        ),
        "composite_ideology": statement(f"SELECT url, round(composite_ideology, {R}) AS composite_ideology FROM joined"),
        "standardize": statement(f"SELECT domain, {_Z} FROM features"),
        "topic_coherence": statement(f"""
            SELECT topic, round(avg(CASE WHEN n IS NULL THEN -1.0 WHEN n = every THEN 1.0
              ELSE ln(n / every * every * every / (na * nb)) / -ln(n / every) END), {R}) AS coherence FROM (
              SELECT p.topic, p.term AS a, q.term AS b, any_value(x.n)::DOUBLE AS na, any_value(y.n)::DOUBLE AS nb,
                any_value(z.n)::DOUBLE AS n, any_value(t.every)::DOUBLE AS every
              FROM lang_terms p JOIN lang_terms q ON p.topic IS NOT DISTINCT FROM q.topic AND p.term < q.term
              JOIN window_pairs x ON x.a = p.term AND x.b = p.term JOIN window_pairs y ON y.a = q.term AND y.b = q.term
              LEFT JOIN window_pairs z ON z.a = p.term AND z.b = q.term,
              (SELECT count(*) AS every FROM token_windows) t GROUP BY p.topic, p.term, q.term) GROUP BY topic"""),
        "nearest_centres": statement("SELECT domain, k, cluster FROM assigned"),
        "silhouette_of_centres": statement(f"""
            SELECT k, round(avg(CASE WHEN members > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), {R}) AS silhouette FROM (
              SELECT k, domain, max(CASE WHEN own THEN n END) AS members, max(CASE WHEN own THEN total / greatest(n - 1, 1) END) AS a,
                min(CASE WHEN NOT own THEN total / n END) AS b FROM (
                SELECT p.k, p.domain, p.cluster = q.cluster AS own, count(*) AS n, sum({_far('zp.z', 'zq.z')}) AS total
                FROM assigned p JOIN assigned q ON p.k = q.k JOIN scaled zp ON p.domain = zp.domain JOIN scaled zq ON q.domain = zq.domain
                GROUP BY p.k, p.domain, p.cluster, q.cluster) GROUP BY k, domain) GROUP BY k"""),
        "project_on": statement("SELECT domain, " + ", ".join(
            "round(" + " + ".join(f"z[{j + 1}] * {pair[i]}::DOUBLE" for j, pair in enumerate(I.LOADINGS)) + f", {R}) AS {n}" for i, n in enumerate("xy")
        ) + " FROM scaled"),
        # The best of the 24 ways to match four topics.
        "aligned_topics": statement(f"""
            SELECT unnest([0, 1, 2, 3])::INT AS topic, unnest([a, b, c, d])::INT AS aligned,
              round(unnest([ca, cb, cc, cd]), {R}) AS cosine FROM (
              SELECT p.other AS a, q.other AS b, r.other AS c, s.other AS d, p.cosine AS ca, q.cosine AS cb, r.cosine AS cc, s.cosine AS cd
              FROM cosines p, cosines q, cosines r, cosines s
              WHERE p.topic = 0 AND q.topic = 1 AND r.topic = 2 AND s.topic = 3 AND len(list_distinct([p.other, q.other, r.other, s.other])) = 4
              ORDER BY p.cosine + q.cosine + r.cosine + s.cosine DESC LIMIT 1)"""),
    }
