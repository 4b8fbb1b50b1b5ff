"""DuckDB SQL with the same result as the registered queries, where SQL can express it."""

from corpuslens.llm.revisits import RECORDS_SQL

SPACE = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""


# A run of ten words of a document that equals a window of an item hits its words.
DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size,
    unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, dw.size, k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""

# Targets by running levels; within a source the documents in the order of their Pareto ranks fill the rest.
MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, cast(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3 * source_size AS bound FROM s),
l AS (SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(bound) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM w WINDOW o AS (ORDER BY bound / weight, source NULLS LAST),
    b AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS first FROM l WHERE bound >= level * weight),
t AS (SELECT source, source_size,
    CASE WHEN first IS NULL OR place < first THEN cast(bound AS DOUBLE)
      ELSE (SELECT level FROM l, f WHERE place = first) * weight END AS target FROM l, f),
c AS (SELECT doc_id, d.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / cast(source_size AS DOUBLE) * 1.0::DOUBLE, 3.0) ELSE 0.0::DOUBLE END AS copies,
    (cast('0x' || substring(md5('mix:' || coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(copies)::BIGINT AS sure, copies - floor(copies) AS p FROM c),
q AS (SELECT *, CASE WHEN p <= 0 THEN 1.0 ELSE ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS rank,
    target - sum(sure * size) OVER (PARTITION BY source) AS rest FROM r),
e AS (SELECT doc_id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= rest AS extra FROM q WHERE sure < 3 AND size > 0)
SELECT q.doc_id, size, source_size, target, (sure + CASE WHEN extra THEN 1 ELSE 0 END) * size AS taken
FROM q LEFT JOIN e ON q.doc_id = e.doc_id"""


# The CRC-32 of a word by its table, made from its polynomial; one logarithm for each bucket.
RESAMPLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), n)) AS t),
dw AS (SELECT doc_id, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dn AS (SELECT doc_id, word, count(*) AS n FROM dw GROUP BY doc_id, word),
sn AS (SELECT word, sum(n) AS n FROM dn GROUP BY word),
tn AS (SELECT word, count(*) AS n FROM bw GROUP BY word),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM sn UNION SELECT word FROM tn)),
k AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(1, 1 + len(x) // 2), lambda i: cast('0x' || substring(x, 2 * i - 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, cast(sum(n) AS DOUBLE) AS s FROM sn JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, cast(sum(n) AS DOUBLE) AS t FROM tn JOIN k USING (word) GROUP BY bucket),
g AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) /
    ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s ON b.bucket = s.bucket LEFT JOIN t ON b.bucket = t.bucket),
w AS (SELECT doc_id, sum(n) AS n, cast(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM dn JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
a AS (SELECT d.doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + cast(floor(-1000 * ln(-ln((cast('0x' || substring(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM a WHERE n_features >= 20)
SELECT a.doc_id, n_features, weight, score,
  CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM r) THEN r END AS rank
FROM a LEFT JOIN r ON a.doc_id = r.doc_id"""


REVISITS = rf"""
WITH r AS ({RECORDS_SQL}),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_[a-z]+=[^&]*', '', 'g'), '^([^?&]*)&', '\1?') AS bare FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)?$', ''),
    '^www\.', '') AS host, regexp_replace(regexp_extract(bare, '^[A-Za-z]+://[^/?]*(.*)$', 1), '/+(\?|$)', '\1', 'g') AS rest FROM b),
k AS (SELECT *, CASE WHEN host <> '' THEN concat(host, rest) END AS canonical_url FROM c),
f AS (SELECT canonical_url AS u, captured AS t, record_id AS response_id, etag AS e, modified AS m, length AS n FROM k
  WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY canonical_url, captured ORDER BY record_id DESC) = 1),
j AS (SELECT k.*, f.* FROM k ASOF LEFT JOIN f ON k.canonical_url = f.u AND k.captured > f.t WHERE k.kind = 'revisit'),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN coalesce(etag = e, modified = m) IS NULL THEN 'no_validator'
    WHEN coalesce(etag = e, modified = m) THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT record_id, url, canonical_url, captured, response_id, status,
  concat_ws(chr(10), 'cache-control: max-age=600', 'content-length: ' || CASE WHEN status = 'resolved' THEN n ELSE length END,
    CASE WHEN status = 'resolved' THEN 'content-type: text/html' END, 'date: ' || captured,
    'etag: ' || CASE WHEN status = 'resolved' THEN coalesce(etag, e) ELSE etag END, 'expires: ' || (captured + 600),
    'last-modified: ' || CASE WHEN status = 'resolved' THEN coalesce(modified, m) ELSE modified END) AS headers
FROM s"""


def llm_oracles() -> dict[str, str]:
    return {
        "op2_revisits": REVISITS,
        "op6_exact_dedup": EXACT_DEDUP,
        "op7_decontaminate": DECONTAMINATE,
        "op10_mix": MIX,
        "op13_resample": RESAMPLE,
    }
