"""Not-modified revisit records resolved to the latest earlier full response of their URL.

An as-of join by canonical URL. A URL that holds a third of all records is not put in order in one
task, even if they all lie in one day: map tasks reduce responses to the latest of each URL and
second, so a block of time has at most as many rows as seconds. Running maxima over the seconds of
a block and over the blocks of a URL tell the latest response before each second, and revisits are joined
to their second. Only (time, id) take part; headers are joined to the pairs found, by id, which Spark
splits where many revisits meet one response.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.scratch import stored

BLOCK_SECONDS = 86_400
# Fields of a 304 answer that describe its own message and never update the stored ones.
NOT_PERMITTED = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-connection te trailer transfer-encoding upgrade"
).split()
RESPONSE, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """The URL without scheme, user, ``www.``, default port, fragment, campaign parameters and final slash; host in lower case.

    Null for what has no host.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "[?&]utm_[a-z]+=[^&]*", "")
    bare = F.regexp_replace(bare, "^([^?&]*)&", "$1?")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), r"^www\.", "")
    rest = F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"/+(\?|$)", "$1")
    return F.when(host != "", F.concat(host, rest))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case, the later of two spellings winning; null counts as no headers."""
    entries = F.transform(
        F.coalesce(F.map_entries(headers), F.array()), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.map_from_arrays(names, last)


def merged_headers(stored_: Column, update: Column) -> Column:
    """Stored headers with those of the revisit in place of theirs, but for the fields that are not permitted to change."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(NOT_PERMITTED) & v.isNotNull())
    kept = F.map_filter(stored_, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit record: (record_id, url, canonical_url, captured, response_id, status, headers).

    records: (record_id, url, captured, kind, headers), captured in seconds, headers a map. The
    response is the latest of the canonical URL that is strictly earlier, of equal times the one
    with the largest id. Its entity tag, compared weakly, or else its modification date must be that
    of the revisit: status ``resolved``, ``mismatch`` or, if they have no validator in common,
    ``no_validator``; ``no_response`` if there is no earlier response, as for null URLs or times.
    Headers are merged where the status is ``resolved`` and otherwise those of the revisit. Records of
    other kinds are ignored; responses that repeat an id count once, revisits are all returned. Of
    responses with one id, and of revisits with one id, URL and time, the headers whose lines come last hold.
    """
    known = records.select(
        "record_id", "url", canonical_url(F.col("url").cast("string")).alias("canonical_url"), F.col("captured").cast("bigint").alias("captured"),
        "kind", F.floor(F.col("captured") / block_seconds).alias("block"),
    ).filter(F.col("kind").isin(RESPONSE, REVISIT))
    known = known.withColumn("full", F.when(F.col("kind") == RESPONSE, F.struct("captured", "record_id")))
    placed = known.filter("canonical_url IS NOT NULL AND captured IS NOT NULL")
    seconds = stored(placed.groupBy("canonical_url", "block", "captured").agg(F.max("full").alias("full")), "seconds")
    blocks = seconds.groupBy("canonical_url", "block").agg(F.max("full").alias("full"))
    before = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("canonical_url", "block", F.max("full").over(before).alias("carried")).filter("carried IS NOT NULL")
    earlier = Window.partitionBy("canonical_url", "block").orderBy("captured").rowsBetween(Window.unboundedPreceding, -1)
    within = seconds.select("canonical_url", "block", "captured", F.max("full").over(earlier).alias("within"))
    latest = within.join(stored(carried, "carried"), ["canonical_url", "block"], "left").select(
        F.col("canonical_url").alias("_canonical"), F.col("captured").alias("_second"), F.coalesce("within", "carried").alias("latest")
    )
    latest = stored(latest.filter("latest IS NOT NULL"), "latest")
    asked = placed.filter(F.col("kind") == REVISIT).select("record_id", "url", "canonical_url", "captured")
    same_second = (F.col("canonical_url") == F.col("_canonical")) & (F.col("captured") == F.col("_second"))
    found = asked.join(latest, same_second, "left").select(*asked.columns, F.col("latest.record_id").alias("response_id"))
    lost = known.filter((F.col("kind") == REVISIT) & (F.col("canonical_url").isNull() | F.col("captured").isNull()))
    columns = ["record_id", "url", "canonical_url", "captured"]
    pointed = found.select(*columns, "response_id").unionByName(
        lost.select(*columns, F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"))
    )
    pointed = stored(pointed, "pointed")
    headers = _lower_names(F.col("headers"))
    full = records.filter(F.col("kind") == RESPONSE).select(F.col("record_id").alias("response_id"), headers.alias("full_headers"))
    # Maps have no order: of records that repeat an id, the one whose header lines come last stands for them.
    full = full.groupBy("response_id").agg(F.max_by("full_headers", header_lines(F.col("full_headers"))).alias("full_headers"))
    own = records.filter(F.col("kind") == REVISIT).select(
        F.col("record_id").alias("_id"), F.col("url").alias("_url"), F.col("captured").cast("bigint").alias("_captured"), headers.alias("own")
    )
    own = own.groupBy("_id", "_url", "_captured").agg(F.max_by("own", header_lines(F.col("own"))).alias("own"))
    same = (
        F.col("record_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
        & F.col("captured").eqNullSafe(F.col("_captured"))
    )
    both = pointed.join(stored(full, "responses"), "response_id", "left").join(own, same, "left")
    tag, date = "etag", "last-modified"
    agree = F.coalesce(
        _weak(F.col("own")[tag]) == _weak(F.col("full_headers")[tag]), F.col("own")[date] == F.col("full_headers")[date]
    )
    status = (
        F.when(F.col("response_id").isNull(), "no_response").when(agree.isNull(), "no_validator")
        .when(agree, "resolved").otherwise("mismatch")
    )
    merged = F.when(F.col("status") == "resolved", merged_headers(F.col("full_headers"), F.col("own"))).otherwise(F.col("own"))
    return both.withColumn("status", status).select(*columns, "response_id", "status", merged.alias("headers"))


def fill_payloads(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` with the payload of the response that each resolved revisit stands for."""
    full = records.filter(F.col("kind") == RESPONSE).select(F.col("record_id").alias("_response"), F.col(payload).alias(payload))
    at = F.when(F.col("status") == "resolved", F.col("response_id"))
    return resolved.join(full.dropDuplicates(["_response"]), at == F.col("_response"), "left").drop("_response")


def header_lines(headers: Column) -> Column:
    """Headers as ``name: value`` lines in the order of their names."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "\n")


# Captures of every page, and a revisit of each under another spelling of its URL. Runs in both engines.
RECORDS_SQL = """
SELECT page_id * 2 AS record_id, url, 1700000000 + (page_id * 7919 % 100003) * 60 AS captured, 'response' AS kind,
  md5(html) AS etag, cast(page_id % 97 AS string) AS modified, cast(length(html) AS string) AS length
FROM pages
UNION ALL
SELECT page_id * 2 + 1, concat(url, CASE WHEN page_id % 3 = 0 THEN '#again' ELSE '' END),
  1700000000 + (page_id * 7919 % 100003) * 60 + CASE WHEN page_id % 11 = 0 THEN -7200 ELSE 3600 * (page_id % 50) END, 'revisit',
  CASE WHEN page_id % 7 = 3 THEN NULL WHEN page_id % 5 = 0 THEN 'changed' ELSE md5(html) END,
  CASE WHEN page_id % 13 = 3 THEN NULL ELSE cast(page_id % 97 AS string) END, '0'
FROM pages"""


def records_of_pages(spark, pages: DataFrame) -> DataFrame:
    """Full responses and not-modified revisits made from ``pages``, as ``resolve_revisits`` takes them."""
    rows = spark.sql(RECORDS_SQL.replace("FROM pages", "FROM {pages}"), pages=pages)
    named = F.map_filter(
        F.create_map(
            F.lit("Date"), F.col("captured").cast("string"), F.lit("ETag"), F.col("etag"), F.lit("Last-Modified"), F.col("modified"),
            F.lit("Content-Length"), F.col("length"), F.lit("Cache-Control"),
            F.when(F.col("kind") == RESPONSE, "max-age=60").otherwise("max-age=600"),
            F.lit("Content-Type"), F.when(F.col("kind") == RESPONSE, "text/html"),
            F.lit("Expires"), F.when(F.col("kind") == REVISIT, (F.col("captured") + 600).cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select("record_id", "url", "captured", "kind", named.alias("headers"))
