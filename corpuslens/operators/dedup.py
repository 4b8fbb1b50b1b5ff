"""Keeping the earliest row of every group of copies."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import text_fingerprint
from corpuslens.functions.urls import url_fingerprint

ORDER = ("fetch_time", "url", "crawl")
# A page seen in several crawls is an observation of each.
APART = ("crawl",)


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds ``_id1, _id2``: 96 bits of content hash by two functions, never null.

    Equal rows share it. The columns must be deterministic, as those of a stored table are.
    """
    return df.withColumns({"_id1": F.xxhash64(*df.columns), "_id2": F.hash(*df.columns)})


def earliest(
    df: DataFrame, keys: Sequence[Column], order: Sequence[str] = ORDER, apart: Sequence[str] = APART, only: DataFrame | None = None
) -> DataFrame:
    """Row ids of the survivors of one pass per key, in the order of ``keys``.

    A pass keeps, for every value of its key, the row that comes first by ``order``; rows
    with a null key form one group. Rows that differ in ``apart`` are no copies of each other. Only order columns, ids and keys are shuffled, and every
    map task sends at most one row per key value, so one group may hold most of the table. With ``only``, which has some
    of these columns, survivors that it does not name are left out in the end: they keep their part in the choice.
    """
    apart = [c for c in apart if c in df.columns]
    by = [*dict.fromkeys([c for c in order if c in df.columns] + apart)]
    names = [f"_key{i}" for i in range(len(keys))]
    rows = with_row_id(df).select(*by, "_id1", "_id2", *[k.alias(n) for k, n in zip(keys, names)])
    for i, name in enumerate(names):
        first = F.min(F.struct(*by, "_id1", "_id2", *names[i + 1:])).alias("_first")
        rows = rows.groupBy(*apart, name).agg(first).select("_first.*")
    named = rows if only is None else rows.join(only, only.columns, "left_semi")
    return named.select("_id1", "_id2")


def keep(df: DataFrame, survivors: DataFrame) -> DataFrame:
    """The rows of ``df`` (which has row ids) whose id is in ``survivors``, full copies once.

    Full copies collapse in the map tasks, and the join reuses the partitioning by id, so the
    wide rows are shuffled once.
    """
    ids = ["_id1", "_id2"]
    return df.dropDuplicates(ids).join(survivors, ids, "left_semi").drop(*ids)


def _dedup(df: DataFrame, key: Column) -> DataFrame:
    return keep(with_row_id(df), earliest(df, [key]))


def dedup_by_url(df: DataFrame, url_col: str = "url", unify_scheme: bool = False) -> DataFrame:
    """One row per crawl and URL fingerprint: the earliest fetched, then the smallest URL."""
    return _dedup(df, url_fingerprint(F.col(url_col), unify_scheme))


def dedup_by_text(df: DataFrame, text_col: str = "text", n_chars: int | None = None) -> DataFrame:
    """One row per crawl and text fingerprint: the earliest fetched, then the smallest URL."""
    return _dedup(df, text_fingerprint(F.col(text_col), n_chars))
