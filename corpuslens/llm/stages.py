"""Stages of a corpus pipeline: (spark, documents, folder of the tables) -> documents.

Decisions are made for rows. Where all ids differ, the id tells the rows; else the rows are stored
with a number of their own, since ids can be null or occur several times. The result is the same
in both cases: rows are in the order of id, a null id last, then number.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.decontaminate import find_leaks
from corpuslens.llm.language import fit_languages, predict_languages
from corpuslens.llm.mixing import mix_sources
from corpuslens.llm.naming import exact_duplicates
from corpuslens.llm.scratch import stored
from corpuslens.llm.simhash import near_duplicates


def _ids_differ(docs: DataFrame) -> bool:
    """Whether every row has an id of its own. Only the ids are read, and one row per id is shuffled."""
    per = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.filter("doc_id IS NULL OR n > 1").isEmpty()


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, and the column that tells them apart: the id if all differ, else a number in a stored copy."""
    if _ids_differ(docs):
        return docs, "doc_id"
    row = _free(docs, "stage_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def by_row(rows: DataFrame, row: str, *columns: str) -> DataFrame:
    """The rows' keys as doc_id, and the columns."""
    return rows.select(F.col(row).alias("doc_id"), *columns)


def only(rows: DataFrame, row: str, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the rows whose key is among the ``doc_id`` of ``kept``."""
    key = _free(rows, "kept_row")
    return rows.join(kept.select(F.col("doc_id").alias(key)), F.col(row) == F.col(key), "left_semi").select(*columns)


def _place(row: str) -> Column:
    """Orders rows by id, a null id last, then by their number; a bare id where that is the key."""
    if row == "doc_id":
        return F.col("doc_id")
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))


def _first_of(rows: DataFrame, row: str, found: DataFrame, kept: Column, columns: list[str]) -> DataFrame:
    """The rows whose place is kept."""
    key = F.col("doc_id") if row == "doc_id" else F.col("doc_id.row")
    return only(rows, row, found.filter(kept).select(key.alias("doc_id")), columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those that language identification rejects go.

    It learns from the documents that have a language; if there are none, all are rejected.
    """
    rows, row = keyed(docs)
    model = fit_languages(by_row(rows, row, "text", "lang"))
    return only(rows, row, predict_languages(by_row(rows, row, "text"), model).filter("NOT rejected"), docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    rows, row = keyed(docs)
    found = exact_duplicates(rows.select(_place(row).alias("doc_id"), "text"))
    return _first_of(rows, row, found, F.col("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays, the one with the smallest id.

    Fingerprints, shingles and the distance of links are those of ``near_duplicates``.
    """
    rows, row = keyed(docs)
    found = near_duplicates(rows.select(_place(row).alias("doc_id"), "text"))
    return _first_of(rows, row, found, F.col("doc_id") == F.col("component_id"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows, row = keyed(docs)
    return only(rows, row, find_leaks(by_row(rows, row, "text"), benchmark).filter("n_hit = 0"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the number of copies that the mix takes, with their number from 1 on in ``copy``.

    A column ``copy`` of the documents gives way to it.
    """
    rows, row = keyed(docs)
    key, n = _free(rows, "mixed_row"), _free(rows, "n_taken")
    copies = mix_sources(rows, row=F.col(row)).filter("copies > 0").select(F.col("row").alias(key), F.col("copies").alias(n))
    taken = rows.join(copies, F.col(row) == F.col(key))
    return taken.select(*[c for c in docs.columns if c.lower() != "copy"], F.explode(F.sequence(F.lit(1), n)).alias("copy"))
