"""A training corpus from ``documents``: language, copies, near copies, benchmark leaks, mix."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import stages as S
from corpuslens.llm.scratch import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", S.language),
    ("exact_dedup", S.exact_dedup),
    ("near_dedup", S.near_dedup),
    ("decontaminate", S.decontaminate),
    ("mix", S.mix),
]

#: A language model of character n-grams has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again as the documents of the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
