"""Registered queries: each applies one operator with production parameters to a whole table."""

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.decontaminate import leak_report
from corpuslens.llm.language import identify_languages
from corpuslens.llm.mixing import mix_sources
from corpuslens.llm.naming import exact_duplicates
from corpuslens.llm.pages import extract_text
from corpuslens.llm.passages import shared_passages
from corpuslens.llm.periods import run_report, with_loops
from corpuslens.llm.quality import classify_quality
from corpuslens.llm.resampling import resample
from corpuslens.llm.revisits import header_lines, records_of_pages, resolve_revisits
from corpuslens.llm.scoring import score_texts
from corpuslens.llm.simhash import near_duplicates
from corpuslens.llm.toxicity import classify_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = records_of_pages(spark, table(spark, sf_dir, "pages"))
    return resolve_revisits(records).withColumn("headers", header_lines("headers"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(with_loops(table(spark, sf_dir, "documents")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_revisits, op3_language, op4_simhash, op5_lm_score, op6_exact_dedup, op7_decontaminate,
        op8_passages, op9_extract, op10_mix, op11_periods, op12_toxicity, op13_resample,
    )
}
