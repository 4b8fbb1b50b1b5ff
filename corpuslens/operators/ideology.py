"""Composite ideology of documents and its monthly panel."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.topics import labels_map, topic_ideology
from corpuslens.schemas import require_columns


def score_topics(doc_topics: DataFrame, labels: DataFrame | Mapping[int, float]) -> DataFrame:
    """``doc_topics`` with ``topic_ideology_score``; ``labels`` has one row or entry per topic."""
    if isinstance(labels, DataFrame):
        with_labels = doc_topics.withColumn("_labels", labels_map(labels))
        score = topic_ideology(F.col("topic_dist_arr"), F.col("_labels"))
        return with_labels.withColumn("topic_ideology_score", score).drop("_labels")
    return doc_topics.withColumn("topic_ideology_score", topic_ideology(F.col("topic_dist_arr"), labels))


def join_scores(scored_topics: DataFrame, sentiment: DataFrame, on: Sequence[str] = ("crawl", "url")) -> DataFrame:
    """Topic and sentiment scores of each document, which is a URL in a crawl."""
    keys = list(on)
    kept = [*dict.fromkeys([*keys, "url", "domain", "year_month"]), "dominant_topic", "topic_ideology_score"]
    scores = ["sentiment_compound", "partisan_score", "sentiment_pos", "sentiment_neg"]
    return scored_topics.select(*kept).join(sentiment.select(*keys, *scores), keys, "inner")


def composite_ideology(joined: DataFrame) -> DataFrame:
    """Adds the mean of partisan score and topic ideology."""
    mean = (F.col("partisan_score") + F.col("topic_ideology_score")) / 2
    return joined.withColumn("composite_ideology", mean)


def ideology_panel(scored: DataFrame, min_docs: int = 5, by: Sequence[str] = ("domain", "year_month")) -> DataFrame:
    """Ideology by domain and month, or by other columns, for groups with enough documents.

    ``median_topic`` and ``modal_topic`` (the smallest on ties) hold one counter per topic,
    so their state does not grow with the group.
    """
    require_columns(scored, "composite_ideology", "dominant_topic")
    means = {
        "avg_sentiment": "sentiment_compound",
        "avg_pos_sentiment": "sentiment_pos",
        "avg_neg_sentiment": "sentiment_neg",
        "avg_topic_ideology": "topic_ideology_score",
        "avg_partisan_score": "partisan_score",
    }
    return (
        scored.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("doc_count"),
            F.avg("composite_ideology").alias("ideology_score"),
            F.stddev_samp("composite_ideology").alias("ideology_std"),
            *[F.avg(c).alias(name) for name, c in means.items()],
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dominant_topic)").cast("int").alias("median_topic"),
            F.mode("dominant_topic", deterministic=True).alias("modal_topic"),
        )
        .filter(F.col("doc_count") >= min_docs)
    )


def build_panel(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the panels of several crawls by column name, each row tagged with its crawl."""
    if not frames:
        raise ValueError("no crawl data")
    tagged = [df.withColumn("crawl", F.lit(crawl)) for crawl, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)
