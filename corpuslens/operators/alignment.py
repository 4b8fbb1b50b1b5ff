"""Topics of separately fitted models next to each other.

Topic numbers of two models mean nothing to one another. Their term weights are compared as
vectors, and an optimal one-to-one assignment carries the numbers of the earlier model on.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.topics import TopicModel
from corpuslens.schemas import require_columns


def topic_terms(model: TopicModel) -> DataFrame:
    """Rows (topic, term, weight) of all topics and terms. The matrix is one of vocabulary times topics."""
    matrix = model.lda.topicsMatrix().toArray()
    spark: SparkSession = model.lda.describeTopics(1).sparkSession
    rows = [(term, [float(x) for x in weights]) for term, weights in zip(model.terms, matrix)]
    table = spark.createDataFrame(rows, "term string, weights array<double>")
    return table.select(F.posexplode("weights").alias("topic", "weight"), "term").select("topic", "term", "weight")


def topic_similarity(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(topic, other, cosine) of each topic of ``later`` and each of ``earlier`` with a common term.

    Both are rows (topic, term, weight), a term once for a topic; the vocabularies may differ. Products are summed
    in the map tasks, so a term of many topics costs a row for each pair of these.
    """
    for df in (earlier, later):
        require_columns(df, "topic", "term", "weight")

    def scaled(df: DataFrame, topic: str, weight: str) -> DataFrame:
        norms = df.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
        joined = df.join(norms.filter("_norm > 0"), "topic")
        return joined.select(F.col("topic").alias(topic), "term", (F.col("weight") / F.col("_norm")).alias(weight))

    both = scaled(later, "topic", "_a").join(scaled(earlier, "other", "_b"), "term")
    return both.groupBy("topic", "other").agg(F.sum(F.col("_a") * F.col("_b")).alias("cosine"))


def assignment(worth: np.ndarray) -> np.ndarray:
    """For each row the column of an assignment of the greatest sum, by augmenting paths with potentials (Kuhn, Munkres).

    There are at least as many columns as rows.
    """
    cost = -np.asarray(worth, dtype=float)
    n, m = cost.shape
    rows, columns = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, previous, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[at]:
            used[at] = True
            slack = cost[owner[at] - 1] - rows[owner[at]] - columns[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            previous[1:][better] = at
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            step_to = int(np.argmin(free))
            delta = free[step_to]
            rows[owner[used]] += delta
            columns[used] -= delta
            least[~used] -= delta
            at = step_to
        while at:
            owner[at], at = owner[previous[at]], previous[at]
    found = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if owner[j]:
            found[owner[j] - 1] = j - 1
    return found


def align_topics(earlier: DataFrame, later: DataFrame, least: float = 0.0) -> DataFrame:
    """(topic, aligned, cosine): the number of the earlier model that each topic of the later one carries on.

    Topics are matched one to one so that the sum of their cosines is greatest. One without a match, as where there are
    more of them, or with a cosine below ``least``, gets a new number after those of the earlier model,
    in its order. The driver sees one row for each pair of topics.
    """
    pairs = topic_similarity(earlier, later).collect()
    old = sorted(r["topic"] for r in earlier.select("topic").distinct().collect())
    new = sorted(r["topic"] for r in later.select("topic").distinct().collect())
    worth = np.zeros((len(new), max(len(old), len(new))))
    place_old, place_new = {t: i for i, t in enumerate(old)}, {t: i for i, t in enumerate(new)}
    for r in pairs:
        worth[place_new[r["topic"]], place_old[r["other"]]] = r["cosine"]
    rows, fresh = [], max(old, default=-1) + 1
    for i, j in enumerate(assignment(worth) if new else []):
        if j < len(old) and worth[i, j] > 0 and worth[i, j] >= least:
            rows.append((new[i], old[j], float(worth[i, j])))
        else:
            rows.append((new[i], fresh, None))
            fresh += 1
    return earlier.sparkSession.createDataFrame(rows, "topic int, aligned int, cosine double")
