"""Domain features, clusters and polarization."""

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.defaults import FEATURES, FIVE_LABELS, SEED, THREE_LABELS


def domain_features(
    panel: DataFrame, min_docs: int = 20, weighted: bool = False, by: Sequence[str] = ("domain",)
) -> DataFrame:
    """Means of the monthly features of each domain and its document count.

    Months count alike; ``weighted=True`` weighs them by documents. ``by=("crawl", "domain")``
    keeps crawls apart.
    """
    docs = F.col("doc_count")

    def mean(c: str):
        if not weighted:
            return F.avg(c)
        return F.sum(F.col(c) * docs) / F.sum(F.when(F.col(c).isNotNull(), docs))

    return (
        panel.groupBy(*by)
        .agg(*[mean(c).alias(c) for c in FEATURES], F.sum(docs).alias("total_docs"))
        .filter(F.col("total_docs") >= min_docs)
    )


def assemble(df: DataFrame, cols: Sequence[str] = FEATURES, output: str = "raw_features") -> DataFrame:
    """One vector per row; rows with a null or NaN feature are left out."""
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid="skip").transform(df)


def standardize(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Adds ``scaled_features`` with zero mean and unit sample deviation per feature."""
    vectors = assemble(df, cols)
    scaler = StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors)


def scaled_columns(standardized: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """``scaled_features`` as one plain column ``z_<feature>`` each."""
    z = vector_to_array("scaled_features")
    kept = [c for c in standardized.columns if c not in ("raw_features", "scaled_features")]
    return standardized.select(*kept, *[F.get(z, F.lit(i)).alias(f"z_{c}") for i, c in enumerate(cols)])


def _kmeans(k: int, max_iter: int, tol: float, seed: int) -> KMeans:
    return KMeans(
        k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="scaled_features", predictionCol="cluster"
    )


def select_k(
    standardized: DataFrame, k_min: int = 3, k_max: int = 8, seed: int = SEED
) -> tuple[int, DataFrame]:
    """The k of ``k_min..k_max`` with the best silhouette (the smallest on ties), and the table (k, silhouette).

    A k not below the number of rows is not tried.
    """
    rows = standardized.select("scaled_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        evaluator = ClusteringEvaluator(
            featuresCol="scaled_features", predictionCol="cluster",
            metricName="silhouette", distanceMeasure="squaredEuclidean",
        )
        scores = []
        for k in range(k_min, min(k_max, n - 1) + 1):
            model = _kmeans(k, 50, 1e-4, seed).fit(rows)
            scores.append((k, float(evaluator.evaluate(model.transform(rows)))))
    finally:
        rows.unpersist()
    if not scores:
        raise ValueError(f"{n} rows are too few for {k_min} clusters")
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    return best, standardized.sparkSession.createDataFrame(scores, "k int, silhouette double")


def cluster_domains(standardized: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds the K-means ``cluster`` of every row."""
    rows = standardized.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _kmeans(k, 100, 1e-6, seed).fit(rows).transform(standardized)
    finally:
        rows.unpersist()


def project_on(standardized: DataFrame, loadings: Sequence[Sequence[float]]) -> DataFrame:
    """Adds plane coordinates ``x, y``: the scaled features by their two loadings each."""
    z = vector_to_array("scaled_features")
    xy = {n: sum(F.get(z, F.lit(j)) * float(pair[i]) for j, pair in enumerate(loadings)) for i, n in enumerate(("x", "y"))}
    return standardized.withColumns(xy)


def project_2d(standardized: DataFrame) -> DataFrame:
    """Adds plane coordinates ``x, y``: the first two principal components of the scaled features.

    The largest loading of each component is made positive, so that signs do not flip between runs.
    """
    model = PCA(k=2, inputCol="scaled_features", outputCol="_plane").fit(standardized)
    loadings = model.pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    return project_on(standardized, loadings * signs)


def cluster_summary(clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per cluster: mean ideology and sentiment, documents and domains."""
    return clusters.groupBy(*by, "cluster").agg(
        F.avg("ideology_score").alias("ideology_score_mean"),
        F.avg("avg_sentiment").alias("avg_sentiment_mean"),
        F.sum("total_docs").alias("doc_count_sum"),
        F.count("domain").alias("domain_count"),
    )


def label_clusters(summary: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``ideology_label`` by the rank of a cluster's own mean ideology, most left first.

    The ranked table has one row per cluster.
    """
    names = THREE_LABELS if k <= 3 else FIVE_LABELS
    order = Window.partitionBy(*by).orderBy("ideology_score_mean", "cluster")
    rank = F.row_number().over(order) - 1
    ranked = summary.withColumn("_rank", rank)
    label = F.coalesce(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("_rank")),
        F.concat(F.lit("Cluster "), F.col("_rank").cast("string")),
    )
    return ranked.withColumn("ideology_label", label).drop("_rank")


def label_domains(clusters: DataFrame, labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gives every domain the label of its cluster."""
    keys = [*by, "cluster"]
    return clusters.join(labelled.select(*keys, "ideology_label"), keys, "left")


def visible_domains(clusters: DataFrame, min_docs: int = 50) -> DataFrame:
    return clusters.filter(F.col("total_docs") >= min_docs)


def label_summary(clusters: DataFrame, min_docs: int = 50) -> DataFrame:
    """Per label, over the domains with enough documents: domains, means and documents."""
    return visible_domains(clusters, min_docs).groupBy("ideology_label").agg(
        F.count("domain").alias("domains"),
        F.avg("ideology_score").alias("avg_ideology"),
        F.avg("avg_sentiment").alias("avg_sentiment"),
        F.sum("total_docs").alias("total_docs"),
    )


def polarization_index(clusters: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Share of the variance of ideology that lies between clusters, one row per ``by`` group.

    Between is the weighted variance of the cluster means, within the weighted mean of the
    sample variances; a cluster of one domain has variance 0. ``by=["crawl"]`` measures all
    crawls in one pass.
    """
    score = F.col("ideology_score")
    stats = clusters.groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(score).alias("_mean"),
        F.coalesce(F.nanvl(F.var_samp(score), F.lit(0.0)), F.lit(0.0)).alias("_var"),
    )
    n, mean = F.col("_n"), F.col("_mean")
    total = F.sum(n)
    # Deviations from the mean: a difference of squares would cancel where the means are close.
    group = Window.partitionBy(*by)
    stats = stats.withColumn("_centre", F.sum(n * mean).over(group) / F.sum(n).over(group))
    sums = stats.groupBy(*by).agg(
        (F.sum(n * F.pow(mean - F.col("_centre"), 2)) / total).alias("_between"),
        (F.sum(n * F.col("_var")) / total).alias("_within"),
        F.count(F.lit(1)).alias("n_clusters"),
        total.alias("n_domains"),
    )
    between, within = F.col("_between"), F.col("_within")
    index = F.when(between + within > 0, between / (between + within)).otherwise(0.0)
    return sums.filter(F.col("n_domains") > 0).select(
        *by,
        F.round(index, digits).alias("polarization_index"),
        F.round(between, digits).alias("between_cluster_var"),
        F.round(within, digits).alias("within_cluster_var"),
        "n_clusters",
        "n_domains",
    )
