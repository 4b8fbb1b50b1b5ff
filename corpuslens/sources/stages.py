"""Stage tables on shared storage: Parquet between stages, JSON and CSV for small results."""

import re
import uuid
import warnings
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens import schemas
from corpuslens.sources.archive import absolute_root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder of the cluster.

    Without that setting the folder lies in the warehouse, the other place that all executors
    share; a warehouse in a local folder is that only if Spark runs on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        local = root.startswith(("/", "file:")) or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root)
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share, not {root}")
    root = absolute_root(spark, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_stage(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Parquet scan under a declared schema: no inference, and a missing column is an error.

    The declared columns are checked against the footer schema, since Parquet would
    otherwise fill an absent column with nulls.
    """
    paths = [path] if isinstance(path, str) else list(path)
    found = spark.read.parquet(*paths)
    schemas.require_columns(found, *schema.fieldNames())
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def for_crawl(df: DataFrame, crawl: str) -> DataFrame:
    """Rows of one crawl; prunes directories when the table is partitioned by ``crawl``."""
    return df.filter(F.col("crawl") == crawl)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with a row count that is taken while the frame is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_stage(
    df: DataFrame, path: str, partition_by: Iterable[str] = (), files: int | None = None
) -> int:
    """Overwrite a stage table and return its row count, taken during the write.

    Without ``files`` the rows are rebalanced: Spark sizes the files by bytes and splits a
    partition value that holds most of the rows. ``files`` fixes their number instead.
    """
    keys = list(partition_by)
    counted, seen = observed(df, f"rows-{uuid.uuid4().hex}")
    laid_out = counted.repartition(files) if files else counted.hint("rebalance", *keys)
    writer = laid_out.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    try:
        return seen.get["rows"]
    except Py4JError:
        # Spark drops the observation with the rest of a plan that turns out to be empty.
        return df.sparkSession.read.schema(df.schema).parquet(path).count()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_topic_labels(spark: SparkSession, path: str) -> DataFrame:
    """Topic labels from one JSON object ``{"topic": score}`` as rows (topic, label)."""
    parsed = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
    rows = spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("topic", "label"))
    return rows.select(F.col("topic").cast("int").alias("topic"), "label")


def read_panel(
    spark: SparkSession, base: str, crawls: Iterable[str], schema: T.StructType = schemas.DOMAIN_IDEOLOGY
) -> dict[str, DataFrame]:
    """The ideology panels ``base/crawl/domain_ideology`` by crawl; see ``build_panel`` for their union.

    Warns about crawls without a panel, and fails if there is none at all.
    """
    found = {}
    for crawl in crawls:
        path = f"{base.rstrip('/')}/{crawl}/domain_ideology"
        try:
            found[crawl] = read_stage(spark, path, schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"no data for crawl {crawl} at {path}", stacklevel=2)
    if not found:
        raise ValueError(f"no crawl data under {base}")
    return found


def read_metrics(spark: SparkSession, base: str, crawls: Iterable[str] = ("*",)) -> DataFrame:
    """Polarization metrics ``base/crawl/polarization_metrics`` of many crawls, crawl taken from the path."""
    paths = [f"{base.rstrip('/')}/{c}/polarization_metrics" for c in crawls]
    crawl = F.regexp_extract(F.input_file_name(), r"([^/]+)/polarization_metrics/[^/]*$", 1)
    return spark.read.schema(schemas.POLARIZATION).json(paths).withColumn("crawl", crawl)
