"""Tables between the steps of an operator, on the storage that all executors share."""

from pyspark.sql import DataFrame

from corpuslens.sources.stages import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet and read again.

    Later jobs read it instead of computing it anew, also after executors are lost, and a join
    on it gets an exchange of its own on either side, whose large partitions Spark can split.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
