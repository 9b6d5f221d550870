"""What the operators share: written tables, tables by name, and lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import session
from plumbline.session import discard, fresh_path, measured_broadcasts, read_table

__all__ = ["ascii_lower", "discard", "fresh_path", "materialize", "measured_broadcasts", "small_batches", "table"]

#: Rows of an Arrow batch of whole texts: a batch is held several times, by Spark and by the Python worker.
TEXT_ROWS = 1_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """As ``session.materialize``; lists of tokens are exploded here, so no table is broadcast by a guess of its size."""
    with measured_broadcasts(df.sparkSession):
        return session.materialize(df, name)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most TEXT_ROWS rows from here on, unless the session has smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)
