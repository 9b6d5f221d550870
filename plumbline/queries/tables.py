"""The given tables as inputs of the operators: one place for the mapping that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import read_table


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the time in whole microseconds (t_us)."""
    return read_table(spark, d, "events").withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp")))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as points: three axes, three more as a normal, a weight."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("vec_id").alias("tag"), "label", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("nx"), e(4).alias("ny"), e(5).alias("nz"),
        (F.abs(e(6)) + 0.1).alias("w"), F.abs(e(7)).alias("score"),
    )


#: The same points in SQL.
POINTS_SQL = """points AS (SELECT vec_id AS point_id, label, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z,
  embedding[4]::double AS nx, embedding[5]::double AS ny, embedding[6]::double AS nz, abs(embedding[7]::double) + 0.1::double AS w, abs(embedding[8]::double) AS score FROM embeddings)"""


def order_spans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as intervals on their customer's line: from the day of the order, as long as the price in hundredths of 10,000."""
    o = orders(spark, d)
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return o.select("o_custkey", "o_orderkey", day.alias("lo"), (day + F.floor(F.col("o_totalprice") / 2500)).alias("hi"), "o_totalprice", "o_orderpriority", "o_orderstatus")


SPANS_SQL = """spans AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', o_orderdate::date)::double AS lo,
  datediff('day', DATE '1992-01-01', o_orderdate::date)::double + floor(o_totalprice / 2500) AS hi, o_totalprice, o_orderpriority, o_orderstatus FROM orders)"""
