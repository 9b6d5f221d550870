"""Result assembly with repairs, validation as violation rows, and an idempotent keyed store."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.shapes import interval


def measure(value: Column, lo: Column, hi: Column, unit: str) -> Column:
    """STRUCT<value, lo, hi, unit> with the interval repaired: missing bounds are the value, and the value lies inside."""
    lo, hi = F.coalesce(lo, value), F.coalesce(hi, value)
    return F.when(value.isNotNull(), F.struct(F.round(value, 4).alias("value"), F.round(F.least(lo, value), 4).alias("lo"), F.round(F.greatest(hi, value), 4).alias("hi"), F.lit(unit).alias("unit")))


def unique_ids(df: DataFrame, by: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Repeated ids get ~2, ~3 .. in order; ``renamed`` marks them."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return df.withColumn("_n", n).withColumn("renamed", F.col("_n") > 1).withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("~", name, "_n")).otherwise(F.col(name))).drop("_n")


def drop_dangling(df: DataFrame, column: str, known: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """Rows whose reference is not known go."""
    return df.join(known.select(*by, F.col(key).alias(column)).distinct(), [*by, column], "left_semi")


def null_dangling(df: DataFrame, column: str, known: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """References that are not known become null."""
    k = known.select(*by, F.col(key).alias(column)).distinct().withColumn("_known", F.lit(True))
    return df.join(k, [*by, column], "left").withColumn(column, F.when(F.col("_known"), F.col(column))).drop("_known")


def assemble(captures: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """One nested row a capture: rooms with their walls and openings in order; a capture without rooms stays, empty."""
    nest = lambda d, keys, order, name: d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in d.columns if c not in (*keys, order))))).alias(name))
    full = rooms.join(nest(walls, ["capture_id", "room_id"], "k", "walls"), ["capture_id", "room_id"], "left").join(nest(openings, ["capture_id", "room_id"], "opening_id", "openings"), ["capture_id", "room_id"], "left")
    return captures.join(nest(full, ["capture_id"], "room_ord", "rooms"), "capture_id", "left")


def foreign_key(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set and unknown."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("_ref")).join(known.select(F.col(key).alias("_ref")), "_ref", "left_anti")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def in_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Rows outside the range, or not finite."""
    c = F.col(column)
    return df.where((c < lo) | (c > hi) | F.isnan(c.cast("double")))


def ordered_interval(df: DataFrame, column: str) -> DataFrame:
    """Measures whose interval does not hold the value."""
    return df.where(f"{column}.lo > {column}.value OR {column}.hi < {column}.value")


def annotate_lengths(walls: DataFrame, scale: float, additive: float, q: float, z: float = 1.645) -> DataFrame:
    """Walls (.., length, observed_fraction, residual, up, down) with lo and hi: scale and additive terms in quadrature, thin evidence inflated."""
    step = F.when(F.col("observed_fraction") < 0.3, 2.0).when(F.col("observed_fraction") < 0.6, 1.4).otherwise(1.0)
    own = F.hypot(additive * step, F.coalesce("residual", F.lit(0.0)))
    sigma = F.hypot(F.col("length") * scale, own)
    return walls.withColumn("_iv", interval(F.col("length"), sigma, z * q, F.coalesce("up", F.lit(0.0)), F.coalesce("down", F.lit(0.0)), z)).select("*", "_iv.lo", "_iv.hi").drop("_iv")


def fallback_interval(value: Column, lo: Column, hi: Column, additive: float, zq: float) -> Column:
    """The interval there is, or half the value and one additive term."""
    wide = interval(value, 0.5 * F.abs(value) + additive, zq)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(wide)


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written, so every capture has every field."""
    results.write.option("ignoreNullFields", "false").json(path)


class KeyedStore:
    """Outputs by content key: only keys that are not stored are computed.

    A write is one folder, which Spark commits as a whole; readers see only
    committed ones. Two writers may store a key twice: the row of the folder
    that is first by name is read, whichever that is.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folders(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        paths = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.toString() for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, key: str) -> DataFrame:
        """The stored rows, one a key."""
        found = self._folders()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*found).withColumn("_file", F.input_file_name())
        names = [c for c in rows.columns if c not in (key, "_file")]
        return rows.groupBy(key).agg(F.min_by(F.struct(*names), "_file").alias("_row")).select(key, "_row.*")

    def compute(self, inputs: DataFrame, key: str, run, mode: str = "live") -> DataFrame:
        """Rows of the inputs: live computes what is missing, replay raises on it, off computes all and stores nothing."""
        wanted = inputs.select(key).distinct()
        if mode == "off":
            return run(inputs)
        have = self.read(key)
        new = inputs.join(have.select(key), key, "left_anti")
        if mode == "replay":
            if not new.isEmpty():
                raise LookupError("keys are missing from the store")
            return have.join(wanted, key, "left_semi")
        run(new).select(*have.columns).write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        return self.read(key).join(wanted, key, "left_semi")
