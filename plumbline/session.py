"""Session defaults, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators count on; everything else is the cluster's business.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster the setting is required.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders of this process's written tables, by application.
_MADE: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete everything written so far by this process, and its catalog tables, once results have been read or stored."""
    for table in spark.catalog.listTables():
        if table.name.startswith("plumbline_"):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    for folder in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from
    files that outlive any executor, and nothing above is computed again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads. Other tables are left alone."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark).removeprefix("file:").lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.removeprefix("file:").lstrip("/").startswith(root + "/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a shuffle that one task is given, and rows of a key that may meet in one task.
ROWS_A_TASK = 500_000


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of so many rows: one for each core, more where each would get too many."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside shuffle into tasks_of() tasks, which stay apart where one task would not do for all rows."""
    own = {"spark.sql.shuffle.partitions": str(tasks_of(spark, rows)), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        if rows > ROWS_A_TASK:
            for k, v in own.items():
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs planned inside broadcast only what adaptive execution has measured.

    A guess from the size of files knows neither how often a row is exploded
    nor how well it was compressed, and a table guessed small is collected by
    the driver whole. Explicit hints hold.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit, own = spark.conf.get(static), spark.conf.get(adaptive, None)
    try:
        spark.conf.set(adaptive, own or limit)
        spark.conf.set(static, "-1")
        yield
    finally:
        spark.conf.set(static, limit)
        if own is None:
            spark.conf.unset(adaptive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
