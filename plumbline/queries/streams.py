"""Streaming queries, run to the end of the given tables, against their batch form in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.result import KeyedStore
from plumbline.session import fresh_path, read_table
from plumbline.streaming import operators as st
from plumbline.streaming import ordered

from .tables import POINTS_SQL

QUERIES, ORACLE_SQL = {}, {}


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = read_table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _finished(spark: SparkSession, out: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The table that the stream leaves behind: its last complete result, all rows appended, or the last update of each key."""
    path = fresh_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{'last' if mode == 'complete' else number}")

    query = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(out.withColumn("_batch", F.lit(0)).schema).parquet(f"{path}/out")
    if mode != "update":
        return rows.drop("_batch")
    rest = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def stream_slot_argmax(spark: SparkSession, d: str) -> DataFrame:
    """In update mode the watermark drops the state of slots that are over."""
    e = st.timed(_stream(spark, d, "events"), "ts", "10 minutes")
    best = st.slot_best(e, ["user_id"], "ts", "1 hour", "value", "event_id", ["event_id", "value"])
    return _finished(spark, best, "update", ("slot", "user_id")).select("user_id", F.unix_micros("slot").alias("slot_us"), "event_id", "value")


def stream_voxel(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = _stream(spark, d, "embeddings").select(e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), (F.abs(e(6)) + 0.1).alias("w"))
    v = _finished(spark, st.running_voxels(p, 0.1), "update", ("ix", "iy", "iz"))
    return v.select("ix", "iy", "iz", *(F.round(c, 9).alias(c) for c in ("x", "y", "z", "w_sum")), "n")


def stream_keyframes(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "events").select("user_id", "event_id", "value")
    return _finished(spark, st.keyframes(e, "user_id", "event_id", ["value"], 20.0), "append")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = st.timed(_stream(spark, d, "events"), "ts", "10 minutes")
    s = _finished(spark, st.gap_sessions(e, ["user_id"], "ts", "30 minutes"), "complete")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def stream_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents' keys streamed twice into a store by key: the second time adds nothing."""
    store = KeyedStore(spark, fresh_path(spark, "stream-store"), "key string, n int")
    keys = lambda df: df.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")).distinct()
    once = st.append_new(store, "key", lambda new: new.select("key", F.length("key").alias("n")))
    for _ in range(2):
        path = fresh_path(spark, "stream")
        _stream(spark, d, "documents").writeStream.foreachBatch(lambda df, n: once(keys(df), n)).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return store.read("key")


def _in_order(spark: SparkSession, d: str, values: dict, fold, columns: tuple[str, ...]) -> DataFrame:
    """Events folded by user, with the state store that timers need for this stream alone."""
    e = st.timed(_stream(spark, d, "events"), "ts", "10 minutes").select("user_id", "ts", "event_id", *(c.alias(n) for n, c in values.items()))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ordered.ROCKS)
    try:
        out = _finished(spark, ordered.in_order(e, "user_id", "ts", "event_id", list(values), fold, 43_200.0), "append")
    finally:
        spark.conf.set(setting, before)
    return out.select("user_id", *columns)


def stream_slots(spark: SparkSession, d: str) -> DataFrame:
    """Hours of media time that runs back at every seventh event; a user idle for half a day begins anew."""
    t = F.unix_micros(F.col("ts")) / 1e6 - F.when(F.col("event_id") % 7 == 3, 5000.0).otherwise(0.0)
    return _in_order(spark, d, {"t": t, "score": F.col("value")}, ordered.Slots(1 / 3600), ("slot", "number", "score"))


def stream_segments(spark: SparkSession, d: str) -> DataFrame:
    """Six hours from a user's first event, broken at jumps of the value."""
    values = {"t": F.unix_micros(F.col("ts")) / 1e6, "x": F.col("value"), "y": F.lit(0.0), "z": F.lit(0.0)}
    return _in_order(spark, d, values, ordered.Segments(21_600.0, 0.001, 40.0), ("segment", "first", "last", "n"))


# what the watermark has passed, in runs of less than half a day between events
_RUNS_SQL = """w AS (SELECT floor(epoch_us(max(ts)) / 1000)::bigint - 600000 AS w FROM events), e AS (SELECT user_id, event_id, value, floor(epoch_us(ts) / 1000)::bigint AS ms, epoch_us(ts) / 1e6::double AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL),
g AS (SELECT e.*, coalesce(ms - lag(ms) OVER u >= 43200000, false) AS new FROM e, w WHERE ms <= w WINDOW u AS (PARTITION BY user_id ORDER BY ms, event_id)), r AS (SELECT *, sum(new::int) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)"""
QUERIES |= {f.__name__: f for f in (stream_slots, stream_segments)}
ORACLE_SQL["stream_slots"] = f"""WITH {_RUNS_SQL}, m AS (SELECT *, t - CASE WHEN event_id % 7 = 3 THEN 5000 ELSE 0 END AS mt FROM r), z AS (SELECT *, greatest(mt - first_value(mt) OVER (PARTITION BY user_id, run ORDER BY ms, event_id), 0) AS z FROM m), s AS (SELECT *, max(floor(z * (1 / 3600.0::double) + 1e-9::double)::bigint) OVER (PARTITION BY user_id, run ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM z),
a AS (SELECT user_id, run, slot, arg_max(event_id, (value, -i)) AS number, max(value) AS score, max(ms) AS last, row_number() OVER (PARTITION BY user_id ORDER BY run DESC, slot DESC) AS back FROM s GROUP BY 1, 2, 3) SELECT user_id, slot, number, score FROM a, w WHERE back > 1 OR w - last >= 43200000"""
ORACLE_SQL["stream_segments"] = f"""WITH {_RUNS_SQL}, b AS (SELECT *, floor((t - first_value(t) OVER u) / 21600)::bigint AS bin, coalesce(abs(value - lag(value) OVER u) > 40 AND abs(value - lag(value) OVER u) / greatest(t - lag(t) OVER u, 0.001::double) > 0.001::double, false) AS jump, row_number() OVER u AS i FROM r WINDOW u AS (PARTITION BY user_id, run ORDER BY ms, event_id)),
c AS (SELECT *, coalesce((jump OR bin <> lag(bin) OVER (PARTITION BY user_id, run ORDER BY i))::int, 0) AS step FROM b), s AS (SELECT *, sum(step) OVER (PARTITION BY user_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::bigint AS segment FROM c),
a AS (SELECT user_id, run, segment, arg_min(event_id, i) AS first, arg_max(event_id, i) AS last, count(*) AS n, max(ms) AS ended, row_number() OVER (PARTITION BY user_id ORDER BY run DESC, segment DESC) AS back FROM s GROUP BY 1, 2, 3) SELECT user_id, segment, first, last, n FROM a, w WHERE back > 1 OR w - ended >= 43200000"""

QUERIES |= {f.__name__: f for f in (stream_slot_argmax, stream_voxel, stream_keyframes, stream_sessions, stream_store)}
ORACLE_SQL["stream_store"] = """SELECT DISTINCT md5(coalesce(text, '')) AS key, 32::int AS n FROM documents"""
ORACLE_SQL["stream_sessions"] = """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events), n AS (SELECT *, coalesce((t - lag(t) OVER w >= 1800000000)::int, 0) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM n)
SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s"""
ORACLE_SQL["stream_slot_argmax"] = """SELECT user_id, epoch_us(date_trunc('hour', ts)) AS slot_us, arg_max(event_id, (value, -event_id)) AS event_id, arg_max(value, (value, -event_id)) AS value FROM events GROUP BY 1, 2"""
ORACLE_SQL["stream_voxel"] = f"""WITH {POINTS_SQL} SELECT floor(x / 0.1::double)::bigint AS ix, floor(y / 0.1::double)::bigint AS iy, floor(z / 0.1::double)::bigint AS iz, round(sum(w*x)/sum(w), 9) AS x, round(sum(w*y)/sum(w), 9) AS y, round(sum(w*z)/sum(w), 9) AS z, round(sum(w), 9) AS w_sum, count(*) AS n FROM points GROUP BY 1, 2, 3"""
