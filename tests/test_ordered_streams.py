"""Slots and segments of streams against plain Python, with the same rows split into batches in different ways."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.streaming.ordered import ROCKS, InOrder, Segments, Slots, in_order

SCHEMA = "k string, ms long, number long, t double, score double, x double, y double, z double"


def capture(key, start, n, seed):
    """Frames 100 ms apart whose media time runs back at times, on a walk with jumps and one pause."""
    rng, rows, x = random.Random(seed), [], 0.0
    for i in range(n):
        x += 3.0 if i % 23 == 22 else 0.05
        ms = start + i * 100 + (60_000 if i >= n * 2 // 3 else 0)
        t = ms / 1000 - (0.9 if i % 7 == 3 else 0.0)
        rows.append((key, ms, i, t, float(rng.randint(0, 4)), x, 0.0, 0.0))
    return rows


def plain(rows, fold, fields, idle):
    out = []
    for key in sorted({r[0] for r in rows}):
        held = last = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if held is not None and r[1] - last >= idle:
                out.append((key, *fold.end(held)))
                held = None
            row = tuple(r[i] for i in fields)
            if held is None:
                held = fold.start(row)
            else:
                held, record = fold.step(held, row)
                out += [(key, *record)] if record is not None else []
            last = r[1]
        out.append((key, *fold.end(held)))
    return sorted(out)


def streamed(spark, tmp_path, batches, values, fold, idle):
    """Each batch is a file, read one at a time; a last row far ahead closes all that is open."""
    source = tmp_path / uuid.uuid4().hex
    for n, rows in enumerate([*batches, [("end", 10_000_000, 0, 0.0, 0.0, 0.0, 0.0, 0.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"{n:03d}"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    s = s.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "20 seconds")
    name = f"m{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        q = in_order(s, "k", "ts", "number", values, fold, idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sorted(tuple(r) for r in spark.table(name).where("k <> 'end'").collect())


@pytest.mark.parametrize("what", ["slots", "segments"])
def test_results_do_not_depend_on_batches(spark, tmp_path, what):
    fold, values, fields = (Slots(1.0), ["t", "score"], (2, 3, 4)) if what == "slots" else (Segments(2.5, 10.0, 0.5), ["t", "x", "y", "z"], (2, 3, 5, 6, 7))
    rows = capture("a", 1_000, 90, 1) + capture("b", 2_000, 60, 2)
    want = plain(rows, fold, fields, 30_000)
    by_time = sorted(rows, key=lambda r: r[1])
    mixed = [r for block in (by_time[i : i + 30] for i in range(0, len(by_time), 30)) for r in random.Random(3).sample(block, len(block))]
    assert streamed(spark, tmp_path, [by_time], values, fold, 30.0) == want
    assert streamed(spark, tmp_path, [mixed[i : i + 50] for i in range(0, len(mixed), 50)], values, fold, 30.0) == want


def test_a_row_of_earlier_media_time_counts_in_the_current_slot():
    fold = Slots(1.0)
    held = fold.start((0, 10.0, 1.0))
    held, closed = fold.step(held, (1, 11.2, 2.0))
    assert closed == (0, 0, 0.0, 1.0)
    held, closed = fold.step(held, (2, 10.5, 3.0))
    assert closed is None and fold.end(held) == (1, 2, 0.5, 3.0)


class _Held:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getListState(self, name, schema):
        return _Cell()

    def getValueState(self, name, schema):
        return _Cell()

    def registerTimer(self, ms):
        self.timers.append(ms)


class _Cell:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value or []

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    def getCurrentWatermarkInMs(self):
        return 5_000


def test_a_key_wakes_once_a_batch():
    held, keyed = _Held(), InOrder("k", "string", Slots(1.0), [("number", "long"), ("t", "double"), ("score", "double")], 30_000)
    keyed.init(held)
    rows = pd.DataFrame([(ms, n, ms / 1000, 1.0) for n, ms in enumerate(range(1_000, 9_000, 100))], columns=["ms", "number", "t", "score"])
    list(keyed.handleInputRows(("a",), iter([rows]), None))
    assert held.timers == [1_000]
    got = pd.concat(keyed.handleExpiredTimer(("a",), _At(5_000), _At(1_000)))
    assert got["slot"].tolist() == [0, 1, 2, 3]
    assert held.timers[1:] == [5_100, 35_000]
