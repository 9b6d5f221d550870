"""Streaming forms: best row a slot, running voxels, keyframes by the last kept one, sessions, idempotent stores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import bins


def timed(events: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time as a timestamp (streams need one with a zone) with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def slot_best(stream: DataFrame, by: Sequence[str], time: str, slot: str, score: str, order: str, values: Sequence[str]) -> DataFrame:
    """Of each tumbling slot the row of the highest score, the first of equals; state is one row a slot and key."""
    best = F.max_by(F.struct(*values), F.struct(F.col(score), -F.col(order))).alias("best")
    return stream.groupBy(F.window(time, slot).alias("w"), *by).agg(best).select(F.col("w.start").alias("slot"), *by, "best.*")


def running_voxels(stream: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Weighted voxel means as points arrive; sums are the state, so late points only add to it."""
    w = F.col("w")
    sums = [(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in ("x", "y", "z")]
    return stream.groupBy(*by, *bins.voxel_keys(size)).agg(*sums, F.sum(w).alias("w_sum"), F.count(F.lit(1)).alias("n"))


def keyframes(stream: DataFrame, key: str, order: str, axes: Sequence[str], distance: float) -> DataFrame:
    """Rows whose position is at least ``distance`` from the last kept row of their key, in order.

    The state is the last kept position and the last order judged. Rows of one
    batch are taken in order; a row that comes after a later one of its key
    was judged is late and left out, so what was given out never changes.
    """
    kinds = dict(stream.dtypes)
    names = [key, order, *axes]

    def step(k: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *last, upto = state.get if state.exists else (*([None] * len(axes)), None)
        rows = pd.concat(list(frames)).sort_values(order)
        kept = []
        for i, (number, *at) in enumerate(rows[[order, *axes]].itertuples(index=False)):
            if upto is not None and number <= upto:
                continue
            upto = int(number)
            if last[0] is None or sum((a - b) ** 2 for a, b in zip(at, last, strict=True)) >= distance * distance:
                kept.append(i)
                last = [float(a) for a in at]
        if upto is not None:
            state.update((*last, upto))
        yield rows.iloc[kept][names]

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    held = ", ".join([*(f"{a} double" for a in axes), "upto long"])
    return stream.select(*names).groupBy(key).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def gap_sessions(stream: DataFrame, by: Sequence[str], time: str, gap: str) -> DataFrame:
    """(start, end, by, n): sessions that end ``gap`` after their last row; the watermark closes them."""
    return stream.groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n")).select("s.start", "s.end", *by, "n")


def append_new(store, key: str, run):
    """A foreachBatch function that stores only keys that are not stored yet, so a batch can be repeated."""

    def batch(df: DataFrame, _: int) -> None:
        store.compute(df, key, run)  # reads what is stored, and writes the rest

    return batch
