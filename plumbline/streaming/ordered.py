"""Streams folded in order of time: slots and segments with value state and timers, whatever batch a row falls into."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that value state and timers need (spark.sql.streaming.stateStore.providerClass).
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Slots:
    """Of each slot of media time the first row of the highest score; a row whose time runs back counts in the current slot."""

    held = "t0 double, slot long, score double, number long, t double"
    out = "slot long, number long, t double, score double"

    def __init__(self, rate: float) -> None:
        self.rate = rate

    def start(self, row: tuple) -> tuple:
        number, t, score = row
        return t, 0, score, number, 0.0

    def step(self, held: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        t0, slot, best, _, _ = held
        number, t, score = row
        t = max(0.0, t - t0)
        now = max(slot, int(t * self.rate + 1e-9))
        if now != slot:
            return (t0, now, score, number, t), self.end(held)
        return ((t0, slot, score, number, t) if score > best else held), None

    def end(self, held: tuple) -> tuple:
        _, slot, score, number, t = held
        return slot, number, t, score


class Segments:
    """Runs of rows within one bin of ``seconds`` from a key's first row, broken where a row is further than distance and faster than speed."""

    held = "t0 double, segment long, bin long, first long, last long, begun double, t double, n long, x double, y double, z double"
    out = "segment long, first long, last long, begun double, ended double, n long"

    def __init__(self, seconds: float, speed: float, distance: float) -> None:
        self.seconds, self.speed, self.distance = seconds, speed, distance

    def start(self, row: tuple) -> tuple:
        number, t, x, y, z = row
        return t, 0, 0, number, number, t, t, 1, x, y, z

    def step(self, held: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        t0, segment, bin_, first, _, begun, before, n, *at = held
        number, t, *place = row
        moved = sum((a - b) ** 2 for a, b in zip(place, at, strict=True)) ** 0.5
        jump = moved > self.distance and moved / max(t - before, 1e-3) > self.speed
        now = int((t - t0) // self.seconds)
        if jump or now != bin_:
            return (t0, segment + 1, now, number, number, t, t, 1, *place), self.end(held)
        return (t0, segment, bin_, first, number, begun, t, n + 1, *place), None

    def end(self, held: tuple) -> tuple:
        _, segment, _, first, last, begun, t, n, *_ = held
        return segment, first, last, begun, t, n


class InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark passes them and are folded by time and number; what is closed is given out once.

    A timer at the earliest of the rows that came together wakes a key; it
    folds all that the watermark has passed and sets the next at the earliest
    row left, so a key wakes about once a batch, not once a row. A key without
    a row for ``idle`` milliseconds ends: its open record is given out, its
    state goes, and a later row begins anew.
    """

    def __init__(self, key: str, kind: str, fold: Slots | Segments, fields: Sequence[tuple[str, str]], idle: int) -> None:
        self.key, self.kind, self.fold, self.fields, self.idle = key, kind, fold, list(fields), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["ms long", *(f"{name} {kind}" for name, kind in self.fields)]))
        self.open = handle.getValueState("open", f"ms long, {self.fold.held}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        listed = [tuple(r) for r in got[["ms", *(name for name, _ in self.fields)]].astype(object).itertuples(index=False)]
        self.waiting.appendList([(int(ms), int(number), *map(float, rest)) for ms, number, *rest in listed])
        self.handle.registerTimer(min(int(r[0]) for r in listed))
        yield pd.DataFrame(columns=self._names())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # whatever the watermark has passed: its timers are all due in this batch, in any order
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [tuple(r) for r in self.waiting.get()]
        due = sorted(r for r in waiting if r[0] <= upto)
        if due:
            rest = [r for r in waiting if r[0] > upto]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(r[0] for r in rest))
            else:
                self.waiting.clear()
        held = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        for ms, *row in due:
            if held is not None and ms - held[0] >= self.idle:
                closed.append(self.fold.end(held[1:]))
                held = None
            if held is None:
                state = self.fold.start(tuple(row))
            else:
                state, record = self.fold.step(held[1:], tuple(row))
                closed += [record] if record is not None else []
            held = (ms, *state)
        if held is not None and upto - held[0] >= self.idle:
            closed.append(self.fold.end(held[1:]))
            self.open.clear()
        elif due:
            self.open.update(held)
            self.handle.registerTimer(held[0] + self.idle)
        yield pd.DataFrame([(key[0], *r) for r in closed], columns=self._names())

    def _names(self) -> list[str]:
        return [self.key, *(part.split()[0] for part in self.fold.out.split(", "))]

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, time: str, number: str, values: Sequence[str], fold: Slots | Segments, idle_seconds: float) -> DataFrame:
    """(key, columns of the fold): closed records of a stream with a watermark on ``time``.

    Rows are folded by time and number, so results do not depend on how they
    fall into batches, as long as none comes later than the watermark allows.
    A record comes out once its successor begins, or its key was idle for
    ``idle_seconds``. Rows with a null in any of the columns take no part. The
    session must use the state store ROCKS.
    """
    kinds = dict(stream.dtypes)
    fields = [(number, "long"), *((v, "double") for v in values)]
    own = stream.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, time, number, *values)))
    own = own.select(F.col(key), F.col(time), F.unix_millis(time).alias("ms"), F.col(number).cast("long").alias(number), *(F.col(v).cast("double").alias(v) for v in values))
    processor = InOrder(key, kinds[key], fold, fields, round(idle_seconds * 1000))
    return own.groupBy(key).transformWithStateInPandas(processor, f"{key} {kinds[key]}, {fold.out}", "append", "EventTime")
