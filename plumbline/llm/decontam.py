"""Benchmark decontamination by template windows with consistent slots.

Texts are reduced to templates: words of letters and digits, A-Z lower-cased,
where numbers, names and units of measure become typed slots. Windows of
consecutive template words are joined by hash between documents and benchmark
items. A question that was re-parameterised ("12 km" to "37 miles") keeps its
windows. An alignment (document, item, shift) counts if the values in its
slots are consistent: one value of the item always stands for one value of
the document.

Numbers are words that begin with a digit; "3.5" or "1,000" is one. Names are
runs of capitalised words that do not begin a sentence. Units count right
after a number. Windows are taken twice, with names as slots and as words, so
a passage in capitals or without any is found too.

An item without a window of enough literals (sums, tables of numbers, very
short ones, sentences without spaces) is taken a third time, word by word:
numbers stay words, characters of scripts without spaces are words of their
own, and all windows have to stand in the document, so exact copies are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textkit import ALNUM, LOWER, U64, constants, mix, run_hashes, slices, word_bounds

#: Template words of a window; an item of fewer words is one window.
WINDOW = 8
#: Words of a window that are no slots, at least.
LITERALS = 4
#: Consistent windows that make a leak, or all of a shorter item's.
LEAK_WINDOWS = 6
#: A form's number times this is added to its places, so the forms are aligned apart.
FORM_BITS = 40
#: The form of literal words, beside those with and without names (0 and 1).
LITERAL_FORM = 2
#: Every task is sent a bit map of 2**FILTER_BITS places (8 MB) of the items' windows; what it lets pass is joined.
FILTER_BITS = 26

# Units of measure.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz w kw v a pa kpa bar n j kj cal kcal "
    "mph kmh kph percent dollar dollars euro euros cent cents usd eur degree degrees"
).split()

# Code points of scripts written without spaces between words, and of punctuation and spaces outside ASCII.
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
PUNCTUATION = ((0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x2190, 0x23FF), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFE30, 0xFE4F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))

NUMBER, NAME, UNIT = 1, 2, 3
_SLOT = constants(4, 31)
_PLACE = constants(64, 32)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
#: Bytes that end a sentence, and those that join the parts of a number.
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n\r")] = True
_JOINT = np.zeros(256, bool)
_JOINT[list(b".,:/")] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(run_hashes(data, np.concatenate(([0], ends[:-1])), ends))


_UNITS = _unit_hashes()


def templates(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Template words of a slice of texts: (row, hash, slot type or 0, hash of the slot's value), with names as slots and without.

    The second form finds passages whose capitals were changed.
    """
    low = LOWER[data]
    starts, ends, rows = word_bounds(data, offs, ALNUM)
    n = len(starts)
    if not n:
        z = np.zeros(0, np.int64)
        return [(z, np.zeros(0, U64), z, np.zeros(0, U64))] * 2
    words = run_hashes(low, starts, ends)
    first = np.concatenate(([True], rows[1:] != rows[:-1]))
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    gap = np.concatenate(([0], ends[:-1]))
    opens = first | (stops[starts] > stops[gap])
    number = _DIGIT[data[starts]]
    at = np.minimum(np.searchsorted(_UNITS, words), len(_UNITS) - 1)
    unit = ~first & np.concatenate(([False], number[:-1])) & ~number & (_UNITS[at] == words)
    name = _CAPITAL[data[starts]] & ~opens & ~unit
    touching = (starts - gap == 1) & _JOINT[data[np.maximum(starts - 1, 0)]]
    out = []
    for names in (name, np.zeros(n, bool)):
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(names, NAME, 0)))
        # words that go on with the slot before them: "3" "." "5", "Ada" "Lovelace"
        same = ~first & np.concatenate(([False], kind[1:] == kind[:-1]))
        head = np.flatnonzero(~(same & (((kind == NUMBER) & touching) | (kind == NAME))))
        value = mix(np.add.reduceat(words * _PLACE[(np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))) & 63], head))
        out.append((rows[head], np.where(kind[head] > 0, _SLOT[kind[head]], words[head]), kind[head], value))
    return out


def _literal_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of literal words: as elsewhere, but a character of a script without spaces is a word, and punctuation outside ASCII none."""
    n = len(data)
    lone, none = np.zeros(n, bool), np.zeros(n, bool)  # by leading byte
    width = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, 2))
    head = np.flatnonzero(data >= 0xC2)
    if len(head):
        at = lambda k: data[np.minimum(head + k, n - 1)].astype(np.int64) & 63
        two, three = (data[head] & 31).astype(np.int64) << 6 | at(1), (data[head] & 15).astype(np.int64) << 12 | at(1) << 6 | at(2)
        code = np.where(width[head] == 2, two, np.where(width[head] == 3, three, (data[head] & 7).astype(np.int64) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        within = lambda spans: np.any([(code >= a) & (code <= b) for a, b in spans], axis=0)
        none[head], lone[head] = within(PUNCTUATION), within(UNSPACED)
        lone &= ~none
    inside = ALNUM[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    for k in range(4):
        gone = np.flatnonzero(none & (width > k)) + k
        inside[gone[gone < n]] = False
    own = np.flatnonzero(lone)
    cut[own] = cut[np.minimum(own + width[own], n)] = True
    kept = np.concatenate(([False], inside, [False]))
    starts = np.flatnonzero(inside & (~kept[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside & (~kept[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def literals(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Literal words of a slice of texts, in the form of templates(): no slots."""
    starts, ends, rows = _literal_words(data, offs) if len(data) else (np.zeros(0, np.int64),) * 3
    return rows, run_hashes(LOWER[data], starts, ends), np.zeros(len(rows), np.int64), np.zeros(len(rows), U64)


def _forms(data: np.ndarray, offs: np.ndarray, sizes: dict[int, tuple[int, ...]]) -> Iterator[tuple[int, tuple]]:
    if 0 in sizes or 1 in sizes:
        yield from ((k, t) for k, t in enumerate(templates(data, offs)) if k in sizes)
    if LITERAL_FORM in sizes:
        yield LITERAL_FORM, literals(data, offs)


def windows(rows: np.ndarray, words: np.ndarray, kind: np.ndarray, size: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of ``size`` words with enough literals."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    rolled = np.zeros(n, U64)
    for k in range(size):
        rolled += words[k : k + n] * _PLACE[k]
    if form == LITERAL_FORM:
        at = np.flatnonzero(rows[:n] == rows[size - 1 :])
        return at, mix(rolled[at] + np.full(1, 4096 + size, U64))
    slots = np.concatenate(([0], np.cumsum(kind > 0)))
    good = (rows[:n] == rows[size - 1 :]) & (size - (slots[size:] - slots[:n]) >= min(LITERALS, size))
    at = np.flatnonzero(good)
    return at, mix(rolled[at] + np.full(1, 2 * size + form, U64))


_WINDOWS = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64()))])
_WINDOWS_SQL = "id long, place long, hash long, slots array<long>"


def _windowed(sizes: dict[int, tuple[int, ...]], wanted=None):
    """Windows of each form's sizes; wanted: a broadcast bit map of the hashes that may be needed, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            ids = batch.column("id")
            for row, data, offs in slices(batch.column("text")):
                for form, (rows, words, kind, value) in _forms(data, offs, sizes):
                    first = np.searchsorted(rows, np.arange(len(offs) - 1)) - (form << FORM_BITS)
                    slot = np.where(kind > 0, value, np.zeros(1, U64)).view(np.int64)
                    for size in sizes[form]:
                        at, hashes = windows(rows, words, kind, size, form)
                        if keep is not None:
                            place = hashes >> U64(64 - FILTER_BITS)
                            met = (keep[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1
                            at, hashes = at[met], hashes[met]
                        for k in range(0, len(at), 50_000):
                            a, h = at[k : k + 50_000], hashes[k : k + 50_000]
                            held = slot[a[:, None] + np.arange(size)].ravel()
                            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * size, pa.int32()), pa.array(held))
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array(rows[a] + row)), pa.array(a - first[rows[a]]), pa.array(h.view(np.int64)), lists], schema=_WINDOWS
                            )

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offs in slices(batch.column("text")):
            counts = np.minimum(*(np.bincount(t[0], minlength=len(offs) - 1) for t in templates(data, offs)))
            said = np.bincount(literals(data, offs)[0], minlength=len(offs) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(offs) - 1), pa.array(counts), pa.array(said)], ["id", "n", "said"])


def _texts(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, dict[int, tuple[int, ...]]]:
    """The items' windows (id, form, place, hash, slots, total) and the sizes of window among them by form.

    total is the number of windows of the item in the form. Items without a
    window of the form without names, which has no dependence on what stands
    around, have windows of the literal form too.
    """
    items = _texts(benchmark, "item_id")
    lengths = materialize(items.mapInArrow(_lengths, "id long, n long, said long"), "items")
    under = lambda rows, n: tuple(sorted(r[0] for r in rows.where((F.col(n) < size) & (F.col(n) > 0)).select(n).distinct().collect()))  # noqa: E731  # fewer than size values
    sizes = (*under(lengths.where(F.col("n") >= LITERALS), "n"), size)
    form = F.shiftright("place", FORM_BITS)
    most = lengths.groupBy("id").agg(F.max("n").alias("n"), F.max("said").alias("said"))

    def own(texts: DataFrame, by_form: dict[int, tuple[int, ...]], n: str) -> DataFrame:
        wide = texts.mapInArrow(_windowed(by_form), _WINDOWS_SQL).join(most, "id")
        return wide.where(F.size("slots") == F.least(n, F.lit(size))).select("id", "place", "hash", "slots", form.alias("form")).distinct()

    usual = materialize(own(items, {0: sizes, 1: sizes}, "n"), "usual-windows")
    rest = lengths.join(usual.where("form = 1").select("id").distinct(), "id", "left_anti")
    said = (*under(rest, "said"), *([size] if rest.where(F.col("said") >= size).limit(1).count() else []))
    found, by_form = usual, {0: sizes, 1: sizes}
    if said:
        by_form[LITERAL_FORM] = said
        found = usual.union(own(items.join(rest.select("id").distinct(), "id"), {LITERAL_FORM: said}, "said"))
    totals = found.groupBy("id", "form").agg(F.countDistinct("place").alias("total"))
    return materialize(found.join(totals, ["id", "form"]), "item-windows"), by_form


def _bit_map(items: DataFrame) -> np.ndarray:
    """A bit for every window hash of the items, by its upper bits; the size is the same for any benchmark."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = items.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(hash, {64 - FILTER_BITS}), 64) AS int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**(FILTER_BITS - 6) rows
    out = np.zeros(1 << (FILTER_BITS - 6), U64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, share): one row for each benchmark item in a document.

    n_windows counts the item's windows in the alignment, n_slots the
    distinct slot values it had to keep consistent, share is n_windows over
    all windows of the item. Of several alignments the longest is told. A
    null or empty text has no windows; an empty benchmark gives no rows.
    Repeated rows of a doc_id are told once; rows without doc_id together.
    Columns other than doc_id and text, and item_id and text, are not read.
    """
    items, sizes = benchmark_windows(benchmark, size)
    wanted = docs.sparkSession.sparkContext.broadcast(_bit_map(items))
    found = _texts(docs, "doc_id").mapInArrow(_windowed(sizes, wanted), _WINDOWS_SQL).toDF("doc_id", "at", "hash", "values")
    met = found.join(items, "hash").where(F.size("slots") == F.size("values"))
    pairs = F.filter(F.zip_with("slots", "values", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"] != 0)
    met = met.select("doc_id", F.col("id").alias("item_id"), "form", (F.col("at") - F.col("place")).alias("shift"), "place", "total", pairs.alias("pairs"))
    # at most a row for each window of the item in a shift
    lined = met.groupBy("doc_id", "item_id", "form", "shift").agg(
        F.countDistinct("place").alias("n_windows"), F.max("total").alias("total"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    # a literal copy is whole
    enough = F.when(F.col("form") == LITERAL_FORM, F.col("total")).otherwise(F.least(F.lit(LEAK_WINDOWS), "total"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"])))
    lined = lined.where((values == F.size("pairs")) & (F.col("n_windows") >= enough))
    best = lined.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", F.size("pairs").alias("n_slots"), "total")).alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.n_windows").cast("long").alias("n_windows"), F.col("best.n_slots").cast("long").alias("n_slots"),
        F.round(F.col("best.n_windows") / F.col("best.total"), 6).alias("share"),
    )
