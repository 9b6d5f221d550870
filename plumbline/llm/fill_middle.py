"""Fill-in-the-middle texts: each text is cut into prefix, middle and suffix, which are put in another order.

Units are runs of ASCII letters and single other code points. A batch goes
through pyarrow.compute as a whole: units are marked off with a byte that UTF-8
never has and split into list arrays, flattened beside the index of their
text, numbered within it, filtered by role (before the first cut, between the
cuts, behind the second), rebuilt into one list a text and role, and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many start with their suffix.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text that go through the arrays together; one longer text goes by itself.
SLICE_BYTES = 2 << 20
#: A unit in bytes of UTF-8, and the byte set behind each.
_UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFE][\x80-\xBF]*"
_END = b"\xff"
_NOTHING = pa.scalar(b"", pa.large_binary())
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def _remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(b, pc.divide(a, b)))


def _pieces(units: pa.Array, role: pa.Array, lengths: pa.Array) -> pa.Array:
    """The units of a role joined, one value a text; lengths are the role's units in each text."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(lengths)])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, units.filter(role)), _NOTHING)


def _cut(text: pa.Array, h: list[pa.Array]) -> list[pa.Array]:
    """The columns of SCHEMA for texts (large_binary, no nulls) and their four hash numbers."""
    marked = pc.replace_substring_regex(text, pattern=_UNIT, replacement=rb"\0" + _END)
    lists = pc.split_pattern(marked, pattern=_END).cast(pa.large_list(pa.large_binary()))
    sizes = pc.list_value_length(lists)  # what stands behind the last mark is one more, and empty
    n = pc.subtract(sizes, 1)
    cuts = [_remainder(x, sizes) for x in h[:2]]
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)

    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = lists.offsets.slice(0, len(lists)).cast(pa.int64())
    ordinal = pc.subtract(pa.arange(0, len(units)), pc.take(pc.subtract(begin, begin[0]), parent)) if len(lists) else pa.array([], pa.int64())
    a, b, end = (pc.take(x, parent) for x in (first, second, n))
    head = pc.less(ordinal, a)
    tail = pc.and_(pc.greater_equal(ordinal, b), pc.less(ordinal, end))
    mid = pc.and_(pc.greater_equal(ordinal, a), pc.less(ordinal, b))
    pieces = [_pieces(units, role, size) for role, size in ((head, first), (mid, pc.subtract(second, first)), (tail, pc.subtract(n, second)))]

    marks = [pc.match_substring(text, mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(marks[0], marks[1]), pc.or_(marks[2], pc.or_(pc.equal(n, 0), pc.greater_equal(_remainder(h[2], pa.scalar(100)), CUT))))
    swapped = pc.less(_remainder(h[3], pa.scalar(100)), SUFFIX_FIRST)
    say = lambda *parts: pc.binary_join_element_wise(*(pa.scalar(p.encode(), pa.large_binary()) if isinstance(p, str) else p for p in parts), _NOTHING)
    psm, spm = say(PREFIX, pieces[0], SUFFIX, pieces[2], MIDDLE, pieces[1]), say(SUFFIX, pieces[2], PREFIX, pieces[0], MIDDLE, pieces[1])
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p.view(pa.large_string())).cast(pa.int64())) for p in pieces[:2]]
    output = pc.if_else(plain, text, pc.if_else(swapped, spm, psm)).view(pa.large_string())
    return [n, pc.if_else(plain, "plain", pc.if_else(swapped, "spm", "psm")), *chars, output]


def _formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, h1 .. h4) as (doc_id, *SCHEMA), a few MB of text at a time."""
    for batch in batches:
        text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        ends = pc.cumulative_sum(pc.binary_length(text).cast(pa.int64())).to_numpy()
        begin, before = 0, 0
        while begin < len(text):
            end = max(begin + 1, int(ends.searchsorted(before + SLICE_BYTES, side="right")))
            h = [batch.column(f"h{k}").slice(begin, end - begin) for k in (1, 2, 3, 4)]
            n, form, head, mid, output = _cut(pa.concat_arrays([text.slice(begin, end - begin)]), h)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), n, form, head, mid, output.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            begin, before = end, int(ends[end - 1])


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs.

    n is the number of units. Where to cut, and the form, come from
    the first four groups of 8 hex digits of the SHA-256 of ``seed:doc_id``:
    so they depend on nothing but the id, and rows that repeat an id have the
    same numbers. A text stays as it is (form ``plain``, no piece lengths) if
    it is null or empty, has one of the marks in it, or by its third number;
    else the output is ``<P>``prefix``<S>``suffix``<M>``middle (``psm``) or, by
    its fourth, ``<S>``suffix``<P>``prefix``<M>``middle (``spm``). Any piece
    may be empty. A row without doc_id is hashed as ``seed:``. Texts of any
    length are cut whole; nothing is shuffled; other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *numbers)
    return rows.mapInArrow(_formed, f"doc_id long, {SCHEMA}")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: no piece has a mark in it, so the marks split the output into its pieces."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
