"""Exact repeated substrings over all documents, by a sampled suffix sort.

A byte is removed if it lies in a string of ``length`` bytes that also starts
anywhere else. Sorting every suffix of the corpus would move many times the
input; this sorts the few that can decide anything.

1. Anchors. In every window of ``length`` bytes the k-gram of smallest hash is
   selected, the leftmost of equals. Equal windows select the same place, so
   comparing windows of equal anchors loses nothing; an anchor stands for all
   consecutive windows that select it (its *reach*), one in about 170 bytes.
2. Whole reaches. Reaches that are equal as strings (two 64-bit hashes) would
   stand side by side in the order, so one of each kind stands for all; each
   of the others is matched with it in all its windows.
3. Suffix sort. One reach of each kind whose k-gram recurs with another reach
   is cut out and grouped by k-gram. A merge sort orders the suffixes that
   start at the anchors; suffixes are compared in logarithmic time by prefix
   polynomial hashes and binary search for the common extension. Neighbours'
   common extensions split the order into blocks for every offset, hashes of
   the part left of the anchor split the blocks, and what is still together
   repeats. Every repeat found is compared byte by byte before it counts.
4. K-grams with more different reaches than ``large_group`` would fill a task.
   Their windows are taken in stretches of STRETCH: a stretch whose common
   core is nowhere else repeats nowhere, one that is elsewhere as a whole
   repeats throughout. Only the stretches between, which hold the very end of
   a copy, are dealt out window by window, by digest, and counted.
5. Verification. What steps 2 and 4 matched by hash is joined into runs of
   bytes, one for each (document, other document, shift), and the other
   document's bytes are brought to every run and compared. Bytes that differ
   under equal hashes stop the job instead of removing anything.

Nothing but whole keys decides, so the result is the same however the rows are
dealt out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, fresh_path, materialize, measured_broadcasts, small_batches
from .textkit import U64, constants, mix

_BLOCK = 1 << 20
#: Windows of a crowded k-gram that are judged together.
STRETCH = 16
_BYTE = constants(256, 21)


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.ones(n, U64)
    step, power = 1, base
    while step < n:
        out[step : 2 * step] = out[: min(step, n - step)] * np.full(1, power, U64)
        step, power = 2 * step, power * power % (1 << 64)
    return out


_BASE = int(constants(1, 22)[0])
_POWER = _powers(_BLOCK + 1, _BASE)
_INVERSE = _powers(_BLOCK + 1, pow(_BASE, -1, 1 << 64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of up to a block of bytes."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end), equal for equal strings wherever they stand."""
    return (prefix[end] - prefix[start]) * _INVERSE[start]


def gram_size(length: int) -> int:
    return max(8, min(64, length // 4))


def large_group(length: int) -> int:
    """Most different reaches of one k-gram that one task sorts: they fit a block of bytes."""
    return max(2, min(1024, _BLOCK // (2 * length)))


def anchors(text: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, last window, k-gram hash) arrays that cover all windows of a text."""
    k = gram_size(length)
    w = length - k + 1
    step = _BLOCK - length
    for begin in range(0, len(text) - length + 1, step):
        part = text[begin : begin + step + length - 1]
        prefix = prefix_hashes(part)
        n = len(part) - k + 1
        grams = mix((prefix[k:] - prefix[:-k]) * _INVERSE[:n])
        keys = (grams >> U64(20) << U64(20)) | np.arange(n, dtype=U64)
        fill = np.full(-n % w, ~U64(0), U64)
        tiles = np.concatenate((keys, fill)).reshape(-1, w)
        fore = np.minimum.accumulate(tiles, axis=1).ravel()
        back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - w + 1
        chosen = (np.minimum(back[:windows], fore[w - 1 : w - 1 + windows]) & U64(_BLOCK - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.concatenate((first[1:], [windows])) - 1
        at = chosen[first]
        yield at + begin, first + begin, last + begin, grams[at]


_ANCHORS = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("gram", pa.int64()), ("reach", pa.int64())]
)


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, held, rows = batch.column("doc_id"), batch.column("key"), [], 0
            for i, value in enumerate(batch.column("text")):
                if not value.is_valid or len(raw := value.as_buffer()) < length:
                    continue
                text, view = np.frombuffer(raw, np.uint8), memoryview(raw)
                for at, lo, hi, gram in anchors(text, length):
                    digests = b"".join(hashlib.blake2b(view[a : b + length], digest_size=8).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
                    n = len(at)
                    held.append([docs.take(pa.array(np.full(n, i))), keys.take(pa.array(np.full(n, i))), at, lo, hi, gram.view(np.int64), np.frombuffer(digests, np.int64)])
                    rows += n
                    if rows >= 20_000:
                        yield _together(held, _ANCHORS)
                        held, rows = [], 0
            if held:
                yield _together(held, _ANCHORS)

    return run


def _together(held: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[x if isinstance(x, pa.Array) else pa.array(x) for x in column] for column in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CUTS = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("gram", pa.int64()), ("open", pa.bool_()), ("kinds", pa.int64()), ("cut", pa.binary())]
)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _CUTS.names}
            for doc, key, value, parts in zip(*(batch.column(c) for c in ("doc_id", "key", "text", "parts")), strict=True):
                view, doc, key = memoryview(value.as_buffer()), doc.as_py(), key.as_py()
                if (doc, key) == last:  # a repeated row; its reaches are settled by their count
                    continue
                last = doc, key
                for p in parts.as_py():
                    for name in ("at", "lo", "hi", "gram", "open", "kinds"):
                        out[name].append(p[name])
                    out["doc_id"].append(doc)
                    out["key"].append(key)
                    out["cut"].append(bytes(view[p["lo"] : p["hi"] + length]))
                if len(out["cut"]) >= 5_000:
                    yield pa.RecordBatch.from_pydict(out, schema=_CUTS)
                    out = {name: [] for name in _CUTS.names}
            if out["cut"]:
                yield pa.RecordBatch.from_pydict(out, schema=_CUTS)

    return run


class SuffixSort:
    """Suffixes data[start:end) of one buffer, grouped, in order within each group."""

    def __init__(self, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.data, self.prefix, self.start, self.end, self.group = data, prefix, start, end, group

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y, by binary search over hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Suffix x before suffix y, a shorter one before its extensions."""
        n = self.extension(x, y)
        i, j = self.start[x] + n, self.start[y] + n
        left, right = i < self.end[x], j < self.end[y]
        last = len(self.data) - 1
        return np.where(left & right, self.data[np.minimum(i, last)] < self.data[np.minimum(j, last)], right & ~left)

    def order(self) -> np.ndarray:
        """The suffixes, merge-sorted within their groups; groups are runs of equal ids."""
        n = len(self.start)
        first = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1])))
        sizes = np.diff(np.append(first, n))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        place = np.arange(n) - base
        order, width = np.arange(n), 1
        while width < int(sizes.max(initial=1)):
            block = place // (2 * width) * (2 * width)
            right = place - block >= width
            # the run beside: where it begins and ends
            lo = base + np.where(right, block, np.minimum(block + width, size))
            hi = base + np.where(right, block + width, np.minimum(block + 2 * width, size))
            begin = lo.copy()
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) >> 1
                mine, theirs = order[live], order[mid]
                # a left element counts those strictly before it, a right one also its equals
                goes = np.empty(len(live), bool)
                on_right = right[live]
                goes[~on_right] = self.below(theirs[~on_right], mine[~on_right])
                goes[on_right] = ~self.below(mine[on_right], theirs[on_right])
                lo[live] = np.where(goes, mid + 1, lo[live])
                hi[live] = np.where(goes, hi[live], mid)
            target = base + block + (place - block - np.where(right, width, 0)) + (lo - begin)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, 2 * width
        return order


def repeats(cuts: list[memoryview], offset: np.ndarray, last: np.ndarray, group: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(cut, start, end) of bytes inside the cuts that are in a repeated window.

    offset is the anchor's place in its cut and last the last window's; cuts of
    one group stand together.
    """
    sizes = np.array([len(c) for c in cuts], np.int64)
    data = np.frombuffer(b"".join(cuts), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    prefix, anchor = prefix_hashes(data), base + offset
    sort = SuffixSort(data, prefix, anchor, np.minimum(base + sizes, anchor + length), group)
    order = sort.order()
    same = np.concatenate(([False], group[order[1:]] == group[order[:-1]]))
    lcp = np.full(len(order), -1, np.int64)
    lcp[same] = sort.extension(order[np.flatnonzero(same) - 1], order[same])

    # the windows of each cut, by their distance left of the anchor, cuts in sorted order
    distances = np.arange(int(offset.max()) + 1)
    block = np.cumsum(lcp[:, None] < (length - distances)[None, :], axis=0, dtype=np.int32)
    held = (distances[None, :] <= offset[order][:, None]) & (distances[None, :] >= (offset - last)[order][:, None])
    row, distance = np.nonzero(held)
    cut = order[row]
    left = span_hashes(prefix, anchor[cut] - distance, anchor[cut])
    # a block number belongs to one group and offset: the rows of other groups never share one
    kind = mix(left ^ mix((block[row, distance].astype(U64) << U64(20)) + distance.astype(U64)))
    by = np.argsort(kind, kind="stable")
    head = np.concatenate(([True], kind[by][1:] != kind[by][:-1]))
    leader = by[np.flatnonzero(head)][np.cumsum(head) - 1]
    partner = np.empty(len(by), np.int64)
    partner[by] = cut[leader]
    counts = np.diff(np.append(np.flatnonzero(head), len(by)))
    several = np.empty(len(by), bool)
    several[by] = np.repeat(counts > 1, counts)
    # the leader's own partner is the next of its kind
    second = np.flatnonzero(head)[counts > 1] + 1
    partner[by[second - 1]] = cut[by[second]]

    found, chosen = [], np.flatnonzero(several)
    if not len(chosen):
        return found
    chosen = chosen[np.lexsort((distance[chosen], partner[chosen], cut[chosen]))]
    c, p, d = cut[chosen], partner[chosen], distance[chosen]
    ends = np.flatnonzero(np.concatenate((c[1:] != c[:-1], [True])) | np.concatenate((p[1:] != p[:-1], [True])) | np.concatenate((d[1:] != d[:-1] + 1, [True])))
    begin = 0
    for end in ends.tolist():
        one, other, near, far = int(c[end]), int(p[end]), int(d[begin]), int(d[end])
        i, j = int(offset[one]), int(offset[other])
        if cuts[one][i - far : i - near + length] == cuts[other][j - far : j - near + length]:
            found.append((one, i - far, i - near + length))
        else:  # hashes met by chance somewhere: compare the windows one by one
            for x in range(near, far + 1):
                if cuts[one][i - x : i - x + length] == cuts[other][j - x : j - x + length]:
                    found.append((one, i - x, i - x + length))
        begin = end + 1
    return found


_RANGES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _sorted_repeats(length: int):
    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        at, lo, hi = (rows.column(c).to_numpy() for c in ("at", "lo", "hi"))
        cuts = [memoryview(x.as_buffer()) for x in rows.column("cut")]
        opened = rows.column("open").to_numpy(zero_copy_only=False)
        found = [x for x in repeats(cuts, at - lo, hi - lo, rows.column("gram").to_numpy(), length) if opened[x[0]]]
        which = np.array([x[0] for x in found], np.int64)
        start, end = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64)
        ids = rows.select(["doc_id", "key"]).take(pa.array(which))
        columns = [ids.column(0).combine_chunks(), ids.column(1).combine_chunks(), pa.array(start + lo[which]), pa.array(end + lo[which])]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive together; as many as fit a block of bytes are sorted at once."""
        held: pa.Table | None = None
        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(row, 1024)])
                held = part if held is None else pa.concat_tables([held, part])
                grams = held.column("gram").to_numpy()
                whole = int(np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))[-1])
                if whole and len(grams) >= 1024:
                    yield from map(solve, _fitting(held.slice(0, whole), length))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from map(solve, _fitting(held, length))

    return run


def _fitting(rows: pa.Table, length: int) -> Iterator[pa.Table]:
    """Runs of whole groups with less than a block of bytes (or one group)."""
    grams = rows.column("gram").to_numpy()
    ends = np.append(np.flatnonzero(grams[1:] != grams[:-1]) + 1, len(grams))
    sizes = np.cumsum((rows.column("hi").to_numpy() - rows.column("lo").to_numpy()) + length)
    begin = 0
    while begin < len(grams):
        limit = (sizes[begin - 1] if begin else 0) + _BLOCK // 2
        fits = ends[(ends > begin) & (sizes[ends - 1] <= limit)]
        end = int(fits[-1]) if len(fits) else int(ends[ends > begin][0])
        yield rows.slice(begin, end - begin)
        begin = end


_STRETCHES = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("open", pa.bool_()), ("core", pa.binary()), ("all", pa.binary()), ("bytes", pa.binary())]
)


def _stretches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows in stretches that end at multiples of STRETCH before the anchor, so equal ones are cut alike."""
        digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                out: dict[str, list] = {name: [] for name in _STRETCHES.names}
                for x in batch.slice(row, 512).to_pylist():
                    begin = x["lo"]
                    while begin <= x["hi"]:
                        top = x["at"] - ((x["at"] - begin) // STRETCH * STRETCH)
                        end = min(x["hi"], top)
                        held = x["cut"][begin - x["lo"] : end - x["lo"] + length]
                        # what all windows of the stretch have in common, were it whole: part of any of them
                        core = x["cut"][top - x["lo"] : top - x["lo"] + length - STRETCH + 1]
                        for name, value in zip(_STRETCHES.names, (x["doc_id"], x["key"], begin, x["open"], digest(core), digest(held), held), strict=True):
                            out[name].append(value)
                        begin = end + 1
                yield pa.RecordBatch.from_pydict(out, schema=_STRETCHES)

    return run


_WINDOWS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("open", pa.bool_()), ("digest", pa.binary())])


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                out: dict[str, list] = {name: [] for name in _WINDOWS.names}
                for x in batch.slice(row, 1024).to_pylist():
                    for i in range(len(x["bytes"]) - length + 1):
                        for name, value in zip(_WINDOWS.names, (x["doc_id"], x["key"], x["start"] + i, x["open"], hashlib.blake2b(x["bytes"][i : i + length], digest_size=16).digest()), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_WINDOWS)

    return run


_MATCHED = ("doc_id", "key", "start", "end", "o_doc", "o_key", "o_start")


def _crowded(cut_at: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Matches (_MATCHED) among the cuts of crowded k-grams, and the tables they are read from."""
    cut, stretches = _cut(length), _stretches(length)
    # one function: two in a row would be two Python workers a task
    parts = cut_at.mapInArrow(lambda batches: stretches(cut(batches)), "doc_id long, key long, start long, open boolean, core binary, all binary, bytes binary")
    parts = materialize(parts, "stretches")
    alls = parts.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("one"), F.first("core").alias("core"))
    alls = materialize(alls, "kinds")
    other = [F.col("one.doc_id").alias("o_doc"), F.col("one.key").alias("o_key"), F.col("one.start").alias("o_start")]
    whole = parts.where("open").join(alls.where("n > 1").select("all", *other), "all").withColumn("end", F.col("start") + F.octet_length("bytes")).select(*_MATCHED)
    # one stretch of each kind stands for all, wherever its core is in more than one kind
    mixed = alls.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("core")
    some = alls.join(mixed, "core").select("one.*", (F.col("n") == 1).alias("single"))
    some = parts.join(some, ["doc_id", "key", "start"]).select("doc_id", "key", "start", (F.col("open") & F.col("single")).alias("open"), "bytes")
    dealt = materialize(some.mapInArrow(_windows(length), "doc_id long, key long, start long, open boolean, digest binary"), "windows")
    twice = dealt.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("one")).where("n > 1").select("digest", *other)
    windows = dealt.where("open").join(twice, "digest").withColumn("end", F.col("start") + length).select(*_MATCHED)
    return whole.union(windows), [parts, alls, dealt]


def _runs_of(matched: DataFrame) -> DataFrame:
    """Matches of one (document, other document, shift) that overlap or touch, as one."""
    matched = matched.withColumn("shift", F.col("start") - F.col("o_start"))
    pair = ["doc_id", "key", "o_doc", "o_key", "shift"]
    upto = Window.partitionBy(*pair).orderBy("start", "end")
    reach = F.max("end").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    new = matched.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    new = new.withColumn("run", F.sum("new").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    return new.groupBy(*pair, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _verify(texts: DataFrame, runs: DataFrame) -> None:
    """Every run holds the bytes of the document it was matched with.

    The bytes of the texts that stand for others are shipped to each run but
    that of a text with itself. A text that stands for a hot group is joined,
    not grouped, and lies in a table without buckets, so both sides are
    shuffled and adaptive execution splits its runs.
    """
    asked = runs.where("NOT (doc_id = o_doc AND key = o_key AND shift = 0)")
    names = asked.select(F.col("o_doc").alias("doc_key"), F.col("o_key").alias("key")).distinct()
    held = texts.select("doc_key", "key", "text").join(names, ["doc_key", "key"], "left_semi").dropDuplicates(["doc_key", "key"])
    held = materialize(held.select(F.col("doc_key").alias("o_doc"), F.col("key").alias("o_key"), F.col("text").alias("other")), "others")
    place, size = (F.col("start") - F.col("shift") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")
    said = asked.join(held, ["o_doc", "o_key"]).select(F.col("doc_id").alias("doc_key"), "key", "start", F.substring("other", place, size).alias("bytes"))
    both = said.join(texts.select("doc_key", "key", "text"), ["doc_key", "key"])
    own = F.substring("text", (F.col("start") + 1).cast("int"), F.octet_length("bytes"))
    with measured_broadcasts(texts.sparkSession):
        wrong = both.agg(F.count_if(own != F.col("bytes")).alias("n")).first()["n"]
    discard(held)
    if wrong:
        raise ValueError(f"{wrong} runs hold different bytes under one hash; nothing was removed")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of two longs that are never null, and the text as bytes.

    The first is the doc_id where there is one. The second, a hash of the
    text, tells rows of one doc_id with different texts apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), key).alias("doc_key"), key.alias("key"), text.cast("binary").alias("text"), *_others(docs))


def _others(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text"))]


def _bucketed(rows: DataFrame, by: tuple[str, ...] = ("doc_key", "key")) -> DataFrame:
    """rows as a table bucketed and sorted by its key. Texts are shuffled and sorted once, here; every later join moves only the other side."""
    spark = rows.sparkSession
    # a bucket is one file, so its order is that of the scan
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"plumbline_texts_{uuid.uuid4().hex}"
    dealt = rows.repartition(n, *by)
    dealt.write.bucketBy(n, *by).sortBy(*by).option("path", fresh_path(spark, "texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _parts(texts: DataFrame, kinds: DataFrame, grams: DataFrame) -> DataFrame:
    """The texts that hold a reach of the given k-grams, with the places of its cuts; open ones occur once."""
    parts = kinds.join(grams.select("gram", "kinds"), "gram").select("one.*", "gram", "kinds", (F.col("n") == 1).alias("open"))
    parts = parts.groupBy(F.col("doc_id").alias("doc_key"), "key").agg(F.collect_list(F.struct("at", "lo", "hi", "gram", "open", "kinds")).alias("parts"))
    return texts.select("doc_key", "key", "text").join(parts, ["doc_key", "key"]).select(F.col("doc_key").alias("doc_id"), "key", "text", "parts")


def repeated_ranges(texts: DataFrame, length: int = 400) -> DataFrame:
    """(doc_key, key, ranges): for each document with repeats, [start, end) pairs of bytes, in order of start.

    texts is a bucketed table of ``_keyed`` documents.
    """
    long = texts.where(F.octet_length("text") >= length).select(F.col("doc_key").alias("doc_id"), "key", "text")
    found = materialize(long.mapInArrow(_anchored(length), "doc_id long, key long, at long, lo long, hi long, gram long, reach long"), "anchors")
    # the hash of the k-gram and that of the reach name a reach together
    kinds = found.groupBy("gram", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "at", "lo", "hi")).alias("one"))
    kinds = materialize(kinds, "reaches")
    several = kinds.where("n > 1").select("gram", "reach", F.col("one.doc_id").alias("o_doc"), F.col("one.key").alias("o_key"), F.col("one.lo").alias("o_start"))
    whole = found.select("gram", "reach", "doc_id", "key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")).join(several, ["gram", "reach"])
    matched, used = whole.select(*_MATCHED), [found, kinds]

    mixed = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    limit = large_group(length)
    crowds = materialize(mixed.where(F.col("kinds") > limit), "crowds")
    if not crowds.isEmpty():
        close, tables = _crowded(_parts(texts, kinds, crowds), length)
        matched, used = matched.union(close), [*used, *tables]
    runs = materialize(_runs_of(matched), "runs")
    small = _parts(texts, kinds, mixed.where(F.col("kinds") <= limit))
    small = small.mapInArrow(_cut(length), "doc_id long, key long, at long, lo long, hi long, gram long, open boolean, kinds long, cut binary").repartition("gram").sortWithinPartitions("gram")
    edges = materialize(small.mapInArrow(_sorted_repeats(length), "doc_id long, key long, start long, end long"), "ends")
    discard(*used, crowds)
    _verify(texts, runs)
    ranges = runs.select("doc_id", "key", "start", "end").union(edges).withColumnRenamed("doc_id", "doc_key")
    return ranges.groupBy("doc_key", "key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def _runs(ranges: pa.Scalar) -> np.ndarray:
    """Maximal runs of overlapping or touching ranges, as an array of (start, end)."""
    if not ranges.is_valid:
        return np.zeros((0, 2), np.int64)
    start, end = (ranges.values.field(i).to_numpy() for i in (0, 1))
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return np.stack((start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]), axis=1)


def _kept(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for value, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                view = memoryview(value.as_buffer())
                runs = _runs(ranges)
                kept, begin = [], 0
                for start, end in runs.tolist():
                    kept.append(view[begin:start])
                    begin = end
                kept.append(view[begin:])
                left = "".join(str(k, "utf-8", "ignore") for k in kept) if as_text else b"".join(kept)
                for column, x in zip(columns, (len(view), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), left), strict=True):
                    column.append(x)
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string() if as_text else pa.binary())]
            rest = [c for c in batch.schema.names if c not in ("text", "ranges")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *arrays], [*rest, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, columns of carry, n_bytes, n_removed, n_spans, kept) for every row of docs.

    kept holds the bytes that are left, of the text's UTF-8; as text, without
    the characters of which a cut took a part. A null text is
    empty. Matches never cross documents. Repeated rows of one doc_id are
    documents of their own, so equal texts of ``length`` bytes or more lose
    everything. Columns other than doc_id, text and those carried are not
    read.
    """
    small_batches(docs.sparkSession)
    wanted = {f"_c{i}": c for i, c in enumerate(docs.columns) if c in carry}
    texts = _bucketed(_keyed(docs).select("doc_key", "key", "text", "doc_id", *wanted))
    joined = texts.join(repeated_ranges(texts, length).hint("merge"), ["doc_key", "key"], "left").select("doc_id", *wanted, "text", "ranges")
    kinds = dict(docs.dtypes)
    left = f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    schema = ", ".join(["doc_id long", *(f"{n} {kinds[c]}" for n, c in wanted.items()), left])
    return joined.mapInArrow(_kept(as_text), schema).toDF("doc_id", *wanted.values(), "n_bytes", "n_removed", "n_spans", "kept")
