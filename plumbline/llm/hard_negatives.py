"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Anchors and candidate rows are dealt into blocks, and a task takes one block
of each. There every dimension is a list of the candidates sorted by it. An
anchor reads all its lists at once, each from the end that the sign of its
component asks for, in strides; what it meets is scored in full by random
access. A row not met yet scores at most the threshold, the score of the
values last read. An anchor stops once its threshold is strictly below the
k-th score found in each of its windows (a row of equal score and smaller id
could still be unseen), or below the window's lower end. A block whose first
threshold is below all windows is never read.

Positives are one search (same label, one window without ends); each positive
then opens a window of scores for the negatives, the second search. Blocks
return k rows a window at most, and these are ranked once more over all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Candidates and anchors of a task, and the anchors that are searched at a time.
ROWS, ANCHORS, TOGETHER = 8192, 1024, 256
#: The first stride is this share of a list; each next one doubles what has been read.
FIRST = 16
_NONE = np.iinfo(np.int64).min


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    lists = column.cast(pa.large_list(pa.int64())).combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _width(column: pa.ChunkedArray) -> int:
    return max((int(np.diff(np.asarray(c.offsets)).max()) for c in column.chunks if len(c)), default=0)


class Lists:
    """Candidates of a block in order of id, and their sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(ids))[:, None], axis=0)


def _first(scores: np.ndarray, ok: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores (anchor, window, k) of the best allowed candidates in each window, and -1 where there are none left."""
    m, w = high.shape
    least = low.min(axis=1)
    if (least == _NONE).any() and scores.shape[1] > k:  # no lower end: the k-th score, ties with it included
        kth = np.partition(np.where(ok, scores, _NONE), scores.shape[1] - k, axis=1)[:, -k]
        least = np.where(least == _NONE, kth, least)
    i, j = np.nonzero(ok & (scores >= least[:, None]) & (scores <= high.max(axis=1)[:, None]))
    s = scores[i, j]
    order = np.lexsort((j, -s, i))  # ids ascend with j
    i, j, s = i[order], j[order], s[order]
    at, best = np.full((m, w, k), -1), np.full((m, w, k), _NONE)
    for c in range(w):
        held = (s <= high[i, c]) & (s >= low[i, c])
        ii, jj, ss = i[held], j[held], s[held]
        rank = np.arange(len(ii)) - np.searchsorted(ii, ii)
        top = rank < k
        at[ii[top], c, rank[top]], best[ii[top], c, rank[top]] = jj[top], ss[top]
    return at, best


def threshold_search(anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, lists: Lists, high: np.ndarray, low: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every anchor and window of scores [low, high] the first k rows of its own label, or of the other labels."""
    n, (m, w) = len(lists.ids), high.shape
    at, best = np.full((m, w, k), -1), np.full((m, w, k), _NONE)
    largest = int(np.abs(anchors).max(initial=0)) * int(np.abs(lists.vectors).max(initial=0)) * anchors.shape[1]
    # floats are exact for whole numbers of this size; larger ones go as Python's integers
    kind = np.float64 if largest < 1 << 52 else object
    if largest >= 1 << 62:
        raise OverflowError("inner products do not fit in a long")
    a, x, values = anchors.astype(kind), lists.vectors.astype(kind), lists.values.astype(kind)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    threshold = lambda rows, top, low_end: (up[rows] @ values[top] + down[rows] @ values[low_end]).astype(np.int64)
    active = np.flatnonzero((high > _NONE).any(axis=1))
    active = active[threshold(active, n - 1, 0) >= low[active].min(axis=1)] if n else active[:0]
    scores, known, read = np.full((m, n), _NONE), np.zeros(n, bool), 0
    while len(active):
        read = min(n, max(2 * read, -(-n // FIRST)))
        met = np.ones((len(active), n), bool)
        if read < n:
            tops, ends = (lists.place >= n - read).astype(np.float32).T, (lists.place < read).astype(np.float32).T
            met = (anchors[active] > 0).astype(np.float32) @ tops + (anchors[active] < 0).astype(np.float32) @ ends > 0
        new = met.any(axis=0) & ~known
        scores[:, new] = (a @ x[new].T).astype(np.int64)
        known |= new
        ok = met & ((anchor_labels[active, None] == lists.labels[None, :]) == same) & (anchor_ids[active, None] != lists.ids[None, :])
        at[active], best[active] = _first(scores[active], ok, high[active], low[active], k)
        enough = np.maximum(best[active][:, :, -1], low[active])
        # a window that is closed asks for nothing
        done = ((threshold(active, n - read, read - 1)[:, None] < enough) | (high[active] == _NONE)).all(axis=1)
        active = active[~done] if read < n else active[:0]
    return at, best


def _search(k: int, windows: int, low_percent: int, same: bool):
    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        width = max(_width(rows["v"]), _width(held["v"]))
        ids, keys = (rows[c].to_numpy() for c in ("vec_id", "key"))
        order = np.lexsort((keys, ids))
        rows = rows.take(pa.array(order))
        ids, keys, labels, vectors = rows["vec_id"].to_numpy(), rows["key"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], width)
        again = (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (labels[1:] == labels[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
        keep = np.concatenate(([True], ~again))[: len(ids)]
        lists = Lists(ids[keep], labels[keep], vectors[keep])
        keys = keys[keep]
        own = {c: held[c].to_numpy() for c in ("vec_id", "key", "label")}
        a, parts = _matrix(held["v"], width), []
        high, low = np.full((len(a), windows), _NONE), np.full((len(a), windows), _NONE)
        if same:
            high[:] = np.iinfo(np.int64).max
        else:
            scores = held["scores"].to_pylist()
            for r, known in enumerate(scores):
                for c, p in enumerate(known):
                    if p >= 0:  # below zero, 80 % of a score lies above it
                        high[r, c], low[r, c] = p, -(-low_percent * p // 100)
            low[high == _NONE] = np.iinfo(np.int64).max
        for b in range(0, len(a), TOGETHER):
            e = slice(b, b + TOGETHER)
            at, best = threshold_search(a[e], own["vec_id"][e], own["label"][e], lists, high[e], low[e], k, same)
            r, c, q = np.nonzero(at >= 0)
            found = at[r, c, q]
            parts.append((own["vec_id"][e][r], own["key"][e][r], c, lists.ids[found], keys[found], best[r, c, q]))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["anchor_id", "anchor_key", "window", "id", "id_key", "score"])

    return run


def _blocks(rows: DataFrame, anchors: DataFrame, parts: list[str], chunks: Column, blocks: Column, search) -> DataFrame:
    """Each block of anchors with each block of rows of the same part. Rows that repeat an id share a block."""
    rows = rows.withColumns({"chunk": F.pmod(F.xxhash64("vec_id"), chunks), "block": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    anchors = anchors.withColumns({"block": F.pmod(F.xxhash64("vec_id", F.lit(1)), blocks), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # columns of their own beside those of rows
    by = [*parts, "block", "chunk"]
    return rows.groupBy(*by).cogroup(anchors.groupBy(*by)).applyInArrow(search, "anchor_id long, anchor_key long, window long, id long, id_key long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("score"), "id", "id_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, embedding and label, ``anchors`` the vec_id of the
    query rows. Components x count as floor(256 x), scores are inner products,
    higher ones first, ties by smaller vec_id. An anchor's positives are its
    first other rows of the same label; a positive's negatives are the first
    rows of other labels that score ``low`` percent of it at least and no more
    than it. Fewer are returned where there are no more; a positive with a
    score below zero has none.

    Rows with a null vec_id, label or vector, or a null or non-finite
    component, take no part. Shorter vectors count as filled up with zeros.
    Rows that repeat an id, label and vector count once; rows that share an id
    but differ are rows of their own, and none of them is another's partner.
    Empty tables give no rows; other columns are not read. A component of 2^30
    or more after scaling stops the job, so no score can overflow unseen.
    """
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    large = F.exists("v", lambda x: F.abs(x) >= 1 << 30)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    kept = kept.withColumn("v", F.when(large, F.raise_error(F.lit("component too large"))).otherwise(F.col("v")))
    kept = materialize(kept.withColumn("key", F.xxhash64("label", "v")), "vectors")
    asked = anchors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    asked = materialize(kept.join(asked, "vec_id", "left_semi").dropDuplicates(["vec_id", "key"]), "asked")

    sizes = kept.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("chunks"))
    sizes = asked.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("blocks")).join(sizes, "label")
    found = _blocks(kept.join(sizes, "label"), asked.join(sizes, "label"), ["label"], F.col("chunks"), F.col("blocks"), _search(positives, 1, 0, True))
    first = _ranked(found, positives).groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    first = first.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), F.transform("p", lambda p: p["score"]).alias("scores"), F.transform("p", lambda p: p["id"]).alias("ids"))
    known = materialize(asked.join(first, ["vec_id", "key"]).where(F.exists("scores", lambda p: p >= 0)), "anchors")

    chunks, blocks = (F.lit(max(1, math.ceil(n / size))).cast("long") for n, size in ((kept.count(), ROWS), (known.count(), ANCHORS)))
    found = _ranked(_blocks(kept, known, [], chunks, blocks, _search(negatives, positives, low, False)), negatives)
    found = found.join(known.select(F.col("vec_id").alias("anchor_id"), F.col("key").alias("anchor_key"), "scores", "ids"), ["anchor_id", "anchor_key"])
    at = lambda c: F.get(c, F.col("window").cast("int"))
    return found.select("anchor_id", at("ids").alias("positive_id"), "rank", F.col("id").alias("negative_id"), at("scores").alias("positive_score"), F.col("score").alias("negative_score"))
