"""Best-fit packing of documents into bins of a fixed number of tokens.

Documents are cut into pieces of at most ``capacity`` tokens. Full pieces are
bins of their own and never enter the search. The rest are dealt into shards
of about SHARD_PIECES by hash, and each shard is packed by itself, longest
piece first: bins are kept in order of their residual, and the search goes up
from the first that is large enough until a bin without a conflict is found,
the tightest compatible one of the shard. A bin carries bitmaps of the
duplicate clusters and of the sources it holds: two documents of one cluster
never share a bin, and no source has more than ``per_source`` pieces in one.

The number of shards follows the input, a shard's size does not; a hot source
or cluster, and the copies of a repeated row, are spread over all shards.
Shards and bins are numbered from the rows alone, so a recomputed task gives
the same numbers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize

CAPACITY = 2048
PER_SOURCE = 4
SHARD_PIECES = 4_000

_PIECES = "doc_id long, copy long, piece long, first_token long, n_tokens long, shard long, bin long, offset long"


class Bins:
    """Bins ordered by residual, with bitmaps of what they hold."""

    def __init__(self, capacity: int, n: int, clusters: int, sources: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.count = 0
        self.clusters = np.zeros((n, -(-max(1, clusters) // 64)), np.uint64)
        # plane k has a source's bit once the bin holds k + 1 of its pieces
        self.sources = np.zeros((per_source, n, -(-max(1, sources) // 64)), np.uint64)

    def place(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """(bin, offset) of a piece in the tightest compatible bin; cluster -1 conflicts with nothing."""
        sw, sb = source // 64, np.uint64(1 << source % 64)
        cw, cb = cluster // 64, np.uint64(1 << cluster % 64)
        full = self.sources[self.per_source - 1]
        at, step = bisect_left(self.order, (size, -1)), 16
        while at < len(self.order):
            ids = np.array([b for _, b in self.order[at : at + step]])
            clash = (full[ids, sw] & sb) != 0
            if cluster >= 0:
                clash |= (self.clusters[ids, cw] & cb) != 0
            free = int(np.argmin(clash))
            if not clash[free]:
                at += free
                break
            at, step = at + len(ids), step * 2
        if at < len(self.order):
            residual, b = self.order.pop(at)
        else:
            residual, b = self.capacity, self.count
            self.count += 1
        if residual > size:
            insort(self.order, (residual - size, b))
        if cluster >= 0:
            self.clusters[b, cw] |= cb
        for plane in self.sources:
            if not plane[b, sw] & sb:
                plane[b, sw] |= sb
                break
        return b, self.capacity - residual


def _packed(capacity: int, per_source: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "cluster", "source", "copy"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        common = [c for c, n in Counter(rows["cluster"]).items() if n > 1]
        cluster = {c: i for i, c in enumerate(sorted(common))}
        source = {s: i for i, s in enumerate(sorted(set(rows["source"])))}
        bins = Bins(capacity, len(rows), len(cluster), len(source), per_source)
        put = [bins.place(n, cluster.get(c, -1), source[s]) for n, c, s in zip(rows["n_tokens"].tolist(), rows["cluster"], rows["source"], strict=True)]
        rows["bin"], rows["offset"] = [b for b, _ in put], [o for _, o in put]
        return rows[["doc_id", "copy", "piece", "first_token", "n_tokens", "shard", "bin", "offset"]]

    return run


def best_fit(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, copy, piece, first_token, n_tokens, shard, bin, offset): where each piece of each document lies.

    Tokens are words between white space. shard and bin together name a bin;
    negative shards hold the bins of full pieces. A null or blank text has no
    tokens and no piece. Rows without doc_id are packed too. Repeated rows are
    documents of one cluster, told apart by copy, a number from 0. Documents
    are of one cluster if their texts are equal but for case (A-Z) and white
    space, or, with clusters (doc_id, component_id), as near_duplicates()
    gives them, if they have one component_id. A null source is a source of
    its own. Columns other than doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    plain = F.trim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("source"),
        words.alias("tokens"),
        F.xxhash64(plain).alias("cluster"),
    ).where("tokens > 0")
    if clusters is not None:
        known = clusters.where("doc_id IS NOT NULL AND component_id IS NOT NULL").groupBy("doc_id").agg(F.xxhash64(F.min("component_id"), F.lit("component")).alias("component"))
        rows = rows.join(known, "doc_id", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")
    rows = rows.groupBy("doc_id", "source", "tokens", "cluster").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "lengths").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    last = F.col("tokens") % capacity
    tails = rows.where(last > 0).select(
        "doc_id", "copy", "source", "cluster", F.floor(F.col("tokens") / capacity).alias("piece"), (F.col("tokens") - last).alias("first_token"), last.alias("n_tokens")
    )
    dealt = F.xxhash64("doc_id", "copy", "cluster", "source")
    tails = tails.withColumn("shard", F.pmod(dealt, F.lit(max(1, round(tails.count() / SHARD_PIECES)))))
    packed = tails.groupBy("shard").applyInPandas(_packed(capacity, per_source), _PIECES)
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tokens") / capacity) - 1))
    full = rows.where(F.col("tokens") >= capacity).select("doc_id", "copy", "cluster", "source", pieces.alias("piece"))
    shards = max(1, round(full.count() / SHARD_PIECES))
    full = full.withColumn("shard", -1 - F.pmod(F.xxhash64("doc_id", "copy", "cluster", "source", "piece"), F.lit(shards)))
    number = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "piece", "cluster", "source", "copy")) - 1
    full = full.select(
        "doc_id", "copy", "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"), "shard",
        number.cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.union(full)
