"""Set-similarity join by parity sketches.

A document's shingles are hashed to the bits of a sketch, and each shingle
flips its bit. Two sketches differ in no more bits than the sets differ in
shingles, so the Hamming distance bounds the symmetric difference from below.
At a similarity of p/100 or more, sets of a and b shingles differ in at most
(100 - p)(a + b) / (100 + p).

* bands: sets are dealt into bands of sizes; in a band at most D shingles may
  differ, and a set that could link with the band below is sketched for it too.
* pigeonhole: a band's sketch has D + 1 + E segments, so two linked sets agree
  in E + 1 at least. A segment is 2^64 bits wide and hardly ever holds two
  shingles in one bit; it is kept as the XOR of what it holds, which is equal
  where the segments are. Of a set with z empty segments, E + 1 - z that hold
  something agree with any set linked to it. So a set that shares fewer of its
  segments with others has no link, and the E - z most frequent that it shares
  are not posted: the rarest segment that a pair shares is posted by both, as
  E - z at least of either set's are more frequent. Sets with more than E empty
  segments leave none out, and are posted under one list of their own besides.
* bound: sets that meet in a list are compared on a short sketch, the wide one
  folded to twice the set's size in bits; of two lengths the longer is folded
  once more. Pairs beyond the bound go.
* verify: what is left is compared on the full sets.

Equal sets are one class from the start, and lists are joined as near_dedup
joins its own: by pivots first, then among members that no link connects yet.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import components

from .near_dedup import _across, _confirm, _Links, _open, _profiles, _stars
from .shared import discard, materialize, small_batches
from .suffix_dedup import _bucketed
from .textkit import U64, constants, mix, shingle_sets

#: A band reaches from its least size up to this many times it.
GROWTH = 1.4
#: Spare segments E of a band: so many, and this share of D.
SPARE, SPARE_SHARE = 2, 0.1


def most_apart(a: int, b: int, percent: int) -> int:
    """Shingles in which sets of sizes a and b may differ at most and still be linked."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.cache
def band(k: int) -> tuple[int, int]:
    """The least size of band k, and of the band above."""
    low = 1 if k == 0 else band(k - 1)[1]
    return low, max(low + 1, int(low * GROWTH))


def sketched_bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, D, segments) of every band that a set of n shingles has a sketch for; a band where no shingle may differ needs none."""
    out, k = [], 0
    while band(k)[0] <= n:
        top = band(k)[1] - 1  # of the smaller set; the larger one may lie above the band
        if n <= top * 100 // percent and (apart := most_apart(top, top * 100 // percent, percent)):
            out.append((k, apart, apart + 1 + SPARE + int(SPARE_SHARE * apart)))
        k += 1
    return out


_BAND = constants(512, 31)
_SEGMENT = constants(1 << 16, 32)


@functools.cache
def _edges(segments: int) -> np.ndarray:
    """The least hash of each segment but the first: segments share the hashes evenly."""
    return np.array([(j << 64) // segments for j in range(1, segments)], U64)


def posted(values: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, need, keys) of a set in each of its bands; values are its sorted hashes. Any set linked to it in a band has ``need`` of its keys at least."""
    out = []
    shown = mix(values)
    for k, apart, segments in sketched_bands(len(values), percent):
        bounds = np.concatenate(([0], np.searchsorted(values, _edges(segments)), [len(values)]))
        filled = np.flatnonzero(bounds[:-1] < bounds[1:])
        parity = np.bitwise_xor.reduceat(shown, bounds[filled])
        keys = mix(parity + _SEGMENT[filled & 0xFFFF] * (filled.astype(U64) + U64(1)) + _BAND[k % 512])
        need = len(filled) - apart  # of the segments, all but D agree
        if need < 1:
            need, keys = 1, np.concatenate((keys, mix(_BAND[k % 512 : k % 512 + 1])))
        out.append((k, need, keys))
    return out


def folded(values: np.ndarray) -> np.ndarray:
    """The parity sketch of twice as many bits as shingles, 64 at least and a power of two, as words of 64 bits."""
    bits = 1 << max(6, (2 * len(values) - 1).bit_length())
    odd = np.bincount((mix(values) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), size):
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                own = [batch.column(c).slice(row, len(sets)) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "text_key", "n_shingles", "digest"])

    return run


def _posted(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), size):
                own = batch.column("id").slice(row, len(sets))
                posts = [[own.take(pa.array([i])), k, need, keys] for i, s in enumerate(sets) for k, need, keys in posted(s, percent)]
                if posts:
                    ids, bands, needs, keys = zip(*posts, strict=True)
                    columns = [pa.concat_arrays(ids), pa.array(bands, pa.int32()), pa.array(needs, pa.int32()), _lists(list(keys))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "band", "need", "tokens"])

    return run


def _folded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), size):
                columns = [batch.column("id").slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), _lists([folded(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "bits"])

    return run


def _distance() -> Column:
    """Hamming distance of the sketches sa and sb, the longer one folded to the length of the other."""
    short = F.least(F.size("sa"), F.size("sb"))
    fold = lambda c: F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold("sa"), fold("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class _Sketched(_Links):
    """Links between classes of equal sets; pairs are held to the bound on their sketches before texts are read."""

    def confirm(self, pairs: DataFrame) -> DataFrame:
        own = lambda c: self.classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))
        met = pairs.join(own("b"), "b").where("b > a").join(own("a"), "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        met = materialize(met.where(_distance() * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent)).select("a", "b"), "pairs")
        self.used.append(met)
        full = met.join(self.texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        full = full.join(self.texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return full.select("a", "b", "ta", "tb").mapInArrow(_confirm(self.size, self.percent), "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two documents link when the Jaccard similarity of their sets of
    ``size``-word shingles is ``percent``/100 at least (75 or more is
    supported); component_id is the smallest doc_id reachable by links, itself
    included. Every link that the components need is found and confirmed on
    the full sets; none is estimated. Links within a component that other
    links imply already are not looked for, so copies are never expanded into
    pairs.

    Words are runs of anything but white space, A-Z lower-cased. A text of
    fewer words than ``size`` is one shingle; a null, empty or blank text has
    none and links with nothing. A row without doc_id has no component_id.
    Rows of one doc_id are one document with the links of all its texts.
    Repeated rows are each returned. Texts of any length are read whole; other
    columns are not read; an empty table gives no rows.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent from 75 to 100")
    small_batches(docs.sparkSession)
    doc, key, text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string").alias("text")
    # texts move once, here: every later step reads them where they lie, and makes again what it needs of their sets
    rows = _bucketed(docs.select(F.coalesce(doc, key).alias("id"), doc.alias("doc_id"), key.alias("text_key"), text), ("id",))
    kept = materialize(rows.select("doc_id", "text_key", "text").mapInArrow(_counted(size), "doc_id long, text_key long, n_shingles long, digest binary"), "sizes")
    named = kept.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("digest", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("text_key"))
    first = materialize(first, "classes")
    member = kept.select("doc_id", "n_shingles", "digest").join(first.select("digest", F.col("id").alias("class_id")), "digest", "left")
    member = materialize(member.select("doc_id", "n_shingles", "class_id"), "members")
    # the texts of one document are linked through it
    several = member.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("last")).where("a < last")
    own = member.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")).where("a < b").distinct()

    # a class has the text of its first row; rows that repeat it are the same
    def texts_of(wanted: DataFrame) -> DataFrame:
        one = wanted.groupBy("id").agg(F.collect_set("text_key").alias("keys"))
        own = rows.where("doc_id IS NOT NULL").join(one.hint("merge"), "id").where(F.array_contains("keys", F.col("text_key")))
        return own.dropDuplicates(["id", "text_key"]).select("id", "text")

    sketched = texts_of(first).mapInArrow(_posted(size, percent), "id long, band int, need int, tokens array<long>")
    # one exchange serves both the count of a list and its members
    dealt = sketched.select("id", "band", "need", F.explode("tokens").alias("token")).repartition("token")
    lists = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("token", "df")
    shared = dealt.join(lists, "token").groupBy("id", "band").agg(F.max("need").alias("need"), F.sort_array(F.collect_set(F.struct("df", "token"))).alias("ts")).where(F.size("ts") >= F.col("need"))
    posts = shared.select("id", F.explode(F.slice("ts", F.lit(1), F.size("ts") - F.col("need") + 1)).alias("t")).select("id", F.col("t.token").alias("token"))
    posts = materialize(posts, "posts")
    met = posts.select("id").distinct()
    texts = texts_of(first.join(met, "id", "left_semi"))
    classes = materialize(texts.mapInArrow(_folded(size), "id long, n long, bits array<long>").dropDuplicates(["id"]), "classes")
    links = _Sketched(classes, texts, size, percent)

    edges = materialize(links.confirm(_stars(posts, 0)).union(own), "links")
    open_posts = materialize(_open(posts, materialize(components(edges), "components")), "open")
    if not open_posts.isEmpty():
        profiles = _profiles(links, open_posts.select("id").distinct())
        open_posts = open_posts.join(profiles.select("id"), "id")
        edges = materialize(edges.union(links.confirm(_stars(open_posts, 1))), "links")
        open_posts = _open(open_posts, materialize(components(edges), "components"))
        edges = materialize(edges.union(links.confirm(_across(open_posts, profiles, percent))), "links")
    comps = materialize(components(edges), "components")
    discard(kept, first, classes, posts, rows, edges, *links.used)

    member = member.join(comps.select(F.col("node").alias("class_id"), "component").hint("merge"), "class_id", "left")
    return member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))
