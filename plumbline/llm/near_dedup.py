"""Near-duplicate documents by a MinHash signature-coordinate inverted join.

Every document's set of word shingles gets a signature of K coordinates. A
(coordinate, value) pair is a token; documents with equal sets share one class
from the start. The join is a T-occurrence search over the tokens' posting
lists:

* skip: a token that only one class has can collide with nothing, and of the
  rest the T-1 most frequent tokens of a class are not posted. Two classes
  with T common tokens still meet in a posted one, as tokens are ordered alike
  everywhere (rarest first), and shared passages stay out of the lists.
* prefix: what is left, at most K-T+1 tokens, is posted.
* count: pairs that met count equal coordinates and go on with T or more.
* the pairs that remain are confirmed on the full sets.

At similarity s >= 0.8 the count of equal coordinates is binomial (48, s):
fewer than 22 occur less than once in 10 million pairs.

A list is not expanded into all its pairs. Each member first meets one pivot
of the list; the links confirmed give components, and only lists that still
hold several components stay open. A class of an open list whose shingles
recur in too few other open classes cannot have a link left and goes (it
would need percent/100 of its set in common with one of them); this removes
documents that share a passage but little else. A second pivot is tried, and
then the members of different components are compared whose profiles (how
many shingles recur, and a bit map of them) still allow a link, each with
those of its own and the next band of set sizes. So no link is lost between
components, and a group of n copies costs about n pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import components

from .shared import discard, materialize
from .textkit import U64, constants, shingle_sets

COORDINATES = 48
MATCHES = 22
#: Words of 64 bits in the map of a profile.
MAP_WORDS = 16
#: Longer lists are compared in blocks of this many members.
SHORT_LIST = 32
BLOCK = 1024
_A = constants(COORDINATES, 11)[:, None]
_B = constants(COORDINATES, 12)[:, None]


def signature(values: np.ndarray) -> np.ndarray:
    """The K coordinates of a non-empty set, as int32."""
    out = np.full(COORDINATES, 0xFFFFFFFF, U64)
    for i in range(0, len(values), 4096):
        x = (values[None, i : i + 4096] ^ _B) * _A
        x = (x ^ (x >> U64(29))) * _B
        np.minimum(out, (x >> U64(32)).min(axis=1), out=out)
    return out.astype(np.uint32).view(np.int32)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), size):
                filled = [s for s in sets if len(s)]
                sigs = np.concatenate([signature(s) for s in filled]) if filled else np.zeros(0, np.int32)
                lengths = [COORDINATES if len(s) else 0 for s in sets]
                offs = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(sets)),
                        batch.column("text_key").slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(offs, pa.array(sigs, pa.int32())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "digest", "sig"],
                )

    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, hash of the text, n_shingles, digest of the set, signature) of whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_signed(size), "doc_id long, text_key long, n_shingles long, digest binary, sig array<int>")


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                left = [s for _, sets in shingle_sets(part.column("ta"), size) for s in sets]
                right = [s for _, sets in shingle_sets(part.column("tb"), size) for s in sets]
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - common
                ok = pa.array((common > 0) & (100 * common >= percent * union))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(ok)

    return run


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column("text"), size):
                ids = np.repeat(np.asarray(batch.column("id").slice(row, len(sets))), [len(s) for s in sets])
                values = np.concatenate(sets) if sets else np.zeros(0, U64)
                for k in range(0, len(values), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(values[k : k + 100_000].view(np.int64))], ["id", "token"])

    return run


class _Links:
    """Confirmed links between classes; ids are the classes' smallest doc_id."""

    def __init__(self, classes: DataFrame, texts: DataFrame, size: int, percent: int):
        self.classes, self.texts, self.size, self.percent = classes, texts, size, percent
        #: Written tables that are of no use once all links are known.
        self.used: list[DataFrame] = []

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that match in T coordinates and then on the full sets."""
        sig = self.classes.select(F.col("id"), "n", "sig")
        met = pairs.join(sig.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        met = met.join(sig.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        met = met.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (equal >= MATCHES))
        met = materialize(met.select("a", "b"), "pairs")
        self.used.append(met)
        full = met.join(self.texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        full = full.join(self.texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return full.select("a", "b", "ta", "tb").mapInArrow(_confirm(self.size, self.percent), "a long, b long")


def _stars(posts: DataFrame, turn: int) -> DataFrame:
    """Each member of a list with the list's pivot: the smallest member, in later turns the smallest by hash."""
    rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    pivots = posts.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "id")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posts.join(pivots.select("token", F.col("p.id").alias("pivot")), "token").where("id <> pivot")
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _open(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """Posts (token, id, comp) of the lists that hold several components."""
    own = posts.select("token", "id").join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
    own = own.select("token", "id", F.coalesce("component", "id").alias("comp"))
    lists = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return own.join(lists.select("token"), "token")


def _profiles(links: _Links, ids: DataFrame) -> DataFrame:
    """(id, n, s, b0 ..): what bounds the intersections of the given classes with each other.

    n is the size of the set and s how many of its shingles another of these
    classes has. The b are a map of those shingles, one bit for each by hash:
    a bit that only one of two classes has stands for a shingle at least that
    the other lacks. Classes that can have no link are left out.
    """
    values = links.texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_members(links.size), "id long, token long")
    values = materialize(values, "shingles")
    links.used.append(values)
    again = values.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    bits = [F.expr(f"bit_or(if(pmod(token, {MAP_WORDS}) = {w}, shiftleft(1L, cast(pmod(shiftright(token, 32), 64) AS int)), 0L))").alias(f"b{w}") for w in range(MAP_WORDS)]
    held = values.join(again, "token").groupBy("id").agg(F.count(F.lit(1)).alias("s"), *bits).join(links.classes.select("id", "n"), "id")
    return materialize(held.where(F.col("s") * 100 >= F.col("n") * links.percent), "profiles")


def _allowed_pairs(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs between two blocks of a list, or within one, that the profiles allow.

        Members of one component are not compared: a run of 128 of them meets
        only the others.
        """
        x, y = (rows[rows["side"] == k].sort_values(["comp", "id"]) for k in (0, 1))
        y = y if len(y) else x
        bits = [f"b{w}" for w in range(MAP_WORDS)]
        held = lambda t: (t[bits].to_numpy(np.int64).view(U64), *(t[c].to_numpy() for c in ("n", "s", "id", "comp", "upper")))
        out = []
        for k in range(0, len(x), 128):
            bx, nx, sx, ix, cx, ux = held(x.iloc[k : k + 128])
            by, ny, sy, iy, cy, uy = held(y[y["comp"] != cx[0]] if cx[0] == cx[-1] else y)
            common = sum(np.bitwise_count(bx[:, None, w] & by[None, :, w]).astype(np.int64) for w in range(MAP_WORDS))
            only_x, only_y = np.bitwise_count(bx).sum(1)[:, None] - common, np.bitwise_count(by).sum(1)[None, :] - common
            most = np.minimum(sx[:, None] - only_x, sy[None, :] - only_y)
            ok = (most * 100 >= (nx[:, None] + ny[None, :] - most) * percent) & (cx[:, None] != cy[None, :]) & ~(ux[:, None] & uy[None, :])
            i, j = np.nonzero(ok)
            out.append(np.stack((np.minimum(ix[i], iy[j]), np.maximum(ix[i], iy[j])), axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return run


def _across(posts: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's members in different components whose profiles allow a link.

    Short lists are joined with themselves. Long ones are cut into bands of
    set sizes, as a link needs sizes in a ratio of percent/100, so in one band
    or the next; a band with the next is dealt into blocks, and tasks take
    pairs of blocks.
    """
    lengths = posts.groupBy("token").agg(F.count(F.lit(1)).alias("length"))
    full = posts.join(profiles, "id").join(lengths, "token")
    short, long = full.where(F.col("length") <= SHORT_LIST).drop("length"), full.where(F.col("length") > SHORT_LIST).drop("length")

    x, y = (short.select("token", *(F.col(c).alias(f"{c}_{k}") for c in short.columns if c != "token")) for k in "xy")
    lacks = lambda p, q: F.expr(" + ".join(f"bit_count(b{w}_{p} & ~b{w}_{q})" for w in range(MAP_WORDS)))
    most = F.least(F.col("s_x") - lacks("x", "y"), F.col("s_y") - lacks("y", "x"))
    allowed = most * 100 >= (F.col("n_x") + F.col("n_y") - most) * percent
    near = x.join(y, "token").where(F.expr("id_x < id_y AND comp_x <> comp_y") & allowed).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))

    # a little wider than the ratio, so rounding never puts a link's ends two bands apart
    width = math.log(100 / percent) * 1.001 + 1e-6
    long = long.withColumn("own", F.floor(F.log("n") / width))
    long = long.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("upper", F.col("own") > F.col("band")).drop("own")
    sizes = long.groupBy("token", "band").agg(F.count(F.lit(1)).alias("held"), F.min("upper").alias("none")).where("NOT none AND held > 1")
    long = long.join(sizes.select("token", "band", F.ceil(F.col("held") / BLOCK).alias("blocks")), ["token", "band"])
    long = long.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    long = long.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")})
    far = long.drop("blocks", "block", "other").groupBy("token", "band", "lo", "hi").applyInPandas(_allowed_pairs(percent), "a long, b long")
    return near.union(far).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Links join documents whose sets of ``size``-word shingles have a Jaccard
    similarity of at least ``percent``/100; component_id is the smallest
    doc_id reachable. A text of fewer words is one shingle; a null, empty or
    blank text has no shingle, no link, and is kept. A row without doc_id is
    kept, with no component_id. Rows of one doc_id are one document, with the
    links of all its texts: texts that share a document are in one component,
    and a document's rows are all kept or all dropped. Repeated rows change
    nothing and are each returned. Texts of any length are read whole. Other
    columns are not read.
    """
    signed = materialize(signatures(docs, size), "signatures")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(
        named.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.max("n_shingles").alias("n"), F.min("sig").alias("sig"))
        .select("digest", F.col("one.doc_id").alias("id"), "one.text_key", "n", "sig"),
        "classes",
    )
    member = signed.join(classes.select("digest", F.col("id").alias("class_id")), "digest", "left")
    member = materialize(member.select("doc_id", "n_shingles", "class_id"), "members")
    # the texts of one document are linked through it
    first = member.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("last")).where("a < last")
    own = member.join(first.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")).where("a < b").distinct()

    tokens = classes.select("id", F.posexplode("sig").alias("i", "v")).select("id", F.expr("(i * 4294967296L) + (v & 4294967295L)").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared_tokens = tokens.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts")).where(F.size("ts") >= MATCHES)
    posts = shared_tokens.select("id", F.explode(F.slice("ts", F.lit(1), F.size("ts") - (MATCHES - 1))).alias("t")).select("id", F.col("t.token").alias("token"))
    posts = materialize(posts, "posts")

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    wanted = classes.join(posts.select("id").distinct(), "id", "left_semi").select("id", "text_key")
    texts = materialize(texts.join(wanted, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("id", "text"), "texts")
    links = _Links(classes, texts, size, percent)

    edges = materialize(links.confirm(_stars(posts, 0)).union(own), "links")
    open_posts = materialize(_open(posts, materialize(components(edges), "components")), "open")
    if not open_posts.isEmpty():
        profiles = _profiles(links, open_posts.select("id").distinct())
        open_posts = open_posts.join(profiles.select("id"), "id")
        edges = materialize(edges.union(links.confirm(_stars(open_posts, 1))), "links")
        open_posts = _open(open_posts, materialize(components(edges), "components"))
        edges = materialize(edges.union(links.confirm(_across(open_posts, profiles, percent))), "links")
    comps = materialize(components(edges), "components")
    discard(signed, classes, posts, texts, edges, *links.used)

    # planned by the caller, who may go by the size of the files
    member = member.join(comps.select(F.col("node").alias("class_id"), "component").hint("merge"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return member.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
