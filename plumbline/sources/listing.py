"""Capture listings: which tier a folder is, its rooms, photos without doubles, numbered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import natural_key

# File kinds, and which of several formats of a photo is kept.
IMAGES = ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "webp")
VIDEOS = ("mp4", "mov", "m4v")
SIDECARS = ("aae", "json", "xmp", "csv", "txt")
RANK = {"heic": 0, "heif": 1, "jpg": 2, "jpeg": 3, "png": 4, "tif": 5, "tiff": 6, "webp": 7}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, parent, name, stem, ext, length, mtime) of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    return described(found)


def described(found: DataFrame) -> DataFrame:
    """The columns that a listing's path gives; hidden and archive-junk files go."""
    parts = F.regexp_extract("path", r"^(.*)/([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    d = found.withColumns({"parent": parts[0], "name": parts[1]})
    d = d.where(~F.col("name").startswith(".") & ~F.col("path").contains("__MACOSX"))
    return d.withColumns({"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))})


def kind(ext: Column) -> Column:
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video").when(ext.isin(*SIDECARS), "sidecar").otherwise("other")


def companions(listing: DataFrame) -> DataFrame:
    """Videos that are the moving part of a photo: the same stem, whatever its case, in the same folder."""
    photos = listing.where(kind(F.col("ext")) == "image").select("parent", F.lower("stem").alias("s")).distinct()
    return listing.where(kind(F.col("ext")) == "video").withColumn("s", F.lower("stem")).join(photos, ["parent", "s"], "left_semi").drop("s")


def distinct_photos(listing: DataFrame) -> DataFrame:
    """One photo a stem and folder, the best format; edits (IMG_E####) go where the original is."""
    photos = listing.where(kind(F.col("ext")) == "image")
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col("ext")), F.lit(99))
    first = Window.partitionBy("parent", F.lower("stem")).orderBy(rank, natural_key(F.col("name")), "name")
    best = photos.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    original = F.regexp_replace(F.upper("stem"), r"^IMG_E(\d+)$", "IMG_$1")
    edited = best.where(F.upper("stem").rlike(r"^IMG_E\d+$")).withColumn("_o", original)
    gone = edited.join(best.select("parent", F.upper("stem").alias("_o")), ["parent", "_o"], "left_semi").select("path")
    return best.join(gone, "path", "left_anti")


def room_folders(photos: DataFrame, root: str, loose_room: str | None = None) -> DataFrame:
    """photos with room and room_ord: one room a folder below the root, in natural order.

    Photos beside the room folders are left out, or are one more room with
    the given name. Without any folder the root itself is the room.
    """
    below = F.regexp_extract(F.substring(F.col("path"), len(root.rstrip("/")) + 2, 10_000), r"^([^/]+)/", 1)
    p = photos.withColumn("room", F.when(below != "", below))
    has = p.agg(F.bool_or(F.col("room").isNotNull()).alias("has"))
    p = p.join(F.broadcast(has)).withColumn("room", F.when(F.col("has"), F.coalesce("room", F.lit(loose_room))).otherwise(F.lit(root.rstrip("/").rpartition("/")[2])))
    return p.where("room IS NOT NULL").drop("has").withColumn("room_ord", F.dense_rank().over(Window.orderBy(natural_key(F.col("room")), "room")))


def numbered(listing: DataFrame, prefer: str = "png") -> DataFrame:
    """(parent, number, path): files by the number in their name, the preferred format where there are several."""
    n = listing.withColumn("number", F.regexp_extract("stem", r"(\d+)$", 1).try_cast("long")).where("number IS NOT NULL")
    return n.groupBy("parent", "number").agg(F.min_by("path", F.struct(F.col("ext") != prefer, F.col("path"))).alias("path"))


def detect(listing: DataFrame, by: str = "parent") -> DataFrame:
    """(by, tier, n_images, n_videos, n_depth): a sensor export, else a single video, else photos, else the longest video."""
    k = kind(F.col("ext"))
    depth = F.col("path").rlike("/depth/[^/]+$")
    count = lambda c: F.count_if(c)
    g = listing.groupBy(by).agg(
        count((k == "image") & ~depth).alias("n_images"), count(k == "video").alias("n_videos"), count(depth).alias("n_depth"), F.bool_or(F.col("name") == "odometry.csv").alias("has_odometry"),
        F.max_by(F.when(k == "video", F.col("path")), F.when(k == "video", F.struct("length", "path"))).alias("longest_video"),
    )
    tier = F.when(F.col("has_odometry") & (F.col("n_depth") > 0), "lidar").when(F.col("n_videos") == 1, "video").when(F.col("n_images") > 0, "photo").when(F.col("n_videos") > 1, "video")
    return g.withColumn("tier", tier)


def content_keys(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of file contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))
