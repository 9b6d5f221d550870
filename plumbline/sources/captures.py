"""Capture folders and zip archives as one data source, and the tables of the sensor exports in it."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import binary, sensor_log

#: Stored bytes that one task reads, unless a single file is larger.
TASK_BYTES = 64 << 20
SCHEMA = "capture_id string, path string, kind string, number long, length long, content binary"
# Names of a sensor export's files.
_NAMES = {"odometry.csv": "odometry", "imu.csv": "imu", "camera_matrix.csv": "camera", "rgb.mp4": "video"}
_FOLDERS = {"depth": "depth", "confidence": "confidence"}


@dataclass
class Piece(InputPartition):
    """Files of one capture that a task reads: members of an archive, or files below a folder; (name, stored bytes, length)."""

    capture: str
    archive: str | None
    root: str
    files: list[tuple[str, int, int]]


def kind_of(name: str) -> tuple[str, int | None]:
    """What a file of a capture is, by its folder and name, and its frame number."""
    *folders, last = name.split("/")
    kind = _NAMES.get(last.lower()) or _FOLDERS.get(folders[-1].lower() if folders else "", "other")
    number = re.search(r"(\d+)\.[^.]*$", last) if kind in _FOLDERS.values() else None
    return kind, int(number[1]) if number else None


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path = options["path"].rstrip("/")
        self.kinds = {k.strip() for k in options.get("kinds", "").split(",") if k.strip()}
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.columns = schema.names

    def partitions(self) -> list[Piece]:
        """Names and sizes alone are looked at: a listing, and the directory at the end of each archive."""
        system, root = fs.FileSystem.from_uri(self.path)
        found: dict[tuple[str, str | None], list[tuple[str, int, int]]] = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            below = f.path[len(root) :].lstrip("/")
            if f.type != fs.FileType.File or not binary.safe_member(below, 0) or any(p.startswith(".") for p in below.split("/")):
                continue
            top, _, rest = below.partition("/")
            if f.extension.lower() == "zip" and not rest:
                with system.open_input_file(f.path) as held, zipfile.ZipFile(held) as z:
                    inside = [i for i in z.infolist() if not i.is_dir() and binary.safe_member(i.filename, i.external_attr >> 16)]
                found[top[:-4], f.path] = [(i.filename, i.compress_size, i.file_size) for i in inside]
            elif rest:
                found.setdefault((top, None), []).append((rest, f.size, f.size))
        pieces = []
        for (capture, archive), files in sorted(found.items(), key=str):
            rows, size = [], 0
            for entry in sorted(files):
                if self.kinds and kind_of(entry[0])[0] not in self.kinds:
                    continue
                if rows and size + entry[1] > self.task_bytes:
                    pieces.append(Piece(capture, archive, root, rows))
                    rows, size = [], 0
                rows.append(entry)
                size += entry[1]
            if rows:
                pieces.append(Piece(capture, archive, root, rows))
        return pieces

    def read(self, partition: Piece | None) -> Iterator[tuple]:
        """A row a file; contents are read if the schema asks for them, each once, straight from its place in the archive."""
        if partition is None:  # nothing was planned
            return
        system, root = fs.FileSystem.from_uri(self.path)
        wanted = "content" in self.columns
        held = system.open_input_file(partition.archive) if partition.archive and wanted else None
        archive = zipfile.ZipFile(held) if held else None
        try:
            for name, _, length in partition.files:
                kind, number = kind_of(name)
                row = {"capture_id": partition.capture, "path": name, "kind": kind, "number": number, "length": length}
                if archive:
                    row["content"] = archive.read(name)
                elif wanted:
                    with system.open_input_file(f"{root}/{partition.capture}/{name}") as f:
                        row["content"] = f.read()
                yield tuple(row[c] for c in self.columns)
        finally:
            if archive:
                archive.close()
                held.close()


class CaptureSource(DataSource):
    """``spark.read.format("captures").load(folder)``: a row a file of every capture below a folder.

    A capture is a folder, or a zip archive, in it. Options: kinds (comma
    separated; other files are not planned), taskBytes. A schema without
    ``content`` gives the listing alone. Hidden files, archive junk, links and
    paths that lead outside are left out; a damaged archive stops the job.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader({k.lower(): v for k, v in self.options.items()}, schema)


def capture_files(spark: SparkSession, path: str, kinds: str = "", content: bool = True) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    schema = SCHEMA if content else SCHEMA.replace(", content binary", "")
    return spark.read.format("captures").schema(schema).option("kinds", kinds).load(path)


def open_captures(spark: SparkSession, path: str, stride: int = 1) -> dict[str, DataFrame]:
    """Tables of all sensor exports below a folder: frames (poses with their rasters' presence), imu, camera, orphans, depth, confidence.

    Each reads only the kinds of files that it needs. depth and confidence
    (capture_id, frame, i, j, value) hold every stride-th pixel; where a frame
    has several rasters, a PNG comes first, as in the listing.
    """
    text = lambda kinds: capture_files(spark, path, kinds).select("capture_id", F.decode("content", "utf-8").alias("text"))
    lines = lambda kinds: text(kinds).select("capture_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    listed = capture_files(spark, path, "depth,confidence", content=False).where("number IS NOT NULL")
    of = lambda kind: listed.where(F.col("kind") == kind)
    poses = sensor_log.odometry(lines("odometry"))

    def pixels(kind: str, read, value: str) -> DataFrame:
        files = capture_files(spark, path, kind).where("number IS NOT NULL")
        first = of(kind).groupBy("capture_id", "number").agg(F.min_by("path", F.struct(~F.lower("path").endswith(".png"), "path")).alias("path"))
        files = files.join(first, ["capture_id", "number", "path"], "left_semi")
        key = F.to_json(F.struct("capture_id", "number"))
        got = read(files.select(key.alias("path"), "content"), stride)
        at = F.from_json("path", "capture_id string, number long")
        return got.select(at.alias("_k"), "i", "j", value).select(F.col("_k.capture_id"), F.col("_k.number").alias("frame"), "i", "j", value)

    return {
        "frames": sensor_log.frames(poses, of("depth"), of("confidence")),
        "imu": sensor_log.imu(lines("imu")),
        "camera": sensor_log.camera_matrix(text("camera")),
        "orphans": sensor_log.orphans(poses, of("depth").select("capture_id", "number")),
        "depth": pixels("depth", binary.depth_pixels, "depth"),
        "confidence": pixels("confidence", binary.confidence_pixels, "conf"),
    }
