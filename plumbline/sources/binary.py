"""Binary readers as Arrow-batched maps: PNG rasters, raw arrays, zip members, maker notes, packed masks."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(data: bytes) -> np.ndarray:
    """Samples of a gray PNG of 8 or 16 bits, not interlaced."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if colour or interlaced or bits not in (8, 16):
                raise ValueError("only gray PNGs of 8 or 16 bits")
            shape = height, width, bits // 8
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    height, width, step = shape
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        mode, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if mode == 2:
            line = (line + above) & 255
        elif mode == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step]) & 255
        elif mode in (3, 4):
            for x in range(len(line)):
                left = line[x - step] if x >= step else 0
                if mode == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    near = [abs(above[x] - corner), abs(left - corner), abs(left + above[x] - 2 * corner)]
                    guess = (left, above[x], corner)[near.index(min(near))]
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    return out.reshape(height, width, step)[:, :, 0] if step == 1 else out.view(">u2").astype(np.uint16)


def depth_metres(data: bytes) -> np.ndarray:
    """Depth in metres of a PNG in mm or an array file in mm or m (a largest value under 100 means metres); invalid is 0."""
    if data.startswith(SIGNATURE):
        return png(data).astype(float) / 1000
    raw = np.nan_to_num(np.load(io.BytesIO(data), allow_pickle=False).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
    return np.clip(raw, 0, None) / (1.0 if raw.max(initial=0) < 100 else 1000.0)


def depth_pixels(files: DataFrame, stride: int = 1) -> DataFrame:
    """(path, i, j, depth) of every stride-th pixel of depth files (path, content); a file that cannot be read gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    d = depth_metres(bytes(data))
                except (ValueError, TypeError, zlib.error):
                    continue
                i, j = np.meshgrid(np.arange(0, d.shape[0], stride), np.arange(0, d.shape[1], stride), indexing="ij")
                yield pd.DataFrame({"path": path, "i": i.ravel(), "j": j.ravel(), "depth": d[::stride, ::stride].ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, i int, j int, depth double")


def confidence_pixels(files: DataFrame, stride: int = 1) -> DataFrame:
    """(path, i, j, conf) of confidence PNGs, held in 0..2."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    c = np.clip(png(bytes(data)).astype(int), 0, 2)
                except (ValueError, zlib.error):
                    continue
                i, j = np.meshgrid(np.arange(0, c.shape[0], stride), np.arange(0, c.shape[1], stride), indexing="ij")
                yield pd.DataFrame({"path": path, "i": i.ravel(), "j": j.ravel(), "conf": c[::stride, ::stride].ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, i int, j int, conf int")


def safe_member(name: str, mode: int) -> bool:
    """Whether a zip member may be unpacked: relative, inside, no drive, no NUL, no link, no archive junk."""
    parts = name.replace("\\", "/").split("/")
    odd = name.startswith(("/", "\\")) or ".." in parts or "\0" in name or (len(name) > 1 and name[1] == ":")
    return not (odd or parts[0] == "__MACOSX" or parts[-1].startswith("._") or (mode & 0o170000) == 0o120000)


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, content) of the safe members of zip files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for info in z.infolist():
                        if not info.is_dir() and safe_member(info.filename, info.external_attr >> 16):
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def acceleration(data: bytes) -> list[float] | None:
    """The acceleration vector (tag 8, three rationals) of an Apple maker note, of either byte order."""
    if not data.startswith(b"Apple iOS\0") or len(data) < 16:
        return None
    order = ">" if data[12:14] == b"MM" else "<"
    (count,) = struct.unpack_from(order + "H", data, 14)
    for k in range(count):
        at = 16 + 12 * k
        if at + 12 > len(data):
            return None
        tag, kind, n, where = struct.unpack_from(order + "HHII", data, at)
        if (tag, kind, n) == (8, 10, 3) and where + 24 <= len(data):
            parts = struct.unpack_from(order + "6i", data, where)
            return [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]
    return None


def accelerations(notes: DataFrame) -> DataFrame:
    """(path, g array<double>) of maker notes (path, note)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "g": [acceleration(bytes(x)) if x is not None else None for x in f["note"]]})

    return notes.select("path", "note").mapInPandas(run, "path string, g array<double>")


def pack_mask(mask: np.ndarray) -> bytes:
    return np.packbits(np.asarray(mask, bool).ravel()).tobytes()


def unpack_mask(data: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=height * width).astype(bool).reshape(height, width)


def _mp4_boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        size = size or end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def video_facts(data: bytes) -> dict | None:
    """width, height, rotation, seconds, frames, fps and device of the first picture track of an MP4 or MOV; None without one.

    Only boxes of the header are read. rotation is clockwise, in quarter turns
    of degrees; device is the text of a camera model tag.
    """
    device = None
    tracks: list[dict] = []
    todo = [(0, len(data), None)]
    while todo:
        start, end, own = todo.pop(0)
        for kind, body, stop in _mp4_boxes(data, start, end):
            if kind == b"trak":
                tracks.append({})
                todo.append((body, stop, tracks[-1]))
            elif kind in (b"moov", b"mdia", b"minf", b"stbl", b"udta"):
                todo.append((body, stop, own))
            elif kind == b"\xa9mod":
                (n,) = struct.unpack_from(">H", data, body)
                device = data[body + 4 : body + 4 + n].decode("utf-8", "replace")
            elif own is not None and kind == b"tkhd":
                matrix = struct.unpack_from(">9i", data, body + (52 if data[body] else 40))
                own["width"], own["height"] = (x / 65536 for x in struct.unpack_from(">II", data, body + (88 if data[body] else 76)))
                own["rotation"] = {(0, 1): 90, (-1, 0): 180, (0, -1): 270}.get((matrix[0] >> 16, matrix[1] >> 16), 0)
            elif own is not None and kind == b"mdhd":
                scale, length = struct.unpack_from(">IQ" if data[body] else ">II", data, body + (20 if data[body] else 12))
                own["seconds"] = length / scale if scale else 0.0
            elif own is not None and kind == b"hdlr":
                own["kind"] = data[body + 8 : body + 12]
            elif own is not None and kind == b"stsz":
                (own["frames"],) = struct.unpack_from(">I", data, body + 8)
    found = next((t for t in tracks if t.get("kind") == b"vide"), None)
    if found is None:
        return None
    seconds, frames = found.get("seconds", 0.0), found.get("frames", 0)
    return {k: found.get(k) for k in ("width", "height", "rotation")} | {"seconds": seconds, "frames": frames, "fps": frames / seconds if seconds else None, "device": device}


def probe_videos(files: DataFrame) -> DataFrame:
    """(path, width, height, rotation, seconds, frames, fps, device) of video files (path, content); nulls for a file without a picture track."""
    names = ("width", "height", "rotation", "seconds", "frames", "fps", "device")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [video_facts(bytes(x)) or {} for x in f["content"]]
            yield pd.DataFrame({"path": f["path"], **{n: [t.get(n) for t in told] for n in names}})

    return files.select("path", "content").mapInPandas(run, "path string, width double, height double, rotation int, seconds double, frames long, fps double, device string")
