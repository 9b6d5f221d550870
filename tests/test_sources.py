import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from plumbline.sources import binary, documents, listing, sensor_log


def png(a: np.ndarray, modes) -> bytes:
    step = a.dtype.itemsize
    raw = a.astype(a.dtype.newbyteorder(">")).tobytes()
    width = a.shape[1] * step
    rows = [np.frombuffer(raw[y * width : (y + 1) * width], np.uint8).astype(int) for y in range(a.shape[0])]
    out = b""
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else np.zeros(width, int)
        left = np.concatenate((np.zeros(step, int), row[:-step]))
        corner = np.concatenate((np.zeros(step, int), above[:-step]))
        p = left + above - corner
        near = np.stack((abs(p - left), abs(p - above), abs(p - corner)))
        paeth = np.choose(near.argmin(0), (left, above, corner))
        guess = (np.zeros(width, int), left, above, (left + above) // 2, paeth)[modes[y % len(modes)]]
        out += bytes([modes[y % len(modes)]]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    box = lambda k, b: struct.pack(">I4s", len(b), k) + b + struct.pack(">I", zlib.crc32(k + b))
    return binary.SIGNATURE + box(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * step, 0, 0, 0, 0)) + box(b"IDAT", zlib.compress(out)) + box(b"IEND", b"")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(kind):
    a = np.random.default_rng(0).integers(0, np.iinfo(kind).max, (11, 7)).astype(kind)
    assert (binary.png(png(a, (0, 1, 2, 3, 4))) == a).all()


def test_depth_units():
    buffer = io.BytesIO()
    np.save(buffer, np.array([[1.5, np.nan], [-1, 4.0]]))
    assert binary.depth_metres(buffer.getvalue()).tolist() == [[1.5, 0], [0, 4]]
    assert binary.depth_metres(png(np.array([[1500, 0]], np.uint16), (0,))).tolist() == [[1.5, 0]]


def test_zip_members(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("a/b.txt", "../evil", "/abs", "__MACOSX/x", "a/._b.txt", "C:x"):
            z.writestr(name, b"1")
    df = spark.createDataFrame([("z", buffer.getvalue())], "path string, content binary")
    assert [r.member for r in binary.zip_members(df).collect()] == ["a/b.txt"]


def test_odometry(spark):
    head = "timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy"
    lines = ["﻿" + head + "\r", "0.2,2,1,0,0,0,0,0,1,,,,", "0.1,1,0,0,0,0,0,0,1,,,,", "0.3,2,9,9,9,0,0,0,1", "0.5,5,1,1,1,0,0,0,1,100,100,50,50", "x,3,0,0,0,0,0,0,1", "0.6,6,0,0,0,0,0,0,9"]
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate(lines)], "capture_id string, line_no int, line string")
    got = sensor_log.odometry(df).orderBy("frame").collect()
    assert [(r.frame, r.x, r.fx, r.gap, r.late) for r in got] == [(1, 0, 100, 0, False), (2, 1, 100, 0, False), (5, 1, 100, 2, False)]
    bare = spark.createDataFrame([("c", 0, "0.1,1,0,0,0,0,0,0,1,,,,")], "capture_id string, line_no int, line string")
    assert sensor_log.odometry(bare).count() == 1


def test_imu_units(spark):
    df = spark.createDataFrame([("a", "0,0,0,1,0,0,0"), ("a", "1,0,0,1,0,0,0"), ("b", "0,0,9.8,0,0,0,0")], "capture_id string, line string")
    got = {r.capture_id: (r.unit, r.az + r.ay) for r in sensor_log.imu(df).collect()}
    assert got["a"] == ("g", pytest.approx(9.80665)) and got["b"][0] == "m/s2"


def test_photos(spark):
    paths = ["/c/Bath/IMG_1.HEIC", "/c/Bath/IMG_1.jpg", "/c/Bath/IMG_E1.jpg", "/c/Bath/img_1.MOV", "/c/Hall 10/a.jpg", "/c/Hall 2/b.jpg", "/c/loose.jpg", "/c/Bath/.hidden.jpg"]
    d = listing.described(spark.createDataFrame([(p, 1) for p in paths], "path string, length long"))
    assert sorted(r.name for r in listing.distinct_photos(d).collect()) == ["IMG_1.HEIC", "a.jpg", "b.jpg", "loose.jpg"]
    assert [r.name for r in listing.companions(d).collect()] == ["img_1.MOV"]
    rooms = listing.room_folders(listing.distinct_photos(d), "/c").orderBy("room_ord").collect()
    assert [r.room for r in rooms] == ["Bath", "Hall 2", "Hall 10"]


def test_ground_truth(spark):
    text = """
rooms:
  - {id: R1, label: Kitchen, ceiling_height: ["2,5", 2.6, 0], walls: [4, {id: W9, length: x}], openings: [{id: O1, type: door, wall: W1, width: 0.8, leads_to: R2}]}
  - {id: R2}
  - {id: R2}
adjacency: [[R2, R1], [R1, R9]]
captures: [{id: c1, tier: lidar}]
"""
    t = documents.ground_truth(spark, {"p": text})
    assert [(r.room_id, r.ceiling_height) for r in t["rooms"].collect()] == [("R1", pytest.approx(2.55)), ("R2", None), ("R2~2", None)]
    assert [(r.wall_id, r.length) for r in t["walls"].collect()] == [("W1", 4.0), ("W9", None)]
    assert [(r.room_a, r.room_b) for r in t["adjacency"].collect()] == [("R1", "R2")]


def test_app_export(spark):
    got = documents.app_export(spark, "Export of a plan\nRoom name;Width (cm);Height\nHall;120;2,5 m\nBath;x;8' 2\"\n").collect()
    assert [(r.room, r.dimension, round(r.metres, 4)) for r in got] == [("Hall", "Width (cm)", 1.2), ("Hall", "Height", 2.5), ("Bath", "Height", 2.4892)]


def test_video_facts(spark):
    import struct

    from plumbline.sources.binary import probe_videos, video_facts

    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    words = lambda *x: struct.pack(f">{len(x)}I", *x)
    turn = struct.pack(">9i", 0, 1 << 16, 0, -1 << 16, 0, 0, 0, 0, 1 << 30)
    tkhd = box(b"tkhd", words(0, 0, 0, 1, 0, 0, 0, 0, 0, 0) + turn + words(1920 << 16, 1080 << 16))
    media = lambda kind, frames: box(b"mdia", box(b"mdhd", words(0, 0, 0, 600, 1200, 0)) + box(b"hdlr", words(0, 0) + kind + bytes(12)) + box(b"minf", box(b"stbl", box(b"stsz", words(0, 0, frames)))))
    movie = box(b"ftyp", b"qt  ") + box(b"moov", box(b"trak", tkhd + media(b"soun", 9)) + box(b"trak", tkhd + media(b"vide", 60)) + box(b"udta", box(b"\xa9mod", struct.pack(">HH", 5, 0) + b"Phone")))
    assert video_facts(movie) == {"width": 1920, "height": 1080, "rotation": 90, "seconds": 2.0, "frames": 60, "fps": 30.0, "device": "Phone"}
    rows = {r.path: r for r in probe_videos(spark.createDataFrame([("a", movie), ("b", b"junk"), ("c", movie[:50])], "path string, content binary")).collect()}
    assert rows["a"].fps == 30.0 and rows["b"].width is None and rows["c"].device is None
