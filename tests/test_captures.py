"""One data source over capture folders and archives."""

import io
import zipfile

import numpy as np
import pytest

from plumbline.sources.captures import CaptureReader, capture_files, kind_of, open_captures

from .test_sources import png

FILES = {
    "odometry.csv": b"timestamp, frame, x, y, z, qx, qy, qz, qw\n0.0,0,0,0,0,0,0,0,1\r\n0.1,1,1,0,0,0,0,0,1\n\n",
    "imu.csv": b"0,0,0,1,0,0,0\n1,0,0,1,0,0,0\n",
    "camera_matrix.csv": b"100,0,50\n0,100,40\n0,0,1\n",
    "depth/000000.png": png(np.array([[1500, 0], [2000, 250]], np.uint16), (0,)),
    "depth/000007.png": png(np.array([[1000, 1000], [1000, 1000]], np.uint16), (1,)),
    "confidence/000000.png": png(np.array([[2, 1], [0, 2]], np.uint8), (0,)),
    "depth/.hidden.png": b"x",
    "notes/readme.txt": b"",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    for name, data in FILES.items():
        (root / "plain" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "plain" / name).write_bytes(data)
    buffer = io.BytesIO()
    array = io.BytesIO()
    np.save(array, np.array([[9.0, 9.0], [9.0, 9.0]]))
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in FILES.items():
            z.writestr(f"export/{name}", data)
        z.writestr("export/depth/000000.npy", array.getvalue())
        z.writestr("../evil/odometry.csv", b"x")
        z.writestr("__MACOSX/odometry.csv", b"x")
    (root / "packed.zip").write_bytes(buffer.getvalue())
    (root / "loose.txt").write_bytes(b"x")
    return str(root)


def test_files(spark, folder):
    rows = {(r.capture_id, r.path): r for r in capture_files(spark, folder).collect()}
    names = {n for n in FILES if "hidden" not in n}
    assert {n for c, n in rows if c == "plain"} == names
    assert {n for c, n in rows if c == "packed"} >= {f"export/{n}" for n in names} and not any("evil" in n or "MACOSX" in n for _, n in rows)
    for name in names:
        for r in (rows["plain", name], rows["packed", f"export/{name}"]):
            assert bytes(r.content) == FILES[name] and r.length == len(FILES[name]) and (r.kind, r.number) == kind_of(name)
    listed = capture_files(spark, folder, "odometry,imu", content=False)
    assert listed.columns == ["capture_id", "path", "kind", "number", "length"] and listed.count() == 4


def test_tasks_are_bounded_by_bytes(spark, folder):
    reader = CaptureReader({"path": folder, "taskbytes": "1"}, capture_files(spark, folder).schema)
    pieces = reader.partitions()
    assert len(pieces) > 10 and sum(len(p.files) for p in pieces if p.capture == "plain") == 7
    assert all(len([f for f in p.files if f[1]]) <= 1 for p in pieces)


def test_tables(spark, folder):
    t = open_captures(spark, folder)
    got = sorted((r.capture_id, r.frame, r.x, r.has_depth, r.has_confidence) for r in t["frames"].collect())
    assert got == [(c, f, float(f), f == 0, f == 0) for c in ("packed", "plain") for f in (0, 1)]
    assert sorted(map(tuple, t["orphans"].collect())) == [("packed", 1), ("plain", 1)]
    assert {(r.capture_id, r.unit) for r in t["imu"].collect()} == {("packed", "g"), ("plain", "g")}
    assert all(list(r.K) == [100, 0, 50, 0, 100, 40, 0, 0, 1] for r in t["camera"].collect())
    depth = {(r.capture_id, r.frame, r.i, r.j): r.depth for r in t["depth"].collect()}
    assert len(depth) == 16 and all(depth[c, 0, 1, 0] == 2.0 and depth[c, 0, 1, 1] == 0.25 and depth[c, 7, 0, 0] == 1.0 for c in ("plain", "packed"))
    assert {(r.i, r.j): r.conf for r in t["confidence"].where("capture_id = 'packed'").collect()} == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_no_captures(spark, tmp_path):
    assert capture_files(spark, str(tmp_path)).count() == 0
