"""Media columns: ISO base media files, written and indexed without decoding.

``store`` puts a payload into an ISO media file: a gray 16 x 12 raw video
track, 192 one-byte samples a frame, 25 frames a second, every 8th frame a
sync sample. ``tracks`` walks the nested boxes of any such file, each track's
by themselves, decodes the sample tables (stsd, mdhd, stsc, stsz, stco/co64,
stss, elst) and the runs of movie fragments (moof, tfhd, trun), and gives
codec, duration, the payload's byte ranges and those of the keyframes. Payload
bytes are only located, never decoded.

Rows are independent, so no step shuffles. The work on one row is in memory:
a task holds about four times the longest text of its batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WIDTH, HEIGHT, RATE, SYNC = 16, 12, 25, 8
FRAME = WIDTH * HEIGHT
#: Frames in a chunk of the file.
CHUNK = 64


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *body))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *body))


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """The payload with spaces up to a positive multiple of a frame."""
    frames = max(1, -(-len(payload) // FRAME))
    return payload.ljust(frames * FRAME, b" ")


def mux(payload: bytes) -> bytes:
    """An ISO media file of a payload of whole frames."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("the payload is not a positive number of whole frames")
    chunks = -(-frames // CHUNK)
    spread = [(1, min(CHUNK, frames), 1)] + ([(chunks, frames - CHUNK * (chunks - 1), 1)] if chunks > 1 and frames % CHUNK else [])
    entry = _box(
        b"raw ",
        struct.pack(">6xH16xHHIII", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0),
        struct.pack(">H32sHh", 1, b"", 8, -1),
    )
    sync = np.arange(1, frames + 1, SYNC, dtype=">u4")

    def head(start: int) -> bytes:
        wide = start + len(payload) >= 1 << 32
        offsets = (start + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME).astype(">u8" if wide else ">u4").tobytes()
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stsc", struct.pack(">I", len(spread)), *(struct.pack(">III", *x) for x in spread)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        )
        source = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"payload\0"),
            _box(b"minf", _full(b"vmhd", struct.pack(">4H", 0, 0, 0, 0), flags=1), source, tables),
        )
        track = _full(
            b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7
        )
        movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, frames, 0x10000, 0x100), _MATRIX, struct.pack(">24xI", 2))
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + _box(b"moov", movie, _box(b"trak", track, media))

    lead = 16 if 8 + len(payload) >= 1 << 32 else 8
    start = len(head(0)) + lead
    made = head(start)
    if len(made) + lead != start:  # the offsets needed the wide form
        start = len(made) + lead
        made = head(start)
    return made + _box(b"mdat", payload)


class Index(NamedTuple):
    codec: str
    timescale: int
    duration: int
    frames: int
    ranges: list[tuple[int, int]]
    keyframes: list[tuple[int, int]]
    #: Four letters of the kind of media: "vide", "soun".
    handler: str = ""
    #: (segment duration in the movie's timescale, media time or -1) of the edit list.
    edits: tuple[tuple[int, int], ...] = ()


_CONTAINERS = {b"mdia", b"minf", b"stbl", b"edts"}


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes in data[start:end)."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, body, start + size
        start += size


def _track_boxes(data: memoryview, start: int, end: int) -> dict[bytes, int]:
    """Where the body of the first box of each kind of one track begins, containers walked in depth."""
    found: dict[bytes, int] = {}
    todo = [(start, end)]
    while todo:
        for kind, body, stop in boxes(data, *todo.pop()):
            found.setdefault(kind, body)
            if kind in _CONTAINERS:
                todo.append((body, stop))
    return found


def _samples(data: memoryview, at: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and whether they are sync samples of a track's sample tables."""
    size, count = struct.unpack_from(">II", data, at[b"stsz"] + 4)
    sizes = np.full(count, size, np.int64) if size else np.frombuffer(data, ">u4", count, at[b"stsz"] + 12).astype(np.int64)
    wide = b"co64" in at
    table = at[b"co64" if wide else b"stco"]
    (chunks,) = struct.unpack_from(">I", data, table + 4)
    offsets = np.frombuffer(data, ">u8" if wide else ">u4", chunks, table + 8).astype(np.int64)
    (runs,) = struct.unpack_from(">I", data, at[b"stsc"] + 4)
    spread = np.frombuffer(data, ">u4", runs * 3, at[b"stsc"] + 8).astype(np.int64).reshape(runs, 3)
    held = np.repeat(spread[:, 1], np.diff(np.append(spread[:, 0], chunks + 1)))
    first = np.concatenate(([0], np.cumsum(held)))
    if first[-1] != count:
        raise ValueError("the chunks hold another number of samples than stsz")
    ends = np.concatenate(([0], np.cumsum(sizes)))
    chunk = np.repeat(np.arange(chunks), held)
    starts = offsets[chunk] + ends[:-1] - ends[first[:-1]][chunk]
    sync = np.ones(count, bool)
    if b"stss" in at:
        (n,) = struct.unpack_from(">I", data, at[b"stss"] + 4)
        sync[:] = False
        sync[np.frombuffer(data, ">u4", n, at[b"stss"] + 8).astype(np.int64) - 1] = True
    return starts, sizes, sync


def _fragment(data: memoryview, moof: int, start: int, end: int, defaults: dict[int, tuple[int, int, int]]) -> tuple[int, int, list[tuple[int, int, bool]]]:
    """(track, duration, samples) of one track fragment of the moof box that begins at ``moof``."""
    track, base, length, size, flags = 0, moof, 0, 0, 0
    duration, samples = 0, []
    for kind, body, _ in boxes(data, start, end):
        (said,) = struct.unpack_from(">I", data, body)
        at = body + 4
        if kind == b"tfhd":
            (track,) = struct.unpack_from(">I", data, at)
            length, size, flags = defaults.get(track, (0, 0, 0))
            at += 4
            if said & 0x1:
                (base,) = struct.unpack_from(">Q", data, at)
                at += 8
            at += 4 * bool(said & 0x2)
            for bit in (0x8, 0x10, 0x20):
                if said & bit:
                    (value,) = struct.unpack_from(">I", data, at)
                    at += 4
                    length, size, flags = (value if bit == 0x8 else length, value if bit == 0x10 else size, value if bit == 0x20 else flags)
        elif kind == b"trun":
            (count,) = struct.unpack_from(">I", data, at)
            at += 4
            place = samples[-1][0] + samples[-1][1] if samples else base
            if said & 0x1:
                place = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            lead = None
            if said & 0x4:
                (lead,) = struct.unpack_from(">I", data, at)
                at += 4
            for i in range(count):
                own = [length, size, flags if i or lead is None else lead]
                for k, bit in enumerate((0x100, 0x200, 0x400)):
                    if said & bit:
                        (own[k],) = struct.unpack_from(">I", data, at)
                        at += 4
                at += 4 * bool(said & 0x800)
                samples.append((place, own[1], not own[2] & 0x10000))
                place, duration = place + own[1], duration + own[0]
    return track, duration, samples


def tracks(stored: bytes) -> list[Index]:
    """Codec, duration and byte ranges of every track of an ISO media file, in the order of the file."""
    data = memoryview(stored)
    found: dict[int, dict] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    top = 0
    for kind, body, end in boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, start, stop in boxes(data, body, end):
                if inner == b"trak":
                    at = _track_boxes(data, start, stop)
                    (name,) = struct.unpack_from(">I", data, at[b"tkhd"] + (20 if data[at[b"tkhd"]] else 12))
                    wide = data[at[b"mdhd"]]
                    timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, at[b"mdhd"] + (20 if wide else 12))
                    starts, sizes, sync = _samples(data, at)
                    edits = []
                    if b"elst" in at:
                        long = data[at[b"elst"]]
                        (n,) = struct.unpack_from(">I", data, at[b"elst"] + 4)
                        edits = [struct.unpack_from(">Qq" if long else ">Ii", data, at[b"elst"] + 8 + i * (20 if long else 12)) for i in range(n)]
                    codec = bytes(data[at[b"stsd"] + 12 : at[b"stsd"] + 16]).decode("latin-1")
                    handler = bytes(data[at[b"hdlr"] + 8 : at[b"hdlr"] + 12]).decode("latin-1") if b"hdlr" in at else ""
                    found[name] = {"codec": codec, "handler": handler, "timescale": timescale, "duration": duration, "edits": tuple(edits), "starts": starts, "sizes": sizes, "sync": sync}
                elif inner == b"mvex":
                    for k, x, _ in boxes(data, start, stop):
                        if k == b"trex":
                            name, _, length, size, flags = struct.unpack_from(">5I", data, x + 4)
                            defaults[name] = length, size, flags
        elif kind == b"moof":
            for inner, start, stop in boxes(data, body, end):
                if inner == b"traf":
                    name, duration, samples = _fragment(data, top, start, stop, defaults)
                    if name in found and samples:
                        own = found[name]
                        own["duration"] += duration
                        for key, values in zip(("starts", "sizes", "sync"), zip(*samples, strict=True), strict=True):
                            own[key] = np.concatenate((own[key], np.array(values, own[key].dtype)))
        top = end
    out = []
    for t in found.values():
        starts, sizes, sync = t["starts"], t["sizes"], t["sync"]
        # samples that stand one behind the other are one range
        head = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + sizes[:-1]))) if len(starts) else np.zeros(0, np.int64)
        lengths = np.add.reduceat(sizes, head) if len(head) else head
        ranges = list(zip(starts[head].tolist(), lengths.tolist(), strict=True))
        keys = list(zip(starts[sync].tolist(), sizes[sync].tolist(), strict=True))
        out.append(Index(t["codec"], t["timescale"], t["duration"], len(starts), ranges, keys, t["handler"], t["edits"]))
    return out


def index(stored: bytes) -> Index:
    """The first video track of an ISO media file, or its first track."""
    found = tracks(stored)
    if not found:
        raise ValueError("the file has no track")
    return next((t for t in found if t.handler == "vide"), found[0])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            payloads = [x or b"" for x in part.column("payload").to_pylist()]
            media = pa.array([mux(padded(x)) for x in payloads], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in payloads], pa.int64()), media], ["doc_id", "n_bytes", "media"])


def store(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of rows (doc_id, payload binary); a null payload is empty."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "payload").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, n, stored in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
            media = stored.as_py()
            found = index(media)
            payload = b"".join(media[s : s + n] for s, n in found.ranges)
            out.append(
                {
                    "doc_id": doc.as_py(),
                    "n_bytes": n.as_py(),
                    "codec": found.codec.strip(),
                    "timescale": found.timescale,
                    "duration": found.duration,
                    "frames": found.frames,
                    "keyframes": [{"start": s, "length": n} for s, n in found.keyframes],
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=_INDEX)


_INDEX = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("frames", pa.int64()),
        ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ]
)


def read_index(stored: DataFrame) -> DataFrame:
    """The media index of stored files, with digests of what the sample tables point at."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        _indexed,
        "doc_id long, n_bytes long, codec string, timescale long, duration long, frames long, keyframes array<struct<start: long, length: long>>, "
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string",
    )


def text_media(docs: DataFrame) -> DataFrame:
    """Every text of docs as an ISO media file, written to the shared folder, read back and indexed.

    A null or empty text gives one frame of spaces. Equal texts give equal
    files. Very long texts are stored whole; from 4 GB on boxes and offsets
    take their wide forms. Repeated rows are each returned; other columns are
    not read.
    """
    payload = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return read_index(materialize(store(docs.select("doc_id", payload.alias("payload"))), "media"))
