"""WARC archives: a writer, and a splittable reader of gzip members.

The writer puts one gzip member a record, so a reader can begin at any of
them. The reader deals the archives out as byte ranges. A task looks for the
gzip magic from the beginning of its range, takes a candidate for a member
only if it decodes to a WARC header, and owns the records that begin inside
its range, reading past the end of the range where the last one does. Ranges
so need no index, and together return every record once.

Archives lie in the shared folder, as files; tasks reach them by the folder's
own file system. A file's name holds the task attempt, and the manifest, a
table written by Spark, names the files of the attempts that counted, so a
lost executor leaves no record twice.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, materialize

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this are never made revisits.
LEAST_REVISITED = 100
#: Bytes of a reader's range, and of an archive before the next is begun.
SPLIT_BYTES = 8 << 20
ARCHIVE_BYTES = 512 << 20
_READ = 1 << 18


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, kind: str, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload of its own."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        task, made, out, name, size = TaskContext.get(), [], None, "", 0
        try:
            for batch in batches:
                for row in range(0, batch.num_rows, 256):
                    for x in batch.slice(row, 256).to_pylist():
                        if out is None:
                            name = f"{root}/{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                            out, size = system.open_output_stream(name, compression=None), 0
                        member = record(x["page_id"], x["url"], x["record_type"], x["payload"] or b"", x["payload_digest"], x["payload_bytes"], x["refers_to"])
                        out.write(member)
                        size += len(member)
                        if size >= ARCHIVE_BYTES:
                            out.close()
                            made.append((name, size))
                            out = None
        finally:
            if out is not None:
                out.close()
                made.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.string()), pa.array([s for _, s in made], pa.int64())], ["path", "bytes"])

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, url, payload, record_type, payload_digest, payload_bytes, refers_to); the manifest (path, bytes)."""
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    rows = records.select("page_id", "url", "payload", "record_type", "payload_digest", "payload_bytes", "refers_to")
    return materialize(rows.mapInArrow(_written(folder), "path string, bytes long"), "manifest")


class _Range:
    """The members that begin in data[lo:hi) of a file of ``size`` bytes.

    ``damaged`` fills with the places where a member should have begun, or
    began and broke off.
    """

    def __init__(self, file: pa.NativeFile, lo: int, hi: int, size: int | None = None):
        self.file, self.hi, self.base, self.data = file, hi, lo, b""
        self.size = file.size() if size is None else size
        self.damaged: list[int] = []
        file.seek(lo)

    def _more(self) -> bool:
        got = self.file.read(_READ)
        self.data += got
        return bool(got)

    def _decoded(self, at: int) -> tuple[bytes, int] | None:
        """The member at an offset and its end, or None if what is there is no WARC record."""
        unpack, out, i = zlib.decompressobj(31), [], at - self.base
        checked = False
        try:
            while not unpack.eof:
                if i >= len(self.data) and not self._more():
                    raise zlib.error("the file ends within a member")
                piece = self.data[i : i + _READ]
                out.append(unpack.decompress(piece))
                i += len(piece)
                if not checked and sum(map(len, out)) >= 5:
                    checked = True
                    if not b"".join(out).startswith(b"WARC/"):
                        return None
        except zlib.error:
            if checked:
                self.damaged.append(at)
            return None
        return (b"".join(out), self.base + i - len(unpack.unused_data)) if checked else None

    def _expected(self, at: int) -> None:
        """A member has to begin at ``at``, behind the last one."""
        while len(self.data) - (at - self.base) < len(MAGIC) and self._more():
            pass
        if at < self.size and self._decoded(at) is None and at not in self.damaged:
            self.damaged.append(at)

    def members(self) -> Iterator[bytes]:
        at, behind = self.base, self.base == 0
        while at < self.hi:
            found = self.data.find(MAGIC, at - self.base)
            if found < 0:
                # the magic may begin in the last two bytes
                at = max(at, self.base + len(self.data) - 2)
                if at >= self.hi or not self._more():
                    break
                continue
            if behind and found:
                self.damaged.append(self.base)
                behind = False
            at = self.base + found
            if at >= self.hi:
                break
            member = self._decoded(at)
            if member is None:
                if behind and at not in self.damaged:
                    self.damaged.append(at)
                at, behind = at + 1, False
                continue
            yield member[0]
            at, behind = member[1], True
            self.data, self.base = self.data[at - self.base :], at
        if behind:
            self._expected(self.base)


def parse_record(member: bytes) -> dict:
    """Fields of one decoded record; digests are computed from the payload it holds."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    said = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != said:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if fields["WARC-Type"] == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": said,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_TYPES = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}


def _read(columns: tuple[str, ...], report: bool):
    schema = pa.schema([(c, _FIELDS[c]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                system, path = _file_system(x["path"]) if "://" in x["path"] else (_file_system(x["folder"])[0], x["path"])
                with system.open_input_file(path) as file:
                    held, size = [], 0
                    part = _Range(file, x["lo"], x["hi"], x["bytes"])
                    for member in part.members():
                        row = parse_record(member)
                        held.append({c: row[c] for c in columns})
                        size += len(member)
                        if size >= 4 << 20 or len(held) >= 5_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if part.damaged and not report:
                        raise ValueError(f"{path} is damaged at {', '.join(map(str, part.damaged))}")
                    held += [{c: {"record_type": "damaged", "url": f"{path}#{at}"}.get(c) for c in columns} for at in part.damaged]
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_archives(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(_FIELDS), split_bytes: int = SPLIT_BYTES, damage: str = "raise") -> DataFrame:
    """The records of the archives in a manifest, read by byte ranges.

    A record that cannot be read stops the job. With damage="report" it is a
    row of record_type "damaged", whose url tells file and byte, and reading
    goes on with the next record.
    """
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", F.lit(folder).alias("folder"), "bytes", begins.alias("lo"))
    ranges = ranges.select("path", "folder", "bytes", "lo", F.least(F.col("lo") + split_bytes, "bytes").alias("hi"))
    tasks = max(1, min(20_000, ranges.count()))
    return ranges.repartition(tasks, "path", "lo").mapInArrow(_read(columns, damage == "report"), ", ".join(f"{c} {_TYPES[c]}" for c in columns))


def with_revisits(pages: DataFrame) -> DataFrame:
    """Records of pages: of equal payloads of LEAST_REVISITED bytes or more the smallest page_id is the response.

    Only (page_id, digest, length) is shuffled to find the revisits; the html
    moves once, by page, and a revisit's is dropped before it does.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = materialize(rows.select("page_id", "payload_digest", "payload_bytes"), "payloads")
    firsts = keys.where(F.col("payload_bytes") >= LEAST_REVISITED).groupBy("payload_digest")
    firsts = firsts.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    again = keys.join(firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "first").distinct()
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left")
    revisit = F.col("first").isNotNull()
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("first").alias("refers_to"),
    )


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written as WARC and read back.

    A null html is an empty payload. Rows of one page_id with equal payloads
    are all the response, or all revisits. A row without page_id is a revisit
    of an equal payload that has one. An empty table gives no archive and no
    rows. A payload of any length is one record. An archive that is damaged
    stops the job. Other columns are not read.
    """
    folder = fresh_path(spark, "warc")
    manifest = write_archives(with_revisits(pages), folder)
    return read_archives(manifest, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
