"""WARC archives: one gzip member a record, written by Spark's text sink and read by byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm.work import marked, materialize

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "path string, offset long, record_type string, page_id long, url string, refers_to long, payload_bytes long,"
    " payload_digest string, digest_ok boolean, payload binary"
)


def _record(kind: str, page: int | None, url: str | None, digest: str, payload: bytes, size: int, refers: int | None, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write page_id, url, html as WARC records under path, a file a partition, with Spark's commit protocol.

    Rows with equal payloads (html in UTF-8, null counts as empty) of at least min_payload bytes: those with the largest
    page_id become response records, the others revisit records without payload that refer to it; smaller payloads are
    all responses. A row without page_id is a response of its own. Repeated rows are repeated records.

    The text sink ends each row with a separator. A gzip member ends with the high byte of its length, zero below
    16 MB, so the separator is that zero byte; a longer record gets an empty member behind it, which ends in zero too.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("payload"),
    )
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    light = rows.select("page_id", "url", "digest", "size")  # no payload: decisions need none
    groups = light.where((F.col("size") >= min_payload) & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("d"))
    groups = groups.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "payloads")  # written, so that both join sides are plain and a hot payload can be split
    again = light.where(F.col("size") >= min_payload).join(groups, (F.col("digest") == F.col("d")) & (F.col("page_id") != F.col("first")))
    again = materialize(again.select("page_id", "url", "digest", "size", F.col("first").alias("refers")), "revisits")
    keys = again.select(F.col("page_id").alias("p"), F.col("digest").alias("g")).distinct()
    rows = marked(rows, "may", F.xxhash64("page_id", "digest"), keys.select(F.xxhash64("p", "g").alias("h")))
    first = rows.where("may").join(keys, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("g")), "left_anti")
    response = rows.where("not may").unionByName(first).select("page_id", "url", "digest", "size", F.lit(None).cast("long").alias("refers"), "payload")
    rows = response.unionByName(again.withColumn("payload", F.lit(None).cast("binary")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(start, 64).to_pylist():
                    kind = "response" if r["refers"] is None else "revisit"
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    record = _record(kind, r["page_id"], r["url"], digest, r["payload"] or b"", r["size"], r["refers"], date)
                    member = gzip.compress(record, level, mtime=0)
                    if member[-1]:
                        member += gzip.compress(b"", mtime=0)
                    out.append(member[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.mapInArrow(kernel, "member binary").select(F.col("member").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", "\0").text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse_record(data: bytes) -> dict:
    """Fields of one whole decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if "application/http" in f.get("content-type", "") else (b"", b"", block)
    kind, digest = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size, ok = int(_fields(http).get("content-length", 0)), None
    else:
        actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        size, ok, digest = len(payload), actual == digest, actual
    return {
        "record_type": kind, "page_id": _number(f.get("warc-record-id")), "url": f.get("warc-target-uri"),
        "refers_to": _number(f.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "digest_ok": ok, "payload": payload,
    }


class _Member:
    """One gzip member of a seekable file, from `at` on, decoded as far as asked for."""

    def __init__(self, file, at: int, chunk: int):
        self.file, self.at, self.chunk, self.used = file, at, chunk, 0
        self.decoder, self.out = zlib.decompressobj(31), []
        self.size = 0

    def more(self, chunk: int) -> bool:
        """Decode the next piece; false when the file ends or the data are no gzip."""
        self.file.seek(self.at + self.used)
        data = self.file.read(chunk)
        if not data:
            return False
        self.used += len(data)
        try:
            self.out.append(self.decoder.decompress(data))
        except zlib.error:
            return False
        self.size += len(self.out[-1])
        return True

    @property
    def end(self) -> int:
        return self.at + self.used - len(self.decoder.unused_data)

    def record(self) -> bytes | None:
        """The whole decoded record, if its header is one of a WARC record and its length is what the header says; b"" for
        an empty member; None otherwise."""
        head = b""
        while not self.decoder.eof and b"\r\n\r\n" not in head and len(head) < 1 << 20:
            if not self.more(4096):
                return None
            head = b"".join(self.out)
            if head and not (head.startswith(b"WARC/") or b"WARC/".startswith(head)):
                return None
        if self.decoder.eof and not self.size:
            return b""
        start, mark, _ = head.partition(b"\r\n\r\n")
        f = _fields(start)
        length = f.get("content-length", "")
        if not mark or not start.startswith(b"WARC/") or "warc-type" not in f or not (length.isascii() and length.isdigit()):
            return None
        whole = len(start) + 8 + int(length)  # two blank lines: behind the header and behind the block
        while not self.decoder.eof:
            if self.size > whole or not self.more(self.chunk):
                return None
        data = b"".join(self.out)
        return data if len(data) == whole and data.endswith(b"\r\n\r\n") else None


def _chained(file, at: int, links: int, chunk: int) -> bool:
    """Whether members follow one another from `at` on, for `links` of them or to the end of the file."""
    for _ in range(links):
        file.seek(at)
        magic = file.read(len(MAGIC))
        if not magic:
            return True
        member = _Member(file, at, chunk)
        if magic != MAGIC or member.record() is None:
            return False
        at = member.end
    return True


def records_in_range(file, start: int, end: int, chunk: int = 1 << 20, links: int = 8) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the records that start in [start, end) of a seekable file; reads past end to finish.

    Candidates are gzip magics. The first one in a range counts when its header decodes to that of a WARC record, its
    length is what the header says, and the members behind it are sound too, `links` of them or to the end of the file:
    so a member that a payload holds, stored as it is, is passed over, unless it is one of more than `links` in a row.
    From then on members follow one another. Empty members are passed over.
    """
    at, inside = start, start == 0
    while at < end:
        file.seek(at)
        if inside and file.read(len(MAGIC)) == MAGIC:
            member = _Member(file, at, chunk)
            record = member.record()
            if record is not None:
                if record:
                    yield at, record
                at = member.end
                continue
        inside = False
        file.seek(at)
        window = file.read(min(chunk, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(window) - len(MAGIC) + 1)
            if len(window) < len(MAGIC):
                return
            continue
        at += hit
        inside = _chained(file, at, links, chunk)
        if not inside:
            at += len(MAGIC)


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    """Records under path, one row each (RECORD). Files of any size are cut into ranges of split_bytes; a task reads its
    ranges through pyarrow's file systems and owns the records that start inside. digest_ok: the payload has the digest
    that its header states (null for revisits, whose length comes from the kept HTTP header). payload=False leaves the
    payload column null. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    size = F.lit(split_bytes).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size)).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("end"))
    ranges = ranges.repartition(max(1, min(ranges.count(), 100_000)))
    names = [f.split()[0] for f in RECORD.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = dict(zip(names, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()], strict=True))

        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", r["path"]))
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, data in records_in_range(file, r["start"], r["end"]):
                        row = {"path": r["path"], "offset": offset} | parse_record(data)
                        held += len(row["payload"]) if payload else 100
                        rows.append(row if payload else row | {"payload": None})
                        if held > 4_000_000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return ranges.mapInArrow(kernel, RECORD)
