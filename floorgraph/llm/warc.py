"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so a record can be read by its byte
range.  Every capture gets an index line that starts with its sort key: the
URL with the host's labels reversed, then the capture's number.  The lines are
range-partitioned and sorted; each partition becomes an index file of
compressed blocks of ``BLOCK_LINES`` lines, and a sparse directory with the
first key and the byte range of each block.  A lookup bisects the partitions'
first keys, then the partition's directory, reads and unpacks one block,
bisects its lines, and the record is then read by its range.

Only one line per index *file* is ever held by all tasks; directories and
blocks are read where they are needed.  Files are written under names of the
attempt that writes them and are found through the rows that a successful
attempt returned, which are written to the shared folder before they are used.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorgraph.llm.common import open_fs, shared_path, utf8_bytes, written

MIN_DEDUP_BYTES, BLOCK_LINES, FILE_BYTES = 100, 3000, 1 << 30
#: Bytes of an archive whose records one task reads.
READ_SPAN = 16 << 20
_DATE = "2024-01-01T00:00:00Z"
_NUMBER = 1 << 63


def _one_word(text: str) -> str:
    """Blanks and control characters, which end lines and fields of the index and of records, percent-encoded."""
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in text)


def sort_key(url: str | None) -> str:
    """Reversed-host form of a URL: "org,example,www)/path?query"; the URL itself where it has no host, "-" for a null."""
    if url is None:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        host = ""
    if not host:
        return _one_word(url.strip()) or "-"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    key = ",".join(reversed(host.rstrip(".").split("."))) + port + ")" + rest
    return _one_word(key)


def capture_key(url: str | None, number: int | None) -> str:
    return f"{sort_key(url)} {'-' if number is None else f'{number + _NUMBER:020d}'}"


def decide(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) plus payload digest and ``refers_to`` (null: a response of its own).

    Digests that occur twice are summed before the exchange and joined back as
    (digest, smallest id); Spark broadcasts them only below its own size bound,
    and the payloads are exchanged only beyond it.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), utf8_bytes(F.col("html")).alias("size"))
    twice = marked.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    twice = written(twice.select(F.col("digest").alias("_digest"), "_first"), "payloads")
    first = F.when(F.col("page_id") != F.col("_first"), F.col("_first"))
    return marked.join(twice, F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "html", "digest", "size", first.alias("refers_to"))


def _record(page_id, url, body: bytes, digest: str, size: int, refers_to) -> bytes:
    name = lambda n: f"<urn:page:{'-' if n is None else n}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _one_word(url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    raw = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + http + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _number(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "-" else int(text)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_DEDUP_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` and return (key, file, offset, length), one row per record."""
    decided = decide(pages, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        fs, to = open_fs(name)
                        fs.create_dir(to.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(to, compression=None)
                    member = _record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8"), r["digest"], r["size"], r["refers_to"])
                    out.write(member)
                    rows.append((capture_key(r["url"], r["page_id"]), name, at, len(member)))
                    at += len(member)
                columns = [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return written(decided.mapInArrow(write, "key string, file string, offset long, length long"), "captures")


@dataclass
class CaptureIndex:
    """First keys and files of the index, one entry per index file."""

    firsts: list[str]
    files: list[str]


def build_capture_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures by key into index files of compressed blocks with a sparse directory each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/{uuid.uuid4().hex}"
        fs, to = open_fs(name)
        lines: list[str] = []
        directory: list[tuple[str, int, int]] = []
        at, out = 0, None

        def flush(n: int) -> None:
            nonlocal at
            block = zlib.compress("\n".join(lines[:n]).encode("utf-8"))
            directory.append((lines[0].split("\t", 1)[0], at, len(block)))
            out.write(block)
            at += len(block)
            del lines[:n]

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(to.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{to}.blocks", compression=None)
                lines.append(f"{r['key']}\t{r['file']}\t{r['offset']}\t{r['length']}")
                if len(lines) >= block_lines:
                    flush(block_lines)
        if out is not None:
            if lines:
                flush(len(lines))
            out.close()
            with fs.open_output_stream(f"{to}.directory", compression=None) as f:
                f.write(json.dumps(directory).encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first", "file"])

    # keys are compared as UTF-8 bytes here and as code points in Python: the same order
    parts = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    found = sorted((r["first"], r["file"]) for r in parts.mapInArrow(write, "first string, file string").collect())  # one per index file
    return CaptureIndex([f for f, _ in found], [f for _, f in found])


class _Reader:
    """Bisects an index; keeps the last directory and block, as lookups come sorted."""

    def __init__(self, index: CaptureIndex):
        self.index, self.part, self.block_at = index, -1, None

    def block(self, part: int, k: int) -> list[str]:
        if (part, k) != self.block_at:
            _, at, length = self.directory[k]
            fs, to = open_fs(self.index.files[part])
            with fs.open_input_file(f"{to}.blocks") as f:
                f.seek(at)
                self.lines = zlib.decompress(f.read(length)).decode("utf-8").split("\n")
            self.keys = [line.split("\t", 1)[0] for line in self.lines]
            self.block_at = (part, k)
        return self.lines

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; repeats of a row may run on into the next blocks."""
        out = []
        part = max(0, bisect_right(self.index.firsts, key) - 1)
        while part > 0 and self.index.firsts[part] == key:  # the key may begin before
            part -= 1
        while part < len(self.index.files) and self.index.firsts[part] <= key:
            if part != self.part:
                fs, to = open_fs(self.index.files[part])
                with fs.open_input_stream(f"{to}.directory", compression=None) as f:
                    self.directory = json.loads(f.read())
                self.starts, self.part, self.block_at = [d[0] for d in self.directory], part, None
            k = max(0, bisect_right(self.starts, key) - 1)
            while k > 0 and self.starts[k] == key:
                k -= 1
            while k < len(self.starts) and self.starts[k] <= key:
                lines = self.block(part, k)
                at = bisect_right(self.keys, key)
                low = at
                while low > 0 and self.keys[low - 1] == key:
                    low -= 1
                out += [(f, int(o), int(n)) for f, o, n in (line.split("\t")[1:] for line in lines[low:at])]
                k += 1
            part += 1
        return out


def look_up(keys: DataFrame, index: CaptureIndex) -> DataFrame:
    """(file, offset, length) of the captures of the distinct ``key`` values, in key order within a task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            rows = [x for key in batch.column(0).to_pylist() for x in reader.find(key)]
            columns = [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "length"])

    asked = keys.select("key").distinct()
    return asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, "file string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to) of the records at these ranges.

    The payload's size and digest are those of what the record holds, so for a
    revisit of an empty payload; ``header_digest`` is what its header states.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    name = r["file"]
                    fs, to = open_fs(name)
                    f = fs.open_input_file(to)
                f.seek(r["offset"])
                headers, payload = parse_record(f.read(r["length"]))
                refers = headers.get("warc-refers-to")
                rows.append((
                    _number(headers["warc-record-id"]), headers["warc-type"], len(payload), hashlib.sha256(payload).hexdigest(),
                    None if refers is None else _number(refers), headers["warc-payload-digest"].removeprefix("sha256:"),
                ))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "header_digest"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=names)
        if f is not None:
            f.close()

    span = F.floor(F.col("offset") / F.lit(READ_SPAN))
    near = places.repartition("file", span).sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, header_digest string")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write ``pages`` to archives, index them, look every capture up and read it back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to,
    header_digest), one row per page.  The payload is the html in UTF-8 (null:
    empty).  Of equal payloads of at least ``min_bytes`` bytes the one with the
    smallest id is stored as a response, as is any repeat of that very id; the
    others are revisits, whose size and digest are resolved through the
    response they refer to.  A null id is no smallest id: such rows are
    responses.  A null URL sorts under "-", blanks and control characters of
    any URL are percent-encoded.  An empty table gives no rows.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    captures = write_archives(own, shared_path(spark, "warc"), min_bytes)
    index = build_capture_index(captures, shared_path(spark, "cdx"))
    records = written(read_records(look_up(captures.select("key"), index)), "records")
    stored = records.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    return records.join(stored, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("_to")) & (F.col("header_digest") == F.col("_digest")), "left").select(
        "page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to", "header_digest"
    )
