"""File sources and sinks: CSV of unknown encoding, row APIs, image headers, compact JSON, path text."""

from __future__ import annotations

import csv
import io
import re
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from floorgraph.functions.text import compact_number, first_non_empty

ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")
MAX_SIDE, MAX_PIXELS = 20_000, 80_000_000


def read_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """CSV files with a header each; all columns are text, missing ones null.

    Every file is read in the first of the encodings that decodes all of its
    bytes; a byte order mark is dropped.  Files of one encoding and header are
    one reader's, and the groups are joined by column name.  What none of the
    encodings decodes is an error that names the files.
    """

    @F.pandas_udf("encoding string, header array<string>")
    def judged(content: pd.Series) -> pd.DataFrame:
        def judge(raw: bytes) -> tuple[str | None, list[str]]:
            for encoding in encodings:
                try:
                    text = bytes(raw).decode(encoding)
                except UnicodeDecodeError:
                    continue
                return encoding, [c.lstrip("\ufeff").strip() for c in next(csv.reader(io.StringIO(text)), [])]
            return None, []

        return pd.DataFrame([judge(raw) for raw in content], columns=["encoding", "header"])

    files = spark.read.format("binaryFile").load(path).select("path", judged("content").alias("j")).orderBy("path").collect()  # a name and header a file
    if unread := [r.path for r in files if r.j.encoding is None]:
        raise ValueError(f"{', '.join(unread[:5])}: none of {', '.join(encodings)} decodes it")
    groups: dict[tuple, list[str]] = {}
    for r in files:
        groups.setdefault((r.j.encoding, tuple(r.j.header)), []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path))
    if not groups:
        raise ValueError(f"{path}: no files")
    parts = [_csv_of(spark, paths, encoding, header) for (encoding, header), paths in groups.items() if header]
    if not parts:
        return spark.createDataFrame([], "struct<>")
    return reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts)


def _csv_of(spark: SparkSession, paths: list[str], encoding: str, header: Sequence[str]) -> DataFrame:
    """Rows of files of one encoding and header; a file in an encoding that Spark's reader lacks is parsed as a whole by one task."""
    if encoding.startswith("utf-8"):
        schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(paths)

    @F.pandas_udf("array<array<string>>")
    def parse(content: pd.Series) -> pd.Series:
        def rows(raw: bytes) -> list[list[str | None]]:
            parsed = list(csv.reader(io.StringIO(bytes(raw).decode(encoding))))[1:]
            return [[r[k] if k < len(r) and r[k] != "" else None for k in range(len(header))] for r in parsed if r]

        return content.map(rows)

    lines = spark.read.format("binaryFile").load(paths).select(F.explode(parse("content")).alias("r"))
    return lines.select(*[F.col("r")[k].alias(name) for k, name in enumerate(header)])


def read_rows_api(
    spark: SparkSession,
    fetch: Callable[[int, int], dict],
    schema: str,
    page_size: int = 500,
    unwrap: Sequence[str] = ("response", "body", "items", "item"),
    readers: int = 4,
    attempts: int = 3,
) -> DataFrame:
    """Rows of a paged API, read by executors; columns of ``schema`` as text, missing ones null.

    ``fetch(page, size)`` returns a document whose items lie below ``unwrap``; a
    single item counts as one.  Reader k of n takes pages k, k + n, ... until one
    is not full, as all pages after that are empty; a page that fails is asked
    for again, ``attempts`` times, and then with its task.  Nothing is kept on
    the driver, and the rows are the same for every page size and number of readers.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def items_of(page: int) -> list[dict]:
        for left in range(attempts - 1, -1, -1):
            try:
                found = fetch(page, page_size)
                break
            except Exception:
                if not left:
                    raise
        for key in unwrap:
            found = found.get(key) or {} if isinstance(found, dict) else found
        return [found] if isinstance(found, dict) and found else list(found or [])

    class Pages(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(k) for k in range(1, readers + 1)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            page, full = partition.value, True
            while full:
                items = items_of(page)
                for at, item in enumerate(items):
                    yield (page - 1) * page_size + at, {k: None if v is None else str(v) for k, v in item.items()}
                full, page = len(items) >= page_size, page + readers

    format_name = f"rows_api_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return "at long, item map<string, string>"

        def reader(self, schema) -> DataSourceReader:
            return Pages()

    spark.dataSource.register(Source)
    return spark.read.format(format_name).load().select(*[F.col("item")[n].alias(n) for n in names])


def normalised(rows: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Columns from the first non-empty of their several names."""
    pick = lambda options: first_non_empty(*[F.col(o) for o in options if o in rows.columns]) if any(o in rows.columns for o in options) else F.lit(None).cast("string")
    return rows.select(*[pick(options).alias(name) for name, options in names.items()])


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP, JPEG or WebP; None for anything else and for headers cut short."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return abs(w), abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X" and len(data) >= 30:
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
    return _jpeg_size(data) if data[:2] == b"\xff\xd8" else None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Size in the first frame header; what lies between segments is skipped."""
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 9 <= len(data):
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if marker in (0x00, 0xFF):  # no marker, a fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:  # no segment behind it
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_sizes(spark: SparkSession, path: str, head_bytes: int = 1 << 20) -> DataFrame:
    """(path, width, height, status) of image files from their headers: ok, too_large or unreadable.

    Python sees the first ``head_bytes`` of a file, and all of it only where those do not tell.
    """

    @F.pandas_udf("width int, height int")
    def sniff(head: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(None if h is None else bytes(h)) or (None, None) for h in head], columns=["width", "height"]).astype("Int32")

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.substring("content", 1, head_bytes).alias("h"))
    first = files.withColumn("s", sniff("h"))
    rest = F.when(F.col("s.width").isNull() & (F.octet_length("content") > head_bytes), F.col("content"))
    both = first.select("path", "s", sniff(rest).alias("t"))
    out = both.select("path", *[F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in ("width", "height")])
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    status = F.when(w.isNull() | (w < 1) | (h < 1), "unreadable").when((w > MAX_SIDE) | (h > MAX_SIDE) | (w * h > MAX_PIXELS), "too_large").otherwise("ok")
    return out.withColumn("status", status)


def list_files(spark: SparkSession, roots: Sequence[str], artefacts: dict[str, DataFrame]) -> DataFrame:
    """(path, name) of the files below the roots, each once, with a flag for each artefact table that holds its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path").distinct()
    files = files.withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    for flag, table in artefacts.items():
        files = files.join(table.select("name", F.lit(True).alias(flag)).distinct(), "name", "left").fillna({flag: False})
    return files


def compact_json(vector: Column) -> Column:
    """A numeric vector on one line, its numbers as short as six decimals allow."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, compact_number), ", "), F.lit("]"))


def write_json_lines(df: DataFrame, path: str, vectors: Sequence[str] = ()) -> None:
    """One document a row; the named vectors are written compactly."""
    marked = df.select(*[F.concat(F.lit("\u0001"), compact_json(F.col(c)), F.lit("\u0001")).alias(c) if c in vectors else F.col(c) for c in df.columns])
    line = F.regexp_replace(F.to_json(F.struct(*marked.columns)), r'"\\u0001|\\u0001"', "")
    marked.select(line.alias("value")).write.mode("overwrite").text(path)


def path_text(nodes: DataFrame) -> DataFrame:
    """(route, text): "id [x, y, z]" of each node that has a 3-D position, in order."""
    shown = F.when(F.size("position") == 3, F.struct("ord", F.concat(F.col("node_id"), F.lit(" "), compact_json(F.col("position"))).alias("t")))
    return nodes.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["t"]), "\n").alias("text"))


def iterate_pages(pages: Sequence[dict]) -> Callable[[int, int], dict]:
    """A local stand-in for a paged API, for tests and offline use."""
    held = list(pages)
    return lambda page, size: held[page - 1] if page <= len(held) else {}
