"""Dropping lines that many documents share.

The number of documents of each distinct line is counted with map-side sums
over 128-bit line hashes, never over the lines themselves.  A sharded minimal
perfect hash over the distinct hashes that enough documents hold indexes two
compact arrays, the fingerprint (the hash's other 64 bits) and the count.  The
documents then probe the arrays, row by row; neither lines nor texts are
exchanged or joined.  A hash below the threshold needs no place in the arrays:
its probe fails on the fingerprint.  So the index is as small as what is
dropped, a small share of all distinct lines.

Where it outgrows a task's cache all the same, the distinct line hashes of each
row are sent to the shards, and the hashes to drop come back by the row's hash:
the only case in which texts are exchanged, once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorgraph.llm.common import ASCII_SPACE, written
from floorgraph.llm.shard_index import KEYS_PER_SHARD, ShardIndex, batches_of, build_index, fits_a_task, released

_SPACE = ASCII_SPACE.encode()
#: Bytes of text whose lines are probed together, and distinct lines a task sums before it emits.
_BLOCK_BYTES, _MOST_SUMS = 8 << 20, 200_000


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """Key of each line: stripped of ASCII white space, A-Z lower-cased; None where it is too short."""
    keys = [line.strip(_SPACE).lower() for line in (text or "").encode("utf-8").split(b"\n")]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8")) >= min_chars) else None for k in keys]


def _digest(keys: list[bytes]) -> np.ndarray:
    """Two unsigned longs for each key."""
    return np.frombuffer(b"".join(map(_raw, keys)), np.uint64).reshape(-1, 2)


def _raw(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_counts(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(key, mark, n): documents of each distinct line hash; a row is a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}

        def emit() -> pa.RecordBatch:
            pair = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
            n = np.fromiter(sums.values(), np.int64, len(sums))
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n)], names=["key", "mark", "n"])

        for batch in batches:
            for text in batch.column(0):
                for k in set(line_keys(text.as_py(), min_chars)):
                    if k is not None:
                        h = _raw(k)
                        sums[h] = sums.get(h, 0) + 1
                if len(sums) >= _MOST_SUMS:
                    yield emit()
                    sums.clear()
        yield emit()

    found = docs.select(text_col).mapInArrow(run, "key long, mark long, n long")
    return found.groupBy("key", "mark").agg(F.sum("n").alias("n"))


@dataclass
class LineIndex:
    """Counts of the lines that ``min_docs`` documents or more hold, and whether they fit a task."""

    counts: ShardIndex
    small: bool
    min_docs: int


def line_index(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
    """The index over the lines that ``min_docs`` of ``docs`` or more hold; it serves any threshold from that one on."""
    recurring = written(line_counts(docs, text_col, min_chars).where(F.col("n") >= min_docs), "lines")
    return LineIndex(build_index(recurring, ["n"], keys_per_shard), fits_a_task((recurring, 1)), min_docs)


def _lines_to_drop(rows: DataFrame, index: ShardIndex, min_docs: int, min_chars: int) -> DataFrame:
    """(row, mark, drop) of the ``rows`` (text, row, mark) with lines to drop: the 16-byte hashes of these lines."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, row, mark in zip(*batch.columns, strict=True):
                keys = list({k for k in line_keys(text.as_py(), min_chars) if k is not None})
                pair = _digest(keys).view(np.int64)
                own = [pa.array(np.full(len(keys), x.as_py())) for x in (row, mark)]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *own], names=["key", "mark", "row", "row_mark"])

    asked = rows.dropDuplicates(["row", "mark"]).select("text", "row", "mark").mapInArrow(ask, "key long, mark long, row long, row_mark long")
    hit = index.routed(asked, "row").where(F.col("counts")[0] >= min_docs)
    # at most a row's own lines
    return hit.groupBy(F.col("row").alias("_row"), F.col("row_mark").alias("_mark")).agg(F.collect_list(F.struct("key", "mark")).alias("drop"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: bool = False,
    index: LineIndex | None = None,
) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` documents hold, in every document.

    Texts are split at \\n (null or empty: one empty line).  Keys of fewer than
    ``min_chars`` code points are never dropped.  Returns (doc_id, n_lines,
    n_dropped, kept); with ``keep`` the input's columns instead, the text
    without the dropped lines and ``n_chars``, where there is one, counted
    anew; a null text stays null.  A row is a document, so repeated rows count
    each.  An empty table gives no rows.  Other columns are ignored, or with
    ``keep`` returned unchanged.  ``index`` probes the lines of another corpus; it
    must have been built for ``min_docs`` or fewer, else it is an error.
    """
    index = index or line_index(docs, text_col, min_docs, min_chars)
    if index.min_docs > min_docs:
        raise ValueError(f"the index lacks lines of fewer than {index.min_docs} documents, and {min_docs} are asked for")
    count = docs.columns.index("n_chars") if keep and "n_chars" in docs.columns else None
    narrow = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    place = narrow.columns.index(text_col if keep else "text")
    schema = narrow.schema if keep else T.StructType([narrow.schema["doc_id"], *T.StructType.fromDDL("n_lines long, n_dropped long, kept string")])
    width = len(narrow.columns)
    if not index.small:
        names = [f"{c}-{uuid.uuid4().hex}" for c in ("row", "mark", "drop")]
        own = narrow[id_col if keep else "doc_id"], narrow[narrow.columns[place]]
        hashed = narrow.select("*", F.xxhash64(*own).alias(names[0]), F.xxhash64(F.lit("row"), *own).alias(names[1]))
        asked = hashed.select(hashed[narrow.columns[place]].alias("text"), F.col(names[0]).alias("row"), F.col(names[1]).alias("mark"))
        drops = _lines_to_drop(asked, index.counts, min_docs, min_chars).withColumnRenamed("drop", names[2])
        narrow = hashed.join(drops, (F.col(names[0]) == F.col("_row")) & (F.col(names[1]) == F.col("_mark")), "left").select(*hashed.columns[:width], names[2])

    def common_of(keys: list[bytes]) -> set[bytes]:
        """Those of the distinct keys that too many documents hold."""
        pair = _digest(keys)
        counts = index.counts.counts(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))[:, 0]
        return {k for k, n in zip(keys, counts.tolist(), strict=True) if n >= min_docs}

    def cleaned(texts: list[str | None], drops: list | None) -> Iterator[tuple[int, int, str]]:
        """(lines, dropped, kept text) of each text."""
        for block in batches_of(((x, len(x[0] or "") + 64) for x in zip(texts, drops or [None] * len(texts), strict=True)), _BLOCK_BYTES):
            keys = [line_keys(t, min_chars) for t, _ in block]
            common = common_of(list({k for own in keys for k in own if k is not None})) if drops is None else set()
            for (text, drop), own in zip(block, keys, strict=True):
                if drop:
                    gone = {np.array([d["key"], d["mark"]], np.int64).tobytes() for d in drop}
                    common = {k for k in own if k is not None and _raw(k) in gone}
                if (drops is not None and not drop) or common.isdisjoint(own):
                    yield len(own), 0, text or ""
                    continue
                lines = [line for line, k in zip((text or "").split("\n"), own, strict=True) if k not in common]
                yield len(own), len(own) - len(lines), "\n".join(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(place).to_pylist()
            done = cleaned(before, None if batch.num_columns == width else batch.column(width).to_pylist())
            if keep:
                after = [None if t is None else kept for t, (_, _, kept) in zip(before, done, strict=True)]
                columns = list(batch.columns[:width])
                columns[place] = pa.array(after, pa.string())
                if count is not None:
                    columns[count] = pa.array([None if t is None else len(t) for t in after], columns[count].type)
            else:
                rows = list(done)
                columns = [batch.column(0), *[pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(lambda batches: released(run(batches)), schema)
