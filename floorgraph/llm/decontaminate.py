"""Benchmark decontamination by size-partitioned MinHash containment search.

The test items are short, the documents long, and what counts is containment:
the share of an *item's* shingles that a document holds.  The items are
partitioned by their number of shingles, those of fewer words than a shingle by
their words.  Each size class has its own sketch length k, from the class's
largest size u and the threshold t: an item that is contained to at least t
misses at most floor((1 - t) * u) of its shingles, so among its k =
floor((1 - t) * u) + 1 smallest min-wise hashes (its bottom-k MinHash) at least
one is in the document.  Each class has its own table of sketches, and a
document searches the classes whose items it is long enough to hold.  Probing
every shingle of a document against a class' sketches therefore finds every
contained item, unlike banded signatures of the whole document, whose Jaccard
similarity to a short item is close to zero however it is partitioned.
Candidates are verified by exact shingle containment.

The documents are read once, row by row, and never exchanged.  The items are a
query set: they go to the tasks in blocks of at most ``block_bytes`` of text, a
pass over the documents each.  Blocks are built one at a time and lie in the
shared folder, from which tasks read them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorgraph.llm.common import open_fs, shared_path

SHINGLE, THRESHOLD = 5, 0.8
#: Item text that one pass over the documents takes along.
BLOCK_BYTES = 16 << 20
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return (text or "").lower().encode("utf-8").translate(_TO_SPACE).split()


class WordHashes(dict):
    """64-bit hash of a word, remembered for as many words as ``most``."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], n: int, known: WordHashes) -> np.ndarray:
    """Hash of each run of n words; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k % len(_MULTIPLIERS)]
        out = (out ^ (x >> np.uint64(29)) ^ x) * _MULTIPLIERS[(k + 3) % len(_MULTIPLIERS)]
    return out ^ (out >> np.uint64(32))


def shingles(words: list[bytes], n: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@dataclass
class SizeClass:
    """Sketches of the items of one size class: by hash the items, and a table of the hashes' leading bits."""

    n: int  # words of a shingle
    least: int  # shingles that a document must have
    sketch: dict[int, list[int]] = field(default_factory=dict)

    def seal(self) -> None:
        self.bits = max(12, min(26, (16 * len(self.sketch)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[np.fromiter(self.sketch, np.uint64) >> np.uint64(64 - self.bits)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        near = h[self.table[h >> np.uint64(64 - self.bits)]]
        return {at for x in np.unique(near).tolist() for at in self.sketch.get(x, ())}


@dataclass
class ItemIndex:
    """A block of items: their size classes and exact shingles."""

    ids: list = field(default_factory=list)
    exact: list[set[bytes]] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    needed: list[int] = field(default_factory=list)
    classes: dict[tuple[int, int], SizeClass] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple], n: int, threshold: float) -> ItemIndex:
        index, known = cls(), WordHashes()
        for item_id, text in items:
            words = words_of(text)
            own = shingles(words, n)
            if not own:
                continue
            at, size, width = len(index.ids), len(own), min(n, len(words))
            needed = int(np.ceil(threshold * size - 1e-9))
            index.ids.append(item_id)
            index.exact.append(own)
            index.hashes.append(np.unique(shingle_hashes(words, n, known)))
            index.needed.append(needed)
            bits = size.bit_length()
            own_class = index.classes.setdefault((width, bits), SizeClass(width, needed))
            own_class.least = min(own_class.least, needed)
            largest = (1 << bits) - 1  # of the size class
            k = largest - int(np.ceil(threshold * largest - 1e-9)) + 1
            for h in index.hashes[-1][:k].tolist():
                own_class.sketch.setdefault(h, []).append(at)
        for own_class in index.classes.values():
            own_class.seal()
        return index

    def search(self, text: str | None, known: WordHashes) -> list[tuple[int, int]]:
        """(item's place, its shingles found) for every item contained in the text."""
        words, by_width, found = words_of(text), {}, []
        for (n, _), own_class in self.classes.items():
            if len(words) - n + 1 < own_class.least:
                continue
            if n not in by_width:
                by_width[n] = shingle_hashes(words, n, known)
            h = by_width[n]
            for at in own_class.candidates(h):
                places = np.flatnonzero(np.isin(h, self.hashes[at]))
                held = len({b" ".join(words[i : i + n]) for i in places.tolist()} & self.exact[at])
                if held >= self.needed[at]:
                    found.append((at, held))
        return sorted(found)


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    total = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    n = max(1, -(-(total.b + 64 * total.n) // block_bytes))
    if n == 1:
        return [items]
    place = F.pmod(F.xxhash64("_id", "_text"), F.lit(n))
    return [items.where(place == k) for k in range(n)]


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, n: int, threshold: float, block_bytes: int) -> list[str]:
    """Files in the shared folder, an index of a block of items each."""
    items = benchmark.select(F.col(item_id).alias("_id"), F.col(item_text).alias("_text")).where("_text is not null").distinct()
    files = []
    for block in _blocks(items, block_bytes):
        index = ItemIndex.build([(r["_id"], r["_text"]) for r in block.collect()], n, threshold)  # one block of items
        files.append(shared_path(benchmark.sparkSession, "items"))
        fs, path = open_fs(files[-1])
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(pickle.dumps(index))
    return files


def _opened(file: str) -> ItemIndex:
    fs, path = open_fs(file)
    with fs.open_input_stream(path, compression=None) as f:
        return pickle.loads(f.read())


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, matched, n_shingles, containment) of every contained item.

    An item is contained if at least ``threshold`` of its distinct shingles of
    ``n`` words are in the document; an item of fewer words has one shingle,
    all its words, and is contained where these follow each other.  Null or wordless items and documents match nothing.
    Repeated documents each get their rows, repeated items count once, items
    of equal text and different ids each get theirs.  Empty tables give no
    rows.  Other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([
        T.StructField("doc_id", narrow.schema["doc_id"].dataType), T.StructField("item_id", kind), T.StructField("matched", T.LongType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("containment", T.DoubleType()),
    ])

    def searcher(file: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            index, known, arrow = _opened(file), WordHashes(), to_arrow_schema(schema)
            for batch in batches:
                rows = [
                    (doc, index.ids[at], held, len(index.exact[at]), held / len(index.exact[at]))
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for at, held in index.search(text.as_py(), known)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        return run

    parts = [narrow.mapInArrow(searcher(file), schema) for file in _indexes(benchmark, item_id, item_text, n, threshold, block_bytes)]
    return reduce(DataFrame.unionAll, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that contain an item, as :func:`contained_items` has it; columns as they were.

    Null and wordless texts contain nothing and stay, repeated rows stay or go together.
    """
    place, schema = docs.columns.index(text_col), docs.schema

    def cleaner(file: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, known = _opened(file), WordHashes()
            for batch in batches:
                yield batch.filter(pa.array([not index.search(text.as_py(), known) for text in batch.column(place)], pa.bool_()))

        return run

    for file in _indexes(benchmark, item_id, item_text, n, threshold, block_bytes):
        docs = docs.mapInArrow(cleaner(file), schema)
    return docs
