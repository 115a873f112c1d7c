"""Cross-entropy difference between a target and a background bigram model.

Both models are counted over the same passes, from one shared vocabulary, so
their per-token losses are comparable: the vocabulary is every word of the
corpus, and grows with it.  Words go by a 64-bit hash.  Words and bigrams are
counted exactly over all documents, with sums before the exchange; what is
gathered stays in written tables, never on the driver.  A document's score is
the mean over its tokens of the target loss less the background loss: lower
means closer to the target.

Most bigrams and many words occur once, which needs no table: what a document
holds and no table has, occurs in this document only, so its count is one, and
one in the target if the document is of the target.  The tables hold what occurs
twice or more.

The counts go into sharded indexes that the scoring pass probes.  Where they fit
a task's cache it does so in small blocks of documents.  Beyond that the blocks
are wide, and each reads the shards one after the other and keeps none, so that
nothing is exchanged or written for a bigram however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorgraph.llm.common import written
from floorgraph.llm.decontaminate import WordHashes
from floorgraph.llm.shard_index import batches_of, build_index, fits_a_task, released

MIX = 0.7
#: Bytes of text whose pairs are counted or looked up together.
_BLOCK_BYTES = 1 << 20
#: The same where each block reads the whole indexes.
_WIDE_BYTES = 16 << 20
#: Stands for the start of a document: the hash of what no word can be.
_START = np.uint64(WordHashes()[b" start"])
_TALLIES, _FIRSTS = ["n_target", "n_all"], ["first_target", "first_all"]
_LOSSES = "n_tokens long, target_loss double, background_loss double, score double"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8").lower().split()


def _word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _pair_hashes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _befores(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each, where a document ends before each of ``ends``."""
    before = np.concatenate(([_START], words[:-1])) if len(words) else words.copy()
    before[ends[ends < len(words)]] = _START
    return before


def _sums(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(place of each distinct key, sums of the weights by key)."""
    _, place, back = np.unique(keys, return_index=True, return_inverse=True)
    return place, [np.bincount(back, weights=w, minlength=len(place)).astype(np.int64) for w in weights]


def _batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], known: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, whether of the target, ends of documents) of blocks of (text, target) rows."""
    for batch in batches:
        rows = ((x, len(x[0] or "") + 64) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for block in batches_of(rows, _BLOCK_BYTES):
            words = [_word_hashes(t, known) for t, _ in block]
            n = np.array([len(w) for w in words])
            yield np.concatenate(words), np.repeat(np.array([c for _, c in block], bool), n), np.cumsum(n)


def word_counts(marked: DataFrame) -> DataFrame:
    """(key, n_target, n_all, first_target, first_all): occurrences of each word, and those that another word follows."""
    schema = "key long, n_target long, n_all long, first_target long, first_all long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, chosen, ends in _blocks(batches, WordHashes()):
            followed = np.ones(len(h), bool)
            followed[ends[ends > 0] - 1] = False
            place, sums = _sums(h, [chosen, np.ones(len(h)), chosen & followed, followed])
            yield _batch(schema, [h[place], *sums])

    found = marked.select("text", "target").mapInArrow(run, schema)
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in _TALLIES + _FIRSTS])


def bigram_counts(marked: DataFrame) -> DataFrame:
    """(key, n_target, n_all): occurrences of each bigram that occurs twice or more."""
    schema = "key long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, chosen, ends in _blocks(batches, WordHashes()):
            keys = _pair_hashes(_befores(h, ends), h)
            place, (t, n) = _sums(keys, [chosen, np.ones(len(h))])
            yield _batch(schema, [keys[place], (t << 32) | n])  # both counts in one number: it is exchanged for every bigram

    found = marked.select("text", "target").mapInArrow(run, schema)
    both = found.groupBy("key").agg(F.sum(F.shiftright("n", 32)).alias("n_target"), F.sum(F.col("n").bitwiseAND(F.lit((1 << 32) - 1))).alias("n_all"))
    return both.where("n_all > 1")


def score(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text", mix: float = MIX) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every document.

    ``target`` marks the rows of the target corpus (null: not); the background
    is all rows.  P(w | v) = mix * c(v, w) / c(v) + (1 - mix) * (c(w) + 1) /
    (N + size), where size counts the distinct words of all rows, N the tokens
    of the model's corpus, v may be the start of the document, and the first
    term is left out where c(v) is zero.  Losses are mean natural-log losses.
    Null or wordless texts have no tokens and null losses and score.  Repeated
    rows count each and get a row each.  An empty table gives no rows.  Other
    columns are ignored.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    words = written(word_counts(marked), "words")
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    row = words.agg(*[of(c) for c in _TALLIES + _FIRSTS], F.count("*").alias("size")).first()
    total, size = np.array(row[:2], np.int64), row["size"]
    started = total - np.array(row[2:4], np.int64)  # documents with words: their last word has no follower
    model = _Model(total, started, size, mix)
    pairs = written(bigram_counts(marked), "bigrams")
    known = words.where("n_all > 1")
    return _by_probes(marked, known, pairs, model, fits_a_task((known, 4), (pairs, 2), narrow=True))


@dataclass
class _Model:
    """Tokens, documents with words, distinct words, and the weight of bigrams; a column of the target and one of all rows."""

    total: np.ndarray
    started: np.ndarray
    size: int
    mix: float


def _by_probes(marked: DataFrame, words: DataFrame, pairs: DataFrame, model: _Model, cached: bool) -> DataFrame:
    known_words = build_index(words.withColumn("mark", F.col("key")), _TALLIES + _FIRSTS, narrow=True)
    known_pairs = build_index(pairs.withColumn("mark", F.col("key")), _TALLIES, narrow=True)
    schema = T.StructType([marked.schema["doc_id"], *T.StructType.fromDDL(_LOSSES)])
    block_bytes = _BLOCK_BYTES if cached else _WIDE_BYTES

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        known = WordHashes()
        for batch in batches:
            for own, text, chosen in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield (own, chosen, _word_hashes(text, known)), len(text or "") + 64

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches_of(hashed(batches), block_bytes):
            n = np.array([len(x) for _, _, x in block])
            ends = np.cumsum(n)
            h = np.concatenate([x for _, _, x in block])
            v = _befores(h, ends)
            keys, at, back = np.unique(_pair_hashes(v, h), return_index=True, return_inverse=True)
            # counts of what occurs only here
            once = np.column_stack([np.repeat(np.array([c for _, c, _ in block], np.int64), n)[at], np.ones(len(at), np.int64)])
            distinct, place = np.unique(h, return_inverse=True)
            counts = known_words.counts(distinct, distinct, cached)
            seen = lambda rows, columns: np.where(rows[:, 1:2] > 0, rows[:, columns], once)  # noqa: B023, E731
            loss = (1 - model.mix) * ((seen(counts[place[at]], slice(0, 2)) + 1) / (model.total + model.size))
            first = seen(counts[place[np.maximum(at - 1, 0)]], slice(2, 4))
            first[v[at] == _START] = model.started
            loss += model.mix * seen(known_pairs.counts(keys, keys, cached), slice(0, 2)) / np.maximum(first, 1)
            loss = -np.log(loss)[back]
            # sums of each document by itself, so that neighbours in the block do not round them differently
            out: list[tuple] = []
            for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                if a == b:
                    out.append((0, None, None, None))
                else:
                    t, g = loss[a:b].sum(axis=0) / (b - a)
                    out.append((b - a, float(t), float(g), float(t - g)))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([own for own, _, _ in block], block[0][0].type), *columns], names=schema.names)

    return marked.select("doc_id", "text", "target").mapInArrow(lambda batches: released(losses(batches)), schema)
