"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other alphabets and digits (and
signs inside words) that stand for letters to plain ones, drops zero-width
characters, and turns everything else into blanks.  The lexicon holds word
beginnings and whole words with their log odds, learned from labelled rows;
phrases in which an entry is harmless are exceptions and cancel the hits inside
them.  A text's weighted hits, as such and by its length in words, go through a
logistic curve.

Learning uses at most ``sample_rows`` labelled rows, near copies of one label
among them counted once.  They are written to the shared folder in one pass
over the documents; all else that is learned reads these rows only.  An entry
occurs in a hundredth of the toxic ones or more, so that the lexicon is bounded
by the sample and the length of its texts.  Scoring is row-local; the lexicon
travels with the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorgraph.llm.common import written
from floorgraph.llm.decontaminate import WordHashes, shingle_hashes
from floorgraph.llm.simhash import alike


# Letters of other alphabets that look like Latin ones, and what stands for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_SIGN = re.compile(r"(?<![^\s])[@$](?=[^\W_])|(?<=[^\W_])[@$!|+€](?=[^\W_])")
_PREFIXES = (4, 5, 6, 7, 8)
SAMPLE_ROWS = 20_000
#: Shingle similarity of labelled rows that count once.
ALIKE = 0.8


class _Fold(dict):
    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if c in ZERO_WIDTH:
            out = ""
        elif 0xFF10 <= code <= 0xFF5A:  # full-width forms
            out = self[code - 0xFEE0]
        else:
            out = HOMOGLYPHS.get(c) or DIGITS.get(c) or (c if c.isalpha() else " ")
        self[code] = out
        return out


_fold = _Fold()


def fold(text: str | None) -> str:
    """Folded words between single or more blanks, a blank at either end."""
    text = (text or "").lower()
    if not text.isascii() or _SIGN.search(text):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(_fold)} "


@dataclass
class Lexicon:
    """Weighted entries (" stem" for beginnings, " word " for whole words), exceptions, and the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-2.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry.rstrip()), entry.endswith(" "), weight))
        for phrase in self.exceptions:
            if f" {phrase} " not in self.weights:
                found.add_word(f" {phrase} ", (len(phrase) + 1, True, None))
        found.make_automaton()
        return found


def hits(text: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """Weight of the strongest entry at each word of a folded text, by the place before the word."""
    if not len(automaton):
        return {}
    at: dict[int, float] = {}
    spans: list[tuple[int, int]] = []
    for end, (length, whole, weight) in automaton.iter(text):
        start = end + 1 - length - whole
        if weight is None:
            spans.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    for a, b in spans:
        for k in [k for k in at if a <= k < b]:
            del at[k]
    return at


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Weighted hits (dampened), and weighted hits for each word of the text (dampened)."""
    folded = fold(text)
    total = sum(hits(folded, automaton).values())
    words = len(folded.split())
    return math.log1p(total), math.log1p(100 * total / words) if words else 0.0


def curve(x: tuple[float, float], weights: tuple[float, float, float]) -> float:
    z = weights[0] + weights[1] * x[0] + weights[2] * x[1]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _candidates(text: str | None) -> set[str]:
    """Beginnings and whole words of a text that could be entries."""
    out: set[str] = set()
    for w in set(fold(text).split()):
        if len(w) >= 4:
            out.update(f" {w[:n]}" for n in _PREFIXES if n <= len(w))
        if len(w) >= 3:
            out.add(f" {w} ")
    return out


def _shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the text's distinct runs of five folded words."""
    return np.unique(shingle_hashes(fold(text).encode("utf-8").split(), 5, known))


def _mapped(df: DataFrame, rows_of, schema: str) -> DataFrame:
    """``rows_of(text, toxic)`` of every row, summed over (entry, toxic) within a task."""
    parsed = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], names=parsed.names
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for entry in rows_of(text.as_py()):
                    sums[entry, toxic] = sums.get((entry, toxic), 0) + 1
                if len(sums) > 100_000:
                    yield emit()
                    sums.clear()
        yield emit()

    return df.select("text", "toxic").mapInArrow(run, parsed).groupBy("entry").agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("tox"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("non")
    )


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``sample_rows`` labelled documents, near copies of one label once, as a written table.

    The rows are those of smallest hashed id, so the draw depends on nothing
    but the ids; ids with two different labels are left out.  Of rows whose
    smallest two shingle hashes agree, one goes if its shingle similarity to one
    that stays is ``ALIKE`` or more.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    drawn = F.broadcast(drawn)  # at most sample_rows rows of two numbers
    chosen = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    fields = "text string, toxic int, doc_id {}, a long, b long"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            least = np.array([(*_shingles(t.as_py(), known)[:2].view(np.int64), 0, 0)[:2] for t in batch.column(1)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(least[:, 0]), pa.array(least[:, 1])], names=["text", "toxic", "doc_id", "a", "b"])

    signed = written(chosen.mapInArrow(sign, fields.format(docs.schema["doc_id"].dataType.simpleString())), "signed")

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf[["text", "toxic"]]
        pdf, known = pdf.sort_values(["doc_id", "text"]), WordHashes()
        kept: dict[int, np.ndarray] = {}
        for place, text in enumerate(pdf["text"]):
            h = _shingles(text, known)
            if not any(alike(h, k, ALIKE) for k in kept.values()):
                kept[place] = h
        return pdf.iloc[list(kept)][["text", "toxic"]]

    return written(signed.groupBy("a", "b", "toxic").applyInPandas(once, "text string, toxic int"), "training")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    exceptions: tuple[str, ...] = (),
    least_texts: int = 4,
    least_share: float = 0.01,
    least_weight: float = 3.0,
    harmless_texts: int = 5,
) -> Lexicon:
    """Lexicon, exceptions and curve from the labelled rows (doc_id, toxic) among ``docs`` (doc_id, text).

    Labels other than 0 and 1, null ids and ids that ``docs`` lacks teach
    nothing; null and empty texts teach the curve's base only.  Of repeated ids
    each row counts.  Without rows of both labels the lexicon is empty and no
    text scores one half.

    An entry is learned from ``least_texts`` toxic texts and ``least_share`` of
    them all or more, with log odds of ``least_weight`` or more: what fewer rows
    show teaches nothing, so fewer than ``least_texts`` toxic rows leave the
    lexicon empty and all scores at the rows' base rate.  A phrase is an
    exception if ``harmless_texts`` texts or more have it and no toxic one does.
    """
    rows = training_rows(docs, labels, sample_rows)
    by_label = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_tox, n_non = by_label.get(1, 0), by_label.get(0, 0)
    if not n_tox or not n_non:
        return Lexicon({}, tuple(exceptions), (math.log(0.5 / (n_non + 1)), 0.0, 0.0))
    least = max(least_texts, math.ceil(least_share * n_tox))
    counts = _mapped(rows, _candidates, "entry string, toxic int, n long")
    odds = F.log((F.col("tox") + 0.5) / F.lit(n_tox + 1)) - F.log((F.col("non") + 0.5) / F.lit(n_non + 1))
    # a text's candidates are in a hundredth of the toxic texts or more: a hundred texts' worth at most
    strong = counts.where(F.col("tox") >= least).withColumn("w", odds).where(F.col("w") >= least_weight).collect()
    weights = _entries({r["entry"]: (r["tox"], float(r["w"])) for r in strong})
    lexicon = Lexicon(weights, tuple(exceptions))
    automaton = lexicon.automaton()

    def phrases(text: str | None) -> set[str]:
        folded = fold(text)
        found = hits(folded, automaton)
        if not found:
            return set()
        words = [(m.start() - 1, m[0]) for m in re.finditer(r"\S+", folded)]
        return {
            f"{a[1]} {b[1]}" for a, b in zip(words, words[1:], strict=False) if a[0] in found or b[0] in found
        }

    # harmless where several texts have the phrase and none of them is toxic: the sample's texts bound them
    harmless = _mapped(rows, phrases, "entry string, toxic int, n long").where((F.col("tox") == 0) & (F.col("non") >= harmless_texts)).orderBy("entry").collect()
    lexicon = Lexicon(weights, (*exceptions, *(r["entry"] for r in harmless)))
    final = lexicon.automaton()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), final) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1).cast(pa.int32())], names=["a", "b", "y"])

    pdf = rows.select("text", "toxic").mapInArrow(measure, "a double, b double, y int").toPandas()  # at most sample_rows rows of three numbers
    return Lexicon(weights, lexicon.exceptions, _logistic(pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy()))


def _entries(strong: dict[str, tuple[int, float]]) -> dict[str, float]:
    """One entry of each family of candidates that share a beginning, the most telling families first.

    A family starts at its shortest beginning and is narrowed to a longer one
    as long as that keeps nine tenths of the toxic texts, so that an entry
    covers all forms of a stem and no more.  What a chosen entry covers with
    nearly the same odds is no entry of its own.
    """
    weights: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for entry in strong:
        for n in range(5, len(entry)):
            longer.setdefault(entry[:n], []).append(entry)
    for root in sorted(strong, key=lambda e: (-strong[e][0], len(e), e)):
        entry = root
        if root.endswith(" ") and root[:-1] in strong:
            continue
        if any(root[:n] in weights and weights[root[:n]] >= 0.8 * strong[root][1] for n in range(5, len(root) + 1)):
            continue
        while narrower := [e for e in longer.get(entry, ()) if not e.endswith(" ") and strong[e][0] >= 0.9 * strong[root][0]]:
            entry = max(narrower, key=lambda e: (len(e), strong[e][0], e))
        if any(e.startswith(entry) or entry.startswith(e) for e in weights):
            continue
        weights[entry] = strong[entry][1]
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, weighted_hits, matched) of every whole text.

    ``score`` is between 0 and 1, ``matched`` counts the words hit.  Null and
    empty texts have no hits and the curve's base score; repeated rows each get
    a row; an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *T.StructType.fromDDL("score double, weighted_hits double, matched long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            out = []
            for text in b.column(1):
                folded = fold(text.as_py())
                found = hits(folded, automaton)
                total, words = sum(found.values()), folded.count(" ") and len(folded.split())
                x = (math.log1p(total), math.log1p(100 * total / words) if words else 0.0)
                out.append((curve(x, lexicon.curve), total, len(found)))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return narrow.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they were.

    Null and empty texts have the curve's base score; repeated rows stay or go
    together; an empty table gives no rows.
    """
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            yield b.filter(pa.array([curve(features(t.as_py(), automaton), lexicon.curve) < threshold for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
