"""Audit of how the sources of a language differ: the terms that mark a source, and the distance of every two sources.

Terms are runs of letters.  Of each language those that enough of its documents
hold are kept, and every source gets a smoothed share of each kept term, in
billionths, all in integers.  A term marks a source by the share that it has
there beyond the language's own, and the highest of each source are found by
radix selection (:mod:`floorgraph.llm.radix_select`).

The distance of two sources sums over all kept terms, though most sources lack
most terms.  A term that a source lacks has the source's baseline share, so the
sum starts as that of two baselines and is corrected where a count is not
zero: once for each count that occurs in a source against the other's baseline
(all terms of one count are one row), and once for each term that both have.
The latter is done by tasks that hold blocks of sources and of terms and send
on one sum for each pair of sources, not one row for each shared term.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.llm.common import written
from floorgraph.llm.radix_select import top_ranked

#: Entries that a task holds before it sends its counts on.
HELD_TERMS = 300_000
#: Sources of a block and rows of a cell that a task compares at once.
BLOCK_SOURCES, CELL_ROWS = 512, 100_000
#: Letters to lower case, bytes of other characters as they are, all else to blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PARTIAL = "lang string, source string, term binary, n long, n_docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, as far as the task holds them; an empty term stands for the group itself."""
    tf, df, held = defaultdict(Counter), defaultdict(Counter), 0

    def sent() -> pa.RecordBatch:
        groups = [(g, t, n, df[g][t]) for g, c in tf.items() for t, n in c.items()]
        cols = list(zip(*groups, strict=True)) if groups else [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        values = ([g[0] for g in cols[0]], [g[1] for g in cols[0]], *cols[1:])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["lang", "source", "term", "n", "n_docs"])

    for batch in batches:
        langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
        for group, text in zip(zip(langs.to_pylist(), sources.to_pylist(), strict=True), texts, strict=True):
            words = text.as_py().translate(_LETTERS).split()
            mine = tf[group]
            before = len(mine)
            mine.update(words)
            mine[b""] += 0
            df[group].update(set(words))
            held += len(mine) - before
            if held > HELD_TERMS:
                yield sent()
                tf.clear(), df.clear()
                held = 0
    yield sent()


def term_counts(docs: DataFrame, least_docs: int = 10, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, lang_n, leads): counts of the kept terms that a group has, their counts in the language.

    Exactly one row of each kept term of a language ``leads``.  Every group has a
    row with an empty term and no counts.  One exchange, of what tasks counted.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(blank("lang"), blank("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    partial = texts.mapInArrow(_counted, _PARTIAL).withColumn("term", F.col("term").cast("string"))
    # dealt by language and term, which serves the groups' sums and the language's
    own = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    of_term = Window.partitionBy("lang", "term")
    both = own.select("*", F.sum("n").over(of_term).alias("lang_n"), F.sum("n_docs").over(of_term).alias("_docs"), F.row_number().over(of_term.orderBy("source")).alias("_at"))
    kept = both.where((F.col("_docs") >= least_docs) | (F.col("term") == ""))
    return kept.select("lang", "source", "term", "n", "lang_n", ((F.col("_at") == 1) & (F.col("term") != "")).alias("leads"))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(1e9 (n + 2) / (total + 2 size)), exactly; 1 for no terms at all."""
    whole = lambda c: c.cast("decimal(19,0)")
    exact = F.call_function("div", whole(n + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), whole(total + 2 * size))
    return F.when(size > 0, 1 + exact).otherwise(F.lit(1)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def groups_of(counts: DataFrame) -> DataFrame:
    """(lang, source, place, total, lang_total, size, base): every group, numbered within its language, with its share of a term that it lacks."""
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("leads").cast("long")).alias("size"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return own.join(langs, "lang").withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("size")))


def shared_terms(lang: str, rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """Corrections of the pairs of sources in a cell, summed over the terms that both have."""
    rows = rows.sort_values(["term", "place"], kind="stable")
    term, place = pd.factorize(rows["term"])[0], rows["place"].to_numpy(np.int64)
    p, base = rows["p"].to_numpy(np.int64), rows["base"].to_numpy(np.int64)
    own, local = np.unique(place, return_inverse=True)
    sums = np.zeros(len(own) ** 2, np.int64)
    ends = np.searchsorted(term, term, side="right")
    across = rows["low"].iloc[0] != rows["high"].iloc[0]
    at = np.arange(len(rows))
    for step in range(1, int((ends - at).max())):
        i = at[ends > at + step]
        j = i + step
        if across:  # pairs within a block belong to the block's own cell
            i, j = (x[place[i] // block != place[j] // block] for x in (i, j))
        value = _gap(p[i], p[j]) - _gap(p[i], base[j]) - _gap(base[i], p[j]) + _gap(base[i], base[j])
        np.add.at(sums, local[i] * len(own) + local[j], value)
    found = np.flatnonzero(sums)
    return pd.DataFrame({"lang": lang, "a": own[found // len(own)], "b": own[found % len(own)], "value": sums[found]})


def pair_gaps(rows: DataFrame, groups: DataFrame, block: int = BLOCK_SOURCES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(lang, a, b, value): the gap of every two groups of a language, by place, summed over all its kept terms.

    ``rows`` (lang, term, place, p, base) are the groups' terms, a written table.
    The result has a row for each ordered pair, as many as a language has of them.
    """
    buckets = max(1, -(-rows.count() // cell_rows))
    blocks = groups.groupBy("lang").agg((F.floor(F.max("place") / block)).alias("_last")).withColumnRenamed("lang", "_lang")
    mine = F.floor(F.col("place") / block)
    cells = rows.join(blocks, F.col("lang") == F.col("_lang")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    cells = cells.select("lang", "term", "place", "p", "base", F.least(mine, "_other").alias("low"), F.greatest(mine, "_other").alias("high"), F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    schema = "lang string, a long, b long, value long"
    both = cells.groupBy("lang", "low", "high", "bucket").applyInPandas(lambda key, pdf: shared_terms(key[0], pdf, block), schema)
    other = groups.select(F.col("lang").alias("_lang"), F.col("place").alias("b"), F.col("base").alias("_base"), "size")
    left = groups.select("lang", F.col("place").alias("a"), "base").join(other, (F.col("lang") == F.col("_lang")) & (F.col("a") != F.col("b")))
    none = left.select("lang", "a", "b", (F.col("size") * gap(F.col("base"), F.col("_base"))).alias("value"))
    alike = rows.groupBy("lang", F.col("place").alias("a"), "p", "base").agg(F.count("*").alias("n"))
    against = alike.join(other, (F.col("lang") == F.col("_lang")) & (F.col("a") != F.col("b")))
    one = against.select("lang", "a", "b", (F.col("n") * (gap(F.col("p"), F.col("_base")) - gap(F.col("base"), F.col("_base")))).alias("value"))
    one = one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = none.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part "pair": the language's other sources by distance, all of them.  Part
    "term": the ``top`` terms that the source has beyond the language's share.
    Null texts, languages and sources count as empty strings; a null and an
    empty source are one.  A repeated row is a document of its own.  A language
    without kept terms has distances of zero and no terms.  Texts are taken
    whole; an empty table gives no rows; other columns are ignored.
    """
    counts = written(term_counts(docs, least_docs, text_col), "terms")
    groups = written(groups_of(counts), "sources")
    near = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    rows = counts.where("term <> ''").join(near, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    rows = rows.select(
        "lang", "source", "term", "place", "base",
        share(F.col("n"), F.col("total"), F.col("size")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q"),
    )
    rows = written(rows, "shares")
    terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = top_ranked(terms, ["lang", "source"], "value", "item", top)
    gaps = pair_gaps(rows.drop("source", "q"), groups)
    name = lambda place, as_: groups.select(F.col("lang").alias(f"_{as_}_lang"), F.col("place").alias(f"_{as_}"), F.col("source").alias(as_))
    for place, as_ in (("a", "source"), ("b", "item")):
        gaps = gaps.join(name(place, as_), (F.col("lang") == F.col(f"_{as_}_lang")) & (F.col(place) == F.col(f"_{as_}")))
    by_source = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = gaps.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(by_source))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
