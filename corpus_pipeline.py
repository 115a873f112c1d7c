"""A corpus pipeline over ``documents``: each stage applies one operator of floorgraph.llm.

Every stage but the last returns the columns of ``documents``; each is written
as Parquet to the shared folder and read again as the next one's input.

For every stage: an empty table gives no rows, null texts are kept as nulls
(one of them after the near-copy stage, where all texts without words are one
group), very long texts are taken whole, columns beside ``doc_id`` and ``text``
pass through whatever their names, and null ids are ids like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floorgraph.llm import bpe_trie, decontaminate, line_dedup, simhash, toxicity
from floorgraph.llm.common import bounded_batches, table, written
from floorgraph.llm.queries import VOCABULARY, digest_tokens


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the lexicon is learned from the labelled rows not held out.

    Repeated rows score alike and stay or go together.  Without labels of both kinds none goes.
    """
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out(labels["doc_id"])))
    return toxicity.drop_toxic(docs, lexicon)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; ``n_chars`` counted anew.  A row is a document, also a repeated one."""
    bounded_batches(spark)
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.8 or more, that of the smallest id.

    Of ties (repeated rows, texts of one id) one stays; texts that are unlike stay under whatever id.
    """
    bounded_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; texts without words hold none."""
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row; a null text counts as empty."""
    bounded_batches(spark)
    return bpe_trie.encode_decode(docs, VOCABULARY, finish=digest_tokens, fields="n_tokens long, ids_sha256 string, decoded_sha256 string")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: The stages learn weights, hash with XXH64 and encode with BPE, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: a row for each document that is left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
