"""The registered queries over the driver's tables, and the pipeline stage by stage."""

import os
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from floorgraph.llm import queries, toxicity
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_lines import brute as line_brute
from tests.llm.test_simhash import exact_groups, plain_fingerprint, plain_groups

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
NAMES = {re.match(r"op(\d+)_", n)[1]: n for n in queries.queries()}


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(map(int, NAMES)) == list(range(1, 14))
    assert queries.queries().keys() | {"pipeline"} <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, tables, name):
    df = queries.queries()[name](spark, sf_dir)
    cursor = tables.execute(queries.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    order, places = sorted(df.columns), [list(kinds).index(c) for c in sorted(kinds)]
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert ours == Counter(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())


def test_op1(spark, sf_dir):
    rows = queries.op1_hilbert_shards(spark, sf_dir).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(docs_of(spark, sf_dir)) and max(counts.values()) - min(counts.get(k, 0) for k in range(40)) <= 1
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_op2(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in docs_of(spark, sf_dir):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, *queries.digest_tokens(ids, library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.op2_trie_bpe(spark, sf_dir).collect()} == want


def test_op4(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    prints = [plain_fingerprint(t) for _, t in docs]
    label = plain_groups(prints)
    least = {g: min(docs[j][0] for j in range(len(docs)) if label[j] == g) for g in set(label)}
    want = {(i, f"{prints[k]:016x}", least[label[k]]) for k, (i, _) in enumerate(docs)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op4_simhash_groups(spark, sf_dir).collect()} == want


def test_op9(spark, sf_dir):
    rows = queries.op9_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(docs_of(spark, sf_dir))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_op9_held_out_accuracy(spark):
    """On labelled rows that nothing was learned from: the share of pairs of a toxic and a clean row in the right order, and of right decisions."""
    sf = os.environ.get("TEST_LARGE_SF_DIR", "/root/testdata/sf0.1")
    if not os.path.isdir(sf):
        pytest.skip("the larger tables are not there")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = queries.op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert set(rows["toxic"]) == {0, 1} and len(rows) > 500
    rank, toxic = rows["score"].rank(), rows["toxic"] == 1  # ties count half
    n = int(toxic.sum())
    auc = (rank[toxic].sum() - n * (n + 1) / 2) / (n * (len(rows) - n))
    right = (rows["predicted"] == rows["toxic"]).mean()
    print(f"AUC {auc:.3f}, {right:.3f} right of {len(rows)}, {n} toxic")
    assert auc >= 0.95 and right >= 0.97


def test_stages_follow_the_order():
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]


def test_pipeline_stage_by_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)

    scores = toxicity.score(docs, toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))
    clean = {r.doc_id for r in scores.where("score < 0.5").collect()}
    kept = stage["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    pairs = [p for p in docs_of(spark, sf_dir) if p[0] in clean]

    lines = stage["line_dedup"](spark, kept, sf_dir)
    want = {eval(s)[0]: eval(s)[3] for s in line_brute(pairs, 10)}
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == want
    pairs = sorted(want.items())

    groups = stage["simhash_near_dedup"](spark, lines, sf_dir)
    label = exact_groups([t for _, t in pairs])
    first = {pairs[k][0] for k in set(label)}
    assert groups.columns == docs.columns and {r.doc_id for r in groups.collect()} == first
    pairs = [p for p in pairs if p[0] in first]

    free = stage["decontamination"](spark, groups, sf_dir)
    leaked = {d for d, *_ in contained(pairs, items)}
    assert free.columns == docs.columns and {r.doc_id for r in free.collect()} == first - leaked

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in pairs:
        if i not in leaked:
            ids = library.encode(t, add_special_tokens=False).ids
            want.add((i, *queries.digest_tokens(ids, library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_pipeline_on_empty_and_odd_documents(spark, make_docs, odd_pairs, sf_dir):
    for pairs in ([], odd_pairs):
        docs = make_docs(pairs)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "bpe" or out.columns == docs.columns
            docs = out
        rows = docs.collect()
        assert (len(rows) > 0) == bool(pairs)
        left = [(r.doc_id, r.ids_sha256) for r in rows]
        assert len(left) == len(set(left)) and (not pairs or {1, 5, 8, 9, 10} - {r.doc_id for r in rows} == {9})  # of "same" the id -3 stays
