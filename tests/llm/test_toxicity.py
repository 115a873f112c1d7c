import random
import zlib

import pytest
from pyspark.sql import functions as F

from floorgraph.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1500):
    rng = random.Random(6)
    clean = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    bad, stems = ["grobble", "snarkle", "vilewort"], ["zoxu", "qwaf"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        toxic = i % 8 == 0
        for _ in range(2 + len(words) // 20 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice([*bad, rng.choice(stems) + rng.choice(clean)]))
        if i % 60 == 1:
            words += ["snarkle", "soup"]  # harmless in this phrase
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark, make_docs):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    return docs, labels, toxicity.learn(make_docs(docs), table.where(~toxicity.held_out(F.col("doc_id"))))


def test_entries_are_the_words_and_stems(learned):
    found = set(learned[2].weights)
    assert {" grobble", " vilewort", " zoxu", " qwaf"} <= found
    assert any("snarkle soup" in e for e in learned[2].exceptions)


def test_held_out_documents(spark, make_docs, learned):
    docs, labels, lexicon = learned
    truth = {i: t for i, _, t in labels}
    rows = [r for r in toxicity.score(make_docs(docs), lexicon).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 200
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows) / len(rows) >= 0.97


def test_disguises_and_exceptions():
    lexicon = toxicity.Lexicon({" grobble": 5.0, " idiot": 5.0}, ("grobble soup",), (-3.0, 2.0, 0.5))
    a = lexicon.automaton()
    for text in ("GROBBLE", "gr0bbl3", "you 1d10t", "grоbblе", "gro​bble", "ｇｒｏｂｂｌｅ", "id!ot", "grobbles", "x,grobble."):
        assert toxicity.hits(toxicity.fold(text), a), text
    for text in ("", None, "grobble soup", "ungrobble", "grob ble"):
        assert not toxicity.hits(toxicity.fold(text), a), text
    assert len(toxicity.hits(toxicity.fold("grobble soup grobble"), a)) == 1


def test_longer_texts_need_more():
    lexicon = toxicity.Lexicon({" grobble": 5.0}, (), (-4.0, 1.0, 1.0))
    a = lexicon.automaton()
    short, long = (toxicity.curve(toxicity.features("grobble " + "fine " * n, a), lexicon.curve) for n in (3, 3000))
    assert short > long


def test_odd_rows(make_docs, odd_pairs, learned):
    rows = toxicity.score(make_docs(odd_pairs), learned[2]).collect()
    assert len(rows) == len(odd_pairs) and all(0 <= r.score <= 1 and r.matched == 0 for r in rows)
    assert toxicity.score(make_docs([]), learned[2]).count() == 0


def test_labels_of_one_kind_teach_nothing(spark, make_docs):
    docs = make_docs([(i, f"some text {i}") for i in range(20)])
    for toxic in (0, 1):
        lexicon = toxicity.learn(docs, spark.createDataFrame([(i, 1, toxic) for i in range(20)], LABELS))
        assert toxicity.drop_toxic(docs, lexicon).count() == 20


def test_near_copies_of_one_label_count_once(spark, make_docs):
    words = [f"word{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words), " ".join(words[:40] + [f"other{k}" for k in range(60)])]
    docs, labels = make_docs(list(enumerate(texts))), [(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 0)]
    rows = toxicity.training_rows(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, rows)) == sorted([(texts[0], 0), (texts[2], 1), (texts[3], 0)])


def test_without_labels_nothing_is_toxic(spark, make_docs, odd_pairs):
    lexicon = toxicity.learn(make_docs(odd_pairs), spark.createDataFrame([], LABELS))
    assert all(r.score < 0.5 for r in toxicity.score(make_docs(odd_pairs), lexicon).collect())


def test_conflicting_and_repeated_labels(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, "d e f"), (3, "g h i")])
    rows = [(1, 1, 0), (1, 1, 1), (2, 1, 1), (2, 0, 1), (3, None, None), (None, 1, 1)]
    assert [r.toxic for r in toxicity.training_rows(docs, spark.createDataFrame(rows, LABELS)).collect()] == [1]


def test_filter(make_docs, learned):
    docs, labels, lexicon = learned
    out = toxicity.drop_toxic(make_docs(docs), lexicon)
    assert out.columns == make_docs(docs).columns
    scores = {r.doc_id: r.score for r in toxicity.score(make_docs(docs), lexicon).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, s in scores.items() if s < 0.5)


def test_held_out_is_the_crc(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def auc(scored):
    """Share of (toxic, other) pairs in which the toxic one scores higher, ties half."""
    one, none = ([s for s, y in scored if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in one for b in none) / (len(one) * len(none))


def test_held_out_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    lexicon = toxicity.learn(docs, labels.where(~held))
    rows = toxicity.score(docs, lexicon).join(labels.where(held), "doc_id").select("score", "toxic").collect()
    scored = [(r.score, r.toxic) for r in rows]
    assert sum(y for _, y in scored) > 50 and auc(scored) >= 0.95
    assert sum((s >= 0.5) == y for s, y in scored) / len(scored) >= 0.98


def test_few_toxic_rows_teach_nothing_by_default(spark):
    texts = [(i, f"grumble word{i}", 1) for i in range(3)] + [(10 + i, f"calm word{i}", 0) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    assert toxicity.learn(docs, labels).weights == {}
    found = toxicity.learn(docs, labels, least_texts=2, least_weight=1.0)
    assert any("grumble".startswith(k.strip()) for k in found.weights)
