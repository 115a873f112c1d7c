import random

from floorgraph.llm import decontaminate as dc


def brute(docs, items, n=5, threshold=0.8):
    out = []
    for doc, text in docs:
        words = dc.words_of(text)
        have = {k: {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} for k in range(1, n + 1)}
        for item, wanted in set(items):
            own, k = dc.shingles(dc.words_of(wanted), n), min(n, len(dc.words_of(wanted)))
            if own and len(own & have[k]) >= threshold * len(own) - 1e-9:
                out.append((doc, item, len(own & have[k]), len(own)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 70)))) for k in range(40)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 900))]
        for _ in range(rng.randrange(3)):
            planted = rng.choice(items)[1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 6))):  # edits that may or may not fall below the threshold
                planted[rng.randrange(len(planted))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = planted
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else ", ".join(words)))
    return docs, items


def rows(df):
    return sorted(((r.doc_id, r.item_id, r.matched, r.n_shingles) for r in df.collect()), key=str)


def test_same_as_brute_force_in_one_pass_and_in_blocks(spark, make_docs):
    docs, items = corpus()
    items += [(90, items[0][1]), (91, None), (92, ""), (93, "!?"), items[3]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [(i, t) for i, t in items if t])
    assert len(want) > 40 and any(m < n for _, _, m, n in want)
    assert rows(dc.contained_items(make_docs(docs), bench)) == want
    assert rows(dc.contained_items(make_docs(docs), bench, block_bytes=2000)) == want


def test_odd_documents_and_items(spark, make_docs, odd_pairs):
    items = [(1, "quick brown fox jumps over the lazy"), (2, "same"), (3, "the"), (4, "word1 word2 word3 word4 word5 word6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(dc.contained_items(make_docs(odd_pairs), bench)) == brute(odd_pairs, items)
    assert {(5, 4), (1, 3), (7, 3)} <= {(d, i) for d, i, *_ in brute(odd_pairs, items)}  # short items inside longer documents too
    assert dc.contained_items(make_docs([]), bench).count() == 0
    assert dc.contained_items(make_docs(odd_pairs), bench.limit(0)).count() == 0


def test_filter_keeps_the_rest_and_the_columns(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    gone = {d for d, *_ in brute(docs, items)}
    out = dc.drop_contaminated(make_docs(docs), bench, block_bytes=2000)
    assert out.columns == make_docs(docs).columns
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _ in docs if d not in gone]
