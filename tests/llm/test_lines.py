import random
from collections import Counter

import numpy as np
import pytest

from floorgraph.llm import line_dedup, mph, shard_index

SPACE = "\t\n\x0b\x0c\r "


def key(line):
    return line.strip(SPACE).translate({i: i + 32 for i in range(65, 91)})


def brute(pairs, least, min_chars=1):
    counts = Counter(k for _, t in pairs for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or counts[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(9)
    pool = ["Copyright 2020", " copyright 2020 ", "é", "É", "", "   ", "\x85x", "A\tb", "line\r"] + [f"line {k}" for k in range(60)]
    return [(i, "\n".join(rng.choice(pool[: rng.randrange(3, 69)]) for _ in range(rng.randrange(1, 12)))) for i in range(120)]


@pytest.mark.parametrize(("least", "min_chars", "per_shard", "cache"), [(10, 1, 1_000_000, None), (10, 1, 3, None), (2, 3, 5, 0), (1, 1, 7, 0)])
def test_same_as_brute_force(make_docs, odd_pairs, monkeypatch, least, min_chars, per_shard, cache):
    if cache is not None:  # beyond a task's cache the probes are sent to the shards
        monkeypatch.setattr(shard_index, "CACHE_BYTES", cache)
    pairs = corpus() + odd_pairs
    docs = make_docs(pairs)
    index = line_dedup.line_index(docs, min_docs=least, min_chars=min_chars, keys_per_shard=per_shard)
    out = line_dedup.dedup_lines(docs, min_docs=least, min_chars=min_chars, index=index)
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept)) for r in out.collect()) == brute(pairs, least, min_chars)


@pytest.mark.parametrize("cache", [None, 0])
def test_keep_mode(make_docs, odd_pairs, monkeypatch, cache):
    if cache is not None:
        monkeypatch.setattr(shard_index, "CACHE_BYTES", cache)
    pairs = corpus() + odd_pairs
    docs = make_docs(pairs)
    out = line_dedup.dedup_lines(docs, keep=True)
    assert out.columns == docs.columns
    rows = out.collect()
    texts = {str(i): t for i, t in pairs}
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or len(r.text) == r.n_chars) for r in rows)
    want = {str(eval(b)[::3]) for b in brute(pairs, 10)}
    assert {str((r.doc_id, r.text or "")) for r in rows} == want
    assert len(rows) == len(pairs) and any(r.text != texts[str(r.doc_id)] for r in rows)


def test_empty_table(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    h = mph.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))


def test_shard_round_trip_and_strangers():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    marks, counts = rng.integers(0, 2**64, len(keys), dtype=np.uint64), rng.integers(1, 500, (len(keys), 2))
    shard = mph.CountShard.load(mph.CountShard.build(keys, marks, counts).dump())
    assert (shard.lookup(keys, marks) == counts).all()
    strangers = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    assert not shard.lookup(strangers, strangers).any()
    assert not shard.lookup(keys, marks + np.uint64(1)).any()


def test_keys_that_share_their_64_bits():
    keys = np.array([5, 7, 5, 9, 5, 7], np.uint64)
    marks = np.array([1, 1, 2, 1, 3, 4], np.uint64)
    counts = np.arange(1, 7)[:, None]
    shard = mph.CountShard.load(mph.CountShard.build(keys, marks, counts).dump())
    assert shard.lookup(keys, marks).tolist() == counts.tolist()
    assert not shard.lookup(np.array([5, 7, 9, 6], np.uint64), np.array([4, 2, 2, 1], np.uint64)).any()


def test_an_index_with_such_keys(spark):
    rows = spark.createDataFrame([(5, 1, 10), (5, 2, 20), (-1, 1, 30), (-1, -1, 40)], "key long, mark long, n long")
    index = shard_index.build_index(rows, ["n"], 2)
    asked = spark.createDataFrame([(5, 2), (5, 1), (-1, -1), (-1, 1), (5, 3)], "key long, mark long")
    assert {(r.key, r.mark): r.counts[0] for r in index.routed(asked, "mark").collect()} == {(5, 2): 20, (5, 1): 10, (-1, -1): 40, (-1, 1): 30, (5, 3): 0}


def test_an_index_serves_its_threshold_and_higher_ones(make_docs):
    pairs = [(i, "\n".join(f"line {k}" for k in range(1, 13) if i < k)) for i in range(12)]  # line k in k documents
    index = line_dedup.line_index(make_docs(pairs), min_docs=6)
    for least in (6, 9):
        out = line_dedup.dedup_lines(make_docs(pairs), min_docs=least, index=index)
        assert sorted(map(str, out.collect())) == sorted(map(str, line_dedup.dedup_lines(make_docs(pairs), min_docs=least).collect()))
    with pytest.raises(ValueError, match="fewer than 6"):
        line_dedup.dedup_lines(make_docs(pairs), min_docs=5, index=index)
