import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from floorgraph.llm import lm_score, shard_index


def brute(rows, mix=0.7):
    words = [[w.decode() for w in lm_score.words_of(t)] for _, t, _ in rows]
    size = len({w for ws in words for w in ws})
    mapped = [["<s> ", *ws] for ws in words]
    models = []
    for own in (lambda k: rows[k][2], lambda k: True):
        pairs = Counter(p for k, ws in enumerate(mapped) if own(k) for p in zip(ws, ws[1:], strict=False))
        first, second = Counter(), Counter()
        for (v, w), c in pairs.items():
            first[v] += c
            second[w] += c
        models.append((pairs, first, second, sum(second.values())))
    out = []
    for (i, _, _), ws in zip(rows, mapped, strict=True):
        loss = []
        for pairs, first, second, m in models:
            parts = [-math.log((1 - mix) * (second[w] + 1) / (m + size) + (mix * pairs[v, w] / first[v] if first[v] else 0)) for v, w in zip(ws, ws[1:], strict=False)]
            loss.append(sum(parts) / len(parts) if parts else None)
        out.append((i, len(ws) - 1, *loss))
    return sorted(out, key=str)


@pytest.mark.parametrize("cache", [None, 0])
def test_same_as_brute_force(make_docs, odd_pairs, monkeypatch, cache):
    if cache is not None:  # beyond a task's cache losses are joined
        monkeypatch.setattr(shard_index, "CACHE_BYTES", cache)
    rng = random.Random(3)
    pool = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(4000)]
    pairs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(90)))) for i in range(200)] + odd_pairs
    docs = make_docs(pairs)
    rows = [(r.doc_id, r.text, r.source == "src1") for r in docs.collect()]
    out = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lm_score.score(docs, F.col("source") == "src1").collect()), key=str)
    want = brute(rows)
    assert len(out) == len(want)
    for a, b in zip(out, want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        assert a[2] is None or (math.isclose(a[2], b[2], rel_tol=1e-9) and math.isclose(a[3], b[3], rel_tol=1e-9))
    assert lm_score.score(make_docs([]), F.lit(True)).count() == 0


def test_score_prefers_the_target(make_docs):
    pairs = [(i, "alpha beta gamma delta" if i % 4 == 1 else "one two three four") for i in range(80)]
    docs = make_docs(pairs)
    out = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") % 4 == 1).collect()}
    assert out[1] < 0 < out[2]


def test_nothing_is_exchanged_for_scores_beyond_a_cache(make_docs, monkeypatch):
    rng = random.Random(5)
    docs = make_docs([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for i in range(300)])
    target = F.col("source") == "src1"
    want = sorted(map(tuple, lm_score.score(docs, target).collect()))
    monkeypatch.setattr(shard_index, "CACHE_BYTES", 0)
    monkeypatch.setattr(lm_score, "_WIDE_BYTES", 3000)  # several blocks of a few documents
    out = lm_score.score(docs, target)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted(map(tuple, out.collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(got, want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))
