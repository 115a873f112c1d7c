"""Radix selection and the source audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import pytest

from floorgraph.llm import divergence
from floorgraph.llm.radix_select import top_ranked

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows, k):
    groups = defaultdict(list)
    for g, v, i in rows:
        if v is not None and i is not None:
            groups[g].append((v, i))
    return Counter((g, v, i, n + 1) for g, held in groups.items() for n, (v, i) in enumerate(sorted(held, key=lambda r: (-r[0], r[1].encode()))[:k]))


@pytest.mark.parametrize("tie_rows", [1, 1000])
def test_radix_selection(spark, tie_rows):
    rng = random.Random(1)
    rows = [("wide", rng.randrange(1 << 60), f"w{i}") for i in range(300)]
    rows += [("ties", 7, "same start " * 3 + rng.choice(["", "a", "é", "日", "zz"]) + str(i)) for i in range(300)] + [("ties", 9, "first")]
    rows += [("prefix", 1, "a" * n) for n in range(1, 60)] + [("copies", 3, "one")] * 40 + [("copies", 3, "two")] * 3
    rows += [(None, 2, "null group"), ("few", 0, "zero"), ("few", 0, ""), ("null", None, "x"), ("null", 5, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v long, i string")
    for k in (1, 7, 45):
        out = Counter((r.g, r.v, r.i, r["rank"]) for r in top_ranked(df, ["g"], "v", "i", k, tie_rows).collect())
        assert out == ranked(rows, k)
    assert top_ranked(df.limit(0), ["g"], "v", "i", 3).count() == 0


def audited(docs, least, top):
    """The definition, over every term of every group."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= least}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        total = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = sorted(((sum(gap(share(c, t), share(o, t)) for t in kept), other) for other, o in counts.items() if other != s), key=lambda r: (-r[0], r[1].encode()))
            terms = sorted(((gap(share(c, t), share(total, t)), t) for t in kept if c[t] and share(c, t) > share(total, t)), key=lambda r: (-r[0], r[1].encode()))[:top]
            out |= {(lang, s, part, item, v, n + 1) for part, rows in (("pair", pairs), ("term", terms)) for n, (v, item) in enumerate(rows)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("block", "cell"), [(512, 100_000), (2, 50)])
def test_audit_by_definition(spark, monkeypatch, block, cell):
    monkeypatch.setattr(divergence, "HELD_TERMS", 40)
    rng = random.Random(2)
    words = ["The", "the", "été", "ÉTÉ", "日本", "x", "don't", "a1b2", "Zebra", *[f"w{chr(97 + i)}" for i in range(20)]]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "é", None, "", "s4"])) for _ in range(160)]
    docs += [(None, "en", "empty"), ("", "none", "a"), ("once", "none", "b"), ("hot " * 5000, "en", "s1"), ("hot " * 5000, "en", "s1")]
    df = spark.createDataFrame([(k, *d, 1) for k, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term int")
    keep = divergence.pair_gaps
    monkeypatch.setattr(divergence, "pair_gaps", lambda rows, groups: keep(rows, groups, block, cell))
    assert found(divergence.audit(df, 4, 3)) == audited(docs, 4, 3)


def test_audit_of_no_documents_and_odd_ones(make_docs, odd_pairs):
    assert divergence.audit(make_docs([])).count() == 0
    docs = make_docs(odd_pairs)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert found(divergence.audit(docs, 2, 10)) == audited(rows, 2, 10)
