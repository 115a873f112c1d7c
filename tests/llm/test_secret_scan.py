"""The combined automaton against one leftmost search for each rule."""

import hashlib
import random
import re

import pytest

from floorgraph.llm import queries, secret_scan
from floorgraph.llm.secret_scan import BASE_RULES, MORE_RULES, Rule, compiled

BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)
PLAIN = BASE + tuple((r.kind, r.pattern, lambda m, r=r: len(m[0]) >= r.least) for r in MORE_RULES)
PIECES = [
    "password", "PassWD", "secret", "token", "api_key", "ApiKey", "APIKEY", '"', "'", " ", "   ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "日", "\n", ".", "eyJ", "eyJhbGciOiJIUzI1NiJ9",
    "ghp_", "a" * 40, "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "z", ",", "deadbeef", "_", "-", "==", "passwd=", "tok", "\x00", "\U0001f600", "K", "K",
]


@pytest.fixture(scope="module")
def scanner():
    return compiled(BASE_RULES + MORE_RULES)


def brute(text, rules=PLAIN):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, keep) in enumerate(rules) for m in re.finditer(pattern, text) if keep(m))


def test_random_texts(scanner):
    rng = random.Random(1)
    for _ in range(600):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        found = scanner.spans([t.encode() for t in texts])
        assert [found.get(k, []) for k in range(len(texts))] == [brute(t) for t in texts]


def test_whole_blocks_side_by_side(scanner):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" word. ", "\n", ""]) for _ in range(rng.randrange(3000))) for _ in range(40)] + ["a" * 200_000 + " " + "9" * 100_000, "x" * 300_000]
    found = scanner.spans([t.encode() for t in texts])
    assert [found.get(k, []) for k in range(len(texts))] == [brute(t) for t in texts]


def test_the_automaton_is_minimal():
    table, marks = secret_scan.minimal(*secret_scan._subsets(*_nfa("(?:a|b)(?:a|b)|c(?:b|a)"), anchored=True))
    assert len(marks) == 4  # begin, after one, after two, dead


def _nfa(pattern):
    parts = secret_scan._parser.parse(pattern)
    nfa = secret_scan._Nfa()
    nfa.state()
    end = nfa.add(parts, 0, parts.state.flags)
    return nfa, secret_scan._classes([nfa]), 1, {end: 1}


@pytest.mark.parametrize("pattern", ["a", "ab?c*", "abcde|c", "a(?:bc)?", "x*", r"a\nb", "é"])
def test_rules_that_one_pass_cannot_tell_apart_are_refused(pattern):
    if pattern == "ab?c*":
        compiled((Rule("fine", pattern + "x"),))
        return
    with pytest.raises(ValueError):
        compiled((Rule("bad", pattern),))


def test_odd_documents(make_docs, odd_pairs):
    pairs = [*odd_pairs, (20, 'é token = "abcdef" AKIA' + "Z9" * 9), (20, "0" * 24)]
    out = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secret_scan.scan(make_docs(pairs)).collect()), key=str)
    kinds = [k for k, *_ in PLAIN]
    assert out == sorted(((i, [(kinds[k], a, b) for a, k, b in brute(t or "")]) for i, t in pairs), key=str)
    assert secret_scan.scan(make_docs([])).count() == 0


def test_op13(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for i, text in docs:
        listed = lambda spans: ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in spans)
        every, base = brute(text or ""), brute(text or "", BASE)
        counts = [sum(k == j for _, k, _ in base) for j in range(3)]
        want.add((i, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
    assert {tuple(r) for r in queries.op13_secret_scan(spark, sf_dir).collect()} == want
