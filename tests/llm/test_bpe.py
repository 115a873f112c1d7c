import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from floorgraph.llm import bpe_trie
from floorgraph.llm.queries import VOCABULARY, digest_tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(3)
    latin = [chr(i) for i in range(0x250)]
    wide = [*latin, *"ΣςİẞſK日本語😀½²٣̣́　 ‍﻿ﬁ"]
    mixed = [*"'''sdtrevm <|>", *"eta " * 9]
    return ["".join(rng.choice(rng.choice((latin, wide, mixed))) for _ in range(rng.randrange(80))) for _ in range(4000)]


def test_same_ids_and_text_as_the_library(library):
    sample = [*texts(), "", "  ", "<|endoftext|>", "a<|startoftext|>b <|end", "it's we'll I'd", "x" * 9000, "ab" * 9000, "the The THE", "0123456789"]
    c = bpe_trie.Codec(VOCABULARY)
    ours = list(c.encode(sample))
    theirs = [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    assert ours == theirs
    assert [c.decode(i) for i in ours] == [library.decode(i, skip_special_tokens=False) for i in theirs]


def test_small_cache_and_blocks_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe_trie, "BLOCK_CHARS", 500)
    sample = texts()[:500]
    assert list(bpe_trie.Codec(VOCABULARY).encode(sample)) == [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]


def test_rows(spark, make_docs, odd_pairs, library):
    rows = bpe_trie.encode_decode(make_docs(odd_pairs), VOCABULARY).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in odd_pairs)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe_trie.encode_decode(make_docs([]), VOCABULARY).count() == 0


def test_digests_are_of_the_ids():
    n, ids, decoded = digest_tokens([5, 77], "a b</w>")
    assert (n, ids, decoded) == (2, hashlib.sha256(b"5 77").hexdigest(), hashlib.sha256(b"a b</w>").hexdigest())


def test_keep_replaces_the_text(make_docs, odd_pairs, library):
    docs = make_docs(odd_pairs)
    out = bpe_trie.encode_decode(docs, VOCABULARY, keep=True)
    assert out.columns == docs.columns
    want = sorted(str((i, None if t is None else library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False))) for i, t in odd_pairs)
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == want
