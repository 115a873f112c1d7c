"""BPE encoding over a trie of distinct words, and decoding.

The vocabulary file's rules (normalisation, splitting, merges) are those of the
tokenizers library; the encoding itself is done here.  The distinct words of a
block of documents are laid into a trie of symbols, and a depth-first pass
gives every node the *last token* of the encoding of its prefix.  The encoding
of a prefix ends in token t exactly if t is a suffix of the prefix and may
follow the last token of the prefix that remains before t, so a node needs
only the states of its ancestors, and a prefix that many words share is
encoded once.  A word's ids are read back along its last tokens.

Row-local: no exchange, and memory is bounded by one block of text plus a word
cache of fixed size.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer


#: Characters of text that are split and encoded together.
BLOCK_CHARS = 4_000_000
#: Distinct words whose encodings a worker keeps in each of two generations.
CACHE_WORDS = 120_000


def byte_alphabet() -> list[str]:
    """The printable character of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Symbols, tokens and merges of a BPE file whose merges are listed in rank order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.specials.items()}
        alphabet, end = byte_alphabet(), model["end_of_word_suffix"]
        self.inner = [self.ids[c] for c in alphabet]
        self.final = [self.ids[c + end] for c in alphabet]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.ranks[left, right] = (rank, made)
            self.parts[made], self.rank_of[made] = (left, right), rank
            self.symbols[made] = self.symbols[left] + self.symbols[right]
        self._automaton()
        self._pairs: dict[int, bool] = {}

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(
                ((self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.ranks[parts[i], parts[i + 1]][1]]
        return parts

    def may_follow(self, pair: int) -> bool:
        """Whether BPE leaves the neighbours left << 16 | right as they are.

        Seen from their border, each token is taken apart in the reverse order
        of its merges; they stay neighbours unless two pieces that face each
        other merge before the pieces that each of them is due to join.
        """
        if len(self._pairs) > 1_000_000:
            self._pairs.clear()
        left, right = pair >> 16, pair & 0xFFFF
        known = self._pairs[pair] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        never = len(self.ranks)
        # pieces at the border with the rank of the merge that swallows them, outermost first
        one, two = self._border(left, 1), self._border(right, 0)
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = one[i], two[j]
            merge = self.ranks.get((a, b))
            # the left piece's own merge comes later in the text only on its left, so on equal ranks it wins
            if merge is not None and merge[0] < min(until_a, until_b):
                return False
            if merge is not None and (merge[0] == until_b < until_a):
                return False
            made_a = self.rank_of.get(a, -1)
            made_b = self.rank_of.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a >= made_b:
                i += 1
            else:
                j += 1
            if max(i, j) > never:
                raise AssertionError("endless border")

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token, its part at this side, that part's part and so on, each with the rank of the merge that swallows it."""
        out, until = [(token, len(self.ranks))], 0
        while (parts := self.parts.get(token)) is not None:
            until = self.rank_of[token]
            token = parts[side]
            out.append((token, until))
        return out

    def _automaton(self) -> None:
        """Suffix automaton of the tokens' symbol strings: per state the longest token that ends there."""
        self.goto: list[dict[int, int]] = [{}]
        ends = [-1]
        for token, symbols in self.symbols.items():
            if self.merged(symbols) != [token]:
                continue  # no encoding can hold it
            state = 0
            for s in symbols:
                if s not in self.goto[state]:
                    self.goto[state][s] = len(self.goto)
                    self.goto.append({})
                    ends.append(-1)
                state = self.goto[state][s]
            ends[state] = token
        self.fail = [0] * len(self.goto)
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(self.goto)
        depth = [0] * len(self.goto)
        queue = [0]
        for state in queue:
            for s, to in self.goto[state].items():
                depth[to] = depth[state] + 1
                self.fail[to] = self.step(self.fail[state], s) if state else 0
                own = ((ends[to], depth[to]),) if ends[to] >= 0 else ()
                self.suffixes[to] = own + self.suffixes[self.fail[to]]
                queue.append(to)

    def step(self, state: int, symbol: int) -> int:
        goto, fail = self.goto, self.fail
        while state and symbol not in goto[state]:
            state = fail[state]
        return goto[state].get(symbol, 0)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each distinct word, in order, by one trie over all of them.

        The words are inserted in sorted order, so the nodes are made in
        depth-first order and each gets its state from its ancestors at once.
        Of a node are kept the automaton's state, the last token of its
        prefix's encoding and the token's length; the current path is a stack
        of them by depth, and what the next word does not share is cut off.
        """
        inner, final, goto, fail, step = self.inner, self.final, self.goto, self.fail, self.step
        suffixes, may_follow, pairs = self.suffixes, self.may_follow, self._pairs
        states, lasts, sizes = [0], [-1], [0]
        before, known = b"", 0
        out: list[list[int]] = [[]] * len(words)
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            end = len(word) - 1
            shared, most = 0, known if known < end else end  # the last symbol of a word is a leaf of its own
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], lasts[shared + 1 :], sizes[shared + 1 :]
            state, depth = states[shared], shared
            while depth <= end:
                symbol = inner[word[depth]] if depth < end else final[word[depth]]
                depth += 1
                to = goto[state].get(symbol)
                state = step(fail[state], symbol) if to is None else to
                for token, n in suffixes[state]:
                    if n == depth:
                        break
                    pair = lasts[depth - n] << 16 | token
                    ok = pairs.get(pair)
                    if ok or (ok is None and may_follow(pair)):
                        break
                else:
                    raise AssertionError("a prefix has no last token")
                states.append(state)
                lasts.append(token)
                sizes.append(n)
            ids, left = [], depth
            while left:
                ids.append(lasts[left])
                left -= sizes[left]
            ids.reverse()
            out[at] = ids
            before, known = word, end
        return out


class _Encodings(dict):
    """Ids by word in two generations: what is asked for again moves over from the older one, the rest goes with it.

    A word in neither gets an empty list, to be filled, and is noted as new.
    """

    def __init__(self, specials: dict[str, int], older: dict[str, list[int]]):
        super().__init__((s, [i]) for s, i in specials.items())
        self.older, self.new = dict(older), []

    def __missing__(self, word: str) -> list[int]:
        ids = self.older.get(word)
        if ids is None:
            ids = []
            self.new.append(word)
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of whole texts for one vocabulary file."""

    #: Letters whose normal form, case and class every Unicode version agrees on.
    _simple = regex.compile("[^\x00-ɏ]")
    _words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.vocab.specials)) + ")")
        self.cache = _Encodings(self.vocab.specials, {})

    def split(self, text: str) -> list[str]:
        """Words of a text, special tokens among them as themselves."""
        if "<|" in text:
            return [w for part in self._special.split(text) for w in ([part] if part in self.vocab.specials else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not self._simple.search(text):
            # a word that spells a special token cannot arise: it would have been split off
            return self._words.findall(text.lower())
        norm, pre = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        pieces = (bytes(self.byte_of[c] for c in piece) for piece, _ in pre(norm(text)))
        return [p.decode("utf-8") for p in pieces]

    def encode_block(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = _Encodings(self.vocab.specials, self.cache)
        cache, collects = self.cache, gc.isenabled()
        of = cache.__getitem__
        gc.disable()  # millions of lists and no cycles among them
        try:
            split = [list(map(of, self.split(t))) for t in texts]
            new, cache.new = cache.new, []
            for w, ids in zip(new, self.vocab.encode_words([w.encode("utf-8") for w in new]), strict=True):
                cache[w] += ids  # in place: the texts above hold this very list
        finally:
            if collects:
                gc.enable()
        for encodings in split:
            yield list(chain.from_iterable(encodings))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        block, chars = [], 0
        for text in texts:
            block.append(text)
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, chars = [], 0
        yield from self.encode_block(block)

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids, joined as a file without a decoder has them: by single spaces."""
        return " ".join(map(self.vocab.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file, so that tasks share its word cache."""
    return Codec(path)


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    finish: Callable[[list[int], str], tuple] = lambda ids, text: (ids, text),
    fields: str = "ids array<int>, decoded string",
    keep: bool = False,
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return what ``finish`` makes of both.

    By default the rows are (doc_id, ids, decoded).  ``finish`` maps the ids
    and the decoded text of one document to the columns in ``fields``, so a
    digest needs no transfer of the ids.  ``keep`` returns the input's columns
    with the decoded text in place of the text instead.  Null texts encode as
    the empty text (no ids, empty decoded text; ``keep`` leaves them null);
    repeated rows each get a row; an empty table gives no rows; other columns
    are ignored or, with ``keep``, returned unchanged.  The vocabulary's path
    must be readable on every executor.
    """
    if keep:
        schema = docs.schema
        index = docs.columns.index(text_col)

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = codec(vocabulary)
            for batch in batches:
                texts = batch.column(index).to_pylist()
                decoded = [None if t is None else c.decode(ids) for t, ids in zip(texts, c.encode([t or "" for t in texts]), strict=True)]
                columns = [pa.array(decoded, pa.string()) if k == index else x for k, x in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return docs.mapInArrow(rewrite, schema)

    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *T.StructType.fromDDL(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, c = to_arrow_schema(schema), codec(vocabulary)
        for batch in batches:
            ids_col, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            done = [finish(ids, c.decode(ids)) for ids in c.encode(texts)]
            columns = [pa.array(list(x), arrow.field(k + 1).type) for k, x in enumerate(zip(*done, strict=True))] if done else [pa.array([], f.type) for f in arrow][1:]
            yield pa.RecordBatch.from_arrays([ids_col.cast(arrow.field(0).type), *columns], schema=arrow)

    return narrow.mapInArrow(run, schema)
