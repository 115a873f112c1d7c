"""Secrets in texts by one automaton for all rules.

Each rule is a regular expression over ASCII.  All of them become one
nondeterministic automaton, the subset construction makes it deterministic, and
partition refinement makes it minimal: arrays of transitions over classes of
bytes, next to the rules that end in each state.  A text is read once, a byte
a step, whatever the number of rules; where a rule's last possible end is met,
the rule's reversed automaton is run back to the earliest start.

Bytes after which every state is the first one (line ends, most punctuation)
cut the texts of a block into thousands of pieces, which are scanned side by
side, an array step for each byte.  What has no such byte is scanned by itself.

A pass over ends can only stand for a leftmost search without overlaps if a
rule's matches grow without gaps and none ends inside a longer one that began
before it.  :func:`compiled` proves this of every rule or refuses it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that are scanned side by side, and the fewest for which array steps pay.
LANES, FEW = 4096, 24
_ALL = (1 << 256) - 1


@dataclass(frozen=True)
class Rule:
    """``pattern`` over ASCII; matches whose ``group`` has fewer than ``least`` characters are dropped after they were found."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The base rules.  Runs of fewer than 24 hexadecimal digits are no match at all, which is the same as dropping them.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Token forms with a prefix of their own.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("pem", r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"),
)


class _Nfa:
    """States with edges (set of bytes as bits, state) and free edges."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, parts, a: int, flags: int) -> int:
        """Append parsed ``parts`` behind state ``a``; the state behind them."""
        for kind, arg in parts:
            if kind in (op.LITERAL, op.NOT_LITERAL, op.IN):
                b = self.state()
                self.edges[a].append((_bytes_of(kind, arg, flags), b))
                a = b
            elif kind is op.BRANCH:
                b = self.state()
                for way in arg[1]:
                    self.free[self.add(way, a, flags)].append(b)
                a = b
            elif kind is op.SUBPATTERN:
                a = self.add(arg[3], a, (flags | arg[1]) & ~arg[2])
            elif kind is op.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    a = self.add(body, a, flags)
                if most is op.MAXREPEAT:
                    loop, b = self.state(), self.state()
                    self.free[a] += [loop, b]
                    end = self.add(body, loop, flags)
                    self.free[end] += [loop, b]
                    a = b
                else:
                    b = self.state()
                    for _ in range(most - least):
                        self.free[a].append(b)
                        a = self.add(body, a, flags)
                    self.free[a].append(b)
                    a = b
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return a

    def closure(self, states: int) -> int:
        todo, out = list(_bits(states)), states
        for s in todo:  # grows as states are met
            for to in self.free[s]:
                if not out >> to & 1:
                    out |= 1 << to
                    todo.append(to)
        return out

    def reversed(self) -> _Nfa:
        back = _Nfa()
        for _ in self.edges:
            back.state()
        for a, edges in enumerate(self.edges):
            for chars, b in edges:
                back.edges[b].append((chars, a))
            for b in self.free[a]:
                back.free[b].append(a)
        return back


def _bytes_of(kind, arg, flags: int) -> int:
    """Set of bytes, as bits, of one parsed character or class."""
    items = arg if kind is op.IN else [(op.LITERAL, arg)]
    out, inverse = 0, kind is op.NOT_LITERAL
    for k, v in items:
        if k is op.NEGATE:
            inverse = True
        elif k is op.LITERAL:
            out |= 1 << v
        elif k is op.RANGE:
            out |= ((1 << (v[1] - v[0] + 1)) - 1) << v[0]
        else:
            raise ValueError(f"not supported in a class: {k}")
    if out >> 128:
        raise ValueError("rules are over ASCII")
    if flags & re.IGNORECASE:
        upper, lower = out >> 65 & (1 << 26) - 1, out >> 97 & (1 << 26) - 1
        out |= (upper | lower) << 65 | (upper | lower) << 97
    return _ALL & ~out if inverse else out


def _classes(nfas: list[_Nfa]) -> np.ndarray:
    """Class of each byte: bytes that no edge tells apart are one."""
    sets = sorted({chars for n in nfas for edges in n.edges for chars, _ in edges})
    marks = np.array([[s >> b & 1 for s in sets] for b in range(256)], np.uint8)
    return np.unique(marks, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint8)


def _subsets(nfa: _Nfa, classes: np.ndarray, start: int, ends: dict[int, int], anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (state, class) and the rules that end in each state, as bits; the first state is 0."""
    n = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]
    moves = {s: [_led(nfa, s, b) for b in sample] for s, edges in enumerate(nfa.edges) if edges}
    moving, ending = sum(1 << s for s in moves), sum(1 << s for s in ends)
    first = nfa.closure(start)
    rest = [0] * n if anchored else [first] * n
    numbers, table, marks, todo = {first: 0}, [], [], [first]
    for subset in todo:  # grows as subsets are met
        row = rest
        for s in _bits(subset & moving):
            row = [a | b for a, b in zip(row, moves[s], strict=True)]
        for to in row:
            if to not in numbers:
                numbers[to] = len(todo)
                todo.append(to)
        table.append([numbers[to] for to in row])
        marks.append(sum(ends[s] for s in _bits(subset & ending)))
    return np.array(table, np.int64), np.array(marks, np.int64)


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


def _led(nfa: _Nfa, state: int, byte: int) -> int:
    """What a byte leads to from a state, free edges included."""
    to = 0
    for chars, b in nfa.edges[state]:
        if chars >> byte & 1:
            to |= 1 << b
    return nfa.closure(to)


def minimal(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest automaton that marks alike: states are split by where they lead until none is. The first state stays 0."""
    block = np.unique(marks, return_inverse=True)[1].reshape(-1)
    while True:
        split = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if split.max() == block.max():
            break
        block = split
    firsts = np.full(block.max() + 1, len(block))
    np.minimum.at(firsts, block, np.arange(len(block)))
    rank = np.empty(len(firsts), np.int64)
    rank[np.argsort(firsts)] = np.arange(len(firsts))
    block = rank[block]
    keep = np.sort(firsts)
    return block[table[keep]], marks[keep]


def _check(rule: Rule, table: np.ndarray, marks: np.ndarray) -> None:
    """Whether the last end in a run of ends is that of the leftmost match, by walking pairs of an earlier and a later start."""
    ends = marks > 0
    alive = ends.copy()
    while True:
        more = alive | alive[table].any(axis=1)
        if (more == alive).all():
            break
        alive = more
    if ends[0]:
        raise ValueError(f"rule {rule.kind} matches nothing")
    if (ends[:, None] & alive[table] & ~ends[table]).any():
        raise ValueError(f"rule {rule.kind}: a match can go on after a gap")
    seen, todo = set(), [(int(q), 0) for q in np.unique(table[0][alive[table[0]]])]
    while todo:
        pair = todo.pop()
        if pair in seen:
            continue
        seen.add(pair)
        early, late = pair
        if ends[late] and not ends[early]:
            raise ValueError(f"rule {rule.kind}: a match can end inside a longer one")
        for a, b in set(zip(table[early].tolist(), table[late].tolist(), strict=True)):
            if ends[early] and ends[b] and not ends[a]:
                raise ValueError(f"rule {rule.kind}: matches can follow each other without a gap")
            if alive[a] and alive[b]:
                todo.append((a, b))
            if alive[a]:
                todo.append((a, 0))


@dataclass
class Scanner:
    """Transitions of all rules together, and of each rule read backwards; ``table`` holds the row offsets of the next states."""

    rules: tuple[Rule, ...]
    classes: np.ndarray
    table: np.ndarray
    marks: np.ndarray
    resets: np.ndarray
    backwards: list[tuple[list[int], list[bool], int]]

    @property
    def width(self) -> int:
        return len(self.resets)

    @property
    def states(self) -> int:
        return len(self.marks)

    def ends(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places behind which a rule ends, in order, and the rules as bits.

        States in which a rule ends have the highest numbers.
        """
        n, least = len(data), int(np.argmax(self.marks > 0)) * self.width
        codes = np.frombuffer(data.translate(self.classes.tobytes()), np.uint8)
        breaks = np.flatnonzero(self.resets[codes]) + 1
        lanes = max(1, min(LANES, n // 256))
        wanted = np.searchsorted(breaks, np.arange(1, lanes) * n // lanes)
        cuts = np.unique(np.concatenate([[0], breaks[wanted[wanted < len(breaks)]], [n]]))
        first, lengths = cuts[:-1], np.diff(cuts)
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        state, at, found = np.zeros(len(first), self.table.dtype), first.copy(), []
        active, t = int((lengths > 0).sum()), 0
        falling = -lengths
        while True:
            active = int(np.searchsorted(falling[:active], -t, side="left"))
            if active < FEW:
                break
            state = self.table[state[:active] + codes[at[:active]]]
            hit = np.flatnonzero(state >= least)
            if len(hit):
                found.append((at[hit], state[hit]))
            at[:active] += 1
            t += 1
        if active:
            table, marked = self.table.tolist(), bytes(codes)
            for lane in range(active):
                s, places, states = int(state[lane]), [], []
                for p in range(int(at[lane]), int(first[lane] + lengths[lane])):
                    s = table[s + marked[p]]
                    if s >= least:
                        places.append(p)
                        states.append(s)
                if places:
                    found.append((np.array(places), np.array(states)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, states = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(places)
        return places[order] + 1, self.marks[states[order] // self.width]

    def start(self, rule: int, codes: np.ndarray, end: int, least: int) -> int | None:
        """The first place from ``least`` on at which a match of the rule that ends at ``end`` begins."""
        table, final, width = self.backwards[rule]
        s, found = 0, None
        for p in range(end - 1, least - 1, -1):
            s = table[s + codes[p]]
            if s < 0:
                break
            if final[s // width]:
                found = p
        return found

    def spans(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """(start, rule, end) in code points, in this order, of each text that has any."""
        data = b"\n".join(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        places, marks = self.ends(data)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for r, rule in enumerate(self.rules):
            own = places[(marks >> r & 1) > 0]
            last = own[np.append(np.diff(own) != 1, True)] if len(own) else own
            owner = np.searchsorted(begins, last, side="left") - 1  # an end lies behind its text's begin
            whole = re.compile(rule.pattern.encode())
            text, before, codes = -1, 0, b""
            for k, end in zip(owner.tolist(), last.tolist(), strict=True):
                if k != text:
                    text, before = k, 0
                    codes = texts[k].translate(self.classes.tobytes())
                end -= int(begins[k])
                begin = self.start(r, codes, end, before)
                if begin is None:  # it began inside the match before
                    continue
                before = end
                group = whole.fullmatch(texts[k], begin, end).span(rule.group) if rule.group else (begin, end)
                if group[1] - group[0] >= rule.least:
                    out.setdefault(k, []).append((begin, r, end))
        for k, found in out.items():
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(texts[k], np.uint8) & 0xC0) != 0x80)])
            out[k] = sorted((int(chars[a]), r, int(chars[b])) for a, r, b in found)
        return out


def compiled(rules: tuple[Rule, ...]) -> Scanner:
    """The minimal automaton of all ``rules``, and each one's backwards; an error for rules that one pass cannot tell apart."""
    alone, whole, ends = [], _Nfa(), {}
    whole.state()
    for r, rule in enumerate(rules):
        parts = _parser.parse(rule.pattern)
        one = _Nfa()
        one.state()
        alone.append((one, one.add(parts, 0, parts.state.flags)))
        begin = whole.state()
        whole.free[0].append(begin)
        ends[whole.add(parts, begin, parts.state.flags)] = 1 << r
    classes = _classes([whole])
    backwards = []
    for rule, (one, end) in zip(rules, alone, strict=True):
        table, marks = minimal(*_subsets(one, classes, 1, {end: 1}, anchored=True))
        _check(rule, table, marks)
        table, marks = minimal(*_subsets(one.reversed(), classes, 1 << end, {0: 1}, anchored=True))
        dead = [s for s in range(len(table)) if not marks[s] and (table[s] == s).all()]
        flat = np.where(np.isin(table, dead), -1, table * table.shape[1])
        backwards.append((flat.ravel().tolist(), (marks > 0).tolist(), table.shape[1]))
    table, marks = minimal(*_subsets(whole, classes, 1, ends, anchored=False))
    rank = np.empty(len(marks), np.int64)
    order = np.argsort(marks > 0, kind="stable")  # those in which a rule ends come last, the first state stays first
    rank[order] = np.arange(len(marks))
    table, marks = rank[table[order]], marks[order]
    resets = (table == 0).all(axis=0)
    if not resets[classes[10]]:
        raise ValueError("a rule matches line ends, which part the texts of a block")
    width = table.shape[1]
    kind = np.int32 if len(marks) * width < 1 << 31 else np.int64
    return Scanner(tuple(rules), classes, (table * width).ravel().astype(kind), marks, resets, backwards)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document: array of (kind, start, end) in code points, by start, then in the order of ``rules``.

    For each rule its leftmost matches without overlaps, less those too short.
    Null texts count as empty; texts are taken whole; a repeated row and a null
    id are rows like others; an empty table gives no rows; other columns are
    ignored.  Row-local: no exchange, and a task holds one Arrow batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))  # the rules' arrays
    kinds = [r.kind for r in rules]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.spans(batch.column("_text").to_pylist())
            spans = [[{"kind": kinds[r], "start": a, "end": b} for a, r, b in found.get(k, ())] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return rows.mapInArrow(scanned, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<struct<kind string, start bigint, end bigint>>")
