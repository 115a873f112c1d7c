"""Kernels for graphs that a task can hold: cheapest routes from some sources, and the ways of a tree.

Both take the rows of one group as Arrow batches and give their result in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a batch of routes, and nodes in a batch of ways.
_ROWS, _NODES = 100_000, 500_000
_NINTH = Decimal("1e-9")


def nine(x: float) -> float:
    """Rounded to nine places as Spark's ``round`` does: half up, by the shortest decimal that is ``x``."""
    r = round(x, 9)
    return r if r == x or x >= 2.0**23 else float(Decimal(repr(x)).quantize(_NINTH, ROUND_HALF_UP))  # above, doubles are further apart


def _tree(start: int, first: list[int], to: np.ndarray, weight: np.ndarray, whole: bool) -> tuple[list[float], list[int], list[int]]:
    """Cost, hops and previous node of every node, by Dijkstra's algorithm; as many hops as nodes where there is no way.

    Cost and hops grow along a route, so that all that may come before a node have been taken when it is.
    """
    n = len(first) - 1
    cost, hops, previous = [float("inf")] * n, [n] * n, [-1] * n
    taken = bytearray(n)
    cost[start], hops[start] = 0.0, 0
    heap = [(0.0, 0, start)]
    while heap:
        c, h, u = heappop(heap)
        if taken[u]:
            continue
        taken[u] = 1
        h += 1
        a, b = first[u], first[u + 1]
        for v, w in zip(to[a:b].tolist(), weight[a:b].tolist(), strict=True):
            w = c + w if whole else nine(c + w)
            if w < cost[v] or (w == cost[v] and h < hops[v]):
                cost[v], hops[v], previous[v] = w, h, u
                heappush(heap, (w, h, v))
            elif w == cost[v] and h == hops[v] and u < previous[v]:
                previous[v] = u
    return cost, hops, previous


def _column(batches: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.chunked_array([b.column(name) for b in batches]).combine_chunks()


def _ids(*columns: pa.Array) -> pa.Array:
    """The different values in their order, as numbers or by bytes, which is Spark's too."""
    ids = pc.drop_null(pc.unique(pa.chunked_array(columns).combine_chunks()))
    return ids.take(pc.sort_indices(ids))


def _codes(values: pa.Array, ids: pa.Array) -> np.ndarray:
    """Places in ``ids``, -1 for null."""
    return pc.fill_null(pc.index_in(values, value_set=ids), -1).to_numpy(zero_copy_only=False)


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def solver(names: list[str]) -> Callable:
    """Routes of a graph as rows of (graph, source, node, cost, hops, previous) = ``names``.

    Rows: _a, _b, _cost of a link, which is not below zero; _a alone of a source.
    """

    def solve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        a, b, weight = (_column(rows, c) for c in ("_a", "_b", "_cost"))
        rows.clear()
        ids, link = _ids(a, b), pc.is_valid(weight)
        sources = a.filter(pc.invert(link))
        begin, end = (_codes(c.filter(link), ids) for c in (a, b))
        weight = weight.filter(link).to_numpy(zero_copy_only=False)
        order = np.argsort(begin, kind="stable")
        to, weight = end[order], weight[order]
        first = [0, *np.cumsum(np.bincount(begin, minlength=len(ids))).tolist()]
        del a, b, link, begin, end, order
        whole = bool((weight == np.floor(weight)).all())
        for source in sources:
            if not source.is_valid:
                none = pa.nulls(1, sources.type)
                yield _batch(names, [pa.repeat(key[0], 1), none, none, pa.array([0.0]), pa.array([0], pa.int32()), none])
                continue
            at = pc.index(ids, source).as_py()
            cost, hops, previous = (np.array(x) for x in _tree(at, first, to, weight, whole))
            found = np.flatnonzero(hops < len(ids))
            for i in range(0, len(found), _ROWS):
                few = found[i : i + _ROWS]
                before = ids.take(pa.array(previous[few], mask=previous[few] < 0))
                yield _batch(names, [pa.repeat(key[0], len(few)), pa.repeat(source, len(few)), ids.take(pa.array(few)), pa.array(cost[few]), pa.array(hops[few], pa.int32()), before])

    return solve


def walker(names: list[str]) -> Callable:
    """Ways of a source's tree as rows of (graph, source, goal, cost, hops, nodes) = ``names``.

    Rows: node, cost, hops, previous of the tree; node alone of a goal.
    """

    def walk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        node, cost, hops, previous = (_column(rows, c) for c in ("node", "cost", "hops", "previous"))
        rows.clear()
        tree = pc.is_valid(hops)
        goals = node.filter(pc.invert(tree))
        ids, cost, hops = node.filter(tree), cost.filter(tree), hops.filter(tree).to_numpy(zero_copy_only=False)
        before, wanted = _codes(previous.filter(tree), ids), _codes(goals, ids)
        wanted = wanted[wanted >= 0]
        wanted = wanted[np.argsort(hops[wanted], kind="stable")]  # ways of a batch are about as long
        ends = np.cumsum(hops[wanted].astype(np.int64) + 1)
        i = 0
        while i < len(wanted):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _NODES, side="right")))
            few = wanted[i:j]
            last = np.cumsum(hops[few].astype(np.int64) + 1)
            way = np.full(last[-1], -1, dtype=np.int32)
            here, at, left = few, last - 1, hops[few]
            while len(here):
                way[at] = here
                go = (left > 0) & (before[here] >= 0)
                here, at, left = before[here[go]], at[go] - 1, left[go] - 1
            offsets = pa.array(np.concatenate([[0], last]), pa.int32())
            nodes = pa.ListArray.from_arrays(offsets, ids.take(pa.array(way, mask=way < 0)))
            yield _batch(names, [pa.repeat(key[0], len(few)), pa.repeat(key[1], len(few)), ids.take(pa.array(few)), cost.take(pa.array(few)), pa.array(hops[few], pa.int32()), nodes])
            i = j

    return walk
