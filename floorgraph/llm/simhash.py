"""SimHash fingerprints and near-duplicate groups, searched by BK-trees.

Documents become 64-bit fingerprints, row by row.  The *distinct* fingerprints
are dealt into shards: the 64 bits are cut into five blocks, and fingerprints
that differ in three bits or fewer agree in at least two whole blocks, so for
each of the ten pairs of blocks those that agree in it form a shard.  Each
shard of two or more becomes a BK-tree (children keyed by their integer Hamming
distance to the parent), and its fingerprints search it, following only edges
within the radius.  A shard above ``tree_size`` is dealt further into parts,
whose trees go to every other part of the shard, a cell for each pair of parts:
a tree is copied to as many tasks as its shard has parts, and no task holds more
than a tree and one part of queries.  The trees of all cells of an Arrow batch
are built and searched together, level by level (:class:`BKForest`).  What leaves
a cell is one link per fingerprint to the smallest one reachable inside it,
never the pairs.  Connected components of those links are found by minimum
labels with pointer jumping.

Three of 64 bits link all but identical texts only.  For near copies
(:data:`NEAR`) the same search finds candidates: texts with equal sets of
five-word shingles are one, the others get a 128-bit fingerprint, where two
texts of Jaccard similarity J differ in a share acos(2J / (1 + J)) / pi of the
bits, 19 of 128 at 0.8, and are dealt into shards by bands of ``rows`` min-wise
hashes of their shingles.  Two texts at J are in a common shard with a
probability of 1 - (1 - J ** rows) ** bands: 0.99996 at 0.8 for 14 bands of 3,
however many documents there are, while unrelated texts hardly ever meet.  The
distinct shingles of every candidate go into a store in the shared folder, and
a second search compares them: a pair is linked if its shingle similarity is
0.8 or more.  Pairs that earlier links already join need no comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorgraph.llm.common import cut, written
from floorgraph.llm.decontaminate import WordHashes, shingle_hashes
from floorgraph.llm.set_store import SetStore, build_store
from floorgraph.llm.shard_index import build_index, fits_a_task, released

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Widths of the blocks of a fingerprint; radius + 2 of them, so that two stay untouched.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints in one BK-tree.
TREE_SIZE = 4096
#: Pairs of a query and a node that are compared at once.
PAIRS = 1 << 18
_BITS = np.arange(64, dtype=np.uint64)
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Sketch:
    """Near copies: shingle length, words of a fingerprint, the bits in which candidates may differ, bands and their hashes, least similarity."""

    n: int = 5
    words: int = 2
    radius: int = 40
    bands: int = 14
    rows: int = 3
    alike: float = 0.8


#: Five words and a similarity of 0.8, where 128 bits differ in 19 with a standard deviation of 4, more for very few shingles.
NEAR = Sketch()


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - n])).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for very long texts
        part = np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS)[2 * ones > len(h)].sum(dtype=np.uint64))


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (n x words of 64 bits) have each bit: rows are added three at a time into sums and carries."""
    counts, weight = np.zeros(64 * rows.shape[1], np.int64), 1
    while len(rows):
        carries = []
        while len(rows) > 24:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            both = a ^ b
            carries.append((a & b) | (c & both))
            rows = np.concatenate([both ^ c, rows[3 * m :]])
        bits = np.unpackbits(np.ascontiguousarray(rows).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += weight * bits.sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries) if carries else rows[:0], 2 * weight
    return counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def distinct_shingles(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z lower-cased, words split at ASCII white space."""
    return np.unique(shingle_hashes((text or "").encode("utf-8").lower().split(), n, known))


def wide_fingerprint(h: np.ndarray, words: int) -> bytes:
    """Majority of the bits of a set of hashes, each stretched to ``words`` words; zero for none."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 16384):  # bounded memory for very long texts
        counts += bit_counts(_mixed(h[at : at + 16384, None] + np.arange(1, words + 1, dtype=np.uint64) * _GOLDEN))
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes()


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key of each band from the least of ``rows`` min-wise hashes of a set; none for the empty set."""
    if not len(h):
        return np.empty(0, np.int64)
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GOLDEN)
    least = np.full(len(seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        x = (h[None, at : at + 4096] ^ seeds[:, None]) * _MIX1
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = _mixed(key * _GOLDEN + column)
    return key.view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees over runs of ``values`` (rows of words): children keyed by their integer distance to the parent.

    ``root`` is the place of the root of the tree that each value belongs to,
    its own place for roots.  The edges of all trees are one sorted array of
    parent * (largest distance + 1) + distance, so those of a node within a
    range of distances are a slice of it.  ``visited`` counts the nodes that
    queries were compared with.
    """

    def __init__(self, values: np.ndarray, root: np.ndarray):
        self.values, self.width, self.visited = values, 64 * values.shape[1] + 1, 0
        self.size = np.bincount(root, minlength=len(values))
        keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rest = np.flatnonzero(root != np.arange(len(values)))
        at = root[rest]
        while len(rest):
            # all that stand at one node with one distance follow the first of them, which is the child
            key = at * self.width + _apart(values[rest], values[at])
            distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(distinct)
            nodes.append(rest[first])
            at = rest[first][which]
            stay = at != rest
            rest, at = rest[stay], at[stay]
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.nodes = np.concatenate(keys)[order], np.concatenate(nodes)[order]

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, nodes) within the radius in the tree of ``root``, in pieces; only edges within the radius are followed."""
        # if nothing is pruned, all pairs of a piece are compared
        pieces = np.cumsum(self.size[root]) // PAIRS
        for q in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(pieces)) + 1):
            node = root[q]
            while len(q):
                self.visited += len(q)
                d = _apart(queries[q], self.values[node])
                hit = d <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.keys, node * self.width + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * self.width + np.minimum(d + radius, self.width - 1), side="right")
                n = high - low
                ends = np.cumsum(n)
                place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(low, n)
                q, node = np.repeat(q, n), self.nodes[place]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i]; a label is the smallest place in its set."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


class Cells:
    """Complete cells, one after the other: fingerprints, names, starts of the cells, and which values are tree and query.

    ``tree`` and ``query`` are both true all over a cell that is searched by
    itself; in a cell of two parts one is the tree, the other the queries.
    """

    def __init__(self, fps: np.ndarray, names: np.ndarray, starts: np.ndarray, tree: np.ndarray, query: np.ndarray):
        which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fps))))
        nodes = np.flatnonzero(tree)
        first = np.full(len(starts), -1, np.int64)  # place of each cell's root among the nodes
        first[which[nodes[::-1]]] = np.arange(len(nodes))[::-1]
        asked = np.flatnonzero(query & (first[which] >= 0))
        self.names, self.nodes, self.asked, self.itself = names, nodes, asked, tree & query
        self.forest = BKForest(fps[nodes], first[which[nodes]])
        self.fps, self.roots = fps[asked], first[which[asked]]

    def links(self, radius: int, store: SetStore | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(name, smallest name of its set in the cell) for all that have a smaller one.

        With a store only pairs whose sets there are alike are linked.
        """
        order = np.argsort(self.names, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranked, labels = self.names[order], np.arange(len(order))
        for q, node in self.forest.search(self.fps, self.roots, radius):
            a, b = place[self.asked[q]], place[self.nodes[node]]
            once = (a > b) | ~self.itself[self.asked[q]]  # a cell that is searched by itself finds each pair twice
            a, b = a[once], b[once]
            labels = _merge(labels, a, b) if store is None else _merge_alike(labels, a, b, ranked, store, least)
        linked = labels != np.arange(len(order))
        return ranked[linked], ranked[labels[linked]]


def _merge_alike(labels: np.ndarray, a: np.ndarray, b: np.ndarray, ranked: np.ndarray, store: SetStore, least: float) -> np.ndarray:
    """``_merge`` of those pairs whose sets are alike; pairs that are joined already are not compared."""
    while True:
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return labels
        # a pair of each text and round: once a group is joined, its other pairs need no comparison
        pick = np.unique(a, return_index=True)[1]
        good = np.zeros(len(pick), bool)
        for at in range(0, len(pick), 256):  # bounded sets at a time
            some = pick[at : at + 256]
            sets = store.get(ranked[np.unique(np.concatenate([a[some], b[some]]))])
            good[at : at + 256] = [alike(sets[x], sets[y], least) for x, y in zip(ranked[a[some]].tolist(), ranked[b[some]].tolist(), strict=True)]
        labels = _merge(labels, a[pick][good], b[pick][good])
        a, b = np.delete(a, pick), np.delete(b, pick)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of ``least`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) - 1e-9 or not len(a):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def shard_links(keyed: DataFrame, radius: int, tree_size: int = TREE_SIZE, store: SetStore | None = None, least: float = 0.0) -> DataFrame:
    """(a, b) links between the distinct ``node`` numbers of ``keyed`` (node, key, words of the fingerprint as longs).

    Nodes of one key form a shard.  A node comes once for each of its keys.
    """
    words = [c for c in keyed.columns if c not in ("node", "key")]
    # only keys of more than a tree's worth are split; there are few, and Spark broadcasts them below its own bound
    parts = F.ceil(F.col("count") / F.lit(tree_size)).cast("int")
    hot = written(keyed.groupBy("key").count().where(F.col("count") > tree_size).select(F.col("key").alias("_key"), parts.alias("_n")), "shards")
    dealt = (
        keyed.join(hot, F.col("key") == F.col("_key"), "left")
        .withColumn("_parts", F.coalesce("_n", F.lit(1)))
        .withColumn("_own", F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select("key", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "_own", "node", *words)
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 5 + len(words)), np.int64)

        def found(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            x, y, own = rows[:, 1], rows[:, 2], rows[:, 3]
            cells = Cells(np.ascontiguousarray(rows[:, 5:]).view(np.uint64), rows[:, 4], starts, own == x, own == y)
            a, b = cells.links(radius, store, least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([rest, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])])
            if not len(rows):
                continue
            starts = np.concatenate(([0], np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1))
            rest = rows[starts[-1] :]
            if len(starts) > 1:
                yield found(rows[: starts[-1]], starts[:-1])
        if len(rest):
            yield found(rest, np.array([0]))

    return dealt.mapInArrow(search, "a long, b long").distinct()


def _block_keys(fp, widths) -> list:
    """Expressions of the shard keys: the table's number above the bits of its two blocks."""
    shifts = [sum(widths[:k]) for k in range(len(widths))]
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, widths, strict=True)]
    pairs = combinations(range(len(widths)), 2)
    return [F.lit(t << 40).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for t, (i, j) in enumerate(pairs)]


def links(fingerprints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b) links between distinct ``fp`` values whose components are those of "within the radius"."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"the blocks serve a radius of {len(BLOCKS) - 2} at most")
    keyed = fingerprints.select(F.col("fp").alias("node"), F.explode(F.array(*_block_keys(F.col("fp"), BLOCKS))).alias("key"), "fp")
    return shard_links(keyed, radius, tree_size)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the links (a, b).

    Every round takes the least label of the neighbours and then the label of
    that label; each round is checkpointed and the number of rounds grows with
    the logarithm of the longest path.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_node"), F.col("label").alias("_far"))
        stepped = low.join(jump, F.col("_low") == F.col("_node")).select("node", F.least("_low", "_far").alias("_new"), (F.least("_low", "_far") != F.col("label")).alias("_moved"))
        stepped = cut(stepped)
        moved = stepped.where("_moved").limit(1).count()
        labels = stepped.select("node", F.col("_new").alias("label"))
        if not moved:
            return labels


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row: the 64-bit fingerprint as a signed long."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["doc_id"], T.StructField("fp", T.LongType())]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest id among the documents whose fingerprints
    are reachable by steps of at most ``RADIUS`` differing bits.  Null and
    wordless texts have fingerprint zero and are linked like any other; repeated
    rows each get a row; null ids count as no id (a component of null ids only
    has a null ``component_id``).  An empty table gives no rows.  Other columns
    are ignored.
    """
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    found = components(links(least.select("fp"), RADIUS, tree_size))
    named = least.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "_least", F.coalesce("label", "fp").alias("_label"))
    named = written(named, "labels")
    smallest = named.groupBy(F.col("_label").alias("_group")).agg(F.min("_least").alias("component_id"))
    member = named.join(smallest, F.col("_label") == F.col("_group")).select("_fp", "component_id")
    return marked.join(member, F.col("fp") == F.col("_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = NEAR, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, key, mark, group) of every row: hashes of id and text, and the number of its group of near copies.

    Texts of equal shingle sets are in one group, those without words among
    them; others are linked at a shingle similarity of ``alike`` or more.
    """
    both = [F.col(id_col), F.col(text_col)]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_hashes(*both), *text_hashes(F.col(text_col)))
    words = [f"w{k}" for k in range(sketch.words)]
    marks = ["key", "mark", "text_hash", "text_mark", "set_a", "set_b", *words]
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in marks], T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets, fps, keys = [], [], []
            for text in batch.column(1):
                h = distinct_shingles(text.as_py(), sketch.n, known)
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(wide_fingerprint(h, sketch.words))
                keys.append(band_keys(h, sketch.bands, sketch.rows))
            both = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
            fp = np.frombuffer(b"".join(fps), np.int64).reshape(-1, sketch.words)
            columns = [batch.column(0), *batch.columns[2:], *map(pa.array, both.T), *map(pa.array, fp.T), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    marked = written(narrow.mapInArrow(sketches, schema), "sketches")
    one = F.min(F.struct("text_hash", "text_mark", "bands", *words)).alias("_one")
    nodes = marked.groupBy("set_a", "set_b").agg(one).select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "_one.*")
    nodes = written(nodes, "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"), *words)
    found = written(shard_links(keyed, sketch.radius, tree_size), "candidates")
    found = components(_alike_links(docs, text_col, nodes, keyed, found, sketch, tree_size))
    label = nodes.select("node", "set_a", "set_b").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    label = label.select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("label", "node").alias("group"))
    return marked.join(label, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b"))).select("doc_id", "key", "mark", "group")


def _alike_links(docs: DataFrame, text_col: str, nodes: DataFrame, keyed: DataFrame, found: DataFrame, sketch: Sketch, tree_size: int) -> DataFrame:
    """Links of the pairs among the candidates that ``found`` names whose shingle sets are alike.

    A text stands for all that have its set.  Where the candidates' hashes fit
    a task, texts are not exchanged: they probe an index of them, and those
    found give their sets.  Beyond that they are joined with the candidates.
    """
    chosen = written(found.select(F.col("a").alias("_a")).unionAll(found.select("b")).distinct(), "candidates")
    wanted = nodes.join(chosen, F.col("node") == F.col("_a"), "left_semi").select(F.col("text_hash").alias("key"), F.col("text_mark").alias("mark"), (F.col("node") + 1).alias("place"))
    wanted = written(wanted, "texts")
    texts = docs.select(F.col(text_col).alias("text"), *text_hashes(F.col(text_col)))
    if fits_a_task((wanted, 1)):
        index = build_index(wanted, ["place"])
        places = lambda key, mark: index.counts(key.view(np.uint64), mark.view(np.uint64))[:, 0]
    else:
        places = lambda place, _: place
        found = texts.join(wanted.toDF("text_hash", "text_mark", "place"), ["text_hash", "text_mark"])
        texts = found.dropDuplicates(["text_hash", "text_mark"]).select("text", "place", "text_mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for batch in batches:
            place = places(*(np.ascontiguousarray(batch.column(k).to_numpy()) for k in (1, 2))) - 1
            rows = [k for k in np.flatnonzero(place >= 0).tolist() if place[k] not in seen and not seen.add(place[k])]
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                sets = [distinct_shingles(batch.column(0)[k].as_py(), sketch.n, known).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(sets, pa.binary())], names=["node", "hashes"])

    store = build_store(written(texts.mapInArrow(lambda batches: released(run(batches)), "node long, hashes binary"), "shingles"))
    return shard_links(keyed.join(chosen, F.col("node") == F.col("_a"), "left_semi"), sketch.radius, tree_size, store, sketch.alike)


def text_hashes(text) -> list:
    """Two independent hashes of a text."""
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit("text"), text).alias("text_mark")]


def row_hashes(doc_id, text) -> list:
    """Two independent hashes of a row's id and text: its key, and what tells it from others of that key."""
    return [F.xxhash64(doc_id, text).alias("key"), F.xxhash64(F.lit("row"), doc_id, text).alias("mark")]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = NEAR, tree_size: int = TREE_SIZE) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns as they were.

    The row of the smallest id stays, of one id's several texts the one of the
    smallest hash, of rows that repeat id and text the one whose other columns
    hash smallest; rows without an id only where the group has no other.  A row
    goes for its own group only: texts of other groups under the same id stay.
    Texts without words are one group.  An empty table gives no rows.

    Where the rows to drop fit a task, texts are not exchanged: the hashes of
    these rows go into the sharded index that the rows then probe.  Beyond that
    the rows are joined with them.  Only repeated rows are gathered by key, with
    map-side reduction.
    """
    grouped = near_groups(docs, id_col, text_col, sketch, tree_size)
    rows = written(grouped.groupBy("group", "key", "mark").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")), "groups")
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "mark")).alias("_kept")
    # of a group of one there is nothing to drop, and most groups are; a table of its own, so that the join may split a large group
    several = rows.groupBy("group").agg(kept, F.count("*").alias("_rows"), F.max("n").alias("_n")).where("_rows > 1 or _n > 1").select(F.col("group").alias("_group"), "_kept")
    several = written(several, "several")
    stays = (F.col("key") == F.col("_kept.key")) & (F.col("mark") == F.col("_kept.mark"))
    verdict = rows.join(several, F.col("group") == F.col("_group")).select("key", "mark", F.when(stays, 2).otherwise(1).alias("verdict"), "n")
    verdict = written(verdict.where("verdict = 1 or n > 1").drop("n"), "verdicts")
    names = [f"{c}-{uuid.uuid4().hex}" for c in ("key", "mark", "verdict")]
    hashed = docs.select("*", *[c.alias(n) for c, n in zip(row_hashes(docs[id_col], docs[text_col]), names, strict=False)])
    schema = T.StructType([*hashed.schema, T.StructField(names[2], T.LongType())])
    if fits_a_task((verdict, 1)):
        index = build_index(verdict, ["verdict"])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, mark = (np.ascontiguousarray(batch.column(k).to_numpy()).view(np.uint64) for k in (-2, -1))
                found = index.counts(key, mark)[:, 0]
                stays = pa.array(found != 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names).filter(stays)

        judged = hashed.mapInArrow(lambda batches: released(judge(batches)), schema)
    else:
        found = verdict.toDF("_key", "_mark", names[2])
        judged = hashed.join(found, (F.col(names[0]) == F.col("_key")) & (F.col(names[1]) == F.col("_mark")), "left").drop("_key", "_mark")
        judged = judged.where(F.coalesce(F.col(names[2]), F.lit(0)) != 1)
    repeated = F.coalesce(F.col(names[2]), F.lit(0)) == 2
    out = judged.where(~repeated).select(*docs.columns)
    if verdict.where("verdict = 2").limit(1).count():
        hashable = [judged[c] for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        first = F.min_by(F.struct(*[judged[c] for c in docs.columns]), F.xxhash64(*hashable)).alias("_row")
        out = out.unionAll(judged.where(repeated).groupBy(*names[:2]).agg(first).select("_row.*"))
    return out
