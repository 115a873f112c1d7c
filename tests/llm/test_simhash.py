import random
import re

import numpy as np
import pytest
import xxhash

from floorgraph.llm import shard_index, simhash


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(values, radius=3):
    label = list(range(len(values)))
    while True:
        new = [min(label[j] for j, w in enumerate(values) if (v ^ w).bit_count() <= radius) for v in values]
        if new == label:
            return label
        label = new


def test_fingerprints(odd_pairs):
    texts = [t for _, t in odd_pairs if t is None or len(t) < 50_000] + ["one", "One two", "a\x0bb\x0cc d", "É È é", "a a a a a a"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def near_values(rng, n):
    centres = [rng.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


def test_trees_find_all_within_the_radius():
    values = np.array(near_values(random.Random(1), 700), np.uint64)[:, None]
    starts = np.array([0, 1, 3, 250, 600])
    root = np.repeat(starts, np.diff([*starts, 700]))
    forest = simhash.BKForest(values, root)
    found = [(int(q), int(n)) for qs, ns in forest.search(values, root, 3) for q, n in zip(qs, ns, strict=True)]
    of = values[:, 0].tolist()
    want = {(i, j) for i, v in enumerate(of) for j, w in enumerate(of) if root[i] == root[j] and (v ^ w).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == want
    assert len(found) < forest.visited < sum(n * n for n in np.diff([*starts, 700]).tolist())


def test_trees_are_built_and_prune(spark, monkeypatch):
    """On the fingerprints of the largest sample each shard is a tree, and most of a large tree's nodes are never visited."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    values = sorted({r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()})
    shards = {}
    for v in values:
        blocks = [v >> s & (1 << w) - 1 for s, w in zip((0, 13, 26, 39, 52), simhash.BLOCKS, strict=True)]
        for i in range(5):
            for j in range(i):
                shards.setdefault((i, j, blocks[i], blocks[j]), []).append(v)
    shards = [s for s in shards.values() if len(s) > 1]
    fps = np.array([v for s in shards for v in s], np.uint64)
    starts = np.cumsum([0, *map(len, shards)])[:-1]
    every = np.ones(len(fps), bool)
    cells = simhash.Cells(fps[:, None], fps.view(np.int64), starts, every, every)
    a, b = cells.links(3)
    label = dict(zip(values, plain_groups_fast(values), strict=True))
    assert len(set(cells.roots.tolist())) == len(shards) > 100  # a tree for each shard
    assert all(label[x % (1 << 64)] == label[y % (1 << 64)] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    linked = sum(label[v] != v for v in values)
    assert len({v for v, w in zip(a.tolist(), b.tolist(), strict=True)}) >= linked > 5
    large = np.random.default_rng(3).integers(0, 1 << 38, (4000, 1), dtype=np.uint64)  # as in a shard, where two blocks agree
    forest = simhash.BKForest(large, np.zeros(4000, np.int64))
    assert sum(len(q) for q, _ in forest.search(large[:200], np.zeros(200, np.int64), 3)) >= 200
    assert forest.visited < 0.5 * 200 * 4000


def plain_groups_fast(values, radius=3):
    """Smallest value reachable from each, by comparison of all."""
    v = np.array(values, np.uint64)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius)
    label = np.arange(len(v))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return [values[k] for k in label]
        label = new


@pytest.mark.parametrize("tree_size", [4096, 16])
def test_links_have_the_same_components(spark, tree_size):
    values = near_values(random.Random(2), 400)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.links(df, tree_size=tree_size)).collect()}
    signed = [r.fp for r in df.collect()]
    label = plain_groups([v % (1 << 64) for v in signed])
    for i, v in enumerate(signed):
        assert got.get(v, v) == min(signed[j] for j in range(len(signed)) if label[j] == label[i])


def test_documents(make_docs, odd_pairs):
    pairs = [p for p in odd_pairs if p[1] is None or len(p[1]) < 50_000]
    rows = simhash.near_duplicates(make_docs(pairs)).collect()
    prints = [plain_fingerprint(t) for _, t in pairs]
    label = plain_groups(prints)
    least = {g: min((pairs[j][0] for j in range(len(pairs)) if label[j] == g and pairs[j][0] is not None), default=None) for g in label}
    want = sorted(str((i, f"{prints[k]:016x}", least[label[k]])) for k, (i, _) in enumerate(pairs))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in rows) == want
    assert simhash.near_duplicates(make_docs([])).count() == 0


def exact_groups(texts, least=0.8):
    """Smallest place reachable from each text by shingle similarity; equal sets are similar."""
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a == b or (least * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9)
    others = [[j for j, b in enumerate(sets) if near(a, b)] for a in sets]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in near_ones) for near_ones in others]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("cache", [None, 0])
def test_keep_one(make_docs, odd_pairs, monkeypatch, cache):
    if cache is not None:  # beyond a task's cache rows are joined
        monkeypatch.setattr(shard_index, "CACHE_BYTES", cache)
    extra = [(None, "nobody knows this text"), (None, "nobody knows this text"), (None, "nor this other one, which differs"), (20, "nor a third"), (20, "nor a third"), (21, "nor a third"), (20, "quite another text under a used id"), (None, "nor a third"), (1, "a text that is like no other")]
    pairs = odd_pairs + extra
    docs = make_docs(pairs)
    label = exact_groups([t for _, t in pairs])
    want = []
    for g in set(label):
        ids = [pairs[j][0] for j in range(len(pairs)) if label[j] == g]
        want.append(min((i for i in ids if i is not None), default=None))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, want)) and want.count(None) >= 2 and want.count(20) == 2 and want.count(1) == 2
    label_of = {(i, t): g for (i, t), g in zip(pairs, label, strict=True)}
    assert len({label_of[r.doc_id, r.text] for r in rows}) == len(rows)


def test_two_texts_of_one_id_that_are_unlike_both_stay(make_docs):
    docs = make_docs([(7, "one text about rivers and the sea beyond them"), (7, "another text of a mountain with snow on it")])
    assert simhash.keep_one(docs).count() == 2


def test_keep_one_of_one_big_group(make_docs):
    rows = simhash.keep_one(make_docs([(i, "the very same words again and again") for i in range(5, 400)])).collect()
    assert [r.doc_id for r in rows] == [5]
    assert simhash.keep_one(make_docs([])).count() == 0


def jaccard(a, b, n=5):
    s, t = ({" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def test_bits_are_counted():
    rows = np.random.default_rng(0).integers(0, 2**64, (1000, 3), dtype=np.uint64)
    want = [int((rows[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).sum()) for k in range(192)]
    for n in (0, 1, 24, 25, 1000):
        assert simhash.bit_counts(rows[:n]).sum() == np.bitwise_count(rows[:n]).sum()
    assert simhash.bit_counts(rows).tolist() == want


@pytest.mark.parametrize("tree_size", [4096, 5])
def test_candidates_are_those_of_all_shards(spark, tree_size):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, (20, 2), dtype=np.uint64)
    rows, table, keys = [], [], []
    for k in range(300):
        bits = np.unpackbits(centres[k % 20].view(np.uint8), bitorder="little")
        table.append(bits ^ (rng.random(128) < rng.choice((0.02, 0.1, 0.3))))
        keys.append({int(x) for x in rng.integers(0, 30, 3)} | {99})
        words = np.packbits(table[-1], bitorder="little").view(np.int64).tolist()
        rows += [(k, key, *words) for key in keys[-1]]
    table = np.array(table)
    near = lambda i, j: (table[i] != table[j]).sum() <= 40 and keys[i] & keys[j]
    label = list(range(300))
    while True:
        new = [min(label[j] for j in range(300) if i == j or near(i, j)) for i in range(300)]
        if new == label:
            break
        label = new
    df = spark.createDataFrame(rows, "node long, key long, w0 long, w1 long")
    got = {r.node: r.label for r in simhash.components(simhash.shard_links(df, 40, tree_size)).collect()}
    assert [got.get(i, i) for i in range(300)] == label


def test_bands_meet_as_often_as_sets_are_alike():
    rng = np.random.default_rng(7)
    met = 0
    for k in range(300):
        common, a, b = np.split(rng.integers(0, 2**64, 900 + 112 + 113, dtype=np.uint64), [900, 1012])  # 0.8
        keys = [simhash.band_keys(np.concatenate([common, x]), 14, 3) for x in (a, b)]
        met += (keys[0] == keys[1]).sum()
        fps = [np.frombuffer(simhash.wide_fingerprint(np.concatenate([common, x]), 2), np.uint64) for x in (a, b)]
        assert (keys[0] == keys[1]).any() and np.bitwise_count(fps[0] ^ fps[1]).sum() <= simhash.NEAR.radius
    assert abs(met / (300 * 14) - 0.512) < 0.04


def test_near_copies_at_four_fifths_go_and_others_stay(make_docs):
    rng = random.Random(12)
    pool = [f"w{k}" for k in range(4000)]
    docs, near, far = [], [], []
    for k in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(60, 900))]
        docs.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            edited = list(words)
            for _ in range(max(1, int(len(words) * rng.choice((0.005, 0.015, 0.15))))):
                edited[rng.randrange(len(words))] = "edit" + str(rng.random())
            docs.append((10 * k + c, " ".join(edited)))
            j = jaccard(docs[-1][1], " ".join(words))
            (near if j >= 0.82 else far if j < 0.6 else []).append(10 * k + c)
    kept = {r.doc_id for r in simhash.keep_one(make_docs(docs)).collect()}
    assert {10 * k for k in range(60)} <= kept and set(far) <= kept
    assert len(near) > 60 and len(set(near) & kept) <= 0.03 * len(near)


def test_keep_one_is_single_linkage_by_exact_similarity(make_docs):
    rng = random.Random(21)
    pool = [f"w{k}" for k in range(4000)]
    docs = []
    for k in range(150):
        words = [rng.choice(pool) for _ in range(rng.choice((6, 9, 14, 20, 35, 80, 300)))]
        docs.append(" ".join(words))
        want = rng.uniform(0.55, 0.9)
        edited, place = list(words), list(range(len(words)))
        rng.shuffle(place)
        while place and jaccard(" ".join(edited), docs[-1]) > want:
            edited[place.pop()] = "edit" + str(rng.random())
        docs.append(" ".join(edited))
        docs.append(" ".join(words[: max(1, int(len(words) * rng.uniform(0.6, 1)))]))
    label, middle = list(range(len(docs))), 0
    for k in range(0, len(docs), 3):
        near = [[jaccard(docs[i], docs[j]) >= 0.8 for j in range(k, k + 3)] for i in range(k, k + 3)]
        middle += sum(0.6 <= jaccard(docs[k], docs[j]) < 0.8 for j in (k + 1, k + 2))
        for _ in range(3):
            for i in range(3):
                label[k + i] = min(label[k + j] for j in range(3) if near[i][j])
    kept = {r.doc_id for r in simhash.keep_one(make_docs(list(enumerate(docs)))).collect()}
    assert middle > 50 and kept == {k for k in range(len(docs)) if label[k] == k}


def test_similarity_is_exact():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 9], [], list(range(100)))]
    assert simhash.alike(sets[0], sets[1], 0.8) and not simhash.alike(sets[0], sets[2], 0.8)
    assert not simhash.alike(sets[3], sets[0], 0.8) and not simhash.alike(sets[4], sets[1], 0.8)


def test_recall_of_near_copies_in_documents(spark, sf_dir):
    """All groups by exact five-word similarity, those between 0.8 and 1 among them, are the groups found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    label = exact_groups([texts[i] for i in ids])
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i, g in zip(ids, label, strict=True) if ids[g] == i} and len(kept) < len(ids)
