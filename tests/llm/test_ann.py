import numpy as np
import pytest

from floorgraph.llm import ann
from floorgraph.llm.queries import op7_learned_partitions

SCHEMA = "vec_id long, embedding array<float>, label int, part int, chunk int, ids string, v int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", 3) for i, v in rows], SCHEMA)


def exact(rows, k, every):
    clean = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array([i for i, _ in clean])
    x = np.array([v for _, v in clean], np.float32).astype(np.float64)
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = (x * x[q]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_all_parts_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(90)]  # a hot vector, some of its rows queries
    rows += [(410, [1.0] * 7), (420, [2.0])]  # of another length than most
    rows += [rows[3], rows[3], (400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [None] * 6), (404, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (405, [])]
    out = got(ann.nearest(make(spark, rows), k=20, query_every=10, chunk_rows=40, target_recall=1))
    want = exact(rows, 20, 10)
    assert out.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in out[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in out[q]], [s for _, s in near], rtol=0, atol=1e-12)


@pytest.mark.parametrize("size", [1e-3, 1e3, 1e6])
def test_large_and_small_components_with_ties(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(1, 4, 6) * size).tolist()) for i in range(300)] + [(1000 + i, (rng.normal(size=6) * 1e-3 * size + size).tolist()) for i in range(300)]
    out = got(ann.nearest(make(spark, rows), k=20, query_every=10, chunk_rows=100, target_recall=1))
    assert out == exact(rows, 20, 10)


def test_products_that_overflow(spark):
    rows = [(i, [1e300 * (-1) ** i, 1e300, float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = got(ann.nearest(df, k=5, query_every=20, target_recall=1))
    assert out.keys() == {0, 20, 40} and all(len(near) == 5 for near in out.values())
    assert [i for i, _ in out[0]] == [2, 4, 6, 8, 10]  # all of them infinite, ties to the smaller id


def test_fewer_candidates_than_asked(spark):
    out = got(ann.nearest(make(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]), k=20))
    assert [i for i, _ in out[0]] == [1, 20] and [i for i, _ in out[20]] == [1, 0]
    assert ann.nearest(make(spark, [])).count() == 0
    assert ann.nearest(make(spark, [(0, [1.0, 0.0])])).count() == 0


def test_balanced_parts():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    part = ann.balanced_parts(ann.neighbour_graph(x, 10), x, 4)
    sizes = np.bincount(part, minlength=16)
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(6000)]
    out, want = got(ann.nearest(make(spark, rows), k=20, query_every=20, sample_rows=3000)), exact(rows, 20, 20)
    hits = sum(len({i for i, _ in near} & {i for i, _ in out[q]}) for q, near in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_few_rows_still_answer_in_full(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 5, 22, 40, 70):
        rows = [(i, rng.normal(size=4).tolist()) for i in range(n)]
        out = got(ann.nearest(make(spark, rows), k=20, query_every=1, target_recall=0.5))
        assert [len(out.get(i, [])) for i in range(n)] == [min(20, n - 1)] * n


def test_parts_grow_with_the_rows():
    assert [1 << ann.parts_depth(n, ann.SAMPLE_ROWS) for n in (0, 1, 15, 500, 2000, 10_000, 10**9)] == [1, 1, 1, 16, 32, 128, 512]


def test_the_query_prunes_and_finds(spark, capsys):
    """Of the parts of the largest sample some are left out, and nine tenths or more of the true neighbours are found."""
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    x = np.unique(np.array([v for _, v in rows], float), axis=0)
    depth = ann.parts_depth(len(x), ann.SAMPLE_ROWS)
    _, probes = ann.train(x, depth, 20)
    out, want = got(op7_learned_partitions(spark, d)), exact(rows, 20, 20)
    hits = sum(len({i for i, _ in near} & {i for i, _ in out[q]}) for q, near in want.items())
    with capsys.disabled():
        print(f" {probes} of {1 << depth} parts probed, recall {hits / sum(map(len, want.values())):.3f}")
    assert depth > 4 and probes < 0.95 * (1 << depth) and 0.9 <= hits / sum(map(len, want.values())) < 1


def test_recall_of_the_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out, want = got(op7_learned_partitions(spark, sf_dir)), exact(rows, 20, 20)
    assert out.keys() == want.keys() and all(len(n) == 20 for n in out.values())
    hits = sum(len({i for i, _ in near} & {i for i, _ in out[q]}) for q, near in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
