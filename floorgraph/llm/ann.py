"""Nearest neighbours by learned partitions.

From a bounded sample the neighbour graph is built and cut into balanced parts
(recursive spectral bisection at the median).  A small classifier learns the
part of a sample vector from the vector.  It deals every row into its most
probable part, and every query to the several most probable ones, whose rows
are ranked by the exact inner product in double precision.  How many parts are
probed is calibrated on sample vectors that the classifier did not see, so
that the target recall is met; a query goes on to further parts, in its order of
probability, until those hold enough rows for a whole answer.  A target of one
probes all parts, which is exact.

Equal vectors are one row of the index with their smallest ids, as many as a
result can hold, and one query.  Both the rows and the queries of a part are
dealt into chunks of bounded size, a cell for each pair of chunks, so neither a
hot vector nor a hot part is one task's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorgraph.llm.common import written

SAMPLE_ROWS, CHUNK_ROWS, TARGET_RECALL = 8192, 8192, 0.96
#: Sample rows that a part of its own needs to be learned.
ROWS_TO_LEARN = 16


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest others of each vector by inner product."""
    out = np.empty((len(x), degree), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Part of each node of the graph: 2**depth parts whose sizes differ by one at most per split."""
    part = np.zeros(len(graph), np.int64)
    local = np.full(len(graph), -1, np.int64)
    for _ in range(depth):
        nxt = np.zeros_like(part)
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            local[:] = -1
            local[nodes] = np.arange(len(nodes))
            near = local[graph[nodes]]
            row, col = np.nonzero(near >= 0)
            to = near[row, col]
            weight = np.bincount(row, minlength=len(nodes)) + np.bincount(to, minlength=len(nodes)) + 1e-9
            # start from the direction of largest spread, which a few sparse steps then smooth along the graph
            centred = x[nodes] - x[nodes].mean(axis=0)
            v = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            for _ in range(30):
                v = v - (v * weight).sum() / weight.sum()
                v = 0.5 * v + 0.5 * (np.bincount(row, v[to], len(nodes)) + np.bincount(to, v[row], len(nodes))) / weight
                v /= np.linalg.norm(v) + 1e-30
            order = np.lexsort((nodes, v))
            side = np.zeros(len(nodes), np.int64)
            side[order[len(nodes) // 2 :]] = 1
            nxt[nodes] = 2 * p + side
        part = nxt
    return part


@dataclass
class Router:
    """One hidden layer and a softmax over the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, n_parts: int, hidden: int = 128, epochs: int = 40, seed: int = 0) -> Router:
        """Trained on vectors in units of their mean length, so that large components do not upset it."""
        rng = np.random.default_rng(seed)
        scale = float(np.linalg.norm(x, axis=1).mean()) or 1.0
        scale = scale if np.isfinite(scale) else float(np.abs(x).max())
        x = x / scale
        p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, n_parts)), np.zeros(n_parts)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(rows)), part[rows]] -= 1
                z /= len(rows)
                back = (z @ p[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ z, z.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= 0.005 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(*p, scale)


def train(x: np.ndarray, depth: int, k: int, target: float = TARGET_RECALL) -> tuple[Router, int]:
    """Router and number of parts to probe, from the sample; all parts for a target of one."""
    n_parts = 1 << depth
    if not depth:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    test = np.arange(len(x)) % 10 == 0
    fit, asked = x[~test], x[test]
    k = min(k, len(fit) - 1)
    part = balanced_parts(neighbour_graph(fit, k), fit, depth)
    router = Router.fit(fit, part, n_parts)
    if target >= 1:
        return router, n_parts
    dealt = router.logits(fit).argmax(axis=1)
    scores = asked @ fit.T
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rank = np.empty((len(asked), n_parts), np.int64)
    np.put_along_axis(rank, np.argsort(-router.logits(asked), axis=1), np.arange(n_parts)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, dealt[near], axis=1), axis=None)
    return router, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def parts_depth(n: int, sample_rows: int) -> int:
    """Levels of bisection: about the root of n parts, as far as the sample has rows to learn each."""
    learnable = max(1, min(n, sample_rows) // ROWS_TO_LEARN)
    return int(min(round(np.log2(max(n, 1)) / 2), np.floor(np.log2(learnable))))


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``query_every``, candidates
    all rows but the query's own; nearness is the largest inner product of the
    original vectors in double precision, ties to the smaller id.  Null
    vectors and ids, zero vectors and those with null, NaN or infinite
    components or of another length than most take no part.  Rows that repeat
    an id and vector count once.  Fewer than ``k`` candidates: all.  An empty
    table gives no rows.  Other columns are ignored.  ``target_recall`` 1 is exact.
    """
    vec = F.transform(F.col("v"), lambda e: e.cast("double"))
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null").withColumn("v", vec).where(sound)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    rows = written(rows.where(F.size("v") == dim).distinct(), "vectors")
    # of equal vectors a result can hold k, and one more if the query is among them
    by_vector = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1)
    points = some.groupBy("v").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    points = written(points, "points")
    n = points.count()
    sample = points.orderBy(F.xxhash64("point"), "point").limit(sample_rows).select("v").toPandas()  # bounded by sample_rows
    x = np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, max(dim, 1)))
    depth = parts_depth(n, sample_rows)
    router, probes = train(x, depth, k, target_recall)
    best = k + 1
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    @F.pandas_udf("int")
    def to_part(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.logits(np.stack(v.to_numpy())).argmax(axis=1) if len(v) else [], dtype="int32")

    dealt = written(points.withColumn("part", to_part("v")), "parts")
    sizes = np.zeros(1 << depth, np.int64)
    for r in dealt.groupBy("part").count().collect():  # a row for each part
        sizes[r["part"]] = r["count"]

    @F.pandas_udf("array<int>")
    def to_parts(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        order = np.argsort(-shared.value.logits(np.stack(v.to_numpy())), axis=1, kind="stable").astype(np.int32)
        enough = (np.cumsum(sizes[order], axis=1) < best).sum(axis=1) + 1
        return pd.Series([row[: max(probes, m)] for row, m in zip(order, enough, strict=True)])

    queries = rows.where(F.pmod("id", F.lit(query_every)) == 0).select(F.col("id").alias("query_id"), "v")
    distinct = queries.groupBy("v").agg(F.min("query_id").alias("asked"))
    routed = written(distinct.withColumn("part", F.explode(to_parts("v"))).select("part", "asked", "v"), "queries")
    count = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias(name))
    chunks = F.broadcast(count(dealt, "chunks").join(count(routed, "batches"), "part"))  # a row for each part
    own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = dealt.join(chunks, "part").select("part", own("point", "chunks").alias("chunk"), every("batches").alias("batch"), "point", "v")
    routed = routed.join(chunks, "part").select("part", every("chunks").alias("chunk"), own("asked", "batches").alias("batch"), "asked", "v")

    def rank(cell: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out_q, out_p, out_s = [], [], []
        if len(q) and len(c):
            points, values = c["point"].to_numpy(), np.stack(c["v"].to_numpy())
            asked, wanted = q["asked"].to_numpy(), np.stack(q["v"].to_numpy())
            longest = np.linalg.norm(values, axis=1).max()
            for a in range(0, len(asked), 256):
                # a product of matrices may round by so much of the vectors' lengths, and what lies that near is compared exactly
                slack = 1e-15 * (wanted.shape[1] + 2) * np.linalg.norm(wanted[a : a + 256], axis=1) * longest
                rough = wanted[a : a + 256] @ values.T
                kth = np.partition(rough, -best, axis=1)[:, -best] if len(points) > best else np.full(len(rough), -np.inf)
                for i, row in enumerate(rough):
                    cut = kth[i] - 2 * slack[i]
                    near = np.flatnonzero(row >= cut) if np.isfinite(cut) and np.isfinite(row).all() else np.arange(len(row))
                    exact = (values[near] * wanted[a + i]).sum(axis=1)
                    order = np.lexsort((points[near], -exact))[:best]  # what overflows to no number comes last
                    out_q.append(np.full(len(order), asked[a + i]))
                    out_p.append(points[near[order]])
                    out_s.append(exact[order])
        empty = [np.zeros(0, np.int64)]
        return pd.DataFrame({"asked": np.concatenate(out_q or empty), "point": np.concatenate(out_p or empty), "score": np.concatenate(out_s or [np.zeros(0)])})

    ranked = routed.groupBy("part", "chunk", "batch").cogroup(held.groupBy("part", "chunk", "batch")).applyInPandas(rank, "asked long, point long, score double")
    by_query = Window.partitionBy("asked").orderBy(F.desc("score"), "point")
    top = ranked.withColumn("_n", F.row_number().over(by_query)).where(F.col("_n") <= best)
    # the points' ids, ordered by score and id: at most (k + 1) squared a query
    top = top.join(points.select(F.col("point").alias("_point"), "ids"), F.col("point") == F.col("_point"))
    listed = top.groupBy("asked").agg(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))).alias("all"))
    listed = listed.select(F.col("asked").alias("_asked"), F.slice(F.array_sort(F.flatten("all")), 1, best).alias("near"))
    asked_by = queries.join(distinct.select(F.col("v").alias("_v"), "asked"), F.col("v") == F.col("_v")).select("query_id", "asked")
    found = asked_by.join(listed, F.col("asked") == F.col("_asked")).select("query_id", F.slice(F.filter("near", lambda c: c["i"] != F.col("query_id")), 1, k).alias("near"))
    return found.select("query_id", F.posexplode("near").alias("_at", "_c")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_c.i").alias("vec_id"), (-F.col("_c.s")).alias("score"))
