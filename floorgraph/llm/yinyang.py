"""Exact k-means in whole numbers with Yinyang bounds.

The centroids are put into a few groups once.  Every vector carries an upper
bound of the distance to its own centroid and one lower bound for each group,
that of the nearest other centroid there.  When centroids move, a round first
loosens the bounds by the moves; a vector whose upper bound stays below all
lower bounds keeps its centroid unseen (the global filter).  Else its own
distance is made exact, and only groups whose lower bound it does not stay
below are scanned, centroid by centroid, exactly (the group filter).

Assignments are those of scanning all centroids: distances are exact integers,
bounds are floats rounded outwards, and a filter holds only if it is strict, so
ties still go to the smaller number.  A round is one pass without an exchange:
tasks write the vectors' new state next to the sums by centroid, which Spark
adds up.  The driver holds k centroids, nothing of the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorgraph.llm.common import shared_path

#: Magnitude up to which squared distances of any 64 components fit 63 bits.
PLAIN = 1 << 27
#: Relative slack of the bounds, beyond what double precision can lose.
SLACK = 1e-9
_STATE = "id long, v array<long>, cluster int, upper double, lower array<double>, distance long"
_SUMS = ", sums array<decimal(38,0)>, size long"


def centroid_groups(centroids: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """Group of each centroid, by a few rounds of k-means over the centroids themselves."""
    x = centroids.astype(np.float64)
    at = x[:n_groups].copy()
    group = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        group = ((x[:, None, :] - at[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(n_groups):
            if (group == g).any():
                at[g] = x[group == g].mean(axis=0)
    return group


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids); an error if one does not fit a long."""
    out = np.empty((len(v), len(centroids)), np.int64)
    if not out.size:
        return out
    dim = max(1, v.shape[1])
    small = max(int(np.abs(v).max()), int(np.abs(centroids).max())) <= min(PLAIN, int(np.sqrt(2**61 / dim)))
    for j, c in enumerate(centroids):
        d = v - c if small else v.astype(object) - c.astype(object)
        found = (d * d).sum(axis=1)
        if not small and max(found) >= 1 << 63:
            raise OverflowError("a squared distance does not fit a long")
        out[:, j] = found
    return out


class Model:
    """Centroids of a round, and how far each has moved since the round before."""

    def __init__(self, centroids: np.ndarray, groups: np.ndarray, before: np.ndarray | None):
        self.centroids, self.groups, self.n_groups = centroids, groups, int(groups.max()) + 1
        self.fresh = before is None
        moves = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids.astype(object) - before.astype(object)) ** 2).sum(axis=1).astype(np.float64))
        self.moves = moves * (1 + SLACK)
        self.group_moves = np.array([self.moves[groups == g].max(initial=0.0) for g in range(self.n_groups)])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds of the vectors, and the number of distances computed."""
        n = len(v)
        if self.fresh:
            cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, self.n_groups))
        else:
            cluster, upper = cluster.copy(), upper + self.moves[cluster]
            lower = lower - self.group_moves
        open_ = np.flatnonzero(lower.min(axis=1) * (1 - SLACK) <= upper * (1 + SLACK))
        if not len(open_):
            return cluster, upper, lower, 0
        own = cluster[open_]
        exact = np.empty(len(open_), np.int64)
        for j in np.unique(own):
            exact[own == j] = squared(v[open_[own == j]], self.centroids[j : j + 1])[:, 0]
        upper[open_] = np.sqrt(exact.astype(np.float64))
        low = lower[open_]
        best, best_d = own.copy(), exact.copy()
        scans = (low * (1 - SLACK) <= (upper[open_] * (1 + SLACK))[:, None]) & (low < np.inf)
        seen, held = len(open_), {}
        for g in range(self.n_groups):
            rows, members = np.flatnonzero(scans[:, g]), np.flatnonzero(self.groups == g)
            if not len(rows) or not len(members):
                continue
            d = squared(v[open_[rows]], self.centroids[members])
            seen += d.size
            held[g] = (rows, members, d)
            near = d.argmin(axis=1)  # of equal distances the smaller number
            found, number = d[np.arange(len(rows)), near], members[near]
            better = (found < best_d[rows]) | ((found == best_d[rows]) & (number < best[rows]))
            best[rows[better]], best_d[rows[better]] = number[better], found[better]
        for g, (rows, members, d) in held.items():  # the nearest of the group that is not the vector's own
            others = np.where(members[None, :] == best[rows][:, None], np.inf, np.sqrt(d.astype(np.float64)))
            low[rows, g] = others.min(axis=1, initial=np.inf)
        left = np.flatnonzero(best != own)  # what a vector leaves bounds the group that it leaves
        g = self.groups[own[left]]
        low[left, g] = np.minimum(low[left, g], upper[open_[left]])
        lower[open_] = low
        cluster[open_] = best
        upper[open_] = np.sqrt(best_d.astype(np.float64))
        return cluster, upper, lower, seen

    def sums(self, v: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Componentwise sums and sizes by cluster, in Python's integers."""
        sums, sizes = np.zeros(self.centroids.shape, object), np.bincount(cluster, minlength=len(self.centroids))
        plain = not v.size or int(np.abs(v).max()) < (1 << 62) // max(1, len(v))
        for j in np.flatnonzero(sizes):
            own = v[cluster == j]
            sums[j] = (own if plain else own.astype(object)).sum(axis=0).astype(object)
        return sums, sizes


def _round(spark: SparkSession, rows: DataFrame, model: Model, path: str, last: bool) -> DataFrame:
    """One pass over the vectors: their state, and rows without an id that hold a task's sums by centroid."""
    shared = spark.sparkContext.broadcast(model)  # k centroids
    k, dim = model.centroids.shape
    decimals = pa.list_(pa.decimal128(38, 0))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total, sizes = np.zeros((k, dim), object), np.zeros(k, np.int64)
        names = ["keyed", "id", "v", "cluster", "upper", "lower", "distance", "sums", "size"]
        for batch in batches:
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy().reshape(n, dim)
            cluster, upper, lower = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1))
            if not m.fresh:
                cluster, upper = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy()
                lower = batch.column("lower").flatten().to_numpy().reshape(n, m.n_groups)
            cluster, upper, lower, _ = m.assign(v, cluster, upper, lower)
            own, count = m.sums(v, cluster)
            total, sizes = total + own, sizes + count
            distance = np.zeros(n, np.int64)
            if last:
                for j in np.unique(cluster):
                    distance[cluster == j] = squared(v[cluster == j], m.centroids[j : j + 1])[:, 0]
            bounds = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m.n_groups, lower.ravel())
            columns = [pa.array(np.ones(n, bool)), batch.column("id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(distance), pa.nulls(n, decimals), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        held = np.flatnonzero(sizes)
        none = lambda kind: pa.nulls(len(held), kind)
        columns = [
            pa.array(np.zeros(len(held), bool)), none(pa.int64()), none(pa.list_(pa.int64())), pa.array(held, pa.int32()), none(pa.float64()), none(pa.list_(pa.float64())),
            none(pa.int64()), pa.array([[int(x) for x in total[j]] for j in held], decimals), pa.array(sizes[held]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(passed, f"keyed boolean, {_STATE}{_SUMS}")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    """Drop a round's table that the next round has replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fit(vectors: DataFrame, start: np.ndarray, rounds: int, n_groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """State (id, v, cluster, distance) after ``rounds`` rounds and a last assignment, and the centroids.

    ``vectors`` (id long, v array<long> of one length) is a written table;
    ``start`` the first centroids, in the order of their numbers.  A round's
    table is removed once the next one is written, so two exist at a time.
    """
    spark, base = vectors.sparkSession, shared_path(vectors.sparkSession, "yinyang")
    groups = centroid_groups(start, max(1, min(len(start), n_groups or max(2, len(start) // 10))))
    centroids, before, rows = start, None, vectors
    for turn in range(rounds + 1):
        last = turn == rounds
        rows = _round(spark, rows.where("keyed").drop("sums", "size") if turn else rows, Model(centroids, groups, before), f"{base}/{turn}", last)
        if turn:
            _removed(spark, f"{base}/{turn - 1}")
        if last:
            return rows.where("keyed").select("id", "v", "cluster", "distance"), centroids
        parts = rows.where("not keyed").select("cluster", "size", F.posexplode("sums").alias("place", "x"))
        summed = parts.groupBy("cluster", "place").agg(F.sum("x").alias("x"), F.sum("size").alias("n")).collect()  # k times the dimension
        before, centroids = centroids, centroids.copy()
        for r in summed:
            centroids[r.cluster, r.place] = int(r.x) // r.n  # floor, also below zero
    raise ValueError("rounds must not be negative")


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dim: int = 64,
    scale: int = 1024,
    seed: int = 3,
    n_groups: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors of exactly ``dim`` components, none null, NaN or infinite, become
    integers floor(``scale`` x).  The first centroids are the ``k`` with the
    smallest hexadecimal SHA-256 of "``seed``:id" (ties by components; a null id
    counts as an empty one), all of them if there are fewer.  A centroid that
    loses all its vectors stays.  Repeated rows are vectors of their own, with
    equal results.  No vectors: no rows.  Other columns are ignored.
    Components or squared distances that do not fit a long are an error.
    """
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    sound = F.forall("_x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("_x")).where((F.size("_x") == dim) & sound)
    rows = rows.select("id", F.transform("_x", lambda e: F.floor(e * scale).cast("long")).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select("v", key.alias("_key")).orderBy("_key", "v").limit(k).collect()  # k rows
    if not first:
        blank = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], blank)
    found, centroids = fit(rows, np.array([r.v for r in first], np.int64), rounds, n_groups)
    totals = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digest = {j: hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest() for j in totals}
    by = lambda values: F.create_map(*[F.lit(e) for pair in values.items() for e in pair])[F.col("cluster")]  # noqa: E731 k entries
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        by(totals).cast("long").alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"), by(digest).alias("centroid_sha256"),
    )
