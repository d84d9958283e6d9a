"""Centroid clustering with adaptive bounds.

Every vector keeps an upper bound of its distance to its own centroid, lower bounds for the several
centroids that were nearest when last looked at, and one lower bound for all the rest. When centroids
have moved, the bounds move by as much; where the upper bound stays below all lower bounds nothing is
looked at, where it stays below those from some place on only the centroids before that place are
looked at, and else all are. Bounds are floating point with a margin to the safe side, what is looked
at is exact integer arithmetic, so the result is that of a full search, ties included.

Vectors and bounds are a table that each round writes anew; nothing but partial sums by cluster is
shuffled, and only centroids and sums, k x dim numbers, reach the driver.

Defined results: vectors of another length, or with a null or non-finite component, are dropped, and
null vectors with them; a null id is kept and comes last where centroids are chosen; rows that repeat
are vectors each (of equal ids the smaller components come first); with fewer than k vectors there are
as many centroids as vectors; equal centroids leave all to the smaller number; a centroid without
vectors stays where it is; a component of 2**27 and more once scaled stops the job, as squared
distances would not fit 64 bits; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm.caches import trimmed
from webgrain.llm.scratch import cut

LARGEST = 1 << 27
#: Relative margin of bounds: far over the rounding of their square roots and sums, far under a unit of distance.
MARGIN = 1e-9
ROWS = 8192
STATE = "vec_id bigint, vec array<int>, places array<int>, upper double, lower array<double>, rest double, scans int, distance bigint"


def scaled(vectors: DataFrame, dim: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec, the components times scale, rounded down."""
    vec, x = F.col(vec_col), F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = vec.isNotNull() & (F.size(vec) == dim) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    too_large = F.raise_error(F.lit(f"a component exceeds {LARGEST} once scaled"))
    small = F.transform(x, lambda y: F.when(F.abs(y * scale) < LARGEST, F.floor(y * scale)).otherwise(too_large).cast("int"))
    return vectors.where(sound).select(F.col(id_col).cast("bigint").alias("vec_id"), small.alias("vec"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids, after salt, have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    return np.array([r["vec"] for r in rows], np.int64)


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    if not len(x) or max(np.abs(x).max(), np.abs(c).max()) >= 1 << 22:
        return np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    a, b = x.astype(float), c.astype(float)  # below 2**53 the products and sums of floating point are whole numbers
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


class Bounds:
    """One batch: places (centroids by nearness, own first), upper, lower (for places after the first), rest."""

    def __init__(self, n: int, width: int):
        self.places, self.lower = np.zeros((n, width + 1), np.int32), np.zeros((n, width))
        self.upper, self.rest, self.scans = np.zeros(n), np.zeros(n), np.zeros(n, np.int32)

    def look_at_all(self, at: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> None:
        d, width = exact_distances(x[at], centroids), self.lower.shape[1]
        order = np.argsort(d, 1, kind="stable")  # of equal distances the smaller number
        near = np.sqrt(np.take_along_axis(d, order[:, :width + 2], 1))
        self.places[at] = order[:, :width + 1]
        self.upper[at], self.lower[at] = near[:, 0] * (1 + MARGIN), near[:, 1:width + 1] * (1 - MARGIN)
        self.rest[at] = near[:, width + 1] * (1 - MARGIN) if width + 1 < len(centroids) else np.inf
        self.scans[at] += len(centroids)

    def look_at_first(self, at: np.ndarray, x: np.ndarray, centroids: np.ndarray, n: int) -> None:
        """Of the rows at, the own centroid and the n next ones."""
        places = self.places[at, :n + 1]
        d = ((x[at][:, None, :] - centroids[places]) ** 2).sum(2)
        order = np.lexsort((places, d), axis=1)
        near = np.sqrt(np.take_along_axis(d, order, 1))
        self.places[at, :n + 1] = np.take_along_axis(places, order, 1)
        self.upper[at], self.lower[at, :n] = near[:, 0] * (1 + MARGIN), near[:, 1:] * (1 - MARGIN)
        self.scans[at] += n

    def follow(self, moved: np.ndarray) -> None:
        """Centroids have moved by so much."""
        self.upper = (self.upper + moved[self.places[:, 0]]) * (1 + MARGIN)
        shifted = self.lower - moved[self.places[:, 1:]]
        self.lower, self.rest = shifted - np.abs(shifted) * MARGIN, self.rest - moved.max() * (1 + MARGIN)

    def settle(self, x: np.ndarray, centroids: np.ndarray) -> None:
        """Look again wherever the order is not certain, at the own centroid first."""
        width = self.lower.shape[1]
        beyond = np.minimum.accumulate(np.column_stack([self.lower, self.rest])[:, ::-1], 1)[:, ::-1]  # from this place on nothing is nearer
        at = np.flatnonzero(self.upper >= beyond[:, 0])
        self.upper[at] = np.sqrt(((x[at] - centroids[self.places[at, 0]]) ** 2).sum(1)) * (1 + MARGIN)
        self.scans[at] += 1
        doubtful = (self.upper[:, None] >= beyond).sum(1)
        for n in range(1, width + 1):
            if len(at := np.flatnonzero(doubtful == n)):
                self.look_at_first(at, x, centroids, n)
        if len(at := np.flatnonzero(doubtful > width)):
            self.look_at_all(at, x, centroids)


def _numbers(column: pa.Array, kind, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def assigned(spark: SparkSession, state: DataFrame, centroids: np.ndarray, former: np.ndarray | None, width: int) -> DataFrame:
    """The state after one assignment; former: the centroids that the bounds of state hold for, None where there are none yet."""
    given = spark.sparkContext.broadcast((centroids, former))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = given.value
        moved = None if old is None else np.sqrt(((new - old) ** 2).sum(1)) * (1 + MARGIN)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                x = _numbers(batch.column("vec"), np.int64, new.shape[1])
                own = Bounds(n, width)
                if moved is None:
                    own.look_at_all(np.arange(n), x, new)
                else:
                    own.places, own.lower = _numbers(batch.column("places"), np.int32, width + 1), _numbers(batch.column("lower"), float, width)
                    own.upper, own.rest, own.scans = (batch.column(c).to_numpy().copy() for c in ("upper", "rest", "scans"))
                    own.follow(moved)
                    own.settle(x, new)
                distance = ((x - new[own.places[:, 0]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vec"), _lists(own.places, pa.int32()), pa.array(own.upper), _lists(own.lower, pa.float64()),
                     pa.array(own.rest), pa.array(own.scans, pa.int32()), pa.array(distance)],
                    names=["vec_id", "vec", "places", "upper", "lower", "rest", "scans", "distance"])

    return state.mapInArrow(trimmed(run), STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the mean of its vectors, rounded down; one row a cluster reaches the driver."""
    dim = centroids.shape[1]
    sums = state.groupBy(F.col("places")[0].alias("cluster")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(dim)]).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, salt: str = "1:", width: int | None = None,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Vectors with their clusters, and the centroids.

    The table has vec_id, vec (scaled), cluster, distance (squared) and scans, how many distances were taken
    exactly to find clusters in all rounds. width: lower bounds kept for single centroids, by default a quarter of k.
    """
    spark = vectors.sparkSession
    rows = cut(scaled(vectors, dim, scale, id_col, vec_col), "vectors")
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        return rows.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).alias("scans")), np.zeros((0, dim), np.int64)
    width = min(len(centroids) - 1, max(1, k // 4) if width is None else width)
    state, former = cut(assigned(spark, rows, centroids, None, width), "bounds"), centroids
    for _ in range(rounds):
        centroids = moved_centroids(state, former)
        state, former = cut(assigned(spark, state, centroids, former, width), "bounds"), centroids
    return state.select("vec_id", "vec", F.col("places")[0].alias("cluster"), "distance", "scans"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256; what is broadcast has one row a cluster."""
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster")
