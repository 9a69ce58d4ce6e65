"""Centroid clustering in whole numbers, with bounds loosened by geometry instead of by full drift.

Each vector keeps the distance to its own centroid and a lower bound of the distance to any other. When
the centroids move, the bound of a vector in cluster *a* must fall by as much as any other centroid may
have come nearer. The full drift of that centroid is always enough. Less is enough where the vectors of
the cluster, all of which lie in a sphere around their centroid, don't lie ahead of the movement: while
a centroid moves by a step *s* in direction *u*, its distance to a point *x* changes by at most *s* times
the cosine of the angle between *u* and the line from the step's beginning to *x*. Sphere, centroid
and direction lie in a plane (the sphere is symmetric around it), where the largest such cosine is that of the
angle to the sphere's centre less the angle the sphere fills. The way of a centroid is cut into steps,
whose bounds add up.

A vector is settled if the distance to its own centroid is below the loosened bound, or below half the
distance from its centroid to the nearest other one. All others are scanned exactly against all centroids.

Distances are exact: components are whole numbers, computed in double precision while all sums stay below
2^53 and in Python's whole numbers beyond, which holds for any magnitude; a distance or inertia above the
largest long is given as the largest long. Bounds are rounded to the safe side.

Vectors never move between tasks: a round reads the state table and writes the next one, and the new
centroids come from sums over the vectors that changed their cluster, added up by Spark.

Defined cases: vectors that are null, of another length, or hold a null, a NaN or an infinite component
(before or after scaling) take no part and get no row. Fewer vectors than clusters give fewer clusters, an
empty table an empty one. Repeated rows all take part. Seeds with equal ids are ordered by their components;
null ids come last among the seeds. An empty cluster keeps its centroid. Extra columns are not
read; the id column keeps its name and type.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

Centroids = list[list[int]]

#: Components below this size keep all sums of a distance exact in double precision (for up to 128 of them).
EXACT_BELOW = 2.0**22
#: Steps that a centroid's way is cut into.
STEPS = 8
#: Relative room for rounding in bounds.
SLACK = 1e-9
#: Bits of the pieces in which sums are added up.
LIMB = 40
#: The largest long.
TOP = 2**63 - 1
LARGEST = np.finfo(np.float64).max
#: Beyond this size centroids give no bounds: their squares would not fit a double.
NO_BOUNDS = 1e100
#: Rows worked on at once.
BLOCK = 4096


def whole(frame: DataFrame, vec_id: str, embedding: str, dims: int, scale: float) -> DataFrame:
    """``vec_id`` and ``at``, the scaled components rounded down, of all vectors that take part."""
    scaled = F.transform(F.col(f"`{embedding}`").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    finite = F.forall("at", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = frame.select(F.col(f"`{vec_id}`").alias("vec_id"), scaled.alias("at")).filter((F.size("at") == dims) & finite)
    # a double's floor as a double: what is 2^52 or more is whole already and would not fit a long
    floor = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    return kept.select("vec_id", F.transform("at", floor).alias("at"))


def seeds(vectors: DataFrame, k: int, seed: str) -> Centroids:
    """The k vectors whose ``seed``:id has the smallest SHA-256, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(digest.alias("digest"), "at").orderBy(F.asc_nulls_last("digest"), "at").limit(k).collect()
    return [[int(x) for x in r["at"]] for r in first]


class Scan:
    """Exact squared distances from blocks of vectors to the centroids."""

    def __init__(self, centroids: Centroids):
        self.centroids = centroids
        self.exact = max((abs(x) for c in centroids for x in c), default=0) < EXACT_BELOW
        if self.exact:
            self.matrix = np.array(centroids, np.float64)
            self.norms = (self.matrix**2).sum(1)

    def fits(self, block: np.ndarray) -> bool:
        return self.exact and (not block.size or np.abs(block).max() < EXACT_BELOW)

    def own(self, block: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The squared distance of each row to its own centroid."""
        if self.fits(block):
            return ((block - self.matrix[cluster]) ** 2).sum(1)
        rows = [[int(x) for x in row] for row in block]
        return np.array([sum((x - y) ** 2 for x, y in zip(row, self.centroids[c], strict=True)) for row, c in zip(rows, cluster, strict=True)], object)

    def all(self, block: np.ndarray) -> np.ndarray:
        """The squared distance of each row to each centroid."""
        if self.fits(block):
            return (block**2).sum(1)[:, None] - 2.0 * (block @ self.matrix.T) + self.norms
        return np.stack([self.own(block, np.full(len(block), c)) for c in range(len(self.centroids))], 1) if len(block) else np.zeros((0, len(self.centroids)))


def root(squared: np.ndarray) -> np.ndarray:
    """Square roots as doubles; the largest double where there is no nearer one."""
    if squared.dtype != object:
        return np.sqrt(squared)
    return np.array([math.sqrt(x) if x < 1 << 1000 else float(min(math.isqrt(int(x)), int(LARGEST))) for x in squared], np.float64)


def loosening(old: Centroids, new: Centroids, radius: list[float]) -> np.ndarray:
    """By how much the lower bound of each cluster's vectors must fall: never more than the largest drift of the other centroids."""
    start, end = np.array(old, np.float64), np.array(new, np.float64)
    if max(np.abs(start).max(), np.abs(end).max()) > NO_BOUNDS:
        return np.full(len(old), np.inf)
    way = end - start
    drift = np.sqrt((way**2).sum(1))
    unit = way / np.where(drift > 0, drift, 1.0)[:, None]
    out = np.zeros(len(old))
    for a in range(len(old)):
        nearer = np.zeros(len(old))
        for step in range(STEPS):
            # from the centroid at the step's beginning to the sphere's centre, and its part along the way
            line = start[a] - (start + way * (step / STEPS))
            length = np.sqrt((line**2).sum(1))
            outside = length > radius[a]
            safe = np.where(outside, length, 1.0)
            to_centre = np.arccos(np.clip((line * unit).sum(1) / safe, -1.0, 1.0))
            filled = np.arcsin(np.clip(radius[a] / safe, 0.0, 1.0))
            cosine = np.where(outside, np.cos(np.maximum(to_centre - filled, 0.0)), 1.0)
            nearer += drift / STEPS * np.minimum(cosine + SLACK, 1.0)
        nearer[a] = -np.inf
        out[a] = nearer.max() if len(old) > 1 else 0.0
    return out


def gaps(centroids: Centroids) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    points = np.array(centroids, np.float64)
    if np.abs(points).max() > NO_BOUNDS:
        return np.zeros(len(points))
    far = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    return far.min(1) / 2.0


def settle(
    block: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None, scan: Scan, fall: np.ndarray, gap: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, squared distance, lower bound and whether it was scanned, of each row, after the centroids have moved."""
    if cluster is None:
        open_ = np.ones(len(block), bool)
        cluster, bound, squared = np.zeros(len(block), np.int32), np.zeros(len(block)), np.zeros(len(block), np.float64 if scan.fits(block) else object)
    else:
        cluster, bound = cluster.copy(), lower - fall[cluster]
        squared = scan.own(block, cluster)
        bound -= SLACK * (np.abs(lower) + np.abs(fall[cluster]))
        open_ = ~(root(squared) * (1.0 + SLACK) < np.maximum(bound, gap[cluster] * (1.0 - SLACK)))
    if open_.any():
        far = scan.all(block[open_])
        best = far.argmin(1).astype(np.int32)
        if squared.dtype != far.dtype:
            squared = squared.astype(object)
        squared[open_] = far[np.arange(len(far)), best]
        cluster[open_] = best
        if far.shape[1] > 1:
            far[np.arange(len(far)), best] = far.max(1) + 1
            bound[open_] = root(far.min(1)) * (1.0 - SLACK)
        else:
            bound[open_] = np.inf
    return cluster, squared, bound, open_


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK):
        part = batch.slice(start, BLOCK)
        yield part, part.column("at").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


def assigned(state: DataFrame, centroids: Centroids, fall: np.ndarray, gap: np.ndarray) -> DataFrame:
    """The next state: each vector with its cluster under ``centroids``, and the one it ``was`` in (-1: none yet)."""
    dims, first = len(centroids[0]), "cluster" not in state.columns
    kind = state.schema["vec_id"].dataType.simpleString()
    keep = ["vec_id", "at"] if first else ["vec_id", "at", "cluster", "lower"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(centroids)
        for batch in batches:
            for part, block in _blocks(batch, dims):
                was = None if first else part.column("cluster").to_numpy()
                cluster, squared, lower, scanned = settle(block, was, None if first else part.column("lower").to_numpy(), scan, fall, gap)
                whole_ = squared.astype(np.int64) if squared.dtype != object else [min(int(x), TOP) for x in squared]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("at"), pa.array(cluster, pa.int32()),
                     pa.array(np.full(len(block), -1) if first else was, pa.int32()), pa.array(whole_, pa.int64()),
                     pa.array(root(squared) * (1.0 + SLACK), pa.float64()), pa.array(lower, pa.float64()), pa.array(scanned)],
                    names=["vec_id", "at", "cluster", "was", "distance", "far", "lower", "scanned"])

    return state.select(*keep).mapInArrow(
        run, f"vec_id {kind}, at array<double>, cluster int, was int, distance long, far double, lower double, scanned boolean")


def limbs(value: int) -> list[int]:
    """A whole number in pieces of ``LIMB`` bits, lowest first; only the last may be negative."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def moves(state: DataFrame, k: int, dims: int) -> DataFrame:
    """By how much each cluster's number of vectors (``axis`` -1) and sum along each axis has changed, in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims + 1) for _ in range(k)]
        for batch in batches:
            for part, block in _blocks(batch, dims):
                exact = not block.size or np.abs(block).max() < EXACT_BELOW
                for sign, name in ((1, "cluster"), (-1, "was")):
                    at = part.column(name).to_numpy()
                    for c in np.unique(at[at >= 0]):
                        rows = block[at == c]
                        sums = [int(x) for x in rows.sum(0)] if exact else [sum(int(x) for x in column) for column in rows.T]
                        for axis, value in enumerate([len(rows), *sums]):
                            total[c][axis] += sign * value
        rows = [(c, axis - 1, place, piece) for c in range(k) for axis in range(dims + 1) for place, piece in enumerate(limbs(total[c][axis])) if piece]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "axis", "place", "piece"])

    changed = state.filter(F.col("cluster") != F.col("was")).select("at", "cluster", "was")
    pieces = changed.mapInArrow(run, "cluster int, axis int, place int, piece long")
    return pieces.groupBy("cluster", "axis", "place").agg(F.sum("piece").alias("piece"))


class Clustering:
    """The state after the last assignment, its centroids, and how many vectors each round scanned."""

    def __init__(self, state: DataFrame | None, centroids: Centroids, scanned: list[tuple[int, int]]):
        self.state, self.centroids, self.scanned = state, centroids, scanned


def cluster(
    frame: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1",
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> Clustering:
    """Assign every vector to its nearest centroid (ties: the smaller number) and move the centroids, ``rounds`` times; then assign once more.

    A centroid moves to the mean of its vectors, rounded down. Only numbers of the size k x dims come to the driver.
    """
    state = store(whole(frame, vec_id, embedding, dims, scale), "vectors")
    centroids = seeds(state, k, seed)
    if not centroids:
        return Clustering(None, [], [])
    sums = [[0] * (dims + 1) for _ in centroids]
    fall = gap = np.zeros(len(centroids))
    scanned = []
    for turn in range(rounds + 1):
        state = store(assigned(state, centroids, fall, gap), f"assigned-{turn}")
        told = state.groupBy("cluster").agg(
            F.max("far").alias("far"), F.count("*").alias("n"), F.sum(F.col("scanned").cast("long")).alias("scanned")).collect()
        scanned.append((sum(r["scanned"] for r in told), sum(r["n"] for r in told)))
        if turn == rounds:
            break
        for r in moves(state, len(centroids), dims).collect():
            sums[r["cluster"]][r["axis"] + 1] += r["piece"] << (LIMB * r["place"])
        moved = [[x // s[0] for x in s[1:]] if s[0] else c for c, s in zip(centroids, sums, strict=True)]
        far = {r["cluster"]: r["far"] for r in told}
        fall, gap = loosening(centroids, moved, [far.get(c, 0.0) for c in range(len(centroids))]), gaps(moved)
        centroids = moved
    return Clustering(state, centroids, scanned)


def _lookup(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def table_of(found: Clustering, frame: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """One row per vector: its id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    kind = frame.schema[vec_id].dataType.simpleString()
    if found.state is None:
        return frame.sparkSession.createDataFrame(
            [], f"`{vec_id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spent = dict(found.state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    sums = [int(spent.get(c, 0)) for c in range(len(found.centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.state.select(
        F.col("vec_id").alias(vec_id), "cluster", "distance", _lookup([min(s, TOP) for s in sums], "long").alias("cluster_inertia"),
        F.lit(min(sum(sums), TOP)).cast("long").alias("inertia"), _lookup(digests, "string").alias("centroid_sha256"))
