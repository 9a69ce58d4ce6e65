"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Vectors fall into bands by their norm and within these into shards by a hash. Each shard's graph is built in one task and stored as flat
arrays: per level the node numbers and a matrix of neighbours, padded with -1. Queries visit
every shard in blocks; shard results are scored exactly and merged.

Inner product turns into cosine by one more coordinate (the norm each vector lacks to the
longest of its shard), so the graph holds unit vectors. Norms of a band differ by a factor of four at
most, so that this coordinate leaves the others their resolution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

#: Distinct vectors in a shard, about.
SHARD_ROWS = 16_384
#: Links of a node on upper levels; the lowest level has twice as many.
LINKS = 16
#: Candidates looked at when a node's links are chosen, and kept when a query walks a graph.
BUILD_WIDTH, SEARCH_WIDTH = 64, 192
#: Query vectors that walk together.
QUERY_BLOCK = 256
#: Query vectors, about, that one copy of a shard's index serves; they stream past it.
TASK_QUERIES = 100_000
#: Tasks of a search, at most; with more shards a task takes several, one after the other.
TASKS = 20_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the coordinate that makes all of them as long as the longest, at length one."""
    vectors = vectors / np.abs(vectors).max()  # squares stay finite
    norms = (vectors * vectors).sum(axis=1)
    longest = norms.max()
    return (np.column_stack([vectors, np.sqrt(np.maximum(longest - norms, 0))]) / np.sqrt(longest)).astype(np.float32)


def _choose(points: np.ndarray, candidates: np.ndarray, sims: np.ndarray, limit: int) -> np.ndarray:
    """Up to ``limit`` links of each row out of candidates sorted by falling similarity (-1: none).

    A candidate is taken if it is nearer to the row than to any link taken before; what is
    missing is filled with the nearest of the rest.
    """
    rows, width = candidates.shape
    near = points[np.maximum(candidates, 0)]
    between = near @ near.transpose(0, 2, 1)
    taken, closest = np.zeros((rows, width), bool), np.full((rows, width), -np.inf, np.float32)
    count = np.zeros(rows, np.int64)
    for k in range(width):
        good = (candidates[:, k] >= 0) & (count < limit) & (sims[:, k] > closest[:, k])
        taken[:, k] = good
        count += good
        closest = np.where(good[:, None], np.maximum(closest, between[:, :, k]), closest)
    rank = np.argsort(~taken * 2 + (candidates < 0) * 4, axis=1, kind="stable")[:, :limit]
    chosen = np.take_along_axis(candidates, rank, axis=1)
    return np.pad(chosen, ((0, 0), (0, limit - chosen.shape[1])), constant_values=-1) if chosen.shape[1] < limit else chosen


def _layer(points: np.ndarray, limit: int, width: int) -> np.ndarray:
    """Neighbours of each point, inserted one after another: links to nearest earlier points, and back."""
    n = len(points)
    links = np.full((n, LINKS), -1, np.int64)
    for at in range(0, n, 512):
        end = min(n, at + 512)
        sims = points[at:end] @ points[:end].T
        sims[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = -np.inf
        k = min(width, end)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(sims, best, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
        best[np.isneginf(value)] = -1
        links[at:end] = _choose(points, best, value, LINKS)
    source = np.repeat(np.arange(n), LINKS)
    target = links.ravel()
    source, target = source[target >= 0], target[target >= 0]
    both = np.unique(np.concatenate([source * n + target, target * n + source]))
    source, target = both // n, both % n
    value = np.einsum("ij,ij->i", points[source], points[target])
    order = np.lexsort((-value, source))
    source, target, value = source[order], target[order], value[order]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    keep = place < width
    candidates, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
    candidates[source[keep], place[keep]], sims[source[keep], place[keep]] = target[keep], value[keep]
    out = np.empty((n, limit), np.int32)
    for at in range(0, n, 512):
        out[at:at + 512] = _choose(points, candidates[at:at + 512], sims[at:at + 512], limit)
    return out


class Graph:
    """Levels of (node numbers, neighbours), the lowest one first, over unit vectors."""

    def __init__(self, points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.points, self.levels = points, levels

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 5, width: int = BUILD_WIDTH) -> Graph:
        """The rows' order is the order of insertion."""
        points = _unit(vectors)
        height = (-np.log(np.random.default_rng(seed).random(len(points))) / np.log(LINKS)).astype(int)
        levels = []
        for level in range(height.max() + 1):
            nodes = np.flatnonzero(height >= level)
            levels.append((nodes, _layer(points[nodes], LINKS * (1 + (level == 0)), width)))
        return Graph(points, levels)

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Node numbers of about the ``width`` nearest of each query (-1: fewer found)."""
        # only the direction of a query counts
        queries = np.column_stack([queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros(len(queries))]).astype(np.float32)
        entry = np.zeros((len(queries), 1), np.int64)
        nodes = self.levels[-1][0]
        for level in range(len(self.levels) - 1, -1, -1):
            nodes, links = self.levels[level]
            found = self._walk(self.points[nodes], links, queries, entry, width if level == 0 else 16)
            if level:
                below = np.searchsorted(self.levels[level - 1][0], nodes)
                entry = np.where(found >= 0, below[np.maximum(found, 0)], -1)
        return found

    @staticmethod
    def _walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, step: int = 4) -> np.ndarray:
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(points) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True

        def look(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids = np.sort(ids, axis=1)
            new = ~seen[rows, ids]
            new[:, 1:] &= ids[:, 1:] != ids[:, :-1]
            seen[rows, ids] = True
            sims = np.einsum("qd,qkd->qk", queries, points[np.maximum(ids, 0)])
            return np.where(new, ids, -1), np.where(new, sims, -np.inf)

        beam, value = look(entry)
        open_ = beam >= 0
        while open_.any():
            # the beam is sorted, so the first open places are the best
            place = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            chosen = np.where(np.take_along_axis(open_, place, axis=1), np.take_along_axis(beam, place, axis=1), -1)
            np.put_along_axis(open_, place, False, axis=1)
            around = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(queries), -1)
            ids, sims = look(around)
            beam = np.concatenate([beam, ids], axis=1)
            value = np.concatenate([value, sims], axis=1)
            open_ = np.concatenate([open_, ids >= 0], axis=1)
            order = np.argsort(-value, axis=1, kind="stable")[:, :width]
            beam, value, open_ = (np.take_along_axis(x, order, axis=1) for x in (beam, value, open_))
        return beam

    def arrays(self) -> list[bytes]:
        return [x.astype("<i4").tobytes() for level in self.levels for x in level]

    @staticmethod
    def load(vectors: np.ndarray, flat: list[bytes]) -> Graph:
        points = _unit(vectors)
        plain = [np.frombuffer(x, "<i4").astype(np.int64) for x in flat]
        return Graph(points, [(n, k.reshape(len(n), -1)) for n, k in zip(plain[::2], plain[1::2])])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, copies: int) -> DataFrame:
    """Distinct vectors with their smallest ids; a vector's copies are counted down in salted groups first."""
    salted = Window.partitionBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= copies)
    each = Window.partitionBy("vector").orderBy("vec_id")
    few = few.withColumn("r", F.row_number().over(each)).filter(F.col("r") <= copies)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def norm_band(vector: Column) -> Column:
    """The band of a vector's norm: each spans a factor of four, and norms about one lie in the middle of theirs."""

    def band(top: Column) -> Column:
        squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / top) * (x / top))
        return F.floor((F.log2(top) + F.log2(squares) / 2) / 2 + 0.5).cast("int")

    # as the variable of a lambda the largest component is found once, not once a component
    return F.transform(F.array(F.array_max(F.transform(vector, F.abs))), band)[0]


def build_index(distinct: DataFrame, bands: DataFrame) -> DataFrame:
    """One row per dimension, norm band and shard: the vectors, their ids and the flat neighbour arrays.

    ``bands(size, band, shards)`` has the number of shards of each.
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        vectors = _matrix(table.column("vector"))
        graph = Graph.build(vectors)
        return pa.table({
            "size": table.column("size").slice(0, 1), "band": table.column("band").slice(0, 1), "shard": table.column("shard").slice(0, 1),
            "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "flat": pa.array([graph.arrays()], pa.list_(pa.binary())),
        })

    keyed = distinct.join(bands, ["size", "band"]).select(
        "size", "band", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"),
        F.xxhash64("vector", F.lit(1)).alias("order"), "vector", "ids")
    kind = "size int, band int, shard int, vectors binary, ids array<array<long>>, flat array<binary>"
    return keyed.groupBy("size", "band", "shard").applyInArrow(build, kind)


def nearest(rows: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``rows(vec_id, embedding, ...)`` whose id ``every`` divides.

    Each query's ``k`` nearest other rows by inner product, ties to the smaller id; fewer if there
    are fewer candidates. Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, take no part; only vectors of one length are compared. Repeated (vec_id, vector) rows
    count once. Copies of a vector are one node of the graph; the ids returned for it are exact. Extra
    columns are ignored; an empty table gives an empty result.
    """
    plain = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    plain = plain.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["vec_id", "vector"])
    distinct = store(_distinct(plain, k + 1).withColumns({"size": F.size("vector"), "band": norm_band(F.col("vector"))}), "vectors")
    bands = store(distinct.groupBy("size", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "bands")
    index = store(build_index(distinct, bands), "index")

    asked = plain.filter(F.col("vec_id") % every == 0)
    count = distinct.count() // (every * TASK_QUERIES) + 1
    blocks = asked.select("vector").distinct().select(
        F.size("vector").alias("size"), F.pmod(F.xxhash64("vector", F.lit(2)), F.lit(count)).cast("int").alias("block"), "vector")
    schema = pa.schema([("vector", pa.list_(pa.float64())), ("vec_id", pa.int64()), ("score", pa.float64())])

    def walk(graph: Graph, vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray) -> Iterator[tuple[int, int, float]]:
        for at in range(0, len(queries), QUERY_BLOCK):
            own = queries[at:at + QUERY_BLOCK]
            found = graph.search(own, width) if len(vectors) > 4 * width else np.tile(np.arange(len(vectors)), (len(own), 1))
            for q, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                score = (vectors[nodes] * own[q]).sum(axis=1)
                # the first k + 1 nodes have k + 1 ids at least, and ties beyond them may have smaller ones
                cut = np.sort(score)[-min(len(score), k + 1)]
                best = nodes[score >= cut]
                pairs = sorted((-s, i) for s, n in zip(score[score >= cut], best) for i in ids[n])[:k + 1]
                yield from ((at + q, i, -s) for s, i in pairs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each index row, then the queries that walk its graph, a batch of them in memory."""
        row = graph = None
        for batch in batches:
            is_query = batch.column("query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(is_query.astype(np.int8))) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                if not high - low:
                    continue
                if not is_query[low]:
                    row, graph = part.slice(part.num_rows - 1), None  # one before it had no queries
                    continue
                if graph is None:
                    vectors = np.frombuffer(row.column("vectors")[0].as_py(), "<f8").reshape(-1, row.column("size")[0].as_py())
                    ids, graph = row.column("ids")[0].as_py(), Graph.load(vectors, row.column("flat")[0].as_py())
                found = list(walk(graph, vectors, ids, _matrix(part.column("vector"))))
                at, near, score = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vector").take(pa.array(at, pa.int32())), pa.array(near, pa.int64()), pa.array(score, pa.float64())], schema=schema)

    # every block of queries meets every shard; a shard's index is sent once a block, so once if queries are few
    place = ["size", "band", "shard", "block"]
    spread = blocks.join(bands, "size").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    sent = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("query", F.lit(False))
    both = sent.unionByName(spread.select(*place, "vector", F.lit(True).alias("query")), allowMissingColumns=True)
    # a task for each, for the work isn't in the bytes
    tasks = min(TASKS, 2 * count * int(bands.agg(F.sum("shards")).first()[0] or 1))
    hits = both.repartition(tasks, *place).sortWithinPartitions(*place, "query").mapInArrow(search, "vector array<double>, vec_id long, score double")
    queries = asked.select(F.col("vec_id").alias("query_id"), "vector")
    best = Window.partitionBy("vector").orderBy(F.desc("score"), "vec_id")
    merged = hits.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    merged = merged.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    merged = store(merged, "merged")  # so that the queries of a frequent vector can be split in the join
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    ranked = queries.join(merged, "vector").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
