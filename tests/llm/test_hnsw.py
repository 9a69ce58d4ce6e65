import numpy as np

from tellerflow.llm import hnsw
from tellerflow.sources.tables import table


def exact(rows, k=20, every=20):
    """Each query's nearest rows by plain comparison."""
    out = {}
    for q, own in rows:
        if q % every == 0:
            scored = sorted(((-float(np.dot(own, v)), i) for i, v in rows if i != q and len(v) == len(own)), key=lambda x: (round(x[0], 12), x[1]))
            out[q] = [i for _, i in scored[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in frame.collect()]
    want, got = exact(rows), found(hnsw.nearest(frame, shard_rows=900, width=96))
    assert set(want) == set(got)
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) > 0.95


def test_graph_recall_on_vectors_of_any_length():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(4000, 32)) * rng.uniform(0.5, 1.5, size=(4000, 1))
    graph = hnsw.Graph.load(vectors, hnsw.Graph.build(vectors).arrays())
    queries = vectors[:200]
    got, want = graph.search(queries), np.argsort(-queries @ vectors.T, axis=1)[:, :20]
    assert np.mean([len(set(g) & set(w)) / 20 for g, w in zip(got.tolist(), want.tolist())]) > 0.9
    links = graph.levels[0][1]
    assert links.shape[1] == 2 * hnsw.LINKS and links.max() < 4000


def test_recall_with_a_few_very_long_vectors(spark):
    """Long vectors in a shard must not take the resolution from the others."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    for k, ratio in ((7, 1e4), (11, 1e6), (13, 1e8)):
        vectors[k] *= ratio
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    want, got = exact([(k, v.astype(float)) for k, v in enumerate(vectors)]), found(hnsw.nearest(frame, width=96))
    assert set(want) == set(got)
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) > 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, 0.5]
    rows = [(0, same), (20, same), *[(k, same) for k in range(100, 140)], (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (7, [3.0, 2.0, 1.0]), (60, []), (80, [-1.0, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 score", "'x' vector", "0 shard")
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    assert found(hnsw.nearest(frame)) == exact([(i, np.array(v)) for i, v in sorted(good)])
    assert hnsw.nearest(frame.limit(0)).count() == 0
    assert found(hnsw.nearest(frame.filter("vec_id = 40"))) == {}


def test_norm_band_is_linear_in_the_dimension(spark):
    import time

    from pyspark.sql import functions as F

    frames = {}
    for dims in (128, 512):
        path = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/band-{dims}-{time.time_ns()}"
        spark.range(0, 20_000, 1, 8).select(F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: (F.col("id") * i % 97).cast("double") + 1).alias("v")).write.parquet(path)
        frames[dims] = spark.read.parquet(path)
        frames[dims].agg(F.sum(hnsw.norm_band(F.col("v")))).collect()
    took = {}
    for dims, frame in frames.items():
        began = time.perf_counter()
        frame.agg(F.sum(hnsw.norm_band(F.col("v")))).collect()
        took[dims] = time.perf_counter() - began
    # four times the components; the quadratic form took sixteen times as long
    assert took[512] < 8 * took[128] + 0.5


def test_blocks_of_queries_meet_every_shard(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(600, 8))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in hnsw.nearest(frame, k=5, every=3).collect()}
    monkeypatch.setattr(hnsw, "TASK_QUERIES", 40)
    monkeypatch.setattr(hnsw, "TASKS", 3)
    # small shards are searched whole, so the answers are exact either way
    assert {tuple(r) for r in hnsw.nearest(frame, k=5, every=3, shard_rows=100).collect()} == whole
