from collections import Counter, defaultdict
from math import log

import random

import pytest
from pyspark.sql import functions as F
from edge import documents, none

from tellerflow.llm import mixing
from tellerflow.sources.tables import table


def entropy(weights):
    return -sum(w * log(w) for w in weights if w)


def test_temperature_reaches_the_entropy():
    counts = {"a": 9000, "b": 900, "c": 100}
    mixture = mixing.temperature(counts, 1000, entropy=0.8)
    assert abs(entropy(mixture.weights.values()) / log(3) - 0.8) < 1e-6
    assert abs(sum(mixture.weights.values()) - 1) < 1e-9
    assert mixing.temperature(counts, 1000, entropy=0.0).exponent == 1.0


def test_repetition_limits_the_exponent():
    counts = {"a": 99_000, "b": 1000}
    mixture = mixing.temperature(counts, 100_000, entropy=1.0, max_epochs=4)
    assert abs(max(mixture.epochs.values()) - 4) < 1e-6
    assert mixing.temperature(counts, 1_000_000, entropy=1.0, max_epochs=4).exponent == pytest.approx(1.0)
    assert mixing.temperature({}, 5).weights == {} and mixing.temperature({"a": 3}, 5).weights == {"a": 1.0}


def check(docs, rows, budget=None, **settings):
    """Draws follow the budget of each source: whole epochs, then blocks until it is spent."""
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    copies, counts = Counter(), Counter()
    for r in docs.collect():
        copies[r.doc_id] += 1
        counts[r.source] += sizes[r.doc_id]
    counts = {s: n for s, n in counts.items() if n}
    mixture = mixing.temperature(counts, budget or sum(counts.values()), **settings)
    drawn = defaultdict(list)
    for r in rows:
        assert r.n_tokens == sizes[r.doc_id] > 0
        drawn[r.source].append(r)
    assert set(drawn) == set(counts)
    for source, own in drawn.items():
        want = mixture.epochs[source] * counts[source]
        own.sort(key=lambda r: r.position)
        total = 0
        for r in own:  # positions are gapless, and the last document is the one that reaches the budget
            assert r.position == total < want
            total += r.n_tokens
        assert total >= want
        per = Counter((r.doc_id, r.epoch) for r in own)
        assert all(n <= copies[d] for (d, _), n in per.items())
        for epoch in range(int(mixture.epochs[source])):
            assert sum(r.n_tokens for r in own if r.epoch == epoch) == counts[source]
        order = [(r.epoch, r.block) for r in own]
        assert all(order.count(x) == len([y for y in order[order.index(x):order.index(x) + order.count(x)] if y == x]) for x in set(order))


@pytest.mark.parametrize("budget,blocks", [(None, 50_000), (200_000, 2_000)])
def test_budgets(spark, sf_dir, budget, blocks):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    check(docs, mixing.mix(docs, budget, block_tokens=blocks).collect(), budget)


def test_same_draws_again(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    once, again = (sorted(map(tuple, mixing.mix(d, keep=["doc_id"]).collect())) for d in (docs, docs.repartition(7)))
    assert once == again


def test_edges(spark):
    docs = documents(spark, "epoch", "n", "row", "key", "position").select("epoch", "doc_id", "text", "source", "n", "row", "key", "position")
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "n_tokens", "_epoch", "block", "_position"]
    check(docs, [r for r in mixed.selectExpr("doc_id", "source", "n_tokens", "_epoch epoch", "block", "_position position").collect()])
    assert mixing.mix(none(spark)).count() == 0


@pytest.mark.parametrize("entropy,epochs,budget", [(0.95, 4.0, None), (0.999, 1.5, None), (0.3, 4.0, None), (1.0, 3.0, 100_000), (0.9, 2.0, 10**9)])
def test_plan_by_sums_is_the_drivers(spark, entropy, epochs, budget):
    rng = random.Random(3)
    rows = [((i == 0, "" if i == 0 else f"s{i}"), 1 + int(rng.paretovariate(0.7))) for i in range(500)]
    frame = spark.createDataFrame(rows, "key struct<none:boolean,name:string>, n long")
    plans = [mixing.source_plan(frame, budget, entropy, epochs, 50, few) for few in (10**6, 3)]
    few, many = ({r.key: r for r in p.collect()} for p in plans)
    assert few.keys() == many.keys() and len(few) == 500
    for key, r in few.items():
        assert (many[key].blocks, many[key].total) == (r.blocks, r.total) and many[key].epochs == pytest.approx(r.epochs, rel=1e-6)


def test_many_sources(spark):
    n = 150_001
    docs = spark.range(0, n + 50_000, 1, 8).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < n, F.concat(F.lit("host"), F.col("id").cast("string"))).otherwise("hot").alias("source"),
        F.lit("one two three").alias("text"))
    drawn = mixing.mix(docs, keep=["doc_id", "source"], block_tokens=1000)
    # the hot source holds a quarter of all tokens; the others keep their share or more
    by = {r["hot"]: (r["n"], r["sources"]) for r in drawn.groupBy((F.col("source") == "hot").alias("hot")).agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("sources")).collect()}
    assert by[False][1] == n and n <= by[False][0] <= 2 * n and 0 < by[True][0] <= 50_000
