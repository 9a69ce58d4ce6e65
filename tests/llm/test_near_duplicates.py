from collections import defaultdict

import numpy as np
import pytest
import xxhash
from edge import documents, none

from tellerflow.llm import components, simhash
from tellerflow.sources.tables import table


def plain_fingerprint(text, width=4):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=4):
    """Smallest id reachable of each (doc_id, fingerprint)."""
    prints = sorted({f for _, f in rows})
    group = {f: f for f in prints}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                group[top(a)] = top(b)
    low = defaultdict(list)
    for doc, f in rows:
        low[top(f)].append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in low.items()}
    return sorted([(doc, f, least[top(f)]) for doc, f in rows], key=str)


def found(frame):
    return sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in frame.collect()], key=str)


def test_fingerprints():
    for text in ["", "a", "a b c", "a b c d e", "A b C d e f g " * 300, "Éa É b c d e"]:
        assert simhash.simhash(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [8192, 8])
def test_against_all_pairs(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)


def test_every_plan_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (1, 3, 4, 5)]
    values = sorted({*map(int, base), *near})
    frame = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "fp long, low long")
    want = plain_components([(k, v % (1 << 64)) for k, v in enumerate(values)])
    rows, correlation = simhash.bit_correlations(frame)
    for size in (10, 10**5, 10**6, 10**7, 10**9):
        plan = simhash.plan_search(size, correlation, np.array(values, np.int64), 4)
        assert sum(t for _, t in plan) == 4 - len(plan) + 1
        assert sorted(b for g, _ in plan for b in g) == list(range(64))
    got = [(r.fp % (1 << 64), r.component_id) for r in simhash.classes(frame, 4).collect()]
    assert sorted(got) == sorted((f, c) for _, f, c in want)


def test_edges(spark):
    docs = documents(spark, "fp", "component_id", "rank", "low", "__row")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    docs = documents(spark, "fp", "rank", "component")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # 2, 3 and 4 have no words; 1 and 7 are copies
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "8", "None"]
    assert simhash.keep_one(none(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected(edges).collect()}
    assert got == {**{k: 0 for k in range(51)}, 90: 90, 100: 90}
