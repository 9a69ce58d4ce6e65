"""SimHash near-duplicates, found by a generalised pigeonhole search.

A document's fingerprint has 64 bits. Two fingerprints link when they differ in at most
``distance`` bits. The bits are grouped into parts; part i gets a threshold t_i of its own
with sum(t_i) = distance - parts + 1, so that two linked fingerprints must agree up to t_i
bits in some part i. A part with threshold -1 is not searched at all. Correlated bits
share a part, and the thresholds come from dynamic programming over estimated costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_column, fresh, row_hash, store, utf8
from .components import connected

#: Fingerprints from which part distances are estimated; only the plan's cost depends on it.
SAMPLE = 4096
#: Members above which a bucket is compared block by block in several tasks.
BLOCK = 8192
#: Relative cost of shuffling one probe and of comparing one pair.
PROBE_COST, PAIR_COST = 1.0, 0.03


def simhash(data: bytes, width: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a text in UTF-8.

    ASCII letters are lowered, words end at ASCII white space, shingles have ``width`` words
    and count as often as they occur. Fewer words form one shingle; none give zero.
    """
    words = data.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    total = max(1, len(words) - width + 1)
    if total == 1:
        return digest(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:total]
    ends = ends[width - 1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 255 * 256):
        part = zip(starts[at:at + 255 * 256].tolist(), ends[at:at + 255 * 256].tolist())
        hashes = np.array([digest(line[a:b], seed) for a, b in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        # 255 rows at a time, so that bytes can't overflow
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed long; null text has fingerprint zero."""

    def compute(column: pa.Array) -> pa.Array:
        values = np.fromiter((simhash(x, width, seed) for x in utf8(column)), np.uint64, len(column))
        return pa.array(values.view(np.int64))

    return arrow_column(compute, "long")(text)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, 64)


def bit_correlations(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the absolute correlation of each two bits, over all of them."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, rows = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            joint += bits.T @ bits
            rows += len(bits)
        values = np.append(joint.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(values)], ["cell", "n"])

    cells = distinct.select("fp").mapInArrow(moments, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = dict(cells.collect())  # 4097 numbers at any size
    rows = found.get(4096, 0)
    joint = np.array([found.get(i, 0) for i in range(4096)], float).reshape(64, 64) / max(rows, 1)
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    return rows, np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, the most correlated ones together."""
    left, groups = set(range(64)), []
    strength = correlation - np.diag(np.diag(correlation))
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        order = sorted(left)
        group = [max(order, key=lambda b: (strength[b, order].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least summed cost; ``costs[i][t + 1]`` is part i's at t >= -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, extra in enumerate(row, start=-1):
                key = used + t
                if key not in new or cost + extra < new[key][0]:
                    new[key] = (cost + extra, [*chosen, t])
        best = new
    return best.get(total, (float("inf"), []))


def plan_search(rows: int, correlation: np.ndarray, sample: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The parts and thresholds of the cheapest search for so many fingerprints."""
    bits = _bits(sample).astype(np.float32) if len(sample) else np.zeros((0, 64), np.float32)
    pairs = max(1, len(sample) * (len(sample) - 1))
    cheapest: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, distance + 2):
        groups, costs = group_bits(correlation, parts), []
        for group in groups:
            own = bits[:, group]
            ones = own.sum(axis=1)
            within = np.zeros(3, np.int64)
            for at in range(0, len(own), 512):  # a strip of the sample at once
                apart = ones[at:at + 512, None] + ones[None, :] - 2 * own[at:at + 512] @ own.T
                within += [int((apart <= t).sum()) for t in range(3)]
            near = [(int(n) - len(own) + 1) / pairs for n in within]
            probes = [sum(comb(len(group), j) for j in range(t + 1)) for t in range(3)]
            costs.append([0.0] + [rows * (p + (p > 1)) * PROBE_COST + rows * rows / 2 * n * PAIR_COST for p, n in zip(probes, near)])
        cost, chosen = allocate(costs, distance - parts + 1)
        if cost < cheapest[0]:
            cheapest = (cost, list(zip(groups, chosen)))
    return cheapest[1]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    """The bits as a signed long."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _span(fps: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over a bucket's links; two probes are never compared."""
    first, second, rest = [], [], np.arange(len(fps))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if probe[at]:
                near &= ~probe[rest]
            if near.any():
                hit, rest = rest[near], rest[~near]
                first.append(np.full(len(hit), at))
                second.append(hit)
                stack.extend(hit.tolist())
    if not first:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return fps[np.concatenate(first)], fps[np.concatenate(second)]


def _bucket_links(sizes: np.ndarray, starts: np.ndarray, fps: np.ndarray, probe: np.ndarray, distance: int) -> Iterator[tuple]:
    """Edges of complete buckets that lie one after another."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        these = starts[sizes == size]
        if size > 32:
            for at in these.tolist():
                yield _span(fps[at:at + size], probe[at:at + size], distance)
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, 2_000_000 // len(i))
        for at in range(0, len(these), step):
            rows = these[at:at + step, None]
            a, b = fps[rows + i], fps[rows + j]
            near = (np.bitwise_count(a ^ b) <= distance) & ~(probe[rows + i] & probe[rows + j])
            yield a[near], b[near]


def link_buckets(distance: int):
    """Over rows sorted by bucket: edges that keep each bucket's links connected."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            keys = held[:3]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(change):
                done = change[-1]
                yield from emit(np.concatenate([[0], change]), [x[:done] for x in held[3:]])
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield from emit(np.array([0, len(held[0])]), held[3:])

    def emit(bounds: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps, probe = columns[0].astype(np.int64).view(np.uint64), columns[1].astype(bool)
        for a, b in _bucket_links(np.diff(bounds), bounds[:-1], fps, probe, distance):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return link


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints linked directly or through others.

    ``distinct`` has one long column ``fp`` without repeats. A bucket (one value of one part)
    emits a spanning forest of its links, never all its pairs. A bucket of more than ``BLOCK``
    members is compared as pairs of blocks, each in a task of its own, so nothing is left out.
    """
    rows, correlation = bit_correlations(distinct)
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    plan = plan_search(rows, correlation, np.array([r[0] for r in sample], np.int64), distance)
    probes = []
    for part, (group, threshold) in enumerate(plan):
        for flips in range(threshold + 1):
            probes += [(part, _mask(group), _mask(flip), flips > 0) for flip in combinations(group, flips)]
    rows_of = ", ".join(f"named_struct('part', {p}, 'mask', bigint('{m}'), 'flip', bigint('{f}'), 'probe', {v})" for p, m, f, v in probes)
    probe = F.expr(f"explode(array({rows_of}))")
    found = distinct.select("fp", probe.alias("p")).select(
        F.col("p.part").alias("part"),
        F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("bucket"),
        "fp", F.col("p.probe").alias("probe"),
    )
    # the few buckets that need several tasks
    large = found.groupBy("part", "bucket").count().filter(F.col("count") > BLOCK).withColumn(
        "blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    found = store(found, "probes").join(store(large, "large"), ["part", "bucket"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
    pair = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(each.cast("array<int>"))
    dealt = found.withColumn("pair", F.explode(pair)).select("part", "bucket", "pair", "fp", "probe")
    ordered = dealt.repartition("part", "bucket", "pair").sortWithinPartitions("part", "bucket", "pair")
    return ordered.mapInArrow(link_buckets(distance), "a long, b long")


def classes(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """``(fp, component_id)`` of every row of ``distinct(fp, low)``, the component's smallest ``low``."""
    roots = connected(links(distinct.select("fp"), distance))
    placed = store(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "placed")
    # stored, so that a very large component can be split in the join
    least = store(placed.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    return placed.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Null text counts as empty; documents without words share fingerprint zero and link like
    any others. ``component_id`` is the smallest doc_id reachable over links; null ids are
    passed over for it, and a component of null ids alone has a null one. Repeated rows stay
    repeated. Extra columns are ignored; an empty table gives an empty result.
    """
    marked = store(docs.select("doc_id", fingerprint(F.col("text"), width, seed).alias("fp")), "fingerprints")
    distinct = store(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    return marked.join(classes(distinct, distance), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row of each near-duplicate component of ``docs(doc_id, text, ...)``, all its columns as they are.

    The row with the smallest doc_id stays; among rows of that id, the one with the smallest hash
    over all columns. Null ids stay only where a component has no other.
    """
    fp, rank, component = (fresh(docs, n) for n in ("fp", "rank", "component"))
    marked = store(docs.withColumn(fp, fingerprint(F.col("text"), width, seed)), "marked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row_hash(docs).alias("row"), F.col(fp).alias("fp"))
    distinct = store(marked.select(F.col(fp).alias("fp"), order.alias("low")).groupBy("fp").agg(F.min("low").alias("low")), "distinct")
    first = classes(distinct, distance).select(F.col("component_id").alias(component)).distinct()
    # few columns decide; one row of each exact repeat is left by the last step
    kept = marked.withColumn(rank, order).join(first, F.col(rank) == F.col(component)).drop(component)
    return kept.dropDuplicates([rank]).drop(rank, fp)
