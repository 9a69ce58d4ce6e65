"""Mixing sources to target weights by temperature.

Each source's share of tokens is raised to an exponent and normalised. The exponent (1: as the
corpus is, 0: all sources alike) is found by bisection: the largest one that reaches the target
entropy, unless a source would then repeat more often than allowed; then the smallest that keeps
to the limit. The weights are realised as budgets of tokens: every source hands out its blocks
in a new random order each epoch until its budget is spent.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, row_hash, store

#: Tokens a block has on average.
BLOCK_TOKENS = 50_000
#: Blocks of a source, at most; beyond it blocks get larger.
MAX_BLOCKS = 100_000
#: Up to so many sources their weights are computed on the driver, beyond it by sums in Spark.
FEW_SOURCES = 100_000
#: Exponents that one pass over the sources compares, and passes: an exponent is found to 1 / (GRID + 1) ** PASSES.
GRID, PASSES = 15, 10
TARGET_ENTROPY = 0.95
MAX_EPOCHS = 4.0


def tokens(text: Column) -> Column:
    """Words at ASCII white space; null and empty texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


@dataclass
class Mixture:
    exponent: float
    weights: dict[str | None, float]
    epochs: dict[str | None, float]


def _weights(shares: list[float], exponent: float) -> list[float]:
    top = max(shares)
    raised = [(s / top) ** exponent for s in shares]
    return [r / sum(raised) for r in raised]


def _entropy(weights: list[float]) -> float:
    return -sum(w * log(w) for w in weights if w > 0)


def _bisect(holds, steps: int = 60) -> float:
    """The largest exponent in 0 to 1 for which ``holds``, true at 0 and monotone."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def temperature(counts: dict[str | None, int], budget: int, entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS) -> Mixture:
    """Weights of the sources with ``counts`` tokens when ``budget`` tokens are to be drawn.

    ``entropy`` is a share of the largest possible one. A budget that no exponent can draw
    within ``max_epochs`` is spent by the shares of the corpus.
    """
    names = sorted((n for n in counts if counts[n] > 0), key=lambda n: (n is None, n))
    if not names:
        return Mixture(1.0, {}, {})
    total = sum(counts[n] for n in names)
    shares = [counts[n] / total for n in names]
    target = entropy * log(len(names))
    exponent = _bisect(lambda e: _entropy(_weights(shares, e)) >= target)
    worst = lambda e: max(w * budget / counts[n] for n, w in zip(names, _weights(shares, e)))
    if worst(exponent) > max_epochs:
        # towards the corpus' own shares repetition falls
        exponent = _smallest(worst, exponent, max_epochs)
    weights = _weights(shares, exponent)
    return Mixture(exponent, dict(zip(names, weights)), {n: w * budget / counts[n] for n, w in zip(names, weights)})


def _smallest(worst, low: float, limit: float, steps: int = 60) -> float:
    """The smallest exponent from ``low`` to 1 whose worst repetition keeps to the limit; 1 if none does."""
    high = 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if worst(middle) <= limit else (middle, high)
    return high


def mix(docs: DataFrame, budget: int | None = None, entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS,
        block_tokens: int = BLOCK_TOKENS, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs(doc_id, text, source, ...)`` as often as the mixture draws them.

    Adds ``n_tokens``, ``epoch`` (from 0), ``block`` and ``position`` (the tokens its source has handed
    out before it) under names the table doesn't use; ``keep`` names the columns to carry, all if not given.
    ``budget`` is in tokens, the corpus' own size if not given. Documents of a source fall into blocks by a
    hash of the whole row; each epoch permutes the blocks by another hash, and a block keeps its inner
    order. A source ends with the document that reaches its budget. A null source is a source of its own;
    documents without a token are never drawn; repeated rows count and are drawn as often as they are
    there; an empty table gives an empty result.

    Only sums by source and by block are ordered in windows: a source of any size is split into blocks
    (of ``block_tokens``, larger ones beyond ``MAX_BLOCKS``), and documents are joined to their block's draws.
    """
    spark, columns = docs.sparkSession, docs.columns if keep is None else keep
    name = F.coalesce("source", F.lit(""))
    key = F.struct(F.col("source").isNull().alias("none"), name.alias("name"))
    rows = store(docs.select(
        key.alias("key"), tokens(F.col("text")).alias("n"), row_hash(docs, seed).alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"),
    ).filter("n > 0"), "rows")
    plan = source_plan(rows, budget, entropy, max_epochs, block_tokens)
    placed = rows.join(plan.select("key", "blocks"), "key").withColumn("block", F.pmod("row", "blocks")).drop("blocks")
    # tokens before a block in its source's order of the epoch
    sums = placed.groupBy("key", "block").agg(F.sum("n").alias("size")).join(plan, "key")
    draws = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor("epochs").cast("int"))))
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    draws = draws.withColumn("before", before + F.col("epoch") * F.col("total")).withColumn("budget", F.col("epochs") * F.col("total"))
    draws = draws.filter(F.col("before") < F.col("budget")).select("key", "block", "epoch", "before", "budget")
    # tokens before a document in its block
    inner = Window.partitionBy("key", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    drawn = placed.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(draws, ["key", "block"])
    position = F.col("before") + F.col("within")
    carried = [F.col(f"doc.`{c}`") for c in columns]
    own = docs.select(*[f"`{c}`" for c in columns])
    extra = {"n_tokens": F.col("n"), "epoch": F.col("epoch"), "block": F.col("block"), "position": position}
    return drawn.filter(position < F.col("budget")).select(*carried, *[v.alias(fresh(own, k)) for k, v in extra.items()])


def source_plan(
    rows: DataFrame, budget: int | None, entropy: float, max_epochs: float, block_tokens: int, few: int | None = None,
) -> DataFrame:
    """``(key, blocks, epochs, total)`` of every source of ``rows(key, n)``.

    A few sources' token counts come to the driver. Of more only sums over all sources do, for several
    exponents at once, and the plan stays a table that Spark joins as its size allows.
    """
    spark, few = rows.sparkSession, FEW_SOURCES if few is None else few
    counts = store(rows.groupBy("key").agg(F.sum("n").alias("total")), "sources")
    total, number = counts.agg(F.sum("total"), F.count("*")).first()
    if not number:
        return spark.createDataFrame([], "key struct<none:boolean,name:string>, blocks long, epochs double, total long")
    budget = total if budget is None else budget
    if number <= few:
        known = {None if r.key.none else r.key.name: r.total for r in counts.collect()}
        mixture = temperature(known, budget, entropy, max_epochs)
        # one row per source, of which there are few
        return F.broadcast(spark.createDataFrame(
            [((s is None, s or ""), min(MAX_BLOCKS, -(-known[s] // block_tokens)), mixture.epochs[s], known[s]) for s in mixture.weights],
            "key struct<none:boolean,name:string>, blocks long, epochs double, total long"))
    exponent, norm, top = _exponent(counts, budget, number, entropy, max_epochs)
    weight = F.pow(F.col("total") / F.lit(float(top)), F.lit(exponent)) / F.lit(norm)
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("total") / F.lit(float(block_tokens)))).cast("long")
    return counts.select("key", blocks.alias("blocks"), (weight * F.lit(float(budget)) / F.col("total")).alias("epochs"), "total")


def _exponent(counts: DataFrame, budget: int, number: int, entropy: float, max_epochs: float) -> tuple[float, float, int]:
    """:func:`temperature`'s exponent by sums over ``counts(total)``; with the weights' norm and the largest count."""
    top, least = counts.agg(F.max("total"), F.min("total")).first()

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """The norm and the entropy under each exponent."""
        each = []
        for e in exponents:
            raised = F.pow(F.col("total") / F.lit(float(top)), F.lit(e))
            each += [F.sum(raised), F.sum(raised * F.log(raised))]
        found = list(counts.agg(*each).first())
        return [(n, log(n) - weighed / n) for n, weighed in zip(found[::2], found[1::2])]

    def search(low: float, holds) -> float:
        """The end of the exponents from ``low`` on for which ``holds(exponent, norm, entropy)``; 1 if all do."""
        high = 1.0
        for _ in range(PASSES):
            grid = [low + (high - low) * k / (GRID + 1) for k in range(1, GRID + 1)] + [high]
            good = [holds(e, *s) for e, s in zip(grid, sums(grid))]
            if all(good):
                return high
            first = good.index(False)
            low, high = (grid[first - 1] if first else low), grid[first]
        return low

    def worst(e: float, norm: float) -> float:
        # repetition falls with the source's size: weight by count is (n / top) ** e / norm / n
        return (least / top) ** e / norm * budget / least

    target = entropy * log(number)
    exponent = search(0.0, lambda e, norm, found: found >= target)
    ((norm, _),) = sums([exponent])
    if worst(exponent, norm) > max_epochs:
        exponent = search(exponent, lambda e, norm, _: worst(e, norm) > max_epochs)
        ((norm, _),) = sums([exponent])
    return exponent, norm, top
