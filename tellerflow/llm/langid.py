"""Language identification with interpolated Kneser-Ney character models.

All training words are counted. A model's n-grams run over single words between a start and an
end mark. The models of all languages lie in one sorted array of n-gram hashes per order, with
a column of log probabilities and of back-off weights per language. Where the n-grams are too many
for one such model, it stays a Spark table, and each block of texts gets the part its own n-grams need.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_column, learnable, store, texts

WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
#: Bytes that fitting a broadcast model may take on the driver; beyond it the model is a table joined with blocks of texts.
MODEL_BYTES = 256 << 20
#: Bytes of one counted n-gram of a language while a model is fitted: its entries in the dictionaries of all orders.
GRAM_BYTES = 450
#: Places times languages that are scored at once.
SCORED_CELLS = 4 << 20
#: n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 500_000
#: Characters of a block of texts that gets a model of its own, about.
BLOCK_CHARS = 8 << 20
#: Bins a nat in which the ranks of quantiles are looked for first.
QUANTILE_BINS = 1 << 10
#: A score as a whole number, and passes in which its scale is searched, each over 32 steps.
SCORE_UNITS, SCALE_PASSES = 1 << 30, 6
UNKNOWN = "und"
PREDICTION = "struct<lang:string,score:double,entropy:double,accepted:boolean>"
PREDICTION_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("accepted", pa.bool_())])


def words_of(text: str) -> list[str]:
    """Runs of letters in small letters; runs of other word characters alone don't count."""
    return WORD.findall(text.lower())


def lines_of(word: str, order: int, size: int) -> Iterator[str]:
    """A word between its marks, in pieces that each predict at most ``size`` characters.

    A piece begins with the ``order - 1`` characters before its first predicted one, so the pieces'
    n-grams of that order are just those of the whole.
    """
    line = START * (order - 1) + word + END
    for at in range(0, len(word) + 1, size):
        yield line[at:at + size + order - 1]


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """``(lang, gram, n)`` over every word of every row of ``docs(lang, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        seen = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                words.setdefault(lang, Counter()).update(words_of(text))
                seen += len(text)
                if seen > 24_000_000:
                    yield from expand(words)
                    words, seen = {}, 0
        yield from expand(words)

    def expand(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            own: Counter = Counter()
            for word, n in counter.items():
                for line in lines_of(word, order, HELD_GRAMS):
                    for at in range(len(line) - order + 1):
                        own[line[at:at + order]] += n
                    if len(own) >= HELD_GRAMS:
                        yield counts(lang, own)
                        own = Counter()
            yield counts(lang, own)

    def counts(lang: str, own: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
            ["lang", "gram", "n"])

    return docs.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of each ``order`` characters that end at a place; the first places have none."""
    value = np.zeros(len(points) - order + 1, np.uint64)
    for k in range(order):
        value = (value + points[k:len(points) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


class Model:
    """Per order: sorted hashes, log probabilities and back-off weights by language."""

    def __init__(self, langs: list[str], order: int, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: np.ndarray,
                 limits: np.ndarray | None = None, scale: float = 1.0):
        self.langs, self.order, self.tables, self.floor = langs, order, tables, floor
        self.limits = np.full(len(langs), np.inf) if limits is None else limits
        self.scale = scale

    def state(self) -> tuple:
        """Plain arrays, as a broadcast carries them."""
        return self.langs, self.order, self.tables, self.floor, self.limits, self.scale

    def line_scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The summed log probability by language and the number of predicted characters of each line."""
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines)) - (self.order - 1)
        first = np.cumsum(lengths + self.order - 1) - lengths  # the first predicted place of each line
        places = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        done = np.zeros(len(places), np.int8)[:, None] + np.zeros((1, len(self.langs)), np.int8)
        total = np.zeros((len(places), len(self.langs)), np.float32)
        for order in range(self.order, 0, -1):
            keys, logp, _ = self.tables[order - 1]
            at, there = self._find(keys, hashes(points, order)[places - order + 1])
            found = np.where(there[:, None], logp[at], np.nan)
            new = (done == 0) & ~np.isnan(found)
            total[new] += found[new]
            done[new] = 1
            if order > 1:
                keys, _, back = self.tables[order - 2]
                at, there = self._find(keys, hashes(points, order - 1)[places - order + 1])
                rest = np.where(there[:, None], back[at], 0)
                total += np.where(done == 0, rest, 0)
        total += np.where(done == 0, self.floor[None, :], 0)
        starts = np.cumsum(lengths) - lengths
        return np.add.reduceat(total.astype(np.float64), starts, axis=0), lengths

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def entropies(self, rows: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by language (nats a character) and predicted characters of each text."""
        numbers: dict[str, int] = {}
        lists = []
        for text in rows:
            lists.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(text)), np.int32))
        values, lengths = np.zeros((len(numbers), len(self.langs))), np.zeros(len(numbers), np.int64)
        for lines, owners in self._blocks(numbers):
            sums, predicted = self.line_scores(lines)
            np.add.at(values, owners, sums)
            np.add.at(lengths, owners, predicted)
        chars = np.array([lengths[x].sum() for x in lists], np.int64).reshape(-1)
        sums = np.array([values[x].sum(axis=0) for x in lists]).reshape(-1, len(self.langs))
        return -sums / np.maximum(chars, 1)[:, None], chars

    def _blocks(self, words: Iterable[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Lines of the words with a letter, and their words' numbers, as many at once as ``SCORED_CELLS`` allows."""
        size = max(1, SCORED_CELLS // len(self.langs))
        lines, owners, held = [], [], 0
        for number, word in enumerate(words):
            if word.isalpha() or any(map(str.isalpha, word)):
                for line in lines_of(word, self.order, size):
                    lines.append(line)
                    owners.append(number)
                    held += len(line)
                    if held >= size:
                        yield lines, owners
                        lines, owners, held = [], [], 0
        if lines:
            yield lines, owners

    def predict(self, rows: list[str]) -> list[dict]:
        return self.decide(*self.entropies(iter(rows)))

    def decide(self, entropy: np.ndarray, chars: np.ndarray) -> list[dict]:
        """Predictions from cross-entropies by language and numbers of predicted characters."""
        out = []
        for own, n in zip(entropy, chars.tolist()):
            if not n:
                out.append({"lang": UNKNOWN, "score": 0.0, "entropy": None, "accepted": False})
                continue
            best = int(own.argmin())
            # short texts count with their length, long ones as if cut at a hundred characters
            weight = np.exp(-(own - own[best]) * min(n, 100) * self.scale)
            out.append({"lang": self.langs[best], "score": float(1 / weight.sum()), "entropy": float(own[best]),
                        "accepted": bool(own[best] <= self.limits[best])})
        return out


def _kneser_ney(grams: dict[str, int], order: int, letters: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """Probabilities by order and back-off weights by context, interpolated, of one language."""
    counts: list[dict[str, int]] = [{} for _ in range(order)]
    counts[order - 1] = grams
    for k in range(order - 1, 0, -1):
        left: Counter = Counter(g[1:] for g in counts[k])  # each type is one left context
        counts[k - 1] = dict(left)
    probability: list[dict[str, float]] = [{} for _ in range(order)]
    backoff: list[dict[str, float]] = [{} for _ in range(order)]
    floor = 1.0 / (letters + 1)
    for k in range(order):
        ones = sum(n == 1 for n in counts[k].values())
        twos = sum(n == 2 for n in counts[k].values())
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        totals: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in counts[k].items():
            totals[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        weight = {c: discount * kinds[c] / totals[c] for c in totals}
        for gram, n in counts[k].items():
            lower = probability[k - 1][gram[1:]] if k else floor
            probability[k][gram] = (n - discount) / totals[gram[:-1]] + weight[gram[:-1]] * lower
        if k:
            backoff[k - 1] = weight
        else:
            rest = weight.get("", 1.0) * floor
    return probability, backoff, rest


def train(docs: DataFrame, order: int = 4) -> Model | None:
    """A model on the driver from all rows of ``docs(lang, text)`` with a language; None where there are no words."""
    return _collected(store(count_grams(docs.filter("lang is not null").select("lang", "text"), order), "grams"), order)


def fitting_bytes(counted: DataFrame, order: int) -> int:
    """About what ``_collected`` takes: dictionaries of all n-grams and, per distinct one and order, a hash and two numbers a language."""
    rows, distinct, langs = counted.agg(F.count("*"), F.count_distinct("gram"), F.count_distinct("lang")).first()
    return rows * GRAM_BYTES + distinct * order * (8 + 8 * langs)


def _collected(counted: DataFrame, order: int) -> Model | None:
    """The whole model of the counted n-grams, on the driver."""
    by: dict[str, dict[str, int]] = {}
    for lang, gram, n in counted.collect():
        by.setdefault(lang, {})[gram] = n
    if not by:
        return None
    langs = sorted(by)
    letters = len({g[-1] for grams in by.values() for g in grams})
    fitted = [_kneser_ney(by[lang], order, letters) for lang in langs]
    tables = []
    for k in range(order):
        union = sorted({g for p, b, _ in fitted for g in (*p[k], *b[k])})
        logp = np.full((len(union), len(langs)), np.nan, np.float32)
        back = np.zeros((len(union), len(langs)), np.float32)
        for j, (p, b, _) in enumerate(fitted):
            logp[:, j] = [np.log(p[k][g]) if g in p[k] else np.nan for g in union]
            back[:, j] = [np.log(b[k][g]) if g in b[k] else 0 for g in union]
        tables.append(_table(union, logp, back))
    return Model(langs, order, tables, np.log([f for _, _, f in fitted]).astype(np.float32))


def _table(grams: list[str], logp: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of one order as hashes, sorted; one that no text holds if there are none."""
    if not grams:
        return np.zeros(1, np.uint64), np.full((1, logp.shape[1]), np.nan, np.float32), np.zeros((1, back.shape[1]), np.float32)
    size = len(grams[0])
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    keys = hashes(points, size)[::size]
    place = np.argsort(keys, kind="stable")
    return keys[place], logp[place], back[place]


def statistics(counted: DataFrame, order: int) -> tuple[list[str], np.ndarray, DataFrame]:
    """The interpolated model of all n-grams as a table: languages, log floors and ``(gram, cells)``.

    Cells are ``(place of the language, log probability or null, log back-off weight or null)``, n-grams
    of all orders up to ``order``. The driver holds one number per language and order; languages are few
    by their nature.
    """
    spark = counted.sparkSession
    counts = {order: counted}
    for k in range(order - 1, 0, -1):  # each type is one left context
        left = counts[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        counts[k] = store(left, f"grams{k}")
    langs = sorted(r.lang for r in counts[1].select("lang").distinct().collect())
    floor = 1.0 / (counts[1].select("gram").distinct().count() + 1)
    parts, lower, rest = [], None, {}
    for k in range(1, order + 1):
        once = counts[k].groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("ones"), F.sum((F.col("n") == 2).cast("long")).alias("twos"))
        discounts = [(r.lang, langs.index(r.lang), min(0.95, max(0.1, r.ones / max(1, r.ones + 2 * r.twos)))) for r in once.collect()]
        discount = F.broadcast(spark.createDataFrame(discounts, "lang string, place int, discount double"))
        own = counts[k].withColumn("context", F.substring("gram", 1, k - 1))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discount, "lang")
        context = store(context.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total")), f"contexts{k}")
        if k > 1:
            own = own.withColumn("rest", F.substring("gram", 2, k - 1)).join(lower, ["lang", "rest"])
            parts.append(context.select(F.col("context").alias("gram"), "place", F.lit(None).cast("double").alias("logp"), F.log("weight").alias("back")))
        else:
            own = own.withColumn("lower", F.lit(floor))
            rest = {r.place: r.weight * floor for r in context.collect()}
        chance = (F.col("n") - F.col("discount")) / F.col("total") + F.col("weight") * F.col("lower")
        fitted = store(own.join(context, ["lang", "context"]).select("lang", "gram", "place", chance.alias("p")), f"fitted{k}")
        parts.append(fitted.select("gram", "place", F.log("p").alias("logp"), F.lit(None).cast("double").alias("back")))
        lower = fitted.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.union(part)
    table = store(cells.groupBy("gram").agg(F.collect_list(F.struct("place", "logp", "back")).alias("cells")), "model")
    return langs, np.log([rest[j] for j in range(len(langs))]).astype(np.float32), table


def _tables(found: pa.Table, langs: int, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The arrays of a model from rows ``(gram, cells)``."""
    grams = found.column("gram").to_pylist()
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    lists = pa.concat_arrays(found.column("cells").chunks) if len(grams) else None
    logp, back = np.full((len(grams), langs), np.nan, np.float32), np.zeros((len(grams), langs), np.float32)
    if len(grams):
        row, cell = np.repeat(np.arange(len(grams)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
        place = cell.field("place").to_numpy(zero_copy_only=False)
        for values, name in ((logp, "logp"), (back, "back")):
            own = cell.field(name).to_numpy(zero_copy_only=False)
            there = ~np.isnan(own)
            values[row[there], place[there]] = own[there]
    tables = []
    for k in range(1, order + 1):
        at = np.flatnonzero(sizes == k)
        tables.append(_table([grams[x] for x in at], logp[at], back[at]))
    return tables


def block_entropies(docs: DataFrame, langs: list[str], order: int, floor: np.ndarray, table: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, lang, chars, entropy)`` per row of ``docs(doc_id, lang, text)`` under a model that is a table.

    Rows fall into blocks as they are read. A block's distinct n-grams are joined with the table, and what
    they find is the model of the block. Nothing is gathered but a block and its n-grams.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            blocks = []
            for part, text in zip(batch.column(3).to_pylist(), texts(batch.column(2))):
                blocks.append((part << 32) + at // block_chars)
                at += len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blocks, pa.int64())], ["doc_id", "lang", "text", "block"])

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = None, set()
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if block != held:
                    if words:
                        yield from expand(held, words)
                    held, words = block, set()
                words.update(words_of(text))
        if words:
            yield from expand(held, words)

    def expand(block: int, words: set[str]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for word in words:
            for line in lines_of(word, order, HELD_GRAMS):
                for size in range(1, order + 1):
                    found.update(line[at:at + size] for at in range(len(line) - size + 1))
                if len(found) >= HELD_GRAMS:
                    yield needs(block, found)
                    found = set()
        yield needs(block, found)

    def needs(block: int, found: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(list(found), pa.string())], ["block", "gram"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Model(langs, order, _tables(right, len(langs), order), floor)
        entropy, chars = [], []
        for part in _slices(left.column("text")):
            e, c = own.entropies(iter(part))
            entropy += list(e)
            chars.append(c)
        return pa.table({"doc_id": left.column("doc_id"), "lang": left.column("lang"), "chars": pa.array(np.concatenate(chars), pa.int64()),
                         "entropy": pa.array(entropy, pa.list_(pa.float64()))})

    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string"
    numbered = docs.select("doc_id", "lang", "text", F.spark_partition_id().cast("long").alias("part"))
    rows = store(numbered.mapInArrow(deal, f"{key}, text string, block long"), "blocks")
    needed = rows.select("block", "text").mapInArrow(need, "block long, gram string").distinct()
    met = needed.join(table, "gram")
    return rows.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(score, f"{key}, chars long, entropy array<double>")


def _slices(column: pa.Array, size: int = 12 << 20) -> Iterator[list[str]]:
    held, total = [], 0
    for text in texts(column):
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    yield held


def predictor(model: Model | None):
    """An expression over a text column: ``struct(lang, score, entropy, accepted)``."""
    if model is None:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                                     F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
    shared = SparkSession.active().sparkContext.broadcast(model.state())

    def predict(column: pa.Array) -> pa.Array:
        own = Model(*shared.value)
        rows = [x for part in _slices(column) for x in own.predict(part)]
        return pa.array(rows, PREDICTION_TYPE)

    return arrow_column(predict, PREDICTION)


def _decider(model: Model):
    """An expression over ``struct(chars, entropy)``: the prediction."""
    langs, limits, scale = model.langs, model.limits, model.scale

    def decide(column: pa.Array) -> pa.Array:
        own = Model(langs, 0, [], np.zeros(0), limits, scale)
        chars = column.field("chars").to_numpy(zero_copy_only=False)
        rows = own.decide(np.array(column.field("entropy").to_pylist()).reshape(-1, len(langs)), chars)
        return pa.array(rows, PREDICTION_TYPE)

    return arrow_column(decide, PREDICTION)


def entropies(model: Model, docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, chars, entropy)`` per row of ``docs(doc_id, lang, text)`` under a broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(2)):
                entropy, chars = own.entropies(iter(part))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, len(part)) for c in batch.columns[:2]), pa.array(chars), pa.array(list(entropy), pa.list_(pa.float64()))],
                    ["doc_id", "lang", "chars", "entropy"])
                at += len(part)

    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string"
    return docs.select("doc_id", "lang", "text").mapInArrow(measure, f"{key}, chars long, entropy array<double>")


def _quantiles(values: DataFrame, shares: tuple[float, ...]) -> dict[int, list[float]]:
    """Exact quantiles of ``values(place, value)`` by place, as ``np.quantile`` has them, where there are four values at least.

    The driver gets the numbers of values a bin; those of the few bins that hold a wanted rank are then ranked in Spark.
    """
    spark = values.sparkSession
    binned = values.withColumn("bin", F.floor(F.col("value") * QUANTILE_BINS))
    by: dict[int, list[tuple[int, int]]] = {}
    for r in binned.groupBy("place", "bin").agg(F.count("*").alias("n")).collect():
        by.setdefault(r.place, []).append((r.bin, r.n))
    ranks, at = [], {}
    for place, counts in by.items():
        counts.sort()
        ends = np.cumsum([n for _, n in counts])
        if ends[-1] < 4:
            continue
        at[place] = [float(q * (ends[-1] - 1)) for q in shares]
        for rank in sorted({int(f(x)) for x in at[place] for f in (np.floor, np.ceil)}):
            k = int(np.searchsorted(ends, rank, side="right"))
            ranks.append((place, counts[k][0], rank, rank - int(ends[k]) + counts[k][1]))
    if not ranks:
        return {}
    wanted = spark.createDataFrame(ranks, "place int, bin long, rank long, inside long")
    few = binned.join(wanted.select("place", "bin").distinct(), ["place", "bin"]).groupBy("place", "bin", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("place", "bin").orderBy("value"))
    found = few.withColumn("upto", upto).join(wanted, ["place", "bin"]).filter("inside < upto AND inside >= upto - n")
    value = {(r.place, r.rank): r.value for r in found.collect()}
    out = {}
    for place, wants in at.items():
        ends = [(value[place, int(np.floor(x))], value[place, int(np.ceil(x))], x % 1) for x in wants]
        out[place] = [low + (high - low) * part for low, high, part in ends]
    return out


def _mean_scores(known: DataFrame, scales: np.ndarray, rows: int) -> np.ndarray:
    """The mean score over ``known(chars, entropy)`` at each scale; summed as whole numbers, so in any order alike."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(scales), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            chars = np.minimum(batch.column(0).to_numpy(zero_copy_only=False), 100)
            entropy = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            gap = (entropy - entropy.min(axis=1, keepdims=True)) * chars[:, None]
            for k, scale in enumerate(scales):
                sums[k] += np.rint(SCORE_UNITS / np.exp(-gap * scale).sum(axis=1)).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(scales)), pa.int32()), pa.array(sums)], ["k", "total"])

    totals = known.select("chars", "entropy").mapInArrow(add, "k int, total long").groupBy("k").agg(F.sum("total").alias("total")).collect()
    return np.array([r.total for r in sorted(totals)]) / SCORE_UNITS / rows


def _set_limits(model: Model, found: DataFrame) -> Model:
    """Set each language's rejection limit and the scale of the scores, from ``found(lang, chars, entropy)`` of all training rows.

    The limit is far outside what a language's own texts show (median plus eight times the spread of the
    middle half); the scale makes the mean score equal the share of right answers. ``found`` is read several
    times: pass a stored frame.
    """
    place = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int") - 1
    known = found.select(place.alias("place"), "chars", "entropy").filter("chars > 0")
    best = F.array_position("entropy", F.array_min("entropy")) - 1
    rows, right = known.agg(F.count("*"), F.sum((best == F.col("place")).cast("long"))).first()
    if not rows:
        return model
    for k, (low, mid, high) in _quantiles(known.select("place", F.get("entropy", F.col("place")).alias("value")), (0.25, 0.5, 0.75)).items():
        model.limits[k] = mid + 8 * max(high - low, 0.01)
    low, high = 1e-3, 10.0
    for _ in range(SCALE_PASSES):
        grid = np.geomspace(low, high, 33)
        k = int((_mean_scores(known, grid[1:-1], rows) < right / rows).sum())  # the mean grows with the scale
        low, high = float(grid[k]), float(grid[k + 1])
    model.scale = (low * high) ** 0.5
    return model


def identify(docs: DataFrame, order: int = 4, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``(doc_id, found)`` per row of ``docs(doc_id, text, lang, ...)``.

    Learns from rows with a language whose id isn't held out (a null id is never learnt from).
    A null text or one without a letter is ``und`` with score 0; so is every text where nothing
    could be learnt. Ties go to the language that sorts first. Repeated rows stay repeated;
    extra columns are ignored. ``model_bytes`` only decides whether the model is broadcast or joined
    as a table: all n-grams count either way. Words of any length are counted and scored in pieces.
    Each text is scored once; limits and scale are then set from all training rows.
    """
    learn = docs.filter(learnable(F.col("doc_id"))).select("lang", "text")
    counted = store(count_grams(learn.filter("lang is not null"), order), "grams")
    own = F.when(learnable(F.col("doc_id")), F.col("lang")).alias("lang")
    asked = docs.select("doc_id", own, "text")
    if fitting_bytes(counted, order) <= model_bytes:
        model = _collected(counted, order)
        if model is None:
            return docs.select("doc_id", predictor(None)(F.col("text")).alias("found"))
        scored = entropies(model, asked)
    else:
        langs, floor, table = statistics(counted, order)
        model = Model(langs, order, [], floor)
        scored = block_entropies(asked, langs, order, floor, table)
    scored = store(scored, "entropies")
    model = _set_limits(model, scored.filter("lang is not null AND chars > 0").select("lang", "chars", "entropy"))
    return scored.select("doc_id", _decider(model)(F.struct("chars", "entropy")).alias("found"))
