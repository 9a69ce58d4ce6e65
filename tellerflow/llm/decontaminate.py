"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_column, per_worker, utf8

#: Item words one automaton may hold (about 0.2 kB each); more items make further automata, never fewer items.
AUTOMATON_WORDS = 1_000_000

#: Bytes of normalised text: letters lowered, what isn't part of a word turned to a space.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER
)
#: A word in the original text, before lowering.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HIT = "struct<n_words:long,hits:array<struct<start:int,end:int>>,items:array<string>>"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


Context = tuple[tuple[int, ...], tuple[int, ...]]


class Matcher:
    """One automaton over the items, and how to tell the windows from what it finds.

    Its patterns are blocks of half a window's words, at every place of an item that half a window's
    words divide: each window holds one of them whole. With a block go its contexts, the words up to half a window before
    and behind it in the items. Where a block occurs in a text, the words around it that agree with a
    context tell which windows occur. So the automaton has about one state a word, not one a word and window.
    An item shorter than a window is one pattern.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.block, self.width = (width + 1) // 2, width
        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], dict[Context | None, set[str]]] = {}
        for item, data in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(data))
            names = set() if item is None else {item}
            if 0 < len(words) < width:
                patterns.setdefault(words, {}).setdefault(None, set()).update(names)
                continue
            reach = width - self.block
            for at in range(0, len(words) - self.block + 1, self.block):
                end = at + self.block
                # nearest words first on both sides
                context = (words[max(0, at - reach):at][::-1], words[end:end + reach])
                patterns.setdefault(words[at:end], {}).setdefault(context, set()).update(names)
        self.automaton = None
        if patterns:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for pattern, found in patterns.items():
                self.automaton.add_word(pattern, (len(pattern), list(found.items())))
            self.automaton.make_automaton()

    def spans(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans covered by windows, and the items whose windows occur."""
        spans, names = [], set()
        for last, (length, contexts) in self.automaton.iter(tuple(words)):
            start, end = last - length + 1, last + 1
            for context, items in contexts:
                left = right = 0
                if context is not None:
                    before, behind = context
                    while left < min(len(before), start) and words[start - left - 1] == before[left]:
                        left += 1
                    while right < min(len(behind), len(words) - end) and words[end + right] == behind[right]:
                        right += 1
                    if left + length + right < self.width:
                        continue
                spans.append((start - left, end + right))
                names |= items
        return spans, names


def scan_text(data: bytes, matcher: Matcher) -> dict:
    words = words_of(data)
    out = {"n_words": len(words), "hits": [], "items": []}
    if matcher.automaton is None or not words:
        return out
    get = matcher.numbers.get
    spans, names = matcher.spans([get(w, 0) for w in words])
    if spans:
        del words
        hit = set()
        reach = 0
        for a, b in sorted(spans):
            hit.update(range(max(a, reach), b))
            reach = max(reach, b)
        out["hits"] = [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORD.finditer(data.decode())) if k in hit]
        out["items"] = sorted(names)
    return out


def _blocks(spark: SparkSession, benchmark: DataFrame, automaton_words: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    # a word takes two characters at least
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    count = max(1, int(size // automaton_words) + 1)
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items for k in range(count)]


def scanner(benchmark: DataFrame, width: int = 10, automaton_words: int = AUTOMATON_WORDS):
    """An expression over a text column: ``struct(n_words, hits, items)`` against the whole benchmark.

    The benchmark is a given query set: its items are broadcast, and a worker builds their automaton once, whatever
    number of batches and tasks it serves. One automaton reads each text once. Only a benchmark of more than about
    ``automaton_words`` words, a bound on a worker's memory, is cut into several (an item never is).
    """
    spark = benchmark.sparkSession
    readers, scan_id = [], uuid.uuid4().hex
    for number, block in enumerate(_blocks(spark, benchmark, automaton_words)):
        items = spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in block.collect()])

        def scan(column: pa.Array, items=items, number=number) -> pa.Array:
            kept = per_worker("decontaminate", dict)
            if kept.get("scan") != scan_id:  # those of an earlier scan go
                kept.clear()
                kept["scan"] = scan_id
            if number not in kept:
                kept[number] = Matcher(items.value, width)
            matcher = kept[number]
            return pa.array(
                [scan_text(x, matcher) for x in utf8(column)],
                pa.struct([("n_words", pa.int64()),
                           ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                           ("items", pa.list_(pa.string()))]),
            )

        readers.append(arrow_column(scan, HIT))

    def expression(text: Column) -> Column:
        found = [read(text) for read in readers]
        if len(found) == 1:
            return found[0]
        hits, names = found[0]["hits"], found[0]["items"]
        for other in found[1:]:
            hits, names = F.array_union(hits, other["hits"]), F.array_union(names, other["items"])
        return F.struct(found[0]["n_words"].alias("n_words"), F.array_sort(hits).alias("hits"), F.array_sort(names).alias("items"))

    return expression


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``(doc_id, found)`` per row of ``docs(doc_id, text, ...)``, found being :func:`scanner`'s struct.

    A null or empty text has no words and no hits. A null item id marks words but is never listed;
    repeated items count once. Repeated rows stay repeated; extra columns are ignored; an empty
    benchmark finds nothing.
    """
    return docs.select("doc_id", scanner(benchmark, width)(F.col("text")).alias("found"))
