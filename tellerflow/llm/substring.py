"""Removal of repeated passages, by suffix automata over shards of reference text.

A window of ``width`` words is repeated if its words also start anywhere else in the corpus; every
word in a repeated window goes. The reference text is only what may be repeated, found first:

* each window has an anchor, the smallest hash among its short word n-grams. Equal windows have
  equal anchors, so windows whose anchor occurs once in the corpus are unique;
* neighbouring windows with one anchor form a run; a long run is cut into runs that overlap by
  ``width - 1`` words, so periodic text gives equal runs, not one of its own length. Where all runs of an anchor are the same words,
  all their windows are repeated;
* the other anchors' distinct runs, with the number of their occurrences, are the reference. They
  are cut by anchor into shards of about equally many words, so that all places of a window are in one shard. A task builds the
  shard's suffix automaton with occurrence counts and streams the shard's runs through it: the
  matching statistic at a word is the longest suffix that occurs twice, and where it reaches
  ``width`` a repeated window ends.

An automaton of all reference text would grow with the corpus, so no automaton is broadcast to
all tasks: a shard's automaton goes with the runs that can match it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, utf8

#: Words of an anchor n-gram.
ANCHOR = 8
#: Words of the distinct runs in a shard, about.
SHARD_WORDS = 240_000
#: An anchor whose distinct runs have more words than this is cut further, window by window.
HOT_WORDS = 300_000
#: Windows of a run at most. Only text of a short period has longer stretches with one anchor.
RUN_WINDOWS = 1_000

RUN = "struct<key:long,seg:long,start:int,len:int,self:boolean>"
RUN_TYPE = pa.struct([("key", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("self", pa.bool_())])
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


class SpanHash:
    """Hashes of any span of a word sequence, equal for equal words."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        self.words = np.fromiter(map(digest, words), np.uint64, len(words))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * _powers(BASE, len(words))[:-1], dtype=np.uint64)])
        self.back = _powers(INVERSE, len(words))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def runs_of(words: list[bytes], width: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor, hash of the words, first window, number of windows, and whether the anchor's n-gram recurs, of each run."""
    windows = len(words) - width + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, bool))
    hashed = SpanHash(words)
    grams = np.zeros(len(words) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = _mix(grams + hashed.words[k:len(words) - anchor + 1 + k])
    # the least n-gram of each window, over spans of doubled length
    reach, least = 1, grams
    while reach * 2 <= width - anchor + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - anchor + 1 - reach
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    lengths = np.diff(np.append(starts, windows))
    if lengths.max() > RUN_WINDOWS:
        parts = -(-lengths // RUN_WINDOWS)
        shift = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN_WINDOWS
        starts, lengths = np.repeat(starts, parts) + shift, np.minimum(np.repeat(lengths, parts) - shift, RUN_WINDOWS)
    keys = least[starts]
    ordered = np.sort(grams)
    recurring = ordered[1:][ordered[1:] == ordered[:-1]]
    own = hashed.of(starts, starts + lengths + width - 1)
    return keys.view(np.int64), own.view(np.int64), starts.astype(np.int32), lengths.astype(np.int32), np.isin(keys, recurring)


class Automaton:
    """A suffix automaton of several word sequences, with weighted numbers of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: int, state: int) -> int:
        """The state for the shorter suffixes of ``state``, as reached from ``at``."""
        copy = self._state(self.length[at] + 1)
        self.next[copy] = dict(self.next[state])
        self.link[copy] = self.link[state]
        self.link[state] = copy
        while at != -1 and self.next[at].get(word) == state:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[int], weight: int) -> None:
        follow, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            at, known = last, follow[last].get(word)
            if known is not None:
                last = known if length[at] + 1 == length[known] else self._split(at, word, known)
            else:
                last = self._state(length[last] + 1)
                while at != -1 and word not in follow[at]:
                    follow[at][word] = last
                    at = link[at]
                if at != -1:
                    known = follow[at][word]
                    link[last] = known if length[at] + 1 == length[known] else self._split(at, word, known)
            self.count[last] += weight

    def finish(self) -> None:
        """Occurrences of the longer sequences count for their suffixes."""
        count, link = self.count, self.link
        for state in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            if link[state] > 0:
                count[link[state]] += count[state]

    def repeated(self, words: list[int], width: int) -> list[int]:
        """The starts of the sequence's windows that occur twice, by matching statistics."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        out = []
        for place, word in enumerate(words):
            state = follow[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and count[state] < 2:
                state = link[state]
                matched = length[state]
            if matched >= width:
                out.append(place - width + 1)
        return out


def find_repeated(sequences: list[bytes], weights: list[int], width: int) -> list[list[int]]:
    """For each sequence of words, the starts of the windows that occur twice among all sequences."""
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(w, len(numbers)) for w in s.split()] for s in sequences]
    automaton = Automaton()
    for words, weight in zip(coded, weights):
        automaton.add(words, weight)
    automaton.finish()
    return [automaton.repeated(words, width) for words in coded]


def _first_pass(width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, parts, offsets = [], [], [], [0]
            for data in utf8(batch.column(2)):
                words = data.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                own = runs_of(words, width)
                parts.append(own)
                offsets.append(offsets[-1] + len(own[0]))
            flat = [pa.array(np.concatenate([p[k] for p in parts])) for k in range(5)] if parts else []
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(RUN_TYPE)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), runs],
                ["doc_id", "rid", "n_words", "digest", "runs"])

    return read


def _cover(size: int, starts: Sequence[int], lengths: Sequence[int], width: int) -> np.ndarray:
    """Which words some window covers; a run of n windows covers n + width - 1 words."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(starts, np.int64) + np.array(lengths, np.int64) + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(words: list[bytes], covered: np.ndarray) -> bytes:
    return b" ".join([words[k] for k in np.flatnonzero(~covered).tolist()])


ENTRY = "struct<start:int,len:int,key:long,seg:long,mixed:boolean,w:long,hot:boolean>"
SETTLED = f"rid binary, line binary, entries array<{ENTRY}>, n_removed long, kept binary"


def _settle(width: int):
    """Final results where no automaton is needed; the words and runs where one is."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("key", pa.int64()), ("seg", pa.int64()),
                               ("mixed", pa.bool_()), ("w", pa.int64()), ("hot", pa.bool_())]))
    schema = pa.schema([("rid", pa.binary()), ("line", pa.binary()), ("entries", kind), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows, size = [], 0
            for rid, data, entries in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2)):
                if rid == before:  # copies lie next to each other
                    continue
                before = rid
                words, entries = data.split(), entries.as_py()
                if any(e["mixed"] for e in entries):
                    rows.append({"rid": rid, "line": b" ".join(words), "entries": entries})
                else:
                    covered = _cover(len(words), [e["start"] for e in entries], [e["len"] for e in entries], width)
                    rows.append({"rid": rid, "n_removed": int(covered.sum()), "kept": _kept(words, covered)})
                size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return settle


PIECES = "key long, seg long, at int, part long, w long, line binary"


def _pieces(width: int):
    """The reference text: each distinct run once, a hot anchor's runs window by window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, segs, ats, parts, ws, lines = [], [], [], [], [], []

            def add(*x) -> None:
                for held, value in zip((keys, segs, ats, parts, ws, lines), x):
                    held.append(value)

            for line, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chosen = [e for e in entries if e["w"]]
                words = line.split() if chosen else []
                hashed = SpanHash(words) if any(e["hot"] for e in chosen) else None
                for e in chosen:
                    start, end = e["start"], e["start"] + e["len"] + width - 1
                    if not e["hot"]:
                        add(e["key"], e["seg"], -1, e["key"], e["w"], b" ".join(words[start:end]))
                        continue
                    places = np.arange(start, start + e["len"])
                    for at, own in zip(places.tolist(), hashed.of(places, places + width).view(np.int64).tolist()):
                        add(e["key"], e["seg"], at - start, own, e["w"], b" ".join(words[at:at + width]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), pa.array(ats, pa.int32()), pa.array(parts, pa.int64()),
                 pa.array(ws, pa.int64()), pa.array(lines, pa.binary())], ["key", "seg", "at", "part", "w", "line"])

    return cut


def _finish(width: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, removed, kept = [], [], []
            for rid, line, entries, decided in zip(*(batch.column(k) for k in range(4))):
                words = line.as_py().split()
                same = [e for e in entries.as_py() if not e["mixed"]]
                starts, lengths = [e["start"] for e in same], [e["len"] for e in same]
                if decided.is_valid:
                    places, hits = decided.values.field("start").to_numpy(), decided.values.field("hits")
                    single = np.repeat(places, hits.value_lengths().to_numpy()) + hits.flatten().to_numpy()
                    starts, lengths = np.append(starts, single), np.append(lengths, np.ones(len(single)))
                covered = _cover(len(words), starts, lengths, width)
                rids.append(rid.as_py())
                removed.append(int(covered.sum()))
                kept.append(_kept(words, covered))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                                             ["rid", "n_removed", "kept"])

    return finish


def remove_repeats(docs: DataFrame, width: int = 35, hot_words: int = HOT_WORDS, digest_only: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row of ``docs(doc_id, text, ...)``.

    ``kept`` is the text of the words that stay, joined by one space: null where nothing was removed
    (the words are as they were). With ``digest_only`` there is ``kept_sha256`` in its place, the hash of
    the kept words in every row. Null and empty texts have no words. Repeated rows and copies repeat each
    other's windows, so they lose them; extra columns are ignored.
    """
    rid = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    first = store(docs.select("doc_id", rid.alias("rid"), "text").mapInArrow(
        _first_pass(width), f"doc_id long, rid binary, n_words long, digest binary, runs array<{RUN}>"), "runs")
    runs = first.select("rid", F.inline("runs"))
    keys = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("self").alias("self"))
    keys = store(keys.filter("n > 1 or self").select("key", F.expr("low <> high or self").alias("mixed")), "anchors")
    # copies of a text fall together here, before the shuffle
    flagged = runs.select("rid", "start", "len", "key", "seg").join(keys, "key")
    flagged = store(flagged.groupBy("rid", "start", "len", "key", "seg", "mixed").agg(F.count("*").alias("n")), "flagged")

    distinct = flagged.filter("mixed").groupBy("key", "seg").agg(
        F.sum("n").alias("w"), F.min(F.struct("rid", "start", "len")).alias("place"))
    distinct = store(distinct, "distinct")
    # stored, so that Spark knows how few they are and needn't deal the distinct runs by anchor
    n_words = F.col("place.len").cast("long") + (width - 1)
    hot = store(distinct.groupBy("key").agg(F.sum(n_words).alias("n")).filter(F.col("n") > hot_words).select("key", F.lit(True).alias("hot")), "hot")
    reference = distinct.join(hot, "key", "left").agg(F.sum(F.when(F.col("hot"), F.col("place.len").cast("long") * width).otherwise(n_words)))
    shards = max(1, -(-(reference.first()[0] or 0) // SHARD_WORDS))

    def entry(mixed: Column, w: Column, is_hot: Column) -> Column:
        return F.struct("start", "len", "key", "seg", mixed.alias("mixed"), w.alias("w"), is_hot.alias("hot"))

    plain = flagged.select("rid", entry(F.col("mixed"), F.lit(0).cast("long"), F.lit(False)).alias("e"))
    chosen = distinct.join(hot, "key", "left").select("place.*", "key", "seg", "w", F.coalesce("hot", F.lit(False)).alias("hot"))
    chosen = chosen.select("rid", entry(F.lit(True), F.col("w"), F.col("hot")).alias("e"))
    wanted = plain.union(chosen).groupBy("rid").agg(F.collect_list("e").alias("entries"))
    # many copies of one text: a join of stored tables is dealt anew where one rid holds too much
    wanted = store(wanted, "wanted")
    texts = docs.select(rid.alias("rid"), "text").join(wanted, "rid").select("rid", "text", "entries")
    settled = store(texts.mapInArrow(_settle(width), SETTLED), "settled")

    pieces = settled.filter("line is not null").select("line", "entries").mapInArrow(_pieces(width), PIECES)
    pieces = store(pieces, "pieces")
    parts = pieces.groupBy("part", "line").agg(
        F.sum("w").alias("w"), F.min("at").alias("at"), F.min("key").alias("key"), F.min("seg").alias("seg"))

    def statistics(table: pa.Table) -> pa.Table:
        found = find_repeated(table.column("line").to_pylist(), table.column("w").to_pylist(), width)
        return pa.table({"part": table.column("part"), "seg": table.column("seg"), "hot": table.column("hot"),
                         "hits": pa.array(found, pa.list_(pa.int32()))})

    sharded = parts.select("part", "seg", (F.col("at") >= 0).alias("hot"), "w", "line", F.pmod(F.xxhash64("part"), F.lit(shards)).alias("shard"))
    found = sharded.groupBy("shard").applyInArrow(statistics, "part long, seg long, hot boolean, hits array<int>")
    found = store(found.filter(F.size("hits") > 0), "found")
    cold = found.filter("not hot").select(F.col("part").alias("key"), "seg", "hits")
    # a window of a hot anchor is its own part; its run learns which windows were found
    windows = pieces.filter("at >= 0").select("key", "seg", "at", "part").join(found.filter("hot").select("part"), "part")
    warm = windows.groupBy("key", "seg").agg(F.collect_set("at").alias("hits"))
    decided = flagged.filter("mixed").select("rid", "start", "key", "seg").join(cold.unionByName(warm), ["key", "seg"])
    decided = decided.groupBy("rid").agg(F.collect_list(F.struct("start", "hits")).alias("decided"))
    open_ = settled.filter("line is not null").select("rid", "line", "entries").join(decided, "rid", "left")
    late = open_.select("rid", "line", "entries", "decided").mapInArrow(_finish(width), "rid binary, n_removed long, kept binary")
    result = settled.filter("line is null").select("rid", "n_removed", "kept").union(late)
    if digest_only:
        result = result.select("rid", "n_removed", F.sha2("kept", 256).alias("kept"))
    result = store(result.dropDuplicates(["rid"]), "kept")
    joined = first.select("doc_id", "rid", "n_words", "digest").join(result, "rid", "left")
    removed = F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed")
    if digest_only:
        return joined.select("doc_id", "n_words", removed, F.coalesce("kept", F.lower(F.hex("digest"))).alias("kept_sha256"))
    return joined.select("doc_id", "n_words", removed, F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).alias("kept"))
