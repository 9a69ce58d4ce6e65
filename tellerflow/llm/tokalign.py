"""Alignment of two tokenizers' tokens by a monoid of fragments.

Both tokenizers cut the same bytes. Where tokens of both end, a group is closed; groups are the finest
spans that both agree on. A *fragment* is what is known of a byte range by itself: tokens before the first
common end (the open head), closed groups, and tokens after the last common end (the open tail). Two neighbouring
fragments compose: the left tail and the right head meet, common ends are searched in them again, and
what they close joins the closed groups. This is associative, so fragments may be composed in any tree.

* Texts up to ``LONG`` characters are cut at spaces into pieces over which no token of either vocabulary
  can reach. Each piece's fragment is closed, is computed once per task, and is reused.
* Longer texts are cut into byte ranges, which go to different tasks. Each tokenizer's tokens are cut at the
  first place at or after a range's beginning where that tokenizer, judged by the two characters around it, must
  cut; the places of the two may differ, which leaves open heads and tails. The fragments, without what they
  have closed, are composed in a tree of ``FAN`` each; closed groups stay where they were found, so no
  task holds a whole long document.

An id pair's count is the number of its links in the whole corpus. The counts of the ``HOT_PAIRS`` most frequent
pairs, a bounded table, are broadcast; all other pairs meet their counts in a shuffled join.

Tokenizers: a byte-level BPE whose pre-tokenizer splits as GPT-2's, and a SentencePiece BPE with byte
fallback that adds a space in front. Their files are parameters, read in each task.

Defined cases: a text that is null or empty, or that a tokenizer doesn't give back byte by byte, has no tokens:
all numbers are 0 and the digest is empty. Rows with equal or null ids are documents of their own. An empty table
gives an empty table. Extra columns are not read. A stretch without any place to cut is one range whatever its length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, store

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: Texts above this many characters are cut into ranges of ``RANGE`` characters.
LONG = 65_536
RANGE = 32_768
#: Fragments composed at once.
FAN = 16
#: Pairs whose counts are broadcast.
HOT_PAIRS = 200_000
#: Pieces remembered in a task, and characters worked on at once.
REMEMBERED = 300_000
SLICE = 1_000_000
#: Runs without a space, or of spaces only, above this length go to the slower library, whose cost stays linear in them.
RUN = 2_000

#: How GPT-2's pre-tokenizer splits (fixed value).
GPT2_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Files(NamedTuple):
    """Where the tokenizers' files lie on every executor."""

    byte_path: str = BYTE_BPE
    piece_path: str = PIECE_BPE


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The byte-level tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.slow = tokenizers.Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.pieces = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, number in vocab.items():
            if all(c in letters for c in piece):
                self.pieces[number] = bytes(letters[c] for c in piece)
        self.fast = self._fast(spec, vocab, letters)

    def _fast(self, spec: dict, vocab: dict[str, int], letters: dict[str, int]) -> tiktoken.Encoding | None:
        """The same vocabulary in the faster library, if merges come in the order of their ids and nothing else is done to texts."""
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {piece: n for piece, n in vocab.items() if piece not in added}
        split = spec["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        same = (
            spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and all(c in letters for piece in ranks for c in piece)
            and [ranks.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and len(ranks) == 256 + len(merges)
        )
        if not same:
            return None
        return tiktoken.Encoding("same", pat_str=GPT2_SPLIT, mergeable_ranks={self.pieces[n]: n for n in ranks.values()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceBpe:
    """The SentencePiece tokenizer for the middle of a text, where no space is added."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]
        usual = [n.replace("▁", " ") for i, n in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: neighbouring characters within a piece; between all others every text is cut
        self.pairs = {n[i:i + 2] for n in usual for i in range(len(n) - 1)}
        if any("\n" in pair for pair in self.pairs):
            raise ValueError("the vocabulary joins line breaks with other characters")

    def encode(self, text: str) -> list[int]:
        # the added space and the line break are tokens of their own
        return self.model.encode("\n" + text)[2:]


LONG_RUN = re.compile(rf"\S{{{RUN}}}|\s{{{RUN}}}")


def load(files: Files) -> Pair:
    return per_worker(("tokenizers", *files), lambda: Pair(ByteBpe(files.byte_path), PieceBpe(files.piece_path)))


def kind(char: str) -> str | None:
    """How the pre-tokenizer sees a character; None where versions of Unicode may differ."""
    category = unicodedata.category(char)
    if category in ("Cn", "Co", "Cs") or "\x1c" <= char <= "\x1f":
        return None
    if char.isspace():
        return "space"
    return {"L": "letter", "N": "number"}.get(category[0], "other")


class Open(NamedTuple):
    """Tokens of both sides with the byte offsets of their ends."""

    a: list[int]
    a_end: list[int]
    b: list[int]
    b_end: list[int]

    def __add__(self, other: Open) -> Open:
        return Open(*(x + y for x, y in zip(self, other, strict=True)))

    def cut(self, ends: list[int]) -> list[Open]:
        """The tokens up to each of the ends, and the rest."""
        out, i, j = [], 0, 0
        for end in [*ends, None]:
            to = (np.searchsorted(self.a_end, end, "right"), np.searchsorted(self.b_end, end, "right")) if end is not None else (len(self.a), len(self.b))
            out.append(Open(self.a[i:to[0]], self.a_end[i:to[0]], self.b[j:to[1]], self.b_end[j:to[1]]))
            i, j = to
        return out

    def common(self) -> list[int]:
        return sorted(set(self.a_end) & set(self.b_end))


EMPTY = Open([], [], [], [])


class Fragment(NamedTuple):
    """What is known of a byte range. ``last`` is the last common end, None as long as there is none; then all is in ``head``.

    ``seams`` are the groups that composing has closed: (beginning, tokens).
    """

    head: Open
    last: int | None
    tail: Open
    seams: list[tuple[int, Open]]
    same: bool = True

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, this one before the other."""
        meeting = (self.head if self.last is None else self.tail) + other.head
        ends = meeting.common()
        *groups, rest = meeting.cut(ends)
        begin = self.last
        seams = list(self.seams)
        head, tail = self.head, EMPTY
        if begin is None:
            # nothing is known of where the first group begins: it stays open
            head, groups = (groups[0], groups[1:]) if groups else (rest, [])
            begin, ends = (ends[0], ends[1:]) if ends else (None, [])
        for end, group in zip(ends, groups, strict=True):
            seams.append((begin, group))
            begin = end
        if other.last is not None:
            begin, tail = other.last, other.tail
        elif begin is not None:
            tail = rest
        return Fragment(head, begin, tail, seams + other.seams, self.same and other.same)


#: The range of no bytes at a document's beginning, which is a common end.
BEGINNING = Fragment(EMPTY, 0, EMPTY, [])


class Groups(NamedTuple):
    """Closed groups of many pieces at once, one piece after the other: per piece numbers, text and links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text: list[str]
    link_from: np.ndarray
    links: np.ndarray


class Pair:
    """Both tokenizers, the bytes of their tokens, and how their tokens align."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.a_length, self.b_length = (np.array([len(p) for p in side.pieces]) for side in (a, b))
        self.radix = len(b.pieces)
        # each token as it reads inside a group, and at the end of its side
        self.words = [f"{i}{end}" for i in range(len(a.pieces)) for end in ",|"] + [f"{i}{end}" for i in range(len(b.pieces)) for end in ",;"]
        self.b_word = 2 * len(a.pieces)
        # spaces and the like that never stand behind another character in a piece
        self.cuts = [c for c in " \n\t" if not any(p[1] == c and p[0] != c for p in b.pairs)]
        stay = "".join(self.cuts)
        self.piece = re.compile(rf"\s*\S+(?:(?=[^\S{stay}])\s+\S*)*|\s+") if self.cuts else re.compile(r"(?s).+")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both sides, and whether both give the text's bytes back."""
        data = text.encode()
        a, b = self.a.encode(text), self.b.encode(text)
        same = b"".join(map(self.a.pieces.__getitem__, a)) == data and b"".join(map(self.b.pieces.__getitem__, b)) == data
        return np.array(a, np.int64), np.array(b, np.int64), same

    def links(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the A token and key of the pair, of all overlaps of tokens that begin at one byte."""
        if not len(a):
            return a, a
        start = np.concatenate([[begin], a_end[:-1]])
        first, last = np.searchsorted(b_end, start, "right"), np.searchsorted(b_end, a_end, "left")
        number = last - first + 1
        at = np.repeat(np.arange(len(a)), number)
        place = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
        return at, a[at] * self.radix + b[place]

    def groups(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, begin: int, pieces: np.ndarray) -> Groups:
        """Align tokens that both end at the last of the pieces' ends; each piece's end is a common one."""
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        in_a, in_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        last_a, last_b = np.append(in_a[1:] != in_a[:-1], True)[:len(a)], np.append(in_b[1:] != in_b[:-1], True)[:len(b)]
        words = np.concatenate([2 * a + last_a, self.b_word + 2 * b + last_b])
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        text = list(map(self.words.__getitem__, words[order].tolist()))
        to_a, to_b = np.searchsorted(a_end, pieces, "right"), np.searchsorted(b_end, pieces, "right")
        stops = (to_a + to_b).tolist()
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        at, links = self.links(a, a_end, b, b_end, begin)
        link_to = np.searchsorted(at, to_a, "left")
        texts = ["".join(text[i:j])[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        return Groups(n_a, n_b, np.diff(np.searchsorted(ends, pieces, "right"), prepend=0), texts, np.concatenate([[0], link_to]), links)

    def closed(self, found: Open, begin: int) -> Groups:
        """The one group that these tokens form."""
        sides = [np.array(x, np.int64) for x in found]
        return self.groups(*sides, begin, sides[1][-1:])

    def fragment(self, a_text: str, a_from: int, b_text: str, b_from: int, first: bool) -> tuple[Fragment, Groups | None]:
        """A range's fragment and what it closes by itself; the sides' texts begin at bytes ``a_from`` and ``b_from``."""
        a, b = np.array(self.a.encode(a_text), np.int64), np.array(self.b.encode(b_text), np.int64)
        same = (
            b"".join(map(self.a.pieces.__getitem__, a)) == a_text.encode() and b"".join(map(self.b.pieces.__getitem__, b)) == b_text.encode())
        if not same:
            return Fragment(EMPTY, None, EMPTY, [], False), None
        a_end, b_end = a_from + np.cumsum(self.a_length[a]), b_from + np.cumsum(self.b_length[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        open_ = lambda i, j, k, m: Open(a[i:j].tolist(), a_end[i:j].tolist(), b[k:m].tolist(), b_end[k:m].tolist())
        if not len(ends) and not first:
            return Fragment(open_(0, len(a), 0, len(b)), None, EMPTY, []), None
        begin = 0 if first else int(ends[0])
        last = int(ends[-1]) if len(ends) else 0
        i, k = (0, 0) if first else (np.searchsorted(a_end, begin, "right"), np.searchsorted(b_end, begin, "right"))
        j, m = np.searchsorted(a_end, last, "right"), np.searchsorted(b_end, last, "right")
        body = self.groups(a[i:j], a_end[i:j], b[k:m], b_end[k:m], begin, np.array([last])) if last > begin else None
        return Fragment(open_(0, i, 0, k), last, open_(j, len(a), m, len(b)), []), body

    def a_cuts(self, left: str, right: str) -> bool:
        """Whether the byte-level side ends a token between these neighbours in any text."""
        x, y = kind(left), kind(right)
        return None not in (x, y) and x != "space" and x != y and left != "'"

    def b_cuts(self, left: str, right: str) -> bool:
        return left + right not in self.b.pairs

    def places(self, text: str, size: int) -> list[tuple[int, int]]:
        """Where each side is cut for ranges of about ``size`` characters."""
        out = [(0, 0)]
        for near in range(size, len(text), size):
            cut = []
            for side, cuts in enumerate((self.a_cuts, self.b_cuts)):
                at = max(near, out[-1][side])
                while at < len(text) and not cuts(text[at - 1], text[at]):
                    at += 1
                cut.append(at)
            if min(cut) < len(text):
                out.append((cut[0], cut[1]))
        return [*out, (len(text), len(text))]


class Memory:
    """The groups of all pieces seen in a task."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.text: list[str] = []
        none = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_groups, self.same = none, none, none, np.zeros(0, bool)
        self.link_from, self.links = np.zeros(1, np.int64), none

    def learn(self, pieces: list[str]) -> None:
        """Align new pieces. One after the other they are a text that is cut between them, but for those that end in a space or are very long."""
        alone = [p for p in pieces if p[-1].isspace() or len(p) > RUN]
        together = [p for p in pieces if not p[-1].isspace() and len(p) <= RUN] if alone else pieces
        if together:
            a, b, same = self.pair.encode("".join(together))
            if same:
                self._add(together, a, b, np.cumsum([len(p.encode()) for p in together]), True)
            else:
                wrong = {p for p in together if not self.pair.encode(p)[2]}
                alone += wrong
                if wrong:
                    self.learn([p for p in together if p not in wrong])
                else:
                    alone += together
        for piece in alone:
            a, b, same = self.pair.encode(piece)
            self._add([piece], a if same else a[:0], b if same else b[:0], np.array([len(piece.encode()) if same else 0]), same)

    def _add(self, pieces: list[str], a: np.ndarray, b: np.ndarray, ends: np.ndarray, same: bool) -> None:
        found = self.pair.groups(a, np.cumsum(self.pair.a_length[a]), b, np.cumsum(self.pair.b_length[b]), 0, ends)
        for piece in pieces:
            self.known[piece] = len(self.known)
        self.size += sum(map(len, pieces))
        self.text += found.text
        self.n_a, self.n_b = np.append(self.n_a, found.n_a), np.append(self.n_b, found.n_b)
        self.n_groups, self.same = np.append(self.n_groups, found.n_groups), np.append(self.same, np.full(len(pieces), same))
        self.link_from = np.append(self.link_from, self.link_from[-1] + found.link_from[1:])
        self.links = np.append(self.links, found.links)

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """For each text numbers of tokens and groups, digest, keys of its pairs and how often each is linked."""
        pieces = [self.pair.piece.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED or self.size > 20 * REMEMBERED:
            self.clear()
        new = list(dict.fromkeys(p for found in pieces for p in found if p not in self.known))
        if new:
            self.learn(new)
        flat = np.array([self.known[p] for found in pieces for p in found], np.int64)
        size = np.array([len(found) for found in pieces])
        doc = np.repeat(np.arange(len(texts)), size)
        bad = np.bincount(doc[~self.same[flat]], minlength=len(texts)) > 0
        numbers = [np.bincount(doc, weights=n[flat], minlength=len(texts)).astype(np.int64) for n in (self.n_a, self.n_b, self.n_groups)]
        number = self.link_from[flat + 1] - self.link_from[flat]
        place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(self.link_from[flat], number)
        space = np.int64(len(self.pair.a.pieces) * self.pair.radix)
        keys, times = np.unique(np.repeat(doc, number) * space + self.links[place], return_counts=True)
        to = np.searchsorted(keys, np.arange(1, len(texts) + 1) * space)
        keys %= space
        at = 0
        for i, n in enumerate(size.tolist()):
            low = to[i - 1] if i else 0
            if bad[i] or not n:
                yield 0, 0, 0, "", keys[:0], times[:0]
            else:
                line = ";".join(map(self.text.__getitem__, flat[at:at + n].tolist()))
                yield *(int(x[i]) for x in numbers), hashlib.sha256(line.encode()).hexdigest(), keys[low:to[i]], times[low:to[i]]
            at += n


PART = "n_a long, n_b long, n_groups long, digest string, keys array<long>, times array<int>"
PART_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
CLOSED = "begin long, line string, n_a long, n_b long, n_groups long, keys array<long>, times array<int>"
CLOSED_TYPE = pa.schema([
    ("begin", pa.int64()), ("line", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
OPEN_TYPE = pa.struct([("a", pa.list_(pa.int32())), ("a_end", pa.list_(pa.int64())), ("b", pa.list_(pa.int32())), ("b_end", pa.list_(pa.int64()))])
SEAM_TYPE = pa.struct([("begin", pa.int64()), ("tokens", OPEN_TYPE)])
OPEN = "struct<a:array<int>,a_end:array<bigint>,b:array<int>,b_end:array<bigint>>"
FRAGMENT = f"row long, place int, head {OPEN}, last long, tail {OPEN}, seams array<struct<begin:bigint,tokens:{OPEN}>>, same boolean"
FRAGMENT_TYPE = pa.schema([
    ("row", pa.int64()), ("place", pa.int32()), ("head", OPEN_TYPE), ("last", pa.int64()), ("tail", OPEN_TYPE),
    ("seams", pa.list_(SEAM_TYPE)), ("same", pa.bool_())])
RANGES = "place int, a_text string, a_from long, b_text string, b_from long"


def _fragment_row(row: int, place: int, f: Fragment) -> dict:
    seams = [{"begin": begin, "tokens": tokens._asdict()} for begin, tokens in f.seams]
    return {"row": row, "place": place, "head": f.head._asdict(), "last": f.last, "tail": f.tail._asdict(), "seams": seams, "same": f.same}


def _fragment(r: dict) -> Fragment:
    return Fragment(Open(**r["head"]), r["last"], Open(**r["tail"]), [(s["begin"], Open(**s["tokens"])) for s in r["seams"]], r["same"])


def _closed_row(begin: int, found: Groups | None) -> dict:
    if found is None:
        return {"begin": begin, "line": None, "n_a": 0, "n_b": 0, "n_groups": 0, "keys": [], "times": []}
    keys, times = np.unique(found.links, return_counts=True)
    return {"begin": begin, "line": found.text[0], "n_a": int(found.n_a[0]), "n_b": int(found.n_b[0]),
            "n_groups": int(found.n_groups[0]), "keys": keys, "times": times}


def short_parts(docs: DataFrame, files: Files) -> DataFrame:
    """A part of the result for each text of ordinary length (columns ``row`` and ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = per_worker(("pieces", *files), lambda: Memory(load(files)))
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            cuts = [0, *np.flatnonzero(np.diff(lengths // SLICE)) + 1, batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                texts = [t or "" for t in batch.column("text").slice(low, high - low).to_pylist()]
                found = list(memory.align(texts))
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), PART_TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(low, high - low) for n in ("row", "doc_id")), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "digest", "keys", "times"]
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, {PART}")


def ranges(docs: DataFrame, files: Files, size: int) -> DataFrame:
    """Long texts cut into ranges, a row each; the first one carries the document's id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(files)
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                row, ids = batch.column("row").slice(at, 1), batch.column("doc_id").slice(at, 1)
                line = " " + text.as_py()
                places = pair.places(line, size)
                a_byte = b_byte = 0
                for place, ((a, b), (a_to, b_to)) in enumerate(zip(places, places[1:], strict=False)):
                    a_text, b_text = line[a:a_to], line[b:b_to]
                    told = [pa.array([x], t) for x, t in (
                        (place, pa.int32()), (a_text, pa.string()), (a_byte, pa.int64()), (b_text, pa.string()), (b_byte, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(
                        [row, ids if place == 0 else pa.nulls(1, ids.type), *told], names=["row", "doc_id", "place", "a_text", "a_from", "b_text", "b_from"])
                    a_byte, b_byte = a_byte + len(a_text.encode()), b_byte + len(b_text.encode())

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, {RANGES}")


def fragments(cut: DataFrame, files: Files) -> DataFrame:
    """Each range's fragment, and what it closes by itself."""
    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([*FRAGMENT_TYPE, *CLOSED_TYPE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(files)
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                r = one.drop_columns(["doc_id"]).to_pylist()[0]
                found, body = pair.fragment(r["a_text"], r["a_from"], r["b_text"], r["b_from"], r["place"] == 0)
                told = {**_fragment_row(r["row"], r["place"], found), **_closed_row(found.head.a_end[-1] if found.head.a_end else 0, body)}
                rest = pa.RecordBatch.from_pylist([told], schema)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), *rest.columns], names=["doc_id", *schema.names])

    return cut.repartition("row", "place").mapInArrow(run, f"doc_id {kind}, {FRAGMENT}, {CLOSED}")


def composed(found: DataFrame) -> DataFrame:
    """One fragment for each ``FAN`` neighbouring ones of a document."""

    def run(batch: pa.Table) -> pa.Table:
        rows = sorted(batch.to_pylist(), key=lambda r: r["place"])
        whole = functools.reduce(lambda x, y: x + y, map(_fragment, rows), BEGINNING if rows[0]["place"] == 0 else NOTHING)
        return pa.Table.from_pylist([_fragment_row(rows[0]["row"], rows[0]["place"] // FAN, whole)], FRAGMENT_TYPE)

    columns = FRAGMENT_TYPE.names
    return found.select(*columns).groupBy("row", F.expr(f"place div {FAN}").alias("parent")).applyInArrow(run, FRAGMENT)


#: The fragment of no bytes.
NOTHING = Fragment(EMPTY, None, EMPTY, [])


def seams(whole: DataFrame, files: Files) -> DataFrame:
    """The groups closed by composing, as rows like those that the ranges have closed."""
    schema = pa.schema([("row", pa.int64()), *CLOSED_TYPE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(files)
        for batch in batches:
            yield pa.RecordBatch.from_pylist(
                [{"row": r["row"], **_closed_row(r["begin"], pair.closed(Open(**r["tokens"]), r["begin"]))} for r in batch.to_pylist()], schema)

    return whole.select("row", F.explode("seams").alias("seam")).select("row", "seam.*").mapInArrow(run, f"row long, {CLOSED}")


def digests(lines: DataFrame) -> DataFrame:
    """The digest of each row's lines in the order of their beginnings, streamed."""
    schema = pa.schema([("row", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, None
        for batch in batches:
            for at, line in zip(batch.column("row"), batch.column("line"), strict=True):
                if at.as_py() != row:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([{"row": row, "digest": state.hexdigest()}], schema)
                    row, state = at.as_py(), hashlib.sha256()
                else:
                    state.update(b";")
                state.update(line.as_py().encode())
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"row": row, "digest": state.hexdigest()}], schema)

    return lines.select("row", "begin", "line").repartition("row").sortWithinPartitions("row", "begin").mapInArrow(run, "row long, digest string")


def long_parts(docs: DataFrame, files: Files, size: int) -> DataFrame:
    """Parts of the results for long texts: one per range, per seam, and per document for the digest."""
    found = store(fragments(ranges(docs, files, size), files), "fragments")
    level, most = found, found.agg(F.max("place")).first()[0]
    while True:
        level = store(composed(level), "composed")
        if not most or (most := most // FAN) == 0:
            break
    good = level.filter(F.col("same") & F.col("last").isNotNull())
    columns = ["row", *CLOSED_TYPE.names]
    bodies = found.filter(F.col("line").isNotNull()).join(good.select("row"), "row", "left_semi").select(*columns)
    closed = store(bodies.unionByName(seams(good, files)), "closed")
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = closed.select("row", F.lit(None).cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", F.lit("").alias("digest"), "keys", "times")
    none = [F.array().cast("array<long>").alias("keys"), F.array().cast("array<int>").alias("times")]
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups")]
    told = found.filter(F.col("place") == 0).join(digests(closed), "row", "left")
    return each.unionByName(told.select("row", "doc_id", *zero, F.coalesce("digest", F.lit("")).alias("digest"), *none))


def scores(parts: DataFrame, radix: int, hot_pairs: int) -> DataFrame:
    """Per row the number of links, of best links, and the sum of the links' counts."""
    each = parts.select("row", F.explode(F.arrays_zip("keys", "times")).alias("link")).select(
        "row", F.col("link.keys").alias("key"), F.col("link.times").cast("long").alias("times"))
    counts = store(each.groupBy("key").agg(F.sum("times").alias("count")), "pair-counts")
    # one row for each id of the second vocabulary
    best = counts.groupBy((F.col("key") % radix).alias("b")).agg(F.max("count").alias("most"))
    rated = store(
        counts.withColumn("b", F.col("key") % radix).join(F.broadcast(best), "b").select("key", "count", (F.col("count") == F.col("most")).alias("best")),
        "rated-pairs")
    hot = store(rated.orderBy(F.desc("count"), "key").limit(hot_pairs), "hot-pairs")
    near = each.join(F.broadcast(hot), "key", "left")
    weighed = [F.col("times"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum")]
    known = near.filter(F.col("count").isNotNull()).select("row", *weighed)
    rest = near.filter(F.col("count").isNull()).select("row", "key", "times").join(rated, "key").select("row", *weighed)
    return known.unionByName(rest).groupBy("row").agg(
        F.sum("times").alias("n_links"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(
    docs: DataFrame, files: Files = Files(), doc_id: str = "doc_id", text: str = "text",
    long: int = LONG, size: int = RANGE, hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """One row per document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    See the module's text for nulls, repeated rows, empty tables, long texts and clashing names.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # each row's number is written together with all that belongs to it before it is used; odd ones are the long texts'
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    numbered = named.select((F.monotonically_increasing_id() * 2 + is_long.cast("int")).alias("row"), "doc_id", "text")
    short, lengthy = numbered.filter(F.col("row") % 2 == 0), numbered.filter(F.col("row") % 2 == 1)
    parts = store(short_parts(short, files).unionByName(long_parts(lengthy, files, size)), "parts")
    told = parts.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")],
        F.max("digest").alias("groups_sha256"))
    radix = sentencepiece.SentencePieceProcessor(model_file=files.piece_path).get_piece_size()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return told.join(scores(parts, radix, hot_pairs), "row", "left").select(
        F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", *zero, "groups_sha256")
