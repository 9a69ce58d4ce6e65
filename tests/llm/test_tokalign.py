"""Token alignment against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
import sentencepiece
import tokenizers
from edge import LONG, documents, none

from tellerflow.llm import queries, tokalign
from tellerflow.sources.tables import table

A = tokenizers.Tokenizer.from_file(tokalign.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=tokalign.PIECE_BPE)
LETTERS = tokalign.byte_letters()


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(ids, to_bytes):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(to_bytes(i))))
        at = out[-1][2]
    return out


def groups_of(text):
    """The groups of a text, each two lists of (id, begin, end), by the libraries' own encoding of the whole."""
    a = A.encode(" " + text, add_special_tokens=False).ids if text else []
    b = B.encode(text) if text else []
    a_bytes = lambda i: bytes(LETTERS[c] for c in A.id_to_token(i))
    if not text or b"".join(map(a_bytes, a)) != (" " + text).encode() or b"".join(map(b_bytes, b)) != (" " + text).encode():
        return []
    a, b = spans(a, a_bytes), spans(b, b_bytes)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    out, i, j = [], 0, 0
    for end in ends:
        k, m = i, j
        while k < len(a) and a[k][2] <= end:
            k += 1
        while m < len(b) and b[m][2] <= end:
            m += 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def plain(rows):
    found = [(i, groups_of(t)) for i, t in rows]
    links = [[(x[0], y[0]) for a, b in groups for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, groups in found]
    count = Counter(p for row in links for p in row)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, groups), row in zip(found, links, strict=True):
        line = ";".join(",".join(str(x[0]) for x in a) + "|" + ",".join(str(y[0]) for y in b) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(row),
                    sum(count[p] == most[p[1]] for p in row), sum(count[p] for p in row), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def result(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert frame.columns == names
    return sorted((tuple(r) for r in frame.collect()), key=str)


ODD = [
    "", " ", "  ", "a", " a", "a ", "\n", "a\n", " \n\t b  c\r\n d \r e;\r\n  ", "it's we'll 'tis x's9 don'tabc !'s", "日本語のテキスト。中国，文字", "ß é́ ﬁ ① ½",
    "<|endoftext|> </s> <s> <unk> <0x41>", "▁x", "a▁b c", " x  y  ", " a  b", "\x1c\x1d !\x1c x", "\x00\x01", "😀😀 👨‍👩‍👧", "a" * 3000,
    " " * 3000 + "x", "tab\tsep\tvalues\n\n\nmore", "ＦＵＬＬ　ｗｉｄｔｈ", "x=1;\r\n\t\ty=2;\r", "﻿bom", "é́", "ab" * 2000 + " c", "12345678901234567890 3.14e10",
]


def any_text(rng):
    alphabet = ["the ", "of", " ", "  ", "\n", "\t", "\r", "é", "日", "本", "'s", "'", "1", "23", ".", ";\r", "ﬁ", "▁", " ", "\x1c", "😀", "word", "Ab", "<s>", "qz"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))


def test_short_texts(spark):
    rng = random.Random(4)
    rows = list(enumerate(ODD + [any_text(rng) for _ in range(600)] + [None] + ODD))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(tokalign.align(frame)) == plain(rows)


@pytest.mark.parametrize("size", [3, 17, 100])
def test_ranges_give_what_whole_texts_give(spark, monkeypatch, size):
    monkeypatch.setattr(tokalign, "FAN", 3)
    rng = random.Random(size)
    rows = list(enumerate([t for t in ODD if len(t) < 500] + [any_text(rng) for _ in range(60)] + ["ab9" * 100, "日本語" * 40, "x " * 300]))
    frame = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    # all counts by the joined way, all texts by ranges
    assert result(tokalign.align(frame, long=0, size=size, hot_pairs=5)) == plain(rows + rows[:5])


def test_fragments_compose_in_any_order():
    pair = tokalign.Pair(tokalign.ByteBpe(tokalign.BYTE_BPE), tokalign.PieceBpe(tokalign.PIECE_BPE))
    rng = random.Random(1)
    opened = 0
    for _ in range(200):
        text = " " + any_text(rng).replace("▁", "") + "qzqz9é日" * 5
        places = pair.places(text, 4)
        at = lambda n: len(text[:n].encode())
        parts = [pair.fragment(text[a:c], at(a), text[b:d], at(b), i == 0)[0] for i, ((a, b), (c, d)) in enumerate(zip(places, places[1:]))]
        opened += sum(bool(p.head.a or p.head.b) for p in parts[1:])
        add = lambda x, y: x + y
        left = reduce(add, parts, tokalign.BEGINNING)
        right = tokalign.BEGINNING + reduce(lambda x, y: y + x, reversed(parts))
        middle = reduce(add, parts[:len(parts) // 2], tokalign.BEGINNING) + reduce(add, parts[len(parts) // 2:], tokalign.NOTHING)
        assert left == right == middle and left.tail == tokalign.EMPTY and left.last == len(text.encode())
    assert opened > 100


def test_edge_rows(spark):
    docs = documents(spark, "row", "keys", "place", "n_a", "begin")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert max(len(t or "") for _, t in rows) > tokalign.LONG
    assert result(tokalign.align(docs)) == plain(rows)
    assert result(tokalign.align(none(spark))) == []


def test_long_text_that_does_not_come_back_has_no_tokens(spark):
    rows = [(1, LONG + "▁ end"), (2, LONG), (3, "x" + " y" * 50_000)]
    assert result(tokalign.align(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_other_vocabulary_goes_the_slow_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokalign.ByteBpe, "_fast", lambda *_: None)
    rows = list(enumerate(ODD))
    assert result(tokalign.align(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert result(queries.QUERIES["op13_token_alignment"](spark, sf_dir)) == plain(rows)
