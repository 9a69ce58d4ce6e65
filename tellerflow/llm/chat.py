"""Chat formatting with a grammar that is proved by parsing every rendered turn again.

A conversation is the concatenation of its turns:

    conversation := turn*
    turn         := "[INST] " role "\\n" text "\\n</s>\\n"

A control string (:data:`CONTROL`) is live unless a backslash precedes it, and no text may hold a
live one. A text that the parser would refuse or not give back as it went in is escaped by one
more backslash before every control string. :class:`Parser` is deterministic and reads a conversation in pieces of any size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

OPEN, CLOSE = "[INST] ", "\n</s>\n"
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
GUARDED = re.compile(rf"(\\*)({CONTROL})")
ESCAPED = re.compile(rf"\\(\\*(?:{CONTROL}))")
#: The first live control string after a turn's head must be its end.
LIVE = re.compile(rf"(?<!\\)(?:{CONTROL})")
RENDERED = "struct<rendered:string,start:int,end:int,escaped:boolean>"


def escape(text: str) -> str:
    return GUARDED.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


#: Characters of a role that could end its line or make a control string.
ROLE_CODES = {"\\": "\\\\", "\n": "\\n", "<": "\\l", "[": "\\b"}
ROLE_CHARS = {code: char for char, code in ROLE_CODES.items()}


def _name(role: str) -> str:
    return "".join(ROLE_CODES.get(c, c) for c in role)


def _role(name: str) -> str:
    return re.sub(r"\\.", lambda m: ROLE_CHARS[m[0]], name)


class Parser:
    """Turns from pieces of rendered text; :meth:`feed` yields ``(role, text, start, end)``.

    Start and end are the place of the text in the conversation, in code points.
    """

    def __init__(self) -> None:
        self.held, self.offset = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, int, int]]:
        self.held += piece
        while True:
            if not self.held.startswith(OPEN):
                if OPEN.startswith(self.held[:len(OPEN)]):
                    return
                raise ValueError("a turn must start with its mark")
            line = self.held.find("\n", len(OPEN))
            end = LIVE.search(self.held, line + 1) if line >= 0 else None
            if not end or len(self.held) < end.end() + 1:
                return
            body = self.held[line + 1:end.start()]
            if end[0] != "</s>" or not body.endswith("\n") or self.held[end.end()] != "\n":
                raise ValueError("a turn must end with its mark on a line")
            yield _role(self.held[len(OPEN):line]), unescape(body[:-1]), self.offset + line + 1, self.offset + end.start() - 1
            self.offset += end.end() + 1
            self.held = self.held[end.end() + 1:]

    def finish(self) -> None:
        if self.held:
            raise ValueError("text after the last turn")


def _reads_back(rendered: str, role: str, text: str) -> bool:
    parser = Parser()
    try:
        turns = [(r, t) for r, t, _, _ in parser.feed(rendered)]
        parser.finish()
    except ValueError:
        return False
    return turns == [(role, text)]


def render(role: str, text: str) -> tuple[str, int, int, bool]:
    """One turn, the place of its text, and whether the text had to be escaped.

    The text goes in as it is and is escaped if the parser doesn't give it back.
    """
    head = f"{OPEN}{_name(role)}\n"
    for escaped, body in enumerate((text, escape(text))):
        if _reads_back(head + body + CLOSE, role, text):
            return head + body + CLOSE, len(head), len(head) + len(body), bool(escaped)
    raise AssertionError("an escaped turn always reads back")


def format_turns(turns: DataFrame) -> DataFrame:
    """The rows of ``turns(conv_id, turn, role, text, ...)`` with their rendered form.

    Adds a column ``turn_text``: struct(rendered, start, end, escaped). A conversation is the
    concatenation of ``rendered`` by turn; start and end frame the escaped text in it. Null
    text and null role count as empty. No row needs another, so nothing is shuffled.
    """

    def apply(roles: pa.Array, bodies: pa.Array) -> pa.Array:
        rows = []
        for role, text in zip(roles.to_pylist(), bodies.to_pylist()):
            rendered, start, end, escaped = render(role or "", text or "")
            rows.append({"rendered": rendered, "start": start, "end": end, "escaped": escaped})
        return pa.array(rows, pa.struct([("rendered", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("escaped", pa.bool_())]))

    return turns.withColumn(fresh(turns, "turn_text"), F.arrow_udf(apply, RENDERED)(F.col("role"), F.col("text")))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rows: DataFrame, role: str = "assistant") -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, rendered)``, read from the rendered text alone.

    The turns of a conversation stream through one parser in order (turn, then role, then text;
    null turns first), so a conversation of any length needs the memory of one turn. The digest
    over all turns is sequential by its definition: one conversation is one task's stream. Rows
    without a conv_id form a conversation of their own; repeated rows are turns of their own, and of rows
    that tie in turn, role and text any order gives the same. An empty table gives no row; extra columns,
    whatever their names, are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        done: list[dict] = []

        def close() -> None:
            conv, parser, turns, loss, state = current
            parser.finish()
            done.append({"conv_id": conv, "n_turns": state[0], "turns_sha256": turns.hexdigest(), "loss_chars": state[1],
                         "loss_sha256": loss.hexdigest(), "formatted_chars": state[2]})

        for batch in batches:
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current = (conv, Parser(), hashlib.sha256(), hashlib.sha256(), [0, 0, 0])
                _, parser, turns, loss, state = current
                text = piece.as_py()
                state[2] += len(text)
                for who, said, _, _ in parser.feed(text):
                    turns.update(f"{who}\n{said}\n".encode())
                    state[0] += 1
                    if who == role:
                        loss.update(said.encode())
                        state[1] += len(said)
            if done:
                yield pa.RecordBatch.from_pylist(done, SCHEMA)
                done = []
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, SCHEMA)

    # repeated rows are alike in every sorted column, so their order doesn't matter
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "rendered").mapInArrow(digest, DIGEST)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
