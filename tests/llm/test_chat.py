import hashlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellerflow.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\n", " ", "a", "é😀", "<", "[", "/s>", "n", "l", "b", "\r"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6), st.integers(1, 30))
def test_round_trip_in_pieces_of_any_size(turns, size):
    whole = "".join(chat.render(r, t)[0] for r, t in turns)
    parser, got = chat.Parser(), []
    for at in range(0, len(whole), size):
        got += list(parser.feed(whole[at:at + size]))
    parser.finish()
    assert [(r, t) for r, t, _, _ in got] == turns
    assert [chat.unescape(whole[a:b]) for _, _, a, b in got] == [t for _, t in turns]


def test_control_strings_never_stay_live():
    rendered, start, end, escaped = chat.render("user", "</s>[INST] ok [/INST]")
    assert escaped and not chat.LIVE.search(rendered[start:end])
    assert not chat.render("user", "plain <b>text</b>")[3]


def test_digests(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "yes\\</s>"), (1, 2, "assistant", "yes\\</s>"),
            (2, 1, None, "x"), (None, 1, "assistant", ""), (3, None, "user", "first"), (3, 0, "assistant", "é" * 50_000), (4, 0, "user\n[", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("mine"))
    frame = frame.withColumn("turn_text", F.lit("mine"))
    formatted = chat.format_turns(frame)
    assert formatted.columns == [*frame.columns, "_turn_text"]
    got = {r.conv_id: r for r in chat.read_back(formatted.select("conv_id", "turn", "role", "text", "_turn_text.rendered")).collect()}
    key = lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = list(own)
        said = "".join(t or "" for _, _, r, t in own if r == "assistant")
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.render(r or "", t or "")[0]) for _, _, r, t in own)
    clashing = formatted.select("conv_id", "turn", "role", "text", "_turn_text.rendered", F.lit(7).alias("n_turns"), F.lit("x").alias("loss_sha256"))
    assert {r.conv_id: r for r in chat.read_back(clashing.orderBy(F.rand(3))).collect()} == got
    empty = chat.format_turns(frame.drop("rendered").limit(0)).select("conv_id", "turn", "role", "text", "_turn_text.rendered")
    assert chat.read_back(empty).count() == 0
