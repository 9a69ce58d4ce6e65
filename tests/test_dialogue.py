"""Dialogue tracking on random conversations against a turn-by-turn replay."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tellerflow.operators import dialogue
from tellerflow.operators import timeline as dialogue_timeline
from tellerflow.operators.timeline import Latest, Position, Previous, Trailing, along_timeline
from pyspark.sql import functions as F

# message, intent on its own, amount, recipient, account
TURNS = [
    ("pay $5 to ann account ok", "transfer_money", 5, "ann", None),
    ("pay $6 to bob account", "transfer_money", 6, "bob", None),
    ("pay to eve account", "transfer_money", None, "eve", None),
    ("pay 7 dollars", "transfer_money", 7, None, None),
    ("pay", "transfer_money", None, None, None),
    ("yes", "greeting", None, None, None),
    ("cancel", "greeting", None, None, None),
    ("some dollars", "greeting", None, None, None),
    ("9 dollars", "greeting", 9, None, None),
    ("savings", "greeting", None, None, "savings"),
    ("checking balance", "balance_inquiry", None, None, "checking"),
]


def replay(turns):
    """(intent, state, active account, pending) after each turn of one user."""
    state, account, pending, out = "initial", "checking", None, []
    for text, own, amount, to, named in turns:
        intent = own
        if state == "awaiting_amount" and (amount or "dollars" in text or "$" in text):
            intent = "amount_specification"
            if amount:
                pending = {**pending, "amount": amount}
        if state == "awaiting_confirmation":
            if any(w in text for w in ("yes", "ok")):
                intent = "confirmation_yes"
            elif any(w in text for w in ("no", "cancel")):
                intent, pending = "confirmation_no", {}
        account = named or account
        state = {"confirmation_yes": "transfer_completed"}.get(intent, "initial")
        if intent == "transfer_money":
            state = ["awaiting_details", "awaiting_amount", "awaiting_recipient", "awaiting_confirmation"][
                bool(to) + 2 * bool(amount)
            ]
            if to or amount:
                pending = {"amount": amount, "recipient": to, "from_account": account if to and amount else None}
        p = pending or {}
        kept = p.get("amount") and Decimal(p["amount"]).quantize(Decimal("0.01"))
        out.append((intent, state, account, kept, p.get("recipient"), p.get("from_account")))
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    rows, expected = [], {}
    for user in range(60):
        turns = rng.choices(TURNS, weights=[4, 4, 4, 1, 1, 3, 2, 2, 2, 1, 1], k=rng.randint(1, 120))
        for (text, *_), result in zip(turns, replay(turns)):
            # several messages share a timestamp; the id breaks the tie
            rows.append((len(rows), user, start + dt.timedelta(seconds=len(rows) // 3), text))
            expected[len(rows) - 1] = result
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "event_id long, user_id long, ts timestamp_ntz, message string")
    return df.repartition(5), expected


@pytest.mark.parametrize("hot_rows", [10**6, 40, 0])
def test_replay(conversations, hot_rows):
    """Plain windows, some users sliced, all users sliced: the same dialogue."""
    df, expected = conversations
    rows = dialogue.pending_actions(df, hot_rows=hot_rows).collect()
    got = {
        r.event_id: (r.intent, r.state, r.active_account, *(
            (r.pending.amount, r.pending.recipient, r.pending.from_account) if r.pending else (None, None, None)))
        for r in rows
    }
    assert len(rows) == len(expected)
    assert got == expected


@pytest.mark.parametrize("hot_rows", [40, 0])
def test_sliced_look_backs_equal_plain_ones(conversations, hot_rows):
    df, _ = conversations

    def steps(frame):
        value = F.when(F.length("message") % 3 != 0, F.col("message"))
        return frame.derive(
            before=Previous(value), known=Latest(value), known_before=Latest(value, inclusive=False), place=Position(),
            last4=Trailing(F.col("message"), 4), last3=Trailing(F.col("message"), 3, inclusive=False),
        ).rows

    plain = {r.event_id: r for r in along_timeline(df, steps).collect()}
    sliced = {r.event_id: r for r in along_timeline(df, steps, hot_rows=hot_rows).collect()}
    assert plain == sliced


def test_entity_memory_and_history(conversations):
    df, expected = conversations
    rows = dialogue.entity_memory(df).filter("user_id = 3").orderBy("ts", "event_id").collect()
    seen = None
    for r in rows:
        seen = r.entities.recipient or seen
        assert r.memory_recipient == seen
    answered = dialogue.score(df).withColumn("response", F.concat(F.lit("re "), "message"))
    rows = dialogue.history(answered, 10).filter("user_id = 3").orderBy("ts", "event_id").collect()
    for i, r in enumerate(rows):
        assert [h.user for h in r.history] == [x.message for x in rows[max(0, i - 9): i + 1]]
    rows = dialogue.prompt_context(answered).filter("user_id = 3").orderBy("ts", "event_id").collect()
    for i, r in enumerate(rows):
        assert r.context == "\n".join(f"User: {x.message}\nBot: {x.response}" for x in rows[max(0, i - 3): i])


def test_sliced_path_runs_its_input_once_and_moves_rows_once_a_step(spark, conversations, monkeypatch):
    """Exchanges of message rows, forced broadcasts, carried values and reads of the input on the sliced path."""
    import re

    from pyspark.sql.classic.dataframe import DataFrame

    df, _ = conversations
    answered = dialogue.score(df).withColumn("response", F.concat(F.lit("re "), "message"))
    reads = spark.sparkContext.accumulator(0)

    def seen(text):
        reads.add(1)
        return text

    counted = answered.withColumn("message", F.udf(seen, "string")("message"))
    plans, derived = [], []
    checkpoint, derive = DataFrame.checkpoint, dialogue_timeline.SliceFrame.derive

    def watched(self, *args):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return checkpoint(self, *args)

    def counted_derive(self, **specs):
        derived.append(specs)
        return derive(self, **specs)

    monkeypatch.setattr(DataFrame, "checkpoint", watched)
    monkeypatch.setattr(dialogue_timeline.SliceFrame, "derive", counted_derive)
    rows = dialogue.history(counted, 10, hot_rows=0, messages=df)
    plain = {r.event_id: r.history for r in dialogue.history(answered, 10).collect()}
    assert {r.event_id: r.history for r in rows.collect()} == plain
    assert reads.value == len(plain)
    assert all(len(h) <= 10 for h in plain.values())

    plans.clear(), derived.clear()
    final = dialogue.track(df, hot_rows=0)

    def moved(text):
        """Exchanges of message rows; those of a slice's summary stand above its aggregate."""
        lines = text.splitlines()
        on_slices = [k for k, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(user_id#\d+L?, timeline_slice", line)]
        return sum("Aggregate(" not in lines[k + 1] for k in on_slices)

    assert max(map(moved, plans)) == 1 and sum(map(moved, plans)) <= len(derived)
    for text in (*plans, final._jdf.queryExecution().toString()):
        assert "ResolvedHint" not in text and "strategy=broadcast" not in text
