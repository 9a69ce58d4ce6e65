"""Dialogue tracking per user: intents in context, state, memory, history.

A message that answers a pending question (a *follow-up*) always leaves the
dialogue in a state with no question pending; any other message sets a state
that depends on that message alone. So a follow-up candidate is a message whose
predecessor's own state asks a question it answers, and in a run of consecutive
candidates the odd ones take effect. That needs look-backs only, no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tellerflow.functions.entities import MONEY
from tellerflow.functions.intents import follow_up, with_base_intent
from tellerflow.operators.timeline import HOT_ROWS, Latest, Position, Previous, Trailing, along_timeline
from tellerflow.sources import catalogue

ENTITY_FIELDS = ["account_type", "transaction_id", "date", "date_range", "amount", "recipient"]


def _understood(messages: DataFrame) -> DataFrame:
    """Messages with entities and base intent; already-understood rows pass."""
    return messages if "base_state" in messages.columns else with_base_intent(messages)


def _score(frame):
    """Effective intent, state and active account on a frame of understood rows."""
    e = F.col("entities")
    asked = F.when(F.col("base_intent") == "transfer_money", F.struct(e["amount"], e["recipient"]))
    frame = frame.derive(
        asked_state=Previous(F.col("base_state")),
        asked=Previous(asked),
        account_before=Latest(e["account_type"], inclusive=False),
        place=Position(),
    )
    rows = frame.rows.withColumns(
        {
            "answer": follow_up(F.col("asked_state"), F.col("answers")),
            "account_before": F.coalesce("account_before", F.lit(catalogue.DEFAULT_ACCOUNT)),
        }
    )
    frame = frame.with_rows(rows).derive(last_plain=Latest(F.when(F.col("answer").isNull(), F.col("place"))))
    answered = (F.col("place") - F.coalesce("last_plain", F.lit(0))) % 2 == 1
    intent = F.when(answered, F.col("answer"))
    rows = frame.rows.withColumns(
        {
            "intent": F.coalesce(intent, "base_intent"),
            "confidence": F.when(answered, F.lit(0.9)).otherwise(F.col("base_confidence")),
            "state": F.when(~answered, F.col("base_state"))
            .when(F.col("answer") == "confirmation_yes", "transfer_completed")
            .otherwise("initial"),
            "active_account": F.coalesce(e["account_type"], "account_before"),
            # the pending transfer as the reply to this message sees it
            "pending_amount": F.when(answered, F.col("asked.amount")),
            "pending_recipient": F.when(answered, F.col("asked.recipient")),
        }
    )
    return frame.with_rows(rows.drop("asked_state", "asked", "answer", "answers", "place", "last_plain"))


def score(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each message with its intent, confidence, state and active account.

    One exchange on the user for all look-backs; extraction runs before it.
    """
    return along_timeline(messages, lambda f: _score(f).rows, hot_rows=hot_rows, prepare=_understood)


def pending_change(intent: Column, entities: Column, account: Column, recipient: Column) -> Column:
    """What a message does to the pending transfer: a new value, a cleared one, or null for no change."""
    has_amount, has_recipient = entities["amount"].isNotNull(), entities["recipient"].isNotNull()

    def pending(kind, amount, to, source):
        return F.struct(
            kind.cast("string").alias("type"),
            amount.cast(MONEY).alias("amount"),
            to.cast("string").alias("recipient"),
            source.cast("string").alias("from_account"),
        )

    nothing = F.lit(None)
    return (
        F.when(
            (intent == "transfer_money") & (has_amount | has_recipient),
            pending(
                F.lit("transfer"),
                entities["amount"],
                entities["recipient"],
                F.when(has_amount & has_recipient, account),
            ),
        )
        .when(
            (intent == "amount_specification") & has_amount,
            pending(F.lit("transfer"), entities["amount"], recipient, nothing),
        )
        .when(intent == "confirmation_no", pending(nothing, nothing, nothing, nothing))
    )


def _track_pending(frame):
    change = pending_change(F.col("intent"), F.col("entities"), F.col("active_account"), F.col("pending_recipient"))
    if "seed" in frame.rows.columns:
        change = F.when(F.col("seed").isNotNull(), F.col("seed.pending")).otherwise(change)
    return frame.derive(pending=Latest(change))


def _track_memory(frame):
    def mentioned(field: str) -> Column:
        value = F.col("entities")[field]
        if "seed" in frame.rows.columns:
            value = F.when(F.col("seed").isNotNull(), F.col("seed.memory")[field]).otherwise(value)
        return value

    return frame.derive(**{f"memory_{f}": Latest(mentioned(f)) for f in ENTITY_FIELDS})


def pending_actions(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The pending transfer after each message."""
    steps = lambda frame: _track_pending(_score(frame)).rows
    return along_timeline(messages, steps, hot_rows=hot_rows, prepare=_understood)


def entity_memory(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per entity the last value the user mentioned so far."""
    return along_timeline(messages, lambda f: _track_memory(f).rows, hot_rows=hot_rows, prepare=_understood)


def track(messages: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Everything a dialogue carries: score, pending transfer and entity memory.

    Rows may include one ``seed`` row per user (see ``streaming``): where the
    user's dialogue stood before these messages.
    """
    steps = lambda frame: _track_memory(_track_pending(_score(frame))).rows
    return along_timeline(messages, steps, hot_rows=hot_rows, prepare=_understood)


def exchange() -> Column:
    return F.struct(
        F.col("message").alias("user"), F.col("response").alias("bot"), F.col("intent"), F.col("entities")
    )


def history(
    answered: DataFrame, n: int = 10, hot_rows: int = HOT_ROWS, messages: DataFrame | None = None
) -> DataFrame:
    """The last ``n`` exchanges up to and including each message, oldest first.

    ``messages``, the messages the answers are for, spares counting the answers.
    """
    steps = lambda frame: frame.derive(history=Trailing(exchange(), n)).rows
    return along_timeline(answered, steps, hot_rows=hot_rows, counted=messages)


def prompt_context(
    answered: DataFrame, n: int = 3, hot_rows: int = HOT_ROWS, messages: DataFrame | None = None
) -> DataFrame:
    """The last ``n`` exchanges before each message, as prompt text."""
    spoken = F.concat(F.lit("User: "), "message", F.lit("\nBot: "), "response")
    rows = along_timeline(
        answered,
        lambda f: f.derive(context=Trailing(spoken, n, inclusive=False)).rows,
        hot_rows=hot_rows,
        counted=messages,
    )
    return rows.withColumn("context", F.array_join("context", "\n"))
