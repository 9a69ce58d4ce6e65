"""From messages to answered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tellerflow.functions import render
from tellerflow.functions.intents import with_base_intent
from tellerflow.operators import dialogue, ledger as lookups
from tellerflow.operators.timeline import HOT_ROWS
from tellerflow.sources.files import store


def requests(understood: DataFrame) -> DataFrame:
    """The distinct facts users ask about, known from the message alone: a message
    that answers a pending question needs none.

    The outer explode keeps the test for "asks something" above the extraction:
    as a plain filter it would be pushed below it and repeat every regex.
    """
    e = F.col("entities")
    kind, _ = lookups.lookup_request(F.col("base_intent"), e)
    start, end = lookups.requested_range(e)
    asked = F.struct(
        kind.alias("kind"),
        F.when(kind == "range", start).alias("start"),
        F.when(kind == "range", end).alias("end"),
        F.when(kind == "id", e["transaction_id"]).alias("transaction_id"),
    )
    found = understood.select("user_id", F.explode_outer(F.when(kind.isNotNull(), F.array(asked))).alias("asked"))
    return found.filter(F.col("asked").isNotNull()).select("user_id", "asked.*").distinct()


def with_response(scored: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the reply to each scored message.

    Only messages that need a fact go to the join. ``scored`` is read twice: pass
    a stored or cached frame.
    """
    kind, arg = lookups.lookup_request(F.col("intent"), F.col("entities"))
    asked = scored.withColumns({"kind": kind, "arg": arg, "account_type": F.col("active_account")})
    found = asked.filter(F.col("kind").isNotNull()).join(facts, lookups.LOOKUP, "left").select(*asked.columns, "fact")
    rest = asked.filter(F.col("kind").isNull()).withColumn("fact", F.lit(None).cast("string"))
    text = render.response(
        F.col("intent"),
        F.col("entities"),
        F.col("event_id"),
        F.col("active_account"),
        F.col("account_before"),
        F.col("fact"),
        F.col("pending_amount"),
        F.col("pending_recipient"),
    )
    return found.unionByName(rest).withColumn("response", text).drop("kind", "arg", "account_type", "fact")


def failed(messages: DataFrame, name: str = "error") -> DataFrame:
    """Messages without text, which fail: they get the error reply and leave no
    trace in the dialogue. ``name`` may be ``request_failed``, the reply of the
    application around the dialogue."""
    return messages.filter(F.col("message").isNull()).withColumns(
        {"intent": F.lit("error"), "confidence": F.lit(0.0), "response": render.reply(name)}
    )


def answer(messages: DataFrame, accounts: DataFrame, ledger: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Messages (event_id, user_id, ts, message) with intent, confidence, state and reply.

    Extraction runs once, the dialogue once; both results are stored.
    """
    spoken = messages.filter(F.col("message").isNotNull())
    understood = store(with_base_intent(spoken).drop("text"), "understood")
    facts = lookups.facts(accounts, ledger, requests(understood))
    scored = store(dialogue.score(understood, hot_rows), "scored")
    return with_response(scored, facts).unionByName(failed(messages), allowMissingColumns=True)
