"""Intent rules that need only the message itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tellerflow.functions.entities import contains_any, with_entities
from tellerflow.sources import catalogue


# Intent and confidence by rule number; the last is the default.
RULES = [
    ("specific_transaction", 0.9),
    ("date_transactions", 0.9),
    ("account_balance", 0.9),
    ("account_transactions", 0.9),
    ("greeting", 0.9),
    ("balance_inquiry", 0.8),
    ("transfer_money", 0.8),
    ("transaction_history", 0.8),
    ("greeting", 0.5),
]


def base_rule(text: Column, entities: Column) -> Column:
    """Number of the first rule that holds, without dialogue state."""
    dated = entities["date"].isNotNull() | entities["date_range"].isNotNull()
    names_account = text.contains("account") & entities["account_type"].isNotNull()
    tests = [
        text.contains("transaction") & contains_any(text, catalogue.ID_WORDS),
        dated & contains_any(text, ["transactions", "spending"]),
        names_account & text.contains("balance"),
        names_account & text.contains("transactions"),
        contains_any(text, catalogue.GREETING_WORDS),
        contains_any(text, catalogue.BALANCE_WORDS),
        contains_any(text, catalogue.TRANSFER_WORDS),
        contains_any(text, catalogue.HISTORY_WORDS),
    ]
    chain = F
    for number, test in enumerate(tests):
        chain = chain.when(test, number)
    return chain.otherwise(len(tests))


def rule_intent(rule: Column) -> Column:
    return F.get(F.array(*[F.lit(intent) for intent, _ in RULES]), rule)


def rule_confidence(rule: Column) -> Column:
    return F.get(F.array(*[F.lit(confidence) for _, confidence in RULES]), rule)


def base_state(intent: Column, entities: Column) -> Column:
    """Dialogue state after a message whose base intent takes effect."""
    has_amount, has_recipient = entities["amount"].isNotNull(), entities["recipient"].isNotNull()
    return F.when(
        intent == "transfer_money",
        F.when(has_amount & has_recipient, "awaiting_confirmation")
        .when(has_amount, "awaiting_recipient")
        .when(has_recipient, "awaiting_amount")
        .otherwise("awaiting_details"),
    ).otherwise("initial")


def answers(text: Column, entities: Column) -> Column:
    """Which pending questions a message would answer.

    The word lists are searched by a higher-order function on purpose: it ends
    the whole-stage code of the extraction before this projection. Fused, the two
    make one method too long for the JIT compiler.
    """

    def says(words: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))

    return F.struct(
        entities["account_type"].isNotNull().alias("account"),
        (entities["amount"].isNotNull() | contains_any(text, catalogue.AMOUNT_WORDS)).alias("amount"),
        F.when(says(catalogue.YES_WORDS), "confirmation_yes")
        .when(says(catalogue.NO_WORDS), "confirmation_no")
        .alias("confirmation"),
    )


def follow_up(state: Column, answer: Column) -> Column:
    """Intent of a message that answers the question pending in ``state``, else null."""
    return (
        F.when((state == "awaiting_account") & answer["account"], "account_selection")
        .when((state == "awaiting_amount") & answer["amount"], "amount_specification")
        .when(state == "awaiting_confirmation", answer["confirmation"])
    )


def with_base_intent(messages: DataFrame) -> DataFrame:
    """Add entities, base intent, its confidence and the state it leads to.

    The steps are separate projections, so a later step refers to the result of
    an earlier one. All of it is computed where the message is read; whatever a
    query does not use afterwards, the message text included, is not shuffled.
    """
    text, entities = F.col("text"), F.col("entities")
    return (
        with_entities(messages)
        .withColumns({"rule": base_rule(text, entities), "answers": answers(text, entities)})
        .withColumns(
            {"base_intent": rule_intent(F.col("rule")), "base_confidence": rule_confidence(F.col("rule"))}
        )
        .withColumn("base_state", base_state(F.col("base_intent"), entities))
        .drop("rule", "text")
    )
