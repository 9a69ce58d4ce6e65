"""Entities, intents and replies of single messages."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tellerflow.functions import prompts, render
from tellerflow.functions.entities import with_entities
from tellerflow.functions.intents import with_base_intent
from tellerflow.operators.model_answers import answer_with_model
from tellerflow.sources import files

NOW = dt.datetime(2024, 3, 13, 9, 30)  # a Wednesday


def frame(spark, messages, ts=NOW):
    rows = [(i, 1, ts, m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, message string")


def entities(spark, messages):
    rows = with_entities(frame(spark, messages)).orderBy("event_id").collect()
    return [r.entities.asDict(recursive=True) for r in rows]


@pytest.mark.parametrize(
    "message, field, value",
    [
        ("Savings or Checking", "account_type", "savings"),
        ("transaction #12345", "transaction_id", "T12345"),
        ("transaction T12345", "transaction_id", "T12345"),
        ("paid 12345", "transaction_id", "T12345"),
        ("id: 12345", "transaction_id", None),
        ("on 3/4/24", "date", "2024-03-04"),
        ("on 3/4/024", "date", "024-03-04"),
        ("112/05/2025", "date", "2025-12-05"),
        ("3/4/24 or 2025-13-45", "date", "2025-13-45"),
        ("2025-5-1", "date", "2025-5-1"),
        ("2025-5-1 or today", "date", "2024-03-13"),
        ("yesterday this week", "date", "2024-03-12"),
        ("yesterday this week", "date_range", None),
        ("this week", "date_range", {"start": "2024-03-11", "end": "2024-03-13"}),
        ("last week", "date_range", {"start": "2024-03-04", "end": "2024-03-10"}),
        ("this month", "date_range", {"start": "2024-03-01", "end": "2024-03-13"}),
        ("last month", "date_range", {"start": "2024-02-01", "end": "2024-02-29"}),
        ("$1234.5", "amount", Decimal("1234.00")),
        ("1234.5 dollars", "amount", Decimal("5.00")),
        ("$12,34", "amount", Decimal("12.00")),
        ("$5 and 7 dollars", "amount", Decimal("7.00")),
        ("$ 1,250.75", "amount", Decimal("1250.75")),
        ("to bob smith account", "recipient", "bob smith"),
        ("send money to another account", "recipient", "another"),
        ("want to transfer money to bob account", "recipient", "transfer money to bob"),
        ("to bob accounts and to ann account", "recipient", "bob accounts and to ann"),
        ("into x account", "recipient", "x"),
        ("to my2 account", "recipient", None),
    ],
)
def test_entity(spark, message, field, value):
    assert entities(spark, [message])[0][field] == value


def test_patterns_on_random_text(spark):
    rng = random.Random(3)
    pieces = ["transaction", "id", "#", "t", " ", "  ", "123456", "77", "/", "-", "2024", "$", ",", "500", ".", "25",
              "dollars", "to ", "bob", " account", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(3000)]

    def find(pattern, text):
        match = re.search(pattern, text)
        return match and match[1]

    def amount(text):
        found = find(r"(\d+(?:,\d{3})*(?:\.\d{2})?)\s*dollars", text) or find(r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", text)
        return found and Decimal(found.replace(",", "")).quantize(Decimal("0.01"))

    for text, got in zip(texts, entities(spark, texts)):
        number = find(r"(?:transaction|id|#)\s*([t#]?\d{5,})", text)
        assert got["transaction_id"] == (number and "T" + number.upper().lstrip("#T")), text
        expected = amount(text)
        assert got["amount"] == (expected if expected is None or expected < 10**16 else None), text
        name = find(r"to\s+([a-zA-Z]+(?:\s+[a-zA-Z]+)*)\s+account", text)
        assert got["recipient"] == name, text


@pytest.mark.parametrize(
    "message, intent, confidence",
    [
        ("Hello there", "greeting", 0.9),
        ("What's my account balance?", "balance_inquiry", 0.8),
        ("I want to transfer some money", "balance_inquiry", 0.8),
        ("Show me my recent transactions", "transaction_history", 0.8),
        ("Transaction history", "greeting", 0.9),
        ("Good evening", "greeting", 0.5),
        ("Transfer funds", "transfer_money", 0.8),
        ("Make a payment", "transfer_money", 0.8),
        ("Show my spending", "transaction_history", 0.8),
        ("transaction number", "specific_transaction", 0.9),
        ("spending today", "date_transactions", 0.9),
        ("checking account balance", "account_balance", 0.9),
        ("transactions of my savings account", "account_transactions", 0.9),
        ("my savings account please", "greeting", 0.5),
        ("", "greeting", 0.5),
    ],
)
def test_base_intent(spark, message, intent, confidence):
    row = with_base_intent(frame(spark, [message])).first()
    assert (row.base_intent, row.base_confidence) == (intent, confidence)


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expression.alias("out")).first().out


@pytest.mark.parametrize(
    "kind, amount, to, text",
    [
        ("transfer", 5, "ann", "I'll set up a transfer of $5.00 from your savings account to ann's account."
                               " Would you like to proceed?"),
        ("transfer", 5, None, "I'll help you transfer $5.00 from your savings account. Who would you like to send it to?"),
        ("transfer", None, "ann", "How much would you like to transfer to ann from your savings account?"),
        (None, None, None, "I've switched to your savings account. How can I help you with this account?"),
    ],
)
def test_account_selection_reply(spark, kind, amount, to, text):
    reply = render.account_selection_reply(
        F.lit("savings"), F.lit(kind).cast("string"), F.lit(amount).cast("decimal(18,2)"), F.lit(to).cast("string")
    )
    assert one(spark, reply, x=1) == text


def test_failed_message_gets_the_error_reply(spark):
    null = F.lit(None).cast("string")
    row = with_entities(frame(spark, ["x"])).select(
        render.response(F.lit("error"), F.col("entities"), F.lit(1), null, null, null, null, null).alias("out")
    ).first()
    assert row.out == "I'm sorry, I encountered an error. Please try again."


def test_labels(spark):
    df = spark.createDataFrame([(" 'greeting'\n",), ('"balance_inquiry"',), ("other",), (None,)], "raw string")
    rows = df.select(prompts.validate_label(F.col("raw")).alias("l")).collect()
    assert [(r.l.intent, r.l.confidence) for r in rows] == [
        ("greeting", 0.9), ("balance_inquiry", 0.9), ("greeting", 0.5), ("error", 0.0)
    ]


def test_model_hook_isolates_failures(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad prompt")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "two")], "id int, prompt string").coalesce(1)
    rows = {r.id: r.raw for r in prompts.apply_model(df, model).collect()}
    assert rows == {1: "ONE", 2: None, 3: "TWO"}


def test_speech_and_locale(spark):
    assert one(spark, render.speech_text(F.col("t")), t=" [a] hi [b\n] there [c]\t") == "hi [b\n] there"
    assert one(spark, render.locale(F.col("t")), t="hi") == "hi-IN"
    assert one(spark, render.locale(F.col("t")), t="xx") == "en-US"


def test_answers_of_a_model(spark):
    """A keyword stub as model: labels, filled replies, and both kinds of failure."""
    def model(texts):
        def one(text):
            if "boom" in text:
                raise ValueError
            if text.startswith("Choose"):
                return " 'balance_inquiry'\n" if "balance" in text.split("Message:")[1] else "nonsense"
            if "fail" in text:
                raise ValueError
            return " It is [AMOUNT]. "

        return [one(t) for t in texts]

    rows = [(0, "my balance", "12.50"), (1, "balance?", None), (2, "fail my balance", "1.00"), (3, "other", "2.00"),
            (4, "boom", "3.00")]
    messages = spark.createDataFrame(rows, "event_id long, message string, balance string").withColumns(
        {"context": F.lit("User: a\nBot: b"), "transactions": F.lit(None).cast("string")}
    )
    responses = files.intent_responses(files.default_intents(spark))
    found = {r.event_id: (r.intent, r.confidence, r.response)
             for r in answer_with_model(messages, responses, model).collect()}
    assert found == {
        0: ("balance_inquiry", 0.9, "It is 12.50."),
        1: ("balance_inquiry", 0.9, "It is [AMOUNT]."),
        2: ("balance_inquiry", 0.9, "Your current balance is [AMOUNT]."),
        3: ("greeting", 0.5, "It is [AMOUNT]."),
        4: ("error", 0.0, "I'm not sure how to respond to that. Could you please rephrase?"),
    }


def test_digits_of_any_script_and_wide_amounts(spark):
    found = entities(spark, ["$٣٣ and more", "on ٢٠٢٤-٠٥-٠١", "id ७७७७७", "pay $99999999999999999.00 to bob account", "１２.５０ dollars", "$" + "9" * 40])
    assert found[0]["amount"] == Decimal("33.00")
    assert found[1]["date"] == "٢٠٢٤-٠٥-٠١"
    assert found[2]["transaction_id"] == "T७७७७७"
    assert found[3]["amount"] == Decimal("99999999999999999.00") and found[3]["recipient"] == "bob"
    assert found[4]["amount"] == Decimal("12.50")
    assert found[5]["amount"] is None  # wider than a decimal goes


RECIPIENT = re.compile(r"to\s+([a-zA-Z]+(?:\s+[a-zA-Z]+)*)\s+account")


def test_recipients_are_those_of_the_plain_pattern(spark):
    rng = random.Random(4)
    pieces = ["to", "account", "a", "bob", " ", "  ", ", ", "1", "ann", "into", "accounts", "\n"]
    messages = [" ".join(rng.choices(pieces, k=rng.randint(2, 14))) for _ in range(600)]
    want = [(m := RECIPIENT.search(t)) and m[1] for t in messages]
    assert [e["recipient"] for e in entities(spark, messages)] == want


def test_a_long_message_takes_linear_time(spark):
    import time

    message = "my account " + "to a " * 8000  # no account follows
    small, large = frame(spark, ["my account to a"]), frame(spark, [message])
    with_entities(small).select("entities.recipient").collect()
    began = time.time()
    assert with_entities(large).select("entities.recipient").collect()[0][0] is None
    spent = time.time() - began
    began = time.time()
    with_entities(small).select("entities.recipient").collect()
    assert spent - (time.time() - began) < 0.5


def test_a_model_that_loses_answers_fails_its_batch(spark):
    def model(texts):
        return [t.upper() for t in texts][:1]

    asked = spark.createDataFrame([(i, f"m{i}") for i in range(5)], "id int, prompt string").coalesce(1)
    assert {r.raw for r in prompts.apply_model(asked, model).collect()} == {f"M{i}" for i in range(5)}
    assert {r.raw for r in prompts.apply_model(asked, lambda texts: []).collect()} == {None}


def test_replies_without_a_model_and_for_failed_requests(spark):
    from tellerflow.operators import answering
    from tellerflow.sources import catalogue

    messages = frame(spark, ["hi", None]).withColumn("context", F.lit("")).withColumn("balance", F.lit("1")).withColumn("transactions", F.lit("t"))
    rows = answer_with_model(messages, files.intent_responses(files.default_intents(spark)), None).collect()
    assert {(r.intent, r.confidence, r.response) for r in rows} == {("error", 0.0, catalogue.REPLIES["no_model"])}
    assert [r.response for r in answering.failed(messages, "request_failed").collect()] == [catalogue.REPLIES["request_failed"]]
