"""The model's own dialogue against a plain loop, and how often the model is asked."""

import glob
import hashlib
import os
import random
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tellerflow.functions import prompts
from tellerflow.operators.model_answers import Answers, answer_dialogues, answer_with_model
from tellerflow.sources import catalogue, files

# the workers can't import the tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(text):
    """Deterministic stub: labels, failures and replies that depend on the whole prompt."""
    digest = hashlib.md5(text.encode()).hexdigest()
    if text.startswith("Choose"):
        return {"0": "?", "1": None, "2": " 'balance_inquiry'"}.get(digest[0], f"{catalogue.INTENT_TAGS[int(digest[1], 16) % len(catalogue.INTENT_TAGS)]}\n")
    return None if digest[0] == "0" else f"  {digest[:5]} [AMOUNT] [TRANSACTIONS] "


def plain(rows):
    """The loop of one dialogue after the other."""
    templates = {t: r for t, _, r in catalogue.DEFAULT_INTENTS}
    out, dialogues = {}, {}
    for event, user, _, message, balance, transactions in sorted(rows, key=lambda r: (r[2], r[0])):
        history = dialogues.setdefault(user, [])
        raw = None if message is None else answer(prompts.CLASSIFY.format(tags=", ".join(catalogue.INTENT_TAGS), message=message))
        label = raw and raw.strip().replace("'", "").replace('"', "")
        intent, confidence = ("error", 0.0) if raw is None else (label, 0.9) if label in catalogue.INTENT_TAGS else ("greeting", 0.5)
        known = templates.get(intent)
        context = "\n".join(f"User: {u}\nBot: {b}" for u, b, _ in history[-3:])
        if not known:
            reply = catalogue.REPLIES["unknown_tag"]
        else:
            shown = "\n".join(f"- {t}" for t in known)
            raw = None if message is None else answer(prompts.REPLY.format(intent=intent, context=context, message=message, templates=shown))
            reply = known[event % len(known)] if raw is None else raw.strip()
            if raw is not None and intent == "balance_inquiry" and balance is not None:
                reply = reply.replace("[AMOUNT]", balance)
            if raw is not None and intent == "transaction_history" and transactions is not None:
                reply = reply.replace("[TRANSACTIONS]", transactions)
        history = dialogues[user] = [*history, (message or "", reply, intent)][-5:]
        out[event] = (user, intent, confidence, reply, history)
    return out


def sample(spark):
    rng = random.Random(6)
    rows = []
    for event in range(300):
        user = rng.choice([None, 1, 1, 1, 2, 3, rng.randint(4, 60)])
        message = rng.choice([None, "", "hello", "my balance", "history please", f"message {rng.randint(0, 40)}"])
        rows.append((event, user, f"2024-01-{1 + rng.randint(0, 27):02d}", message, rng.choice([None, "12.50"]), rng.choice([None, "T1; T2"])))
    frame = spark.createDataFrame(rows, "event_id long, user_id long, ts string, message string, balance string, transactions string")
    return rows, frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def model(texts):
    return [answer(t) for t in texts]


@pytest.mark.parametrize("rounds", [1, 3, 1000])
def test_replies_feed_the_next_prompt(spark, rounds):
    rows, messages = sample(spark)
    if rounds == 1000:
        # dialogues of few turns only: a round is a job
        rows = [r for r in rows if r[1] is not None and r[1] > 3]
        messages = messages.filter("user_id > 3")
    found = answer_dialogues(messages, files.intent_responses(files.default_intents(spark)), model, rounds=rounds).collect()
    got = {r.event_id: (r.user_id, r.intent, r.confidence, r.response, [tuple(x) for x in r.history]) for r in found}
    assert len(found) == len(rows) and got == plain(rows)


def test_no_messages(spark):
    _, messages = sample(spark)
    assert answer_dialogues(messages.limit(0), files.intent_responses(files.default_intents(spark)), model).count() == 0


def counted(folder, fail=None):
    """A model that notes every prompt it is asked; ``fail`` ends the task."""

    def asked(texts):
        for text in texts:
            if fail and fail in text:
                raise SystemExit("lost")
            with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as file:
                file.write(text)
        return [answer(t) for t in texts]

    return asked


def notes(folder):
    out = []
    for path in glob.glob(f"{folder}/*"):
        with open(path, encoding="utf-8") as file:
            out.append(file.read())
    return out


def test_each_distinct_prompt_is_asked_once(spark, tmp_path):
    rows = [(i, f"message {i % 7}", "", None, None) for i in range(500)]
    messages = spark.createDataFrame(rows, "event_id long, message string, context string, balance string, transactions string").repartition(5)
    responses = files.intent_responses(files.default_intents(spark))
    os.mkdir(f"{tmp_path}/calls")
    answers = Answers(spark, f"{tmp_path}/answers", counted(f"{tmp_path}/calls"))
    first = {tuple(r) for r in answer_with_model(messages, responses, answers).collect()}
    calls = notes(f"{tmp_path}/calls")
    failed = [t for t in set(calls) if answer(t) is None]
    assert len(first) == 500 and len(set(calls)) <= 14
    # the same prompts again: only those that the model failed on are asked
    assert {tuple(r) for r in answer_with_model(messages, responses, answers).collect()} == first
    assert sorted(notes(f"{tmp_path}/calls")) == sorted(calls + failed)
    assert len(calls) == len(set(calls))


def test_a_failed_call_goes_on_where_it_stopped(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"prompt {i}") for i in range(200)], "id int, prompt string")
    os.mkdir(f"{tmp_path}/calls")
    answers = Answers(spark, f"{tmp_path}/answers", counted(f"{tmp_path}/calls", fail="prompt 77"), wave=20)
    with pytest.raises(Exception):
        answers.ask(frame, F.col("prompt")).collect()
    kept = answers.read().count()
    assert 0 < kept < 200
    os.mkdir(f"{tmp_path}/more")
    answers.model = counted(f"{tmp_path}/more")
    raws = answers.ask(frame, F.col("prompt")).collect()
    assert {r.id: r.raw for r in raws} == {i: answer(f"prompt {i}") for i in range(200)}
    assert len(notes(f"{tmp_path}/more")) == 200 - kept


def test_rows_that_share_a_prompt_stay_apart(spark, monkeypatch):
    """A prompt that half of all rows share, and rows without one, don't meet in one task; nothing is shuffled by intent."""
    from tellerflow.operators import model_answers

    monkeypatch.setattr(model_answers, "OFTEN", 50, raising=False)
    n = 8000
    messages = spark.range(0, n, 1, 8).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 4 < 2, "the same words").when(F.col("id") % 4 == 2, F.concat(F.lit("words "), "id")).alias("message"),
        F.lit("").alias("context"), F.lit(None).cast("string").alias("balance"), F.lit(None).cast("string").alias("transactions"))

    def model(texts):
        return ["greeting" if text.startswith("Choose") else f"to {text.split('Message: ')[1].split(chr(10))[0]}" for text in texts]

    told = answer_with_model(messages, files.intent_responses(files.default_intents(spark)), model)
    assert "hashpartitioning(intent" not in told._jdf.queryExecution().executedPlan().toString()
    rows = told.select("event_id", "intent", "response", F.spark_partition_id().alias("part")).collect()
    assert {r.event_id for r in rows} == set(range(n)) and len(rows) == n
    for r in rows:
        said = [None, "the same words", f"words {r.event_id}"][(1, 1, 2, 0)[r.event_id % 4]]
        assert (r.intent, r.response) == (("error", catalogue.REPLIES["unknown_tag"]) if said is None else ("greeting", f"to {said}"))
    size = {}
    for r in rows:
        if r.event_id % 4 != 2:
            size[r.part] = size.get(r.part, 0) + 1
    assert max(size.values()) < n // 4, size
