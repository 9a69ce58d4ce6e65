"""Messages answered by a caller-supplied text model instead of the rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tellerflow.functions import prompts
from tellerflow.operators.timeline import HOT_ROWS, Position, along_timeline
from tellerflow.session import scratch_path
from tellerflow.sources import catalogue
from tellerflow.sources.files import is_missing, store

Model = Callable[[list[str]], list[str]]

# Exchanges a dialogue remembers, and how many of them a prompt shows.
REMEMBERED, SHOWN = 5, 3
# Prompts between two commits of the answers.
WAVE = 1_000_000
# Rows that share a prompt from which on its answer is brought to them; the others meet theirs by key.
OFTEN = 10_000
# Turns answered for all users at once; what a user says after these is answered in order, one by one.
ROUNDS = 64

EXCHANGES = "array<struct<user:string,bot:string,intent:string>>"


class Answers:
    """A model's answers in a table by the hash of their prompt: each distinct prompt is asked once.

    New prompts are asked in waves of about ``wave``, each one an append that is committed as a
    whole; after a failure the same call goes on with the waves that are missing. An answer that the
    model failed to give is not stored, so a later call asks again. One writer at a time.
    """

    KEY = "_prompt_key"

    def __init__(self, spark: SparkSession, folder: str, model: Model, wave: int = WAVE):
        self.spark, self.folder, self.model, self.wave = spark, folder, model, wave

    def read(self) -> DataFrame:
        """(key, raw) of all prompts answered so far."""
        schema = f"`{self.KEY}` string, raw string"
        try:
            return self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _answer(self, asked: DataFrame) -> None:
        new = store(asked.join(self.read(), self.KEY, "left_anti"), "new-prompts")
        waves = -(-new.count() // self.wave)
        for number in range(waves):
            part = new.filter(F.pmod(F.hash(self.KEY), F.lit(waves)) == number)
            given = prompts.apply_model(part, self.model).filter(F.col("raw").isNotNull())
            given.select(self.KEY, "raw").write.mode("append").parquet(self.folder)

    def ask(self, frame: DataFrame, prompt: Column, keep: list[str] | None = None) -> DataFrame:
        """``frame``, or its columns ``keep``, with ``raw``, the model's answer to ``prompt``; null where the prompt is null or the model failed.

        ``frame`` is read several times: pass a stored one. Prompts are counted map-side first, so one that
        most rows share travels once a task. Its answer travels to the rows, and rows without a prompt stay where they are: the
        shuffle to the answers holds no key that is in more than ``OFTEN`` rows.
        """
        columns = frame.columns if keep is None else keep
        keyed = frame.select(*columns, F.sha2(prompt, 256).alias(self.KEY))
        # by key and prompt, a hash table of the different ones; an aggregate of the prompt's text would sort all rows
        asked = frame.select(F.sha2(prompt, 256).alias(self.KEY), prompt.alias("prompt")).filter(F.col(self.KEY).isNotNull())
        asked = store(asked.groupBy(self.KEY, "prompt").agg(F.count("*").alias("n")), "prompts")
        self._answer(asked.select(self.KEY, "prompt"))
        given = self.read()
        often = asked.filter(F.col("n") > OFTEN).select(self.KEY, F.lit(True).alias("_often"))
        often = store(often.join(given, self.KEY, "left"), "often")  # few: Spark sees it by the size
        here = keyed.join(often, self.KEY, "left").filter(F.col(self.KEY).isNull() | F.col("_often"))
        rest = keyed.filter(F.col(self.KEY).isNotNull()).join(often, self.KEY, "left_anti").join(given, self.KEY, "left")
        return here.select(*columns, "raw").unionByName(rest.select(*columns, "raw"))


def _answers(spark: SparkSession, model: Model | Answers) -> Answers:
    return model if isinstance(model, Answers) else Answers(spark, scratch_path(spark, "answers"), model)


def _labelled(messages: DataFrame, answers: Answers) -> DataFrame:
    """Messages with the model's intent and confidence."""
    asked = answers.ask(messages, prompts.classification_prompt(F.col("message")))
    label = prompts.validate_label(F.col("raw"))
    return asked.withColumn("label", label).select(*messages.columns, "label.intent", "label.confidence")


def _replied(labelled: DataFrame, responses: DataFrame, answers: Answers) -> DataFrame:
    """Labelled messages with ``context``, ``balance`` and ``transactions``, and the model's ``response``.

    Where the model fails the reply is an unfilled template; a label without templates has a fixed reply.
    """
    templated = prompts.with_templates(labelled, responses)
    known = F.coalesce(F.size("templates"), F.lit(0)) > 0
    prompt = prompts.response_prompt(F.col("intent"), F.col("context"), F.col("message"), F.col("templates"))
    # templates are long and few: rows are moved without them
    replied = prompts.with_templates(answers.ask(templated, F.when(known, prompt), labelled.columns), responses)
    filled = prompts.fill_template(prompts.strip(F.col("raw")), F.col("intent"), F.col("balance"), F.col("transactions"))
    fallback = prompts.template_reply(F.col("templates"), F.col("event_id"))
    response = F.when(known, F.coalesce(filled, fallback)).otherwise(fallback)
    return replied.select(*labelled.columns, response.alias("response"))


def answer_with_model(messages: DataFrame, responses: DataFrame, model: Model | Answers | None) -> DataFrame:
    """Add intent, confidence and response to messages whose context is given.

    ``messages`` has event_id, message, context (see ``dialogue.prompt_context``)
    and, nullable, the facts ``balance`` and ``transactions`` as text;
    ``responses(tag, templates)`` is the intent catalogue. The model is called for
    the label and, where the label is known, for the reply, once for each different
    prompt. Where there is no model, every message gets the reply that says so.
    """
    if model is None:
        return messages.withColumns(
            {"intent": F.lit("error"), "confidence": F.lit(0.0), "response": F.lit(catalogue.REPLIES["no_model"])}
        )
    answers = _answers(messages.sparkSession, model)
    responses = store(responses, "templates")  # so that Spark knows its size: rows by intent would be a few huge groups
    labelled = store(_labelled(store(messages, "asked"), answers), "labelled")
    return _replied(labelled, responses, answers)


# --- The model's own dialogue -------------------------------------------------


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def _context(history: Column) -> Column:
    spoken = F.transform(_last(history, SHOWN), lambda x: F.concat(F.lit("User: "), x["user"], F.lit("\nBot: "), x["bot"]))
    return F.array_join(spoken, "\n")


def _said() -> Column:
    return F.struct(
        F.coalesce("message", F.lit("")).alias("user"), F.col("response").alias("bot"), F.col("intent").alias("intent"))


def answer_dialogues(
    messages: DataFrame, responses: DataFrame, model: Model | Answers,
    rounds: int = ROUNDS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Messages answered in dialogues of their own: each reply is part of the next prompt.

    ``messages`` has event_id, user_id, ts, message and, nullable, the facts ``balance`` and
    ``transactions`` as text. Added are ``turn`` (1-based place in the user's dialogue), intent, confidence,
    response and ``history``, the last five exchanges after the message.

    Labels don't depend on the dialogue, so all messages are labelled first. Then turn *k* of all users
    is one batched call of the model, and the histories it leaves are the context of turn *k* + 1: the
    number of rounds is the longest dialogue's number of turns, ``rounds`` at most. A dialogue that goes on
    after that is answered by one task, message by message, with no more in memory than its history; what
    it is told there is not stored.
    """
    spark = messages.sparkSession
    answers = _answers(spark, model)
    responses = store(responses, "templates")
    placed = store(along_timeline(messages, lambda f: f.derive(turn=Position()).rows, hot_rows=hot_rows), "placed")
    labelled = _labelled(placed, answers)
    # clustered by turn, so that a round reads its rows only
    turns = store(labelled.repartitionByRange("turn", "user_id"), "turns")
    last = turns.agg(F.max("turn")).first()[0] or 0
    done, history = [], None
    for turn in range(1, min(last, rounds) + 1):
        now = _with_history(turns.filter(F.col("turn") == turn), history)
        now = store(now.withColumn("context", _context(F.col("history"))), "turn")
        replied = _replied(now, responses, answers).withColumn("history", _last(F.concat("history", F.array(_said())), REMEMBERED))
        done.append(store(replied.select(*turns.columns, "response", "history"), "replied"))
        history = done[-1].select("user_id", "history")
    if last > rounds:
        late = turns.filter(F.col("turn") > rounds)
        first = _with_history(late.filter(F.col("turn") == rounds + 1), history)
        rest = late.filter(F.col("turn") > rounds + 1).withColumn("history", F.lit(None).cast(EXCHANGES))
        done.append(_one_by_one(prompts.with_templates(first.unionByName(rest), responses), answers.model))
    if not done:
        return turns.withColumns({"response": F.lit(None).cast("string"), "history": F.lit(None).cast(EXCHANGES)})
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(*out.columns))
    return out


def _with_history(now: DataFrame, history: DataFrame | None) -> DataFrame:
    """Rows of one turn, one a user, with what the user's dialogue left before."""
    none = F.array().cast(EXCHANGES)
    if history is None:
        return now.withColumn("history", none)
    before = history.select(F.col("user_id").alias("_user"), F.col("history").alias("_before"))
    joined = now.join(before, F.col("user_id").eqNullSafe(F.col("_user")), "left")
    return joined.select(*now.columns, F.coalesce("_before", none).alias("history"))


def _one_by_one(rows: DataFrame, model: Model) -> DataFrame:
    """Each user's rows in their order through the model. The first row of a user carries the history before it."""
    columns = [c for c in rows.columns if c not in ("templates", "history")]

    def ask(intent: str, context: str, message: str | None, templates: list[str]) -> str | None:
        if message is None:
            return None
        prompt = prompts.response_prompt_text(intent, context, message, templates)
        try:
            (answer,) = model([prompt])
            return answer
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        history: list[dict] = []
        for frame in frames:
            told, kept = [], []
            for row in frame.to_dict("records"):
                if row["history"] is not None:
                    history = [dict(x) for x in row["history"]]
                intent = row["intent"]
                templates = [] if row["templates"] is None else list(row["templates"])
                context = "\n".join(f"User: {x['user']}\nBot: {x['bot']}" for x in history[-SHOWN:])
                raw = ask(intent, context, row["message"], templates) if templates else None
                if raw is not None:
                    reply = prompts.fill_template_text(raw.strip(), intent, row.get("balance"), row.get("transactions"))
                else:
                    reply = templates[int(row["event_id"]) % len(templates)] if templates else catalogue.REPLIES["unknown_tag"]
                history = [*history, {"user": row["message"] or "", "bot": reply, "intent": intent}][-REMEMBERED:]
                told.append(reply)
                kept.append(list(history))
            yield frame[columns].assign(response=told, history=kept)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "turn")
    return ordered.mapInPandas(run, f"{fields}, response string, history {EXCHANGES}")
