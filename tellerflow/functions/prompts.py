"""Labels, prompts and templates for an external text model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tellerflow.functions.render import fill
from tellerflow.sources import catalogue

# Our own wording; a model may need another one.
CLASSIFY = (
    "Choose the intent of the customer message from this list: {tags}.\n"
    "Message: {message}\n"
    "Answer with the intent name alone."
)
REPLY = (
    "Write a short, friendly answer from a bank's assistant.\n"
    "Intent: {intent}\n"
    "Earlier in this conversation:\n{context}\n"
    "Message: {message}\n"
    "Follow the style of these templates:\n{templates}"
)


def strip(text: Column) -> Column:
    """Text without surrounding whitespace of any kind."""
    blank = r"[\s\p{Z}\x1c-\x1f\x85]"
    return F.regexp_replace(F.regexp_replace(text, rf"^{blank}+", ""), rf"(?<!{blank}){blank}+$", "")


def validate_label(raw: Column, tags: list[str] | None = None) -> Column:
    """(intent, confidence) of a model's raw answer; null means it failed."""
    label = F.translate(strip(raw), "'\"", "")

    def labelled(intent: Column, confidence: float) -> Column:
        return F.struct(intent.alias("intent"), F.lit(confidence).alias("confidence"))

    return (
        F.when(raw.isNull(), labelled(F.lit("error"), 0.0))
        .when(label.isin(*(tags or catalogue.INTENT_TAGS)), labelled(label, 0.9))
        .otherwise(labelled(F.lit("greeting"), 0.5))
    )


def classification_prompt(message: Column, tags: list[str] | None = None) -> Column:
    names = ", ".join(tags or catalogue.INTENT_TAGS)
    return fill(CLASSIFY, tags=F.lit(names), message=message)


def response_prompt(intent: Column, context: Column, message: Column, templates: Column) -> Column:
    listed = F.array_join(F.transform(templates, lambda t: F.concat(F.lit("- "), t)), "\n")
    return fill(REPLY, intent=intent, context=F.coalesce(context, F.lit("")), message=message, templates=listed)


def response_prompt_text(intent: str, context: str, message: str, templates: list[str]) -> str:
    """``response_prompt`` of one message."""
    listed = "\n".join(f"- {t}" for t in templates)
    return REPLY.format(intent=intent, context=context, message=message, templates=listed)


def with_templates(messages: DataFrame, responses: DataFrame) -> DataFrame:
    """Add the templates of each message's intent, null for an unknown tag.

    ``responses(tag, templates)`` has one row per tag; Spark broadcasts it when
    its size allows.
    """
    table = responses.select(F.col("tag").alias("intent"), "templates")
    return messages.join(table, "intent", "left")


def template_reply(templates: Column, key: Column) -> Column:
    """A template chosen by a stable key, unfilled; used when the model fails."""
    chosen = F.get(templates, F.pmod(key, F.greatest(F.size(templates), F.lit(1))).cast("int"))
    return F.when(F.coalesce(F.size(templates), F.lit(0)) > 0, chosen).otherwise(
        F.lit(catalogue.REPLIES["unknown_tag"])
    )


def fill_template(text: Column, intent: Column, balance: Column, transactions: Column) -> Column:
    """Put known facts into a template; placeholders of unknown facts stay."""
    return (
        F.when((intent == "balance_inquiry") & balance.isNotNull(), F.replace(text, F.lit("[AMOUNT]"), balance))
        .when(
            (intent == "transaction_history") & transactions.isNotNull(),
            F.replace(text, F.lit("[TRANSACTIONS]"), transactions),
        )
        .otherwise(text)
    )


def fill_template_text(text: str, intent: str, balance: str | None, transactions: str | None) -> str:
    """``fill_template`` of one reply."""
    if intent == "balance_inquiry" and balance is not None:
        return text.replace("[AMOUNT]", balance)
    if intent == "transaction_history" and transactions is not None:
        return text.replace("[TRANSACTIONS]", transactions)
    return text


def apply_model(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """Add ``raw``, the answer of a caller-supplied model, null where it failed.

    The model sees one Arrow batch of prompts at a time, without null prompts; a
    failing batch is retried prompt by prompt so that one bad prompt costs one
    answer.
    """

    def one(text: str) -> str | None:
        try:
            (answer,) = model([text])
            return answer
        except Exception:
            return None

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame[prompt].notna()
            texts = frame.loc[asked, prompt].tolist()
            try:
                answers = list(model(texts)) if texts else []
                if len(answers) != len(texts):
                    raise ValueError("the model must give one answer per prompt")
            except Exception:
                answers = [one(t) for t in texts]
            raw = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            raw[asked] = answers
            yield frame.assign(raw=raw)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(batches, f"{fields}, raw string")
