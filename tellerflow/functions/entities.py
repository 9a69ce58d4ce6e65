"""Entity extraction from a customer message.

All tests work on the lower-cased message and are unanchored: a word counts
wherever it occurs, also inside another word. One expression per entity, so
Catalyst drops those a query does not use.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tellerflow.sources import catalogue

# What an entity looks like in a lower-cased message.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
# The widest a decimal goes: an amount of more than 36 digits before the point counts as absent.
MONEY = "decimal(38,2)"
# Digits as Unicode understands them, and the same as the JVM's numbers read them.
_DIGITS = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]
_PLAIN_DIGITS = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)

TRANSACTION_ID = rf"(?:transaction|id|#){_SPACE}*([t#]?\p{{Nd}}{{5,}})"
SLASH_DATE = r"(\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4})"
ISO_DATE = r"(\p{Nd}{4}-\p{Nd}{1,2}-\p{Nd}{1,2})"
DOLLAR_SIGN_AMOUNT = rf"\${_SPACE}*(\p{{Nd}}+(?:,\p{{Nd}}{{3}})*+(?:\.\p{{Nd}}{{2}})?)"
# Tried once per run of digits: a match inside a run would also start at its head.
DOLLAR_WORD_AMOUNT = rf"(?<!\p{{Nd}})(\p{{Nd}}++(?:,\p{{Nd}}{{3}})*(?:\.\p{{Nd}}{{2}})?){_SPACE}*dollars"
# Letters and spaces between 'to' and 'account'. First each run of them up to its last
# 'account', entered at its head only; then what follows the first 'to' in it. Both
# are linear, and together they find the match of the two words and all between.
_LETTERS = r"[a-zA-Z\s\p{Z}\x1c-\x1f\x85]"
BEFORE_ACCOUNT = rf"(?<!{_LETTERS})({_LETTERS}*{_SPACE})account"
AFTER_TO = rf"to{_SPACE}+([a-zA-Z](?:{_LETTERS}*[a-zA-Z])?)"


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the leftmost match, the empty string when there is none."""
    return F.regexp_extract(text, pattern, 1)


# The regex matches later steps refer to, one column each.
MATCHES = {
    "_id": TRANSACTION_ID,
    "_slash": SLASH_DATE,
    "_iso": ISO_DATE,
    "_sign": DOLLAR_SIGN_AMOUNT,
    "_word": DOLLAR_WORD_AMOUNT,
}


def account_type(text: Column) -> Column:
    """The last type in list order wins when several are named."""
    return F.coalesce(
        *[F.when(text.contains(name), F.lit(name)) for name in reversed(catalogue.ACCOUNT_TYPES)]
    )


def transaction_id(found: Column) -> Column:
    bare = F.regexp_replace(F.upper(found), "^[#T]+", "")
    return F.when(found != "", F.concat(F.lit("T"), bare))


def explicit_date(slash: Column, iso: Column) -> Column:
    """ISO dates verbatim, else month/day/year padded; no validity check."""
    part = F.split(slash, "/")
    year = F.get(part, 2)
    padded = F.concat_ws(
        "-",
        F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year),
        F.lpad(F.get(part, 0), 2, "0"),
        F.lpad(F.get(part, 1), 2, "0"),
    )
    return F.when(iso != "", iso).when(slash != "", padded)


# Relative dates in the order they are tested.
RELATIVE_DATES = ["today", "yesterday", "this week", "last week", "this month", "last month"]


def relative_date(text: Column) -> Column:
    """Number of the first relative date named, null when there is none."""
    chain = F
    for number, name in enumerate(RELATIVE_DATES):
        chain = chain.when(text.contains(name), number)
    return chain


def message_date(named: Column, ts: Column, explicit: Column) -> Column:
    """A named day (today, yesterday) overrides an explicit date."""
    return F.when(named <= 1, F.date_sub(ts.cast("date"), named).cast("string")).otherwise(explicit)


def message_date_range(named: Column, ts: Column) -> Column:
    """Named weeks (from Monday) and months; those named 'this' end on the day."""
    day = ts.cast("date")
    monday, first = F.trunc(day, "week"), F.trunc(day, "month")
    start = (
        F.when(named == 2, monday)
        .when(named == 3, F.date_sub(monday, 7))
        .when(named == 4, first)
        .otherwise(F.add_months(first, -1))
    )
    end = F.when(named == 3, F.date_sub(monday, 1)).when(named == 5, F.date_sub(first, 1)).otherwise(day)
    return F.when(
        named >= 2, F.struct(start.cast("string").alias("start"), end.cast("string").alias("end"))
    )


def amount(word: Column, sign: Column) -> Column:
    """``n dollars`` overrides ``$n``; commas removed."""
    found = F.when(word != "", word).when(sign != "", sign)
    plain = F.replace(found, F.lit(","), F.lit(""))
    ascii_only = F.when(plain.rlike(r"[^\x00-\x7F]"), F.translate(plain, "".join(_DIGITS), _PLAIN_DIGITS)).otherwise(plain)
    return ascii_only.try_cast(MONEY)


def recipient(text: Column) -> Column:
    """The patterns are only tried where both words occur."""
    heads = F.regexp_extract_all(text, F.lit(BEFORE_ACCOUNT), F.lit(1))
    names = F.filter(F.transform(heads, lambda head: first_match(head, AFTER_TO)), lambda name: name != "")
    return F.when(text.contains("to") & text.contains("account"), F.get(names, 0))


def with_entities(messages: DataFrame, message: str = "message", ts: str = "ts") -> DataFrame:
    """Add ``text`` (the lower-cased message) and the ``entities`` struct.

    Null fields are absent entities; ``ts``, the message's own time, anchors
    relative dates. Each regex runs once, in its own projection. A null message
    reads as an empty one; knowing that ``text`` is never null also keeps the
    generated code short enough for the JIT compiler.
    """
    text = F.col("text")
    lowered = F.lower(F.coalesce(F.col(message), F.lit("")))
    matched = messages.withColumn("text", lowered).withColumns(
        {"_named": relative_date(text), **{n: first_match(text, pattern) for n, pattern in MATCHES.items()}}
    )
    named = F.col("_named")
    entities = F.struct(
        account_type(text).alias("account_type"),
        transaction_id(F.col("_id")).alias("transaction_id"),
        message_date(named, F.col(ts), explicit_date(F.col("_slash"), F.col("_iso"))).alias("date"),
        message_date_range(named, F.col(ts)).alias("date_range"),
        amount(F.col("_word"), F.col("_sign")).alias("amount"),
        recipient(text).alias("recipient"),
    )
    return matched.withColumn("entities", entities).drop("_named", *MATCHES)
