"""Reply texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tellerflow.sources import catalogue


def pick(choices: list[str] | list[Column], key: Column) -> Column:
    """One of several variants, chosen by a stable key instead of at random.

    The higher-order function keeps a projection with this choice out of
    whole-stage code: all reply texts fused with the join before them make one
    method too long for the JIT compiler.
    """
    options = F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices])
    chosen = F.pmod(key, F.lit(len(choices))).cast("int")
    return F.get(F.transform(F.array(chosen), lambda i: F.get(options, i)), 0)


def fill(template: str, **values: Column) -> Column:
    """A template with its {placeholders} replaced by columns; null if any is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def money(value: Column) -> Column:
    """Two decimals, no grouping."""
    return value.cast("decimal(38,2)").cast("string")


def reply(name: str, **values: Column) -> Column:
    return fill(catalogue.REPLIES[name], **values)


def account_selection_reply(
    account: Column, pending_type: Column, pending_amount: Column, pending_recipient: Column
) -> Column:
    """Reply to naming an account when asked for one."""
    pending = pending_type == "transfer"
    amount, to = money(pending_amount), pending_recipient
    return (
        F.when(account.isNull(), reply("fallback"))
        .when(
            pending & amount.isNotNull() & to.isNotNull(), reply("confirm", amount=amount, account=account, recipient=to)
        )
        .when(pending & amount.isNotNull(), reply("switched_ask_recipient", amount=amount, account=account))
        .when(pending & to.isNotNull(), reply("switched_ask_amount", recipient=to, account=account))
        .otherwise(reply("switched", account=account))
    )


def response(
    intent: Column,
    entities: Column,
    key: Column,
    account: Column,
    account_before: Column,
    fact: Column,
    pending_amount: Column,
    pending_recipient: Column,
) -> Column:
    """The reply to a message.

    ``account`` is the account in effect including this message,
    ``account_before`` the one before it; ``fact`` is what the lookup found;
    ``pending_*`` is the transfer this message answers to.
    """
    e = entities
    date, span = e["date"], e["date_range"]
    amount, to = money(e["amount"]), e["recipient"]
    found = fact.isNotNull()

    balances = [fill(t, account=account, balance=fact) for t in catalogue.BALANCE_REPLIES]
    dated = F.when(
        date.isNotNull(),
        F.when(found, reply("on_date", date=date, account=account, lines=fact)).otherwise(
            reply("none_on_date", date=date, account=account)
        ),
    ).when(
        span.isNotNull(),
        F.when(found, reply("in_range", start=span["start"], end=span["end"], account=account, lines=fact)).otherwise(
            reply("none_in_range", start=span["start"], end=span["end"], account=account)
        ),
    )
    one = F.when(
        e["transaction_id"].isNotNull(),
        F.when(found, reply("one", id=e["transaction_id"], detail=fact)).otherwise(
            reply("no_such", id=e["transaction_id"], account=account)
        ),
    )
    transfer = (
        F.when(amount.isNotNull() & to.isNotNull(), reply("confirm", amount=amount, account=account, recipient=to))
        .when(amount.isNotNull(), reply("ask_recipient", amount=amount))
        .when(to.isNotNull(), reply("ask_amount", recipient=to))
        .otherwise(reply("ask_details"))
    )
    given = F.when(
        amount.isNotNull(),
        F.when(
            pending_recipient.isNotNull(),
            reply("confirm", amount=amount, account=account_before, recipient=pending_recipient),
        ).otherwise(reply("ask_recipient", amount=amount)),
    )
    done = reply(
        "transferred",
        amount=money(F.coalesce(pending_amount, F.lit(0))),
        account=account_before,
        recipient=F.coalesce(pending_recipient, F.lit(catalogue.DEFAULT_RECIPIENT)),
    )
    chain = (
        F.when(intent == "greeting", pick(catalogue.GREETING_REPLIES, key))
        .when(
            intent.isin("balance_inquiry", "account_balance"),
            F.when(found, pick(balances, key)).otherwise(reply("no_balance", account=account)),
        )
        .when(
            intent.isin("transaction_history", "account_transactions"),
            F.when(found, reply("recent", account=account, lines=fact)).otherwise(reply("no_recent", account=account)),
        )
        .when(intent == "date_transactions", dated)
        .when(intent == "specific_transaction", one)
        .when(intent == "transfer_money", transfer)
        .when(intent == "account_selection", account_selection_reply(e["account_type"], F.lit("transfer"), pending_amount, pending_recipient))
        .when(intent == "amount_specification", given)
        .when(intent == "confirmation_yes", done)
        .when(intent == "confirmation_no", reply("cancelled"))
        .when(intent == "error", reply("error"))
    )
    return F.coalesce(chain, reply("fallback"))


def speech_text(text: Column) -> Column:
    """Text to read aloud: bracketed spans removed, ends trimmed."""
    blank = r"[\s\p{Z}\x{feff}]"
    bare = F.regexp_replace(text, r"\[[^\n\r\x{2028}\x{2029}]*?\]", "")
    return F.regexp_replace(bare, rf"^{blank}+|{blank}+$", "")


def locale(language: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in catalogue.LOCALES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, language), F.lit(catalogue.DEFAULT_LOCALE))
