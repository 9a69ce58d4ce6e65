"""Ledger lookups against brute force, and the sample ledger by hand."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tellerflow.operators import answering, ledger as lookups
from tellerflow.sources import schemas

ROWS = "user_id long, account_type string, pos long, date string, description string, amount decimal(18,2), id string"
ASKED = "event_id long, user_id long, account_type string, transaction_id string, date string, start string, end string"

SAMPLE = [
    ("checking", "2025-05-01", "Grocery Store", "-65.42", "T12345"),
    ("checking", "2025-05-02", "Salary Deposit", "2500.00", "T12346"),
    ("checking", "2025-05-02", "Rent Payment", "-1200.00", "T12347"),
    ("checking", "2025-04-28", "Restaurant", "-45.80", "T12348"),
    ("checking", "2025-04-25", "Gas Station", "-35.50", "T12349"),
    ("savings", "2025-05-01", "Interest Payment", "12.33", "T22345"),
    ("savings", "2025-04-15", "Transfer from Checking", "500.00", "T22346"),
    ("savings", "2025-04-01", "Interest Payment", "11.98", "T22347"),
]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1, a, i, d, t, Decimal(m), n) for i, (a, d, t, m, n) in enumerate(SAMPLE)]
    return spark.createDataFrame(rows, ROWS)


def test_sample_listing(sample):
    days = lookups.daily_listing(sample)
    listing = lookups.recent_listing(days).filter("account_type = 'checking'")
    text = listing.select(lookups.bullet_list(F.transform("rows", lookups.signed_line)).alias("t")).first().t
    assert text == (
        "\n- 2025-05-02 | Salary Deposit | +$2500.00 | ID: T12346"
        "\n- 2025-05-02 | Rent Payment | $1200.00 | ID: T12347"
        "\n- 2025-05-01 | Grocery Store | $65.42 | ID: T12345"
        "\n- 2025-04-28 | Restaurant | $45.80 | ID: T12348"
        "\n- 2025-04-25 | Gas Station | $35.50 | ID: T12349"
    )


def test_nested_ledger(spark):
    money = "decimal(18,2)"
    txn = f"struct<date:string,description:string,amount:{money},id:string>"
    schema = f"user_id long, accounts map<string,struct<account_number:string,balance:{money},transactions:array<{txn}>>>"
    nested = {
        kind: ("00" + kind, Decimal("10.00"), [(d, t, Decimal(m), n) for a, d, t, m, n in SAMPLE if a == kind])
        for kind in ("checking", "savings")
    }
    accounts, rows = lookups.flatten_ledger(spark.createDataFrame([(1, nested)], schema))
    assert sorted(r.account_number for r in accounts.collect()) == ["00checking", "00savings"]
    assert [(r.pos, r.id) for r in rows.orderBy("account_type", "pos").collect()][:2] == [(0, "T12345"), (1, "T12346")]


def select(rows, asked, limit=5):
    """What one request selects, by scanning the whole ledger."""
    event, user, account, number, date, start, end = asked
    mine = [r for r in rows if r[0] == user and r[1] == account]
    if number:
        return sorted((event, None, r[2]) for r in mine if r[6] == number)
    mine = [r for r in mine if (not date or r[3] == date) and (not start or start <= r[3] <= end)]
    mine.sort(key=lambda r: r[2])
    mine.sort(key=lambda r: r[3], reverse=True)
    return [(event, i + 1, r[2]) for i, r in enumerate(mine[:limit])]


@pytest.mark.parametrize("hot_rows", [lookups.HOT_ROWS, 200, 40, 0])
def test_requests_on_random_ledgers(spark, hot_rows):
    rng = random.Random(5)
    days = [f"2024-01-{d:02d}" for d in range(1, 20)]
    kinds = ["checking", "savings", "none"]
    rows = [
        # user 0 holds a third of the ledger; some ids repeat
        (rng.choice([0, 0, 1, 2, 3]), rng.choice(kinds[:2]), i, rng.choice(days), "d", Decimal("1.00"), f"T{rng.randint(0, 300)}")
        for i in range(500)
    ]
    asked = []
    for i in range(800):
        start, end = rng.choice(days + ["2023-01-01"]), rng.choice(days + ["2025-01-01", "2024-01-99"])
        ranged, dated, numbered = rng.random() < 0.5, rng.random() < 0.4, rng.random() < 0.3
        asked.append((i, rng.choice([0, 0, 1, 2, 9]), rng.choice(kinds), f"T{rng.randint(0, 320)}" if numbered else None,
                      rng.choice(days) if dated else None, start if ranged else None, end if ranged else None))
    ledger = spark.createDataFrame(rng.sample(rows, len(rows)), ROWS)
    found = lookups.transactions(spark.createDataFrame(asked, ASKED), ledger, hot_rows=hot_rows).collect()
    key = lambda t: (t[0], t[1] or 0, t[2])
    got = sorted(((r.event_id, r.rn, r.txn_pos) for r in found), key=key)
    assert got == sorted((x for a in asked for x in select(rows, a)), key=key)


def test_slices_without_days_pass_on_what_lies_before(spark):
    """Five days, then questions only: many slices away, each still finds the days."""
    rows = [(1, "checking", i, f"2024-01-{i + 1:02d}", "d", Decimal("1.00"), f"T{i}") for i in range(7)]
    asked = [(i, 1, "checking", None, None, "2024-01-01", f"2025-{i:04d}") for i in range(300)]
    asked.append((300, 1, "checking", None, None, "2024-01-01", "2024-01-03"))
    ledger = spark.createDataFrame(rows, ROWS)
    found = lookups.transactions(spark.createDataFrame(asked, ASKED), ledger, hot_rows=10).collect()
    got = sorted((r.event_id, r.rn, r.txn_pos) for r in found)
    assert got == sorted(x for a in asked for x in select(rows, a))


def test_busy_accounts_are_cut_into_slices(spark):
    rows = [(1, "checking", i, f"2024-{i:04d}", "d", Decimal("1.00"), f"T{i}") for i in range(90)]
    rows += [(u, "savings", 0, "2024-0001", "d", Decimal("1.00"), "T0") for u in range(2, 30)]
    asked = spark.createDataFrame([(1, "checking", "", f"2024-{i:04d}") for i in range(0, 90, 2)],
                                  "user_id long, account_type string, start string, end string")
    ledger = spark.createDataFrame(rows, ROWS)
    assert lookups.busy_accounts(ledger, asked) is None
    busy = lookups.busy_accounts(ledger, asked, 20)
    assert [tuple(r) for r in busy.collect()] == [(1, "checking", 135)]
    days = lookups.daily_rows(ledger)
    found = lookups.as_of(days, asked, busy=busy, hot_rows=20)
    same = lookups.as_of(days, asked)
    assert sorted(map(str, found.collect())) == sorted(map(str, same.collect()))
    # what follows the cut goes by account and slice, never by the account alone
    points = days.select(*lookups.ACCOUNT, "date", "rows", F.lit(None).cast("string").alias("start"))
    sliced = lookups._upto_in_slices(points, 5, 7)
    text = sliced._jdf.queryExecution().explainString(
        sliced._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    moved = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    assert moved and all("slice#" in columns for columns in moved)


def test_answers_use_the_account_in_effect(spark, sample):
    accounts = spark.createDataFrame(
        [(1, "checking", "1", Decimal("1250.75")), (1, "savings", "2", Decimal("5432.10"))], schemas.ACCOUNTS
    )
    said = [
        "balance of my savings account",
        "show transactions on 2025-04-15",
        "transaction #T22346",
        "number of transaction T12346",
        "checking account transactions please",
        "spending this month",
        "transfer $20 to ann account",
        "go ahead, sure",
        "pay to bob account",
        "savings, 30 dollars",
        "transaction #",
    ]
    rows = [(i, 1, f"2025-05-02 10:00:{i:02d}", m) for i, m in enumerate(said)]
    messages = spark.createDataFrame(rows, "event_id long, user_id long, ts string, message string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    answered = answering.answer(messages, accounts, sample).orderBy("event_id").collect()
    got = [(r.intent, r.response) for r in answered]
    assert got[0] == ("account_balance", "Your savings account balance is $5432.10."
                                         " Would you like to see your recent transactions?")
    assert got[1] == ("date_transactions", "Here are your transactions from 2025-04-15 for your savings account:"
                                           "\n- 2025-04-15 | Transfer from Checking | +$500.00 | ID: T22346")
    assert got[2] == ("specific_transaction", "Transaction T22346: 2025-04-15 | Transfer from Checking | $500.00 | Credit")
    assert got[3] == ("specific_transaction", "I couldn't find transaction T12346 in your savings account.")
    assert got[4][0] == "account_transactions" and got[4][1].count("\n- ") == 5
    assert got[5] == ("date_transactions", "Here are your transactions from 2025-05-01 to 2025-05-02 for your checking"
                      " account:\n- 2025-05-02 | Salary Deposit | +$2500.00 | ID: T12346"
                      "\n- 2025-05-02 | Rent Payment | $1200.00 | ID: T12347"
                      "\n- 2025-05-01 | Grocery Store | $65.42 | ID: T12345")
    assert got[6][1].startswith("I'll set up a transfer of $20.00 from your checking account to ann's account.")
    assert got[7] == ("confirmation_yes", "I've transferred $20.00 from your checking account to ann's account."
                                          " The transaction has been completed successfully.")
    # the account named in the same message counts only afterwards
    assert got[9] == ("amount_specification", "I'll set up a transfer of $30.00 from your checking account to bob's"
                                              " account. Would you like to proceed?")
    assert got[10] == ("specific_transaction",
                       "I'm not sure how to respond to that. Could you please rephrase your question?")


def test_message_without_text_fails_and_leaves_no_trace(spark, sample):
    accounts = spark.createDataFrame([], schemas.ACCOUNTS)
    said = ["transfer $20 to ann account", None, "yes"]
    messages = spark.createDataFrame(
        [(i, 1, m) for i, m in enumerate(said)], "event_id long, user_id long, message string"
    ).withColumn("ts", F.lit("2025-05-02 10:00:00").cast("timestamp_ntz"))
    rows = answering.answer(messages, accounts, sample).orderBy("event_id").collect()
    assert [(r.intent, r.confidence) for r in rows] == [
        ("transfer_money", 0.8), ("error", 0.0), ("confirmation_yes", 0.9)
    ]
    assert rows[1].response == "I'm sorry, I encountered an error. Please try again."
