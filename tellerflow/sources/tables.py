"""Views of banking messages, ledgers and corpora derived from the test tables.

The supplied tables hold no banking vocabulary, so each view spells a banking
column out of their keys and values, for every row of the table. The texts are
plain SQL understood by Spark and by the checking engine alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One customer message per event; the twenty forms reach every intent.
UTTERANCES = """
SELECT event_id, user_id, ts,
  coalesce(CASE k
    WHEN 0 THEN 'Hello there'
    WHEN 1 THEN 'What''s my account balance?'
    WHEN 2 THEN 'balance of my savings account please'
    WHEN 3 THEN 'show transactions for my checking account'
    WHEN 4 THEN 'Transaction history'
    WHEN 5 THEN 'Show me my recent transactions'
    WHEN 6 THEN concat('transactions on ', CAST(CAST(ts AS DATE) AS STRING))
    WHEN 7 THEN 'my spending last month'
    WHEN 8 THEN 'transactions this week in savings'
    WHEN 9 THEN concat('details of transaction #', CAST(10000 + event_id AS STRING))
    WHEN 10 THEN concat('transfer $', CAST(5 + event_id % 900 AS STRING), '.50 to alice account')
    WHEN 11 THEN 'yes, confirm'
    WHEN 12 THEN 'pay to bob account'
    WHEN 13 THEN concat(CAST(10 + event_id % 90 AS STRING), ' dollars')
    WHEN 14 THEN 'transfer 1,250.00 dollars'
    WHEN 15 THEN 'no, cancel that'
    WHEN 16 THEN 'I want to transfer money'
    WHEN 17 THEN 'transfer funds'
    WHEN 18 THEN concat('transactions on ', CAST(month(ts) AS STRING), '/', CAST(day(ts) AS STRING), '/24')
    ELSE 'Good evening'
  END, '') AS message
FROM (SELECT *, event_id % 20 AS k FROM events) AS e
"""

# Messages as they arrive: padded, and some blank.
RAW_UTTERANCES = f"""
SELECT event_id, user_id, ts,
  CASE WHEN event_id % 7 = 3 THEN '   '
       WHEN event_id % 11 = 5 THEN ''
       ELSE concat('  ', message, ' ') END AS message
FROM ({UTTERANCES}) AS u
"""

# Relative dates, overrides and the amount, date and recipient traps.
ENTITY_MESSAGES = """
SELECT event_id, user_id, ts,
  CASE k
    WHEN 0 THEN 'spending today'
    WHEN 1 THEN 'What did I buy YESTERDAY in savings'
    WHEN 2 THEN 'transactions this week'
    WHEN 3 THEN 'transactions last week, checking or savings'
    WHEN 4 THEN 'Spending this month'
    WHEN 5 THEN 'spending last month'
    WHEN 6 THEN concat('this week or today? 2024-05-', CAST(event_id % 40 AS STRING))
    WHEN 7 THEN concat('on ', CAST(event_id % 13 AS STRING), '/', CAST(event_id % 32 AS STRING), '/2024 or so')
    WHEN 8 THEN concat('it was 3/4/24 not 2024-5-', CAST(event_id % 30 AS STRING))
    WHEN 9 THEN concat('paid ', CAST(10000 + event_id AS STRING), ' by card')
    WHEN 10 THEN concat('transaction t', CAST(20000 + event_id AS STRING), ' and id: 777777')
    WHEN 11 THEN concat('$', CAST(event_id AS STRING), '.5 and more')
    WHEN 12 THEN concat(CAST(event_id % 1000 AS STRING), '.5 dollars')
    WHEN 13 THEN concat('$5 and ', CAST(event_id % 7000 AS STRING), ' dollars')
    WHEN 14 THEN 'I want to transfer money to bob account or to ann account'
    WHEN 15 THEN concat('transfer $', CAST(90000000000000000 + event_id AS STRING), '.25 to bob account')
    WHEN 16 THEN concat('₹ or $٣', CAST(event_id % 9 AS STRING), '٤.٥٠ on ٢٠٢٤-٠٥-٠', CAST(event_id % 9 AS STRING), ' for id ٧٧٧٧', CAST(event_id AS STRING))
    WHEN 17 THEN concat('account to a to b (', CAST(event_id AS STRING), ') into  the   savings account to pay to account')
    ELSE concat('send $12,34 to another account on ', CAST(112 + event_id % 3 AS STRING), '/05/2025')
  END AS message
FROM (SELECT *, event_id % 19 AS k FROM events) AS e
"""

# Notes with prices, long numbers, contractions, links and mail addresses.
NOISY_NOTES = """
SELECT event_id AS id,
  CASE k
    WHEN 0 THEN concat('cars ', CAST(event_id % 10 AS STRING), ' and 10usd')
    WHEN 1 THEN concat('1.5 or 12.5 or 1,234.56 or ', CAST(event_id AS STRING))
    WHEN 2 THEN concat('I paid $', CAST(event_id AS STRING), '.50 for € 7 tea')
    WHEN 3 THEN 'I won''t and can''t, they don''t'
    WHEN 4 THEN 'we''re sure it''s the bank''s fault'
    WHEN 5 THEN 'I''d say I''ll, I''ve, I''m; can''t ''t'
    WHEN 6 THEN concat('see https://example.com/a/', CAST(100000 + event_id AS STRING), '?x=1 now')
    WHEN 7 THEN concat('www.example.org/', CAST(event_id AS STRING), ' and more')
    WHEN 8 THEN concat('mail USER', CAST(event_id % 100 AS STRING), '@example.com, please')
    WHEN 9 THEN 'हिन्दी और ₹ 500 बैंक'
    WHEN 10 THEN ''
    WHEN 11 THEN CAST(NULL AS STRING)
    WHEN 12 THEN concat('cannot gonna wanna--gimme 50% #', CAST(event_id AS STRING), ' R&D a_b/c')
    WHEN 13 THEN concat('Loans, deposit and the documents at branch ', CAST(event_id % 50 AS STRING))
    ELSE concat('1,2,3 then 1.2.3 then 12 345 @ x@ @y rs ', CAST(event_id AS STRING))
  END AS text
FROM (SELECT *, event_id % 15 AS k FROM events) AS e
"""

# Customers' turns as messages: a conversation is a user's dialogue, its turns are in order.
CONVERSATION_MESSAGES = """
SELECT conv_id * 1000000 + turn AS event_id, conv_id AS user_id, CAST('2024-03-13 09:30:00' AS TIMESTAMP) AS ts,
  coalesce(text, '') AS message
FROM conversations WHERE role = 'user'
"""

# Every document as one message.
DOCUMENT_MESSAGES = """
SELECT doc_id AS event_id, doc_id AS user_id, CAST('2024-03-13 09:30:00' AS TIMESTAMP) AS ts, coalesce(text, '') AS message
FROM documents
"""

# One ledger row per event.
LEDGER = """
SELECT user_id,
  CASE WHEN event_id % 3 = 0 THEN 'savings' ELSE 'checking' END AS account_type,
  event_id AS pos,
  CAST(CAST(ts AS DATE) AS STRING) AS date,
  event_type AS description,
  CASE WHEN event_type IN ('purchase', 'view', 'error')
       THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS amount,
  concat('T', CAST(10000 + event_id AS STRING)) AS id
FROM events
"""

# A checking account for every customer, savings for every second one.
ACCOUNTS = """
SELECT c_custkey AS user_id, 'checking' AS account_type,
  lpad(CAST(c_custkey AS STRING), 10, '0') AS account_number,
  CAST(c_acctbal AS DECIMAL(18,2)) AS balance
FROM customer
UNION ALL
SELECT c_custkey, 'savings', lpad(CAST(c_custkey + 5000000 AS STRING), 10, '0'),
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 2 AS DECIMAL(18,2))
FROM customer
WHERE c_custkey % 2 = 0
"""

# The five labelled corpus sources: every document in one of them, in unequal shares.
CORPUS_TABLES = {
    "faqs": """
        SELECT d.doc_id AS question_id, d.text AS question, b.text AS answer
        FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
        WHERE d.doc_id % 11 < 2""",
    "complaints": """
        SELECT doc_id AS complaint_id, text AS description
        FROM documents WHERE doc_id % 11 BETWEEN 2 AND 4""",
    "assistance": "SELECT doc_id AS assistance_id, text AS query FROM documents WHERE doc_id % 11 = 5",
    "fraud_reports": """
        SELECT doc_id AS report_id, text AS description
        FROM documents WHERE doc_id % 11 BETWEEN 6 AND 8""",
    "transaction_details": """
        SELECT doc_id AS transaction_id, text AS description
        FROM documents WHERE doc_id % 11 > 8""",
}

# The user whose rows a query for one user shows.
SHOWN_USER = 7

# Documents' languages, and as many tags again that the documents don't have.
LANGUAGES = """
SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'it' WHEN 1 THEN 'hi' WHEN 2 THEN 'ja' WHEN 3 THEN 'zh' WHEN 4 THEN 'xx'
  WHEN 5 THEN CAST(NULL AS STRING) ELSE lang END AS lang
FROM documents
"""

# Messages, one in thirteen without text.
PARTLY_MISSING = f"""
SELECT event_id, user_id, ts, CASE WHEN event_id % 13 = 5 THEN CAST(NULL AS STRING) ELSE message END AS message
FROM ({UTTERANCES}) AS u
"""

# Sign-ups in arrival order; names repeat and some fields are missing.
REGISTRATIONS = """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN 'ab' ELSE concat('user', CAST(o_custkey AS STRING)) END AS username,
  o_orderdate AS created_at,
  o_orderkey % 37 <> 0 AS has_password,
  o_orderkey % 41 <> 0 AS passwords_match,
  CASE WHEN o_orderkey % 47 = 0 THEN 7 ELSE 8 + o_orderkey % 9 END AS password_length
FROM orders
"""

_BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view text over the tables it names."""
    words = set(sql.replace("(", " ").replace(")", " ").replace("\n", " ").split())
    frames = {name: table(spark, sf_dir, name) for name in _BASE_TABLES if name in words}
    return spark.sql(on_frame(sql, *frames), **frames)


def on_frame(sql: str, *names: str) -> str:
    """A view text that takes the named tables as ``spark.sql`` arguments."""
    for name in names:
        for keyword in ("FROM", "JOIN"):
            sql = sql.replace(f"{keyword} {name}", f"{keyword} {{{name}}}")
    return sql


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, UTTERANCES)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LEDGER)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ACCOUNTS)
