"""Seeded synthetic banking tables.

Every value is a function of (seed, table, id), so a table comes out the same
whatever the partitioning, and a lost task reproduces its rows. Ids come from
``spark.range`` or from any DataFrame with an ``id`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tellerflow.sources import catalogue as c

SEED = 42
AS_OF = "2025-05-10 12:00:00"
USERS = 100_000


class _Row:
    """Column builders over the draws of one table."""

    def __init__(self, table: str, seed: int, as_of: str, users: int):
        self.table, self.seed, self.users = table, seed, users
        self.now = F.lit(as_of).cast("timestamp_ntz")

    def digest(self, part: str) -> Column:
        """32 hex digits per (seed, table, part, id)."""
        return F.md5(F.concat(F.lit(f"{self.seed}:{self.table}:{part}:"), F.col("id").cast("string")))

    def draw(self, field: str) -> Column:
        """A whole number below 2^60, so that reducing it is even for any range in use."""
        return F.conv(F.substring(self.digest(field), 1, 15), 16, 10).cast("bigint")

    def below(self, field: str, n: int) -> Column:
        return self.draw(field) % F.lit(n)

    def pick(self, field: str, options: list) -> Column:
        return F.get(F.array(*[F.lit(o) for o in options]), self.below(field, len(options)).cast("int"))

    def whole(self, field: str, low: int, high: int) -> Column:
        return self.below(field, high - low + 1) + F.lit(low)

    def money(self, field: str, low: int, high: int) -> Column:
        cents = self.whole(field, low * 100, high * 100)
        return (cents.cast("decimal(16,0)") / F.lit(100)).cast("decimal(18,2)")

    def moment(self, field: str, days: int) -> Column:
        return F.timestamp_add("SECOND", -self.below(field, days * 86400), self.now)

    def text(self, field: str, words: int) -> Column:
        """Filler of at most 16 words."""
        digest = self.digest(field)
        vocabulary = F.array(*[F.lit(w) for w in c.FILLER_WORDS])

        def word(i: Column) -> Column:
            pair = F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.get(vocabulary, pair % F.lit(len(c.FILLER_WORDS)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word), " ")

    def user(self) -> Column:
        return self.whole("user_id", 1, self.users)


def _user_details(r: _Row) -> dict[str, Column]:
    first, last = r.pick("first", c.FIRST_NAMES), r.pick("last", c.LAST_NAMES)
    return {
        "name": F.concat_ws(" ", first, last),
        "email": F.concat(F.lower(first), F.lit("."), F.lower(last), F.col("id").cast("string"), F.lit("@example.com")),
        "phone": F.concat(F.lit("555-"), F.lpad(r.below("phone", 10_000_000).cast("string"), 7, "0")),
        "address": F.concat(
            r.whole("house", 1, 999).cast("string"), F.lit(" "), r.pick("street", c.STREETS), F.lit(" Street\n"),
            r.pick("city", c.CITIES), F.lit(", "), F.lpad(r.below("zip", 100_000).cast("string"), 5, "0"),
        ),
        # 18 years, plus less than 73, before the reference date
        "date_of_birth": F.date_sub(F.add_months(r.now.cast("date"), -18 * 12), r.below("dob", 73 * 365).cast("int")),
        "occupation": r.pick("occupation", c.JOBS),
        "annual_income": r.whole("annual_income", 300_000, 2_000_000),
    }


def _transaction_details(r: _Row) -> dict[str, Column]:
    return {
        "user_id": r.user(),
        "type": r.pick("type", c.TRANSACTION_TYPES),
        "amount": r.money("amount", 100, 100_000),
        "timestamp": r.moment("timestamp", 365),
        "status": r.pick("status", c.TRANSACTION_STATUSES),
        "description": r.text("description", 5),
    }


def _credit_cards(r: _Row) -> dict[str, Column]:
    digits = [F.lpad(r.below(f"digits{i}", 100_000_000).cast("string"), 8, "0") for i in (1, 2)]
    expiry = F.add_months(r.now.cast("date"), r.below("expiry", 120).cast("int"))
    return {
        "user_id": r.user(),
        "card_type": r.pick("card_type", c.CARD_TYPES),
        "card_number": F.concat(*digits),
        "expiry_date": F.concat(F.substring(expiry.cast("string"), 6, 2), F.lit("/"), F.substring(expiry.cast("string"), 3, 2)),
        "credit_limit": r.pick("credit_limit", c.CARD_LIMITS).cast("bigint"),
        "current_balance": r.money("current_balance", 0, 100_000),
        "status": r.pick("status", c.CARD_STATUSES),
    }


def _loans(r: _Row) -> dict[str, Column]:
    return {
        "user_id": r.user(),
        "loan_type": r.pick("loan_type", c.LOAN_TYPES),
        "amount": r.money("amount", 100_000, 10_000_000),
        "interest_rate": r.money("interest_rate", 7, 15).cast("decimal(5,2)"),
        "term_months": r.pick("term_months", c.LOAN_TERMS),
        "status": r.pick("status", c.LOAN_STATUSES),
        "application_date": r.moment("application_date", 730),
    }


def _complaints(r: _Row) -> dict[str, Column]:
    return {
        "user_id": r.user(),
        "type": r.pick("type", c.COMPLAINT_TYPES),
        "description": r.text("description", 16),
        "priority": r.pick("priority", c.COMPLAINT_PRIORITIES),
        "status": r.pick("status", c.COMPLAINT_STATUSES),
        # drawn independently: a complaint may be resolved before it was created
        "created_at": r.moment("created_at", 365),
        "resolved_at": r.moment("resolved_at", 365),
    }


def _fraud_reports(r: _Row) -> dict[str, Column]:
    return {
        "user_id": r.user(),
        "fraud_type": r.pick("fraud_type", c.FRAUD_TYPES),
        "description": r.text("description", 16),
        "amount_involved": r.money("amount_involved", 1_000, 500_000),
        "reported_date": r.moment("reported_date", 365),
        "status": r.pick("status", c.FRAUD_STATUSES),
    }


def _faqs(r: _Row) -> dict[str, Column]:
    """The base pairs verbatim as rows 1..5, every later row one of them again."""
    n = len(c.FAQ_PAIRS)
    place = F.when(F.col("id") <= n, F.col("id") - 1).otherwise(r.below("pair", n)).cast("int")
    return {
        "question": F.get(F.array(*[F.lit(q) for q, _ in c.FAQ_PAIRS]), place),
        "answer": F.get(F.array(*[F.lit(a) for _, a in c.FAQ_PAIRS]), place),
        "category": r.pick("category", c.FAQ_CATEGORIES),
    }


def _assistance(r: _Row) -> dict[str, Column]:
    return {
        "user_id": r.user(),
        "type": r.pick("type", c.ASSISTANCE_TYPES),
        "query": r.text("query", 16),
        "status": r.pick("status", c.ASSISTANCE_STATUSES),
        "created_at": r.moment("created_at", 365),
        "response_time": r.whole("response_time", 1, 72).cast("int"),
    }


GENERATORS = {
    "user_details": ("user_id", _user_details),
    "transaction_details": ("transaction_id", _transaction_details),
    "credit_cards": ("card_id", _credit_cards),
    "loans": ("loan_id", _loans),
    "complaints": ("complaint_id", _complaints),
    "fraud_reports": ("report_id", _fraud_reports),
    "faqs": ("question_id", _faqs),
    "assistance": ("assistance_id", _assistance),
}


def generate(table: str, ids: DataFrame, users: int = USERS, seed: int = SEED, as_of: str = AS_OF) -> DataFrame:
    """Rows of one table for the given ids (1, 2, ...); a narrow projection."""
    key, build = GENERATORS[table]
    columns = build(_Row(table, seed, as_of, users))
    return ids.select(F.col("id").cast("bigint").alias(key), *[v.alias(k) for k, v in columns.items()])


def generate_all(spark: SparkSession, folder: str, n: int = USERS, **options) -> None:
    """Write all eight tables with ``n`` rows each as Parquet."""
    for table in GENERATORS:
        generate(table, spark.range(1, n + 1), users=n, **options).write.mode("overwrite").parquet(f"{folder}/{table}")
