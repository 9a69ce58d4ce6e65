"""Account and ledger lookups for messages.

Listings show at most five rows, newest date first, equal dates in ledger
order. None of the operators pairs messages with ledger rows: the ledger is
reduced to short listings first, and a message joins the one listing it asks
for. A user with a third of all messages and a third of the ledger therefore
costs rows, not rows times rows, and the timeline of such an account is cut
into slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellerflow.operators.timeline import HOT_ROWS
from tellerflow.sources import catalogue
from tellerflow.sources.files import store

LISTED = 5
ACCOUNT = ["user_id", "account_type"]
_ROW = ["date", "pos", "description", "amount", "id"]


def flatten_ledger(documents: DataFrame, accounts: str = "accounts") -> tuple[DataFrame, DataFrame]:
    """Nested account maps as flat tables: (accounts, ledger rows with their position)."""
    opened = documents.select("user_id", F.explode(accounts).alias("account_type", "account"))
    flat_accounts = opened.select("user_id", "account_type", "account.account_number", "account.balance")
    rows = opened.select(
        "user_id", "account_type", F.posexplode("account.transactions").alias("pos", "row")
    ).select("user_id", "account_type", "pos", "row.*")
    return flat_accounts, rows


def signed_line(row: Column) -> Column:
    """One listing line. Only a gain shows a sign; the amount itself is shown without one."""
    money = F.concat(F.when(row["amount"] > 0, "+").otherwise(""), F.lit("$"), F.abs(row["amount"]).cast("string"))
    return F.concat_ws(" | ", row["date"], row["description"], money, F.concat(F.lit("ID: "), row["id"]))


def detail_line(row: Column) -> Column:
    """One ledger row in full, as the reply to a question about it."""
    money = F.concat(F.lit("$"), F.abs(row["amount"]).cast("string"))
    kind = F.when(row["amount"] > 0, "Credit").otherwise("Debit")
    return F.concat_ws(" | ", row["date"], row["description"], money, kind)


def bullet_list(lines: Column) -> Column:
    return F.concat(F.lit("\n- "), F.array_join(lines, "\n- "))


def ledger_line(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("line", signed_line(F.struct(*_ROW)))


def _newest_first(rows: Column, limit: int) -> Column:
    """A short array of ledger rows: date descending, then position ascending."""
    return F.slice(
        F.array_sort(
            rows,
            lambda a, b: F.when(a["date"] > b["date"], -1)
            .when(a["date"] < b["date"], 1)
            .when(a["pos"] < b["pos"], -1)
            .when(a["pos"] > b["pos"], 1)
            .otherwise(0),
        ),
        1,
        limit,
    )


def newest(ledger: DataFrame, keys: list[str], limit: int = LISTED) -> DataFrame:
    """The newest rows per key. Each map task keeps its own top rows before the
    shuffle, so a hot key sends a few rows per task."""
    window = Window.partitionBy(*keys).orderBy(F.desc("date"), F.asc("pos"))
    return ledger.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= limit)


def recent_transactions(ledger: DataFrame, limit: int = LISTED) -> DataFrame:
    """The newest rows of every account with their rank ``rn``."""
    return newest(ledger, ACCOUNT, limit)


def daily_rows(ledger: DataFrame, limit: int = LISTED) -> DataFrame:
    """Per account and day its first rows as one array."""
    keys = [*ACCOUNT, "date"]
    return newest(ledger, keys, limit).groupBy(*keys).agg(
        _newest_first(F.collect_list(F.struct(*_ROW)), limit).alias("rows")
    )


def daily_listing(ledger: DataFrame, limit: int = LISTED) -> DataFrame:
    """The days of each account, and in ``upto`` its newest rows up to each day.

    ``upto`` looks back over at most ``limit`` days of at most ``limit`` rows.
    """
    back = Window.partitionBy(*ACCOUNT).orderBy("date").rowsBetween(-(limit - 1), 0)
    days = daily_rows(ledger, limit)
    return days.withColumn("upto", _newest_first(F.flatten(F.collect_list("rows").over(back)), limit))


def _last_days(keys: list[str], order: str, limit: int) -> Column:
    """The rows of the last ``limit`` days before this point of a timeline, latest day first. All look back in one sorted pass."""
    over = f"IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"
    return F.array_compact(F.array(*[F.expr(f"lag(rows, {k}) {over}") for k in range(1, limit + 1)]))


def busy_accounts(ledger: DataFrame, asked: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Accounts with more than ``hot_rows`` ledger rows and questions together, and how many: None if there are none."""
    busy = (
        ledger.select(*ACCOUNT).unionByName(asked.select(*ACCOUNT)).groupBy(*ACCOUNT)
        .agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    )
    return None if busy.isEmpty() else store(busy, "busy-accounts")


def as_of(
    days: DataFrame, asked: DataFrame, limit: int = LISTED, busy: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """For each distinct question (user_id, account_type, start, end) the newest rows of the closed range.

    The newest rows up to the end of a range, less those before its start, are its
    listing. Days and questions share one timeline and one exchange, and a question
    looks back at the last ``limit`` days before its end. Accounts in ``busy`` (see
    ``busy_accounts``) have their timelines cut into slices of about ``hot_rows`` points.
    """
    points = days.select(*ACCOUNT, "date", "rows").unionByName(
        asked.select(*ACCOUNT, "start", F.col("end").alias("date")).distinct(), allowMissingColumns=True
    )

    def plainly(points: DataFrame) -> DataFrame:
        return points.withColumn("upto", _last_days(ACCOUNT, "date, isnull(rows)", limit)).filter("rows IS NULL")

    if busy is None:
        found = plainly(points)
    else:
        points = store(points, "points")
        slices = int(busy.agg(F.sum("n")).first()[0]) // max(hot_rows, 1) + 1
        busy = busy.select(*ACCOUNT)
        few = points.join(busy, ACCOUNT, "left_anti").select(*points.columns)
        many = points.join(busy, ACCOUNT, "left_semi").select(*points.columns)
        found = plainly(few).unionByName(_upto_in_slices(many, limit, slices))
    rows = F.filter(_newest_first(F.flatten("upto"), limit), lambda r: r["date"] >= F.col("start"))
    return found.select(*ACCOUNT, "start", F.col("date").alias("end"), rows.alias("rows"))


def _upto_in_slices(points: DataFrame, limit: int, slices: int) -> DataFrame:
    """Each question with ``upto``, its last ``limit`` days, where no task takes a whole account.

    The points are range-partitioned on (account, date) into slices and stored, so that
    a lost executor reads the same slices again. Days are looked back at within a slice;
    the last days of the slices before it come through a carry, for which a slice gives
    at most ``limit`` days and one mark.
    """
    ranges = points.repartitionByRange(slices, *ACCOUNT, "date", F.col("rows").isNull())
    sliced = store(ranges.withColumn("slice", F.spark_partition_id()), "slices")
    part = [*ACCOUNT, "slice"]
    own = sliced.withColumn("upto", _last_days(part, "date, isnull(rows)", limit)).filter("rows IS NULL")

    newest_days = Window.partitionBy(*part).orderBy(F.desc("date"))
    last = sliced.filter("rows IS NOT NULL").withColumn("rn", F.row_number().over(newest_days)).filter(F.col("rn") <= limit)
    # a slice's mark stands before its own days, so it sees those of the slices before
    marks = sliced.select(*part).distinct()
    along = last.select(*part, "date", "rows").unionByName(marks, allowMissingColumns=True)
    carried = along.withColumn("carry", _last_days(ACCOUNT, "slice, isnotnull(rows), date", limit)).filter("rows IS NULL")
    # stored, so that Spark knows how few they are
    carried = store(carried.select(*part, "carry"), "carry")
    upto = F.slice(F.concat("upto", F.coalesce("carry", F.array().cast(carried.schema["carry"].dataType))), 1, limit)
    return own.join(carried, part, "left").withColumn("upto", upto).drop("slice", "carry")


def recent_listing(days: DataFrame) -> DataFrame:
    """Listing of every account: the newest rows up to its last day."""
    return days.groupBy(*ACCOUNT).agg(F.max_by("upto", "date").alias("rows"))


def account_history(accounts: DataFrame, ledger: DataFrame, limit: int = LISTED) -> DataFrame:
    """Every account with its balance and newest rows, null where it has none.

    Of tables bucketed by user nothing moves: the newest rows are found where they lie, and users meet there.
    """
    kept = newest(ledger, ACCOUNT, limit).select(*ACCOUNT, F.struct(*_ROW).alias("row"))
    listed = kept.groupBy(*ACCOUNT).agg(_newest_first(F.collect_list("row"), limit).alias("rows"))
    # by user alone, as the buckets are: one entry for each account of a user
    entries = F.map_from_entries(F.collect_list(F.struct("account_type", "rows")))
    theirs = listed.groupBy("user_id").agg(entries.alias("listings"))
    joined = accounts.select(*ACCOUNT, "balance").join(theirs, "user_id", "left")
    return joined.select(*ACCOUNT, "balance", F.element_at("listings", F.col("account_type")).alias("rows"))


def balances(asked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add the balance of the account each row names; null when it has none."""
    return asked.join(accounts.select(*ACCOUNT, "balance"), ACCOUNT, "left")


def transactions(asked: DataFrame, ledger: DataFrame, limit: int = LISTED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ledger rows each request selects, one output row each with rank ``rn``.

    ``asked`` has user_id, account_type and, nullable, transaction_id, date,
    start and end. An id selects every row with that id, unsorted and without
    limit; otherwise date and range both restrict the newest-first listing.
    Requests for an unknown account, or that select nothing, give no rows.
    """
    asked = store(asked, "requests")  # read several times below
    columns, by_number = asked.columns, F.col("transaction_id").isNotNull()
    row = F.struct(*_ROW).alias("row")
    by_id = asked.filter(by_number).join(
        ledger.select(*ACCOUNT, F.col("id").alias("transaction_id"), row), [*ACCOUNT, "transaction_id"]
    )

    # Date, range, both or neither: always one range. Dates compare as text, so
    # the empty string is before every date and "~" after.
    listings = asked.filter(~by_number).withColumns(
        {
            "_from": F.coalesce(F.greatest("date", "start"), F.lit("")),
            "_to": F.coalesce(F.least("date", "end"), F.lit("~")),
        }
    )
    ranges = listings.select(*ACCOUNT, F.col("_from").alias("start"), F.col("_to").alias("end"))
    busy = busy_accounts(ledger, ranges, hot_rows)
    found = as_of(daily_rows(ledger, limit), ranges, limit, busy, hot_rows).withColumnsRenamed({"start": "_from", "end": "_to"})
    listed = listings.join(found, [*ACCOUNT, "_from", "_to"]).select(
        *columns, F.posexplode("rows").alias("place", "row")
    )
    chosen = by_id.select(*columns, F.lit(None).cast("int").alias("rn"), "row").unionByName(
        listed.select(*columns, (F.col("place") + 1).alias("rn"), "row")
    )
    return chosen.select(*columns, "rn", *[F.col("row")[c].alias(f"txn_{c}") for c in _ROW])


# --- One lookup for replies -------------------------------------------------

LOOKUP = ["user_id", "account_type", "kind", "arg"]


def lookup_request(intent: Column, entities: Column) -> tuple[Column, Column]:
    """(kind, arg) of the fact a reply needs; null kind when it needs none.

    A single date is the range from that day to itself, and beats a named range.
    """
    kind = (
        F.when(intent.isin("balance_inquiry", "account_balance"), "balance")
        .when(intent.isin("transaction_history", "account_transactions"), "recent")
        .when(intent == "date_transactions", "range")
        .when((intent == "specific_transaction") & entities["transaction_id"].isNotNull(), "id")
    )
    start, end = requested_range(entities)
    arg = (
        F.when(kind == "range", range_arg(start, end)).when(kind == "id", entities["transaction_id"]).otherwise("")
    )
    return kind, arg


def requested_range(entities: Column) -> tuple[Column, Column]:
    day, span = entities["date"], entities["date_range"]
    return F.coalesce(day, span["start"]), F.coalesce(day, span["end"])


def range_arg(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit(".."), end)


def facts(
    accounts: DataFrame, ledger: DataFrame, requests: DataFrame, hot_rows: int = HOT_ROWS, days: DataFrame | None = None
) -> DataFrame:
    """Everything the replies can quote, one row per (user, account, kind, arg).

    One keyed table instead of four lets messages be shuffled once for all
    lookups. ``requests`` holds the distinct (user_id, kind, start, end,
    transaction_id) users ask about (see ``answering.requests``); a question is
    answered for either account. Accounts and ledger are cut to the users who ask.
    ``days``, the ledger's ``daily_rows``, spares finding them: pass stored ones where facts are asked for again and again.
    """

    def askers(*kinds: str) -> DataFrame:
        return requests.filter(F.col("kind").isin(*kinds)).select("user_id").distinct()

    either = F.explode(F.array(*[F.lit(a) for a in catalogue.ACCOUNT_TYPES]))
    # the newest rows of all are those of the range from before every date to after it
    is_range = F.col("kind") == "range"
    ranges = requests.filter(F.col("kind").isin("recent", "range")).select(
        "user_id",
        either.alias("account_type"),
        F.when(is_range, F.col("start")).otherwise("").alias("start"),
        F.when(is_range, F.col("end")).otherwise("~").alias("end"),
    )
    listed = askers("recent", "range")
    own = daily_rows(ledger.join(listed, "user_id", "left_semi")) if days is None else days.join(listed, "user_id", "left_semi")
    whole = (F.col("start") == "") & (F.col("end") == "~")
    # a timeline holds days, of which there are no more than ledger rows
    busy = busy_accounts(ledger if days is None else own, ranges, hot_rows)
    listings = as_of(own, ranges, busy=busy, hot_rows=hot_rows).filter(F.size("rows") > 0).select(
        *ACCOUNT,
        F.when(whole, "recent").otherwise("range").alias("kind"),
        F.when(whole, "").otherwise(range_arg(F.col("start"), F.col("end"))).alias("arg"),
        bullet_list(F.transform("rows", signed_line)).alias("fact"),
    )

    # Only ledger rows somebody asks for; the first one where an id repeats.
    wanted = requests.filter(F.col("kind") == "id").select("user_id", F.col("transaction_id").alias("id"))
    by_id = (
        ledger.join(wanted.distinct(), ["user_id", "id"], "left_semi")
        .groupBy(*ACCOUNT, "id")
        .agg(F.min_by(detail_line(F.struct(*_ROW)), "pos").alias("fact"))
        .select(*ACCOUNT, F.lit("id").alias("kind"), F.col("id").alias("arg"), "fact")
    )
    balance = accounts.join(askers("balance"), "user_id", "left_semi").select(
        *ACCOUNT, F.lit("balance").alias("kind"), F.lit("").alias("arg"), F.col("balance").cast("string").alias("fact")
    )
    return balance.unionByName(listings).unionByName(by_id)
