"""The chat log and user tables: append, read back, clear, register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tellerflow.functions.prompts import strip
from tellerflow.operators.keyed_table import FOLDERS, KeyedTable
from tellerflow.sources import schemas

RECENT = 10
# The least lengths the registration form accepts.
MIN_USERNAME, MIN_PASSWORD = 3, 8


def valid_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """Messages stripped of surrounding whitespace; blank ones rejected."""
    return messages.withColumn(column, strip(F.col(column))).filter(F.col(column) != "")


def chat_rows(answered: DataFrame) -> DataFrame:
    """Answered messages as chat-log rows; the log keeps whole seconds."""
    return answered.select(
        F.col("event_id").alias("id"),
        "user_id",
        "message",
        "response",
        "intent",
        "confidence",
        # date_trunc would go through the session's time zone
        F.substring(F.col("ts").cast("string"), 1, 19).cast("timestamp_ntz").alias("timestamp"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


class ChatLog(KeyedTable):
    """The stored log, by user and time."""

    def __init__(self, spark: SparkSession, folder: str, folders: int = FOLDERS):
        super().__init__(spark, folder, schemas.CHAT_HISTORY, "user_id", ("timestamp", "id"), folders)

    def clear(self, users: DataFrame) -> None:
        """Remove the rows of the given users."""
        self.rewrite(users, lambda rows: clear_chats(rows, users))


def recent_chats(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` rows of every user in chronological order (``place`` 1 is
    the oldest shown). Each map task keeps its own last rows before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("id"))
    kept = log.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)
    shown = Window.partitionBy("user_id").orderBy(F.desc("rn"))
    return kept.withColumn("place", F.row_number().over(shown)).drop("rn")


def user_chats(log: DataFrame, user_id: int, n: int = RECENT) -> DataFrame:
    """The last ``n`` rows of one user; the filter reaches the scan."""
    return log.filter(F.col("user_id") == user_id).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def clear_chats(log: DataFrame, users: DataFrame) -> DataFrame:
    """The log without the rows of the given users."""
    return log.join(users.select("user_id").distinct(), "user_id", "left_anti")


def orphans(log: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user does not exist."""
    return log.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def find_user(users: DataFrame, username: str) -> DataFrame:
    return users.filter(F.col("username") == username)


def upsert_accounts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """An incoming account replaces the whole entry of the same user and type."""
    kept = existing.join(incoming.select("user_id", "account_type"), ["user_id", "account_type"], "left_anti")
    return kept.unionByName(incoming)


def merge_user_data(existing: Column, incoming: Column) -> Column:
    """A user's data map with the incoming entries replacing those of the same key."""
    kept = F.map_filter(existing, lambda k, _: ~F.map_contains_key(incoming, k))
    return F.coalesce(F.map_concat(kept, incoming), existing, incoming)


def check_registrations(requests: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Add ``status``: accepted, missing_field, too_short, password_mismatch or name_taken.

    ``requests`` has id (arrival order), username, has_password, passwords_match
    and, where known, password_length. The first valid request for a name wins. Winners are found
    by a pre-aggregated minimum and joined back on the unique id, so a name that
    everybody asks for is no hot spot.
    """
    short = F.length("username") < MIN_USERNAME
    if "password_length" in requests.columns:
        short = short | (F.col("password_length") < MIN_PASSWORD)
    checked = requests.withColumn(
        "problem",
        F.when((F.coalesce("username", F.lit("")) == "") | ~F.col("has_password"), "missing_field")
        .when(short, "too_short")
        .when(~F.col("passwords_match"), "password_mismatch"),
    )
    valid = checked.filter(F.col("problem").isNull())
    firsts = valid.groupBy("username").agg(F.min("id").alias("id"))
    if users is not None:
        firsts = firsts.join(users.select("username"), "username", "left_anti")
    winners = firsts.select("id", F.lit(True).alias("first"))
    status = F.coalesce("problem", F.when(F.col("first"), "accepted"), F.lit("name_taken"))
    return checked.join(winners, "id", "left").withColumn("status", status).drop("problem", "first")


def unique_users(requests: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The user rows created by a set of registrations."""
    accepted = check_registrations(requests, users).filter(F.col("status") == "accepted")
    return accepted.select("id", "username", "created_at")
