"""The dialogue as a Structured Streaming job.

Each micro-batch runs the batch plan. What a user's dialogue carried before the
batch enters as one *seed* row, placed on the timeline just before the user's
first new message; the windows then need no special case. After the batch the
state of the users seen in it is written as a small delta table, and every
``snapshot_every`` batches the deltas are folded into a snapshot, so a batch
reads one snapshot and a few deltas and no lineage grows. Both lie in folders by
a hash of the user: a batch reads only those its users fall into, and keeps
their rows before it looks for the newest ones. What a snapshot has taken in is
deleted with the next one.

A message without text gets the error reply and leaves no trace in the dialogue,
as in the batch job.

All outputs go to folders named after the batch id and are overwritten when a
batch is repeated after a failure, so the log holds every message once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tellerflow.functions.intents import with_base_intent
from tellerflow.operators import answering, chatlog, dialogue, ledger as lookups
from tellerflow.operators.timeline import HOT_ROWS, Trailing, along_timeline
from tellerflow.sources.files import read_optional, store
from tellerflow.sources.schemas import CHAT_HISTORY, MESSAGES

SNAPSHOT_EVERY = 20
HISTORY = 10
# Folders of the state tables.
BUCKETS = 16

_PENDING = "struct<type:string,amount:decimal(38,2),recipient:string,from_account:string>"
_ENTITIES = (
    "struct<account_type:string,transaction_id:string,date:string,date_range:struct<start:string,end:string>,"
    "amount:decimal(38,2),recipient:string>"
)
STATE = (
    "user_id bigint, event_id bigint, ts timestamp_ntz, state string, active_account string, "
    f"pending {_PENDING}, memory {_ENTITIES}, "
    f"history array<struct<user:string,bot:string,intent:string,entities:{_ENTITIES}>>"
)


class DialogueStream:
    """Answers a stream of messages (event_id, user_id, ts, message) under ``folder``.

    The ledger is reduced to its days once, with the first batch that this object takes; all batches read these.
    """

    def __init__(
        self, spark: SparkSession, folder: str, accounts: DataFrame, ledger: DataFrame,
        hot_rows: int = HOT_ROWS, snapshot_every: int = SNAPSHOT_EVERY,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.accounts, self.ledger = accounts, ledger
        self.days: DataFrame | None = None
        self.hot_rows, self.snapshot_every = hot_rows, snapshot_every

    # --- State tables --------------------------------------------------------

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch_id={batch_id}"

    def _write_state(self, rows: DataFrame, table: str, batch_id: int) -> None:
        placed = rows.withColumn("bucket", _bucket()).repartition("bucket")  # few files a folder
        placed.write.mode("overwrite").partitionBy("bucket").parquet(self._path(table, batch_id))

    def _delete(self, table: str, batch_id: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table, batch_id))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def state_before(self, batch_id: int, users: DataFrame | None = None) -> DataFrame:
        """The newest state row of every user, or of the given ``users(user_id)``, before a batch."""
        snapshot = batch_id // self.snapshot_every * self.snapshot_every - 1
        paths = [self._path("state", b) for b in range(snapshot + 1, batch_id)]
        if snapshot >= 0:
            paths.append(self._path("snapshot", snapshot))
        if not paths:
            return self.spark.createDataFrame([], STATE)
        # one reader a path: a folder by bucket each
        parts = [self.spark.read.schema(f"{STATE}, bucket int").parquet(p) for p in paths]
        rows = reduce(DataFrame.unionByName, parts)
        if users is not None:
            buckets = [r[0] for r in users.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
            rows = rows.filter(F.col("bucket").isin(*buckets)).join(users, "user_id", "left_semi")
        return _newest(rows.drop("bucket"))

    def _fold(self, batch_id: int) -> None:
        """A snapshot after this batch; what the one before has taken in goes."""
        delta = self.spark.read.schema(f"{STATE}, bucket int").parquet(self._path("state", batch_id)).drop("bucket")
        self._write_state(_newest(self.state_before(batch_id).unionByName(delta)), "snapshot", batch_id)
        # the newest deltas and the snapshot before stay: this batch may be repeated
        last = batch_id - self.snapshot_every
        for old in range(last - self.snapshot_every + 1, last + 1):
            if old >= 0:
                self._delete("state", old)
        if last - self.snapshot_every >= 0:
            self._delete("snapshot", last - self.snapshot_every)

    # --- One micro-batch -----------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        # Frames read several times are kept; a failing batch releases them too.
        kept: list[DataFrame] = []

        def keep(frame: DataFrame) -> DataFrame:
            kept.append(frame.persist())
            return kept[-1]

        try:
            self._process(batch, batch_id, keep)
        finally:
            for frame in kept:
                frame.unpersist()

    def _process(self, batch: DataFrame, batch_id: int, keep: Callable[[DataFrame], DataFrame]) -> None:
        batch = keep(batch.select("event_id", "user_id", "ts", "message"))
        users = batch.select("user_id").distinct()
        state = keep(self.state_before(batch_id, users))
        last = state.select("user_id", F.struct("ts", "event_id").alias("last"))
        placed = batch.filter(F.col("message").isNotNull()).join(last, "user_id", "left")
        is_late = F.coalesce(F.struct("ts", "event_id") <= F.col("last"), F.lit(False))
        late = placed.filter(is_late).drop("last")
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(self._path("late", batch_id))

        understood = keep(with_base_intent(placed.filter(~is_late).drop("last")))
        tracked = keep(dialogue.track(_with_seeds(understood, state), self.hot_rows).filter(F.col("seed").isNull()))
        if self.days is None:
            self.days = store(lookups.daily_rows(self.ledger), "days")
        # stored: read by every part of the facts, and small
        requests = store(answering.requests(understood), "requests")
        facts = lookups.facts(self.accounts, self.ledger, requests, days=self.days)
        answered = keep(answering.with_response(tracked, facts))

        rows = answered.unionByName(answering.failed(batch), allowMissingColumns=True)
        chatlog.chat_rows(rows).write.mode("overwrite").parquet(self._path("chat_log", batch_id))
        self._write_state(self._state_after(answered, state), "state", batch_id)
        if batch_id % self.snapshot_every == self.snapshot_every - 1:
            self._fold(batch_id)

    def _state_after(self, answered: DataFrame, before: DataFrame) -> DataFrame:
        """The state of the batch's users: their last message's row, with history."""
        steps = lambda f: f.derive(recent=Trailing(dialogue.exchange(), HISTORY)).rows
        rows = along_timeline(answered, steps, hot_rows=self.hot_rows)  # answered is stored
        memory = F.struct(*[F.col(f"memory_{f}").alias(f) for f in dialogue.ENTITY_FIELDS])
        last = _newest(
            rows.select("user_id", "event_id", "ts", "state", "active_account", "pending", memory.alias("memory"), "recent")
        )
        earlier = before.select("user_id", F.col("history").alias("earlier"))
        joined = last.join(earlier, "user_id", "left")
        both = F.concat(F.coalesce("earlier", F.array().cast(last.schema["recent"].dataType)), "recent")
        history = F.slice(both, F.greatest(F.size(both) - HISTORY + 1, F.lit(1)), HISTORY)
        return joined.select(*last.drop("recent").columns, history.alias("history"))

    # --- Running -------------------------------------------------------------

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """Start on a streaming DataFrame; ``trigger`` as for ``writeStream.trigger``."""
        writer = (
            messages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
        )
        return (writer.trigger(**trigger) if trigger else writer).start()

    def chat_log(self) -> DataFrame:
        found = read_optional(self.spark, f"{self.folder}/chat_log", CHAT_HISTORY, "parquet")
        return self.spark.createDataFrame([], CHAT_HISTORY) if found is None else found.select(*CHAT_HISTORY.names)

    def late_rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/late")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], MESSAGES)
        return self.spark.read.parquet(f"{self.folder}/late").drop("batch_id")


def _bucket() -> Column:
    return F.pmod(F.hash("user_id"), F.lit(BUCKETS)).alias("bucket")


def _newest(state: DataFrame) -> DataFrame:
    """The newest row of every user; each map task keeps one before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return state.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def _with_seeds(understood: DataFrame, state: DataFrame) -> DataFrame:
    """Messages and one seed row per known user.

    The seed poses as the message that left the dialogue where it stands: it
    names the active account and, if a question is pending, the transfer.
    """
    asks = F.col("state").isin("awaiting_amount", "awaiting_confirmation")
    carried = F.struct(
        F.col("active_account").alias("account_type"),
        F.lit(None).cast("string").alias("transaction_id"),
        F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("struct<start:string,end:string>").alias("date_range"),
        F.col("pending.amount").alias("amount"),
        F.col("pending.recipient").alias("recipient"),
    )
    kind = understood.schema
    seeds = state.select(
        "event_id",
        "user_id",
        "ts",
        F.lit("").alias("message"),
        carried.cast(kind["entities"].dataType).alias("entities"),
        F.struct(F.lit(False).alias("account"), F.lit(False).alias("amount"), F.lit(None).cast("string").alias("confirmation"))
        .cast(kind["answers"].dataType)
        .alias("answers"),
        F.when(asks, "transfer_money").otherwise("greeting").alias("base_intent"),
        F.lit(0.0).alias("base_confidence"),
        F.col("state").alias("base_state"),
        F.struct("pending", "memory").alias("seed"),
    )
    return understood.unionByName(seeds, allowMissingColumns=True)
