"""The dialogue as a Structured Streaming job over Spark's own keyed state.

What a user's dialogue carries from message to message lies in Spark's state store (RocksDB, with the
changelog and snapshots of the query's checkpoint). All rules stay column expressions: where a message is read it
is given its entities, the intent it has by itself and the intents it would have as the answer to each pending
question. The stateful step picks one of these and carries state, account, pending transfer and entity memory on.
Replies then need the ledger, which is joined per micro-batch; the log is written per batch id, and overwritten
when a batch is repeated.

Late messages (older than the user's last one) go to a table of their own. A message without text gets the
error reply and leaves no trace. The stateful step takes a user's messages of one batch in one task: limit the
batch by the source (``maxFilesPerTrigger``). For batches in which one user sends more than a task can sort use
``dialogue_stream``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tellerflow.functions.intents import follow_up, with_base_intent
from tellerflow.operators import answering, chatlog, ledger as lookups
from tellerflow.operators.dialogue import ENTITY_FIELDS
from tellerflow.sources import catalogue
from tellerflow.sources.files import read_optional, store
from tellerflow.sources.schemas import CHAT_HISTORY, MESSAGES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

# What a message is by itself, flat, so that little is converted on the way to Python and back.
FLAT = {
    "account_type": "string", "transaction_id": "string", "date": "string", "range_start": "string", "range_end": "string",
    "amount": "decimal(38,2)", "recipient": "string",
}
STATE = (
    "ts timestamp_ntz, event_id bigint, state string, active_account string, asked_amount decimal(38,2), asked_recipient string, "
    "pending_type string, pending_amount decimal(38,2), pending_recipient string, pending_from string, "
    + ", ".join(f"memory_{f} {t}" for f, t in FLAT.items())
)
# On the way to Python and back a message has few columns, as each costs there by row and by user: what it is by
# itself is one list of texts, and what the dialogue makes of it another.
OWN = [*FLAT, "base_intent", "base_confidence", "base_state", "if_amount", "if_confirmation"]
TOLD = {
    "intent": "string", "confidence": "double", "state": "string", "active_account": "string", "account_before": "string",
    "pending_amount": "decimal(38,2)", "pending_recipient": "string",
}
SCORED = "user_id bigint, event_id bigint, ts timestamp_ntz, message string, own array<string>, told array<string>, late boolean"


def prepared(messages: DataFrame) -> DataFrame:
    """Messages with all that the rules say about each by itself."""
    e = F.col("entities")
    flat = {f: e[f] for f in ENTITY_FIELDS if f != "date_range"} | {"range_start": e["date_range"]["start"], "range_end": e["date_range"]["end"]}
    own = {f: flat[f].cast(t) for f, t in FLAT.items()} | {
        "if_amount": follow_up(F.lit("awaiting_amount"), F.col("answers")),
        "if_confirmation": follow_up(F.lit("awaiting_confirmation"), F.col("answers"))}
    texts = [own.get(f, F.col(f)).cast("string") for f in OWN]
    return with_base_intent(messages.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "message")).select(
        "event_id", "user_id", "ts", "message", F.array(*texts).alias("own"))


def opened(scored: DataFrame) -> DataFrame:
    """What the stateful step returns, a column each."""
    return scored.select(
        "user_id", "event_id", "ts", "message",
        *[F.get("own", F.lit(OWN.index(f))).cast(t).alias(f) for f, t in (FLAT | {"base_intent": "string"}).items()],
        *[F.get("told", F.lit(k)).cast(t).alias(f) for k, (f, t) in enumerate(TOLD.items())],
        "late")


ACCOUNT, AMOUNT, RECIPIENT = (OWN.index(f) for f in ("account_type", "amount", "recipient"))


def _place(ts: Any, event_id: int) -> tuple:
    """Messages in the order of a timeline, those without a time first."""
    return (ts is not None, ts, event_id) if ts is not None else (False, 0, event_id)


class Dialogue(StatefulProcessor):
    """One user's dialogue: picks the intent of each message and carries the rest."""

    def __init__(self, default_account: str = catalogue.DEFAULT_ACCOUNT):
        self.default_account = default_account
        self.row = Row(*[field.split(" ")[0] for field in SCORED.split(", ")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("dialogue", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.carried.get() if self.carried.exists() else None
        ts, event, state, active, asked_amount, asked_recipient, *rest = found or (None, None, None, None, None, None, *[None] * 11)
        pending, memory, last = tuple(rest[:4]), list(rest[4:]), _place(ts, event) if found else None
        for user, event_id, at, message, own in sorted(
                ((r.user_id, r.event_id, r.ts, r.message, r.own) for r in rows), key=lambda r: _place(r[2], r[1])):
            entities = own[:len(FLAT)]
            entities[AMOUNT] = amount = None if own[AMOUNT] is None else Decimal(own[AMOUNT])
            account, recipient = entities[ACCOUNT], entities[RECIPIENT]
            base_intent, base_confidence, base_state, if_amount, if_confirmation = own[len(FLAT):]
            if message is None or (found and _place(at, event_id) <= last):
                yield self.row(user, event_id, at, message, own, None, message is not None)
                continue
            answer = {"awaiting_amount": if_amount, "awaiting_confirmation": if_confirmation}.get(state)
            intent = answer or base_intent
            before = active or self.default_account
            active = account or before
            state = base_state if not answer else "transfer_completed" if answer == "confirmation_yes" else "initial"
            of_transfer = (asked_amount, asked_recipient) if answer else (None, None)
            if intent == "transfer_money" and (amount is not None or recipient is not None):
                pending = ("transfer", amount, recipient, active if amount is not None and recipient is not None else None)
            elif intent == "amount_specification" and amount is not None:
                pending = ("transfer", amount, of_transfer[1], None)
            elif intent == "confirmation_no":
                pending = (None,) * 4
            asked_amount, asked_recipient = (amount, recipient) if base_intent == "transfer_money" else (None, None)
            memory = [new if new is not None else old for new, old in zip(entities, memory)]
            ts, event = at, event_id
            told = [intent, "0.9" if answer else base_confidence, state, active, before,
                    None if of_transfer[0] is None else str(of_transfer[0]), of_transfer[1]]
            yield self.row(user, event_id, at, message, own, told, False)
        if state is not None:
            self.carried.update((ts, event, state, active, asked_amount, asked_recipient, *pending, *memory))

    def close(self) -> None:
        pass


class KeyedDialogue:
    """Answers a stream of messages (event_id, user_id, ts, message) under ``folder``.

    The ledger is reduced to its days once, with the first batch that this object takes; all batches read these.
    """

    def __init__(self, spark: SparkSession, folder: str, accounts: DataFrame, ledger: DataFrame):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.accounts, self.ledger = accounts, ledger
        self.days: DataFrame | None = None

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.folder}/{table}/batch_id={batch_id}"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Answer one batch of scored messages."""
        # written first: read several times, and the stateful step runs once
        path = self._path("scored", batch_id)
        batch = opened(batch)
        batch.write.mode("overwrite").parquet(path)
        scored = self.spark.read.schema(batch.schema).parquet(path)
        late = scored.filter("late").select("event_id", "user_id", "ts", "message")
        late.write.mode("overwrite").parquet(self._path("late", batch_id))

        span = F.struct(F.col("range_start").alias("start"), F.col("range_end").alias("end"))
        entities = F.struct(
            *[F.when(F.col("range_start").isNotNull(), span).alias(f) if f == "date_range" else F.col(f) for f in ENTITY_FIELDS])
        kept = scored.filter("NOT late AND message IS NOT NULL").withColumn("entities", entities).drop(*FLAT, "late")
        if self.days is None:
            self.days = store(lookups.daily_rows(self.ledger), "days")
        # stored: read by every part of the facts, and small
        facts = lookups.facts(self.accounts, self.ledger, store(answering.requests(kept), "requests"), days=self.days)
        answered = answering.with_response(kept, facts)
        failed = answering.failed(scored.select("event_id", "user_id", "ts", "message"))
        rows = chatlog.chat_rows(answered.unionByName(failed, allowMissingColumns=True))
        rows.write.mode("overwrite").parquet(self._path("chat_log", batch_id))

    def scored(self, messages: DataFrame) -> DataFrame:
        return prepared(messages).groupBy("user_id").transformWithState(
            statefulProcessor=Dialogue(), outputStructType=SCORED, outputMode="append", timeMode="none")

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """Start on a streaming DataFrame; ``trigger`` as for ``writeStream.trigger``."""
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKSDB)
        try:
            writer = (
                self.scored(messages).writeStream.outputMode("append").foreachBatch(self.process)
                .option("checkpointLocation", f"{self.folder}/checkpoint")
            )
            return (writer.trigger(**trigger) if trigger else writer).start()
        finally:
            self.spark.conf.set(PROVIDER, before)

    def chat_log(self) -> DataFrame:
        found = read_optional(self.spark, f"{self.folder}/chat_log", CHAT_HISTORY, "parquet")
        return self.spark.createDataFrame([], CHAT_HISTORY) if found is None else found.select(*CHAT_HISTORY.names)

    def late_rows(self) -> DataFrame:
        found = read_optional(self.spark, f"{self.folder}/late", MESSAGES, "parquet")
        return self.spark.createDataFrame([], MESSAGES) if found is None else found.select(*MESSAGES.names)

    def state(self) -> DataFrame:
        """Where every user's dialogue stands after the last batch, from the query's checkpoint."""
        reader = self.spark.read.format("statestore").option("stateVarName", "dialogue")
        return reader.load(f"{self.folder}/checkpoint").select("key.user_id", "value.*")
