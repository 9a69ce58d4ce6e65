"""The job over Spark's keyed state gives what the batch gives, also after a restart."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tellerflow.operators import answering, chatlog, dialogue
from tellerflow.sources import tables
from tellerflow.streaming.keyed_dialogue import KeyedDialogue


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return tables.utterances(spark, sf_dir), tables.accounts(spark, sf_dir), tables.ledger(spark, sf_dir)


def feed(spark, folder, messages, accounts, ledger, parts):
    """Write each part as one file, and let a new job (a restart, but for the first) take what is there."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    job = KeyedDialogue(spark, f"{folder}/out", accounts, ledger)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    job.start(stream, availableNow=True).awaitTermination()
    return job


def rows(df):
    return {r.id: r for r in df.select("id", "user_id", "message", "response", "intent", "confidence", "timestamp").collect()}


def test_stream_equals_batch_after_restarts(spark, tmp_path, inputs):
    messages, accounts, ledger = inputs
    odd = messages.withColumn("message", F.expr("CASE event_id % 11 WHEN 3 THEN NULL WHEN 5 THEN '  ' ELSE message END"))
    part = lambda low, high: odd.filter(F.col("event_id").between(low, high))
    feed(spark, tmp_path, odd, accounts, ledger, [part(0, 199), part(200, 449)])
    job = feed(spark, tmp_path, odd, accounts, ledger, [part(450, 999)])
    assert rows(job.chat_log()) == rows(chatlog.chat_rows(answering.answer(odd, accounts, ledger)))
    assert job.late_rows().count() == 0
    # the state is where the batch plan ends
    ends = dialogue.track(odd.filter("message IS NOT NULL")).groupBy("user_id").agg(
        F.max_by(F.struct("state", "active_account", "pending", "memory_recipient", "memory_date_range"), F.struct("ts", "event_id")).alias("e"))
    state = {r.user_id: r for r in job.state().collect()}
    found = ends.collect()
    assert {r.user_id for r in found} == set(state)
    for r in found:
        s, e = state[r.user_id], r.e
        assert (s.state, s.active_account, s.memory_recipient) == (e.state, e.active_account, e.memory_recipient)
        assert (s.memory_range_start, s.memory_range_end) == tuple(e.memory_date_range or (None, None))
        assert (s.pending_type, s.pending_amount, s.pending_recipient, s.pending_from) == tuple(e.pending or (None,) * 4)


def test_late_messages_and_messages_without_time_or_user(spark, tmp_path, inputs):
    messages, accounts, ledger = inputs
    odd = messages.withColumns({
        "ts": F.when(F.col("event_id") % 50 != 7, F.col("ts")), "user_id": F.when(F.col("event_id") % 40 != 9, F.col("user_id"))})
    feed(spark, tmp_path, odd, accounts, ledger, [odd.filter("event_id >= 500")])
    job = feed(spark, tmp_path, odd, accounts, ledger, [odd.filter("event_id < 500")])
    seen = {r.user_id for r in odd.filter("event_id >= 500").select("user_id").distinct().collect()}
    expected = {r.event_id for r in odd.filter("event_id < 500").collect() if r.user_id in seen}
    assert {r.event_id for r in job.late_rows().collect()} == expected
    logged = job.chat_log()
    assert logged.count() == logged.select("id").distinct().count() == 1000 - len(expected)


@pytest.mark.parametrize("name", ["dialogue_stream"])
def test_registered_streams_take_messages_without_time_and_none_at_all(spark, tmp_path, sf_dir, name):
    events = pq.read_table(f"{sf_dir}/events.parquet")
    place = events.schema.get_field_index("ts")
    ts = pa.array([None if i % 10 == 3 else t for i, t in enumerate(events["ts"].to_pylist())], events.schema.field("ts").type)
    for kind, rows in (("some", events.set_column(place, events.schema.field("ts"), ts)), ("none", events.slice(0, 0))):
        folder = f"{tmp_path}/{kind}"
        os.mkdir(folder)
        for file in os.listdir(sf_dir):
            if file != "events.parquet":
                os.symlink(f"{sf_dir}/{file}", f"{folder}/{file}")
        pq.write_table(rows, f"{folder}/events.parquet")
        got = entry.queries()[name](spark, folder)
        assert got.count() == rows.num_rows
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in entry.queries()["chat_log"](spark, folder).select(*got.columns).collect()}


@pytest.mark.parametrize("name", ["dialogue_stream", "sliced_dialogue_stream"])
def test_streams_reduce_the_ledger_once(spark, sf_dir, monkeypatch, name):
    """Five batches, one pass that finds the ledger's rows a day; the log is the batch's."""
    from tellerflow.operators import ledger

    calls, inner = [], ledger.daily_rows
    monkeypatch.setattr(ledger, "daily_rows", lambda *a, **k: calls.append(1) or inner(*a, **k))
    got = entry.queries()[name](spark, sf_dir)
    found = {tuple(r) for r in got.collect()}
    assert len(calls) == 1
    assert found == {tuple(r) for r in entry.queries()["chat_log"](spark, sf_dir).select(*got.columns).collect()}
