"""The streaming job gives what the batch gives, also in several batches."""

import pytest
from pyspark.sql import functions as F

from tellerflow.operators import answering, chatlog
from tellerflow.sources import tables
from tellerflow.streaming.dialogue_stream import DialogueStream


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return tables.utterances(spark, sf_dir), tables.accounts(spark, sf_dir), tables.ledger(spark, sf_dir)


def run(spark, folder, source, messages, accounts, ledger, **options):
    job = DialogueStream(spark, folder, accounts, ledger, **options)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    job.start(stream, availableNow=True).awaitTermination()
    return job


def rows(df):
    return {r.id: r for r in df.select("id", "user_id", "message", "response", "intent", "confidence", "timestamp").collect()}


def test_stream_equals_batch(spark, tmp_path, inputs):
    """Four batches in time order, with a snapshot after every second."""
    messages, accounts, ledger = inputs
    for low in range(0, 1000, 250):
        part = messages.filter(F.col("event_id").between(low, low + 249))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    job = run(spark, f"{tmp_path}/out", f"{tmp_path}/in", messages, accounts, ledger, snapshot_every=2)
    batch = answering.answer(messages, accounts, ledger)
    assert rows(job.chat_log()) == rows(chatlog.chat_rows(batch))
    assert job.late_rows().count() == 0
    state = {r.user_id: r for r in job.state_before(4).collect()}
    from tellerflow.operators import dialogue

    history = dialogue.history(batch, 10)
    last = history.groupBy("user_id").agg(F.max_by("history", F.struct("ts", "event_id")).alias("history"))
    assert {u: s.history for u, s in state.items()} == {r.user_id: r.history for r in last.collect()}
    tracked = dialogue.track(messages)
    ends = tracked.groupBy("user_id").agg(
        F.max_by(F.struct("state", "active_account", "pending", "memory_recipient"), F.struct("ts", "event_id")).alias("e")
    )
    for r in ends.collect():
        s = state[r.user_id]
        assert (s.state, s.active_account, s.pending, s.memory.recipient) == tuple(r.e)


def test_late_rows_and_repeated_batches(spark, tmp_path, inputs):
    messages, accounts, ledger = inputs
    job = DialogueStream(spark, str(tmp_path), accounts, ledger)
    job.process(messages.filter("event_id >= 500"), 0)
    job.process(messages.filter("event_id < 600"), 1)
    job.process(messages.filter("event_id < 600"), 1)
    seen = {r.user_id for r in messages.filter("event_id >= 500").select("user_id").distinct().collect()}
    late = {r.event_id for r in job.late_rows().collect()}
    expected = {r.event_id for r in messages.filter("event_id < 600").collect() if r.user_id in seen}
    assert late == expected
    logged = job.chat_log()
    assert logged.count() == logged.select("id").distinct().count() == 1000 - len(expected) + len(
        {i for i in expected if i >= 500})


def test_messages_without_text_or_blank_are_as_in_the_batch(spark, tmp_path, inputs):
    messages, accounts, ledger = inputs
    odd = messages.withColumn("message", F.expr("CASE event_id % 9 WHEN 3 THEN NULL WHEN 5 THEN '  ' WHEN 7 THEN concat(' ', message) ELSE message END"))
    job = DialogueStream(spark, str(tmp_path), accounts, ledger)
    job.process(odd.filter("event_id < 500"), 0)
    job.process(odd.filter("event_id >= 500"), 1)
    assert rows(job.chat_log()) == rows(chatlog.chat_rows(answering.answer(odd, accounts, ledger)))


def test_state_is_read_for_the_batch_only_and_old_state_goes(spark, tmp_path, inputs):
    import os

    messages, accounts, ledger = inputs
    job = DialogueStream(spark, str(tmp_path), accounts, ledger, snapshot_every=2)
    for number in range(7):
        job.process(messages.filter(F.col("event_id").between(number * 100, number * 100 + 99)), number)
    assert sorted(os.listdir(f"{tmp_path}/state")) == ["batch_id=4", "batch_id=5", "batch_id=6"]
    assert sorted(os.listdir(f"{tmp_path}/snapshot")) == ["batch_id=3", "batch_id=5"]
    assert not os.path.exists(f"{tmp_path}/late")
    few = messages.filter("user_id = 3").select("user_id").distinct()
    frame = job.state_before(7, few)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text and text.index("Window") < text.index("LeftSemi")
    assert "PartitionFilters: [bucket" in frame._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket#", "bucket#").replace(
        "PartitionFilters: [(bucket", "PartitionFilters: [bucket")
    assert {r.user_id for r in frame.collect()} <= {3}


def test_a_failing_batch_releases_its_frames(spark, tmp_path, inputs):
    messages, accounts, ledger = inputs
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    job = DialogueStream(spark, str(tmp_path), accounts.drop("balance"), ledger)
    with pytest.raises(Exception):
        job.process(messages, 0)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
