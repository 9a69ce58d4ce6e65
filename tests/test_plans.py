"""Plans: no Python in the core, one exchange per dialogue, pruned scans."""

import re

import pytest

import __spark_entry__ as entry
from tellerflow.functions.intents import with_base_intent
from tellerflow.operators import answering, ledger as ledgers
from tellerflow.sources import files, tables


def plan(df, mode="simple"):
    return df._jdf.queryExecution().explainString(
        df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES) - {"dialogue_stream", "sliced_dialogue_stream", "model_answers", "model_dialogue"}))
def test_no_python_workers_and_no_cross_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
        assert operator not in text, operator


@pytest.mark.parametrize("name", ["dialogue_state", "active_account", "pending_action", "entity_memory"])
def test_dialogue_shuffles_once(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", text)) == 1
    assert text.count("Exchange ") == 1


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(entry.queries()["intent_mapping"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: (\S+)", text)
    assert sum("text" in s for s in schemas) <= 1
    text = plan(entry.queries()["locale_map"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_top_rows_are_cut_before_the_shuffle(spark, sf_dir):
    for name in ("recent_txns", "render_history"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert re.search(r"Exchange[^\n]*\n[^\n]*WindowGroupLimit", text), name


def test_generated_code_stays_below_the_compiler_limit(spark, sf_dir):
    """Methods over 8000 bytes of code are never compiled by the JIT."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("dialogue_state", "render_response", "clean_documents", "extract_entities"):
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan(entry.queries()[name](spark, sf_dir), "codegen"))
            assert max(map(int, sizes)) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_replies_extract_once_and_join_only_what_needs_a_fact(spark, sf_dir, monkeypatch):
    from tellerflow.functions.entities import TRANSACTION_ID
    from tellerflow.operators import answering

    stored, store = [], answering.store

    def watched(frame, name):
        stored.append(plan(frame))
        return store(frame, name)

    monkeypatch.setattr(answering, "store", watched)
    text = plan(entry.QUERIES["render_response"](spark, sf_dir))
    assert sum(t.count(TRANSACTION_ID) for t in [*stored, text]) == 1
    # day listings: once by day, once by account
    listings = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "account_type" in line]
    by_day = [x for x in listings if re.search(r"hashpartitioning\(user_id#\d+L?, account_type#\d+, date#\d+, \d+\)", x)]
    by_account = [x for x in listings if re.search(r"hashpartitioning\(user_id#\d+L?, account_type#\d+, \d+\)", x)]
    assert len(by_day) <= 1 and len(by_account) <= 1
    # users who ask, for the days, the rows by id and the balances; one join for the facts, below one side of a union
    assert text.count("LeftSemi") >= 3 and text.count("LeftOuter") == 1


def test_log_queries_read_the_stored_log(spark, sf_dir):
    for name in ("chat_history_top10", "chat_orphans", "chat_cleared", "latest_chats"):
        text = plan(entry.QUERIES[name](spark, sf_dir))
        assert "ReadSchema: struct<id:bigint" in text and "fact" not in text and "entities" not in text, name


def first_above(text, scan, names):
    """The first of the named steps above each scan of a table."""
    lines, found = text.splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "FileScan" in line and scan in line:
            level = depth(line)
            for above in reversed(lines[:at]):
                if depth(above) < level:
                    level = depth(above)
                    if any(n in above for n in names):
                        found.append(next(n for n in names if n in above))
                        break
            else:
                found.append(None)
    return found


def test_bucketed_accounts_and_ledger_are_not_shuffled(spark, sf_dir):
    ledger = files.store_bucketed(tables.ledger(spark, sf_dir), "ledger", "user_id", 16, ("account_type", "date"))
    accounts = files.store_bucketed(tables.accounts(spark, sf_dir), "accounts", "user_id", 16, ("account_type",))
    asked = files.store(answering.requests(with_base_intent(tables.utterances(spark, sf_dir))), "asked")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "Exchange" not in plan(ledgers.account_history(accounts, ledger))
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        text = plan(found := ledgers.facts(accounts, ledger, asked))
        assert first_above(text, "default.ledger_", ["Exchange", "Aggregate"]) == ["Aggregate", "Aggregate"]
        assert first_above(text, "default.accounts_", ["Exchange", "Union"]) == ["Union"]
        plainly = ledgers.facts(tables.accounts(spark, sf_dir), tables.ledger(spark, sf_dir), asked)
        assert sorted(map(str, found.collect())) == sorted(map(str, plainly.collect()))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
