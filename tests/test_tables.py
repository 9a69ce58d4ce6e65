"""Files, catalogues, generators, corpus and the chat-log tables."""

import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from tellerflow.operators import chatlog, corpus
from tellerflow.sources import catalogue, files, schemas
from tellerflow.sources.generate import GENERATORS, generate, generate_all


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    texts = ['a "quoted", b', "two\nlines", " padded ", "", None, "crlf\r\nend", "back\\slash", 'ends with "']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    files.write_csv(df, f"{tmp_path}/csv")
    back = files.read_csv(spark, f"{tmp_path}/csv", df.schema)
    assert [r.text for r in back.orderBy("id").collect()] == texts
    converted = files.to_parquet(spark, f"{tmp_path}/csv", df.schema, f"{tmp_path}/parquet")
    assert converted.count() == len(texts)


def test_missing_tables_are_skipped(spark, tmp_path, caplog):
    rows = generate("faqs", spark.range(1, 8))
    files.write_csv(rows, f"{tmp_path}/faqs.csv")
    with caplog.at_level(logging.WARNING):
        found = files.read_bulk_tables(spark, str(tmp_path))
    assert list(found) == ["faqs"] and "skipped" in caplog.text
    built = corpus.training_corpus(found)
    assert [r.intent for r in built.select("intent").distinct().collect()] == ["faq"]
    with pytest.raises(ValueError):
        corpus.training_corpus({})


def test_intents_file_and_fallback(spark, tmp_path):
    path = tmp_path / "intents.json"
    path.write_text('{"intents": [\n {"tag": "a", "patterns": ["p", "q"], "responses": ["r"]},\n'
                    ' {"tag": "a", "patterns": ["z"], "responses": ["s"]}]}')
    documents = files.read_intents(spark, str(path))
    assert [(r.tag, r.place, r.pattern) for r in files.intent_patterns(documents).collect()] == [
        ("a", 0, "p"), ("a", 1, "q"), ("a", 0, "z")
    ]
    assert [(r.tag, r.templates) for r in files.intent_responses(documents).collect()] == [("a", ["r"])]
    fallback = files.read_intents(spark, f"{tmp_path}/none.json")
    assert {r.tag for r in files.intent_responses(fallback).collect()} == set(catalogue.INTENT_TAGS)


def test_template_file(spark, tmp_path):
    path = tmp_path / "templates.json"
    path.write_text('{"greeting": ["Hello", "Hi"],\n "fallback": ["What?"]}')
    rows = files.read_templates(spark, str(path)).collect()
    assert {(r.intent, r.place, r.template) for r in rows} == {
        ("greeting", 0, "Hello"), ("greeting", 1, "Hi"), ("fallback", 0, "What?")
    }


def test_generated_tables_match_their_schemas_and_domains(spark, tmp_path):
    generate_all(spark, str(tmp_path), n=500)
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in GENERATORS}
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.BULK[name]], name
        assert df.count() == 500
        key = GENERATORS[name][0]
        assert df.agg(F.min(key), F.max(key), F.countDistinct(key)).first()[:] == (1, 500, 500)
    as_of = dt.date(2025, 5, 10)
    for born, in tables["user_details"].select("date_of_birth").collect():
        age = as_of.year - born.year - ((as_of.month, as_of.day) < (born.month, born.day))
        assert 18 <= age <= 90
    low, high = tables["loans"].agg(F.min("interest_rate"), F.max("interest_rate")).first()
    assert 7 <= low and high <= 15
    assert tables["transaction_details"].agg(F.max(F.length("description"))).first()[0] <= 50
    assert tables["assistance"].agg(F.max(F.length("query"))).first()[0] <= 150
    first = [(r.question, r.answer) for r in tables["faqs"].orderBy("question_id").limit(5).collect()]
    assert first == catalogue.FAQ_PAIRS
    assert {(r.question, r.answer) for r in tables["faqs"].collect()} == set(catalogue.FAQ_PAIRS)


def test_generated_values_do_not_depend_on_partitioning(spark):
    one = generate("loans", spark.range(1, 200, 1, 1)).collect()
    many = generate("loans", spark.range(1, 200).repartition(7)).orderBy("loan_id").collect()
    assert one == many
    other = generate("loans", spark.range(1, 200, 1, 1), seed=7).collect()
    assert one != other


def test_summary_pairs_each_intent_with_its_own_reply(spark):
    tables = {
        "faqs": spark.createDataFrame([(2, "q", "two"), (1, "q", "one")], "question_id int, question string, answer string"),
        "complaints": spark.createDataFrame([(i, "late") for i in range(5)], "complaint_id int, description string"),
    }
    reply = catalogue.CORPUS_SOURCES[1][3]
    expected = [("complaint", 5, reply), ("faq", 2, "one")]
    assert [tuple(r) for r in corpus.intent_mapping(tables).collect()] == expected
    assert [tuple(r) for r in corpus.summarize(corpus.training_corpus(tables)).collect()] == expected


def test_registrations(spark):
    rows = [(1, "ann", True, True), (2, "ann", True, True), (3, "", True, True), (4, "bob", False, True),
            (5, "bob", True, False), (6, "bob", True, True), (7, "eve", True, True), (8, None, True, True)]
    requests = spark.createDataFrame(rows, "id long, username string, has_password boolean, passwords_match boolean")
    known = spark.createDataFrame([(0, "eve")], "id long, username string")
    status = {r.id: r.status for r in chatlog.check_registrations(requests, known).collect()}
    assert status == {1: "accepted", 2: "name_taken", 3: "missing_field", 4: "missing_field", 5: "password_mismatch",
                      6: "accepted", 7: "name_taken", 8: "missing_field"}
    assert chatlog.find_user(known, "eve").count() == 1


def test_log_of_one_user_and_append(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, f"m{i}", "r", "greeting", 0.5, start + dt.timedelta(seconds=i // 4)) for i in range(40)]
    log = spark.createDataFrame(rows, schemas.CHAT_HISTORY)
    chatlog.append(log.filter("id < 20"), f"{tmp_path}/log")
    chatlog.append(log.filter("id >= 20"), f"{tmp_path}/log")
    stored = spark.read.schema(schemas.CHAT_HISTORY).parquet(f"{tmp_path}/log")
    assert stored.count() == 40
    assert [r.id for r in chatlog.user_chats(stored, 1).collect()] == [39, 37, 35, 33, 31, 29, 27, 25, 23, 21]
    shown = chatlog.recent_chats(stored).filter("user_id = 0").orderBy("place").collect()
    assert [r.id for r in shown] == [20, 22, 24, 26, 28, 30, 32, 34, 36, 38]
    assert chatlog.clear_chats(stored, spark.createDataFrame([(1,)], "user_id long")).count() == 20


def test_blank_messages_are_rejected(spark):
    rows = [(1, " a b \n"), (2, " \t"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id int, message string")
    assert [(r.id, r.message) for r in chatlog.valid_messages(df).collect()] == [(1, "a b")]


def test_build_from_csv_files(spark, tmp_path):
    """Generated tables as CSV, two of them missing, to corpus and summary."""
    for name in set(GENERATORS) - {"complaints", "loans"}:
        files.write_csv(generate(name, spark.range(1, 41)), f"{tmp_path}/in/{name}.csv")
    found = corpus.build(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert set(found) == set(GENERATORS) - {"complaints", "loans"}
    users = spark.read.parquet(f"{tmp_path}/out/processed_user_details")
    assert users.count() == 40 and users.columns == [f.name for f in schemas.BULK["user_details"]]
    assert users.filter(F.col("address").contains("\n")).count() == 40
    faqs = spark.read.parquet(f"{tmp_path}/out/processed_faqs")
    assert {"processed_question", "processed_answer", "question", "answer"} <= set(faqs.columns)
    summary = {r.intent: (r["count"], r.sample_response)
               for r in spark.read.parquet(f"{tmp_path}/out/intent_mapping").collect()}
    assert set(summary) == {"faq", "assistance", "fraud", "transaction"}
    assert summary["faq"] == (40, "visit nearest branch required document apply online website")
    replies = {intent: reply for intent, _, _, reply in catalogue.CORPUS_SOURCES}
    assert summary["fraud"] == (40, replies["fraud"])


def test_draws_are_even(spark):
    """Loan amounts over ten equal bins, to one percent; user ids reach every user and none beyond."""
    loans = generate("loans", spark.range(1, 400_001), users=1000)
    low, width = 100_000, (10_000_000 - 100_000) / 10
    bins = loans.groupBy(F.least(F.floor((F.col("amount") - low) / width), F.lit(9)).alias("bin")).count().collect()
    assert len(bins) == 10 and all(abs(b["count"] - 40_000) < 600 for b in bins)
    assert loans.agg(F.min("user_id"), F.max("user_id"), F.countDistinct("user_id")).first()[:] == (1, 1000, 1000)
    from tellerflow.sources.generate import _Row

    draws = spark.range(1, 200_001).select(_Row("t", 1, "2025-01-01 00:00:00", 1).draw("x").alias("x"))
    low, high = draws.agg(F.min("x"), F.max("x")).first()
    assert 0 <= low < 2**45 and 2**59 < high < 2**60


def test_generated_users_exist(spark, sf_dir):
    import __spark_entry__ as entry

    users = entry.QUERIES["gen_user_details"](spark, sf_dir).select("user_id")
    for name in ("transaction_details", "loans", "complaints", "assistance"):
        rows = entry.QUERIES[f"gen_{name}"](spark, sf_dir)
        assert rows.join(users, "user_id", "left_anti").count() == 0


def test_faq_answers_reach_every_benchmark_row(spark):
    from tellerflow.sources import tables

    folder = "/root/testdata/sf0.1"
    answers = tables.view(spark, folder, tables.CORPUS_TABLES["faqs"]).select("answer").distinct()
    items = tables.table(spark, folder, "benchmark").select("text").distinct()
    assert answers.count() == items.count() == 200


def test_repeated_ids_count_once_in_the_summary(spark):
    rows = spark.createDataFrame([(1, "q", "zeta"), (1, "q", "beta"), (2, "q", "gamma")], "question_id long, question string, answer string")
    found = corpus.intent_mapping({"faqs": rows}).collect()
    assert [(r["intent"], r["count"], r["sample_response"]) for r in found] == [("faq", 3, "beta")]
    stored = corpus.training_corpus({"faqs": rows}, {})
    assert [tuple(r) for r in corpus.summarize(stored).select("intent", "count", "sample_response").collect()] == [("faq", 3, "beta")]


def test_short_names_and_passwords_are_refused(spark):
    rows = [(1, "ab", True, True, 9), (2, "abc", True, True, 7), (3, "abc", True, True, 8)]
    requests = spark.createDataFrame(rows, "id long, username string, has_password boolean, passwords_match boolean, password_length int")
    status = {r.id: r.status for r in chatlog.check_registrations(requests).collect()}
    assert status == {1: "too_short", 2: "too_short", 3: "accepted"}


def test_scratch_tables_can_be_cleared(spark):
    import os

    from tellerflow import session

    stored = files.store(spark.range(3).toDF("id"), "probe")
    assert stored.count() == 3
    root = session._scratch_root(spark)
    other = session.scratch_path(spark, "probe").removeprefix("file:")
    assert other.startswith(root.removeprefix("file:")) and spark.sparkContext.applicationId in other
    kept = [name for name in os.listdir(root.removeprefix("file:")) if name.startswith("probe")]
    assert kept
