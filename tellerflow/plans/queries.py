"""The registered queries: (spark, sf_dir) -> DataFrame over whole tables.

Amounts are given as decimal text, so that no engine's rounding is involved.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tellerflow.functions import prompts, render, textprep
from tellerflow.functions.entities import with_entities
from tellerflow.functions.intents import with_base_intent
from tellerflow.operators import answering, chatlog, corpus, dialogue, lemmas
from tellerflow.operators import ledger as ledgers
from tellerflow.operators.keyed_table import KeyedTable
from tellerflow.operators.model_answers import answer_dialogues, answer_with_model
from tellerflow.session import scratch_path
from tellerflow.sources import catalogue, files, schemas, tables
from tellerflow.sources.csv_splits import read_csv_splits
from tellerflow.sources.generate import generate
from tellerflow.streaming.dialogue_stream import DialogueStream
from tellerflow.streaming.keyed_dialogue import KeyedDialogue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _entity_columns(entities: Column) -> list[Column]:
    return [
        entities["account_type"].alias("account_type"),
        entities["transaction_id"].alias("transaction_id"),
        entities["date"].alias("date"),
        entities["date_range"]["start"].alias("range_start"),
        entities["date_range"]["end"].alias("range_end"),
        entities["amount"].cast("string").alias("amount"),
        entities["recipient"].alias("recipient"),
    ]


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.answer(
        tables.utterances(spark, sf_dir), tables.accounts(spark, sf_dir), tables.ledger(spark, sf_dir)
    )


def _chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlog.chat_rows(_answered(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored messages as ledger requests on the account in effect."""
    scored = dialogue.score(tables.utterances(spark, sf_dir))
    e = F.col("entities")
    return scored.select(
        "event_id",
        "user_id",
        "intent",
        F.col("active_account").alias("account_type"),
        e["transaction_id"].alias("transaction_id"),
        e["date"].alias("date"),
        e["date_range"]["start"].alias("start"),
        e["date_range"]["end"].alias("end"),
    )


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "account_type", "rn", F.col("txn_date").alias("date"), F.col("txn_id").alias("id"),
                       F.col("txn_amount").cast("string").alias("amount"))


# --- Text preparation --------------------------------------------------------


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.view(spark, sf_dir, tables.NOISY_NOTES)


@query
def clean_currency(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", textprep.mark_currency(F.lower("text")).alias("cleaned"))


@query
def clean_numbers(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", textprep.mark_numbers(F.col("text")).alias("cleaned"))


@query
def expand_contractions(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", textprep.expand_contractions(F.lower("text")).alias("expanded"))


@query
def clean_notes(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", textprep.clean(F.col("text")).alias("cleaned"))


@query
def clean_documents(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", textprep.clean(F.col("text")).alias("cleaned"))


@query
def clean_pages(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", textprep.clean(F.col("html")).alias("cleaned"))


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = textprep.tokenize(textprep.clean(F.col("text")))
    return tables.table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("tokens"))


@query
def tokens(spark, sf_dir):
    rows = _document_tokens(spark, sf_dir)
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", "|").alias("tokens"))


@query
def token_notes(spark, sf_dir):
    cleaned = textprep.tokenize(textprep.clean(F.col("text")))
    return _notes(spark, sf_dir).select("id", F.array_join(cleaned, "|").alias("tokens"))


@query
def token_filter(spark, sf_dir):
    rows = _document_tokens(spark, sf_dir)
    return rows.select("doc_id", F.array_join(textprep.keep_tokens(F.col("tokens")), "|").alias("kept"))


@query
def lemma_tokens(spark, sf_dir):
    """Lemmas found by the noun rules in the corpus's own vocabulary."""
    prepared = _document_tokens(spark, sf_dir).select("doc_id", textprep.keep_tokens(F.col("tokens")).alias("kept"))
    kept = files.store(prepared, "tokens")  # read three times
    vocabulary = files.store(kept.select(F.explode("kept").alias("token")).distinct(), "vocabulary")
    found = lemmas.noun_lemmas(vocabulary, vocabulary.withColumnRenamed("token", "word"))
    # stored, so that its real size decides how it joins the tokens
    table = files.store(found, "lemmas")
    rows = lemmas.lemmatize_tokens(kept, "doc_id", "kept", table, [e for e, _ in catalogue.NOUN_ENDINGS])
    return rows.select("doc_id", F.array_join("lemmas", " ").alias("processed"))


@query
def preprocess_text(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", textprep.preprocess(F.col("text")).alias("processed"))


@query
def process_columns(spark, sf_dir):
    """Listed text columns prepared, originals kept, absent columns ignored."""
    return textprep.add_processed(tables.table(spark, sf_dir, "documents"), ["text", "summary"])


# --- Corpus ------------------------------------------------------------------


def _corpus_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: tables.view(spark, sf_dir, sql) for name, sql in tables.CORPUS_TABLES.items()}


@query
def training_corpus(spark, sf_dir):
    return corpus.training_corpus(_corpus_tables(spark, sf_dir)).select("row_id", "text", "response", "intent")


@query
def intent_mapping(spark, sf_dir):
    return corpus.intent_mapping(_corpus_tables(spark, sf_dir))


# --- Messages ----------------------------------------------------------------


@query
def utterances_valid(spark, sf_dir):
    raw = tables.view(spark, sf_dir, tables.RAW_UTTERANCES)
    return chatlog.valid_messages(raw).select("event_id", "user_id", "message")


@query
def extract_entities(spark, sf_dir):
    found = with_entities(tables.utterances(spark, sf_dir))
    return found.select("event_id", *_entity_columns(F.col("entities")))


@query
def relative_dates(spark, sf_dir):
    found = with_entities(tables.view(spark, sf_dir, tables.ENTITY_MESSAGES))
    return found.select("event_id", *_entity_columns(F.col("entities")))


@query
def intent_base(spark, sf_dir):
    found = with_base_intent(tables.view(spark, sf_dir, tables.ENTITY_MESSAGES))
    return found.select("event_id", "message", "base_intent", "base_confidence", "base_state")


@query
def intent_counts(spark, sf_dir):
    found = with_base_intent(tables.utterances(spark, sf_dir))
    return found.groupBy("base_intent", "base_confidence").agg(F.count("*").alias("n"))


@query
def document_entities(spark, sf_dir):
    """Entities of whole documents."""
    found = with_entities(tables.view(spark, sf_dir, tables.DOCUMENT_MESSAGES))
    return found.select("event_id", *_entity_columns(F.col("entities")))


@query
def conversation_entities(spark, sf_dir):
    """Entities and base intents of the customers' turns."""
    found = with_base_intent(tables.view(spark, sf_dir, tables.CONVERSATION_MESSAGES))
    return found.select("event_id", *_entity_columns(F.col("entities")), "base_intent")


@query
def conversation_state(spark, sf_dir):
    """The dialogue over the customers' turns of each conversation."""
    scored = dialogue.score(tables.view(spark, sf_dir, tables.CONVERSATION_MESSAGES))
    return scored.select("event_id", "user_id", "intent", "confidence", "state", "active_account")


# --- Dialogue ----------------------------------------------------------------


@query
def dialogue_state(spark, sf_dir):
    scored = dialogue.score(tables.utterances(spark, sf_dir))
    return scored.select("event_id", "user_id", "intent", "confidence", "state")


@query
def active_account(spark, sf_dir):
    return dialogue.score(tables.utterances(spark, sf_dir)).select("event_id", "active_account")


@query
def pending_action(spark, sf_dir):
    rows = dialogue.pending_actions(tables.utterances(spark, sf_dir))
    p = F.col("pending")
    return rows.select(
        "event_id",
        p["type"].alias("type"),
        p["amount"].cast("string").alias("amount"),
        p["recipient"].alias("recipient"),
        p["from_account"].alias("from_account"),
    )


@query
def entity_memory(spark, sf_dir):
    rows = dialogue.entity_memory(tables.utterances(spark, sf_dir))
    memory = F.struct(*[F.col(f"memory_{f}").alias(f) for f in dialogue.ENTITY_FIELDS])
    return rows.withColumn("memory", memory).select("event_id", *_entity_columns(F.col("memory")))


def _history_text(rows: DataFrame) -> DataFrame:
    shown = F.transform("history", lambda x: F.concat_ws("|", x["user"], x["intent"], x["bot"]))
    return rows.select("event_id", F.size("history").cast("bigint").alias("n"), F.array_join(shown, "\n").alias("history"))


@query
def history_10(spark, sf_dir):
    messages = tables.utterances(spark, sf_dir)
    return _history_text(dialogue.history(_answered(spark, sf_dir), 10, messages=messages))


@query
def history_5(spark, sf_dir):
    messages = tables.utterances(spark, sf_dir)
    return _history_text(dialogue.history(_answered(spark, sf_dir), 5, messages=messages))


@query
def prompt_context(spark, sf_dir):
    messages = tables.utterances(spark, sf_dir)
    return dialogue.prompt_context(_answered(spark, sf_dir), messages=messages).select("event_id", "context")


# --- Accounts and ledger -----------------------------------------------------


@query
def ledger_flatten(spark, sf_dir):
    """Nested account maps built per customer, flattened to ledger rows."""
    money = F.col("c_acctbal").cast("decimal(18,2)")

    def row(date, description, amount, id_):
        return F.struct(date.alias("date"), description.alias("description"),
                        amount.cast("decimal(18,2)").alias("amount"), id_.alias("id"))

    key = F.col("c_custkey")
    number = F.concat(F.lit("T"), (key + 20000).cast("string"))

    def account(rows, balance):
        return F.struct(F.lpad(key.cast("string"), 10, "0").alias("account_number"),
                        balance.cast("decimal(18,2)").alias("balance"), F.array(*rows).alias("transactions"))

    checking = account([row(F.lit("2025-05-01"), F.col("c_mktsegment"), money, number),
                        row(F.lit("2025-05-02"), F.col("c_name"), -money, F.concat(number, F.lit("1")))], money)
    savings = account([row(F.lit("2025-04-15"), F.lit("Interest"), money, F.concat(number, F.lit("2")))], money * 2)
    nested = tables.table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.when(key % 2 == 0, F.create_map(F.lit("checking"), checking, F.lit("savings"), savings))
        .otherwise(F.create_map(F.lit("checking"), checking)).alias("accounts"),
    )
    accounts, rows = ledgers.flatten_ledger(nested)
    joined = rows.join(accounts, ["user_id", "account_type"])
    return joined.select("user_id", "account_type", "account_number", F.col("balance").cast("string").alias("balance"),
                         "pos", "date", "description", F.col("amount").cast("string").alias("amount"), "id")


@query
def balance_lookup(spark, sf_dir):
    asked = _requests(spark, sf_dir).filter(F.col("intent").isin("balance_inquiry", "account_balance"))
    found = ledgers.balances(asked, tables.accounts(spark, sf_dir))
    return found.select("event_id", "account_type", F.col("balance").cast("string").alias("balance"))


@query
def recent_txns(spark, sf_dir):
    rows = ledgers.recent_transactions(tables.ledger(spark, sf_dir))
    return rows.select("user_id", "account_type", "rn", "date", "id", F.col("amount").cast("string").alias("amount"))


@query
def txn_lines(spark, sf_dir):
    return ledgers.ledger_line(tables.ledger(spark, sf_dir)).select("id", "line")


@query
def render_history(spark, sf_dir):
    days = ledgers.daily_listing(tables.ledger(spark, sf_dir))
    lines = ledgers.bullet_list(F.transform("rows", ledgers.signed_line))
    return ledgers.recent_listing(days).select("user_id", "account_type", lines.alias("listing"))


@query
def bucketed_history(spark, sf_dir):
    """Balance and newest rows of every account from tables bucketed by user."""
    ledger = files.store_bucketed(tables.ledger(spark, sf_dir), "ledger", "user_id", 16, ("account_type", "date"))
    accounts = files.store_bucketed(tables.accounts(spark, sf_dir), "accounts", "user_id", 16, ("account_type",))
    return ledgers.account_history(accounts, ledger).select(
        "user_id", "account_type", F.col("balance").cast("string").alias("balance"),
        ledgers.bullet_list(F.transform("rows", ledgers.signed_line)).alias("listing"))


@query
def txn_by_id(spark, sf_dir):
    asked = _requests(spark, sf_dir).filter(F.col("transaction_id").isNotNull())
    found = ledgers.transactions(asked, tables.ledger(spark, sf_dir))
    return _listed(found).drop("rn")


@query
def txn_on_date(spark, sf_dir):
    asked = _requests(spark, sf_dir).filter(F.col("date").isNotNull())
    return _listed(ledgers.transactions(asked, tables.ledger(spark, sf_dir)))


@query
def txn_in_range(spark, sf_dir):
    asked = _requests(spark, sf_dir).filter(F.col("start").isNotNull() & F.col("date").isNull())
    return _listed(ledgers.transactions(asked, tables.ledger(spark, sf_dir)))


@query
def accounts_upsert(spark, sf_dir):
    """Customers' accounts, replaced or extended by those their orders name."""
    incoming = (
        tables.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.min("o_orderkey").alias("first_order"))
        .select(
            "user_id",
            F.lit("savings").alias("account_type"),
            F.lpad(F.col("first_order").cast("string"), 10, "9").alias("account_number"),
            F.col("first_order").cast("decimal(18,2)").alias("balance"),
        )
    )
    incoming, accounts = files.store(incoming, "incoming"), files.store(tables.accounts(spark, sf_dir), "accounts")
    stored = KeyedTable(spark, scratch_path(spark, "accounts_by_user"), accounts.schema, "user_id", ("account_type",))
    stored.append(accounts)
    stored.rewrite(incoming, lambda rows: chatlog.upsert_accounts(rows, incoming))
    return stored.read().withColumn("balance", F.col("balance").cast("string"))


@query
def user_data_merge(spark, sf_dir):
    """Each customer's data map, updated by a second one."""
    existing = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")
    incoming = F.when(
        F.col("c_custkey") % 3 != 0,
        F.create_map(F.lit("name"), F.upper("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string")),
    )
    merged = F.array_sort(F.map_entries(chatlog.merge_user_data(existing, incoming)))
    shown = F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return tables.table(spark, sf_dir, "customer").select("c_custkey", shown.alias("data"))


# --- Replies and chat log ----------------------------------------------------


@query
def render_response(spark, sf_dir):
    return _answered(spark, sf_dir).select("event_id", "user_id", "message", "intent", "confidence", "response")


def _stored_log(spark: SparkSession, sf_dir: str) -> chatlog.ChatLog:
    log = chatlog.ChatLog(spark, scratch_path(spark, "chat_log"))
    log.append(files.store(_chat_log(spark, sf_dir), "chat-rows"))
    return log


@query
def chat_log(spark, sf_dir):
    """The log after appending it to a stored table and reading that back."""
    return _stored_log(spark, sf_dir).read()


@query
def chat_history_top10(spark, sf_dir):
    log = _stored_log(spark, sf_dir).read()
    return chatlog.recent_chats(log).select("user_id", "place", "id", "message", "response")


@query
def latest_chats(spark, sf_dir):
    """The newest rows of one user."""
    shown = _stored_log(spark, sf_dir).of(tables.SHOWN_USER)
    return chatlog.user_chats(shown, tables.SHOWN_USER).select("id", "message", "response")


@query
def chat_cleared(spark, sf_dir):
    """The stored log after the customers of one market segment cleared theirs."""
    gone = tables.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    log = _stored_log(spark, sf_dir)
    log.clear(gone.select(F.col("c_custkey").alias("user_id")))
    return log.read().select("id", "user_id", "intent")


@query
def chat_orphans(spark, sf_dir):
    """Log rows of users that the user table, customers not in debt, doesn't have."""
    known = tables.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    return chatlog.orphans(_stored_log(spark, sf_dir).read(), known).select("id", "user_id", "intent")


@query
def user_lookup(spark, sf_dir):
    """The user row of one name."""
    users = files.store(chatlog.unique_users(tables.view(spark, sf_dir, tables.REGISTRATIONS)), "users")
    stored = KeyedTable(spark, scratch_path(spark, "users_by_name"), users.schema, "username")
    stored.append(users)
    return stored.of(f"user{tables.SHOWN_USER}")


@query
def failure_rows(spark, sf_dir):
    """What messages without text are answered."""
    found = answering.failed(tables.view(spark, sf_dir, tables.PARTLY_MISSING))
    return found.select("event_id", "user_id", "intent", "confidence", "response")


@query
def account_switch(spark, sf_dir):
    """The reply to naming each account, whatever transfer is pending."""
    accounts = tables.accounts(spark, sf_dir)
    user = F.col("user_id")
    pending = F.when(user % 3 > 0, "transfer").otherwise("")
    reply = render.account_selection_reply(
        F.col("account_type"), pending, F.when(user % 5 < 3, F.col("balance")), F.when(user % 7 < 4, F.lit("ann")))
    return accounts.select("user_id", F.col("account_type").alias("account"), reply.alias("reply"))


@query
def unique_users(spark, sf_dir):
    return chatlog.unique_users(tables.view(spark, sf_dir, tables.REGISTRATIONS))


@query
def registration_check(spark, sf_dir):
    checked = chatlog.check_registrations(tables.view(spark, sf_dir, tables.REGISTRATIONS))
    return checked.select("id", "username", "status")


# --- Prompts -----------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers of varying quality, spelled from the base intents."""
    found = with_base_intent(tables.utterances(spark, sf_dir))
    intent = F.col("base_intent")
    raw = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" '"), intent, F.lit("'\n")))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('"'), intent, F.lit('"')))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("Intent: "), intent))
        .when(F.col("event_id") % 5 == 3, intent)
    )
    label = prompts.validate_label(F.col("raw"))
    return found.withColumn("raw", raw).withColumn("label", label).withColumns(
        {"intent": F.col("label.intent"), "confidence": F.col("label.confidence")}
    )


def _responses(spark: SparkSession) -> DataFrame:
    """Templates from a written intents document: three a tag, and a tag that comes again and loses."""
    entries = [
        {"tag": tag, "patterns": patterns, "responses": [*responses, f"Another way: {responses[0]}", f"{tag}?"]}
        for tag, patterns, responses in catalogue.DEFAULT_INTENTS
    ]
    again = {"tag": entries[0]["tag"], "patterns": ["Yo"], "responses": ["Not this one."]}
    path = scratch_path(spark, "intents")
    spark.createDataFrame([([*entries, again],)], schemas.INTENTS).coalesce(1).write.json(path)
    return files.intent_responses(files.read_intents(spark, path, multi_line=False))


@query
def label_validate(spark, sf_dir):
    return _labelled(spark, sf_dir).select("event_id", "raw", "intent", "confidence")


@query
def template_pick(spark, sf_dir):
    messages = with_base_intent(tables.utterances(spark, sf_dir)).withColumn("intent", F.col("base_intent"))
    found = prompts.with_templates(messages, _responses(spark))
    return found.select("event_id", "intent", prompts.template_reply(F.col("templates"), F.col("event_id")).alias("reply"))


@query
def template_fill(spark, sf_dir):
    """Templates filled with the balances and newest transactions of all accounts of each user."""
    per_user = lambda lines: F.array_join(F.array_sort(F.collect_list(F.concat(F.col("account_type"), F.lit(": "), lines))), "; ")
    days = ledgers.daily_listing(tables.ledger(spark, sf_dir))
    lines = F.array_join(F.transform("rows", ledgers.signed_line), "; ")
    newest = ledgers.recent_listing(days).groupBy("user_id").agg(per_user(lines).alias("transactions"))
    balance = tables.accounts(spark, sf_dir).groupBy("user_id").agg(per_user(F.col("balance").cast("string")).alias("balance"))
    found = prompts.with_templates(_labelled(spark, sf_dir), _responses(spark))
    facts = found.join(balance, "user_id", "left").join(newest, "user_id", "left")
    chosen = prompts.template_reply(F.col("templates"), F.col("event_id"))
    reply = prompts.fill_template(chosen, F.col("intent"), F.col("balance"), F.col("transactions"))
    return facts.select("event_id", "intent", reply.alias("reply"))


@query
def prompt_dataset(spark, sf_dir):
    """Classification and reply prompts with the three exchanges before each message."""
    contexts = dialogue.prompt_context(_answered(spark, sf_dir), messages=tables.utterances(spark, sf_dir))
    rows = prompts.with_templates(contexts, _responses(spark))
    shown = F.coalesce("templates", F.array().cast("array<string>"))
    return rows.select(
        "event_id",
        prompts.classification_prompt(F.col("message")).alias("classify"),
        prompts.response_prompt(F.col("intent"), F.col("context"), F.col("message"), shown).alias("reply"),
    )


@query
def speech_text(spark, sf_dir):
    """Replies and conversation turns as text to read aloud."""
    turns = tables.table(spark, sf_dir, "conversations")
    marked = F.concat(F.lit(" [10:"), F.col("turn").cast("string"), F.lit("] "), F.col("text"), F.lit(" [speaker] "))
    return turns.select("conv_id", "turn", render.speech_text(marked).alias("spoken"))


@query
def locale_map(spark, sf_dir):
    documents = tables.view(spark, sf_dir, tables.LANGUAGES)
    return documents.select("doc_id", "lang", render.locale(F.col("lang")).alias("locale"))


# --- Files -------------------------------------------------------------------


@query
def scan_csv_roundtrip(spark, sf_dir):
    """Documents written as CSV, read back with a fixed schema."""
    path = scratch_path(spark, "documents_csv")
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    files.write_csv(documents, path)
    return files.read_csv(spark, path, documents.schema)


# Text of one CSV file, about: one task writes a file.
CSV_FILE_BYTES = 256 << 20


@query
def scan_csv_splits(spark, sf_dir):
    """Documents written as CSV files of many splits, one file up to 256 MB of text, read back by many tasks a file."""
    path = scratch_path(spark, "documents_csv")
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files.write_csv(documents.coalesce(size // CSV_FILE_BYTES + 1), path)
    return read_csv_splits(spark, path, documents.schema, split_bytes=1 << 22)


@query
def intent_patterns_flat(spark, sf_dir):
    """Intent files written per part, one document per line, scanned and flattened."""
    path = scratch_path(spark, "intents")
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")

    def entry(tag, patterns, responses):
        return F.struct(tag.alias("tag"), patterns.alias("patterns"), responses.alias("responses"))

    document = F.array(
        entry(brand, F.split(name, " "), F.array(kind, name)),
        entry(kind, F.array(F.concat(F.lit("find "), name)), F.array(brand)),
    )
    tables.table(spark, sf_dir, "part").select(document.alias("intents")).write.json(path)
    return files.intent_patterns(files.read_intents(spark, path, multi_line=False))


@query
def template_catalog(spark, sf_dir):
    """JSON template maps written per part, parsed and flattened."""
    parts = tables.table(spark, sf_dir, "part")
    document = F.create_map(
        F.col("p_brand"), F.array(F.concat(F.lit("About "), "p_name"), F.col("p_type")),
        F.lit("fallback"), F.array(F.concat(F.lit('Which "'), "p_type", F.lit('"?'))),
    )
    stored = parts.select("p_partkey", F.to_json(document).alias("json"))
    return files.parse_templates(stored)


@query
def fallback_intents(spark, sf_dir):
    """The built-in phrases, used where no intents document is, of each message's intent."""
    documents = files.read_intents(spark, scratch_path(spark, "no-intents"))
    messages = files.store(with_base_intent(tables.utterances(spark, sf_dir)).select("event_id", "base_intent"), "intents")
    return messages.join(files.intent_patterns(documents), F.col("base_intent") == F.col("tag")).select(
        "event_id", "tag", "place", "pattern")


@query
def tolerant_scan(spark, sf_dir):
    """A folder that holds two of the eight bulk tables."""
    folder = scratch_path(spark, "bulk")
    for name in ("complaints", "faqs"):
        source, key = GENERATED_FROM[name]
        ids = tables.table(spark, sf_dir, source).select((F.col(key) + 1).alias("id"))
        files.write_csv(generate(name, ids), f"{folder}/{name}.csv")
    found = files.read_bulk_tables(spark, folder)
    parts = [
        rows.select(F.lit(name).alias("name"), F.col(rows.columns[0]).alias("id")) for name, rows in found.items()
    ]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query
def model_answers(spark, sf_dir):
    """Every message answered through the model hook, with a stub that looks for words."""

    def model(texts: list[str]) -> list[str]:
        answers = []
        for text in texts:
            if "Intent: " in text:
                answers.append(f" On {text.split('Intent: ')[1].split(chr(10))[0]}: [AMOUNT] [TRANSACTIONS]\n")
                continue
            message = text.split("Message: ")[1].lower()
            if "evening" in message:
                raise ValueError("closed")
            answers.append("balance_inquiry" if "balance" in message else "'transaction_history'" if "history" in message else "?")
        return answers

    key = F.col("event_id")
    messages = tables.utterances(spark, sf_dir).select(
        "event_id", "message", F.lit("").alias("context"),
        F.when(key % 2 == 0, key.cast("string")).alias("balance"),
        F.when(key % 3 == 0, F.concat(F.lit("T"), key.cast("string"))).alias("transactions"))
    return answer_with_model(messages, files.intent_responses(files.default_intents(spark)), model).select(
        "event_id", "intent", "confidence", "response")


@query
def model_dialogue(spark, sf_dir):
    """The customers' turns of every conversation answered in the model's own dialogue, with a stub for the model.

    The stub labels by the message's length, and answers with a digest of what was said before, or fails.
    """
    import hashlib

    def model(texts: list[str]) -> list[str]:
        answers = []
        for text in texts:
            before, _, rest = text.partition("\nMessage: ")
            if "Intent: " not in before:
                kind = len(rest.rpartition("\nAnswer with")[0]) % 4
                answers.append(["balance_inquiry", "'transaction_history'", "?", None][kind])
                continue
            digest = hashlib.md5(before.partition("Earlier in this conversation:\n")[2].encode()).hexdigest()
            answers.append(None if digest[0] in "cf" else f" After {digest[:6]}: [AMOUNT] [TRANSACTIONS]\n")
        return answers

    user = F.col("user_id")
    messages = tables.view(spark, sf_dir, tables.CONVERSATION_MESSAGES).withColumns({
        "balance": F.when(user % 2 == 0, user.cast("string")),
        "transactions": F.when(user % 3 == 0, F.concat(F.lit("T"), user.cast("string")))})
    told = answer_dialogues(messages, files.intent_responses(files.default_intents(spark)), model)
    bots = F.array_join(F.transform("history", lambda x: x["bot"]), "\n")
    return told.select(
        "event_id", "turn", "intent", "confidence", "response", F.size("history").alias("remembered"), F.md5(bots).alias("bots_md5"))


# --- Generated tables --------------------------------------------------------

# Each generated table grows with the ids of one given table.
GENERATED_FROM = {
    "user_details": ("customer", "c_custkey"),
    "transaction_details": ("events", "event_id"),
    "credit_cards": ("customer", "c_custkey"),
    "loans": ("customer", "c_custkey"),
    "complaints": ("orders", "o_orderkey"),
    "fraud_reports": ("orders", "o_orderkey"),
    "faqs": ("documents", "doc_id"),
    "assistance": ("events", "event_id"),
}


def _generated(name: str) -> Query:
    source, key = GENERATED_FROM[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = tables.table(spark, sf_dir, source).select((F.col(key) + 1).alias("id"))
        # as many users as user_details has
        rows = generate(name, ids, users=tables.table(spark, sf_dir, "customer").count())
        texts = [f.name for f in rows.schema.fields if f.dataType.simpleString().startswith("decimal")]
        return rows.withColumns({c: F.col(c).cast("string") for c in texts}) if texts else rows

    return run


QUERIES.update({f"gen_{name}": _generated(name) for name in GENERATED_FROM})


# --- Streaming ---------------------------------------------------------------


BATCHES = 5


def _stream_log(spark: SparkSession, sf_dir: str, job: DialogueStream | KeyedDialogue) -> DataFrame:
    """The chat log a job writes of event files that arrive in time order; each arrival is a batch, and a restart."""
    events = tables.table(spark, sf_dir, "events")
    folder = scratch_path(spark, "events")
    shares = [k / BATCHES for k in range(1, BATCHES)]
    cuts = events.agg(F.percentile_approx("ts", shares).alias("cuts")).first().cuts or []
    # events without a time arrive first
    arrival = sum((F.coalesce(F.col("ts") > F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for number in range(len(cuts) + 1):
        events.filter(arrival == number).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        messages = spark.sql(tables.on_frame(tables.UTTERANCES, "events"), events=stream)
        job.start(messages, availableNow=True).awaitTermination()
    return job.chat_log()


@query
def sliced_dialogue_stream(spark, sf_dir):
    """The chat log as the job with its own state tables writes it; it cuts hot users into slices."""
    accounts, ledger = tables.accounts(spark, sf_dir), tables.ledger(spark, sf_dir)
    return _stream_log(spark, sf_dir, DialogueStream(spark, scratch_path(spark, "dialogue"), accounts, ledger, snapshot_every=2))


@query
def dialogue_stream(spark, sf_dir):
    """The chat log as the job over Spark's keyed state writes it."""
    accounts, ledger = tables.accounts(spark, sf_dir), tables.ledger(spark, sf_dir)
    return _stream_log(spark, sf_dir, KeyedDialogue(spark, scratch_path(spark, "dialogue"), accounts, ledger))
