"""SQL counterparts of the registered queries, written for a plain SQL engine.

The texts restate the rules on their own: counted runs instead of positions,
ledger rows joined and ranked per message instead of prepared listings. Only the
derived views and the fixed values are shared with the Spark side.
"""

from __future__ import annotations

from tellerflow.functions.prompts import CLASSIFY, REPLY
from tellerflow.sources import catalogue as c
from tellerflow.sources import tables
from tellerflow.sources.generate import AS_OF, SEED

ORACLES: dict[str, str] = {}


def _s(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_s(i) if isinstance(i, str) else str(i) for i in items) + "]"


def _in(items) -> str:
    return "(" + ", ".join(_s(i) for i in items) + ")"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_s(w)})" for w in words) + ")"


def _fill(template: str, **values: str) -> str:
    """SQL concatenation of a template and the expressions for its placeholders."""
    sql, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            sql.append(_s(head))
        name, _, rest = tail.partition("}")
        if brace:
            sql.append(f"CAST({values[name]} AS VARCHAR)")
    return "(" + " || ".join(sql) + ")"


def _reply(name: str, **values: str) -> str:
    return _fill(c.REPLIES[name], **values)


# --- Text preparation --------------------------------------------------------

_WS = r"[\s\p{Z}]"
_CUR = rf"(\$|€|£|₹|¥|₩|₽|₿|rs|inr|usd){_WS}?\p{{Nd}}+([.,]\p{{Nd}}+)*"
_NUM = "|".join(
    [
        r"\p{Nd}{4,}([.,]\p{Nd}+)*",
        r"\p{Nd}{2,3}([.,]\p{Nd}+)+",
        r"\p{Nd}[.,]\p{Nd}{2,}([.,]\p{Nd}+)*",
        r"\p{Nd}([.,]\p{Nd}+){2,}",
    ]
)


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_s(pattern)}, {_s(by)}, 'g')"


def _currency(text: str) -> str:
    return _sub(text, _CUR, " CURRENCY ")


def _numbers(text: str) -> str:
    return _sub(text, _NUM, " NUMBER ")


def _contractions(text: str) -> str:
    for short, full in c.CONTRACTIONS:
        text = f"replace({text}, {_s(short)}, {_s(full)})"
    return text


def _clean(column: str) -> str:
    text = _contractions(_numbers(_currency(f"lower(coalesce({column}, ''))")))
    text = _sub(text, r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+", " URL ")
    text = _sub(text, r"[^\s\p{Z}]+@[^\s\p{Z}]+", " EMAIL ")
    return f"trim({_sub(text, r'[^\p{L}\p{N}@#%&*\-_/]+', ' ')})"


def _tokens(cleaned: str) -> str:
    text = _sub(_sub(cleaned, r"([@#%&])", r" \1 "), "--", " -- ")
    # one word at a time: a fused form counts between characters that are no word characters
    for head, tail in c.FUSED_FORMS:
        end = r"(\s|$)" if (head, tail) == ("wan", "na") else r"([^\p{L}\p{N}_]|$)"
        text = _sub(text, rf"(?i)(^|[^\p{{L}}\p{{N}}_])({head})({tail}){end}", r"\1 \2 \3 \4")
    return f"list_filter(string_split_regex({text}, ' +'), lambda x: x <> '')"


def _kept(tokens: str) -> str:
    return (
        f"list_filter({tokens}, lambda x: list_contains({_list(c.DOMAIN_TERMS)}, x)"
        f" OR NOT list_contains({_list(c.STOP_WORDS)}, x))"
    )


def _processed(column: str) -> str:
    names, lemmas = _list(c.LEMMAS), _list(c.LEMMAS.values())
    kept = _kept(_tokens(_clean(column)))
    return (
        f"array_to_string(list_transform({kept}, lambda x:"
        f" CASE WHEN list_contains({names}, x) AND NOT list_contains({_list(c.DOMAIN_TERMS)}, x)"
        f" THEN {lemmas}[list_position({names}, x)] ELSE x END), ' ')"
    )


_NOTES = f"({tables.NOISY_NOTES}) AS notes"
ORACLES["clean_currency"] = f"SELECT id, {_currency('lower(text)')} AS cleaned FROM {_NOTES}"
ORACLES["clean_numbers"] = f"SELECT id, {_numbers('text')} AS cleaned FROM {_NOTES}"
ORACLES["expand_contractions"] = f"SELECT id, {_contractions('lower(text)')} AS expanded FROM {_NOTES}"
ORACLES["clean_notes"] = f"SELECT id, {_clean('text')} AS cleaned FROM {_NOTES}"
ORACLES["clean_documents"] = f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents"
ORACLES["clean_pages"] = f"SELECT page_id, {_clean('html')} AS cleaned FROM pages"
_DOC_TOKENS = f"(SELECT doc_id, {_tokens(_clean('text'))} AS t FROM documents) AS d"
ORACLES["tokens"] = f"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM {_DOC_TOKENS}"
ORACLES["token_notes"] = f"SELECT id, array_to_string({_tokens(_clean('text'))}, '|') AS tokens FROM {_NOTES}"
ORACLES["token_filter"] = f"SELECT doc_id, array_to_string({_kept('t')}, '|') AS kept FROM {_DOC_TOKENS}"
ORACLES["preprocess_text"] = f"SELECT id, {_processed('text')} AS processed FROM {_NOTES}"
ORACLES["process_columns"] = f"SELECT *, {_processed('text')} AS processed_text FROM documents"

_ENDINGS = "(VALUES " + ", ".join(
    f"({i}, {_s(end)}, {_s(base)})" for i, (end, base) in enumerate([("", ""), *c.NOUN_ENDINGS])
) + ") AS e(rank, ending, base)"
ORACLES["lemma_tokens"] = f"""
WITH kept AS (SELECT doc_id, {_kept('t')} AS t FROM {_DOC_TOKENS}),
words AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM kept),
vocabulary AS (SELECT DISTINCT token FROM words),
forms AS (
  SELECT v.token, e.rank, left(v.token, length(v.token) - length(e.ending)) || e.base AS lemma
  FROM vocabulary v, {_ENDINGS}
  WHERE ends_with(v.token, e.ending) AND v.token NOT IN {_in(c.DOMAIN_TERMS)}),
best AS (
  SELECT token, lemma FROM forms WHERE lemma IN (SELECT token FROM vocabulary)
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY length(lemma), rank) = 1),
joined AS (
  SELECT w.doc_id, string_agg(coalesce(b.lemma, w.token), ' ' ORDER BY w.place) AS processed
  FROM words w LEFT JOIN best b ON b.token = w.token GROUP BY w.doc_id)
SELECT k.doc_id, coalesce(j.processed, '') AS processed FROM kept k LEFT JOIN joined j ON j.doc_id = k.doc_id"""

# --- Corpus ------------------------------------------------------------------

_ROW_IDS = ["question_id", "complaint_id", "assistance_id", "report_id", "transaction_id"]
_CORPUS = "\nUNION ALL\n".join(
    f"SELECT {i} AS src, {row_id} AS row_id, {_processed(column)} AS text,"
    f" {_s(canned) if canned else _processed('answer')} AS response, {_s(intent)} AS intent"
    f" FROM ({tables.CORPUS_TABLES[table]}) AS s{i}"
    for i, ((intent, table, column, canned), row_id) in enumerate(zip(c.CORPUS_SOURCES, _ROW_IDS))
)
ORACLES["training_corpus"] = f"SELECT row_id, text, response, intent FROM ({_CORPUS}) AS corpus"
ORACLES["intent_mapping"] = f"""
SELECT intent, count(*) AS count, arg_min(response, CAST(src AS BIGINT) * 1000000000 + row_id) AS sample_response
FROM ({_CORPUS}) AS corpus GROUP BY intent"""

# --- Messages ----------------------------------------------------------------


def _entities(view: str) -> str:
    """One row per message with its entity columns; t is the lower-cased text."""
    return f"""
  SELECT event_id, user_id, ts, message, t,
    CASE WHEN contains(t, 'savings') THEN 'savings' WHEN contains(t, 'checking') THEN 'checking' END AS account_type,
    CASE WHEN idm = '' THEN NULL ELSE 'T' || regexp_replace(upper(idm), '^[#T]+', '') END AS transaction_id,
    CASE WHEN contains(t, 'today') THEN strftime(ts, '%Y-%m-%d')
         WHEN contains(t, 'yesterday') THEN strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d')
         WHEN iso <> '' THEN iso
         WHEN slash <> '' THEN
           CASE WHEN length(split_part(slash, '/', 3)) = 2 THEN '20' ELSE '' END || split_part(slash, '/', 3)
           || '-' || right('0' || split_part(slash, '/', 1), 2) || '-' || right('0' || split_part(slash, '/', 2), 2)
    END AS date,
    CASE WHEN contains(t, 'today') OR contains(t, 'yesterday') THEN NULL
         WHEN contains(t, 'this week') THEN strftime(date_trunc('week', ts), '%Y-%m-%d')
         WHEN contains(t, 'last week') THEN strftime(date_trunc('week', ts) - INTERVAL 7 DAY, '%Y-%m-%d')
         WHEN contains(t, 'this month') THEN strftime(ts, '%Y-%m-01')
         WHEN contains(t, 'last month') THEN strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m-%d')
    END AS range_start,
    CASE WHEN contains(t, 'today') OR contains(t, 'yesterday') THEN NULL
         WHEN contains(t, 'this week') THEN strftime(ts, '%Y-%m-%d')
         WHEN contains(t, 'last week') THEN strftime(date_trunc('week', ts) - INTERVAL 1 DAY, '%Y-%m-%d')
         WHEN contains(t, 'this month') THEN strftime(ts, '%Y-%m-%d')
         WHEN contains(t, 'last month') THEN strftime(date_trunc('month', ts) - INTERVAL 1 DAY, '%Y-%m-%d')
    END AS range_end,
    CAST(translate(CASE WHEN worded <> '' THEN replace(worded, ',', '') WHEN signed <> '' THEN replace(signed, ',', '') END,
      '٠١٢٣٤٥٦٧٨٩', '0123456789')
         AS DECIMAL(38,2)) AS amount,
    CASE WHEN contains(t, 'to ') AND contains(t, ' account') THEN nullif(trim(
      regexp_extract(t, 'to\\s+([a-zA-Z]+(?:\\s+[a-zA-Z]+)*)\\s+account', 1)), '') END AS recipient
  FROM (
    SELECT *, regexp_extract(t, '(?:transaction|id|#)\\s*([t#]?\\p{{Nd}}{{5,}})', 1) AS idm,
      regexp_extract(t, '(\\p{{Nd}}{{1,2}}/\\p{{Nd}}{{1,2}}/\\p{{Nd}}{{2,4}})', 1) AS slash,
      regexp_extract(t, '(\\p{{Nd}}{{4}}-\\p{{Nd}}{{1,2}}-\\p{{Nd}}{{1,2}})', 1) AS iso,
      regexp_extract(t, '\\$\\s*(\\p{{Nd}}+(?:,\\p{{Nd}}{{3}})*(?:\\.\\p{{Nd}}{{2}})?)', 1) AS signed,
      regexp_extract(t, '(\\p{{Nd}}+(?:,\\p{{Nd}}{{3}})*(?:\\.\\p{{Nd}}{{2}})?)\\s*dollars', 1) AS worded
    FROM (SELECT *, lower(message) AS t FROM ({view}) AS raw) AS lowered) AS matched"""


def _labelled(entities: str) -> str:
    """Entities with base intent, confidence and the state it leads to."""
    return f"""
  SELECT *, CASE WHEN base_intent <> 'transfer_money' THEN 'initial'
      WHEN amount IS NOT NULL AND recipient IS NOT NULL THEN 'awaiting_confirmation'
      WHEN amount IS NOT NULL THEN 'awaiting_recipient'
      WHEN recipient IS NOT NULL THEN 'awaiting_amount' ELSE 'awaiting_details' END AS base_state,
    CAST(CASE WHEN rule = 8 THEN 0.5 WHEN rule >= 5 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS base_confidence
  FROM (
    SELECT *, ['specific_transaction', 'date_transactions', 'account_balance', 'account_transactions',
      'greeting', 'balance_inquiry', 'transfer_money', 'transaction_history'][
        CASE WHEN rule = 8 THEN 5 WHEN rule >= 5 THEN rule + 1 ELSE rule + 1 END] AS base_intent
    FROM (
      SELECT *, CASE
        WHEN contains(t, 'transaction') AND {_any('t', c.ID_WORDS)} THEN 0
        WHEN {_any('t', ['transactions', 'spending'])} AND (date IS NOT NULL OR range_start IS NOT NULL) THEN 1
        WHEN contains(t, 'account') AND account_type IS NOT NULL AND contains(t, 'balance') THEN 2
        WHEN contains(t, 'account') AND account_type IS NOT NULL AND contains(t, 'transactions') THEN 3
        WHEN {_any('t', c.GREETING_WORDS)} THEN 4
        WHEN {_any('t', c.BALANCE_WORDS)} THEN 5
        WHEN {_any('t', c.TRANSFER_WORDS)} THEN 6
        WHEN {_any('t', c.HISTORY_WORDS)} THEN 7
        ELSE 8 END AS rule
      FROM ({entities}) AS e) AS ruled) AS named"""


_ENTITY_COLUMNS = (
    "event_id, account_type, transaction_id, date, range_start, range_end, CAST(amount AS VARCHAR) AS amount, recipient"
)
ORACLES["utterances_valid"] = f"""
SELECT event_id, user_id, trim(message) AS message FROM ({tables.RAW_UTTERANCES}) AS raw WHERE trim(message) <> ''"""
ORACLES["extract_entities"] = f"SELECT {_ENTITY_COLUMNS} FROM ({_entities(tables.UTTERANCES)}) AS e"
ORACLES["relative_dates"] = f"SELECT {_ENTITY_COLUMNS} FROM ({_entities(tables.ENTITY_MESSAGES)}) AS e"
ORACLES["intent_base"] = f"""
SELECT event_id, message, base_intent, base_confidence, base_state
FROM ({_labelled(_entities(tables.ENTITY_MESSAGES))}) AS l"""
ORACLES["document_entities"] = f"SELECT {_ENTITY_COLUMNS} FROM ({_entities(tables.DOCUMENT_MESSAGES)}) AS e"
ORACLES["conversation_entities"] = f"""
SELECT {_ENTITY_COLUMNS}, base_intent FROM ({_labelled(_entities(tables.CONVERSATION_MESSAGES))}) AS l"""
_BASE = _labelled(_entities(tables.UTTERANCES))
ORACLES["intent_counts"] = f"""
SELECT base_intent, base_confidence, count(*) AS n FROM ({_BASE}) AS l GROUP BY ALL"""

# --- Dialogue ----------------------------------------------------------------


def _scored(view: str) -> str:
    """The dialogue over a view of messages: base, asked, ..., scored."""
    return f"""
base AS MATERIALIZED ({_labelled(_entities(view))}),
asked AS (
  SELECT *, lag(base_state) OVER u AS asked_state, lag(amount) OVER u AS asked_amount,
    lag(recipient) OVER u AS asked_recipient,
    coalesce(last_value(account_type IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'checking')
      AS account_before
  FROM base WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
candidates AS (
  SELECT *, CASE
    WHEN asked_state = 'awaiting_amount' AND (amount IS NOT NULL OR {_any('t', c.AMOUNT_WORDS)})
      THEN 'amount_specification'
    WHEN asked_state = 'awaiting_confirmation' AND {_any('t', c.YES_WORDS)} THEN 'confirmation_yes'
    WHEN asked_state = 'awaiting_confirmation' AND {_any('t', c.NO_WORDS)} THEN 'confirmation_no' END AS answer
  FROM asked),
islands AS (
  SELECT *, sum(CASE WHEN answer IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
  FROM candidates),
runs AS (
  SELECT *, sum(CASE WHEN answer IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY user_id, island ORDER BY ts, event_id) % 2 = 1 AND answer IS NOT NULL AS answered
  FROM islands),
scored AS MATERIALIZED (
  SELECT event_id, user_id, ts, message, account_type, transaction_id, date, range_start, range_end, amount, recipient,
    CASE WHEN answered THEN answer ELSE base_intent END AS intent,
    CASE WHEN answered THEN 0.9 ELSE base_confidence END AS confidence,
    CASE WHEN NOT answered THEN base_state WHEN answer = 'confirmation_yes' THEN 'transfer_completed'
         ELSE 'initial' END AS state,
    account_before, coalesce(account_type, account_before) AS active_account,
    CASE WHEN answered THEN asked_amount END AS pending_amount,
    CASE WHEN answered THEN asked_recipient END AS pending_recipient
  FROM runs)"""


_SCORED = _scored(tables.UTTERANCES)
ORACLES["dialogue_state"] = f"""
WITH {_SCORED} SELECT event_id, user_id, intent, CAST(confidence AS DOUBLE) AS confidence, state FROM scored"""
ORACLES["conversation_state"] = f"""
WITH {_scored(tables.CONVERSATION_MESSAGES)}
SELECT event_id, user_id, intent, CAST(confidence AS DOUBLE) AS confidence, state, active_account FROM scored"""
ORACLES["active_account"] = f"WITH {_SCORED} SELECT event_id, active_account FROM scored"
ORACLES["pending_action"] = f"""
WITH {_SCORED},
changes AS (
  SELECT *, CASE WHEN intent = 'transfer_money' AND (amount IS NOT NULL OR recipient IS NOT NULL)
      OR intent = 'amount_specification' AND amount IS NOT NULL OR intent = 'confirmation_no' THEN 1 ELSE 0 END AS changed
  FROM scored),
spans AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM changes),
heads AS (
  SELECT user_id, span, intent <> 'confirmation_no' AS live, intent, amount,
    CASE WHEN intent = 'amount_specification' THEN pending_recipient ELSE recipient END AS recipient,
    active_account, recipient IS NOT NULL AS named
  FROM spans WHERE changed = 1)
SELECT s.event_id, CASE WHEN h.live THEN 'transfer' END AS type,
  CASE WHEN h.live THEN CAST(h.amount AS VARCHAR) END AS amount, CASE WHEN h.live THEN h.recipient END AS recipient,
  CASE WHEN h.intent = 'transfer_money' AND h.amount IS NOT NULL AND h.named THEN h.active_account END AS from_account
FROM spans s LEFT JOIN heads h ON h.user_id = s.user_id AND h.span = s.span"""


def _memory(field: str, source: str | None = None) -> str:
    return (
        f"last_value({source or field} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {field}"
    )


ORACLES["entity_memory"] = f"""
SELECT event_id, {_memory('account_type')}, {_memory('transaction_id')}, {_memory('date')}, {_memory('range_start')},
  {_memory('range_end')}, {_memory('amount', 'CAST(amount AS VARCHAR)')}, {_memory('recipient')}
FROM ({_entities(tables.UTTERANCES)}) AS e"""

# --- Accounts and ledger -----------------------------------------------------

_LINE = (
    "date || ' | ' || description || ' | ' || CASE WHEN amount > 0 THEN '+' ELSE '' END || '$'"
    " || CAST(abs(amount) AS VARCHAR) || ' | ID: ' || id"
)
_TABLES = f"ledger AS MATERIALIZED ({tables.LEDGER}),\naccounts AS MATERIALIZED ({tables.ACCOUNTS})"
_TOP5 = "row_number() OVER (PARTITION BY {keys} ORDER BY l.date DESC, l.pos)"

ORACLES["ledger_flatten"] = """
WITH a AS (
  SELECT c_custkey AS user_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS account_number, c_name, c_mktsegment,
    CAST(c_acctbal AS DECIMAL(18,2)) AS money, 'T' || CAST(c_custkey + 20000 AS VARCHAR) AS number FROM customer)
SELECT user_id, 'checking' AS account_type, account_number, CAST(money AS VARCHAR) AS balance, 0 AS pos,
  '2025-05-01' AS date, c_mktsegment AS description, CAST(money AS VARCHAR) AS amount, number AS id FROM a
UNION ALL
SELECT user_id, 'checking', account_number, CAST(money AS VARCHAR), 1, '2025-05-02', c_name,
  CAST(-money AS VARCHAR), number || '1' FROM a
UNION ALL
SELECT user_id, 'savings', account_number, CAST(CAST(money * 2 AS DECIMAL(18,2)) AS VARCHAR), 0, '2025-04-15',
  'Interest', CAST(money AS VARCHAR), number || '2' FROM a WHERE user_id % 2 = 0"""
ORACLES["balance_lookup"] = f"""
WITH {_SCORED}, {_TABLES}
SELECT s.event_id, s.active_account AS account_type, CAST(a.balance AS VARCHAR) AS balance
FROM scored s LEFT JOIN accounts a ON a.user_id = s.user_id AND a.account_type = s.active_account
WHERE s.intent IN ('balance_inquiry', 'account_balance')"""
ORACLES["recent_txns"] = f"""
WITH {_TABLES}
SELECT user_id, account_type, {_TOP5.format(keys='user_id, account_type')} AS rn, date, id,
  CAST(amount AS VARCHAR) AS amount
FROM ledger l QUALIFY rn <= 5"""
ORACLES["txn_lines"] = f"WITH {_TABLES} SELECT id, {_LINE} AS line FROM ledger"
ORACLES["render_history"] = f"""
WITH {_TABLES},
ranked AS (SELECT *, {_TOP5.format(keys='user_id, account_type')} AS rn FROM ledger l)
SELECT user_id, account_type, string_agg(chr(10) || '- ' || {_LINE}, '' ORDER BY rn) AS listing
FROM ranked WHERE rn <= 5 GROUP BY user_id, account_type"""
ORACLES["bucketed_history"] = f"""
WITH {_TABLES},
ranked AS (SELECT *, {_TOP5.format(keys='user_id, account_type')} AS rn FROM ledger l),
listed AS (
  SELECT user_id, account_type, string_agg(chr(10) || '- ' || {_LINE}, '' ORDER BY rn) AS listing
  FROM ranked WHERE rn <= 5 GROUP BY user_id, account_type)
SELECT a.user_id, a.account_type, CAST(a.balance AS VARCHAR) AS balance, l.listing
FROM accounts a LEFT JOIN listed l ON l.user_id = a.user_id AND l.account_type = a.account_type"""
_SELECTED = "l.user_id = s.user_id AND l.account_type = s.active_account"
ORACLES["txn_by_id"] = f"""
WITH {_SCORED}, {_TABLES}
SELECT s.event_id, l.account_type, l.date, l.id, CAST(l.amount AS VARCHAR) AS amount
FROM scored s JOIN ledger l ON {_SELECTED} AND l.id = s.transaction_id"""
ORACLES["txn_on_date"] = f"""
WITH {_SCORED}, {_TABLES}
SELECT s.event_id, l.account_type, {_TOP5.format(keys='s.event_id')} AS rn, l.date, l.id,
  CAST(l.amount AS VARCHAR) AS amount
FROM scored s JOIN ledger l ON {_SELECTED} AND l.date = s.date
  AND (s.range_start IS NULL OR l.date BETWEEN s.range_start AND s.range_end)
WHERE s.transaction_id IS NULL
QUALIFY rn <= 5"""
ORACLES["txn_in_range"] = f"""
WITH {_SCORED}, {_TABLES}
SELECT s.event_id, l.account_type, {_TOP5.format(keys='s.event_id')} AS rn, l.date, l.id,
  CAST(l.amount AS VARCHAR) AS amount
FROM scored s JOIN ledger l ON {_SELECTED} AND l.date BETWEEN s.range_start AND s.range_end
WHERE s.date IS NULL AND s.transaction_id IS NULL
QUALIFY rn <= 5"""
ORACLES["accounts_upsert"] = f"""
WITH {_TABLES},
incoming AS (
  SELECT o_custkey AS user_id, 'savings' AS account_type,
    lpad(CAST(min(o_orderkey) AS VARCHAR), 10, '9') AS account_number,
    CAST(min(o_orderkey) AS DECIMAL(18,2)) AS balance
  FROM orders GROUP BY o_custkey)
SELECT coalesce(i.user_id, a.user_id) AS user_id, coalesce(i.account_type, a.account_type) AS account_type,
  coalesce(i.account_number, a.account_number) AS account_number,
  CAST(coalesce(i.balance, a.balance) AS VARCHAR) AS balance
FROM accounts a FULL JOIN incoming i ON i.user_id = a.user_id AND i.account_type = a.account_type"""

ORACLES["user_data_merge"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0
    THEN 'name=' || upper(c_name) || '; nation=' || c_nationkey || '; segment=' || c_mktsegment
    ELSE 'name=' || c_name || '; segment=' || c_mktsegment END AS data
FROM customer"""

# --- Replies -----------------------------------------------------------------

_ACCOUNT = "s.active_account"
_BALANCES = [_fill(t, account=_ACCOUNT, balance="a.balance") for t in c.BALANCE_REPLIES]


def _pick(options: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE s.event_id % {len(options)} {whens} END"


_MONEY = "CAST(s.amount AS VARCHAR)"
_ANSWERED = f"""{_SCORED}, {_TABLES},
listed AS (
  SELECT s.event_id, l.date, l.description, l.amount, l.id, {_TOP5.format(keys='s.event_id')} AS rn
  FROM scored s JOIN ledger l ON {_SELECTED}
  WHERE s.intent IN ('transaction_history', 'account_transactions')
     OR s.intent = 'date_transactions' AND s.date IS NOT NULL AND l.date = s.date
     OR s.intent = 'date_transactions' AND s.date IS NULL AND l.date BETWEEN s.range_start AND s.range_end),
listing AS (
  SELECT event_id, string_agg(chr(10) || '- ' || {_LINE}, '' ORDER BY rn) AS lines
  FROM listed WHERE rn <= 5 GROUP BY event_id),
answered AS MATERIALIZED (
  SELECT s.*, CASE
    WHEN s.intent = 'greeting' THEN {_pick([_s(g) for g in c.GREETING_REPLIES])}
    WHEN s.intent IN ('balance_inquiry', 'account_balance') THEN
      CASE WHEN a.balance IS NULL THEN {_reply('no_balance', account=_ACCOUNT)} ELSE {_pick(_BALANCES)} END
    WHEN s.intent IN ('transaction_history', 'account_transactions') THEN
      CASE WHEN g.lines IS NULL THEN {_reply('no_recent', account=_ACCOUNT)}
           ELSE {_reply('recent', account=_ACCOUNT, lines='g.lines')} END
    WHEN s.intent = 'date_transactions' AND s.date IS NOT NULL THEN
      CASE WHEN g.lines IS NULL THEN {_reply('none_on_date', date='s.date', account=_ACCOUNT)}
           ELSE {_reply('on_date', date='s.date', account=_ACCOUNT, lines='g.lines')} END
    WHEN s.intent = 'date_transactions' THEN
      CASE WHEN g.lines IS NULL
           THEN {_reply('none_in_range', start='s.range_start', end='s.range_end', account=_ACCOUNT)}
           ELSE {_reply('in_range', start='s.range_start', end='s.range_end', account=_ACCOUNT, lines='g.lines')} END
    WHEN s.intent = 'specific_transaction' AND s.transaction_id IS NULL THEN {_reply('fallback')}
    WHEN s.intent = 'specific_transaction' THEN
      CASE WHEN x.id IS NULL THEN {_reply('no_such', id='s.transaction_id', account=_ACCOUNT)}
           ELSE {_reply('one', id='s.transaction_id', detail="(x.date || ' | ' || x.description || ' | $' || CAST(abs(x.amount) AS VARCHAR) || ' | ' || CASE WHEN x.amount > 0 THEN 'Credit' ELSE 'Debit' END)")} END
    WHEN s.intent = 'transfer_money' THEN
      CASE WHEN s.amount IS NOT NULL AND s.recipient IS NOT NULL
           THEN {_reply('confirm', amount=_MONEY, account=_ACCOUNT, recipient='s.recipient')}
           WHEN s.amount IS NOT NULL THEN {_reply('ask_recipient', amount=_MONEY)}
           WHEN s.recipient IS NOT NULL THEN {_reply('ask_amount', recipient='s.recipient')}
           ELSE {_reply('ask_details')} END
    WHEN s.intent = 'amount_specification' AND s.amount IS NOT NULL
      THEN {_reply('confirm', amount=_MONEY, account='s.account_before', recipient='s.pending_recipient')}
    WHEN s.intent = 'confirmation_yes'
      THEN {_reply('transferred', amount='CAST(s.pending_amount AS VARCHAR)', account='s.account_before', recipient='s.pending_recipient')}
    WHEN s.intent = 'confirmation_no' THEN {_reply('cancelled')}
    ELSE {_reply('fallback')} END AS response
  FROM scored s
  LEFT JOIN accounts a ON a.user_id = s.user_id AND a.account_type = s.active_account
  LEFT JOIN listing g ON g.event_id = s.event_id
  LEFT JOIN ledger x ON x.user_id = s.user_id AND x.account_type = s.active_account AND x.id = s.transaction_id)"""
ORACLES["render_response"] = f"""
WITH {_ANSWERED}
SELECT event_id, user_id, message, intent, CAST(confidence AS DOUBLE) AS confidence, response FROM answered"""
_LOG = f"""{_ANSWERED},
chat_rows AS (
  SELECT event_id AS id, user_id, message, response, intent, CAST(confidence AS DOUBLE) AS confidence,
    date_trunc('second', ts) AS timestamp FROM answered)"""
ORACLES["chat_log"] = f"WITH {_LOG} SELECT * FROM chat_rows"
ORACLES["dialogue_stream"] = ORACLES["chat_log"]
ORACLES["chat_history_top10"] = f"""
WITH {_LOG},
newest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn FROM chat_rows QUALIFY rn <= 10)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) AS place, id, message, response
FROM newest"""
ORACLES["chat_cleared"] = f"""
WITH {_LOG}
SELECT id, user_id, intent FROM chat_rows
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _history(n: int) -> str:
    frame = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    shown = "message || '|' || intent || '|' || response"
    return f"""
WITH {_ANSWERED}
SELECT event_id, count(*) {frame} AS n, array_to_string(list({shown}) {frame}, chr(10)) AS history FROM answered"""


ORACLES["history_10"] = _history(10)
ORACLES["history_5"] = _history(5)
_CONTEXT = """coalesce(array_to_string(list('User: ' || message || chr(10) || 'Bot: ' || response)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)), '')"""
ORACLES["prompt_context"] = f"WITH {_ANSWERED} SELECT event_id, {_CONTEXT} AS context FROM answered"

# --- Users -------------------------------------------------------------------

_CHECKED = f"""
requests AS ({tables.REGISTRATIONS}),
valid AS (
  SELECT * FROM requests WHERE length(username) >= 3 AND has_password AND password_length >= 8 AND passwords_match),
ranked AS (SELECT id, row_number() OVER (PARTITION BY username ORDER BY id) AS rn FROM valid),
checked AS (
  SELECT r.*, CASE WHEN r.username = '' OR NOT r.has_password THEN 'missing_field'
      WHEN length(r.username) < 3 OR r.password_length < 8 THEN 'too_short'
      WHEN NOT r.passwords_match THEN 'password_mismatch'
      WHEN k.rn = 1 THEN 'accepted' ELSE 'name_taken' END AS status
  FROM requests r LEFT JOIN ranked k ON k.id = r.id)"""
ORACLES["unique_users"] = f"WITH {_CHECKED} SELECT id, username, created_at FROM checked WHERE status = 'accepted'"
ORACLES["registration_check"] = f"WITH {_CHECKED} SELECT id, username, status FROM checked"
ORACLES["chat_orphans"] = f"""
WITH {_LOG}
SELECT id, user_id, intent FROM chat_rows WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""
ORACLES["latest_chats"] = f"""
WITH {_LOG}
SELECT id, message, response FROM chat_rows WHERE user_id = {tables.SHOWN_USER} ORDER BY timestamp DESC, id DESC LIMIT 10"""
ORACLES["user_lookup"] = f"""
WITH {_CHECKED} SELECT id, username, created_at FROM checked WHERE status = 'accepted' AND username = 'user{tables.SHOWN_USER}'"""

# --- Prompts -----------------------------------------------------------------

_RAW = """
raw AS (
  SELECT event_id, user_id, CASE event_id % 5
    WHEN 0 THEN ' ''' || base_intent || '''' || chr(10) WHEN 1 THEN '"' || base_intent || '"'
    WHEN 2 THEN 'Intent: ' || base_intent WHEN 3 THEN base_intent END AS raw FROM base),
labels_checked AS (
  SELECT *, trim(replace(replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '''', ''), '"', '')) AS label FROM raw),
""" + f"""
labelled AS (
  SELECT *, CASE WHEN raw IS NULL THEN 'error' WHEN label IN {_in(c.INTENT_TAGS)} THEN label ELSE 'greeting' END AS intent,
    CAST(CASE WHEN raw IS NULL THEN 0 WHEN label IN {_in(c.INTENT_TAGS)} THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence
  FROM labels_checked),
templates AS (
  SELECT tag, choices || ['Another way: ' || choices[1], tag || '?'] AS choices
  FROM (VALUES {", ".join(f"({_s(t)}, {_list(r)})" for t, _, r in c.DEFAULT_INTENTS)}) AS v(tag, choices))"""
_CHOSEN = f"coalesce(t.choices[b.event_id % len(t.choices) + 1], {_s(c.REPLIES['unknown_tag'])})"
ORACLES["label_validate"] = f"""
WITH base AS ({_BASE}), {_RAW} SELECT event_id, raw, intent, confidence FROM labelled"""
ORACLES["template_pick"] = f"""
WITH base AS ({_BASE}), {_RAW}
SELECT b.event_id, b.base_intent AS intent, {_CHOSEN} AS reply
FROM base b LEFT JOIN templates t ON t.tag = b.base_intent"""
ORACLES["template_fill"] = f"""
WITH base AS ({_BASE}), {_RAW}, {_TABLES},
shown AS (
  SELECT user_id, account_type || ': ' || string_agg({_LINE}, '; ' ORDER BY rn) AS part
  FROM (SELECT *, {_TOP5.format(keys='user_id, account_type')} AS rn FROM ledger l) AS r
  WHERE rn <= 5 GROUP BY user_id, account_type),
newest AS (SELECT user_id, string_agg(part, '; ' ORDER BY part) AS transactions FROM shown GROUP BY user_id),
held AS (SELECT user_id, string_agg(account_type || ': ' || CAST(balance AS VARCHAR), '; ' ORDER BY account_type || ': ' || CAST(balance AS VARCHAR)) AS balance
  FROM accounts GROUP BY user_id)
SELECT b.event_id, b.intent, CASE
    WHEN b.intent = 'balance_inquiry' AND a.balance IS NOT NULL
      THEN replace({_CHOSEN}, '[AMOUNT]', CAST(a.balance AS VARCHAR))
    WHEN b.intent = 'transaction_history' AND n.transactions IS NOT NULL
      THEN replace({_CHOSEN}, '[TRANSACTIONS]', n.transactions)
    ELSE {_CHOSEN} END AS reply
FROM labelled b LEFT JOIN templates t ON t.tag = b.intent
LEFT JOIN held a ON a.user_id = b.user_id
LEFT JOIN newest n ON n.user_id = b.user_id"""
_SHOWN = "coalesce(array_to_string(list_transform(t.choices, lambda x: '- ' || x), chr(10)), '')"
ORACLES["prompt_dataset"] = f"""
WITH {_ANSWERED}, {_RAW},
contexts AS (SELECT event_id, message, intent, {_CONTEXT} AS context FROM answered)
SELECT k.event_id, {_fill(CLASSIFY, tags=_s(", ".join(c.INTENT_TAGS)), message='k.message')} AS classify,
  {_fill(REPLY, intent='k.intent', context='k.context', message='k.message', templates=_SHOWN)} AS reply
FROM contexts k LEFT JOIN templates t ON t.tag = k.intent"""
ORACLES["speech_text"] = """
SELECT conv_id, turn, regexp_replace(regexp_replace(
    ' [10:' || turn || '] ' || text || ' [speaker] ', '\\[[^\\n\\r]*?\\]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS spoken
FROM conversations"""
ORACLES["locale_map"] = f"""
SELECT doc_id, lang, CASE lang {" ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in c.LOCALES.items())}
  ELSE {_s(c.DEFAULT_LOCALE)} END AS locale FROM ({tables.LANGUAGES}) AS l"""

# --- Files -------------------------------------------------------------------

ORACLES["scan_csv_roundtrip"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLES["scan_csv_splits"] = ORACLES["scan_csv_roundtrip"]
ORACLES["intent_patterns_flat"] = """
SELECT p_brand AS tag, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS place, unnest(w) AS pattern
FROM (SELECT p_brand, string_split(p_name, ' ') AS w FROM part) AS s
UNION ALL SELECT p_type, 0, 'find ' || p_name FROM part"""
ORACLES["template_catalog"] = """
SELECT p_partkey, p_brand AS intent, 0 AS place, 'About ' || p_name AS template FROM part
UNION ALL SELECT p_partkey, p_brand, 1, p_type FROM part
UNION ALL SELECT p_partkey, 'fallback', 0, 'Which "' || p_type || '"?' FROM part"""

ORACLES["tolerant_scan"] = """
SELECT 'complaints' AS name, count(*) AS n, min(o_orderkey) + 1 AS first, max(o_orderkey) + 1 AS last FROM orders
UNION ALL SELECT 'faqs', count(*), min(doc_id) + 1, max(doc_id) + 1 FROM documents"""
ORACLES["fallback_intents"] = f"""
WITH base AS ({_BASE}),
patterns AS (SELECT * FROM (VALUES {", ".join(f"({_s(t)}, {i}, {_s(p)})" for t, ps, _ in c.DEFAULT_INTENTS for i, p in enumerate(ps))})
  AS v(tag, place, pattern))
SELECT b.event_id, p.tag, p.place, p.pattern FROM base b JOIN patterns p ON p.tag = b.base_intent"""
ORACLES["account_switch"] = f"""
WITH {_TABLES},
s AS (
  SELECT user_id, account_type AS account, user_id % 3 > 0 AS pending,
    CASE WHEN user_id % 5 < 3 THEN balance END AS amount, CASE WHEN user_id % 7 < 4 THEN 'ann' END AS recipient
  FROM accounts)
SELECT user_id, account, CASE
  WHEN pending AND amount IS NOT NULL AND recipient IS NOT NULL
    THEN {_reply('confirm', amount='amount', account='account', recipient='recipient')}
  WHEN pending AND amount IS NOT NULL THEN {_reply('switched_ask_recipient', amount='amount', account='account')}
  WHEN pending AND recipient IS NOT NULL THEN {_reply('switched_ask_amount', recipient='recipient', account='account')}
  ELSE {_reply('switched', account='account')} END AS reply FROM s"""
ORACLES["failure_rows"] = f"""
SELECT event_id, user_id, 'error' AS intent, CAST(0 AS DOUBLE) AS confidence, {_reply('error')} AS response
FROM ({tables.PARTLY_MISSING}) AS m WHERE message IS NULL"""
ORACLES["model_answers"] = f"""
WITH base AS ({_BASE}),
asked AS (
  SELECT event_id, CASE WHEN contains(t, 'evening') THEN 'error' WHEN contains(t, 'balance') THEN 'balance_inquiry'
    WHEN contains(t, 'history') THEN 'transaction_history' ELSE 'greeting' END AS intent,
    CASE WHEN contains(t, 'evening') THEN 0.0 WHEN contains(t, 'balance') OR contains(t, 'history') THEN 0.9 ELSE 0.5 END AS confidence,
    CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS balance,
    CASE WHEN event_id % 3 = 0 THEN 'T' || event_id END AS transactions
  FROM base)
SELECT event_id, intent, CAST(confidence AS DOUBLE) AS confidence, CASE
  WHEN intent = 'error' THEN {_s(c.REPLIES['unknown_tag'])}
  WHEN intent = 'balance_inquiry' AND balance IS NOT NULL THEN 'On ' || intent || ': ' || balance || ' [TRANSACTIONS]'
  WHEN intent = 'transaction_history' AND transactions IS NOT NULL THEN 'On ' || intent || ': [AMOUNT] ' || transactions
  ELSE 'On ' || intent || ': [AMOUNT] [TRANSACTIONS]' END AS response
FROM asked"""

ORACLES["model_dialogue"] = f"""
WITH RECURSIVE said AS MATERIALIZED (
  SELECT event_id, user_id, message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn,
    ['balance_inquiry', 'transaction_history', 'greeting', 'error'][length(message) % 4 + 1] AS intent,
    [0.9, 0.9, 0.5, 0.0][length(message) % 4 + 1] AS confidence,
    CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS balance,
    CASE WHEN user_id % 3 = 0 THEN 'T' || user_id END AS transactions
  FROM ({tables.CONVERSATION_MESSAGES})),
templates AS (SELECT * FROM (VALUES {", ".join(f"({_s(t)}, {_list(r)})" for t, _, r in c.DEFAULT_INTENTS)}) AS v(tag, replies)),
rows AS MATERIALIZED (SELECT s.*, t.replies FROM said s LEFT JOIN templates t ON t.tag = s.intent),
talk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS response,
    CAST([] AS VARCHAR[]) AS spoken, CAST([] AS VARCHAR[]) AS bots FROM (SELECT DISTINCT user_id FROM rows)
  UNION ALL
  SELECT user_id, turn, event_id, response, list_append(spoken, 'User: ' || message || chr(10) || 'Bot: ' || response), list_append(bots, response)
  FROM (
    SELECT *, CASE WHEN intent = 'error' THEN {_s(c.REPLIES['unknown_tag'])}
      WHEN digest[1] IN ('c', 'f') THEN replies[event_id % len(replies) + 1]
      WHEN intent = 'balance_inquiry' AND balance IS NOT NULL THEN 'After ' || digest[1:6] || ': ' || balance || ' [TRANSACTIONS]'
      WHEN intent = 'transaction_history' AND transactions IS NOT NULL THEN 'After ' || digest[1:6] || ': [AMOUNT] ' || transactions
      ELSE 'After ' || digest[1:6] || ': [AMOUNT] [TRANSACTIONS]' END AS response
    FROM (
      SELECT r.*, t.spoken, t.bots, md5(array_to_string(t.spoken[greatest(len(t.spoken) - 2, 1):], chr(10))) AS digest
      FROM talk t JOIN rows r ON r.user_id = t.user_id AND r.turn = t.turn + 1)))
SELECT t.event_id, t.turn, r.intent, CAST(r.confidence AS DOUBLE) AS confidence, t.response,
  CAST(least(len(t.bots), 5) AS INTEGER) AS remembered, md5(array_to_string(t.bots[greatest(len(t.bots) - 4, 1):], chr(10))) AS bots_md5
FROM talk t JOIN rows r USING (event_id)"""

# --- Generated tables --------------------------------------------------------

_NOW = f"TIMESTAMP '{AS_OF}'"


def _generator(table: str, source: str, key: str, columns: dict[str, str]) -> str:
    shown = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT {shown} FROM (SELECT {key} + 1 AS id FROM {source}) AS ids"


def _digest(table: str, part: str) -> str:
    return f"md5('{SEED}:{table}:{part}:' || id)"


def _draw(table: str, part: str) -> str:
    return f"CAST('0x' || substr({_digest(table, part)}, 1, 15) AS BIGINT)"


_USER = "(1 + {} % (SELECT count(*) FROM customer))"


class _Sql:
    def __init__(self, table: str):
        self.table = table

    def draw(self, part):
        return _draw(self.table, part)

    def below(self, part, n):
        return f"({self.draw(part)} % {n})"

    def pick(self, part, options):
        return f"{_list(options)}[{self.below(part, len(options))} + 1]"

    def whole(self, part, low, high):
        return f"({low} + {self.below(part, high - low + 1)})"

    def money(self, part, low, high):
        cents = self.whole(part, low * 100, high * 100)
        return f"({cents} // 100 || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"

    def moment(self, part, days):
        return f"({_NOW} - to_seconds({self.below(part, days * 86400)}))"

    def text(self, part, words):
        digest = _digest(self.table, part)
        return (
            f"array_to_string(list_transform(range(0, {words}), lambda i: {_list(c.FILLER_WORDS)}["
            f"CAST('0x' || substr({digest}, 2 * i + 1, 2) AS BIGINT) % {len(c.FILLER_WORDS)} + 1]), ' ')"
        )


def _generated() -> None:
    def add(table, source, key, build):
        g = _Sql(table)
        ORACLES[f"gen_{table}"] = _generator(table, source, key, build(g))

    add("user_details", "customer", "c_custkey", lambda g: {
        "user_id": "id",
        "name": f"{g.pick('first', c.FIRST_NAMES)} || ' ' || {g.pick('last', c.LAST_NAMES)}",
        "email": f"lower({g.pick('first', c.FIRST_NAMES)} || '.' || {g.pick('last', c.LAST_NAMES)}) || id || '@example.com'",
        "phone": f"'555-' || lpad(CAST({g.below('phone', 10_000_000)} AS VARCHAR), 7, '0')",
        "address": f"{g.whole('house', 1, 999)} || ' ' || {g.pick('street', c.STREETS)} || ' Street' || chr(10) || "
                   f"{g.pick('city', c.CITIES)} || ', ' || lpad(CAST({g.below('zip', 100_000)} AS VARCHAR), 5, '0')",
        "date_of_birth": f"CAST(CAST({_NOW} AS DATE) - INTERVAL 18 YEAR AS DATE) - CAST({g.below('dob', 26645)} AS INTEGER)",
        "occupation": g.pick("occupation", c.JOBS),
        "annual_income": g.whole("annual_income", 300_000, 2_000_000),
    })
    add("transaction_details", "events", "event_id", lambda g: {
        "transaction_id": "id", "user_id": _USER.format(g.draw("user_id")), "type": g.pick("type", c.TRANSACTION_TYPES),
        "amount": g.money("amount", 100, 100_000), "timestamp": g.moment("timestamp", 365),
        "status": g.pick("status", c.TRANSACTION_STATUSES), "description": g.text("description", 5),
    })
    month = "CAST(CAST(TIMESTAMP '{}' AS DATE) + to_months(CAST({} AS INTEGER)) AS DATE)"
    add("credit_cards", "customer", "c_custkey", lambda g: {
        "card_id": "id", "user_id": _USER.format(g.draw("user_id")), "card_type": g.pick("card_type", c.CARD_TYPES),
        "card_number": " || ".join(
            f"lpad(CAST({g.below(f'digits{i}', 100_000_000)} AS VARCHAR), 8, '0')" for i in (1, 2)),
        "expiry_date": f"strftime({month.format(AS_OF, g.below('expiry', 120))}, '%m/%y')",
        "credit_limit": f"CAST({g.pick('credit_limit', c.CARD_LIMITS)} AS BIGINT)",
        "current_balance": g.money("current_balance", 0, 100_000), "status": g.pick("status", c.CARD_STATUSES),
    })
    add("loans", "customer", "c_custkey", lambda g: {
        "loan_id": "id", "user_id": _USER.format(g.draw("user_id")), "loan_type": g.pick("loan_type", c.LOAN_TYPES),
        "amount": g.money("amount", 100_000, 10_000_000), "interest_rate": g.money("interest_rate", 7, 15),
        "term_months": f"CAST({g.pick('term_months', c.LOAN_TERMS)} AS INTEGER)",
        "status": g.pick("status", c.LOAN_STATUSES), "application_date": g.moment("application_date", 730),
    })
    add("complaints", "orders", "o_orderkey", lambda g: {
        "complaint_id": "id", "user_id": _USER.format(g.draw("user_id")), "type": g.pick("type", c.COMPLAINT_TYPES),
        "description": g.text("description", 16), "priority": g.pick("priority", c.COMPLAINT_PRIORITIES),
        "status": g.pick("status", c.COMPLAINT_STATUSES), "created_at": g.moment("created_at", 365),
        "resolved_at": g.moment("resolved_at", 365),
    })
    add("fraud_reports", "orders", "o_orderkey", lambda g: {
        "report_id": "id", "user_id": _USER.format(g.draw("user_id")), "fraud_type": g.pick("fraud_type", c.FRAUD_TYPES),
        "description": g.text("description", 16), "amount_involved": g.money("amount_involved", 1_000, 500_000),
        "reported_date": g.moment("reported_date", 365), "status": g.pick("status", c.FRAUD_STATUSES),
    })
    n = len(c.FAQ_PAIRS)

    def faqs(g):
        place = f"CASE WHEN id <= {n} THEN id ELSE {g.below('pair', n)} + 1 END"
        return {
            "question_id": "id", "question": f"{_list([q for q, _ in c.FAQ_PAIRS])}[{place}]",
            "answer": f"{_list([a for _, a in c.FAQ_PAIRS])}[{place}]", "category": g.pick("category", c.FAQ_CATEGORIES),
        }

    add("faqs", "documents", "doc_id", faqs)
    add("assistance", "events", "event_id", lambda g: {
        "assistance_id": "id", "user_id": _USER.format(g.draw("user_id")), "type": g.pick("type", c.ASSISTANCE_TYPES),
        "query": g.text("query", 16), "status": g.pick("status", c.ASSISTANCE_STATUSES),
        "created_at": g.moment("created_at", 365),
        "response_time": f"CAST({g.whole('response_time', 1, 72)} AS INTEGER)",
    })


_generated()
ORACLES["sliced_dialogue_stream"] = ORACLES["dialogue_stream"]
