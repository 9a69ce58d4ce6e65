"""Text preparation against the standard library's regex on random text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tellerflow.functions import textprep
from tellerflow.operators import lemmas
from tellerflow.sources import catalogue

ALPHABET = list("ab1239.,$€ @#%&*-_/'!?\t\n") + ["rs", "usd", "हि", "é", " ", " ", "\x1c", "٣", "½", "http://", "www."]


def column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r.out for r in df.select("i", expression(F.col("t")).alias("out")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(4000)]


def test_currency(spark, texts):
    pattern = re.compile(r"(\$|€|£|₹|¥|₩|₽|₿|rs|inr|usd)\s?\d+([.,]\d+)*")
    assert column(spark, texts, textprep.mark_currency) == [pattern.sub(" CURRENCY ", t) for t in texts]


def test_numbers_count_their_separators(spark, texts):
    def mark(text):
        return re.sub(r"\d+([.,]\d+)*", lambda m: " NUMBER " if len(m[0]) > 3 else m[0], text)

    assert column(spark, texts, textprep.mark_numbers) == [mark(t) for t in texts]


def test_mail_addresses(spark, texts):
    assert column(spark, texts, textprep.mark_emails) == [re.sub(r"\S+@\S+", " EMAIL ", t) for t in texts]


def test_characters_and_spaces(spark, texts):
    def keep(text):
        kept = "".join(ch if ch.isalnum() or ch in "@#%&*-_/" else " " for ch in text)
        return " ".join(kept.split())

    assert column(spark, texts, textprep.keep_characters) == [keep(t) for t in texts]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("cars 5", "ca CURRENCY"),
        ("1.5 and 12.5", "1 5 and NUMBER"),
        ("The bank's app won't open", "the bank is app will not open"),
        ("see https://x.org/12345?a=b now", "see URL NUMBER a b now"),
        ("mail me@x.org!", "mail EMAIL"),
        ("हिन्दी", "ह न द"),
        (None, ""),
    ],
)
def test_clean(spark, raw, cleaned):
    assert column(spark, [raw], textprep.clean) == [cleaned]


def test_tokens(spark):
    text = "cannot a@b 50%--x wanna go gonna_x R&D #7"
    assert column(spark, [text], textprep.tokenize) == [
        ["can", "not", "a", "@", "b", "50", "%", "--", "x", "wan", "na", "go", "gonna_x", "R", "&", "D", "#", "7"]
    ]


def test_domain_terms_beat_stop_words_and_lemmas(spark):
    assert column(spark, ["Please check the savings balance of my accounts"], textprep.preprocess) == [
        "check savings balance account"
    ]


def test_answer_of_the_first_faq(spark):
    answer = catalogue.FAQ_PAIRS[0][1]
    assert column(spark, [answer], lambda c: textprep.preprocess(c, {"documents": "document"})) == [
        "visit nearest branch required document apply online website"
    ]


def test_long_texts_do_not_overflow_the_regex_stack(spark):
    texts = ["1," * 50_000 + "1", "a" * 200_000, "a@" * 50_000, "to " + "word " * 30_000 + "account"]
    marked = column(spark, texts, textprep.clean)
    assert marked[0] == "NUMBER" and marked[1] == texts[1] and marked[2] == "EMAIL"


def test_noun_lemmas(spark):
    tokens = spark.createDataFrame([(w,) for w in "cats boxes flies men mice glass cards xyzs".split()], "token string")
    lexicon = spark.createDataFrame([(w,) for w in "cat box fly man mouse glass glas".split()], "word string")
    irregular = spark.createDataFrame([("mice", "mouse")], "token string, lemma string")
    found = {r.token: r.lemma for r in lemmas.noun_lemmas(tokens, lexicon, irregular).collect()}
    assert found == {"cats": "cat", "boxes": "box", "flies": "fly", "men": "man", "mice": "mouse", "glass": "glas"}


def test_lemma_join_keeps_order_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, ["b", "cats", "b", "cats"]), (2, [])], "id int, tokens array<string>")
    table = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    found = {r.id: r.lemmas for r in lemmas.lemmatize_tokens(docs, "id", "tokens", table, literal=0).collect()}
    assert found == {r.id: r.lemmas for r in lemmas.lemmatize_tokens(docs, "id", "tokens", table).collect()}
    assert found == {1: ["b", "cat", "b", "cat"], 2: []}


def test_large_lemma_tables_are_taken(spark):
    from tellerflow.operators import lemmas

    table = {f"word{k}s": f"word{k}" for k in range(2000)}
    frame = spark.createDataFrame([(1, "word7s word1999s accounts words"), (2, "")], "id int, text string")
    tokens = frame.select("id", F.split("text", " ").alias("t"))
    plain = {r.id: r.x for r in tokens.select("id", textprep.lemmatize_with(F.col("t"), table).alias("x")).collect()}
    joined = {r.id: r.lemmas for r in lemmas.lemmatize_tokens(tokens, "id", "t", spark.createDataFrame(list(table.items()), "token string, lemma string"), literal=0).collect()}
    assert plain == joined and plain[1] == ["word7", "word1999", "accounts", "words"]


def test_lemmas_do_not_move_the_tokens(spark):
    from tellerflow.operators import lemmas

    frame = spark.createDataFrame([(k, ["cars", "a", "cars", None]) for k in range(5)], "id int, t array<string>")
    found = lemmas.lemmatize_tokens(frame, "id", "t", spark.createDataFrame([("cars", "car")], "token string, lemma string"), ["s"], literal=0)
    assert {tuple(r.lemmas) for r in found.collect()} == {("car", "a", "car")}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in text and text.count("Generate explode") == 1
