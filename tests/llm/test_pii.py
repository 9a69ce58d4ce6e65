import re

import numpy as np
from edge import documents, none
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellerflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return (
        [("email", *m.span()) for m in EMAIL.finditer(text)]
        + [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        + [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    )


def base(text):
    return [(c.kind, c.start, c.end) for c in pii.find(text) if c.base]


PIECES = ["4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "256.1.1.1", "a@b.co", "@", "a.b%c@x-y.zz.d", "+1 (212) 555-0100", "+", " ", ".", "-",
          "1", "12", "999", "0", "é", "(", ")", "b", "%", "5500-0000-0000-0004", "1.2.3.4.5.6.7.8", "😀"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_are_the_plain_patterns(text):
    assert base(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 50_000, "+1" + "(" * 100_000, "A" * 100_000 + " 1" * 100_000):
        pii.find(text)


def test_numbers_of_thousands_of_digits():
    assert base("9" * 6000 + ".1.1.1 " + "0" * 6000 + "7.1.1.1") == [("ip", 6007, 6007 + 6001 + 6)]


def test_edges(spark):
    docs = documents(spark, "spans", "code")
    rows = pii.personal_data(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == plain(texts[row.doc_id])
    assert pii.personal_data(none(spark)).count() == 0


def test_further_kinds_and_redaction(spark):
    told = [
        'token = "44e15e09fd311c3cf3163b66d0"', "password: hunter2hunter2", "IBAN DE89 3704 0044 0532 0130 00", "ssn 123-45-6789",
        "write to jane.doe (at) example (dot) com", "call (212) 555-0199 now", "Dr. Smith met Mary Jones",
    ]
    clean = ["version 1.2.3 of the book", "the total is 1234567", "In 2024 we met", "token ring network", "order #123-456-7890-1"]
    docs = spark.createDataFrame([(k, f"{t} mail a{k}@b{k}.org") for k, t in enumerate(told * 20)] + [(1000 + k, t) for k, t in enumerate(clean * 20)],
                                 "doc_id long, text string")
    found = {r.doc_id: {s.kind for s in r.spans} for r in pii.personal_data(docs).collect()}
    want = ["secret", "secret", "iban", "ssn", "email", "phone", "name"]
    assert all(kind in found[k] for k, kind in enumerate(want))
    assert not any(found[1000 + k] for k in range(len(clean)))
    accepted = pii.train(docs.select(pii.candidates(F.col("text")).alias("spans")))
    rows = {r.doc_id: r.clean for r in docs.select("doc_id", pii.redactor(accepted)(F.col("text"), pii.candidates(F.col("text"))).alias("clean")).collect()}
    assert rows[0] == 'token = "<SECRET>" mail <EMAIL>'
    assert rows[1000] == clean[0]
    assert docs.select(pii.redactor(accepted)(F.lit(None).cast("string"), pii.candidates(F.lit(None).cast("string"))).alias("x")).first().x is None


def test_reliabilities_come_from_the_votes():
    """A pattern no strict rule backs is believed when its labelers agree, and not when they disagree."""
    def code(kind, *votes):
        value = pii.KINDS.index(kind)
        for v in votes:
            value = value * 3 + v + 1
        return value

    good, bad, strict = code("secret", 0, 1, 0, 1, 1, 0, 1, 1), code("secret", 0, -1, -1, 0, 0, -1, -1, -1), code("email", 1, 1, 0, 1, 1, 0, 1, 1)
    belief = pii.label_model([good, bad, strict], np.array([50.0, 50.0, 100.0]))
    assert belief[0] > 0.8 > 0.2 > belief[1]
    assert pii.decode(good) == (pii.KINDS.index("secret"), [0, 1, 0, 1, 1, 0, 1, 1])
