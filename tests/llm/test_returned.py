"""What the registered queries without SQL return over whole tables, against plain Python over the same rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_classifiers import plain_entropy, plain_models
from test_mixing import check
from test_near_duplicates import plain_components, plain_fingerprint
from test_pii import plain as plain_spans

import __spark_entry__ as entry
from tellerflow.llm import mixing, toxicity
from tellerflow.sources.tables import table


def run(spark, sf_dir, number):
    name = next(n for n in entry.queries() if n.startswith(f"op{number}_"))
    return entry.queries()[name](spark, sf_dir)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").collect()


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_personal_data(spark, sf_dir, docs):
    found = run(spark, sf_dir, 1)
    types = dict(found.dtypes)
    assert [types[f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == ["bigint"] * 4
    rows = found.collect()
    assert ids(rows) == ids(docs)
    texts = {r.doc_id: r.text or "" for r in docs}
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        line = ",".join(f"{kind}:{start}:{end}" for kind, start, end in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == kind for s in want) for kind in ("email", "ip", "card", "phone")]
        spans = r.spans.split(",") if r.spans else []
        assert set(line.split(",") if line else []) <= set(spans)
        for kind, start, end in (s.split(":") for s in spans):
            assert 0 <= int(start) < int(end) <= len(texts[r.doc_id])
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0


def test_licences(spark, sf_dir, docs):
    rows = run(spark, sf_dir, 2).collect()
    assert ids(rows) == ids(docs)
    marks = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC"}
    texts = {r.doc_id: r.text or "" for r in docs}
    for r in rows:
        text = texts[r.doc_id]
        assert r.families == ",".join(sorted({family for mark, family in marks.items() if mark in text}))
        notices = [n.split(":") for n in r.notices.split(",") if n]
        assert len(notices) == r.n_notices
        for family, start, end in notices:
            assert any(mark in text[int(start):int(end)] for mark, own in marks.items() if own == family)
    assert sum(r.n_notices for r in rows) > 0


def test_near_duplicates(spark, sf_dir, docs):
    rows = run(spark, sf_dir, 5).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs])
    assert sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows], key=str) == want


def test_toxicity(spark, sf_dir, docs):
    """The returned score is the plain sum of a text's votes and features under the trained weights."""
    frame = run(spark, sf_dir, 7)
    assert dict(frame.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = frame.collect()
    assert ids(rows) == ids(docs)
    labels = table(spark, sf_dir, "labels")
    terms, weights = toxicity.train(table(spark, sf_dir, "documents"), labels)
    voters = toxicity.Voters(terms)
    texts = {r.doc_id: r.text or "" for r in docs}
    for r in rows:
        assert r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.3)
        odds = sum(float(x) * float(w) for x, w in zip(voters.read(texts[r.doc_id])[1], weights)) + float(weights[-1])
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id in toxic) for r in held) > 0.95 * len(held)


def test_labels_of_held_out_rows_are_not_learnt(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = spark.createDataFrame([(r.doc_id, 1 - r.toxic if held_out(r.doc_id) and r.toxic in (0, 1) else r.toxic) for r in labels.collect()], "doc_id long, toxic int")
    terms, weights = toxicity.train(docs, labels)
    others, same = toxicity.train(docs, turned)
    assert terms == others and np.allclose(weights, same)


def test_mixture(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    rows = run(spark, sf_dir, 8).collect()
    check(documents.select("doc_id", "source", "text"), rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(documents, keep=["doc_id", "source"]).collect()))


def test_neighbours(spark, sf_dir):
    frame = run(spark, sf_dir, 9)
    assert dict(frame.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = {}
    for r in table(spark, sf_dir, "embeddings").collect():
        if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding):
            vectors[r.vec_id] = np.array(r.embedding, float)
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in vectors if i % 20 == 0}
    met = []
    for query, own in found.items():
        scored = sorted((-float(vectors[query] @ v), i) for i, v in vectors.items() if i != query and len(v) == len(vectors[query]))
        assert [r.rank for r in own] == list(range(1, min(20, len(scored)) + 1))
        assert all(r.score == pytest.approx(float(vectors[query] @ vectors[r.vec_id]), abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        met.append(len({i for _, i in scored[:20]} & {r.vec_id for r in own}) / len(own))
    assert np.mean(met) >= 0.9


def test_languages(spark, sf_dir, docs):
    """Every prediction is that of plain Kneser-Ney models over the rows that may be learnt from."""
    frame = run(spark, sf_dir, 10)
    types = dict(frame.dtypes)
    assert (types["held_out"], types["lang_pred"], types["score"]) == ("boolean", "string", "double")
    rows = frame.collect()
    assert ids(rows) == ids(docs)
    models = plain_models([(r.lang, r.text or "") for r in docs if r.lang is not None and not held_out(r.doc_id)])
    texts = {r.doc_id: r.text or "" for r in docs}
    for r in rows:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        if not re.search(r"[^\W\d_]", texts[r.doc_id]):
            assert r.lang_pred == "und"
            continue
        entropy = plain_entropy(models, texts[r.doc_id])
        assert entropy[r.lang_pred] == pytest.approx(min(entropy.values()), rel=1e-5)
