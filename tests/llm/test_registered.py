"""The registered queries against their SQL, and the pipeline stage by stage."""

import re

import pytest
from compare import connect, difference
from edge import documents, none
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tellerflow.llm import decontaminate, pii, queries, simhash, toxicity
from tellerflow.sources.tables import table


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    assert difference(spark, connect(sf_dir), name, sf_dir) is None


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, sf_dir), "stage")
        ids = {r.doc_id for r in before.collect()}
        kept = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == before.columns
        if name == "toxicity":
            scores = toxicity.score_documents(before, table(spark, sf_dir, "labels")).collect()
            assert kept.keys() == {r.doc_id for r in scores if r.score < toxicity.THRESHOLD}
        elif name == "near duplicates":
            assert kept.keys() == {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert docs.count() == len(kept)
        elif name == "decontamination":
            found = decontaminate.contamination(before, table(spark, sf_dir, "benchmark")).collect()
            assert kept.keys() == {r.doc_id for r in found if not r.found.hits}
        elif name == "personal data":
            assert kept.keys() == ids
            for r in pii.personal_data(before).collect():
                assert len(re.findall("<(?:EMAIL|IP|CARD|PHONE)>", kept[r.doc_id].text)) >= len({s.start for s in r.spans if s.base} and [1])
            assert not any(c.base for r in kept.values() for c in pii.find(r.text))
            assert all(r.n_chars == len(r.text) for r in kept.values())
        else:
            assert kept.keys() <= ids and {"epoch", "position"} <= set(docs.columns)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_anything(spark, sf_dir, name, stage):
    docs = documents(spark, "score", "found", "spans", "fp", "epoch", "row", "key")
    out = stage(spark, docs, sf_dir)
    assert out.count() > 0
    if name != "mixing":
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert {r.score for r in out.select("score").collect()} == {"mine"}
    assert stage(spark, none(spark), sf_dir).count() == 0
    assert stage(spark, docs.withColumn("text", F.lit(None).cast("string")), sf_dir).count() >= 0
