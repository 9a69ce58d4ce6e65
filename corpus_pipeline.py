"""A corpus from raw documents: STAGES in order, each over all that the one before has kept.

All stages take empty tables, texts of any length, repeated rows, nulls in any column, and extra columns
under names that a stage would like to use itself: these stay, and the stage takes another name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerflow.llm import decontaminate, mixing, pii, simhash, toxicity
from tellerflow.llm.common import fresh, store
from tellerflow.sources.tables import table

#: No SQL can state the toxicity model's decisions, on which every later row depends.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt on the given documents, doesn't reject. A null text counts as empty."""
    score = toxicity.scorer(*toxicity.train(docs, table(spark, sf_dir, "labels")))
    name = fresh(docs, "score")
    return docs.withColumn(name, score(F.col("text"))).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id.

    Texts without a word, null ones included, are copies of each other, as are repeated rows.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window; a null or empty text has none. An empty benchmark drops nothing."""
    found = decontaminate.scanner(table(spark, sf_dir, "benchmark"))(F.col("text"))
    name = fresh(docs, "found")
    return docs.withColumn(name, found).filter(F.size(F.col(name)["hits"]) == 0).drop(name)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and ``n_chars`` counted anew.

    A null or empty text stays as it is. Each text is searched once: it is stored with what was found.
    """
    name = fresh(docs, "spans")
    found = store(docs.withColumn(name, pii.candidates(F.col("text"))), "candidates")
    accepted = pii.train(found.select(F.col(name).alias("spans")))
    clean = found.withColumn("text", pii.redactor(accepted)(F.col("text"), F.col(name))).drop(name)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mixture: each document's id as often as its source's weight asks for, ordered by ``position``.

    A null source is a source of its own; documents without a word are never drawn; documents of equal rank in
    their block are told apart by a hash of the whole row.
    """
    return mixing.mix(docs, keep=["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
