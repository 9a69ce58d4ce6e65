"""The labelled training corpus and its summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tellerflow.functions.textprep import add_processed, preprocess
from tellerflow.sources import catalogue, files

# Row id of each source table: the order rows were written in.
ROW_IDS = {
    "faqs": "question_id",
    "complaints": "complaint_id",
    "assistance": "assistance_id",
    "fraud_reports": "report_id",
    "transaction_details": "transaction_id",
}


def process_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table with its processed text columns; originals stay."""
    return {name: add_processed(df, catalogue.TEXT_COLUMNS.get(name, [])) for name, df in tables.items()}


def training_corpus(tables: dict[str, DataFrame], lemmas: dict[str, str] | None = None) -> DataFrame:
    """(text, response, intent) of every available source, with its place in
    ``src_rank`` and ``row_id``. Absent tables contribute nothing."""
    parts = []
    for rank, (intent, table, column, canned) in enumerate(catalogue.CORPUS_SOURCES):
        if table not in tables:
            continue
        answer = F.lit(canned) if canned else preprocess(F.col("answer"), lemmas)
        parts.append(
            tables[table].select(
                preprocess(F.col(column), lemmas).alias("text"),
                answer.alias("response"),
                F.lit(intent).alias("intent"),
                F.lit(rank).alias("src_rank"),
                F.col(ROW_IDS[table]).alias("row_id"),
            )
        )
    if not parts:
        raise ValueError("no corpus source is available")
    return reduce(DataFrame.unionByName, parts)


def intent_mapping(tables: dict[str, DataFrame], lemmas: dict[str, str] | None = None) -> DataFrame:
    """Rows and first response per intent, straight from the source tables.

    Count and first row id need the id column alone; the text of one row per
    source is then read and prepared, not the whole corpus.
    """
    parts = []
    for rank, (intent, table, _, canned) in enumerate(catalogue.CORPUS_SOURCES):
        if table not in tables:
            continue
        rows, key = tables[table], ROW_IDS[table]
        total = rows.agg(F.count("*").alias("count"), F.min(key).alias(key)).filter(F.col("count") > 0)
        if canned:
            total = total.withColumn("response", F.lit(canned))
        else:
            # the id may repeat: the least of its answers counts once
            first = rows.select(key, "answer").join(total, key).groupBy("count").agg(F.min("answer").alias("answer"))
            total = first.withColumn("response", preprocess(F.col("answer"), lemmas))
        parts.append(
            total.select(F.lit(intent).alias("intent"), "count", F.col("response").alias("sample_response"), F.lit(rank).alias("src_rank"))
        )
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("count"), "src_rank").drop("src_rank")


def summarize(corpus: DataFrame) -> DataFrame:
    """The same summary of a stored corpus (with src_rank and row_id).

    The first pass aggregates numbers only; its few result rows, one per intent
    and source, fetch their responses.
    """
    firsts = corpus.groupBy("intent", "src_rank").agg(F.count("*").alias("count"), F.min("row_id").alias("row_id"))
    found = corpus.select("intent", "src_rank", "row_id", "response").join(firsts, ["intent", "src_rank", "row_id"])
    return (
        found.groupBy("intent", "src_rank", "row_id")
        .agg(F.first("count").alias("count"), F.min("response").alias("response"))
        .groupBy("intent")
        .agg(
            F.sum("count").alias("count"),
            F.min_by("response", F.struct("src_rank", "row_id")).alias("sample_response"),
            F.min("src_rank").alias("src_rank"),
        )
        .orderBy(F.desc("count"), "src_rank")
        .drop("src_rank")
    )


def build(spark: SparkSession, source: str, target: str, fmt: str = "csv") -> list[str]:
    """Prepare all bulk tables found under ``source`` and write them, the corpus
    and its summary as Parquet under ``target``; returns the tables found.

    Everything is planned from the source tables; no step reads what another wrote
    except the summary, which needs no text of the stored corpus but the replies.
    """
    tables = files.read_bulk_tables(spark, source, fmt)
    for name, df in process_tables(tables).items():
        files.write_table(df, f"{target}/processed_{name}")
    if any(table in tables for _, table, _, _ in catalogue.CORPUS_SOURCES):
        files.write_table(training_corpus(tables), f"{target}/training_corpus")
        stored = spark.read.parquet(f"{target}/training_corpus")
        files.write_table(summarize(stored), f"{target}/intent_mapping")
    return list(tables)
