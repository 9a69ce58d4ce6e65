"""File scans and sinks."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tellerflow.session import scratch_path
from tellerflow.sources import catalogue, schemas

log = logging.getLogger(__name__)

# Addresses and free text hold quotes, commas and line breaks.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# No value is this; the reader would otherwise take empty text for null.
NULL_MARK = "\u0000"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and quoted line breaks.

    One task reads a file: this is for tables of many files. Large files are read
    by ``csv_splits.read_csv_splits``. Nothing between two commas is null; ``""`` is empty text.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", "true").option("nullValue", NULL_MARK)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once however
    often it is used, without lineage, and of a size the planner knows."""
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` stored as a table bucketed by ``key``, one file a bucket, sorted by ``key`` and ``order``.

    Windows and groups by the key, alone or with other columns, and joins by the key then read it without a shuffle; a side
    that isn't bucketed is shuffled to it. So do joins by the key and more columns where the session sets
    ``spark.sql.requireAllClusterKeysForCoPartition`` to false. A bucket is one task: a table where one key holds a large part of all
    rows is better left unbucketed. Take no fewer buckets than shuffle partitions, or Spark may shuffle after all.
    """
    path = scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def to_parquet(spark: SparkSession, csv_path: str, schema: T.StructType, path: str) -> DataFrame:
    """Convert a CSV table once; every later scan is columnar and splits."""
    write_table(read_csv(spark, csv_path, schema), path)
    return spark.read.schema(schema).parquet(path)


def is_missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame | None:
    """The table at ``path``, or None (with a warning) when there is none."""
    try:
        return read_csv(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        log.warning("no table at %s, skipped", path)
        return None


def read_bulk_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """Those of the eight bulk tables that exist under ``folder``."""
    suffix = ".csv" if fmt == "csv" else ""
    found = {
        name: read_optional(spark, f"{folder}/{name}{suffix}", schema, fmt)
        for name, schema in schemas.BULK.items()
    }
    return {name: df for name, df in found.items() if df is not None}


# --- Intent and template catalogues -----------------------------------------


def default_intents(spark: SparkSession) -> DataFrame:
    rows = [([{"tag": t, "patterns": p, "responses": r} for t, p, r in catalogue.DEFAULT_INTENTS],)]
    return spark.createDataFrame(rows, schemas.INTENTS)


def read_intents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested intent documents; the built-in catalogue when the path is absent."""
    try:
        return spark.read.schema(schemas.INTENTS).option("multiLine", str(multi_line).lower()).json(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        log.warning("no intents at %s, built-in catalogue used", path)
        return default_intents(spark)


def intent_patterns(documents: DataFrame) -> DataFrame:
    """(tag, place, pattern), one row per example phrase."""
    tags = documents.select(F.explode("intents").alias("intent"))
    return tags.select("intent.tag", F.posexplode("intent.patterns").alias("place", "pattern"))


def intent_responses(documents: DataFrame) -> DataFrame:
    """(tag, templates): the templates of each tag, its first entry winning."""
    tags = documents.select(F.posexplode("intents").alias("rank", "intent"))
    return tags.groupBy("intent.tag").agg(F.min_by("intent.responses", "rank").alias("templates"))


def parse_templates(documents: DataFrame, column: str = "json") -> DataFrame:
    """(…, intent, place, template) from JSON maps of intent to templates."""
    others = [c for c in documents.columns if c != column]
    opened = documents.select(
        *others, F.explode(F.from_json(column, schemas.TEMPLATES)).alias("intent", "templates")
    )
    return opened.select(*others, "intent", F.posexplode("templates").alias("place", "template"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return parse_templates(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
