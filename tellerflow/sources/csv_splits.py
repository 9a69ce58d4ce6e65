"""CSV with quoted line breaks, read by many tasks a file.

Spark's multi-line reader takes a whole file in one task. Here a file is cut where Spark cuts text files, and
whether a line begins inside quotes follows from counting: quotes are doubled inside quoted values, so a place
is inside quotes if an odd number of them stands before it. Each split counts its quotes; a running sum over the
splits, a row each, tells how every split begins, and a running sum inside the split how every line begins. A line that
begins and ends outside quotes is a record. The others are put together to records, also across splits, and
all are parsed by ``from_csv`` as the multi-line reader would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tellerflow.sources.files import CSV_OPTIONS, NULL_MARK, store

FILE, SPLIT = "file", "split"
_MAX_BYTES = "spark.sql.files.maxPartitionBytes"


def lines(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(file, split, place, line, quotes): every line with its split, its order there and its number of quotes.

    Stored, so that all that follows sees the same splits. ``split_bytes`` overrides the session's size of a split.
    """
    before = spark.conf.get(_MAX_BYTES)
    if split_bytes:
        spark.conf.set(_MAX_BYTES, str(split_bytes))
    try:
        # lines end at \n only: a \r may be part of a value
        text = spark.read.option("lineSep", "\n").text(path)
        found = text.select(
            F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT),
            F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
            (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
        return store(found, "csv-lines")
    finally:
        spark.conf.set(_MAX_BYTES, before)


def _split_starts(found: DataFrame) -> DataFrame:
    """For each split whether it begins inside quotes: one row a split."""
    before = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    each = found.groupBy(FILE, SPLIT).agg(F.sum("quotes").alias("quotes"))
    return each.select(FILE, SPLIT, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"))


def records(found: DataFrame) -> DataFrame:
    """(file, first, record): the text of each record and whether it is its file's first one."""
    along = Window.partitionBy(FILE, SPLIT).orderBy("place")
    up_to, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    begins = (F.col("inside") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2 == 0
    ends = (F.col("inside") + F.sum("quotes").over(up_to)) % 2 == 0
    placed = found.join(store(_split_starts(found), "csv-splits"), [FILE, SPLIT]).select(
        FILE, SPLIT, "place", "line", begins.alias("begins"), ends.alias("ends"))
    # the number of the record that a line belongs to, within its split; 0: it began in a split before
    placed = placed.withColumn("number", F.count(F.when(F.col("begins"), 1)).over(up_to))
    placed = store(placed, "csv-placed")

    whole = F.col("begins") & F.col("ends")
    first = (F.col(SPLIT) == 0) & (F.col("number") == 1)
    single = placed.filter(whole).select(FILE, first.alias("first"), F.col("line").alias("record"))

    # the split where a record began that reaches into this one, and its number there: a row a split
    starts = placed.groupBy(FILE, SPLIT).agg(F.max("number").alias("records"))
    earlier = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    origin = starts.select(
        FILE, SPLIT, F.last(F.when(F.col("records") > 0, F.struct(F.col(SPLIT).alias("split"), "records")), ignorenulls=True).over(earlier).alias("origin"))
    parts = placed.filter(~whole).join(store(origin, "csv-origins"), [FILE, SPLIT]).select(
        FILE,
        F.when(F.col("number") > 0, F.col(SPLIT)).otherwise(F.col("origin.split")).alias("home"),
        F.when(F.col("number") > 0, F.col("number")).otherwise(F.col("origin.records")).alias("number"),
        F.struct(F.col(SPLIT), "place", "line").alias("part"))
    joined = parts.groupBy(FILE, "home", "number").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        FILE, ((F.col("home") == 0) & (F.col("number") == 1)).alias("first"), F.array_join(F.col("parts.line"), "\n").alias("record"))
    # a line break of two characters ends a record too; empty lines between records are none
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", "")).filter(F.col("record") != "")


def read_csv_splits(spark: SparkSession, path: str, schema: T.StructType, split_bytes: int | None = None) -> DataFrame:
    """The rows of ``files.read_csv``, read by as many tasks as Spark cuts the files into.

    Every file begins with a header line. Quotes stand around values and doubled inside them, nowhere else.
    Values are as in the file; the other reader makes ``\\n`` of a value's ``\\r\\n`` if the file's lines end so.
    """
    options = {**{k: v for k, v in CSV_OPTIONS.items() if k != "header"}, "multiLine": "true", "nullValue": NULL_MARK}
    rows = records(lines(spark, path, split_bytes)).filter(~F.col("first"))
    return rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("row")).select("row.*")
