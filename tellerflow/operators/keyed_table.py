"""Stored tables that are looked up and changed by key.

A table lies in folders by a hash of its key, rows of a key lie together within the files of its folder, and files carry
Bloom filters over the key. A lookup reads one folder, and of that the row groups that may hold the key; a change rewrites the
folders that its keys fall into and leaves all others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tellerflow.sources.files import is_missing, store

FOLDERS = 64
FOLDER = "key_folder"
# Different keys a row group's Bloom filter is made for.
KEYS_A_GROUP = 100_000


class KeyedTable:
    """A Parquet table under ``folder``, by ``key`` and within a key by ``order``. One writer at a time.

    Choose ``folders`` so that one holds some hundred megabytes: it is what the smallest change rewrites. A key with very many
    rows is split between files of its folder by ``order``.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, key: str, order: tuple[str, ...] = (), folders: int = FOLDERS,
    ):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.key, self.order, self.folders = key, order, folders

    def _place(self, key: Column) -> Column:
        return F.pmod(F.hash(key.cast(self.schema[self.key].dataType)), F.lit(self.folders))

    def _write(self, rows: DataFrame, mode: str) -> None:
        by = (FOLDER, self.key, *self.order)
        placed = rows.select(*self.schema.names, self._place(F.col(self.key)).alias(FOLDER))
        writer = (
            placed.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy(FOLDER)
            .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(KEYS_A_GROUP))
            # replaces the folders that have rows, no others
            .option("partitionOverwriteMode", "dynamic")
        )
        writer.parquet(self.folder)

    def append(self, rows: DataFrame) -> None:
        """Add rows. ``rows`` is read twice, first for the ranges its tasks get: pass a stored frame."""
        self._write(rows, "append")

    def _read(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(FOLDER, T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read().select(*self.schema.names)

    def of(self, key) -> DataFrame:
        """The rows of one key."""
        found = self._read().filter((F.col(FOLDER) == self._place(F.lit(key))) & (F.col(self.key) == F.lit(key)))
        return found.select(*self.schema.names)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of all folders that ``keys`` fall into by ``change`` of them.

        ``change`` must keep rows of other keys as they are, and give the same if it is done again: a rewrite that failed is repeated.
        What it gives is stored first, as the folders can't be read and replaced at once.
        """
        # as many numbers as there are folders
        touched = [r[0] for r in keys.select(self._place(F.col(self.key))).distinct().collect()]
        after = store(change(self._read().filter(F.col(FOLDER).isin(touched)).select(*self.schema.names)), "changed")
        self._write(after, "overwrite")
        kept = {r[0] for r in after.select(self._place(F.col(self.key))).distinct().collect()}
        for number in set(touched) - kept:
            self._delete(number)

    def _delete(self, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{FOLDER}={number}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
