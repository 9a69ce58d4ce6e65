"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerflow.session import scratch_path

#: ASCII capitals to small letters, every other byte unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: computed once, lineage cut."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name the frame doesn't use, in any spelling."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(frame: DataFrame, seed: int = 0) -> Column:
    """A hash over all columns of a row."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in frame.schema]
    return F.xxhash64(*parts, F.lit(seed))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def texts(column: pa.Array) -> Iterator[str]:
    """Each text; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids no model may learn from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for ids a model may learn from; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def arrow_column(function: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """An Arrow function of one column as a column expression."""

    def apply(column: pa.Array) -> pa.Array:
        return function(column)

    return F.arrow_udf(apply, kind)


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a Python worker.

    A worker serves many tasks, and each task brings its own copy of this package's functions and globals;
    what shall outlive a task is kept in a module of its own.
    """
    kept = sys.modules.setdefault("_tellerflow_worker", types.ModuleType("_tellerflow_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
