"""Per-key timelines that stay parallel when one key holds most of the rows.

A dialogue looks back along one user's messages. ``Window.partitionBy(user)``
says exactly that and costs one exchange, but it puts a whole user into one
task. Here the same look-backs are written once against a *frame*:

* ``KeyFrame`` – plain windows by key, for every key of ordinary size;
* ``SliceFrame`` – for keys above ``hot_rows``. Their rows are range-partitioned
  on (key, order), so each partition is a balanced slice of a timeline. Windows
  run inside a slice, and what a slice must know about the slices before it
  arrives through a small carry table (one row per key and slice).

``along_timeline`` counts rows per key (one narrow aggregate), uses the plain
frame alone when no key is hot, and otherwise runs both and unions them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellerflow.session import shared_folder
from tellerflow.sources.files import store

# A task sorts this many rows of one key without trouble (it may spill); it is also
# the size of a slice.
HOT_ROWS = 5_000_000

@dataclass(frozen=True)
class Previous:
    """Value of the row before, null on the first row."""

    value: Column


@dataclass(frozen=True)
class Latest:
    """Last non-null value up to this row (or up to the row before)."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Position:
    """1-based position of the row on its timeline."""


@dataclass(frozen=True)
class Trailing:
    """The last ``n`` values, oldest first, ending at this row (or the one before)."""

    value: Column
    n: int
    inclusive: bool = True


class KeyFrame:
    """Look-backs by plain windows: all share one exchange and one sort."""

    def __init__(self, rows: DataFrame, key: str, order: tuple[str, ...]):
        self.rows, self.key, self.order = rows, key, order
        self.window = Window.partitionBy(key).orderBy(*order)

    def with_rows(self, rows: DataFrame) -> "KeyFrame":
        return KeyFrame(rows, self.key, self.order)

    def derive(self, **specs) -> "KeyFrame":
        return self.with_rows(self.rows.withColumns({n: _local(s, self.window) for n, s in specs.items()}))


class SliceFrame:
    """Look-backs inside slices plus a carry from the slices before."""

    SLICE = "timeline_slice"

    def __init__(self, rows: DataFrame, key: str, order: tuple[str, ...]):
        self.rows, self.key, self.order = rows, key, order
        self.window = Window.partitionBy(key, self.SLICE).orderBy(*order)

    @classmethod
    def cut(
        cls, rows: DataFrame, key: str, order: tuple[str, ...], slices: int, prepare: Callable[[DataFrame], DataFrame]
    ) -> "SliceFrame":
        """Range-partition, number the slices, prepare the rows and store them, so
        that a lost executor re-reads the same slice numbers instead of drawing
        new ones. Finding the ranges reads rows as they come, not prepared."""
        shared_folder(rows.sparkSession)
        sliced = rows.repartitionByRange(slices, key, *order).withColumn(cls.SLICE, F.spark_partition_id())
        return cls(prepare(sliced).checkpoint(), key, order)

    def with_rows(self, rows: DataFrame) -> "SliceFrame":
        return SliceFrame(rows, self.key, self.order)

    def derive(self, **specs) -> "SliceFrame":
        """One exchange of the rows, on (key, slice); its result is stored, so that
        neither the carry nor a later step repeats what came before."""
        order, w = F.struct(*self.order), self.window
        local = self.rows.withColumns(
            {"_row": F.row_number().over(w), **{f"_l_{n}": _local(s, w) for n, s in specs.items()}}
        ).checkpoint()

        # What each slice leaves behind, then what reaches each slice.
        leaves = [F.count("*").alias("_count")]
        for name, spec in specs.items():
            if isinstance(spec, Previous):
                leaves.append(F.max_by(spec.value, order).alias(name))
            elif isinstance(spec, Latest):
                leaves.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), order)).alias(name))
            elif isinstance(spec, Trailing):
                mine = F.col(f"_l_{name}")
                full = mine if spec.inclusive else F.concat(mine, F.array_compact(F.array(spec.value)))
                leaves.append(F.max_by(_last(full, spec.n), order).alias(name))
        left = local.groupBy(self.key, self.SLICE).agg(*leaves)

        across = Window.partitionBy(self.key).orderBy(self.SLICE)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carries = [self.key, self.SLICE, F.sum("_count").over(before).alias("_offset")]
        for name, spec in specs.items():
            if isinstance(spec, Previous):
                carries.append(F.lag(name).over(across).alias(f"_c_{name}"))
            elif isinstance(spec, Latest):
                carries.append(F.last(name, ignorenulls=True).over(before).alias(f"_c_{name}"))
            elif isinstance(spec, Trailing):
                # each slice before holds at least one row, so n slices hold n values
                lists = F.collect_list(name).over(across.rowsBetween(-spec.n, -1))
                carries.append(_last(F.flatten(lists), spec.n).alias(f"_c_{name}"))
        carry = left.select(*carries)

        joined = local.join(carry, [self.key, self.SLICE], "left")
        out = {}
        for name, spec in specs.items():
            mine, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}") if not isinstance(spec, Position) else None
            if isinstance(spec, Position):
                out[name] = mine + F.coalesce("_offset", F.lit(0))
            elif isinstance(spec, Previous):
                out[name] = F.when(F.col("_row") == 1, carried).otherwise(mine)
            elif isinstance(spec, Latest):
                out[name] = F.coalesce(mine, carried)
            else:
                out[name] = _last(F.concat(F.coalesce(carried, F.array()), mine), spec.n)
        rows = joined.withColumns(out)
        return self.with_rows(rows.drop(*[c for c in rows.columns if c[:3] in ("_l_", "_c_")], "_row", "_offset"))


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def _local(spec, window) -> Column:
    if isinstance(spec, Previous):
        return F.lag(spec.value).over(window)
    if isinstance(spec, Latest):
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        return F.last(spec.value, ignorenulls=True).over(frame)
    if isinstance(spec, Position):
        return F.row_number().over(window).cast("bigint")
    end = 0 if spec.inclusive else -1
    return F.collect_list(spec.value).over(window.rowsBetween(end - spec.n + 1, end))


def hot_keys(rows: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, and how many; counted map-side first."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)


def along_timeline(
    rows: DataFrame,
    steps: Callable[[KeyFrame | SliceFrame], DataFrame],
    key: str = "user_id",
    order: tuple[str, ...] = ("ts", "event_id"),
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Apply ``steps`` to every key's timeline. (key, order) must identify a row.

    ``prepare`` adds columns that ``steps`` needs to each row by itself.
    ``counted`` holds the same keys as ``rows`` but is cheaper to count, where
    ``rows`` is the result of joins.
    """
    hot = hot_keys(rows if counted is None else counted, key, hot_rows)
    if hot.isEmpty():
        return steps(KeyFrame(prepare(rows), key, order))
    # stored: read several times below, and the planner knows how small the keys are
    hot, rows = store(hot, "hot-keys"), store(rows, "timeline")
    # one number: how many slices of about hot_rows rows the hot keys fill
    slices = int(hot.agg(F.sum("n")).first()[0]) // max(hot_rows, 1) + 1
    hot = hot.select(key)
    few = rows.join(hot, key, "left_anti").select(*rows.columns)
    many = rows.join(hot, key, "left_semi").select(*rows.columns)
    ordinary = steps(KeyFrame(prepare(few), key, order))
    sliced = steps(SliceFrame.cut(many, key, order, slices, prepare))
    return ordinary.unionByName(sliced.drop(SliceFrame.SLICE).select(*ordinary.columns))
