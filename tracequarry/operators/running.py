"""Running values over keys of any size: a two-level scan for the keys that are more than a task's share of the rows.

A window puts a key's rows into one task. Here a hot key's rows are cut into slices by range partitions of key and order, so
that a slice is no more than a partition, whatever the key or its ties. Each slice runs on its own and its last row sums it up
(the carry); carries, one for each key and slice, run once more and are added back. Keys that are not hot take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stages import stored

#: Rows of a key that are never too many for a task.
LEAST_HOT = 10_000
#: Rows that a task sorts at once, about, so that its memory does not grow with the table.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Running:
    """A running value: kind ``sum``, ``max`` or ``last`` (the last value that is not null); with ``before`` the row itself is left out.

    As with a window, a sum without a value before it is null, and so are the others.
    """

    name: str
    kind: str
    value: Column
    before: bool = False

    def over(self, value: Column, window) -> Column:
        return {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}[self.kind](value).over(window)

    def joined(self, carry: Column, own: Column) -> Column:
        """The value with what the slices before say."""
        if self.kind == "sum":
            return F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(carry + own)
        return F.greatest(carry, own) if self.kind == "max" else F.coalesce(own, carry)


def lag(name: str, value: Column) -> Running:
    """The value of the row before, in a field ``v``: a null value is told from no row."""
    return Running(name, "last", F.struct(value.alias("v")), before=True)


_ALL, _SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[Running], least_hot: int = LEAST_HOT) -> DataFrame:
    """The rows with the running values of their key in an order that tells all rows of a key apart.

    Hot are keys of more rows than ``least_hot`` and than a shuffle partition's even share or TASK_ROWS, if that is less. Larger tables
    take more partitions. Without keys all rows are one key.
    Null keys are keys. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    counts = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(least_hot, min(total // partitions, TASK_ROWS))
    hot = counts.where(F.col("_n") > share)  # fewer than partitions, or one for each TASK_ROWS
    many = hot.agg(F.sum("_n")).first()[0] or 0
    hot = hot.drop("_n")
    slices = max(-(-many // TASK_ROWS), min(partitions, -(-many // max(1, least_hot))))
    # a window's own exchange would let partitions grow up to a size in bytes
    dealt = lambda df: df.repartition(max(partitions, -(-(total - many) // TASK_ROWS)), *keys) if keys and total - many > TASK_ROWS else df
    if not many:
        return _plain(dealt(rows), keys, order, values)
    if not keys:
        return _sliced(rows, keys, order, values, slices)
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in keys]
    part = lambda how: rows.alias("_a").join(F.broadcast(hot.alias("_b")), same, how)
    return _plain(dealt(part("left_anti")), keys, order, values).unionByName(_sliced(part("left_semi"), keys, order, values, slices))


def _plain(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[Running]) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({v.name: v.over(v.value, own.rowsBetween(*(_ALL if v.before else _SO_FAR))) for v in values})


def _sliced(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[Running], slices: int) -> DataFrame:
    cut = rows.repartitionByRange(slices, *[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    cut = cut.repartition(slices, *keys, "_slice")  # a few slices each; left to the window it would let them grow up to a size in bytes
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    run = {"_at": F.row_number().over(own)}
    for i, v in enumerate(values):
        run[f"_end{i}"] = v.over(v.value, own.rowsBetween(*_SO_FAR))
        if v.before:
            run[f"_own{i}"] = v.over(v.value, own.rowsBetween(*_ALL))
    done = stored(cut.withColumns(run), "slices")  # written once: another cut would move rows between slices
    ends = [F.max_by(f"_end{i}", "_at").alias(f"_end{i}") for i in range(len(values))]
    carries = done.groupBy(*keys, "_slice").agg(*ends)  # a row for each hot key and for each partition at most
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*_ALL)
    carries = carries.select(*keys, "_slice", *[v.over(F.col(f"_end{i}"), ahead).alias(f"_carry{i}") for i, v in enumerate(values)])
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in [*keys, "_slice"]]
    both = done.alias("_a").join(F.broadcast(carries.alias("_b")), same, "left")
    whole = [v.joined(F.col(f"_carry{i}"), F.col(f"_own{i}" if v.before else f"_end{i}")).alias(v.name) for i, v in enumerate(values)]
    return both.select(*[F.col(f"_a.{c}") for c in rows.columns], *whole)
