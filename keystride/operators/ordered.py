"""Row numbers and look-ahead that hold when one group is larger than a task.

A plain window sends each group to one task. That is the cheapest plan while groups are small, so
it is used as long as the largest group stays under a bound. Beyond it the rows are cut into ranges
of equal size over (group, order), numbered inside each range, and shifted by the sizes of the
ranges before; only those sizes (one row per range) and the group starts cross between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.params import MAX_BROADCAST_ROWS, MAX_GROUP_ROWS
from keystride.session import materialize

_SEQ, _CUT, _POS = "_seq", "_cut", "_pos"
_CUT_SHIFT = 33  # monotonically_increasing_id keeps the partition above these bits


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join on equal columns, null being equal to null; still a hash or merge join.

    ``small`` says that ``right`` has been found small enough to be broadcast.
    """
    named = right.select(*[F.col(c).alias(f"_right_{c}" if c in by else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by])
    return left.join(F.broadcast(named) if small else named, same, how).drop(*[f"_right_{c}" for c in by])


def join_hot(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner", salts: int = 32,
             max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join rows with keys that repeat without bound to a table with a row per key; null equals null.

    A small table is broadcast; copies of a larger one meet the parts of each key.
    """
    if right.count() <= max_broadcast:
        return null_safe_join(left, right, by, how, small=True)
    parts = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # By place in the partition: equal rows are dealt out too. Not random, so a lost task repeats it.
    salted = left.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    return null_safe_join(salted, parts, [*by, "_salt"], how).drop("_salt")


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    if not by:
        return df.count()
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.max("n")).first()[0] or 0


def _cut_into_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add the range number and the row's global position in (by, order)."""
    keys = [F.col(c).asc() for c in by] + list(order)
    cut = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )
    # The range bounds are drawn from a sample, so all readers must see one and the same cut.
    cut = materialize(cut).withColumn(_CUT, F.shiftright(_SEQ, _CUT_SHIFT))
    sizes = cut.groupBy(_CUT).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(_CUT).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, never more than there are shuffle partitions.
    bases = sizes.select(_CUT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    in_cut = F.col(_SEQ) - F.shiftleft(F.col(_CUT), _CUT_SHIFT)
    return cut.join(F.broadcast(bases), _CUT).withColumn(_POS, F.col("_base") + in_cut).drop("_base", _SEQ)


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str,
                max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``row_number() over (partition by by order by order)``; ``order`` must be total."""
    if largest_group(df, by) <= max_group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    placed = _cut_into_ranges(df, by, order)
    if not by:
        return placed.withColumn(name, F.col(_POS) + 1).drop(_CUT, _POS)
    firsts = placed.groupBy(_CUT, *by).agg(F.min(_POS).alias("_first"))
    starts = firsts.withColumn("_start", F.min("_first").over(Window.partitionBy(*by))).drop("_first")
    return (
        null_safe_join(placed, starts, [_CUT, *by])
        .withColumn(name, F.col(_POS) - F.col("_start") + 1)
        .drop(_CUT, _POS, "_start")
    )


def next_value(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str,
               max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``lead(value) over (partition by by order by order)``; null on each group's last row."""
    if largest_group(df, by) <= max_group_rows:
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*by).orderBy(*order)))
    placed = _cut_into_ranges(df.withColumn("_value", value), by, order)
    heads = placed.groupBy(_CUT, *by).agg(F.min_by("_value", _POS).alias("_head"))
    across = heads.withColumn(
        "_across", F.lead("_head").over(Window.partitionBy(*by).orderBy(_CUT))
    ).drop("_head")
    inside = Window.partitionBy(_CUT, *by).orderBy(_POS)
    ahead = placed.withColumn("_inside", F.lead(F.struct(F.col("_value"))).over(inside))
    return (
        null_safe_join(ahead, across, [_CUT, *by])
        .withColumn(name, F.when(F.col("_inside").isNull(), F.col("_across")).otherwise(F.col("_inside._value")))
        .drop(_CUT, _POS, "_value", "_inside", "_across")
    )
