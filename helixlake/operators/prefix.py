"""Prefix sums and maxima over tables of any size, by range partitions.

Rows are range-partitioned by their order and stored with the number of their range. Within a range a window adds up; what goes on from one range to the
next is a table of one or two rows a range, as many as there are partitions. So no task holds more than its range,
and one key may spread over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.sources.store import stored

#: Columns of a stored table: the number of the range.
PART = "_part"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges by order (null first), with the number of each row's range; numbers ascend with the order."""
    return stored(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranged")


def running_sum(parts: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """parts (of ranged) with out: the sum of value up to each row in the order, itself included; rows that are equal in the order follow in any order."""
    own = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(PART).agg(F.sum(value).alias("_sum"))
    # one row a range
    before = sums.select(PART, F.coalesce(F.sum("_sum").over(Window.partitionBy().orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.withColumn(out, F.sum(value).over(own)).join(F.broadcast(before), PART).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def prefix_sum(df: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """df with out: the sum of value up to each row in the order, itself included."""
    return running_sum(ranged(df, *order), value, out, *order).drop(PART)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order, which tells all rows apart, for an n that may be as large as the table."""
    return prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", "_at", *order).where(F.col("_at") <= n).drop("_one", "_at")


def carried(parts: DataFrame, group: str, value, latest: bool) -> DataFrame:
    """(_part, group, _carry): what earlier ranges hand on to the group that each range begins with.

    value is a struct whose first fields are group and whose last is the value handed on: the largest of a range counts, and of several
    ranges the largest too, or with latest the last.
    """
    ends = parts.groupBy(PART).agg(F.min(F.struct(group)).alias("_first"), F.max(value).alias("_end"))
    given = ends.select(F.col(f"_end.{group}").alias(group), F.col(PART).alias("_at"), F.lit(1).alias("_kind"), F.col("_end._v").alias("_v"))
    asked = ends.select(F.col(f"_first.{group}").alias(group), F.col(PART).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(given.schema["_v"].dataType).alias("_v"))
    w = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    over = F.last("_v", ignorenulls=True).over(w) if latest else F.max("_v").over(w)
    return given.union(asked).withColumn("_carry", over).where("_kind = 0 and _carry is not null").select(F.col("_at").alias(PART), group, "_carry")


def segmented_before(parts: DataFrame, group: str, value: str, out: str, *order: str, latest: bool = False) -> DataFrame:
    """parts (of ranged by group, then order) with out: the largest value of the group's rows before each one, null for the first; with latest that of the row before."""
    w = Window.partitionBy(PART, group).orderBy(*order)
    own = F.lag(value).over(w) if latest else F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    key = [F.col(group).alias(group), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order if latest else [])), F.col(value).alias("_v")]
    carry = F.broadcast(carried(parts, group, F.struct(*key), latest).select(F.col(PART).alias("_p"), F.col(group).alias("_g"), "_carry"))  # one row a range at most
    both = parts.withColumn(out, own).join(carry, (F.col(PART) == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return both.withColumn(out, F.coalesce(out, "_carry") if latest else F.greatest(out, "_carry")).drop("_carry", "_p", "_g")
