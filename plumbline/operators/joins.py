"""As-of, range and key joins over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row at or before (strict: before) left_on; NULL where there is none.

    One sort of the union of both sides: no range join, linear in the rows.
    """
    order = 1 if strict else 2  # the left row stands before or after a right row of the same instant
    a = left.select(*[F.col(k) for k in keys], F.col(left_on).alias("__at"), F.lit(order * 2 - 1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    b = right.select(*[F.col(k) for k in keys], F.col(right_on).alias("__at"), F.lit(2).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*values).alias("__right"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where(F.col("__left").isNotNull())
    return joined.select("__left.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def count_until(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, name: str) -> DataFrame:
    """left with the number of right rows at or before left_on."""
    w = Window.partitionBy(*keys).orderBy(right_on)
    numbered = right.select(*keys, right_on, F.count("*").over(w).alias(name)).distinct()
    out = asof_join(left, numbered, keys, left_on, right_on, [name])
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def value_ahead(value: str, n: int, order: str = "date", key: str = "symbol") -> Column:
    return F.lead(value, n).over(Window.partitionBy(key).orderBy(order))
