"""Ordered operations inside a group that may hold a large part of all rows.

Rows are ordered by a leading number. Windows run over (group, bucket), where a bucket is a fixed range of
that number, so one group is worked on by many tasks. What crosses bucket borders comes from one
summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, lead: Column, width: float) -> DataFrame:
    return df.withColumn("bucket", F.floor(lead / F.lit(width)))


def row_places(df: DataFrame, keys: list[str], order: list[str], width: float, name: str = "place") -> DataFrame:
    """Row numbers from 1 within each group; order[0] is the leading number."""
    split = _bucketed(df, F.col(order[0]), width)
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*keys, "bucket")
        .agg(F.count("*").alias("rows_here"))
        .select(*keys, "bucket", F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("rows_before"))
    )
    inside = F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(*order))
    return (
        split.withColumn("inside", inside)
        .join(offsets, [*keys, "bucket"])
        .withColumn(name, (F.col("inside") + F.col("rows_before")).cast("int"))
        .drop("bucket", "inside", "rows_before")
    )


def previous_values(
    df: DataFrame, keys: list[str], order: list[str], width: float, values: list[str], prefix: str = "prev_"
) -> DataFrame:
    """The named values of the row before, null on the first row of a group."""
    split = _bucketed(df, F.col(order[0]), width)
    held = F.struct(*values)
    last = split.groupBy(*keys, "bucket").agg(F.max_by(held, F.struct(*order)).alias("last"))
    carried = last.select(
        *keys, "bucket", F.lag("last").over(W.partitionBy(*keys).orderBy("bucket")).alias("carried")
    )
    inside = F.lag(held).over(W.partitionBy(*keys, "bucket").orderBy(*order))
    joined = split.withColumn("near", inside).join(carried, [*keys, "bucket"])
    back = F.coalesce("near", "carried")
    return joined.select(*df.columns, *[back[v].alias(f"{prefix}{v}") for v in values])


def running_total(
    df: DataFrame, keys: list[str], order: list[str], width: float, value: str, name: str
) -> DataFrame:
    """Sum of the value from the start of the group up to and including the row."""
    split = _bucketed(df, F.col(order[0]), width)
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*keys, "bucket")
        .agg(F.sum(value).alias("here"))
        .select(*keys, "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("carried"))
    )
    upto = W.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        split.withColumn("near", F.sum(value).over(upto))
        .join(offsets, [*keys, "bucket"])
        .withColumn(name, F.col("near") + F.col("carried"))
        .drop("bucket", "near", "carried")
    )
