"""Grouping of numbers along one axis, group by group.

Rows first collapse to distinct values with counts, which changes nothing: equal values always end in one
cluster. A gap wider than the tolerance ends every cluster, so each stretch between such gaps is folded
on its own and no array ever holds more than the distinct coordinates of one stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUT = "cast(array() AS array<struct<v:double,n:bigint,id:int>>)"

FOLDS = {
    # Compare with the mean of the open cluster.
    "mean": f"""aggregate(entries, named_struct('s', 0D, 'n', 0L, 'id', 0, 'out', {OUT}), (a, e) ->
        CASE WHEN a.n = 0 OR abs(e.v - a.s / a.n) > tol
        THEN named_struct('s', e.v * e.n, 'n', e.n, 'id', a.id + 1, 'out', concat(a.out, array(named_struct('v', e.v, 'n', e.n, 'id', a.id + 1))))
        ELSE named_struct('s', a.s + e.v * e.n, 'n', a.n + e.n, 'id', a.id, 'out', concat(a.out, array(named_struct('v', e.v, 'n', e.n, 'id', a.id)))) END,
        a -> a.out)""",
    # Take the first cluster whose mean is near enough.
    "any": f"""aggregate(entries, named_struct('rows', cast(array() AS array<struct<s:double,n:bigint>>), 'out', {OUT}), (a, e) ->
        element_at(transform(array(cast(array_position(transform(a.rows, r -> abs(e.v - r.s / r.n) <= tol), true) AS int)), hit ->
          named_struct(
            'rows', CASE WHEN hit = 0 THEN concat(a.rows, array(named_struct('s', e.v * e.n, 'n', e.n)))
                    ELSE transform(a.rows, (r, i) -> CASE WHEN i + 1 = hit THEN named_struct('s', r.s + e.v * e.n, 'n', r.n + e.n) ELSE r END) END,
            'out', concat(a.out, array(named_struct('v', e.v, 'n', e.n, 'id', CASE WHEN hit = 0 THEN size(a.rows) + 1 ELSE hit END))))), 1),
        a -> a.out)""",
}
# The first value of every cluster of the mean rule.
STARTS = """aggregate(entries, named_struct('s', 0D, 'n', 0L, 'out', cast(array() AS array<double>)), (a, e) ->
    CASE WHEN a.n = 0 OR abs(e.v - a.s / a.n) > tol THEN named_struct('s', e.v * e.n, 'n', e.n, 'out', concat(a.out, array(e.v)))
    ELSE named_struct('s', a.s + e.v * e.n, 'n', a.n + e.n, 'out', a.out) END,
    a -> a.out)"""
# A sweep whose centre moves half way to each joining value; n equal values move it by 1 - 2^-n.
SWEEP = """aggregate(entries, cast(array() AS array<double>), (a, e) ->
    CASE WHEN size(a) = 0 OR abs(e.v - element_at(a, -1)) > tol THEN concat(a, array(e.v))
    ELSE concat(slice(a, 1, size(a) - 1), array(e.v + (element_at(a, -1) - e.v) * power(0.5D, e.n))) END)"""


def _stretches(points: DataFrame, keys: list[str], value: str, tolerance: str) -> DataFrame:
    distinct = points.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("n"), F.max(tolerance).alias("tol")
    )
    order = W.partitionBy(*keys).orderBy("v")
    gap = F.col("v") - F.lag("v").over(order)
    flagged = distinct.withColumn("opens", F.when(gap > F.col("tol"), 1).otherwise(0))
    return flagged.withColumn("stretch", F.sum("opens").over(order)).drop("opens")


def axis_clusters(points: DataFrame, keys: list[str], value: str, tolerance: str, rule: str) -> DataFrame:
    """(keys, v, n, cluster): cluster numbers from 1 in ascending order for every distinct value.

    rule is last (compare with the previous value), mean or any; the tolerance is constant per group.
    """
    stretches = _stretches(points, keys, value, tolerance)
    if rule == "last":
        return stretches.select(*keys, "v", "n", (F.col("stretch") + 1).cast("int").alias("cluster"))
    packed = stretches.groupBy(*keys, "stretch").agg(
        F.array_sort(F.collect_list(F.struct("v", "n"))).alias("entries"), F.max("tol").alias("tol")
    )
    placed = packed.withColumn("item", F.explode(F.expr(FOLDS[rule]))).select(*keys, "stretch", "item.v", "item.n", "item.id")
    number = F.dense_rank().over(W.partitionBy(*keys).orderBy("stretch", "id"))
    return placed.select(*keys, "v", "n", number.cast("int").alias("cluster"))


def cluster_starts(points: DataFrame, keys: list[str], value: str, tolerance: str) -> DataFrame:
    """(keys, starts): least value of every cluster of the mean rule, in order. A value's cluster is the number of starts up to it."""
    packed = _stretches(points, keys, value, tolerance).groupBy(*keys, "stretch").agg(
        F.array_sort(F.collect_list(F.struct("v", "n"))).alias("entries"), F.max("tol").alias("tol")
    )
    return packed.select(*keys, F.explode(F.expr(STARTS)).alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("starts"))


def cluster_centres(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Mean value and size of each cluster."""
    return clusters.groupBy(*keys, "cluster").agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("centre"), F.sum("n").alias("size")
    )


def sweep_centres(points: DataFrame, keys: list[str], value: str, tolerance: str) -> DataFrame:
    """Column centres of the halving sweep, as one ascending array per group."""
    stretches = _stretches(points, keys, value, tolerance)
    packed = stretches.groupBy(*keys, "stretch").agg(
        F.array_sort(F.collect_list(F.struct("v", "n"))).alias("entries"), F.max("tol").alias("tol")
    )
    swept = packed.select(*keys, F.explode(F.expr(SWEEP)).alias("centre"))
    return swept.groupBy(*keys).agg(F.array_sort(F.collect_list("centre")).alias("centres"))


def nearest(value: str, centres: str) -> str:
    """Zero-based index of the centre closest to the value; the lower index wins a tie."""
    return (
        f"cast(element_at(transform(array(transform({centres}, c -> abs({value} - c))),"
        f" d -> array_position(d, array_min(d)) - 1), 1) AS int)"
    )


def dominant_interval(start: str, end: str, bounds: str, tolerance: str) -> str:
    """Zero-based index of the interval that holds most of [start, end]; the lower index wins a tie."""
    low, high = f"get({bounds}, i)", f"get({bounds}, i + 1)"
    span = f"greatest(1D, {end} - {start})"
    common = f"greatest(0D, least({end}, {high}) - greatest({start}, {low}))"
    centred = f"abs(({start} + {end}) / 2 - ({low} + {high}) / 2) / greatest({span}, {high} - {low}, 1D)"
    score = (
        f"{common} / {span} * 0.72D + greatest(0D, 1D - {centred}) * 0.28D"
        f" - CASE WHEN {start} < {low} - {tolerance} OR {end} > {high} + {tolerance} THEN 0.08D ELSE 0D END"
    )
    return (
        f"cast(CASE WHEN size({bounds}) <= 1 THEN 0 ELSE element_at(transform(array(transform("
        f"sequence(0, greatest(0, size({bounds}) - 2)), i -> {score})), s -> array_position(s, array_max(s)) - 1), 1) END AS int)"
    )
