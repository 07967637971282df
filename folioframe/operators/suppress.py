"""Greedy box suppression without walking a page in one task.

A box falls when a box placed before it survives and covers it. Copies of one geometry share their
fate, so they are folded first. Boxes that come first in every tile they touch certainly survive; what
they cover is dropped in one linear pass. The few remaining conflicts become edges, and rounds over the
edges settle every box whose rivals are settled until no edge is left.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.geometry import Box, intersection
from folioframe.operators.spatial import crowded_keys, pair_overlaps, tiles_of
from folioframe.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """Order of the walk and the test by which a surviving box removes a later one."""

    largest_first: bool
    removes: Callable[[Box, Box], Column]
    copies_fall: bool
    ties: tuple[str, ...] = ()


# Shares at which a box counts as nested or duplicated.
def _layout_nested(winner: Box, loser: Box) -> Column:
    area = F.greatest(loser.area, F.lit(1.0))
    ratio = area / F.greatest(winner.area, F.lit(1.0))
    return (intersection(winner, loser) / area >= 0.88) & (ratio <= 0.72)


def _nested_text(winner: Box, loser: Box) -> Column:
    return intersection(winner, loser) / F.greatest(loser.area, F.lit(1e-9)) >= 0.88


def _nested_block(winner: Box, loser: Box) -> Column:
    common = intersection(winner, loser)
    return (common / F.greatest(loser.area, F.lit(1e-9)) >= 0.72) | (
        common / F.greatest(winner.area, F.lit(1e-9)) >= 0.72
    )


def _duplicate(winner: Box, loser: Box) -> Column:
    smaller = F.greatest(F.lit(1.0), F.least(winner.area, loser.area))
    return intersection(winner, loser) / smaller >= 0.82


LAYOUT_NESTED = Rule(True, _layout_nested, False)
FLEXIBLE_TEXT = Rule(True, _nested_text, True)
FLEXIBLE_BLOCK = Rule(True, _nested_block, True)
DETECTED_DUPLICATE = Rule(False, _duplicate, True, ("y", "x"))


def greedy_keep(
    boxes: DataFrame, on: list[str], row_id: str, names: tuple[str, ...], size: float, rule: Rule
) -> DataFrame:
    """Surviving rows of a greedy walk by area, earlier row ids first among equals."""
    shape = [*on, *names]
    unique = boxes.groupBy(*shape).agg(F.min(row_id).alias("first_id"))
    area = Box.of(names).area
    ranked = unique.withColumn("place", F.struct((-area if rule.largest_first else area).alias("a"), *rule.ties, "first_id"))
    unique = cut_lineage(ranked)

    # The few boxes of most pages share one tile, which makes fewer of them sure but copies none.
    many = crowded_keys(unique, None, on)
    tiles = tiles_of(unique, on, names, size, many).drop("tiled")
    tops = tiles.groupBy(*on, "tile_x", "tile_y").agg(
        F.min(F.struct("place", *names)).alias("top"), F.count("*").alias("crowd")
    )
    crowded = tops.filter("crowd > 1").drop("crowd")
    facing = tiles.join(crowded, [*on, "tile_x", "tile_y"])
    # A sure survivor leads in every tile it touches, so whatever it covers meets it right here.
    loses = cut_lineage(facing.filter(F.col("place") != F.col("top.place")))
    contested = loses.select(*on, "first_id").distinct()
    sure = unique.join(contested, [*on, "first_id"], "left_anti")
    hit = rule.removes(Box.field(F.col("top"), names), Box.of(names))
    fallen = (
        loses.filter(hit)
        .select(*on, "first_id", F.col("top.place.first_id").alias("winner"))
        .join(sure.select(*on, F.col("first_id").alias("winner")), [*on, "winner"], "left_semi")
        .select(*on, "first_id")
        .distinct()
    )
    undecided = unique.join(contested, [*on, "first_id"], "left_semi").join(fallen, [*on, "first_id"], "left_anti")

    before = lambda l, r: (l["place"] < r["place"]) & rule.removes(Box.field(l, names), Box.field(r, names))
    edges = cut_lineage(
        pair_overlaps(undecided, undecided, on, names, size, before, many).select(
            *on, F.col("l.first_id").alias("winner"), F.col("r.first_id").alias("loser")
        )
    )
    fallen = cut_lineage(fallen)

    while not edges.isEmpty():
        rivals = edges.select(*on, F.col("loser").alias("winner")).distinct()
        settled = edges.join(rivals, [*on, "winner"], "left_anti")
        dropped = settled.select(*on, F.col("loser").alias("first_id")).distinct()
        fallen = cut_lineage(fallen.union(dropped))
        edges = cut_lineage(_without(edges, on, dropped))

    dropped_shapes = unique.join(fallen, [*on, "first_id"], "left_semi").select(*shape)
    kept = boxes.join(dropped_shapes, shape, "left_anti")
    if rule.copies_fall:
        kept = kept.join(unique.select(*on, F.col("first_id").alias(row_id)), [*on, row_id], "left_semi")
    return kept


def _without(edges: DataFrame, on: list[str], fallen: DataFrame) -> DataFrame:
    gone = fallen.select(*on, "first_id")
    return edges.join(gone.withColumnRenamed("first_id", "loser"), [*on, "loser"], "left_anti").join(
        gone.withColumnRenamed("first_id", "winner"), [*on, "winner"], "left_anti"
    )
