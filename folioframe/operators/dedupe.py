"""One reading per text and place: duplicates among the cells that a table's texts were assigned to.

Cells are looked at in an order: per-cell readings first, then by row, column, y and x. A cell falls when an earlier cell of the same text stays and
either sits at the same row and column or one of the two is a per-cell reading whose box holds the other's box.

Per-cell readings depend on none but themselves and are settled first. Whatever waits for an undecided reading waits; the first undecided reading of
every (text, row, column) that waits for none stays, and takes the others at its place and those held with it along. Without nested readings that is
one round. Everything else follows in one pass: held by a kept reading, at the place of one, or not the first at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.geometry import PIXEL, Box
from folioframe.functions.text import normalise_text
from folioframe.operators.spatial import pair_overlaps
from folioframe.session import cut_lineage

PER_CELL = "per_cell_ocr"
TOLERANCE = 2.0  # fixed value: pixels by which a held box may stick out
TILE = 200.0


def _holds(outer: Column, inner: Column) -> Column:
    o, i = Box.field(outer, PIXEL), Box.field(inner, PIXEL)
    return (i.x >= o.x - TOLERANCE) & (i.y >= o.y - TOLERANCE) & (i.right <= o.right + TOLERANCE) & (i.bottom <= o.bottom + TOLERANCE)


def _held_pairs(readings: DataFrame, cells: DataFrame, both_ways: bool) -> DataFrame:
    """(group_id, winner, loser) of a reading and a later cell of the same text, one in the other's box.

    Boxes meet in tiles. A reading is widened by the tolerance there, so that what sticks out still meets it.
    """
    kept = ("group_id", "value", "place", *PIXEL)
    with_box = " AND ".join(f"{c} IS NOT NULL" for c in PIXEL)
    wide = readings.filter(with_box).select(
        "group_id", "value", "place", F.struct(*PIXEL).alias("own"), *[(F.col(c) - TOLERANCE).alias(c) for c in ("x", "y")], *[(F.col(c) + 2 * TOLERANCE + 1e-6).alias(c) for c in ("width", "height")])
    other = cells.filter(with_box).select(*kept)

    def held(l: Column, r: Column) -> Column:
        test = _holds(l["own"], r)
        return (l["place"] < r["place"]) & (test | _holds(r, l["own"]) if both_ways else test)

    pairs = pair_overlaps(wide, other, ["group_id", "value"], PIXEL, TILE, held)
    return pairs.select("group_id", F.col("l.place").alias("winner"), F.col("r.place").alias("loser"))


def _settled_readings(readings: DataFrame) -> DataFrame:
    """The per-cell readings that stay."""
    place = ["group_id", "value", "row_no", "col_no"]
    left = cut_lineage(readings)
    waits = cut_lineage(_held_pairs(left, left, both_ways=True))
    kept = None
    while not left.isEmpty():
        open_edges = waits.join(left.select("group_id", F.col("place").alias("winner")), ["group_id", "winner"], "left_semi")
        leaders = left.groupBy(*place).agg(F.min("place").alias("place"))
        ready = cut_lineage(leaders.join(open_edges.select("group_id", F.col("loser").alias("place")), ["group_id", "place"], "left_anti"))
        kept = ready if kept is None else kept.unionByName(ready)
        fell = waits.join(ready.select("group_id", F.col("place").alias("winner")), ["group_id", "winner"], "left_semi").select("group_id", F.col("loser").alias("place"))
        left = cut_lineage(left.join(ready.select(*place), place, "left_anti").join(fell, ["group_id", "place"], "left_anti"))
    return left if kept is None else readings.join(kept.select("group_id", "place"), ["group_id", "place"], "left_semi")


def deduplicate_cells(cells: DataFrame, cell_id: str = "box_id") -> DataFrame:
    """The cells that stay, all columns kept.

    cells: group_id, a unique `cell_id`, row_no, col_no, text, source, x, y, width, height. Blank texts fall; a cell without a box is held by none
    and holds none; a null row or column is 0.
    """
    order = F.struct(
        F.coalesce(F.col("source") != PER_CELL, F.lit(True)).alias("rank"), F.coalesce("row_no", F.lit(0)).alias("row_no"), F.coalesce("col_no", F.lit(0)).alias("col_no"),
        F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("x", F.lit(0.0)).alias("x"), F.col(cell_id).alias("id"),
    )
    told = cut_lineage(cells.select(
        "group_id", normalise_text(F.col("text")).alias("value"), order.alias("place"), F.coalesce("row_no", F.lit(0)).alias("row_no"), F.coalesce("col_no", F.lit(0)).alias("col_no"), *PIXEL,
    ).filter("value <> ''"))
    place = ["group_id", "value", "row_no", "col_no"]
    readings = _settled_readings(told.filter("NOT place.rank"))
    rest = told.filter("place.rank").join(readings.select(*place), place, "left_anti")
    fell = _held_pairs(readings, rest, both_ways=False).select("group_id", F.col("loser").alias("place"))
    others = rest.join(fell, ["group_id", "place"], "left_anti").groupBy(*place).agg(F.min("place").alias("place"))
    stays = readings.select("group_id", "place.id").unionByName(others.select("group_id", "place.id"))
    return cells.join(stays.withColumnRenamed("id", cell_id), ["group_id", cell_id], "left_semi")
