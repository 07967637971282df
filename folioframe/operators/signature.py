"""Layout signatures: one row of fixed size per page.

Sums run over whole millionths of the page, so a signature does not depend on the order in which tasks
finish; grid areas stay in that unit, because a cosine does not change with scale.
Region lists hold all regions of a label; `per_label` keeps the first ones only, as a spatial score with such a limit reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.geometry import RATIO, Box
from folioframe.functions.numeric import clamp, let, rnd, units
from folioframe.operators.spatial import RATIO_TILE, drop_covered_centres

# The three labels and the 4 x 4 grid.
LABELS = ("text", "table", "image")
GRID = 4


def normalise_label(value: Column) -> Column:
    label = F.lower(value)
    return F.when(label.isin(*LABELS), label).otherwise(F.lit("text"))


def usable_regions(regions: DataFrame) -> DataFrame:
    """Clamp to the page, drop empty boxes and unreadable numbers, round as stored."""
    numbers = {name: F.col(name).try_cast("double") for name in RATIO}
    clean = regions.select(
        "page_id",
        "region_id",
        normalise_label(F.coalesce("label", F.lit("text"))).alias("label"),
        *[F.when(value.isNotNull(), clamp(value)).alias(name) for name, value in numbers.items()],
        rnd(F.coalesce(F.col("confidence"), F.lit(0.0)), 4).alias("confidence"),
    )
    valid = F.col("x_ratio").isNotNull() & F.col("y_ratio").isNotNull()
    clean = clean.filter(valid & (F.col("width_ratio") > 0) & (F.col("height_ratio") > 0))
    box = Box.of()
    return clean.select(
        "page_id",
        "region_id",
        "label",
        rnd(box.cx, 6).alias("centre_x"),
        rnd(box.cy, 6).alias("centre_y"),
        rnd(clamp(box.area), 6).alias("area_ratio"),
        *[rnd(F.col(name), 6).alias(name) for name in RATIO],
        "confidence",
    )


def drop_masked(regions: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """Regions outside every mask.

    A region is masked when its centre is inside or 60 % of it is covered. Covering more than half of
    a box covers the middle of both its sides, so the centre test alone decides.
    """
    real = masks.filter((F.col("width_ratio") > 0) & (F.col("height_ratio") > 0))
    return drop_covered_centres(regions, real, on, ("centre_x", "centre_y"), RATIO, RATIO_TILE)


def grid_cell(cx: Column, cy: Column) -> Column:
    def slot(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(value * GRID).cast("int")))

    return slot(cy) * GRID + slot(cx)


def region_order() -> list[Column]:
    return [F.col("centre_y"), F.col("centre_x"), F.col("region_id")]


def page_metrics(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and areas by label and by grid cell; at most 48 partial rows per page leave the first step."""
    cells = (
        regions.withColumn("cell", grid_cell(F.col("centre_x"), F.col("centre_y")))
        .groupBy(*keys, "label", "cell")
        .agg(F.count("*").alias("n"), F.sum(units(F.col("area_ratio"), 6)).alias("area"))
    )
    aggs = [F.sum("n").cast("bigint").alias("region_count")]
    for label in LABELS:
        mine = F.col("label") == label
        aggs.append(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).cast("bigint").alias(f"count_{label}"))
        aggs.append(F.coalesce(F.sum(F.when(mine, F.col("area"))), F.lit(0)).cast("bigint").alias(f"units_{label}"))
        aggs.append(F.collect_list(F.when(mine, F.struct("cell", "n", "area"))).alias(f"cells_{label}"))
    packed = cells.groupBy(*keys).agg(*aggs)

    def dense(entries: Column, name: str) -> Column:
        # At most 16 entries in slot order, so a position lookup beats building a map.
        slots = F.sequence(F.lit(0), F.lit(GRID * GRID - 1))
        return let(
            F.struct(
                F.transform(entries, lambda e: e["cell"]).alias("cells"),
                F.transform(entries, lambda e: e[name]).alias("values"),
            ),
            lambda s: F.transform(
                slots,
                lambda i: F.coalesce(
                    F.get(s["values"], F.array_position(s["cells"], i).cast("int") - 1), F.lit(0).cast("bigint")
                ),
            ),
        )

    out = [*keys, "region_count"]
    for label in LABELS:
        entries = F.col(f"cells_{label}")
        out += [
            F.col(f"count_{label}"),
            F.least(F.lit(1.0), F.col(f"units_{label}") / F.lit(1e6)).alias(f"area_{label}"),
            dense(entries, "n").alias(f"grid_count_{label}"),
            F.transform(dense(entries, "area"), lambda v: F.least(v, F.lit(1_000_000).cast("bigint"))).alias(
                f"grid_units_{label}"
            ),
        ]
    return packed.select(*out)


#: What a region carries besides its box where masks may take it out of a signature later.
MASKABLE = ("centre_x", "centre_y", "area_ratio")


def leading_regions(regions: DataFrame, keys: list[str], per_label: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Regions of each label in signature order, as one array per label; with a limit, the first ones."""
    order = W.partitionBy(*keys, "label").orderBy(*region_order())
    top = regions.withColumn("place", F.row_number().over(order))
    if per_label is not None:
        top = top.filter(F.col("place") <= per_label)
    item = F.struct("place", *[F.col(name) for name in (*RATIO, *extra)])
    return top.groupBy(*keys).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("label") == label, item))).alias(f"regions_{label}")
            for label in LABELS
        ]
    )


def layout_signatures(
    pages: DataFrame, regions: DataFrame, keys: list[str] | None = None, per_label: int | None = None, maskable: bool = False
) -> DataFrame:
    """One signature per page, pages without regions included; `maskable` ones can be corrected by masks."""
    extra = MASKABLE if maskable else ()
    keys = keys or ["page_id"]
    aspect = F.greatest(F.col("image_width").cast("double"), F.lit(1.0)) / F.greatest(
        F.col("image_height").cast("double"), F.lit(1.0)
    )
    joined = (
        pages.withColumn("page_aspect_ratio", rnd(aspect, 6))
        .join(page_metrics(regions, keys), keys, "left")
        .join(leading_regions(regions, keys, per_label, extra), keys, "left")
    )
    zeros = F.array_repeat(F.lit(0).cast("bigint"), GRID * GRID)
    empty = F.array().cast("array<struct<place:int," + ",".join(f"{name}:double" for name in (*RATIO, *extra)) + ">>")
    none = F.lit(0).cast("bigint")
    out = [F.col(c) for c in pages.columns]
    out += [F.col("page_aspect_ratio"), F.coalesce("region_count", none).alias("region_count")]
    for label in LABELS:
        units_by_cell = F.coalesce(F.col(f"grid_units_{label}"), zeros)
        squares = F.aggregate(units_by_cell, none, lambda total, v: total + v * v)
        out += [
            F.coalesce(F.col(f"count_{label}"), none).alias(f"count_{label}"),
            F.coalesce(F.col(f"area_{label}"), F.lit(0.0)).alias(f"area_{label}"),
            F.coalesce(F.col(f"grid_count_{label}"), zeros).alias(f"grid_count_{label}"),
            units_by_cell.alias(f"grid_units_{label}"),
            F.sqrt(squares.cast("double")).alias(f"norm_{label}"),
            F.coalesce(F.col(f"regions_{label}"), empty).alias(f"regions_{label}"),
        ]
    return joined.select(*out)


def without_masked(side: str, label: str, masks: Column) -> dict[str, Column]:
    """The columns of one label of a maskable signature once the masks are applied, from the regions that it carries.

    masks: an array of boxes; those without extent hide nothing. A region goes when its centre lies in one, edges included.
    """
    name = f"{side}regions_{label}"
    real = F.filter(masks, lambda m: (m["width_ratio"] > 0) & (m["height_ratio"] > 0))

    def hidden(r: Column) -> Column:
        return F.exists(real, lambda m: r["centre_x"].between(m["x_ratio"], m["x_ratio"] + m["width_ratio"]) & r["centre_y"].between(m["y_ratio"], m["y_ratio"] + m["height_ratio"]))

    def corrected(left: Column) -> Column:
        area = lambda kept: F.aggregate(kept, F.lit(0).cast("bigint"), lambda total, r: total + units(r["area_ratio"], 6))
        grid = F.transform(
            F.sequence(F.lit(0), F.lit(GRID * GRID - 1)),
            lambda i: F.least(F.lit(1_000_000).cast("bigint"), area(F.filter(left, lambda r: grid_cell(r["centre_x"], r["centre_y"]) == i))))
        return let(grid, lambda g: F.struct(
            left.alias("regions"), F.size(left).cast("bigint").alias("count"), F.least(F.lit(1.0), area(left) / F.lit(1e6)).alias("area"), g.alias("grid_units"),
            F.sqrt(F.aggregate(g, F.lit(0).cast("bigint"), lambda total, v: total + v * v).cast("double")).alias("norm")))

    stored = F.struct(*[F.col(f"{side}{part}_{label}").alias(part) for part in ("regions", "count", "area", "grid_units", "norm")])
    # Most pairs lose nothing and keep what is stored.
    now = let(F.filter(F.col(name), lambda r: ~hidden(r)), lambda left: F.when(F.size(left) == F.size(F.col(name)), stored).otherwise(corrected(left)))
    return {f"{side}_now_{label}": F.when(F.size(real) > 0, now).otherwise(stored)}
