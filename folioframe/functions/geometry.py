"""Box predicates and measures as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.numeric import clamp, rnd

RATIO = ("x_ratio", "y_ratio", "width_ratio", "height_ratio")
PIXEL = ("x", "y", "width", "height")

# Padding in pixels by region type, and the share of a box a word search adds.
TEXT_PADDING_PX = 8.0
TABLE_EDGE_PADDING_PX = 2.0
TABLE_ROI_PADDING_PX = 10.0
SEARCH_PADDING_RATIO = 0.15
MAX_NEIGHBOUR_OVERLAP = 0.15


@dataclass(frozen=True)
class Box:
    """Left, top, width and height of a box held in four columns."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, names: tuple[str, ...] = RATIO, alias: str | None = None, prefix: str = "") -> Box:
        head = f"{alias}." if alias else ""
        return cls(*[F.col(f"{head}{prefix}{name}") for name in names])

    @classmethod
    def field(cls, value: Column, names: tuple[str, ...] = RATIO) -> Box:
        return cls(*[value[name] for name in names])

    @classmethod
    def corners(cls, left: Column, top: Column, right: Column, bottom: Column) -> Box:
        return cls(left, top, right - left, bottom - top)

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h


def box_from_points(points: Column) -> Column:
    """Bounding corners of [[x, y], ...]; null when no point is usable."""
    usable = F.filter(points, lambda p: F.size(p) >= 2)
    xs = F.transform(usable, lambda p: p[0].cast("double"))
    ys = F.transform(usable, lambda p: p[1].cast("double"))
    return F.when(
        F.size(usable) > 0,
        F.struct(
            F.array_min(xs).alias("left"),
            F.array_min(ys).alias("top"),
            F.array_max(xs).alias("right"),
            F.array_max(ys).alias("bottom"),
        ),
    )


def intersection(a: Box, b: Box) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a.right, b.right) - F.greatest(a.x, b.x))
    high = F.greatest(F.lit(0.0), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    return wide * high


def intersects(a: Box, b: Box) -> Column:
    """Strict overlap: touching edges do not count."""
    return (a.x < b.right) & (a.right > b.x) & (a.y < b.bottom) & (a.bottom > b.y)


def share_inside(inner: Box, outer: Box, floor_area: float = 1e-6) -> Column:
    """Part of the inner box that the outer one covers."""
    return intersection(inner, outer) / F.greatest(inner.area, F.lit(floor_area))


def share_of_smaller(a: Box, b: Box, floor_area: float = 1.0) -> Column:
    return intersection(a, b) / F.greatest(F.lit(floor_area), F.least(a.area, b.area))


def iou(a: Box, b: Box) -> Column:
    common = intersection(a, b)
    return clamp(common / F.greatest(F.lit(1e-6), a.area + b.area - common))


def contains(outer: Box, inner: Box, tolerance: float = 1e-6) -> Column:
    return (
        (inner.x >= outer.x)
        & (inner.y >= outer.y)
        & (inner.right <= outer.right + F.lit(tolerance))
        & (inner.bottom <= outer.bottom + F.lit(tolerance))
    )


def centre_inside(inner: Box, outer: Box) -> Column:
    return inner.cx.between(outer.x, outer.right) & inner.cy.between(outer.y, outer.bottom)


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length of two intervals against the shorter one."""
    common = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return common / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def pixel_to_ratio(box: Box, width: Column, height: Column) -> Box:
    """Pixel box as page shares, clipped to the page and rounded to six places."""
    left = clamp(box.x / width)
    top = clamp(box.y / height)
    right = F.greatest(left, clamp(box.x / width + box.w / width))
    bottom = F.greatest(top, clamp(box.y / height + box.h / height))
    return Box(rnd(left, 6), rnd(top, 6), rnd(right - left, 6), rnd(bottom - top, 6))


def expand_by_share(box: Box, share: float = SEARCH_PADDING_RATIO) -> Box:
    """Grow a box by a share of its own size, inside the page."""
    share = max(0.0, min(0.5, share))
    left = F.greatest(F.lit(0.0), box.x - box.w * share)
    top = F.greatest(F.lit(0.0), box.y - box.h * share)
    right = F.least(F.lit(1.0), box.x + box.w + box.w * share)
    bottom = F.least(F.lit(1.0), box.y + box.h + box.h * share)
    return Box(
        rnd(left, 6),
        rnd(top, 6),
        rnd(F.greatest(F.lit(0.0), right - left), 6),
        rnd(F.greatest(F.lit(0.0), bottom - top), 6),
    )


def expand_by_pixels(box: Box, padding: Column | float, width: Column, height: Column) -> Box:
    """Grow a ratio box by pixels on every side, inside the page."""
    pad = padding if isinstance(padding, Column) else F.lit(padding)
    pad_x = pad / F.greatest(width.cast("double"), F.lit(1.0))
    pad_y = pad / F.greatest(height.cast("double"), F.lit(1.0))
    left = F.greatest(F.lit(0.0), box.x - pad_x)
    top = F.greatest(F.lit(0.0), box.y - pad_y)
    right = F.least(F.lit(1.0), box.x + box.w + pad_x)
    bottom = F.least(F.lit(1.0), box.y + box.h + pad_y)
    return Box(left, top, F.greatest(F.lit(0.0), right - left), F.greatest(F.lit(0.0), bottom - top))
