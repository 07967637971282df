"""Fragments shared by the SQL twins; each mirrors one column helper."""

from __future__ import annotations


def rnd(expr: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def clamp(expr: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {expr}))"


def ratio_sim(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} <= 0 AND {b} <= 0 THEN 1.0::DOUBLE ELSE "
        + clamp(f"1.0::DOUBLE - abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-6::DOUBLE)")
        + " END)"
    )


def count_sim(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0::DOUBLE ELSE least({a}, {b}) / greatest({a}, {b}, 1) END)"


def area(a: str) -> str:
    return f"({a}.width_ratio * {a}.height_ratio)"


def cx(a: str) -> str:
    return f"({a}.x_ratio + {a}.width_ratio / 2)"


def cy(a: str) -> str:
    return f"({a}.y_ratio + {a}.height_ratio / 2)"


def common(a: str, b: str) -> str:
    return (
        f"(greatest(0.0::DOUBLE, least({a}.x_ratio + {a}.width_ratio, {b}.x_ratio + {b}.width_ratio)"
        f" - greatest({a}.x_ratio, {b}.x_ratio))"
        f" * greatest(0.0::DOUBLE, least({a}.y_ratio + {a}.height_ratio, {b}.y_ratio + {b}.height_ratio)"
        f" - greatest({a}.y_ratio, {b}.y_ratio)))"
    )


def common_px(a: str, b: str) -> str:
    return (
        f"(greatest(0.0::DOUBLE, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
        f" * greatest(0.0::DOUBLE, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y)))"
    )


def distance(a: str, b: str) -> str:
    dx, dy = f"({cx(a)} - {cx(b)})", f"({cy(a)} - {cy(b)})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def box_sim(a: str, b: str) -> str:
    position = clamp(f"1.0::DOUBLE - {distance(a, b)} / 0.75::DOUBLE")
    size = (
        f"(({ratio_sim(a + '.width_ratio', b + '.width_ratio')}"
        f" + {ratio_sim(a + '.height_ratio', b + '.height_ratio')}) / 2)"
    )
    return clamp(
        f"{position} * 0.50::DOUBLE + {size} * 0.30::DOUBLE + {ratio_sim(area(a), area(b))} * 0.20::DOUBLE"
    )
