"""Column expressions over boxes: centre (cx, cy), size (w, h), angle in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAFF_LINES = 5
LEDGER_LINES = 4


def box(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in ("cx", "cy", "w", "h", "angle")}


def left(b) -> Column:
    return b["cx"] - b["w"] / 2


def right(b) -> Column:
    return b["cx"] + b["w"] / 2


def top(b) -> Column:
    return b["cy"] - b["h"] / 2


def bottom(b) -> Column:
    return b["cy"] + b["h"] / 2


def normalised_angle(w: Column, h: Column, angle: Column) -> Column:
    """Fold an angle to [-45, 45]; a quarter turn swaps width and height."""
    turned = F.when(angle > 135, angle - 180).when(angle < -135, angle + 180).when(angle > 45, angle - 90).when(
        angle < -45, angle + 90
    ).otherwise(angle)
    swap = ((angle > 45) & (angle <= 135)) | ((angle < -45) & (angle >= -135))
    return F.struct(
        F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"), turned.alias("angle")
    )


def y_at(x: Column, b) -> Column:
    """Height of the centre line of a box, extended to x."""
    return (x - b["cx"]) * F.tan(F.radians(b["angle"])) + b["cy"]


def may_touch(a, b) -> Column:
    """Cheap test: centres no farther apart than both major axes together."""
    return F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) <= F.greatest(a["w"], a["h"]) + F.greatest(b["w"], b["h"])


def rectangles_intersect(a, b) -> Column:
    """Axis-aligned overlap, edges included."""
    return (left(a) <= right(b)) & (left(b) <= right(a)) & (top(a) <= bottom(b)) & (top(b) <= bottom(a))


def boxes_overlap(a, b) -> Column:
    """Overlap of two rotated boxes, touching included: no axis of either box separates them."""
    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    result = F.lit(True)
    for own in (a, b):
        for quarter in (0, 90):
            t = F.radians(own["angle"] + quarter)
            ux, uy = F.cos(t), F.sin(t)
            reach = F.lit(0.0)
            for other in (a, b):
                c, s = F.cos(F.radians(other["angle"])), F.sin(F.radians(other["angle"]))
                reach = reach + other["w"] / 2 * F.abs(c * ux + s * uy) + other["h"] / 2 * F.abs(c * uy - s * ux)
            result = result & (F.abs(dx * ux + dy * uy) <= reach + 1e-9)
    return result


def connects_extrapolated(a, b, unit: Column) -> Column:
    """Two line fragments meet: small gaps to the midpoint and heights there within a third of a unit."""
    first = a["cx"] > b["cx"]
    lo = {k: F.when(first, b[k]).otherwise(a[k]) for k in a}
    hi = {k: F.when(first, a[k]).otherwise(b[k]) for k in a}
    mid = (a["cx"] + b["cx"]) / 2
    gap = F.greatest(mid - lo["cx"] - F.floor(lo["w"] / 2), hi["cx"] - mid - F.floor(hi["w"] / 2))
    return (gap <= unit * 5) & (F.abs(y_at(mid, lo) - y_at(mid, hi)) <= unit / 3)


def staff_position(ys: Column, y: Column) -> Column:
    """Position of a height on a staff in half units, counted from below; halves round to even."""
    distances = F.transform(ys, lambda v: F.abs(v - y))
    i = F.array_position(distances, F.array_min(distances)).cast("int")
    unit = (F.element_at(ys, -1) - F.element_at(ys, 1)) / (F.size(ys) - 1)
    away = F.element_at(ys, i) - y
    return ((F.size(ys) - (i - 1)) * 2 + F.bround(away * 2 / unit) - 1).cast("int")


def clamp_region(start: Column, stop: Column, pad: Column, low: Column, high: Column) -> Column:
    return F.struct(F.greatest(start - pad, low).alias("start"), F.least(stop + pad, high).alias("stop"))
