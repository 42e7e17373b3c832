"""Boxes and polygons as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_box(points: Column) -> Column:
    """The box of an array of ``[x, y]`` points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def aspect(b: Column) -> Column:
    return F.try_divide(F.greatest(b["w"], b["h"]), F.least(b["w"], b["h"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for empty boxes."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def suspect_reasons(b: Column, min_side: float = 50, min_area: float = 5000, max_aspect: float = 10) -> Column:
    """Why a figure's box looks wrong (F32)."""
    return F.array_compact(F.array(F.when(b.isNull(), "no_box"), F.when(F.least(b["w"], b["h"]) < min_side, "small_side"), F.when(area(b) < min_area, "small_area"), F.when(aspect(b) > max_aspect, "extreme_aspect")))


def grid_cell(b: Column, width: Column, height: Column, n: int = 3) -> Column:
    """The cell, counted by rows, of a box's centre in an ``n`` by ``n`` grid."""
    cx, cy = (F.least(F.greatest(F.floor(c * n), F.lit(0)), F.lit(n - 1)) for c in (F.try_divide(b["x"] + b["w"] / 2, width), F.try_divide(b["y"] + b["h"] / 2, height)))
    return (cy * n + cx).cast("int")


def cells_entropy(boxes: Column, width: Column, height: Column, n: int = 3) -> Column:
    """Entropy of boxes over the grid, 0 to 1."""
    cells = F.transform(boxes, lambda b: grid_cell(b, width, height, n))
    total = F.size(cells)
    share = lambda i: F.try_divide(F.size(F.filter(cells, lambda c: c == i)), total)
    terms = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.coalesce(F.when(share(i) > 0, -share(i) * F.log2(share(i))), F.lit(0.0)))
    return F.when(total > 0, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.log2(F.lit(float(n * n)))).otherwise(0.0)


def clutter(*parts: Column) -> Column:
    """The mean of terms capped at 1."""
    return sum((F.least(p, F.lit(1.0)) for p in parts), F.lit(0.0)) / len(parts)


def layout_flags(edge_density: Column, whitespace: Column, components: Column, clutter_score: Column, imbalance_score: Column) -> Column:
    """Flags of an image that is hard to read (F29): many edges, little free space, many parts, clutter, imbalance. Thresholds are fixed values."""
    return F.struct((edge_density >= 0.15).cast("int").alias("high_edge_density"), (whitespace <= 0.20).cast("int").alias("low_whitespace"), (components >= 500).cast("int").alias("high_component_count"), (clutter_score >= 0.50).cast("int").alias("high_visual_clutter"), (imbalance_score >= 0.50).cast("int").alias("layout_imbalance"))
