"""Squarified treemaps: one grouped pass per level of nesting.

A level lays out all containers of all drives at once; only the items that can be drawn (the largest of each container, by LIMITS) go to
Python, a container at a time. Each drive has its own unit square.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROOT, TREEMAP
from .tree import cut_lineage, edges

# How many children are drawn by depth, and the deepest depth.
LIMITS = [2000, 1000, 500, 250, 120, 60, 30]
DEEPEST = 8
SMALLEST = 0.0005


@dataclass(frozen=True)
class Profile:
    """What a screen can show: its size, the smallest area for children, the smallest nested box, and the frame around children."""

    width: float
    height: float
    least_width: float
    least_height: float
    nest_width: float
    nest_height: float
    side: float
    top: float
    bottom: float


def cells(width: float = 120, height: float = 40) -> Profile:
    return Profile(width, height, 2, 1, 6, 4, 1, 1, 1)


def pixels(width: float = 1280, height: float = 720) -> Profile:
    return Profile(width, height, 4, 4, 60, 40, 2, 18, 2)


def squarify(sizes: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float] | None]:
    """Boxes for sizes (largest first) within a box, in strips along the shorter side; None where the room is too small.

    A strip takes on items as long as its worst aspect ratio doesn't grow. With all items of a strip as wide as the strip, only its
    largest and smallest item can be the worst.
    """
    out: list[tuple[float, float, float, float] | None] = [None] * len(sizes)
    total, at = float(sum(sizes)), 0
    while at < len(sizes) and w >= SMALLEST and h >= SMALLEST:
        short, long = min(w, h), max(w, h)
        end, best, held = at, float("inf"), 0.0
        while end < len(sizes):
            held += sizes[end]
            breadth = held / total * long
            ratios = [(breadth / side, side / breadth) for size in (sizes[at], sizes[end]) if (side := size / held * short) > 0 and breadth > 0]
            worst = max(max(r) for r in ratios) if ratios else float("inf")
            if end > at and worst > best:
                held -= sizes[end]
                break
            best, end = worst, end + 1
        share = 1.0 if end == len(sizes) else held / total
        along = 0.0
        for i in range(at, end):
            part = sizes[i] / held
            out[i] = (x, y + along * h, share * w, part * h) if w >= h else (x + along * w, y, part * w, share * h)
            along += part
        if w >= h:
            x, w = x + share * w, w * (1 - share)
        else:
            y, h = y + share * h, h * (1 - share)
        total, at = total - held, end
    return out


def _container(p: Profile, depth: int):
    """Lays out the items of one container."""

    def lay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place").reset_index(drop=True)
        found = squarify([float(s) for s in part["size"]], *map(float, part.loc[0, ["bx", "by", "bw", "bh"]]))
        keep = [i for i, b in enumerate(found) if b is not None]
        rows = part.loc[keep, ["drive", "record_number", "parent_record_number", "name", "size", "is_directory"]].copy()
        rows["depth"] = depth
        for k, c in enumerate("xywh"):
            rows[c] = [found[i][k] for i in keep]
        rows["children_rendered"] = rows["is_directory"] & (rows["h"] * p.height >= p.nest_height) & (rows["w"] * p.width >= p.nest_width) & (depth < DEEPEST)
        return rows

    return lay


def treemap(rolled: DataFrame, profile: Profile | None = None, root: int = ROOT) -> DataFrame:
    """TM01-TM04: the boxes of the tree below root, for each drive (TREEMAP). rolled: from tree.rollup()."""
    p = profile or cells()
    size = F.when(F.col("is_directory") & (F.col("total_size") > 0), F.col("total_size")).otherwise(F.col("file_size"))
    items = edges(rolled).where(~F.col("name").isin(".", "..")).select("drive", "record_number", "parent_record_number", "name", size.alias("size"), "is_directory").where("size > 0")
    order = Window.partitionBy("drive", "parent_record_number").orderBy(F.desc("size"), "record_number", "name")
    ranked = cut_lineage(items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LIMITS[0]))
    boxes = rolled.where(F.col("record_number") == root).select("drive", F.col("record_number").alias("box")).distinct().withColumns({c: F.lit(v).cast("double") for c, v in (("bx", 0), ("by", 0), ("bw", 1), ("bh", 1))})
    out = None
    for depth in range(DEEPEST + 1):
        limit = LIMITS[min(depth, len(LIMITS) - 1)]
        fits = (F.col("bw") * p.width >= p.least_width) & (F.col("bh") * p.height >= p.least_height) & (F.col("bw") > 0) & (F.col("bh") > 0)
        inside = ranked.where(F.col("place") <= limit).join(boxes.where(fits), (ranked["drive"] == boxes["drive"]) & (ranked["parent_record_number"] == boxes["box"])).select(ranked["*"], "bx", "by", "bw", "bh")
        level = cut_lineage(inside.groupBy("drive", "parent_record_number").applyInPandas(_container(p, depth), TREEMAP))
        out = level if out is None else out.unionByName(level)
        side, top, bottom = p.side / p.width, p.top / p.height, p.bottom / p.height
        boxes = level.where("children_rendered").select("drive", F.col("record_number").alias("box"), (F.col("x") + side).alias("bx"), (F.col("y") + top).alias("by"), (F.col("w") - 2 * side).alias("bw"), (F.col("h") - top - bottom).alias("bh"))
        if boxes.isEmpty():
            break
    return out
