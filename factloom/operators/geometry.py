"""Boxes on pages: overlap joins by grid cells, containment, intersection over union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of a grid row in points.
CELL = 48.0


def overlap(a: str, b: str, slack: float = 0.0) -> Column:
    """Boxes a and b overlap in x and in y by more than -slack."""
    c = lambda s, n: F.col(f"{s}.{n}")
    x = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    y = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return (x > -slack) & (y > -slack)


def area(s: str) -> Column:
    return (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))


def iou(a: str, b: str) -> Column:
    c = lambda s, n: F.col(f"{s}.{n}")
    w = F.greatest(F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")), F.lit(0.0))
    h = F.greatest(F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")), F.lit(0.0))
    return w * h / (area(a) + area(b) - w * h)


def gridded(boxes: DataFrame, slack: float = 0.0, cell: float = CELL) -> DataFrame:
    """boxes once per grid row that they touch: an equality to join on instead of a range."""
    first, last = F.floor((F.col("y0") - slack) / cell), F.floor((F.col("y1") + slack) / cell)
    return boxes.withColumn("cell", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], slack: float = 0.0, cell: float = CELL) -> DataFrame:
    """Pairs (a, b) of boxes with equal keys that overlap; each pair once, in the first grid row that both touch."""
    a, b = gridded(left, slack, cell).alias("a"), gridded(right, slack, cell).alias("b")
    same = F.col("a.cell") == F.col("b.cell")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    home = F.greatest(F.floor((F.col("a.y0") - slack) / cell), F.floor((F.col("b.y0") - slack) / cell))
    return a.join(b, same & overlap("a", "b", slack) & (F.col("a.cell") == home))


def point_join(points: DataFrame, boxes: DataFrame, keys: list[str], slack: float = 0.0, cell: float = CELL) -> DataFrame:
    """Points p (px, py) with the boxes b of equal keys that hold them."""
    p = points.withColumn("cell", F.floor(F.col("py") / cell)).alias("p")
    b = gridded(boxes, slack, cell).alias("b")
    on = F.col("p.cell") == F.col("b.cell")
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    inside = F.col("p.px").between(F.col("b.x0") - slack, F.col("b.x1") + slack) & F.col("p.py").between(F.col("b.y0") - slack, F.col("b.y1") + slack)
    return p.join(b, on & inside)
