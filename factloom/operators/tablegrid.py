"""Invariants of a table's grid under repair: what its cells cover, where they meet, and what its rows are bound to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bands(cells: DataFrame) -> DataFrame:
    """cells (table, cell, row, column, row_span, column_span) once for each band of rows that they cross: (table, band, low, high, cell, first, after).

    Bands lie between the rows where some cell of the table begins or ends, so a sweep down the rows stops there alone, however tall a cell is.
    """
    edges = cells.select("table", F.explode(F.array(F.col("row"), F.col("row") + F.col("row_span"))).alias("low")).distinct()
    w = Window.partitionBy("table").orderBy("low")
    numbered = edges.withColumns({"band": F.row_number().over(w), "high": F.lead("low").over(w)})
    top = cells.join(numbered.select("table", F.col("low").alias("row"), F.col("band").alias("from")), ["table", "row"])
    both = top.withColumn("end", F.col("row") + F.col("row_span")).join(numbered.select("table", F.col("low").alias("end"), F.col("band").alias("upto")), ["table", "end"])
    each = both.select("table", "cell", F.col("column").alias("first"), (F.col("column") + F.col("column_span")).alias("after"), F.explode(F.sequence(F.col("from"), F.col("upto") - 1)).alias("band"))
    return each.join(numbered.where("high is not null"), ["table", "band"])


def findings(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table, issue, cell, other, low, high, first, after) of cells (table, cell, row, column, row_span, column_span, x0, y0, x1, y1, bound) of tables (table, rows, columns).

    span: a cell that spans nothing, or begins before the grid; outside: one that ends beyond it; neither takes part in what follows. overlap: a cell that lies on another, each with the one of those before it that
    reaches furthest; gap: places that no cell covers. boundary: cells next to each other in a band whose boxes overlap by more than half of the narrower one, so the boxes contradict the grid; box: a cell
    whose box is inside out. binding: a source row that cells of two rows are bound to; unbound: a cell without one in a table that has some.
    A null in row, column or a span is a span issue. Tables without cells are one gap; cells of no table are of no interest here.
    """
    held = cells.join(tables, "table")
    bad = ~F.coalesce((F.col("row_span") > 0) & (F.col("column_span") > 0) & (F.col("row") >= 0) & (F.col("column") >= 0), F.lit(False))
    out = ~bad & ((F.col("row") + F.col("row_span") > F.col("rows")) | (F.col("column") + F.col("column_span") > F.col("columns")))
    kind = F.when(bad, "span").when(out, "outside")
    told = held.withColumn("issue", kind)
    number = lambda c: F.lit(c).cast("long") if c is None else c.cast("long")

    def rows(df: DataFrame, issue, cell=None, other=None, low=None, high=None, first=None, after=None) -> DataFrame:
        names = ("cell", "other", "low", "high", "first", "after")
        return df.select("table", issue.alias("issue"), *[number(c).alias(n) for n, c in zip(names, (cell, other, low, high, first, after), strict=True)])

    found = rows(told.where("issue is not null"), F.col("issue"), F.col("cell"))
    good = told.where("issue is null").drop("issue")

    each = bands(good)
    w = Window.partitionBy("table", "band").orderBy("first", "after", "cell")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    # the cell that reaches furthest of those before stands for all that the sweep has open
    swept = each.withColumns({"reach": F.max("after").over(so_far), "by": F.max_by("cell", "after").over(so_far)})
    meets = F.col("first") < F.col("reach")
    over = swept.where(meets).groupBy("table", F.least("cell", "by").alias("a"), F.greatest("cell", "by").alias("b")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max(F.least("after", "reach")).alias("after"))
    found = found.unionByName(rows(over, F.lit("overlap"), F.col("a"), F.col("b"), F.col("low"), F.col("high"), F.col("first"), F.col("after")))

    inner = swept.select("table", "low", "high", F.coalesce("reach", F.lit(0)).alias("from"), F.col("first").alias("upto"))
    last = each.groupBy("table", "low", "high").agg(F.max("after").alias("from")).join(tables, "table").select("table", "low", "high", "from", F.col("columns").alias("upto"))
    spans = each.select("table", "low", "high").distinct()
    ends = Window.partitionBy("table").orderBy("low")
    above = spans.withColumn("before", F.coalesce(F.lag("high").over(ends), F.lit(0))).join(tables, "table").select("table", F.col("before").alias("low"), F.col("low").alias("high"), F.lit(0).alias("from"), F.col("columns").alias("upto"))
    below = tables.join(spans.groupBy("table").agg(F.max("high").alias("end")), "table", "left").select("table", F.coalesce("end", F.lit(0)).alias("low"), F.col("rows").alias("high"), F.lit(0).alias("from"), F.col("columns").alias("upto"))
    holes = inner.unionByName(last).unionByName(above).unionByName(below).where("upto > from and high > low")
    found = found.unionByName(rows(holes, F.lit("gap"), None, None, F.col("low"), F.col("high"), F.col("from"), F.col("upto")))

    boxed = each.join(good.select("table", "cell", "x0", "x1"), ["table", "cell"])
    beside = boxed.withColumns({"px0": F.lag("x0").over(w), "px1": F.lag("x1").over(w), "other": F.lag("cell").over(w)})
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0"))
    crossed = beside.where((narrow > 0) & (F.col("px1") - F.col("x0") > 0.5 * narrow)).groupBy("table", "cell", "other").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.unionByName(rows(crossed, F.lit("boundary"), F.col("cell"), F.col("other"), F.col("low"), F.col("high")))
    found = found.unionByName(rows(good.where("x1 < x0 or y1 < y0"), F.lit("box"), F.col("cell")))

    bound = good.where("bound is not null").groupBy("table", "bound").agg(F.count_distinct("row").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.min("cell").alias("cell"))
    found = found.unionByName(rows(bound.where("n > 1"), F.lit("binding"), F.col("cell"), F.col("bound"), F.col("low"), F.col("high")))
    some = good.where("bound is not null").select("table").distinct()
    return found.unionByName(rows(good.where("bound is null").join(some, "table", "left_semi"), F.lit("unbound"), F.col("cell")))
