"""Template families of pages: what a page says by itself, and what a page without a heading of its own takes over from the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The families and the lines that show them.
AUDIT, LEGACY, NORMATIVE, SINGLE = "audit_matrix", "legacy_indicator_value", "id_normative_with_context", "single_column_indicators"
ACTIONS = ("required client actions", "required cab actions")
QUESTION = "how do i interpret this requirement?"
#: Shares of a page's width: where the middle and the right column of a matrix begin, and where numbers stand; and of its height above which they do.
MIDDLE, RIGHT, NUMBERS, FOOT = 0.31, 0.61, 0.13, 0.9


def evidence(lines: DataFrame) -> DataFrame:
    """(document, page, signals) of lines (document, page, text, x0, y0, width, height): one pass over the lines, so pages are never gathered.

    signals has a flag for each thing that a page can show; family by itself follows from them.
    """
    low = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    across = F.col("x0") / F.col("width")
    first = F.split(F.coalesce("text", F.lit("")), r"\s+")
    marked = (F.length(F.get(first, F.lit(0))) == 2) & F.get(first, F.lit(0)).endswith(".") & (F.size(first) > 1)
    letter = F.substring(F.coalesce("text", F.lit("")), 1, 1)
    number = F.split(F.get(first, F.lit(0)), r"\.")
    flags: dict[str, Column] = {
        "client": low.contains(ACTIONS[0]), "cab": low.contains(ACTIONS[1]), "client_column": marked & letter.between("a", "z") & (across >= MIDDLE) & (across < RIGHT), "auditor_column": marked & letter.between("A", "Z") & (across >= RIGHT),
        "applies": low.startswith("applicability:"), "indicator": low == "indicator", "value": low == "requirement", "question": low.contains(QUESTION), "said_requirement": low.startswith("requirement:"),
        "said_indicator": low.startswith("indicator:"), "indicators": low.startswith("indicators:"),
        "anchored": (F.size(number) >= 3) & F.forall(number, lambda p: p.rlike("^[0-9]+$")) & (across < NUMBERS) & (F.col("y0") < FOOT * F.col("height")),
    }
    return lines.groupBy("document", "page").agg(F.struct(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()]).alias("signals"))


def by_itself(s: Column) -> Column:
    """The family that a page's signals show, the most telling first; null where they show none."""
    matrix = s["client_column"] & s["auditor_column"] & s["applies"]
    return (
        F.when((s["client"] & s["cab"]) | matrix, AUDIT).when(s["indicator"] & s["value"], LEGACY)
        .when(s["question"] | (s["said_requirement"] & s["said_indicator"]), NORMATIVE).when(s["indicators"], SINGLE)
    )


def resolved(pages: DataFrame) -> DataFrame:
    """(document, page, own, family, inherited) of pages (document, page, signals) of evidence().

    A page that shows no family takes that of the last one that did, if it follows right after a page and the family is one that goes on without headings: the normative one, or the single column
    where the page has numbers of its own. Pages that are not there break the run. What is carried never changes by being taken over, so windows say it all.
    """
    w = Window.partitionBy("document").orderBy("page")
    own = pages.withColumn("own", by_itself(F.col("signals")))
    held = own.withColumns({"last": F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "follows": F.coalesce(F.lag("page").over(w) == F.col("page") - 1, F.lit(False))})
    goes_on = F.col("follows") & ((F.col("last") == NORMATIVE) | ((F.col("last") == SINGLE) & F.col("signals.anchored")))
    family = F.coalesce("own", F.when(goes_on, F.col("last")))
    return held.select("document", "page", "own", family.alias("family"), (F.col("own").isNull() & family.isNotNull()).alias("inherited"))
