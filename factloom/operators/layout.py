"""Rules of a page's layout that windows can state: repeating marginals, lanes of columns, notes at the bottom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordered import islands

#: Shares of a page's height that are its margins, and of the pages, or of the odd or even ones, that a template must be on; pages in a row that do instead.
MARGIN, PAGES, PARITY, ROW = 0.10, 0.50, 0.60, 3
#: Lines that recur in the body of standards, which are no marginals.
# Words that open a numbered part, labels before a colon, and a question that stands as a heading.
NUMBERED = ("principle", "criterion")
LABELS = ("indicator", "requirement")
QUESTION = "how do i interpret this requirement?"
#: Points that count as one height.
JITTER = 6


def _anchors(text: Column) -> Column:
    """Whether a line opens a part of a standard: it recurs on pages without being their margin."""
    low = F.lower(text)
    word, rest = F.substring_index(low, " ", 1), F.regexp_replace(low, r"^\S+ *", "")
    return (word.isin(*NUMBERED) & rest.rlike("^[0-9]")) | (low.contains(":") & F.rtrim(F.substring_index(low, ":", 1)).isin(*LABELS)) | low.startswith(QUESTION)


def marginals(lines: DataFrame, document: str, page: str, height: float) -> DataFrame:
    """(document, label, template, bucket, pages, reason) of the headers and footers among lines (document, page, text, y0, y1)."""
    text, middle = F.trim(F.regexp_replace("text", r"\s+", " ")), (F.col("y0") + F.col("y1")) / 2
    template = F.regexp_replace(F.regexp_replace(F.lower(text), r"\bpage \d+ of \d+\b", "page {n} of {n}"), r"\b\d+\b", "{n}")
    label = F.when(middle <= height * MARGIN, "header").when(middle >= height * (1 - MARGIN), "footer")
    key = [document, "label", "template", "bucket"]
    c = lines.where(text.rlike(r"\w") & ~_anchors(text)).select(document, page, label.alias("label"), template.alias("template"), F.round(middle / JITTER).cast("long").alias("bucket")).where("label is not null")
    odd = F.col(page) % 2 == 1
    count = lambda on: F.count_distinct(F.when(on, F.col(page)))
    held = c.groupBy(*key).agg(F.count_distinct(page).alias("pages"), count(~odd).alias("even"), count(odd).alias("odd"))
    whole = lines.groupBy(document).agg(F.count_distinct(page).alias("total"), count(~odd).alias("even_pages"), count(odd).alias("odd_pages"))
    longest = islands(c, key, page).groupBy(*key).agg(F.max("n").alias("run"))
    most = lambda n, share: F.greatest(F.lit(2), F.ceil(F.col(n) * share))
    half = lambda side: (F.col(f"{side}_pages") >= 2) & (F.col(side) >= most(f"{side}_pages", PARITY))
    reason = F.when(F.col("pages") >= most("total", PAGES), "global").when(half("even") | half("odd"), "parity").when(F.col("run") >= ROW, "run")
    return held.join(whole, document).join(longest, key).withColumn("reason", reason).where("reason is not null and total >= 2").select(*key, "pages", "reason")


#: Share of a page's width that is no column's, borders of the lanes, blocks that each lane must have, and switches between them.
WIDE, LEFT, RIGHT, LANE, SWITCHES = 0.58, 0.46, 0.54, 8, 5


def lanes(blocks: DataFrame, document: str, order: str, width: float) -> DataFrame:
    """blocks (document, order, id, x0, y0, x1) with their place in reading order, which is their order but where two lanes are mixed."""
    middle = (F.col("x0") + F.col("x1")) / 2
    lane = F.when(middle < width * LEFT, 0).when(middle > width * RIGHT, 1)
    w, whole = Window.partitionBy(document).orderBy(order), Window.partitionBy(document)
    c = blocks.where(F.col("x1") - F.col("x0") < width * WIDE).select(document, order, "id", "x0", "y0", lane.alias("lane")).where("lane is not null")
    c = c.withColumn("switch", F.lag("lane").over(w) != F.col("lane")).withColumn("first", F.first("lane").over(w))
    mixed = (F.least(F.count_if(F.col("lane") == 0).over(whole), F.count_if(F.col("lane") == 1).over(whole)) >= LANE) & (F.count_if("switch").over(whole) >= SWITCHES)
    c = c.withColumn("mixed", mixed).where("mixed")
    slots = c.select(document, F.col(order).alias("place"), F.row_number().over(w).alias("slot"))
    ranked = c.select(document, "id", F.row_number().over(Window.partitionBy(document).orderBy(F.col("lane") != F.col("first"), "y0", "x0", "id")).alias("slot"))
    moved = ranked.join(slots, [document, "slot"]).select("id", "place")
    return blocks.join(moved, "id", "left").withColumn("place", F.coalesce("place", order))


#: Shares of a page's height from where a numbered line may be a note, and is one; gap in points and shift to the side of a line that goes on one.
LOW, BOTTOM, GAP, SHIFT = 0.69, 0.84, (-2.0, 14.0), 32.0


def footnotes(lines: DataFrame, page: list[str], height: float) -> DataFrame:
    """(id, note, role, reason): notes and the lines that go on them, among the lines (page, id, text, x0, y0, y1) of body text."""
    number = F.regexp_extract(F.trim("text"), r"^([1-9]\d*)\s+\S", 1)
    low = lines.where(F.col("y0") >= height * LOW).select(*page, "id", "x0", "y0", "y1", F.nullif(number, F.lit("")).cast("int").alias("no"))
    by_y, whole = Window.partitionBy(*page).orderBy("y0", "id"), Window.partitionBy(*page)
    numbered = low.where("no is not null").withColumn("before", F.lag("no").over(by_y))
    numbered = numbered.withColumn("rising", (F.count("*").over(whole) >= 2) & F.min(F.coalesce(F.col("no") > F.col("before"), F.lit(True))).over(whole))
    notes = numbered.select("id", F.when(F.col("y0") >= height * BOTTOM, "bottom").when(F.col("rising"), "run").alias("reason")).where("reason is not null")
    w = Window.partitionBy(*page).orderBy("y0", "x0", "id")
    rows = low.join(notes, "id", "left")
    goes_on = F.col("reason").isNull() & F.col("no").isNull() & (F.col("y0") - F.lag("y1").over(w)).between(*GAP) & (F.abs(F.col("x0") - F.lag("x0").over(w)) <= SHIFT)
    rows = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    v = Window.partitionBy(*page, "island").orderBy("y0", "x0", "id")
    rows = rows.withColumn("note", F.first("id").over(v)).withColumn("why", F.first("reason").over(v)).where("why is not null")
    return rows.select("id", "note", F.when(F.col("id") == F.col("note"), "note").otherwise("line").alias("role"), F.col("why").alias("reason"))
