"""Units merged and split without losing a character: every unit carries a map of where its text comes from.

A map is an array of pieces (at, source, start, end) in the order of the text: from code point at on, the unit holds the source's text from start to end. A piece
without a source is a joint that a merge has put in. Merging concatenates maps, splitting cuts them, so that they compose over any number of repairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINT = "\n"


def _piece(at: Column, source: Column, start: Column, end: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), source.cast("long").alias("source"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def original(units: DataFrame) -> DataFrame:
    """units (document, id, ordinal, parent, kind, text) with the map of a unit that nothing has been done to; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return units.withColumn("text", text).withColumn("pieces", F.array(_piece(F.lit(0), F.col("id"), F.lit(0), F.char_length(text))))


def merged(units: DataFrame, requests: DataFrame, units_table: tuple[str, ...] = ("table", "table_row")) -> tuple[DataFrame, DataFrame]:
    """(units after the merges of requests (document, request, id), verdicts (document, request, n, reason)).

    A request names the units of a document that become one, which takes the id and the place of its first. It is carried out where reason is null: two units or more, none
    twice, none in another request, all there, none a coverage check or part of a table, none without text, all of one parent which is none of them, and next to each other in the order of the document.
    """
    w = Window.partitionBy("document").orderBy("ordinal")
    placed = units.withColumn("place", F.when(F.col("kind") != "coverage", F.count_if(F.col("kind") != "coverage").over(w)))
    asked = requests.groupBy("document", "request", "id").agg(F.count("*").alias("times")).withColumn("shared", F.count("*").over(Window.partitionBy("document", "id")) > 1)
    held = asked.join(placed.select("document", "id", "ordinal", "place", "parent", "kind", "text", "pieces"), ["document", "id"], "left")
    rows = F.count("*")
    reason = (
        F.when((rows < 2) | (F.max("times") > 1), "needs two units or more, none twice").when(F.bool_or("shared"), "unit in two requests").when(F.count("ordinal") < rows, "unknown unit").when(F.bool_or(F.col("kind") == "coverage"), "coverage check")
        .when(F.bool_or(F.col("kind").isin(*units_table)), "table boundary").when(F.bool_or(F.trim("text") == ""), "no text").when((F.count_distinct(F.coalesce("parent", F.lit(-1))) > 1) | F.array_contains(F.collect_set("id"), F.max("parent")), "different parents")
        .when(F.max("place") - F.min("place") + 1 != rows, "not adjacent")
    )
    parts = F.array_sort(F.collect_list(F.struct("place", "id", "text", "pieces")))
    each = held.groupBy("document", "request").agg(rows.alias("n"), reason.alias("reason"), F.when(reason.isNull(), parts).alias("parts"))
    # where each part begins in the new text: after the parts before it and a joint for each
    begin = F.transform(F.col("parts"), lambda _, i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, p: n + F.char_length(p["text"]) + len(JOINT)))
    moved = F.transform(
        F.arrays_zip(F.col("parts").alias("p"), begin.alias("b")),
        lambda z: F.concat(F.when(z["b"] > 0, F.array(_piece(z["b"] - len(JOINT), F.lit(None), F.lit(0), F.lit(len(JOINT))))).otherwise(F.array().cast("array<struct<at: bigint, source: bigint, start: bigint, end: bigint>>")), F.transform(z["p"]["pieces"], lambda x: _piece(x["at"] + z["b"], x["source"], x["start"], x["end"]))),
    )
    good = each.where("reason is null")
    new = good.select("document", F.get("parts", F.lit(0))["id"].alias("id"), F.array_join(F.transform("parts", lambda p: p["text"]), JOINT).alias("new_text"), F.flatten(moved).alias("new_pieces"))
    gone = good.select("document", F.explode(F.slice(F.col("parts"), 2, 1 << 30)).alias("p")).select("document", F.col("p.id").alias("id"))
    out = units.join(gone, ["document", "id"], "left_anti").join(new, ["document", "id"], "left")
    out = out.withColumns({"text": F.coalesce("new_text", "text"), "pieces": F.coalesce("new_pieces", "pieces")}).drop("new_text", "new_pieces")
    return out.select(*units.columns), each.select("document", "request", "n", "reason")


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The pieces of the code points from start to end, counted from start."""
    within = F.filter(pieces, lambda p: (p["at"] < end) & (p["at"] + p["end"] - p["start"] > start))

    def clipped(p: Column) -> Column:
        low, high = F.greatest(p["at"], start), F.least(p["at"] + p["end"] - p["start"], end)
        return _piece(low - start, p["source"], p["start"] + low - p["at"], p["start"] + high - p["at"])

    return F.transform(within, clipped)


def divided(units: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units after the splits of requests (document, id, cuts), verdicts (document, id, n, reason)).

    cuts are code points of the unit's text where a new part begins. A unit is split where reason is null: it is there and not part of a table, one request asks for it, and the cuts rise, lie inside the text and leave
    no part blank. Parts have the unit's id with part 0, 1, ...; units that stay whole have part 0.
    """
    asked = requests.groupBy("document", "id").agg(F.count("*").alias("times"), F.first("cuts").alias("cuts"))
    rows = units.join(asked, ["document", "id"], "full")
    size = F.char_length("text").cast("long")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c.cast("long")), F.array(size))
    spans = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda a, i: F.struct(a.alias("a"), F.get(bounds, i + 1).alias("b")))
    text = lambda s: F.substring(F.col("text"), s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int"))
    reason = (
        F.when(F.col("ordinal").isNull(), "unknown unit").when(F.col("times") > 1, "asked twice").when(F.col("kind").isin("table", "table_row", "coverage"), "table boundary").when(F.size("cuts") == 0, "no cuts")
        .when(F.exists(spans, lambda s: s["a"].isNull() | s["b"].isNull() | (s["b"] <= s["a"])), "cuts outside or not rising").when(F.exists(spans, lambda s: F.trim(F.regexp_replace(text(s), r"\s+", " ")) == ""), "blank part")
    )
    told = rows.withColumn("reason", F.when(F.col("times").isNotNull(), reason)).withColumn("split", F.col("times").isNotNull() & F.col("reason").isNull())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")))
    parts = told.where("ordinal is not null").select("*", F.posexplode(F.when(F.col("split"), spans).otherwise(whole)).alias("part", "s"))
    s = F.col("s")
    out = parts.withColumn("pieces", F.when(F.col("split"), _cut(F.col("pieces"), s["a"], s["b"])).otherwise(F.col("pieces"))).withColumn("text", text(s)).select(*units.columns, "part")
    return out, told.where("times is not null").select("document", "id", F.size("cuts").alias("n"), "reason")


def rebuilt(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(document, id, text) of units made anew from their maps and the texts of sources (source, original), for what a map says must be what a unit holds."""
    each = units.select("document", "id", *(["part"] if "part" in units.columns else []), F.posexplode_outer("pieces").alias("k", "p"))
    keys = [c for c in ("document", "id", "part") if c in each.columns]
    joined = each.join(sources, F.col("p.source") == F.col("source"), "left")
    text = F.when(F.col("p.source").isNull(), F.when(F.col("p.end").isNotNull(), F.lit(JOINT)).otherwise("")).otherwise(F.substring(F.col("original"), F.col("p.start").cast("int") + 1, (F.col("p.end") - F.col("p.start")).cast("int")))
    return joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "").alias("text"))
