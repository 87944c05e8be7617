"""Mentions of numbered parts in text, and links from them to the parts that bear the number, nearest scope first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.grammar import Word, either, found, maybe, phrase, read, span, then
from factloom.functions.semantics import column_of

# What is named with a number, and the kind of part that each is; which kinds are pointed at by place.
NAMED = {
    "table": "table", "tables": "table", "figure": "figure", "figures": "figure", "fig.": "figure", "section": "section", "sections": "section", "clause": "section", "clauses": "section",
    "annex": "section", "appendix": "section",
}
POINTED = ("table", "figure")
BELOW, ABOVE = ("below", "following"), ("above", "preceding")

_name = phrase(*NAMED)
_joint = either(then(maybe(phrase(",")), phrase("and", "or", "to", "&")), phrase(","))
_pointer = either(then(phrase(*POINTED), phrase("below", "above")), then(phrase("following", "preceding"), phrase(*POINTED)))
_note = then(phrase("["), maybe(phrase("^")))


def _label(text: str, words: list[Word], i: int) -> int:
    """The place after a label: letters and digits with dots and hyphens, nothing between them, that hold a digit, or are a letter or a Roman number in capitals."""
    j = i
    while j < len(words) and (words[j].low[0].isalnum() or (j > i and words[j].low in ".-")) and (j == i or words[j].start == words[j - 1].end):
        j += 1
    while j > i and words[j - 1].low in ".-":
        j -= 1
    low = "".join(w.low for w in words[i:j])
    if any(map(str.isdigit, low)):
        return j
    return j if low and text[words[i].start : words[j - 1].end].isupper() and (len(low) == 1 or set(low) <= set("ivxlc")) else -1


def mentions(text: str) -> list[dict]:
    """(start, end, text, kind, label, way): named parts, also several after one name; parts below or above; footnote marks. Ways are label, below, above and note."""
    words = read(text)
    out = []
    for i, j in found(_name, words):
        kind, first = NAMED[" ".join(w.low for w in words[i:j]).replace(" .", ".")], True
        while (k := _label(text, words, j)) > 0:
            if first and words[j].start == words[j - 1].end and words[j - 1].low != ".":
                break
            a, b = words[i].start if first else words[j].start, words[k - 1].end
            out.append({"start": a, "end": b, "text": text[a:b], "kind": kind, "label": text[words[j].start : b].lower(), "way": "label"})
            first, j = False, _joint(words, k)
            if j < 0:
                break
    for i, j in found(_pointer, words):
        low = [w.low for w in words[i:j]]
        out.append(span(text, words, i, j) | {"kind": next(w for w in low if w in POINTED), "label": None, "way": "below" if set(low) & set(BELOW) else "above"})
    for i, j in found(_note, words):
        if j + 1 < len(words) and words[j].low.isdigit() and len(words[j].low) <= 2 and words[j + 1].low == "]":
            out.append(span(text, words, i, j + 2) | {"kind": "footnote", "label": words[j].low, "way": "note"})
    return sorted(out, key=lambda m: (m["start"], m["end"]))


def opening(text: str) -> dict | None:
    """(kind, label) that a text begins with, as a caption, heading or footnote does; None where it begins with neither."""
    first = next((m for m in mentions(text) if not text[: m["start"]].strip() and m["label"] is not None), None)
    if first:
        return {"kind": first["kind"], "label": first["label"]}
    words = read(text[:64].lstrip())
    return {"kind": "footnote", "label": words[0].low} if words and words[0].low.isdigit() and len(words[0].low) <= 2 and text.lstrip()[len(words[0].low) :][:1].isspace() else None


_S, _I = T.StringType(), T.IntegerType()
MENTION = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I), *(T.StructField(n, _S) for n in ("text", "kind", "label", "way"))]))
OPENING = T.StructType([T.StructField("kind", _S), T.StructField("label", _S)])


def mention_rows(text: Column) -> Column:
    return column_of(MENTION, mentions, text)


def opening_of(text: Column) -> Column:
    return column_of(OPENING, opening, text)


def links(blocks: DataFrame) -> DataFrame:
    """(id, start, end, text, kind, label, way, target, reason) for each mention in blocks (document, id, ordinal, scope, kind, text): the part that it means, or why there is none.

    scope numbers the sections of a document in their order. A label means the part of its kind that bears it in the mention's own scope, or else in the nearest scope, the earlier of two as near; in one
    scope the first that bears it. Below and above mean the nearest part of the kind in the mention's scope. A part is not linked to itself: its own label at its own beginning is no mention.
    Mentions and parts are met by carrying parts along the order of each label, so a label that a long document repeats costs its rows, not their product.
    """
    parts = blocks.where(F.col("kind").isin("table", "figure", "heading", "footnote")).withColumn("o", opening_of(F.col("text")))
    fits = (F.col("o.kind") == F.col("kind")) | ((F.col("o.kind") == "section") & (F.col("kind") == "heading"))
    bearing = parts.where(fits).groupBy("document", F.col("o.kind").alias("kind"), F.col("o.label").alias("label"), "scope").agg(F.min_by("id", "ordinal").alias("part"))
    said = blocks.select("document", "id", "ordinal", "scope", "kind", F.explode(mention_rows(F.col("text"))).alias("m"))
    said = said.select("document", "id", "ordinal", "scope", "m.*", (F.col("kind").isin("table", "figure", "heading", "footnote") & (F.col("m.start") == 0) & (F.col("m.way") != "below") & (F.col("m.way") != "above")).alias("own"))
    said = said.where("not own").drop("own")

    nothing = F.lit(None).cast("string")
    named = said.where("label is not null").select("document", "kind", "label", "scope", F.lit(None).cast("long").alias("part"), F.struct("id", "start", "end", "text", "way").alias("m"))
    both = named.unionByName(bearing.select("document", "kind", "label", "scope", F.col("part").cast("long").alias("part"), F.lit(None).cast(named.schema["m"].dataType).alias("m")))
    w = Window.partitionBy("document", "kind", "label").orderBy("scope")
    place = F.when(F.col("part").isNotNull(), F.struct("scope", "part"))
    # the range frames take the mention's own scope in on both sides
    back, ahead = F.last(place, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first(place, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.when(F.col("a").isNull() | (F.col("scope") - F.col("b.scope") <= F.col("a.scope") - F.col("scope")), F.col("b.part")).otherwise(F.col("a.part"))
    target = F.when(F.col("b").isNull(), F.col("a.part")).otherwise(near)
    labelled = both.withColumns({"b": back, "a": ahead}).where("m is not null").select("m.id", "m.start", "m.end", "m.text", "kind", "label", "m.way", target.alias("target"))
    labelled = labelled.withColumn("reason", F.when(F.col("target").isNull(), "no part bears this label").when(F.col("target") == F.col("id"), "itself")).withColumn("target", F.when(F.col("reason").isNull(), F.col("target")))

    shown = said.where("label is null").select("document", "scope", "kind", "ordinal", F.lit(None).cast("long").alias("part"), F.struct("id", "start", "end", "text", "way").alias("m"))
    seen = shown.unionByName(parts.where(F.col("kind").isin(*POINTED)).select("document", "scope", "kind", "ordinal", F.col("id").cast("long").alias("part"), F.lit(None).cast(shown.schema["m"].dataType).alias("m")))
    by = Window.partitionBy("document", "scope", "kind").orderBy("ordinal")
    before, after = F.last("part", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, -1)), F.first("part", ignorenulls=True).over(by.rangeBetween(1, Window.unboundedFollowing))
    pointed = seen.withColumns({"b": before, "a": after}).where("m is not null").withColumn("target", F.when(F.col("m.way") == "below", F.col("a")).otherwise(F.col("b")))
    pointed = pointed.select("m.id", "m.start", "m.end", "m.text", "kind", nothing.alias("label"), "m.way", "target", F.when(F.col("target").isNull(), "no such part in scope").alias("reason"))
    return labelled.unionByName(pointed)
