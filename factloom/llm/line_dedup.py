"""Cross-site boilerplate lines by distinct-site spread: HyperLogLog sketches first, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import documents, free, joined_by_size, written

#: A line on this many sites or more is boilerplate.
SITES = 10
#: log2 of the registers of a sketch; the relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 8
#: Sketches whose estimate is within this many standard errors of the threshold are counted exactly.
ERRORS = 5


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line."""
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(site, key, doc_id) of each different line of docs that is not blank."""
    split = docs.select(F.col(site).alias("site"), "doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("line"))
    return split.where(F.trim("line") != "").select("site", "doc_id", line_key(F.col("line")).alias("key"))


def repeated(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """(site, key, doc_id, first) of the lines that documents mention at least sites times, first being the smallest doc_id; a line of fewer
    mentions has fewer sites. Written once, for what follows reads it again; the texts are split here alone."""
    mentions = written(lines(docs, site), "lines")
    held = written(mentions.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= sites), "held")
    return written(joined_by_size(mentions, held, ["key"], mentions.count()), "repeated")


def spread(mentions: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """A mergeable sketch of the sites of each line of mentions (site, key): (key, sketch). Sketches of parts of a corpus merge by hll_union_agg."""
    return mentions.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))


def boilerplate(mentions: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """(key, sites, first, n) of the lines of repeated() on at least sites distinct sites; n is how many documents mention the line.

    The estimate decides alone where it is more than ERRORS standard errors off the threshold; the rest get an exact distinct
    count over their own lines, of which each site counts once before the shuffle.
    """
    margin = ERRORS * 1.04 / 2 ** (lg_k / 2)
    low, high = sites * (1 - margin), sites * (1 + margin) + 1
    est = mentions.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min("first").alias("first"))
    est = written(est.select("key", F.hll_sketch_estimate("sketch").alias("sites"), "first", "n"), "spread")
    near = est.where((F.col("sites") >= low) & (F.col("sites") <= high)).drop("sites")
    each = mentions.where("site is not null").groupBy("key", "site").agg(F.lit(1).alias("one"))
    counted = each.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites).join(near, "key")
    return est.where(F.col("sites") > high).unionByName(counted)


def without_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source", counts: bool = False) -> DataFrame:
    """docs with boilerplate lines cut from text; the document of smallest doc_id that holds such a line keeps its first copy there.

    So no line leaves the corpus, and of many copies of a document one stays whole. Lines are compared trimmed, blank lines are never cut,
    n_chars, where docs has it, is recomputed for changed texts. A null text stays null; a null site counts for no site;
    rows with the same doc_id are treated alike, so repeated rows are; a null doc_id is never the first unless all are. A very long text is split like
    any other. Other columns pass through, whatever their names. With counts, columns n_lines and n_removed are added. An empty table gives no rows.
    """
    mentions = repeated(docs, sites, site)
    found = written(boilerplate(mentions, sites).select("key", "first", "n"), "boilerplate")
    # what is cut has its first document from the mentions already
    mine = joined_by_size(mentions, found.select("key", "n"), ["key"], mentions.count())
    of, cut, keep, keys, left = free(docs, "of", "cut", "keep", "keys", "left")
    held = mine.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("key").alias(cut), F.collect_set(F.when(F.col("first") == F.col("doc_id"), F.col("key"))).alias(keep))
    rows = docs.join(held, docs["doc_id"].eqNullSafe(held[of]), "left")
    parts = F.split("text", "\n", -1)
    pairs = F.arrays_zip(parts.alias("line"), F.col(keys).alias("key"))

    def stays(p: Column, i: Column) -> Column:
        first_here = F.array_position(F.col(keys), p["key"]) == i + 1
        return ~F.array_contains(cut, p["key"]) | (F.array_contains(keep, p["key"]) & first_here)

    rows = rows.withColumn(keys, F.when(F.col(cut).isNotNull(), F.transform(parts, line_key)))
    rows = rows.withColumn(left, F.when(F.col(cut).isNotNull(), F.transform(F.filter(pairs, stays), lambda p: p["line"])))
    text = F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    out = {"text": text}
    if counts:
        total = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
        out |= {"n_lines": total, "n_removed": F.when(F.col(left).isNotNull(), total - F.size(left)).otherwise(F.lit(0)).cast("long")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(left).isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars").cast("long"))
    return rows.withColumns(out).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*docs.columns, *(["n_lines", "n_removed"] if counts else [])])])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_boilerplate(documents(spark, sf_dir), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "text")


ORACLE = {
    "op8_line_dedup": f"""
with parts as (
  select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
  from documents),
found as (
  select trim(line) as k, min(doc_id) as first_doc from parts where trim(line) <> ''
  group by 1 having count(distinct source) >= {SITES}),
marked as (
  select p.doc_id, p.line, p.i, f.k is not null and not (f.first_doc = p.doc_id
         and row_number() over (partition by p.doc_id, trim(p.line) order by p.i) = 1) as cut
  from parts p left join found f on trim(p.line) = f.k),
rejoined as (
  select doc_id, count(*) as n_lines, count(*) filter (where cut) as n_removed,
         coalesce(string_agg(line, chr(10) order by i) filter (where not cut), '') as text
  from marked group by doc_id)
select doc_id, n_lines, n_removed, md5(text) as text_md5, text from rejoined
""",
}
