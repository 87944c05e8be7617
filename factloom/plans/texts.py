"""Queries of pages, workbooks, sentences and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import semantics as sem
from factloom.operators import delivery as d
from factloom.operators import ordered as o
from factloom.plans.catalog import query
from factloom.sources import html
from factloom.sources.derived import prefix

_B, _R, _U = prefix("blocks"), prefix("registry"), prefix("units")


@query("s2_1_6_html_nodes")
def _(t):
    """Elements of pages with paths and sections; a parser, so no SQL."""
    return html.nodes(t.pages)


@query("s2_1_6_html_links", "select page_id, 'a' as tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<a[ >]')) from pages) group by 1")
def _(t):
    return html.nodes(t.pages).where("tag = 'a'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("s2_1_6_html_headings", """select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) as title from pages where regexp_matches(html, '(?s)<h1[^>]*>.*?</h1>')""")
def _(t):
    """The first heading of each page, as the parser reads it."""
    return html.nodes(t.pages).where("tag = 'h1'").groupBy("page_id").agg(F.min_by("text", "node").alias("title"))


@query("s2_1_9_table_geometry")
def _(t):
    """Cells of a table laid out beside those that reach down from the rows above; an occupancy grid per table, so no SQL."""

    def laid(batches):
        for pdf in batches:
            out = []
            for document, cells in zip(pdf["document_id"], pdf["cells"], strict=True):
                rows = 1 + max(c["row"] for c in cells)
                placed, _ = html.grid([(c["row"], c["id"], c["down"], c["across"]) for c in cells], rows)
                out += [(document, *p) for p in placed]
            yield pd.DataFrame(out, columns=["document_id", "id", "row", "column", "down", "across"])

    cell = F.struct((F.floor((F.col("seq") - 1) / 2)).cast("int").alias("row"), "id", (F.col("level") % 3).cast("int").alias("down"), F.when(F.col("level") == 2, 2).otherwise(1).alias("across"))
    tables = t.blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return tables.mapInPandas(laid, "document_id long, id long, row int, column int, down int, across int")


@query("s2_1_20_content_validation", "select page_id, case when length(html) < 500 then 'size' when not starts_with(html, '<!DOCTYPE html') then 'signature' when contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'of the') then 'blocked_title' else 'ok' end as verdict from pages")
def _(t):
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)", 1))
    return t.pages.select("page_id", F.when(F.length("html") < 500, "size").when(~F.col("html").startswith("<!DOCTYPE html"), "signature").when(title.contains("of the"), "blocked_title").otherwise("ok").alias("verdict"))


@query("s2_1_21_package_read", "select page_id, case when page_id % 11 = 0 then 'unlisted' when page_id % 7 = 0 then 'changed' else 'ok' end as verdict from pages union all select -1, 'missing'")
def _(t):
    body = t.pages.select("page_id", F.sha2("html", 256).alias("sha256"))
    manifest = t.pages.where("page_id % 11 <> 0").select("page_id", F.when(F.col("page_id") % 7 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("sha256"))
    return d.verified(body, manifest.unionByName(t.spark.sql("select -1L as page_id, 'x' as sha256")), "page_id")


@query("s2_1_25_metadata_suggestion", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) as lang, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


# ---- sentences


def _part(t, name):
    return t.blocks.select("id", sem.part(name, F.col("text")).alias("a"))


@query("s2_9_6_language_cues", _B + """, c as (select id, 2.0 * len(regexp_extract_all(lower(text), '\\b(shall|must|should|unless)\\b')) + 1.0 * len(regexp_extract_all(lower(text), '\\bmay\\b')) + 0.75 * len(regexp_extract_all(lower(text), '\\b(not|no|if|when|where|after|except)\\b')) + 0.25 * len(regexp_extract_all(lower(text), '\\b(the|and|or)\\b')) as en from blocks)
 select id, en::double as english, en < 2 as ambiguous from c""")  # fmt: skip
def _(t):
    return _part(t, "language").select("id", "a.english", "a.ambiguous")


@query("s2_9_7_modality_spans", _B + """, m as (select id, text, regexp_extract(text, '(shall not|must|may|should)', 1) as w from blocks) select id, cast(strpos(text, w) - 1 as int) as start, cast(strpos(text, w) - 1 + length(w) as int) as "end",
 case w when 'shall not' then 'prohibition' when 'must' then 'obligation' when 'may' then 'permission' else 'recommendation' end as kind from m where w <> ''""")  # fmt: skip
def _(t):
    return _part(t, "modalities").select("id", F.explode("a").alias("m")).select("id", "m.start", "m.end", "m.kind")


@query("s2_9_8_negation_spans", _B + "select id, cast(strpos(text, ' not ') as int) as start, cast(strpos(text, ' not ') + 3 as int) as \"end\", cast(length(text) - 1 as int) as scope_end from blocks where contains(text, ' not ')")
def _(t):
    return _part(t, "negations").select("id", F.explode("a").alias("m")).select("id", "m.start", "m.end", "m.scope_end")


@query("s2_9_9_conditions", "select p_partkey, 'condition' as kind, 'if ' || lower(p_brand) || ' is ready' as text from part union all select p_partkey, 'exception', 'unless size exceeds ' || p_size from part where p_partkey % 2 = 0")
def _(t):
    extra = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", unless size exceeds "), F.col("p_size").cast("string"))).otherwise(F.lit(""))
    s = F.concat(F.lit("The operator must act if "), F.lower("p_brand"), F.lit(" is ready"), extra, F.lit("."))
    return t.part.select("p_partkey", F.explode(sem.part("contexts", s)).alias("c")).select("p_partkey", "c.kind", "c.text")


@query("s2_9_10_thresholds", _B + """select id, 'gte' as operator, cast(regexp_extract(text, 'at least (\\d+)', 1) as double) as value, 'kg' as unit from blocks union all select id, 'lte', cast(regexp_extract(text, 'within (\\d+)', 1) as double), 'days' from blocks""")
def _(t):
    return _part(t, "thresholds").select("id", F.explode("a").alias("m")).select("id", "m.operator", "m.value", "m.unit")


@query("s2_9_13_semantic_bundle", _B + "select id, 2 as thresholds, case when text like '%will%' then 0 else 1 end as modalities, case when text like '%not%' then 1 else 0 end as negations from blocks")
def _(t):
    return t.blocks.select("id", sem.analysed(F.col("text")).alias("a")).select("id", *[F.size(f"a.{k}").alias(k) for k in ("thresholds", "modalities", "negations")])


@query("s2_9_14_clause_lists", "select p_partkey, m as mark, case m when 'a' then lower(p_brand) when 'b' then lower(p_type) else 'size ' || p_size end as text from (select *, unnest(['a', 'b', 'c']) as m from part)")
def _(t):
    s = F.concat(F.lit("The file must hold: (a) "), F.lower("p_brand"), F.lit("; (b) "), F.lower("p_type"), F.lit("; (c) size "), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.explode(sem.part("clauses", s)).alias("c")).select("p_partkey", "c.mark", "c.text")


@query("s2_9_3_token_scan", _B + ", k as (select id, unnest(regexp_extract_all(lower(text), '[0-9]+|[a-z]+')) as token from blocks) select token, count(*) as n from k group by 1")
def _(t):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def scan(s: pd.Series) -> pd.Series:
        return pd.Series([sem.tokens(v or "") for v in s], dtype=object)

    return t.blocks.select(F.explode(scan(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("s2_9_23_safe_repair", "select p_partkey, 'ship 1.' || (p_size % 10) || ' tonnes of ' || case when p_partkey % 2 = 0 then 'cargo' else 'car- go' end as text from part")
def _(t):
    @F.pandas_udf(T.StringType())
    def fix(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sem.repaired(p, q) for p, q in zip(a, b, strict=True)])

    size = (F.col("p_size") % 10).cast("string")
    broken = F.concat(F.lit("ship 1 ."), size, F.lit(" tonnes of car- go"))
    witness = F.concat(F.lit("ship 1."), size, F.lit(" tonnes of "), F.when(F.col("p_partkey") % 2 == 0, "cargo").otherwise("wood"))
    return t.part.select("p_partkey", fix(broken, witness).alias("text"))


@query("s2_9_19_record_mapping", _B + "select document_id, count(*) filter (where kind = 'paragraph') as mapped, count(*) filter (where kind <> 'paragraph') as residual, count(*) - count(distinct text) > 0 as repeated from blocks group by 1")
def _(t):
    p = F.col("kind") == "paragraph"
    return t.blocks.groupBy("document_id").agg(F.count_if(p).alias("mapped"), F.count_if(~p).alias("residual"), (F.count("*") - F.countDistinct("text") > 0).alias("repeated"))


@query("s2_9_32_word_diff", "select p_partkey, p_name <> p_type as changed, len(list_filter(string_split(p_name, ' '), lambda w: not list_contains(string_split(p_type, ' '), w))) as removed, len(list_filter(string_split(p_type, ' '), lambda w: not list_contains(string_split(p_name, ' '), w))) as added from part")
def _(t):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return t.part.select("p_partkey", (F.col("p_name") != F.col("p_type")).alias("changed"), F.size(F.filter(a, lambda w: ~F.array_contains(b, w))).cast("long").alias("removed"), F.size(F.filter(b, lambda w: ~F.array_contains(a, w))).cast("long").alias("added"))


# ---- folds over text


@query("s2_6_2_paragraph_merge", _B + """, f as (with recursive f as (select document_id, seq, id, id as head, page_index as page, x0, y0 from blocks where seq = 1 union all
  select b.document_id, b.seq, b.id, case when g then f.head else b.id end, case when g then f.page else b.page_index end, case when g then f.x0 else b.x0 end, case when g then f.y0 else b.y0 end
  from (select f.*, b.seq as next, 0.4::double * (f.page = b.page_index)::int + 0.3::double * greatest(0.0::double, 1.0::double - abs(f.x0 - b.x0) / 200.0::double) + 0.3::double * case when b.y0 >= f.y0 then 1.0::double else 0.4::double end >= 0.82::double as g
   from f join blocks b on b.document_id = f.document_id and b.seq = f.seq + 1) f join blocks b on b.document_id = f.document_id and b.seq = f.next) select * from f)
 select f.document_id, head as id, cast(count(*) as int) as n, string_agg(b.text, ' ' order by f.seq) as text from f join blocks b using (id) group by 1, 2""")  # fmt: skip
def _(t):
    """Paragraphs joined to the one before where their boxes and text fit; a merged block is compared again."""

    def merged(batches):
        for pdf in batches:
            out = []
            for document, items in zip(pdf["document_id"], pdf["items"], strict=True):
                held = None
                for b in items:
                    b = b.asDict() if hasattr(b, "asDict") else dict(b)
                    if held is not None and joined_score(held, b) >= 0.82:
                        held["text"] = joined_text(held["text"], b["text"])
                        held |= {"n": held["n"] + 1, "y1": max(held["y1"], b["y1"]), "x1": max(held["x1"], b["x1"])}
                    else:
                        if held is not None:
                            out.append((document, held["id"], held["n"], held["text"]))
                        held = b | {"n": 1}
                out.append((document, held["id"], held["n"], held["text"]))
            yield pd.DataFrame(out, columns=["document_id", "id", "n", "text"])

    item = F.struct("seq", "id", "kind", "page_index", "x0", "y0", "x1", "y1", "text")
    docs = t.blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return docs.mapInPandas(merged, "document_id long, id long, n int, text string")


def joined_score(a: dict, b: dict) -> float:
    """How well block b goes on block a: same page, near left edges, order of lines."""
    left = max(0.0, 1 - abs(a["x0"] - b["x0"]) / 200)
    below = 1.0 if b["y0"] >= a["y0"] else 0.4
    return 0.4 * (a["page_index"] == b["page_index"]) + 0.3 * left + 0.3 * below


def joined_text(a: str, b: str) -> str:
    """Two lines as one: a hyphen at the end goes unless its word holds another or is part of a link."""
    last = a.rsplit(" ", 1)[-1]
    if a.endswith("-") and last.count("-") == 1 and "://" not in last:
        return a[:-1] + b
    return f"{a}{'' if a.endswith('-') else ' '}{b}"


@query("s2_6_12_line_clusters", _B + """, s as (select *, max(y1) over (partition by document_id, page_index order by y0, id rows between unbounded preceding and 1 preceding) as reach from blocks), g as (select *, sum(case when reach is null or y0 > reach then 1 else 0 end) over (partition by document_id, page_index order by y0, id rows unbounded preceding) as line from s)
 select document_id, page_index, line, count(*) as words, min(x0) as x0, max(x1) as x1 from g group by 1, 2, 3""", whole=("line",))  # fmt: skip
def _(t):
    w = Window.partitionBy("document_id", "page_index").orderBy("y0", "id")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = o.runs(t.blocks.withColumn("reach", reach), ["document_id", "page_index"], ["y0", "id"], F.col("y0") > F.col("reach"), "line")
    return g.groupBy("document_id", "page_index", "line").agg(F.count("*").alias("words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


# ---- exports


@query("s2_2_2_jsonl_export", _B + "select id, '{\"id\":' || id || ',\"kind\":\"' || kind || '\",\"text\":\"' || text || '\"}' as line from blocks")
def _(t):
    return t.blocks.select("id", F.to_json(F.struct("id", "kind", "text")).alias("line"))


@query("s2_2_4_markdown_export", _B + "select document_id, string_agg(case kind when 'heading' then repeat('#', level) || ' ' || text when 'list' then '- ' || text when 'table' then '| ' || replace(text, '|', '\\|') || ' |' else text end, chr(10) || chr(10) order by seq) as markdown from blocks group by 1")
def _(t):
    return d.markdown(t.blocks, "document_id", "seq")


def _facts(t):
    modal = F.nullif(F.regexp_extract("text", "(must|shall not|may|should)", 1), F.lit(""))
    return d.triples(t.blocks, "id", {"modality": modal, "sourceSegment": F.col("document_id"), "sourcePage": F.when(F.col("page_index") > 0, F.col("page_index"))})


_TRIPLES = _B + """, facts as (select cast(id as varchar) as s, 'modality' as p, nullif(regexp_extract(text, '(must|shall not|may|should)', 1), '') as o from blocks
 union all select cast(id as varchar), 'sourceSegment', cast(document_id as varchar) from blocks union all select cast(id as varchar), 'sourcePage', case when page_index > 0 then cast(page_index as varchar) end from blocks), f as (select * from facts where o is not null)"""


@query("s2_2_6_triples", _TRIPLES + " select s, p, o from f")
def _(t):
    return _facts(t)


