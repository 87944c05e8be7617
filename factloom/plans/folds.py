"""Queries of repairs and of the operators that remain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import geometry as geo
from factloom.operators import graph as g
from factloom.operators import ledger as l
from factloom.operators import matching as m
from factloom.operators import repairs as r
from factloom.plans.catalog import query
from factloom.sources.derived import prefix

_B, _U, _R, _L, _UE = prefix("blocks"), prefix("units"), prefix("registry"), prefix("log"), prefix("units", "edges")


@query("s2_1_24_material_parse")
def _(t):
    """Visible text atoms of pages as blocks with scope and evidence; a parser, so no SQL."""
    from factloom.sources.html import nodes

    rows = nodes(t.pages).where("not hidden and text <> ''")
    kind = F.when(F.col("tag").rlike("^h[1-6]$"), "heading").when(F.col("tag") == "li", "list").when(F.col("tag").isin("td", "th"), "table").otherwise("paragraph")
    return rows.select("page_id", "node", kind.alias("kind"), "text", F.col("path").alias("evidence"), F.substring(F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "path"), 256), 1, 32).alias("scope"))


@query("s2_2_10_governance_export", _R + "select source_id, content_hash from registry where last_success_at > date '2024-06-01' or content_change = 'CHANGED'")
def _(t):
    return t.registry.where("last_success_at > date '2024-06-01' or content_change = 'CHANGED'").select("source_id", "content_hash")


@query("s2_3_22_hierarchy_overlay", _U + "select id, case when id % 11 = 0 then id + 1 else floor(id / 2)::bigint end as parent, id % 11 = 0 as edited from units")
def _(t):
    edited = F.col("id") % 11 == 0
    return t.units.select("id", F.when(edited, F.col("id") + 1).otherwise(F.floor(F.col("id") / 2)).alias("parent"), edited.alias("edited"))


def _flow(t):
    b = t.blocks
    demand = b.where("kind <> 'table'").select("document_id", F.col("id").alias("d"), F.col("level").alias("need"))
    supply = b.where("kind = 'table'").select("document_id", F.col("id").alias("s"), F.col("level").alias("have"))
    near = demand.join(supply, "document_id").where((F.col("d") + F.col("s")) % 2 == 0).select("document_id", "d", "s")
    return demand, supply, near


@query("s2_4_18_maximum_flow")
def _(t):
    """Token demand against supply under reach: a largest flow per document, so no SQL."""
    return m.shortfalls(*_flow(t), ["document_id"])


@query("s2_4_27_template_review", _B + "select id, case when kind = 'heading' and coalesce(lead(kind) over w, '') <> 'paragraph' then 'no_body' when kind = 'paragraph' and text not like '%.' then 'punctuation' when kind = 'table' and lead(kind) over w = 'table' and lead(level) over w <> level then 'columns' else 'ok' end as verdict from blocks window w as (partition by document_id order by seq)")
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq")
    k, nxt = F.col("kind"), F.lead("kind").over(w)
    v = F.when((k == "heading") & (F.coalesce(nxt, F.lit("")) != "paragraph"), "no_body").when((k == "paragraph") & ~F.col("text").endswith("."), "punctuation").when((k == "table") & (nxt == "table") & (F.lead("level").over(w) != F.col("level")), "columns").otherwise("ok")
    return t.blocks.select("id", v.alias("verdict"))


@query("s2_4_28_region_repair", _B + "select id from blocks a where kind <> 'table' and not exists (select 1 from blocks b where b.kind = 'table' and b.document_id = a.document_id and b.page_index = a.page_index and least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0) union all select id from blocks where kind = 'table'")
def _(t):
    tables = t.blocks.where("kind = 'table'")
    others = t.blocks.where("kind <> 'table'")
    hit = geo.overlap_join(others, tables, ["document_id", "page_index"]).select(F.col("a.id").alias("id"))
    return others.join(hit, "id", "left_anti").select("id").unionByName(tables.select("id"))


@query("s2_4_29_region_text", _B + ", p as (select r.id as region, w.id, w.text, w.y0, w.x0 from blocks r join blocks w on r.document_id = w.document_id and r.page_index = w.page_index and (w.x0 + w.x1) / 2 between r.x0 - 50 and r.x1 + 50 where r.kind = 'heading') select region, string_agg(text, ' ' order by y0, x0, id) as text from p group by 1")
def _(t):
    reg, w = t.blocks.where("kind = 'heading'").alias("r"), t.blocks.alias("w")
    middle = (F.col("w.x0") + F.col("w.x1")) / 2
    on = (F.col("r.document_id") == F.col("w.document_id")) & (F.col("r.page_index") == F.col("w.page_index")) & middle.between(F.col("r.x0") - 50, F.col("r.x1") + 50)
    rows = reg.join(w, on).select(F.col("r.id").alias("region"), F.struct("w.y0", "w.x0", "w.id", "w.text").alias("s"))
    return rows.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), " ").alias("text"))


@query("s2_5_30_gold_integrity", "select 'duplicate' as issue, count(*) as n from (select doc_id from labels group by 1 having count(*) > 1) union all select 'domain', count(*) from labels where quality not in (0, 1) or toxic not in (0, 1) union all select 'orphan', count(*) from labels where doc_id not in (select doc_id from documents) union all select 'length', count(*) from documents where n_chars <> length(text)")
def _(t):
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    out = count("duplicate", t.labels.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1"))
    out = out.unionByName(count("domain", t.labels.where("quality not in (0, 1) or toxic not in (0, 1)")))
    out = out.unionByName(count("orphan", t.labels.join(t.documents.select("doc_id"), "doc_id", "left_anti")))
    return out.unionByName(count("length", t.documents.where(F.col("n_chars") != F.char_length("text"))))


_JOINED = _B + """, b as (select document_id // 50 as document_id, row_number() over (partition by document_id // 50 order by document_id, seq) as n, id, kind, page_index, x0, x1, 1 + id % 2 as level, text from blocks),
 t as (select *, row_number() over (partition by document_id order by n) as k from b where kind = 'table'),
 f as (with recursive f as (select document_id, k, id, id as head, page_index as page, x0, x1, level from t where k = 1 union all
  select t.document_id, t.k, t.id, case when g then f.head else t.id end, t.page_index, case when g then f.x0 else t.x0 end, case when g then f.x1 else t.x1 end, case when g then f.level else t.level end from (select f.*, t.k as nk, f.page <> t.page_index
   and 0.4::double * greatest(0.0::double, 1.0::double - abs(f.x0 - t.x0) / 250.0::double) + 0.3::double * (least(f.x1 - f.x0, t.x1 - t.x0) / greatest(f.x1 - f.x0, t.x1 - t.x0, 1e-9)) + 0.3::double * (f.level = t.level)::int >= 0.88::double as g from f join t on t.document_id = f.document_id and t.k = f.k + 1) f join t on t.document_id = f.document_id and t.k = f.nk) select * from f),
 j as (select b.*, coalesce(f.head, b.id) as head from b left join f using (id)), w as (select document_id, head as id, min(n) as n, string_agg(text, chr(10) order by n) as text, arg_min(kind, n) as kind from j group by 1, 2)
 select document_id, id, cast(row_number() over (partition by document_id order by n) - 1 as int) as place, kind, text from w"""


@query("s2_6_3_cross_page_tables", _JOINED)
def _(t):
    """Tables that go on over pages joined, in documents of about two hundred blocks; what is joined is compared again."""
    n = F.row_number().over(Window.partitionBy(F.floor(F.col("document_id") / 50)).orderBy("document_id", "seq"))
    b = t.blocks.withColumn("seq", n).withColumn("document_id", F.floor(F.col("document_id") / 50)).withColumn("level", (1 + F.col("id") % 2).cast("int"))
    return r.repaired(b, [r.cross_page_tables]).select("document_id", "id", "place", "kind", "text")


@query("s2_6_9_local_inversions")
def _(t):
    """Blocks moved back over those below them; sequential, so no SQL."""
    return r.repaired(t.blocks, [r.local_inversions])


@query("s2_6_11_anchored_inserts")
def _(t):
    """Recovered blocks put beside their anchors; each insertion changes the next, so no SQL."""
    return r.repaired(t.blocks, [r.anchored_inserts])


@query("s2_9_17_template_families", _B + """, h as (select *, last_value(case when kind = 'heading' then level end ignore nulls) over (partition by document_id order by seq) as l from blocks)
 select id, cast(seq - 1 as int) as place, coalesce(case l when 1 then 'numbered' when 2 then 'table' when 3 then 'list' end, 'plain') || '/' || kind as kind from h""")  # fmt: skip
def _(t):
    return r.repaired(t.blocks, [r.template_family]).select("id", "place", "kind")


@query("s2_8_16_merged_cells")
def _(t):
    """Cells of each document's grid joined where rules are missing; components of small grids, so no SQL."""

    def joined(batches):
        for pdf in batches:
            rows = []
            for document, cells in zip(pdf["document_id"], pdf["cells"], strict=True):
                at = [(int(c["row"]), int(c["col"])) for c in cells]
                right = {(int(c["row"]), int(c["col"])) for c in cells if c["open"] == 0}
                below = {(int(c["row"]), int(c["col"])) for c in cells if c["open"] == 1}
                rows += [(document, *x) for x in r.rectangles(at, right, below)]
            yield pd.DataFrame(rows, columns=["document_id", "row", "column", "rows", "columns", "whole"])

    cell = F.struct(F.floor((F.col("seq") - 1) / 3).cast("int").alias("row"), ((F.col("seq") - 1) % 3).cast("int").alias("col"), (F.col("id") % 4).alias("open"))
    return t.blocks.groupBy("document_id").agg(F.collect_list(cell).alias("cells")).mapInPandas(joined, "document_id long, row int, column int, rows int, columns int, whole boolean")


@query("s2_8_17_tree_flattening", "select r_regionkey as owner, 'group' as relation, 'n' || n_nationkey as target, '0.' || (row_number() over (partition by n_regionkey order by n_nationkey) - 1) as path, 1 as low, 2 as high from nation join region on n_regionkey = r_regionkey union all select n_nationkey, 'leaf', 'x' || n_nationkey, '0.' || (row_number() over (partition by n_regionkey order by n_nationkey) - 1) || '.0', 1, 1 from nation")
def _(t):
    def flat(batches):
        for pdf in batches:
            rows = []
            for region, nations in zip(pdf["n_regionkey"], pdf["nations"], strict=True):
                tree = {"id": int(region), "quantity": (1, 2), "items": [{"id": f"n{n}", "items": [{"id": f"x{n}"}]} for n in nations]}
                rows += [(int(str(o).lstrip("n")), *x) for o, *x in r.flattened(tree)]
            yield pd.DataFrame(rows, columns=["owner", "relation", "target", "path", "low", "high"])

    trees = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("nations"))
    return trees.mapInPandas(flat, "owner int, relation string, target string, path string, low int, high int")


@query("s2_8_22_closed_input_set", _UE + ", tree as (select distinct unit_id as src, dependency_id as dst from edges), s as (with recursive c(id) as (select id from units where id % 501 = 3 union select tree.dst from c join tree on tree.src = c.id) select id from c) select s.id, coalesce(u.status = 'accepted', false) as confirmed from s left join units u using (id)")
def _(t):
    tree = t.edges.select(F.col("unit_id").alias("src"), F.col("dependency_id").alias("dst")).distinct()
    whole = g.reach(t.units.where("id % 501 = 3").select("id"), tree, "out")
    return whole.join(t.units.select("id", "status"), "id", "left").select("id", F.coalesce(F.col("status") == "accepted", F.lit(False)).alias("confirmed"))


@query("s2_8_27_collaboration_preview", "with b as (select p_partkey as k, p_brand as v from part), c as (select k, case when k % 4 = 0 then v || 'c' else v end as v from b), i as (select k, case when k % 6 = 0 then v || 'i' else v end as v from b), j as (select k, case when c.v = i.v then 'same' when b.v = i.v then 'auto_current' when b.v = c.v then 'auto_incoming' else 'conflict' end as outcome, c.v as cv, i.v as iv from b join c using (k) join i using (k)) select k, outcome, case when outcome = 'auto_incoming' or (outcome = 'conflict' and k % 24 = 0) then iv else cv end as value, outcome <> 'conflict' or k % 24 = 0 as resolved from j")
def _(t):
    base = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("value"))
    mark = lambda n, c: base.select("k", F.when(F.col("k") % n == 0, F.concat("value", F.lit(c))).otherwise(F.col("value")).alias("value"))
    incoming = mark(6, "i")
    merged = g.merge3(base, mark(4, "c"), incoming, ["k"])
    decided = merged.join(incoming.select("k", F.col("value").alias("iv")), "k").withColumn("chosen", (F.col("outcome") == "conflict") & (F.col("k") % 24 == 0))
    return decided.select("k", "outcome", F.when(F.col("chosen"), F.col("iv")).otherwise(F.col("value")).alias("value"), ((F.col("outcome") != "conflict") | F.col("chosen")).alias("resolved"))


@query("s2_8_28_direct_references", _UE + ", tree as (select distinct unit_id as src, dependency_id as dst from edges) select src, dst, sha256(src || ':' || dst) as fingerprint, src % 5 <> dst % 5 as stale from tree")
def _(t):
    tree = t.edges.select(F.col("unit_id").alias("src"), F.col("dependency_id").alias("dst")).distinct()
    return tree.select("src", "dst", F.sha2(F.concat_ws(":", F.col("src").cast("string"), F.col("dst").cast("string")), 256).alias("fingerprint"), (F.col("src") % 5 != F.col("dst") % 5).alias("stale"))


@query("s2_9_16_canonicalisation", _B + "select id, case kind when 'paragraph' then 'normative' when 'heading' then 'title' else 'support' end as role, case when text like '%shall not%' then 'prohibition' when text like '%must%' then 'obligation' else 'other' end as modality, level / 3.0 as confidence, case when level = 3 and kind = 'paragraph' then 'accepted' else 'review' end as status from blocks")
def _(t):
    x, k = F.col("text"), F.col("kind")
    return t.blocks.select("id", F.when(k == "paragraph", "normative").when(k == "heading", "title").otherwise("support").alias("role"), F.when(x.contains("shall not"), "prohibition").when(x.contains("must"), "obligation").otherwise("other").alias("modality"), (F.col("level") / 3.0).alias("confidence"), F.when((F.col("level") == 3) & (k == "paragraph"), "accepted").otherwise("review").alias("status"))


@query("s2_10_17_task_ledgers", _L + "select item, kind, count(*) as entries, arg_max(state, seq) as head from log group by 1, 2")
def _(t):
    return t.log.groupBy("item", "kind").agg(F.count("*").alias("entries"), F.max_by("state", "seq").alias("head"))


@query("s2_10_21_peer_sync", "with a as (select event_id as seq, user_id as item, value from events where event_id % 3 <> 0), b as (select event_id as seq, user_id as item, value from events where event_id % 2 = 0), u as (select * from a union select * from b) select item, max(seq) as revision, arg_max(value, seq) as value from u group by 1")
def _(t):
    e = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("item"), "value")
    both = e.where("seq % 3 <> 0").union(e.where("seq % 2 = 0")).dropDuplicates(["seq"])
    return l.heads(both, "item", ["seq"]).select("item", F.col("seq").alias("revision"), "value")


@query("s2_10_23_decision_application", _B + ", d as (select l_orderkey as document_id, max(l_linenumber) as last, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) as decision from lineitem group by 1) select id, case when seq <= last and decision = 'R' then 'withdrawn' when decision = 'A' then 'edited' else 'kept' end as outcome from blocks join d using (document_id)")
def _(t):
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.max("l_linenumber").alias("last"), F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("decision"))
    c = F.when((F.col("seq") <= F.col("last")) & (F.col("decision") == "R"), "withdrawn").when(F.col("decision") == "A", "edited").otherwise("kept")
    return t.blocks.join(d, "document_id").select("id", c.alias("outcome"))


