"""Queries of joins and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import geometry as geo
from factloom.operators.matching import maximum_matching, nearest_one_to_one
from factloom.plans.catalog import query
from factloom.sources.derived import prefix

_U, _B, _UE = prefix("units"), prefix("blocks"), prefix("units", "edges")


@query("s2_4_1_orphans", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("s2_4_2_stale_versions", "with p as (select o_orderkey, count(*) as lines from orders join lineitem on o_orderkey = l_orderkey group by 1) select o.o_orderkey, p.lines is null as missing from orders o left join p using (o_orderkey) where p.lines is null or p.lines < o.o_orderkey % 5")
def _(t):
    p = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("lines"))
    return t.orders.join(p, "o_orderkey", "left").where("lines is null or lines < o_orderkey % 5").select("o_orderkey", F.col("lines").isNull().alias("missing"))


@query("s2_4_3_anti_join_backfill", "select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def _(t):
    return t.lineitem.join(t.part.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_partkey").distinct()


@query("s2_4_4_references_by_page", _B + "select document_id, id, page_index, r as ref from (select *, unnest([page_index, page_index + 1]) as r from blocks)")
def _(t):
    return t.blocks.select("document_id", "id", "page_index", F.explode(F.array("page_index", F.col("page_index") + 1)).alias("ref"))


@query("s2_4_5_exists_over_array", _B + "select document_id, count(*) as n from (select document_id, list(distinct page_index) as pages from blocks group by 1) where list_has_any(pages, [0, 2]) group by 1")
def _(t):
    pages = t.blocks.groupBy("document_id").agg(F.collect_set("page_index").alias("pages"))
    return pages.where(F.exists("pages", lambda p: p.isin(0, 2))).groupBy("document_id").agg(F.count("*").alias("n"))


@query("s2_4_6_upsert", """with old as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 3 <> 0), new as (select o_orderkey as k, o_totalprice * 2 as v from orders where o_orderkey % 2 = 0)
 select coalesce(new.k, old.k) as k, coalesce(new.v, old.v) as v, case when old.k is null then 'insert' when new.k is null then 'keep' else 'update' end as op from old full join new on old.k = new.k""")  # fmt: skip
def _(t):
    old = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("ov"))
    new = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("nv"))
    op = F.when(F.col("ov").isNull(), "insert").when(F.col("nv").isNull(), "keep").otherwise("update")
    return old.join(new, "k", "full").select("k", F.coalesce("nv", "ov").alias("v"), op.alias("op"))


@query("s2_4_7_staging_reconcile", """with s as (select p_partkey as k, p_brand as h from part where p_partkey % 4 <> 0), l as (select p_partkey as k, case when p_partkey % 5 = 0 then 'x' else p_brand end as h, p_partkey % 7 = 0 as manual from part where p_partkey % 6 <> 0)
 select s.k, case when l.k is null then 'missing' when manual then 'manual_preserved' when l.h <> s.h then 'identity_changed' else 'synced' end as outcome from s left join l using (k)""")  # fmt: skip
def _(t):
    s = t.part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("h"))
    l = t.part.where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("k"), F.expr("case when p_partkey % 5 = 0 then 'x' else p_brand end").alias("lh"), F.expr("p_partkey % 7 = 0").alias("manual"))  # noqa: E741
    outcome = F.when(F.col("lh").isNull(), "missing").when(F.col("manual"), "manual_preserved").when(F.col("lh") != F.col("h"), "identity_changed").otherwise("synced")
    return s.join(l, "k", "left").select("k", outcome.alias("outcome"))


@query("s2_4_8_source_reconcile", "with c as (select p_partkey as k, p_size as v from part), d as (select p_partkey as k, p_size + case when p_partkey % 9 = 0 then 1 else 0 end as v from part where p_partkey % 10 <> 0) select c.k, d.k is null as added, c.v <> d.v as changed from c left join d using (k) where d.k is null or c.v <> d.v")
def _(t):
    c = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    d = t.part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("k"), F.expr("p_size + case when p_partkey % 9 = 0 then 1 else 0 end").alias("w"))
    return c.join(d, "k", "left").where("w is null or v <> w").select("k", F.col("w").isNull().alias("added"), (F.col("v") != F.col("w")).alias("changed"))


@query("s2_4_9_binding_integrity", """select 'line_without_order' as issue, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'order_without_customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
 union all select 'line_without_part', count(*) from lineitem where l_partkey not in (select p_partkey from part)""")  # fmt: skip
def _(t):
    def orphans(name, left, lk, right, rk):
        return left.join(right, left[lk] == right[rk], "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")

    return orphans("line_without_order", t.lineitem, "l_orderkey", t.orders, "o_orderkey").unionByName(orphans("order_without_customer", t.orders, "o_custkey", t.customer, "c_custkey")).unionByName(orphans("line_without_part", t.lineitem, "l_partkey", t.part, "p_partkey"))


_OVER = "least(a.x1, b.x1) - greatest(a.x0, b.x0) > {s} and least(a.y1, b.y1) - greatest(a.y0, b.y0) > {s}"
_IOU = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query("s2_4_10_box_overlap", _B + f"select a.id as a, b.id as b from blocks a join blocks b on a.document_id = b.document_id and a.page_index = b.page_index and a.id < b.id where {_OVER.format(s=-1)}")
def _(t):
    pairs = geo.overlap_join(t.blocks, t.blocks, ["document_id", "page_index"], slack=1.0)
    return pairs.where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("s2_4_11_point_in_box", _B + "select p.id as p, b.id as b from blocks p join blocks b on p.document_id = b.document_id and p.page_index = b.page_index and (p.x0 + p.x1) / 2 between b.x0 - 1 and b.x1 + 1 and (p.y0 + p.y1) / 2 between b.y0 - 1 and b.y1 + 1")
def _(t):
    points = t.blocks.select("id", "document_id", "page_index", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    return geo.point_join(points, t.blocks, ["document_id", "page_index"], slack=1.0).select(F.col("p.id").alias("p"), F.col("b.id").alias("b"))


@query("s2_4_12_locator_prefix", """with l as (select n_nationkey, 'r' || n_regionkey || ' > n' || n_nationkey as path from nation), s as (select 'r' || r_regionkey as path from region)
 select l.n_nationkey, s.path from l join s on l.path = s.path or starts_with(l.path, s.path || ' > ')""")  # fmt: skip
def _(t):
    l = t.nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit(" > n"), "n_nationkey").alias("path"))  # noqa: E741
    heads = l.select("n_nationkey", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", " > "))), lambda i: F.array_join(F.slice(F.split("path", " > "), F.lit(1), i), " > "))).alias("path"))
    return heads.join(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("path")), "path").select("n_nationkey", "path")


@query("s2_4_13_nearest_match", _B + """, a as (select document_id * 10 + page_index as k, id, x0, y0, seq as i, row_number() over (partition by document_id, page_index order by seq, id) as n from blocks),
 o as (select document_id * 10 + page_index as k, id as o_id, x0 + id % 7 as ox, y0 + id % 3 as oy, seq as oi from blocks), c as (select a.k, a.n, a.id, o.o_id, o.oi, abs(x0 - ox) + 2 * abs(y0 - oy) + 2 * abs(i - oi) as cost from a join o using (k)),
 f as (with recursive f as (select k, n, id, arg_min(o_id, (cost, oi, o_id)) as o_id, min(cost) as cost, [arg_min(o_id, (cost, oi, o_id))] as used from c where n = 1 group by 1, 2, 3 union all
  select c.k, c.n, c.id, arg_min(c.o_id, (c.cost, c.oi, c.o_id)), min(c.cost), list_append(f.used, arg_min(c.o_id, (c.cost, c.oi, c.o_id))) from f join c on c.k = f.k and c.n = f.n + 1 where not list_contains(f.used, c.o_id) group by c.k, c.n, c.id, f.used) select * from f)
 select id, o_id, cost::double as cost from f""")  # fmt: skip
def _(t):
    """Greedy nearest one-to-one match of tokens of two engines on a page: order decides, so a fold per page."""
    b = t.blocks.select("document_id", "page_index", "id", "x0", "y0", F.col("seq").alias("i"))
    other = b.select("document_id", "page_index", F.col("id").alias("o_id"), (F.col("x0") + F.col("id") % 7).alias("ox"), (F.col("y0") + F.col("id") % 3).alias("oy"), F.col("i").alias("oi"))
    return nearest_one_to_one(b, other, ["document_id", "page_index"])


@query("s2_4_14_nearest_heading", _B + "select id, (select max(h.seq) from blocks h where h.document_id = b.document_id and h.kind = 'heading' and h.seq <= b.seq) as heading from blocks b")
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return t.blocks.select("id", F.last(F.when(F.col("kind") == "heading", F.col("seq")), ignorenulls=True).over(w).alias("heading"))


@query("s2_4_15_reference_links", _B + """, m as (select id, document_id, 'list' as kind, seq - 1 as no from blocks where kind = 'table'), i as (select document_id, kind, seq as no, min(id) as target from blocks group by 1, 2, 3)
 select m.id, i.target from m left join i using (document_id, kind, no)""")  # fmt: skip
def _(t):
    m = t.blocks.where("kind = 'table'").select("id", "document_id", F.lit("list").alias("kind"), (F.col("seq") - 1).alias("no"))
    i = t.blocks.groupBy("document_id", "kind", F.col("seq").alias("no")).agg(F.min("id").alias("target"))
    return m.join(i, ["document_id", "kind", "no"], "left").select("id", "target")


@query("s2_4_16_sibling_link", _B + "select id, (select min(s.seq) from blocks s where s.document_id = b.document_id and s.kind = 'table' and s.seq > b.seq) as below, (select max(s.seq) from blocks s where s.document_id = b.document_id and s.kind = 'table' and s.seq < b.seq) as above from blocks b where kind = 'paragraph'")
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq")
    table = F.when(F.col("kind") == "table", F.col("seq"))
    out = t.blocks.select("id", "kind", F.first(table, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("below"), F.last(table, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    return out.where("kind = 'paragraph'").drop("kind")


@query("s2_4_17_footnote_join", _B + """, n as (select document_id, page_index, level as marker, min(id) as note, count(*) > 1 as disputed from blocks where kind = 'list' group by 1, 2, 3)
 select b.id, n.note, n.disputed from blocks b join n on b.document_id = n.document_id and b.page_index = n.page_index and b.level = n.marker where b.kind = 'paragraph'""")  # fmt: skip
def _(t):
    notes = t.blocks.where("kind = 'list'").groupBy("document_id", "page_index", "level").agg(F.min("id").alias("note"), (F.count("*") > 1).alias("disputed"))
    return t.blocks.where("kind = 'paragraph'").join(notes, ["document_id", "page_index", "level"]).select("id", "note", "disputed")


@query("s2_4_19_bipartite_matching")
def _(t):
    """Largest one-to-one match of headings to overlapping blocks per page: augmenting paths, so no SQL."""
    pairs = geo.overlap_join(t.blocks.where("kind = 'heading'"), t.blocks.where("kind <> 'heading'"), ["document_id", "page_index"])
    return maximum_matching(pairs.select(F.col("a.document_id").alias("document_id"), F.col("a.page_index").alias("page_index"), F.col("a.id").alias("left"), F.col("b.id").alias("right")), ["document_id", "page_index"])


@query("s2_4_20_gold_join", """with g as (select p_partkey as id, p_size as v from part where p_partkey % 5 <> 0), p as (select p_partkey as id, p_size + p_partkey % 2 as v from part where p_partkey % 4 <> 0)
 select case when g.id is null then 'extra' when p.id is null then 'missing' when g.v = p.v then 'equal' else 'different' end as outcome, count(*) as n from g full join p on g.id = p.id group by 1""")  # fmt: skip
def _(t):
    g = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("gv"))
    p = t.part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.col("p_partkey") % 2).alias("pv"))
    outcome = F.when(F.col("gv").isNull(), "extra").when(F.col("pv").isNull(), "missing").when(F.col("gv") == F.col("pv"), "equal").otherwise("different")
    return g.join(p, "id", "full").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("s2_4_21_order_inversions", _B + "select a.document_id, count(*) as inversions from blocks a join blocks b on a.document_id = b.document_id and a.page_index = b.page_index and a.seq < b.seq and a.y0 > b.y0 group by 1")
def _(t):
    a, b = t.blocks.alias("a"), t.blocks.alias("b")
    on = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.seq") < F.col("b.seq")) & (F.col("a.y0") > F.col("b.y0"))
    return a.join(b, on).groupBy(F.col("a.document_id").alias("document_id")).agg(F.count("*").alias("inversions"))


@query("s2_4_22_duplicate_regions", _B + f"select a.id as a, b.id as b from blocks a join blocks b on a.document_id = b.document_id and a.page_index = b.page_index and a.kind = b.kind and a.id < b.id where {_IOU} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU}) >= 0.2")
def _(t):
    pairs = geo.overlap_join(t.blocks, t.blocks, ["document_id", "page_index", "kind"])
    return pairs.where((F.col("a.id") < F.col("b.id")) & (geo.iou("a", "b") >= 0.2)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("s2_4_23_queue_enrichment", _U + """select u.id, c.c_mktsegment, n.n_name, k.lines from units u join customer c on u.document_id = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
 left join (select l_orderkey, count(*) as lines from lineitem group by 1) k on k.l_orderkey = u.id where u.status = 'pending' and c.c_custkey not in (select s_suppkey from supplier)""")  # fmt: skip
def _(t):
    k = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("lines"))
    rows = t.units.where("status = 'pending'").join(t.customer, F.col("document_id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left_anti").join(k, "id", "left").select("id", "c_mktsegment", "n_name", "lines")


@query("s2_4_24_coverage_edges", _B + "select a.id as unit, list(distinct b.id order by b.id)::varchar as checks from blocks a join blocks b on a.document_id = b.document_id and a.page_index = b.page_index and b.kind = 'table' where a.kind = 'paragraph' group by 1")
def _(t):
    a = t.blocks.where("kind = 'paragraph'").select("document_id", "page_index", F.col("id").alias("unit"))
    b = t.blocks.where("kind = 'table'").select("document_id", "page_index", F.col("id").alias("check"))
    ids = F.array_join(F.array_sort(F.collect_set("check")), ", ")
    return a.join(b, ["document_id", "page_index"]).groupBy("unit").agg(F.concat(F.lit("["), ids, F.lit("]")).alias("checks"))


@query("s2_4_25_unmapped_evidence", _B + "select id, 'mapped' as origin from blocks where kind in ('heading', 'paragraph') union all select id, 'residual' from blocks where kind not in ('heading', 'paragraph')")
def _(t):
    named = F.col("kind").isin("heading", "paragraph")
    return t.blocks.where(named).select("id", F.lit("mapped").alias("origin")).unionByName(t.blocks.where(~named).select("id", F.lit("residual").alias("origin")))


@query("s2_4_26_conflict_routing", _B + """, c as (select document_id, id from blocks where kind = 'table'), p as (select o_orderkey as document_id from orders where o_orderstatus = 'O')
 select document_id, list(distinct id order by id)::varchar as conflicts from c where document_id not in (select document_id from p) group by 1""")  # fmt: skip
def _(t):
    c = t.blocks.where("kind = 'table'")
    pending = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("document_id"))
    rows = c.join(pending, "document_id", "left_anti").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("c"))
    return rows.select("document_id", F.concat(F.lit("["), "c", F.lit("]")).alias("conflicts"))


@query("s2_4_31_span_clip", _B + """, s as (select document_id, id, (seq - 1) * 50 as a, seq * 50 as b from blocks), f as (select document_id, 30 as fa, 120 as fb from blocks where seq = 1)
 select s.id, greatest(a, fa) - a as start, least(b, fb) - a as "end" from s join f using (document_id) where a < fb and fa < b""")  # fmt: skip
def _(t):
    s = t.blocks.select("document_id", "id", ((F.col("seq") - 1) * 50).alias("a"), (F.col("seq") * 50).alias("b"))
    f = t.blocks.where("seq = 1").select("document_id", F.lit(30).alias("fa"), F.lit(120).alias("fb"))
    return s.join(f, "document_id").where("a < fb and fa < b").select("id", (F.greatest("a", "fa") - F.col("a")).alias("start"), (F.least("b", "fb") - F.col("a")).alias("end"))


@query("s2_4_32_staleness", prefix("registry") + "select m.p_partkey as id, r.source_status <> 'CURRENT' or r.content_hash <> sha256(cast(m.p_partkey % 690 as varchar)) as stale from part m join registry r on r.n = m.p_partkey")
def _(t):
    m = t.part.select(F.col("p_partkey").alias("n"), F.sha2((F.col("p_partkey") % 690).cast("string"), 256).alias("saved"))
    return m.join(t.registry, "n").select(F.col("n").alias("id"), ((F.col("source_status") != "CURRENT") | (F.col("content_hash") != F.col("saved"))).alias("stale"))


@query("s2_4_33_latest_legacy", _U + "select document_id, max(id) as latest, arg_max(status, (ordinal, id)) as status from units group by 1")
def _(t):
    return t.units.groupBy("document_id").agg(F.max("id").alias("latest"), F.max_by("status", F.struct("ordinal", "id")).alias("status"))


@query("s2_5_24_completeness", _B + "select document_id, count(*) as total, count(*) filter (where kind <> 'table') as assigned, count(*) - count(distinct text) as repeated, case when count(*) filter (where kind = 'table') = 0 then 'complete' else 'partial' end as status from blocks group by 1")
def _(t):
    return t.blocks.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("kind") != "table").alias("assigned"), (F.count("*") - F.countDistinct("text")).alias("repeated"), F.when(F.count_if(F.col("kind") == "table") == 0, "complete").otherwise("partial").alias("status"))
