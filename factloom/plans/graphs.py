"""Queries of ordered operators, spans and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import graph as g
from factloom.operators import ordered as o
from factloom.plans.catalog import query
from factloom.sources.derived import prefix

_U, _B, _L, _R = prefix("units"), prefix("blocks"), prefix("log"), prefix("registry")
_UE = prefix("units", "edges")
_TREE = _UE + ", tree as (select distinct unit_id as src, dependency_id as dst from edges)"


def _tree(t):
    return t.edges.select(F.col("unit_id").alias("src"), F.col("dependency_id").alias("dst")).distinct()


# ---- ordered

@query("s2_6_4_fragment_runs", _B + """, k as (select *, case when lag(kind) over w = kind and lag(page_index) over w = page_index then 0 else 1 end as new from blocks window w as (partition by document_id order by seq))
 , r as (select *, sum(new) over (partition by document_id order by seq) as run from k) select document_id, run, string_agg(text, ' ' order by seq) as text, count(*) as n from r group by 1, 2""", whole=("run",))  # fmt: skip
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq")
    breaks = ~((F.lag("kind").over(w) == F.col("kind")) & (F.lag("page_index").over(w) == F.col("page_index")))
    r = o.runs(t.blocks, ["document_id"], ["seq"], breaks)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    return r.groupBy("document_id", "run").agg(joined.alias("text"), F.count("*").alias("n"))


@query("s2_5_29_position_runs", _B + ", i as (select document_id, kind, seq, seq - row_number() over (partition by document_id, kind order by seq) as base from blocks) select document_id, kind, min(seq) as start, max(seq) as \"end\", count(*) as n from i group by document_id, kind, base")
def _(t):
    return o.islands(t.blocks, ["document_id", "kind"], "seq")


@query("s2_6_5_heading_paths", _B + """, h as (select b.id, k.level as k, (select arg_max((x.level, x.id), x.seq) from blocks x where x.document_id = b.document_id and x.kind = 'heading' and x.level <= k.level and x.seq <= b.seq) as top
 from blocks b cross join (values (1), (2), (3)) k(level)) select id, coalesce(string_agg(cast(top[2] as varchar), '/' order by k) filter (where top[1] = k), '') as path from h group by 1""")  # fmt: skip
def _(t):
    return o.heading_paths(t.blocks, "document_id", "seq", 3).select("id", "path")


@query("s2_6_6_list_nesting", _B + "select id, (select max(p.seq) from blocks p where p.document_id = b.document_id and p.seq < b.seq and p.level < b.level) as parent from blocks b")
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    below = {k: F.last(F.when(F.col("level") < k, F.col("seq")), ignorenulls=True).over(w) for k in (1, 2, 3)}
    return t.blocks.select("id", F.when(F.col("level") == 1, below[1]).when(F.col("level") == 2, below[2]).otherwise(below[3]).alias("parent"))


@query("s2_6_7_sibling_index", _B + "select id, row_number() over (partition by document_id, kind order by seq) - 1 as place from blocks")
def _(t):
    return t.blocks.select("id", (F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("seq")) - 1).alias("place"))


@query("s2_6_8_reading_order", _B + "select id, row_number() over (partition by document_id, page_index order by y0, x0, id) as place from blocks")
def _(t):
    return t.blocks.select("id", F.row_number().over(Window.partitionBy("document_id", "page_index").orderBy("y0", "x0", "id")).alias("place"))


@query("s2_6_13_fractional_order", _B + "select id, coalesce((seq + lag(seq) over w) / 2, seq - 1)::double as key from blocks where seq % 2 = 0 or seq = 1 window w as (partition by document_id order by seq)")
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq")
    return t.blocks.where("seq % 2 = 0 or seq = 1").select("id", F.coalesce((F.col("seq") + F.lag("seq").over(w)) / 2, F.col("seq") - 1).cast("double").alias("key"))


@query("s2_6_14_latest_row", _L + 'select item, arg_max(state, (log."at", seq)) as state, max(seq) as last from log group by 1')
def _(t):
    return t.log.groupBy("item").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("seq").alias("last"))


@query("s2_6_15_next_number", _R + "select substr(source_id, 1, 5) as prefix, max(cast(substr(source_id, 6) as int)) + 1 as next from registry group by 1 having max(cast(substr(source_id, 6) as int)) < 1000")
def _(t):
    n = F.max(F.substring("source_id", 6, 3).cast("int"))
    return t.registry.groupBy(F.substring("source_id", 1, 5).alias("prefix")).agg((n + 1).alias("next")).where("next <= 1000")


@query("s2_6_16_label_numbers", _B + "select id, upper(substr(kind, 1, 1)) || row_number() over (partition by document_id, kind order by x0, -x1, id) as label from blocks")
def _(t):
    n = F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("x0", -F.col("x1"), "id"))
    return t.blocks.select("id", F.concat(F.upper(F.substring("kind", 1, 1)), n.cast("string")).alias("label"))


def _spans(t):
    return t.blocks.select("document_id", F.col("x0").cast("long").alias("start"), F.col("x1").cast("long").alias("end"))


@query("s2_6_17_greedy_intervals", _B + """, s as (select document_id, cast(x0 as bigint) as a, cast(x1 as bigint) as b from blocks), n as (select *, row_number() over (partition by document_id order by a, a - b, b) as n from s), kept as (
 with recursive f as (select document_id, n, a, b, b as reach, true as kept from n where n = 1 union all
  select n.document_id, n.n, n.a, n.b, case when n.a >= f.reach then n.b else f.reach end, n.a >= f.reach from f join n on n.document_id = f.document_id and n.n = f.n + 1) select * from f)
 select document_id, a as start, b as "end" from kept where kept""")  # fmt: skip
def _(t):
    return o.greedy_intervals(_spans(t), "document_id")


@query("s2_6_18_row_offsets", _B + "select id, coalesce(sum(level) over (partition by document_id order by seq rows between unbounded preceding and 1 preceding), 0) as first_row from blocks where kind = 'table'", whole=("first_row",))
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return t.blocks.where("kind = 'table'").select("id", F.coalesce(F.sum("level").over(w), F.lit(0)).alias("first_row"))


@query("s2_6_19_next_sibling", _B + "select id, case when kind = 'paragraph' and lead(kind) over w = 'list' then 'subheading' when kind = 'paragraph' and lag(kind) over w = 'table' then 'caption' else kind end as kind from blocks window w as (partition by document_id order by seq)")
def _(t):
    w = Window.partitionBy("document_id").orderBy("seq")
    p = F.col("kind") == "paragraph"
    return t.blocks.select("id", F.when(p & (F.lead("kind").over(w) == "list"), "subheading").when(p & (F.lag("kind").over(w) == "table"), "caption").otherwise(F.col("kind")).alias("kind"))


@query("s2_6_21_edge_duplicates", _B + "select id from blocks a where kind <> 'table' and not exists (select 1 from blocks b where b.document_id = a.document_id and b.page_index = a.page_index and b.kind = 'table' and a.x1 <= b.x1 and a.x0 >= b.x0)")
def _(t):
    tables = t.blocks.where("kind = 'table'").alias("b")
    a = t.blocks.where("kind <> 'table'").alias("a")
    on = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.x1") <= F.col("b.x1")) & (F.col("a.x0") >= F.col("b.x0"))
    return a.join(tables, on, "left_anti").select("id")


@query("s2_6_23_chain_coalesce", _B + """, s as (select document_id, cast(x0 as bigint) as a, cast(x1 as bigint) as b from blocks), w as (select *, max(b) over (partition by document_id order by a, b rows between unbounded preceding and 1 preceding) as reach from s),
 g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by document_id order by a, b rows unbounded preceding) as g from w) select document_id, min(a) as start, max(b) as "end" from g group by document_id, g""")  # fmt: skip
def _(t):
    return o.merged_spans(_spans(t), "document_id")


@query("s2_8_6_residual_spans", _B + """, s as (select document_id, cast(x0 as bigint) as a, cast(x1 as bigint) as b from blocks union all select distinct document_id, 800, 800 from blocks),
 w as (select *, coalesce(max(b) over (partition by document_id order by a, b rows between unbounded preceding and 1 preceding), 0) as reach from s) select document_id, reach as start, a as "end" from w where a > reach""")  # fmt: skip
def _(t):
    return o.residual_spans(t.blocks.select("document_id", F.lit(800).alias("length")).distinct(), _spans(t), "document_id")


# ---- graphs


@query("s2_8_7_transitive_closure", _TREE + ", closed as (with recursive c(node, reached, depth) as (select src, dst, 1 from tree union select c.node, tree.dst, c.depth + 1 from c join tree on c.reached = tree.src where c.depth < 40) select node, reached, min(depth) as depth from c group by 1, 2) select * from closed")
def _(t):
    return g.closure(_tree(t))


@query("s2_8_8_bidirectional_load", _TREE + """, down as (with recursive d(id) as (select 37::bigint union select tree.src from d join tree on tree.dst = d.id) select id from d), up as (with recursive a(id) as (select 37::bigint union select tree.dst from a join tree on tree.src = a.id) select id from a)
 select id from down union select id from up""")  # fmt: skip
def _(t):
    tree, seed = _tree(t), t.spark.sql("select 37L as id")
    return g.reach(seed, tree, "in").union(g.reach(seed, tree, "out")).distinct()


@query("s2_8_9_dependency_gate", _TREE + """, bad as (select id from units where status <> 'accepted' union select src from tree where dst not in (select id from units)), cyc as (select a.src as id from tree a join tree b on a.dst = b.src and b.dst = a.src),
 blocked as (with recursive b(id) as (select id from bad union select id from cyc union select tree.src from b join tree on tree.dst = b.id) select id from b) select id from units where id not in (select id from blocked)""")  # fmt: skip
def _(t):
    return g.ready(t.units, _tree(t), F.col("status") == "accepted")


@query("s2_8_10_cycles", _TREE + ", c as (select distinct a.src as node from tree a join tree b on a.dst = b.src and b.dst = a.src), missing as (select distinct src from tree where dst not in (select id from units)) select node, 'cycle' as problem from c union all select src, 'missing' from missing")
def _(t):
    tree = _tree(t)
    cyclic = g.cyclic(tree).select(F.col("id").alias("node"), F.lit("cycle").alias("problem"))
    missing = tree.join(t.units.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node")).distinct()
    return cyclic.unionByName(missing.withColumn("problem", F.lit("missing")))


@query("s2_8_11_outline", _UE + ", e as (select unit_id as src, max(dependency_id) as dst from edges group by 1) select id, e.dst as parent, (select count(*) from e k where k.dst = units.id) as children from units left join e on e.src = units.id")
def _(t):
    e = t.edges.groupBy(F.col("unit_id").alias("src")).agg(F.max("dependency_id").alias("dst"))
    return g.outline(e, t.units.select("id"))


@query("s2_8_12_impact", _TREE + ", impacted as (with recursive d(id) as (select id from units where id % 1009 = 5 union select tree.src from d join tree on tree.dst = d.id) select id from d) select id from impacted")
def _(t):
    return g.reach(t.units.where("id % 1009 = 5").select("id"), _tree(t), "in")


@query("s2_8_14_tips", _TREE + ", n as (select src as id from tree union select dst from tree) select id from n where id not in (select dst from tree)")
def _(t):
    tree = _tree(t)
    return g.heads(tree, tree.select(F.col("src").alias("id")).union(tree.select("dst")).distinct())


@query("s2_8_14_ancestor_distance", _TREE + ", closed as (with recursive c(node, reached, depth) as (select src, dst, 1 from tree union select c.node, tree.dst, c.depth + 1 from c join tree on c.reached = tree.src where c.depth < 40) select node, reached, min(depth) as depth from c group by 1, 2) select node, reached as ancestor, depth, node not in (select dst from tree) as tip from closed")
def _(t):
    """Every ancestor of a node with its least distance, and whether the node is a tip."""
    tree = _tree(t)
    parents = tree.select(F.col("dst").alias("node")).distinct().withColumn("held", F.lit(True))
    return g.closure(tree).join(parents, "node", "left").select("node", F.col("reached").alias("ancestor"), "depth", F.col("held").isNull().alias("tip"))


_V = """, base as (select p_partkey as k, 'size' as path, cast(p_size as varchar) as value from part where p_partkey % 7 <> 0 union all select p_partkey, 'brand', p_brand from part),
 cur as (select k, path, case when k % 4 = 0 then value || 'c' when k % 12 = 3 then value || 'x' else value end as value from base where k % 11 <> 0),
 inc as (select k, path, case when k % 6 = 0 then value || 'i' when k % 12 = 3 then value || 'x' else value end as value from base where k % 13 <> 0 union all select p_partkey, 'size', 'new' from part where p_partkey % 7 = 0)"""
_M3 = "with one as (select 1)" + _V


def _versions(t):
    part = t.part
    base = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), F.lit("size").alias("path"), F.col("p_size").cast("string").alias("value")).unionByName(part.select(F.col("p_partkey").alias("k"), F.lit("brand").alias("path"), F.col("p_brand").alias("value")))
    mark = lambda m, c: F.when(F.col("k") % m == 0, F.concat("value", F.lit(c))).when(F.col("k") % 12 == 3, F.concat("value", F.lit("x"))).otherwise(F.col("value")).alias("value")
    cur = base.where("k % 11 <> 0").select("k", "path", mark(4, "c"))
    inc = base.where("k % 13 <> 0").select("k", "path", mark(6, "i")).unionByName(part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("k"), F.lit("size").alias("path"), F.lit("new").alias("value")))
    return base, cur, inc


@query("s2_8_15_three_way_merge", _M3 + """, a as (select k, path from base union select k, path from cur union select k, path from inc), j as (select a.k, a.path, b.value as bv, c.value as cv, i.value as iv, b.k is not null as bp, c.k is not null as cp, i.k is not null as ip
 from a left join base b using (k, path) left join cur c using (k, path) left join inc i using (k, path)),
 r as (select *, case when cp = ip and cv is not distinct from iv then 'same' when bp = ip and bv is not distinct from iv then 'auto_current' when bp = cp and bv is not distinct from cv then 'auto_incoming' else 'conflict' end as outcome from j)
 select k, path, outcome, case when outcome = 'auto_incoming' then iv else cv end as value, case when outcome = 'auto_incoming' then ip else cp end as present from r""")  # fmt: skip
def _(t):
    return g.merge3(*_versions(t), ["k", "path"])


@query("s2_8_21_leaf_changes", _M3 + " select k, path, base.value as old, cur.value as new from base full join cur using (k, path) where base.value is distinct from cur.value")
def _(t):
    base, cur, _ = _versions(t)
    return g.leaf_changes(base, cur, ["k", "path"])


@query("s2_8_4_event_union", "select event_id, user_id from events where event_id % 3 = 0 union select event_id, user_id from events where event_id % 2 = 0")
def _(t):
    e = t.events.select("event_id", "user_id")
    return e.where("event_id % 3 = 0").union(e.where("event_id % 2 = 0")).dropDuplicates(["event_id"])


@query("s2_8_5_history_union", _U + "select id, 'task' as origin from units where status = 'pending' union all select seq, 'history' from (" + prefix("log") + "select seq from log where state = 'done')")
def _(t):
    return t.units.where("status = 'pending'").select("id", F.lit("task").alias("origin")).unionByName(t.log.where("state = 'done'").select(F.col("seq").alias("id"), F.lit("history").alias("origin")))


@query("s2_8_18_structure_invariants", _B + "select 'box' as rule, count(*) as n from blocks where x1 <= x0 or y1 <= y0 union all select 'level', count(*) from blocks where level not between 1 and 3 union all select 'page', count(*) from blocks where x1 > 700 union all select 'repeat', count(*) - count(distinct id) from blocks")
def _(t):
    b = t.blocks
    rows = b.agg(F.count_if(F.expr("x1 <= x0 or y1 <= y0")).alias("box"), F.count_if(F.expr("level not between 1 and 3")).alias("level"), F.count_if(F.col("x1") > 700).alias("page"), (F.count("*") - F.countDistinct("id")).alias("repeat"))
    return rows.select(F.expr("stack(4, 'box', box, 'level', level, 'page', page, 'repeat', repeat) as (rule, n)"))


@query("s2_8_19_referential_validation", _UE + "select unit_id, dependency_id from edges where dependency_id not in (select id from units)")
def _(t):
    return t.edges.join(t.units, F.col("dependency_id") == F.col("id"), "left_anti").select("unit_id", "dependency_id")


@query("s2_8_20_review_impact", _TREE + ", both_ways as (select src as a, dst as b from tree union select dst, src from tree) select id from (with recursive d(id) as (select id from units where id % 1009 = 5 union select b from d join both_ways on a = d.id) select id from d)")
def _(t):
    return g.reach(t.units.where("id % 1009 = 5").select("id"), _tree(t))


@query("s2_8_20_impact_closure", _TREE + """, both_ways as (select src as a, dst as b from tree union select dst, src from tree), base as (select id, status, id as place from units),
 cur as (select id, case when id % 2003 = 5 then 'changed' else status end as status, case when id % 2003 = 7 then id + 1 else id end as place from units), inc as (select id, case when id % 2003 = 9 then 'changed' else status end as status, id as place from units where id % 2003 <> 11),
 seeds as (select id from base join cur using (id) left join inc using (id) where base.status is distinct from cur.status or base.status is distinct from inc.status or base.place is distinct from cur.place or base.place is distinct from inc.place)
 select id from (with recursive d(id) as (select id from seeds union select b from d join both_ways on a = d.id) select id from d)""")  # fmt: skip
def _(t):
    """The units that either of two versions has changed, moved or dropped, and all that dependencies join to them in any number of steps."""
    base = t.units.select("id", F.struct("status", F.col("id").alias("place")).alias("value"))
    state = lambda k: F.when(F.col("id") % 2003 == k, "changed").otherwise(F.col("status")).alias("status")
    cur = t.units.select("id", F.struct(state(5), F.when(F.col("id") % 2003 == 7, F.col("id") + 1).otherwise(F.col("id")).alias("place")).alias("value"))
    inc = t.units.where("id % 2003 <> 11").select("id", F.struct(state(9), F.col("id").alias("place")).alias("value"))
    changed = g.leaf_changes(base, cur, ["id"]).select("id").union(g.leaf_changes(base, inc, ["id"]).select("id"))
    return g.reach(changed, _tree(t))


@query("s2_8_23_adjacent_merge", _B + ", w as (select document_id, string_agg(text, '' order by seq) as whole, count(*) as parts from blocks group by 1) select document_id, parts, length(whole) as chars, sha256(whole) as digest from w")
def _(t):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "")
    return t.blocks.groupBy("document_id").agg(whole.alias("whole"), F.count("*").alias("parts")).select("document_id", "parts", F.length("whole").cast("long").alias("chars"), F.sha2("whole", 256).alias("digest"))


@query("s2_8_24_table_grid", _B + ", s as (select document_id, unnest(range(seq, seq + level)) as slot from blocks where kind = 'table'), n as (select document_id, slot, count(*) as n from s group by 1, 2) select document_id, count(*) filter (where n > 1) as overlaps, max(slot) - min(slot) + 1 - count(*) as gaps from n group by 1")
def _(t):
    s = t.blocks.where("kind = 'table'").select("document_id", F.explode(F.sequence("seq", F.col("seq") + F.col("level") - 1)).alias("slot"))
    n = s.groupBy("document_id", "slot").agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.count_if(F.col("n") > 1).alias("overlaps"), (F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("gaps"))


@query("s2_8_25_relation_targets", _B + "select a.id, a.id + 1 as target from blocks a where not exists (select 1 from blocks b where b.id = a.id + 1 and b.kind <> 'table')")
def _(t):
    a = t.blocks.select("id", (F.col("id") + 1).alias("target"))
    return a.join(t.blocks.where("kind <> 'table'").select(F.col("id").alias("target")), "target", "left_anti").select("id", "target")


@query("s2_8_28_context_closure", _TREE + """, c as (with recursive r(node, reached) as (select src, dst from tree union select r.node, tree.dst from r join tree on r.reached = tree.src) select node, reached from r),
 m as (select src as node, src as x from tree union select node, reached from c), e as (select node, bool_or(x % 5 <> dst % 5) as stale from m join tree on m.x = tree.src group by 1),
 f as (select node, count(*) as refs, sha256(string_agg(cast(reached as varchar), ',' order by reached)) as fingerprint from c group by 1) select node, refs, fingerprint from f join e using (node) where not stale""")  # fmt: skip
def _(t):
    """Units with all that they refer to in any number of steps and its fingerprint; one stale reference on the way rejects the unit."""
    tree = _tree(t)
    closed = g.closure(tree).select("node", "reached")
    at = closed.union(tree.select("src", "src")).distinct()
    stale = at.join(tree, F.col("reached") == F.col("src")).where(F.col("src") % 5 != F.col("dst") % 5).select("node").distinct()
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("reached")), lambda x: x.cast("string")), ",")
    return closed.join(stale, "node", "left_anti").groupBy("node").agg(F.count("*").alias("refs"), F.sha2(whole, 256).alias("fingerprint"))


@query("s2_8_30_copy_verify", "select 'lost' as side, count(*) as n from (select n_nationkey, n_name from nation except all select n_nationkey, n_name from nation where n_nationkey % 10 <> 0) union all select 'added', count(*) from (select n_nationkey, n_name from nation where n_nationkey % 10 <> 0 except all select n_nationkey, n_name from nation)")
def _(t):
    a = t.nation.select("n_nationkey", "n_name")
    b = a.where("n_nationkey % 10 <> 0")
    return a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("lost").alias("side"), "n").unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("added").alias("side"), "n"))
