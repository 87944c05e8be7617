"""Queries of repairs that people make and of what peers exchange: differences, boundaries, links, orders, ledgers, grids, hierarchies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import rules
from factloom.operators import boundaries as b
from factloom.operators import diff, export, families, hierarchy, mentions, ordering, profiles, sync, tablegrid, updates
from factloom.plans.catalog import query
from factloom.sources import packages
from factloom.sources.derived import prefix
from factloom.sources.scratch import fresh
from factloom.streaming import failures

_B, _C, _U = prefix("blocks"), prefix("clauses"), prefix("units")

# ---- two versions of a document's passages

_CHANGED = "(document_id + seq) % 4 = 0"
_SAVED = "select document_id, id, seq * 10 as place, text from blocks"
_LOCAL = f"""select document_id, id, seq * 10 + case when id % 7 = 0 then 25 when id % 11 = 0 then -36 else 0 end as place,
 case when {_CHANGED} then replace(replace(text, 'ship at least', 'store'), 'days', 'working days') else text end as text from blocks where id % 13 <> 0
 union all select document_id, -id, seq * 10 + 5, concat('New: ', text) from blocks where id % 17 = 0"""


def _versions(t):
    return tuple(t.spark.sql(text.replace("from blocks", "from {blocks}"), blocks=t.blocks) for text in (_SAVED, _LOCAL))


@query("s2_9_32_edit_script", _B + f""", p as (select s.document_id, s.id, s.text as old, l.text as new from ({_SAVED}) s join ({_LOCAL}) l using (document_id, id) where s.text <> l.text)
 select document_id, id, cast(len(regexp_extract_all(old, '\\w+|\\s+|[^\\w\\s]')) - 5 as bigint) as kept, 13::bigint as deleted, 13::bigint as inserted, cast(strpos(old, 'ship') - 1 as int) as old_start, sha256(new) as replayed from p""")  # fmt: skip
def _(t):
    """The edit script of each passage whose wording differs: how many words and marks stay, code points deleted and inserted, the first deletion, and the new text made from the old by the script."""
    saved, local = _versions(t)
    both = diff.passages(saved, local, "document_id", "id", "place", "text").where("change = 'changed'").withColumn("runs", diff.edit_script(F.col("old"), F.col("new")))
    piece = lambda text, a, z: F.substring(F.col(text), a + 1, z - a)
    total = lambda op, a, z: F.aggregate(F.filter("runs", lambda r: r["op"] == op), F.lit(0).cast("long"), lambda n, r: n + r[z] - r[a])
    words = F.aggregate(F.filter("runs", lambda r: r["op"] == "keep"), F.lit(0).cast("long"), lambda n, r: n + F.size(F.regexp_extract_all(piece("old", r["old_start"], r["old_end"]), F.lit(r"(\w+|\s+|[^\w\s])"), 1)))
    first = F.get(F.filter("runs", lambda r: r["op"] == "delete"), F.lit(0))
    again = F.array_join(F.transform("runs", lambda r: F.when(r["op"] == "keep", piece("old", r["old_start"], r["old_end"])).when(r["op"] == "insert", piece("new", r["new_start"], r["new_end"])).otherwise("")), "")
    return both.select("document_id", "id", words.alias("kept"), total("delete", "old_start", "old_end").alias("deleted"), total("insert", "new_start", "new_end").alias("inserted"), first["old_start"].alias("old_start"), F.sha2(again, 256).alias("replayed"))


@query("s2_9_32_moved_passages", _B + f""", s as ({_SAVED}), l as ({_LOCAL}), f as (select coalesce(s.document_id, l.document_id) as document_id, s.place as o, l.place as n, s.text as old, l.text as new, s.id as sid, l.id as lid from s full join l on s.document_id = l.document_id and s.id = l.id),
 k as (select document_id, o, n from f where o is not null and n is not null),
 c as (with recursive r as (select document_id, o, n, 1 as len from k union all select k.document_id, k.o, k.n, r.len + 1 from r join k on k.document_id = r.document_id and k.o > r.o and k.n > r.n) select document_id, max(len) as stay from r group by 1),
 a as (select document_id, count(*) filter (where sid is null) as added, count(*) filter (where lid is null) as removed, count(*) filter (where old <> new) as changed, count(*) filter (where sid is not null and lid is not null) as survive from f group by 1)
 select a.document_id, added, removed, changed, survive - coalesce(stay, 0) as moved from a left join c using (document_id)""")  # fmt: skip
def _(t):
    """How many passages of each document were added, removed or changed, and the fewest that must have moved: those outside a longest increasing subsequence."""
    saved, local = _versions(t)
    rows = diff.passages(saved, local, "document_id", "id", "place", "text")
    of = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return rows.groupBy("document_id").agg(of("added"), of("removed"), of("changed"), F.count_if("moved").alias("moved"))


# ---- boundaries of units

_MERGES = """select document_id, 1 as request, id from blocks where document_id % 4 = 0 and seq in (2, 3) union all select document_id, 1, id from blocks where document_id % 4 = 1 and seq in (1, 3)
 union all select document_id, 2, id from blocks where document_id % 8 = 2 and seq in (4, 5) union all select document_id, 2, id from blocks where document_id % 16 = 2 and seq = 4 union all select document_id, 2, -id from blocks where document_id % 8 = 6 and seq in (1, 2)"""
_SPLITS = """select document_id, id, array(strpos - 1, strpos + document_id % 5) as cuts from (select document_id, id, seq, position(' within' in text) as strpos from blocks) where document_id % 4 = 3 or (document_id % 4 = 0 and seq = 2)
 union all select document_id, id, array(400) from blocks where document_id % 4 = 1 and seq = 2"""


def _bounded(t):
    units = b.original(t.blocks.selectExpr("document_id as document", "id", "seq as ordinal", "floor((seq - 1) / 4) as parent", "kind", "text"))
    asked = lambda text: t.spark.sql(text.replace("from blocks", "from {blocks}"), blocks=t.blocks).withColumnRenamed("document_id", "document")
    whole, verdicts = b.merged(units, asked(_MERGES))
    parts, split_verdicts = b.divided(whole, asked(_SPLITS))
    return units, whole, parts, verdicts, split_verdicts


_MERGE_SQL = f""", q as ({_MERGES}), g as (select document_id, request, id, count(*) as times from q group by 1, 2, 3), h as (select g.*, b.seq, b.kind, floor((b.seq - 1) / 4) as parent, b.text from g left join blocks b on b.document_id = g.document_id and b.id = g.id),
 v as (select document_id as document, request, count(*) as n, case when count(*) < 2 or max(times) > 1 then 'needs two units or more, none twice' when count(seq) < count(*) then 'unknown unit' when bool_or(kind = 'table') then 'table boundary'
  when count(distinct parent) > 1 then 'different parents' when max(seq) - min(seq) + 1 <> count(*) then 'not adjacent' end as reason from h group by 1, 2)"""


@query("s2_8_23_merge_verdicts", _B + _MERGE_SQL + " select document, request, n, reason from v")
def _(t):
    """Requests to merge units of a document, and why those that are refused are."""
    return _bounded(t)[3]


@query("s2_8_23_boundary_repairs", _B + _MERGE_SQL + f""", w as (select b.document_id, b.id, b.seq, b.kind, b.text, case when v.reason is null and v.document is not null and h.id is not null then min(b.id) over (partition by b.document_id, h.request, v.reason is null and v.document is not null and h.id is not null) else b.id end as into_id
   from blocks b left join h on h.document_id = b.document_id and h.id = b.id left join v on v.document = h.document_id and v.request = h.request),
 m as (select document_id, into_id as id, string_agg(text, chr(10) order by seq) as text, count(*) as sources, arg_min(kind, seq) as kind from w group by 1, 2),
 c as (select document_id, id, case when document_id % 4 = 1 then [400] else [p - 1, p + document_id % 5] end as cuts from (select document_id, id, seq, strpos(text, ' within') as p from blocks) where document_id % 4 = 3 or (document_id % 4 = 0 and seq = 2) or (document_id % 4 = 1 and seq = 2)),
 j as (select m.*, case when c.cuts is not null and kind <> 'table' and c.cuts[-1] < length(text) and trim(text[c.cuts[1] + 1 : c.cuts[-1]]) <> '' then c.cuts else [] end as cuts from m left join c using (document_id, id)),
 p as (select document_id, id, text, sources, unnest(range(len(cuts) + 1)) as part, list_concat([0], cuts, [length(text)]) as bounds from j)
 select document_id as document, id, cast(part as int) as part, bounds[part + 2] - bounds[part + 1] as chars, sha256(text[bounds[part + 1] + 1 : bounds[part + 2]]) as digest,
  length(text[bounds[part + 1] + 1 : bounds[part + 2]]) - (length(text[bounds[part + 1] + 1 : bounds[part + 2]]) - length(replace(text[bounds[part + 1] + 1 : bounds[part + 2]], chr(10), ''))) as from_sources from p""")  # fmt: skip
def _(t):
    """Units after merges and splits: each part's text, made anew from the maps and the first texts, and how many of its code points come from a source."""
    units, _, parts, _, _ = _bounded(t)
    again = b.rebuilt(parts, units.select(F.col("id").alias("source"), F.col("text").alias("original")))
    drawn = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.when(p["source"].isNotNull(), p["end"] - p["start"]).otherwise(0))
    return parts.select("document", "id", "part", drawn.alias("from_sources")).join(again, ["document", "id", "part"]).select("document", "id", "part", F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"), "from_sources")


# ---- mentions and the parts they mean

_SAID = """, s as (select document_id, id, scope, kind as own, unnest(case (ordinal - 1) % 6
  when 2 then [('table', regexp_extract(text, 'Table (\\d)', 1), 'label', 4), ('figure', regexp_extract(text, 'Fig. (\\d)', 1), 'label', 16), ('section', regexp_extract(text, 'sections (\\d+)', 1), 'label', strpos(text, 'sections') - 1), ('section', regexp_extract(text, 'sections \\d+ and (\\d+)', 1), 'label', strpos(text, ' apply') - 1 - length(regexp_extract(text, 'sections \\d+ and (\\d+)', 1)))]
  when 4 then [('table', null, case when contains(text, 'above') then 'above' else 'below' end, 4), ('section', 'b', 'label', strpos(text, 'annex') - 1), ('footnote', regexp_extract(text, '\\^(\\d+)', 1), 'note', strpos(text, '[') - 1)] else [] end) as m from clauses),
 l as (select document_id, id, scope, kind, case kind when 'heading' then 'section' else kind end as bears, case kind when 'footnote' then regexp_extract(text, '^(\\d+)', 1) else regexp_extract(text, '^\\w+ (\\d+)', 1) end as label from clauses where kind <> 'paragraph'),
 n as (select s.id, s.m[1] as kind, s.m[2] as label, s.m[3] as way, s.m[4] as start, s.document_id, s.scope from s),
 t as (select n.id, n.start, n.kind, arg_min(l.id, (abs(l.scope - n.scope), l.scope, l.id)) as target from n join l on l.document_id = n.document_id and l.bears = n.kind and l.label = n.label group by 1, 2, 3),
 p as (select n.id, n.start, case n.way when 'below' then min(l.id) filter (where l.id > n.id) else max(l.id) filter (where l.id < n.id) end as target from n join l on l.document_id = n.document_id and l.scope = n.scope and l.kind = n.kind where n.label is null group by n.id, n.start, n.way)"""  # fmt: skip


@query("s2_4_15_mention_links", _C + _SAID + """ select n.id, cast(n.start as int) as start, n.kind, n.label, n.way, case when n.label is null then p.target else t.target end as target,
 case when n.label is not null and t.target is null then 'no part bears this label' when n.label is null and p.target is null then 'no such part in scope' end as reason
 from n left join t on t.id = n.id and t.start = n.start and t.kind = n.kind left join p on p.id = n.id and p.start = n.start""")  # fmt: skip
def _(t):
    """Mentions read from the text, each with the part it means in the nearest section, or the reason why it has none."""
    found = mentions.links(t.clauses.withColumnRenamed("document_id", "document"))
    return found.select("id", "start", "kind", "label", "way", "target", "reason")


# ---- orders kept by keys


@query("s2_6_13_moves", _B + """, n as (select document_id, list(seq order by seq) as l from blocks group by 1), v as (select document_id, seq as unit, case when l_no > 7 then null else l_no end as after, row_number() over (partition by document_id order by seq) as k from (select document_id, seq, id % 9 + page_index * 2 as l_no, id from blocks) where (id + document_id) % 3 <> 0),
 r as (with recursive r as (select document_id, 0::bigint as k, l, 0 as moves from n union all
  select r.document_id, r.k + 1, case when v.unit = v.after or (v.after is not null and not list_contains(r.l, v.after)) then r.l when v.after is null then list_concat([v.unit], list_filter(r.l, lambda x: x <> v.unit))
   else list_concat(list_filter(r.l, lambda x: x <> v.unit)[:list_position(list_filter(r.l, lambda x: x <> v.unit), v.after)], [v.unit], list_filter(r.l, lambda x: x <> v.unit)[list_position(list_filter(r.l, lambda x: x <> v.unit), v.after) + 1:]) end,
   r.moves + case when v.unit = v.after or (v.after is not null and not list_contains(r.l, v.after)) then 0 else 1 end from r join v on v.document_id = r.document_id and v.k = r.k + 1) select document_id, arg_max(l, k) as l, max(moves) as moves from r group by 1)
 select document_id, array_to_string(l, ',') as units, moves::bigint as moves from r""")  # fmt: skip
def _(t):
    """The order of each document's units after its moves are replayed, by their keys alone."""
    n = Window.partitionBy("document_id")
    units = t.blocks.select(F.col("document_id").alias("document"), F.col("seq").cast("long").alias("unit"), ordering.first_keys(F.col("seq"), F.count("*").over(n)).alias("key"))
    after = F.col("id") % 9 + F.col("page_index") * 2
    moves = t.blocks.where("(id + document_id) % 3 <> 0").select(F.col("document_id").alias("document"), F.col("seq").alias("seq"), F.col("seq").alias("unit"), F.when(after <= 7, after).alias("after"))
    done = ordering.moved(units, moves)
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "unit")))), lambda x: x["unit"]), ",")
    return done.groupBy(F.col("document").alias("document_id")).agg(in_order.alias("units"), F.sum("moves").alias("moves"))


# ---- ledgers of peers

_EDITS = """select user_id as item, event_id % 3 as peer, value, event_id, row_number() over (partition by user_id, event_id % 3 order by event_id) as counter from events"""


@query("s2_10_21_vector_sync", f"""with e as ({_EDITS}), s as (select e.item, e.peer, e.counter, e.value, e.event_id, p.peer as other, (select count(*) from e f where f.item = e.item and f.peer = p.peer and f.event_id < case when p.peer = e.peer then e.event_id else (e.event_id // 2000) * 2000 end) as upto from e cross join (values (0), (1), (2)) p(peer)),
 known as (select * from e where not (event_id % 101 = 0)), top as (select k.* from known k where not exists (select 1 from s where s.item = k.item and s.other = k.peer and s.upto >= k.counter and s.event_id % 101 <> 0)),
 gap as (select item, sum(u - n) as missing, sum(n) as revision from (select item, peer, max(upto) as u, sum(n) as n from (select item, peer, counter as upto, 1 as n from known union all select item, other, upto, 0 from s where event_id % 101 <> 0) group by 1, 2) group by 1)
 select top.item, any_value(revision)::bigint as revision, case when count(distinct value) = 1 and any_value(missing) = 0 then max(value) end as value, count(*) as heads, case when any_value(missing) > 0 then 'missing edits' when count(distinct value) > 1 then 'concurrent' end as review from top join gap using (item) group by 1""".replace("from e cross join", "from e cross join"))  # fmt: skip
def _(t):
    """Three peers edit items apart and exchange every two thousand events; ledgers that overlap are united, and items that two have edited at the same time go to review."""
    e = t.spark.sql(_EDITS.replace("from events", "from {events}"), events=t.events)
    before = Window.partitionBy("item").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    # how many edits of each peer there were before an event, and before the last exchange
    marks = e.select("item", "event_id", "peer", "counter", "value", F.lit(1).alias("real")).unionByName(e.select("item", (F.floor(F.col("event_id") / 2000) * 2000 - 0.5).alias("event_id"), F.lit(-1).alias("peer"), F.lit(0).cast("long").alias("counter"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("real")).distinct())
    running = marks.select("*", *[F.count_if((F.col("peer") == p) & (F.col("real") == 1)).over(before).alias(f"n{p}") for p in range(3)])
    exchanged = [F.last(F.when(F.col("real") == 0, F.col(f"n{p}")), ignorenulls=True).over(before).alias(f"x{p}") for p in range(3)]
    seen = F.map_from_arrays(F.array(*map(F.lit, range(3))), F.array(*[F.when(F.col("peer") == p, F.col(f"n{p}")).otherwise(F.col(f"x{p}")) for p in range(3)]))
    edits = running.select("*", *exchanged).where("real = 1").select("item", "event_id", F.col("peer").cast("int").alias("peer"), "counter", "value", seen.alias("seen"))
    known = edits.where("event_id % 101 <> 0")
    first, second = known.where("event_id % 5 <> 0").drop("event_id"), known.where("event_id % 2 = 0 or event_id % 5 = 0").drop("event_id")
    return sync.state(sync.united(second, first, second)).select("item", "revision", "value", "heads", "review")


# ---- grids

_CELLS = """select document_id as tab, id as cell, cast(floor((seq - 1) / 2) as int) as r, cast((seq - 1) % 2 as int) as c, case when id % 19 = 0 then 2 when id % 23 = 0 then 0 else 1 end as rs, case when id % 13 = 0 then 2 else 1 end as cs,
 cast((seq - 1) % 2 as double) * 100 as x0, cast((seq - 1) % 2 as double) * 100 + case when id % 17 = 0 then 180 when id % 29 = 0 then -5 else 95 end as x1, case when id % 7 = 0 then null when id % 31 = 0 then 0 else floor((seq - 1) / 2) end as bound from blocks"""


@query("s2_8_24_grid_findings", _B + f""", k as ({_CELLS}), n as (select document_id as tab, cast(ceil(count(*) / 2.0) as int) as nr, 2 as nc from blocks group by 1), h as (select k.*, nr, nc, rs = 0 as bad, r + rs > nr or c + cs > nc as out from k join n using (tab)), g as (select * from h where not bad and not out),
 p as (select tab, cell, unnest(range(r, r + rs)) as pr, c, cs from g), q as (select tab, cell, pr, unnest(range(c, c + cs)) as pc from p), u as (select tab, pr, pc, count(*) as n from q group by 1, 2, 3),
 a as (select tab, count(*) as covered, count(*) filter (where n > 1) as twice from u group by 1), bd as (select tab, bound from g where bound is not null group by 1, 2 having count(distinct r) > 1), bn as (select tab, count(*) as n from bd group by 1), ub as (select tab, count(*) as n from g where bound is null and tab in (select tab from g where bound is not null) group by 1)
 select n.tab, (select count(*) from h where h.tab = n.tab and bad) as spans, (select count(*) from h where h.tab = n.tab and out and not bad) as outside, nr * nc - coalesce(covered, 0) as gaps, coalesce(twice, 0) > 0 as overlaps, coalesce(bn.n, 0) as bindings, coalesce(ub.n, 0) as unbound, (select count(*) from g where g.tab = n.tab and x1 < x0) as boxes
 from n left join a using (tab) left join bn using (tab) left join ub using (tab)""")  # fmt: skip
def _(t):
    """Findings about each table's grid: cells without span or outside, places not covered, overlaps, source rows bound twice or not at all, boxes inside out."""
    cells = t.spark.sql(_CELLS.replace("from blocks", "from {blocks}"), blocks=t.blocks)
    cells = cells.select(F.col("tab").alias("table"), "cell", F.col("r").alias("row"), F.col("c").alias("column"), F.col("rs").alias("row_span"), F.col("cs").alias("column_span"), "x0", F.lit(0.0).alias("y0"), "x1", F.lit(1.0).alias("y1"), "bound")
    tables = t.blocks.groupBy(F.col("document_id").alias("table")).agg(F.ceil(F.count("*") / 2).cast("int").alias("rows"), F.lit(2).alias("columns"))
    found = tablegrid.findings(cells, tables)
    of = lambda issue: F.count_if(F.col("issue") == issue)
    area = F.coalesce(F.sum(F.when(F.col("issue") == "gap", (F.col("high") - F.col("low")) * (F.col("after") - F.col("first")))), F.lit(0))
    told = tables.join(found, "table", "left").groupBy("table").agg(of("span").alias("spans"), of("outside").alias("outside"), area.alias("gaps"), (of("overlap") > 0).alias("overlaps"), of("binding").alias("bindings"), of("unbound").alias("unbound"), of("box").alias("boxes"))
    return told.withColumnRenamed("table", "tab")


# ---- hierarchies

_TREE = "select id, case when id % 97 = 0 and id > 0 then 2 * id when id % 11 = 0 and id > 0 then id + 1 when id > 0 then cast(floor(id / 2) as bigint) end as parent from units"


@query("s2_3_22_tree_places", _U + f""", t as ({_TREE}), w as (with recursive r as (select id, id as node, 0::bigint as d, [id] as seen from t union all select r.id, t.parent, r.d + 1, list_append(seen, t.parent) from r join t on t.id = r.node where t.parent is not null and not list_contains(seen, t.parent)) select id, max(d) as d, arg_max(node, d) as last from r group by 1)
 select w.id, t.parent, case when e.parent is null then d end as depth, case when e.parent is null then last end as root, case when e.parent is null and e.id is null then 'unknown_parent' when e.parent is null then 'fine' when e.parent = w.id then 'cycle' else 'below_cycle' end as state
 from w join t using (id) left join t e on e.id = w.last""")  # fmt: skip
def _(t):
    """Where each unit stands after people have edited its parent: depth and root, or the cycle that an edit has made."""
    source = t.units.select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("parent"))
    edit = F.when(F.col("id") % 97 == 0, 2 * F.col("id")).otherwise(F.col("id") + 1)
    edits = t.units.where("id > 0 and (id % 97 = 0 or id % 11 = 0)").select("id", edit.alias("parent"), F.lit(2).alias("at"))
    older = t.units.where("id % 11 = 0").select("id", F.lit(None).cast("long").alias("parent"), F.lit(1).alias("at")).where("id > 0")
    tree = hierarchy.overlaid(source, edits.unionByName(older))
    return hierarchy.placed(tree).select("id", "parent", "depth", "root", "state")


# ---- packages

_FAULTS = 12


def _packages(t):
    """Packages of twenty pages each, and what is wrong with those of some numbers."""

    def pack(batches):
        for pdf in batches:
            for k, ids, texts in zip(pdf["k"], pdf["ids"], pdf["texts"], strict=True):
                files = {f"pages/{i}.html": x.encode() for i, x in zip(ids, texts, strict=True)}
                yield pd.DataFrame({"path": [f"p{k}"], "content": [_with_fault(int(k) % _FAULTS, files)]})

    grouped = t.pages.groupBy(F.floor(F.col("page_id") / 20).alias("k")).agg(F.array_sort(F.collect_list(F.struct("page_id", F.coalesce("html", F.lit("")).alias("html")))).alias("x"))
    return grouped.select("k", F.transform("x", lambda p: p["page_id"]).alias("ids"), F.transform("x", lambda p: p["html"]).alias("texts")).mapInPandas(pack, "path string, content binary")


def _with_fault(fault: int, files: dict[str, bytes]) -> bytes:
    whole = packages.packed(files)
    first = min(files)
    stored = {packages.FOLDER + p: x for p, x in files.items()}
    if fault == 1:
        return whole[: len(whole) // 2]
    if fault == 2:
        return packages.packed(files, b'{"files": [], "files": []}')
    if fault == 3:
        return packages.packed(files, stored=stored | {packages.FOLDER + first: b"other"})
    if fault == 4:
        return packages.packed(files, stored={k: v for k, v in stored.items() if k != packages.FOLDER + first})
    if fault == 5:
        return packages.packed(files, stored=stored | {packages.FOLDER + "extra": b"x"})
    if fault == 6:
        return packages.packed(files | {"../out": b"x"})
    if fault == 7:
        return packages.packed(files | {first.upper(): b"x"})
    return whole


@query("s2_1_21_packages", """with k as (select cast(floor(page_id / 20) as bigint) as k, count(*) as n from pages group by 1), f as (select *, k % 12 as fault from k),
 e as (select 'p' || k as package, case fault when 1 then 'archive_corrupt' when 2 then 'manifest_repeated_key' end as issue, 1::bigint as rows from f where fault in (1, 2)
  union all select 'p' || k, null, n - case when fault in (3, 4, 7) then 1 else 0 end from f where fault not in (1, 2) union all select 'p' || k, case fault when 3 then 'file_changed' when 4 then 'file_missing' when 5 then 'unlisted' when 6 then 'path_climbs' when 7 then 'path_collision' end, case fault when 7 then 2 else 1 end from f where fault between 3 and 7)
 select package, issue, rows from e where rows > 0""")  # fmt: skip
def _(t):
    """What the packages hold, and what is wrong with the others: one row for each file, summed by its issue."""
    return packages.read(_packages(t)).groupBy("package", "issue").agg(F.count("*").alias("rows"))


# ---- rules and the catalog of fields

_LEAVES = """select p_partkey as rule, case p_partkey % 5 when 0 then 'p_name' when 1 then 'p_size' when 2 then 'p_retailprice' when 3 then 'p_color' else 'p_brand' end as field,
 case p_partkey % 5 when 1 then case when p_partkey % 3 = 0 then 'text' else 'number' end when 2 then 'number' when 3 then 'text' else case when p_partkey % 7 = 0 then 'date' else 'text' end end as kind,
 case p_partkey % 4 when 0 then 'eq' when 1 then 'contains' when 2 then 'between' else case when p_partkey % 11 = 0 then null else 'is_empty' end end as op from part"""


@query("s2_3_18_rule_issues", f"""with l as ({_LEAVES}), c as (select * from (values ('p_name', 'text'), ('p_brand', 'text'), ('p_size', 'number'), ('p_retailprice', 'number')) v(field, now))
 select rule, field, case when now is null then 'absent' when kind <> now then 'kind changed' else 'operator not allowed' end as issue from l left join c using (field)
 where now is null or kind <> now or op is null or (now = 'text' and op = 'between') or (now = 'number' and op = 'contains')""")  # fmt: skip
def _(t):
    """Rules whose field, kind or operator the table's columns no longer bear out."""
    leaves = t.spark.sql(_LEAVES.replace("from part", "from {part}"), part=t.part)
    fields = t.spark.createDataFrame(rules.catalog(t.part.schema), "field string, kind string, operators array<string>")
    return rules.mapping_issues(leaves, fields)


# ---- template families

_SHEETS = """select document_id as document, scope + case when document_id % 6 = 0 and scope >= 2 then 1 else 0 end as page, ordinal, 600.0D as width, 800.0D as height, ((ordinal - 1) % 6) * 130.0D + 40.0D as y0,
 case (ordinal - 1) % 6 when 3 then 220.0D when 4 then 400.0D when 5 then 30.0D else 90.0D end as x0,
 case when f = 0 and slot = 0 then 'Indicator' when f = 0 and slot = 1 then ' Requirement ' when f = 1 and slot = 0 then 'Required  Client actions' when f = 1 and slot = 2 then 'see Required CAB Actions' when f = 2 and slot = 0 then 'Indicators: 3'
  when f = 3 and slot = 2 then 'How do I interpret this requirement?' when f = 4 and slot = 0 then 'Indicator: a' when f = 4 and slot = 1 then 'Requirement: b' when f = 5 and slot = 0 then 'Applicability: all' when f = 5 and slot = 3 then 'a. do' when f = 5 and slot = 4 then 'B. check'
  when f = 6 and slot = 3 then 'A. do' when f % 2 = 1 and slot = 5 then '1.2.3 Nets' else 'plain text' end as text
from (select *, (ordinal - 1) % 6 as slot, (document_id * 7 + scope * 5) % 11 as f from clauses) c"""


@query("s2_9_17_page_families", _C + f""", s as ({_SHEETS.replace('.0D', '.0')}), g as (select document, page, bool_or(text = 'Indicator') and bool_or(trim(text) = 'Requirement') as legacy, bool_or(text like 'Required  Client%') and bool_or(text like '%CAB Actions') as audit, bool_or(text like 'Indicators:%') as single, bool_or(text like 'How do I%') or (bool_or(text like 'Indicator:%') and bool_or(text like 'Requirement:%')) as norm,
  bool_or(text = 'a. do') and bool_or(text = 'B. check') and bool_or(text like 'Applicability%') as matrix, bool_or(text like '1.2.3%' and y0 < 720) as anchored from s group by 1, 2),
 o as (select *, case when audit or matrix then 'audit_matrix' when legacy then 'legacy_indicator_value' when norm then 'id_normative_with_context' when single then 'single_column_indicators' end as own from g)
 select document, page, own, coalesce(own, case when exists (select 1 from o p where p.document = o.document and p.page = o.page - 1) and (l.own = 'id_normative_with_context' or (l.own = 'single_column_indicators' and anchored)) then l.own end) as family
 from o left join lateral (select p.own from o p where p.document = o.document and p.page < o.page and p.own is not null order by p.page desc limit 1) l on true""".replace("o.own is null", "o.own is null").replace("select document, page, own, coalesce(own,", "select document, page, o.own, coalesce(o.own,"))  # fmt: skip
def _(t):
    """The family of each page of each document, by its own lines or by the page before."""
    lines = t.spark.sql(_SHEETS.replace("from clauses", "from {clauses}"), clauses=t.clauses)
    return families.resolved(families.evidence(lines)).select("document", "page", "own", "family")


# ---- profiles by sketches

_KLL = 400


@query("s2_5_25_sketched_edges", _B + "select page_index, count(*) as lines, true as left_near, true as right_near from blocks group by 1")
def _(t):
    """Medians of a page's edges by mergeable quantile sketches, held against their exact ranks: within two hundredths, of which the sketch's size promises less than one."""
    marks = profiles.medians(t.blocks, ["page_index"], {"left": "x0", "right": "x1"}, _KLL)
    return profiles.ranked(t.blocks, marks, ["page_index"], {"left": "x0", "right": "x1"}, 0.02).withColumnRenamed("n", "lines")


# ---- exports and failures


@query("s2_2_10_versioned_export", prefix("registry") + """select source_id, content_hash, case when n % 50 = 3 then 'SUPERSEDED' else source_status end as source_status from registry where n % 40 <> 7 union all select concat('NEW', n), content_hash, source_status from registry where n % 90 = 1""")
def _(t):
    """A register exported, changed and exported again into the same folder, then read back: the second run writes only the parts that have changed."""
    path = fresh(t.spark)
    first = t.registry.select("source_id", "content_hash", "source_status")
    export.export(first, path, "source_id")
    changed = t.registry.where("n % 40 <> 7").select("source_id", "content_hash", F.when(F.col("n") % 50 == 3, "SUPERSEDED").otherwise(F.col("source_status")).alias("source_status"))
    new = t.registry.where("n % 90 = 1").select(F.concat(F.lit("NEW"), "n").alias("source_id"), "content_hash", "source_status")
    export.export(changed.unionByName(new), path, "source_id")
    return export.exported(t.spark, path, "source_id string, content_hash string, source_status string")


_ATTEMPTS = "select user_id as item, event_id as seq, case when event_id % 5 = 0 then 'usable' else 'failed' end as kind, case when event_id % 5 = 0 then null when event_id % 7 = 0 then 'upstream_lost' else concat('HtmlProfileError:', event_type) end as code from events"


@query("s2_10_18_retained_failures", f"""with e as ({_ATTEMPTS}), g as (select *, count(*) filter (where kind = 'usable') over (partition by item order by seq) as epoch from e),
 f as (select item, code, epoch, min(seq) as seq from g where kind = 'failed' and code not like 'upstream%' group by 1, 2, 3), u as (select item, code, min(seq) as seq from g where code like 'upstream%' group by 1, 2)
 select item, seq, 'retained' as event, code from f union all select item, seq, 'retained', code from u union all select f.item, g.seq, 'recovered', f.code from f join g on g.item = f.item and g.kind = 'usable' and g.epoch = f.epoch + 1""")  # fmt: skip
def _(t):
    """Failures of each item that are kept, and those that a usable result has retired."""
    return failures.folded(t.spark.sql(_ATTEMPTS.replace("from events", "from {events}"), events=t.events))


# ---- newer contents

_HELD = "select doc_id as id, sha256(coalesce(lang, '')) as base, case when doc_id % 3 = 0 then sha256(coalesce(text, '')) else sha256(coalesce(lang, '')) end as current, 1 + doc_id % 4 as revision from documents where doc_id % 13 <> 5"
_OFFERED = """select doc_id as id, case when doc_id % 5 = 0 then sha256(coalesce(lang, '')) when doc_id % 7 = 0 then sha256(coalesce(text, '')) else sha256(concat('x', doc_id)) end as digest, 1 + doc_id % 4 as revision from documents where doc_id % 6 <> 1
 union all select doc_id, 'older', 0 from documents where doc_id % 2 = 0 union all select doc_id, 'ahead', 9 from documents where doc_id % 17 = 0"""


def _hashed(t, text):
    """A query of documents, with SHA-256 as Spark names it."""
    return t.spark.sql(re.sub(r"sha256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", text).replace("from documents", "from {documents}"), documents=t.documents)


@query("s2_10_7_reconciled_digests", f"""with h as ({_HELD}), o as ({_OFFERED}), b as (select id, arg_min(digest, (-revision, digest)) as offered, max(revision) as made from o group by 1)
 select coalesce(h.id, b.id) as id, case when h.id is null then 'new' when offered is null or offered = current or offered = base then 'keep' when made <> revision then 'stale' when base = current then 'adopt' else 'merge' end as choice,
  case when h.id is null or (offered <> current and offered <> base and made = revision and base = current) then offered else current end as digest from h full join b on h.id = b.id""")  # fmt: skip
def _(t):
    """Candidates against what is held, by digests: kept, adopted, stale, new, or for a person to merge."""
    return updates.reconciled(_hashed(t, _HELD), _hashed(t, _OFFERED))


@query("s2_10_24_fetched_digests", """with s as (select page_id as id, case when page_id % 9 = 0 then null when page_id % 4 = 0 then sha256(url) else sha256(html) end as digest, 5 as checked_at from pages where page_id % 10 <> 3),
 f as (select page_id as id, 7 as at, case when page_id % 7 = 0 then 500 else 200 end as status, html as content from pages where page_id % 8 <> 2), b as (select id, status, sha256(content) as now, 7 as fetched from f)
 select coalesce(s.id, b.id) as id, case when b.id is null then 'unasked' when status >= 400 or now is null then 'failed' when digest is null then 'first' when digest = now then 'unchanged' else 'changed' end as outcome,
  case when b.id is not null and status < 400 and now is not null then now else digest end as digest, case when b.id is not null and status < 400 and now is not null then 7 else checked_at end as checked_at from s full join b on s.id = b.id""")  # fmt: skip
def _(t):
    """Each source's last fetch against the digest that is stored; a failed one changes nothing."""
    k = F.col("page_id")
    digest = F.when(k % 9 == 0, None).when(k % 4 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))
    stored = t.pages.where("page_id % 10 <> 3").select(k.alias("id"), digest.alias("digest"), F.lit(5).alias("checked_at"))
    fetch = lambda at, status, content: t.pages.where("page_id % 8 <> 2").select(k.alias("id"), F.lit(at).alias("at"), status.alias("status"), content.alias("content"))
    both = fetch(7, F.when(k % 7 == 0, 500).otherwise(200), F.col("html")).unionByName(fetch(6, F.lit(200), F.col("url")))
    return updates.checked(stored, both)
