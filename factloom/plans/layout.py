"""Queries of pages' layout: marginals, lanes, notes at the bottom, and the whole assembly of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import layout as y
from factloom.operators import repairs as r
from factloom.plans.catalog import query
from factloom.sources.derived import prefix

_B = prefix("blocks")

_MARGINALS = _B + """, m as (select document_id // 150 as doc, document_id % 12 as page, lower(text) as text, (y0 + y1) / 2 as middle from blocks),
 c as (select doc, page, case when middle <= 72 then 'header' else 'footer' end as label, regexp_replace(text, '\\b\\d+\\b', '{n}', 'g') as template, cast(round(middle / 6) as bigint) as bucket from m where middle <= 72 or middle >= 648),
 k as (select distinct doc, label, template, bucket, page from c), i as (select *, page - row_number() over (partition by doc, label, template, bucket order by page) as base from k),
 runs as (select doc, label, template, bucket, max(n) as run from (select doc, label, template, bucket, base, count(*) as n from i group by all) group by all),
 g as (select doc, label, template, bucket, count(*) as pages, count(*) filter (where page % 2 = 0) as even, count(*) filter (where page % 2 = 1) as odd from k group by all),
 t as (select doc, count(distinct page) as total, count(distinct page) filter (where page % 2 = 0) as even_pages, count(distinct page) filter (where page % 2 = 1) as odd_pages from m group by 1)
 select doc, label, template, bucket, pages, case when pages >= greatest(2, ceil(total * 0.5)) then 'global' when even_pages >= 2 and even >= greatest(2, ceil(even_pages * 0.6)) or odd_pages >= 2 and odd >= greatest(2, ceil(odd_pages * 0.6)) then 'parity' else 'run' end as reason
 from g join t using (doc) join runs using (doc, label, template, bucket) where pages >= greatest(2, ceil(total * 0.5)) or even_pages >= 2 and even >= greatest(2, ceil(even_pages * 0.6)) or odd_pages >= 2 and odd >= greatest(2, ceil(odd_pages * 0.6)) or run >= 3"""


@query("s2_6_1_repeating_marginals", _MARGINALS)
def _(t):
    """Lines at the top or bottom tenth of a page whose template stands at one height on half of the pages, on three in five of the odd or even ones, or on three in a row."""
    b = t.blocks.select(F.floor(F.col("document_id") / 150).alias("doc"), (F.col("document_id") % 12).alias("page"), "text", "y0", "y1")
    return y.marginals(b, "doc", "page", 720.0).select("doc", "label", "template", "bucket", "pages", "reason")


@query("s2_6_10_two_lanes", _B + """, b as (select document_id // 5 as doc, row_number() over (partition by document_id // 5 order by document_id, seq) as n, id, x0, y0, x1, (x0 + x1) / 2 as middle from blocks),
 c as (select *, case when middle < 322 then 0 else 1 end as lane from b where x1 - x0 < 0.58 * 700 and (middle < 322 or middle > 378)), s as (select *, coalesce(lag(lane) over (partition by doc order by n) <> lane, false) as switch from c),
 d as (select doc, count(*) filter (where lane = 0) as a, count(*) filter (where lane = 1) as z, count(*) filter (where switch) as switches, arg_min(lane, n) as first from s group by 1),
 k as (select c.*, row_number() over (partition by doc order by n) as slot, row_number() over (partition by doc order by (lane <> first)::int, y0, x0, id) as rank from c join d using (doc) where a >= 8 and z >= 8 and switches >= 5)
 select b.id, coalesce(p.n, b.n) as place from b left join k on k.id = b.id left join k p on p.doc = k.doc and p.slot = k.rank""")  # fmt: skip
def _(t):
    """Text that bounces between two columns, at least five times and with eight blocks in each, is put into the order of its lanes; all else keeps its place."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("document_id", "seq"))
    b = t.blocks.withColumn("doc", F.floor(F.col("document_id") / 5)).withColumn("n", n)
    return y.lanes(b, "doc", "n", 700.0).select("id", "place")


_NOTES = _B + """, b as (select document_id // 50 as doc, page_index, id, x0, y0, x1, y1, case when kind = 'list' then level || ' ' || text else text end as text from blocks where kind in ('list', 'paragraph') and y0 >= 0.69 * 720),
 k as (select *, try_cast(nullif(regexp_extract(text, '^([1-9][0-9]*)\\s+\\S', 1), '') as int) as no from b), s as (select *, lag(no) over (partition by doc, page_index order by y0, id) as before from k where no is not null),
 g as (select doc, page_index, count(*) >= 2 and bool_and(before is null or no > before) as rising from s group by 1, 2), p as (select s.id, case when y0 >= 0.84 * 720 then 'bottom' else 'run' end as reason from s join g using (doc, page_index) where y0 >= 0.84 * 720 or rising),
 l as (select k.*, p.reason, lag(k.x0) over w as px, lag(k.y1) over w as py from k left join p using (id) window w as (partition by doc, page_index order by k.y0, k.x0, k.id)),
 h as (select *, case when reason is null and no is null and y0 - py between -2 and 14 and abs(x0 - px) <= 32 then 0 else 1 end as new from l), i as (select *, sum(new) over (partition by doc, page_index order by y0, x0, id rows unbounded preceding) as island from h),
 f as (select *, first_value(id) over v as head, first_value(reason) over v as head_reason from i window v as (partition by doc, page_index, island order by y0, x0, id))
 select id, head as note, case when id = head then 'note' else 'line' end as role, head_reason as reason from f where head_reason is not null"""


@query("s2_6_20_footnote_promotion", _NOTES)
def _(t):
    """Numbered notes at the bottom of a page, by place or by a rising run of at least two, with the lines that go on them."""
    text = F.when(F.col("kind") == "list", F.concat(F.col("level").cast("string"), F.lit(" "), "text")).otherwise(F.col("text"))
    b = t.blocks.where("kind in ('list', 'paragraph')").withColumn("doc", F.floor(F.col("document_id") / 50)).withColumn("text", text)
    return y.footnotes(b, ["doc", "page_index"], 720.0)


@query("s2_6_22_assembly_order")
def _(t):
    """The eleven repairs in their fixed order, in one pass over each document; each works on what the one before left, so no SQL."""
    return r.repaired(t.blocks, r.ASSEMBLY)
