"""Queries of rules, feeds and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import rules
from factloom.operators import ledger as l
from factloom.plans.catalog import query
from factloom.sources.derived import prefix
from factloom.sources.scratch import fresh
from factloom.streaming import feeds

_L, _U, _B, _R, _J = prefix("log"), prefix("units"), prefix("blocks"), prefix("registry"), prefix("judged")

# ---- rules and projections

_RULE = {
    "all": [
        {"any": [{"field": "o_orderpriority", "op": "starts_with", "value": "1"}, {"field": "o_orderpriority", "op": "in", "value": ["2-HIGH", "5-LOW"]}]},
        {"field": "o_totalprice", "op": "between", "value": [50_000, 300_000]},
        {"field": "o_orderstatus", "op": "eq", "value": "P", "not": True},
        {"any": [{"field": "o_custkey", "op": "gt", "value": 100}, {"field": "o_orderpriority", "op": "contains", "value": "URG"}]},
        {"field": "o_orderstatus", "op": "is_not_empty"},
    ]
}


@query("s2_3_17_rule_tree", "select o_orderkey from orders where (o_orderpriority like '1%' or o_orderpriority in ('2-HIGH', '5-LOW')) and o_totalprice between 50000 and 300000 and o_orderstatus <> 'P' and (o_custkey > 100 or o_orderpriority like '%URG%')")
def _(t):
    return t.orders.where(rules.compiled(_RULE, t.orders.schema)).select("o_orderkey")


@query("s2_3_18_catalog_check", "select * from (values ('good', 0), ('unknown field', 1), ('wrong operator', 1), ('empty group', 1)) v(\"case\", problems)")
def _(t):
    cases = {"good": _RULE, "unknown field": {"field": "nope", "op": "eq", "value": 1}, "wrong operator": {"field": "o_totalprice", "op": "contains", "value": "1"}, "empty group": {"all": []}}
    return t.spark.createDataFrame([(k, len(rules.checked(v, t.orders.schema))) for k, v in cases.items()], '`case` string, problems int')


@query("s2_9_29_spreadsheet_scalars", "select p_partkey, coalesce(p_retailprice / nullif(p_size % 5, 0), -1) as guarded, case when p_size > 25 and p_retailprice > 1000 then 'big' else 'small' end as class, cast(round(p_size / 50.0 * 100) as int) || '%' as share, p_brand || '-' || p_size as label, floor(p_retailprice)::bigint as whole from part")
def _(t):
    guarded = rules.if_error(F.try_divide(F.col("p_retailprice"), F.col("p_size") % 5), -1.0)
    big = F.when((F.col("p_size") > 25) & (F.col("p_retailprice") > 1000), "big").otherwise("small")
    return t.part.select("p_partkey", guarded.alias("guarded"), big.alias("class"), rules.percent(F.col("p_size") / 50).alias("share"), F.concat_ws("-", "p_brand", "p_size").alias("label"), F.floor("p_retailprice").alias("whole"))


@query("s2_3_5_task_page", _U + "select id, document_id from units where status = 'pending' and chapter like '%HIGH%' and kind <> 'coverage' and price > 100000 order by id limit 50")
def _(t):
    return t.units.where((F.col("status") == "pending") & F.col("chapter").contains("HIGH") & (F.col("kind") != "coverage") & (F.col("price") > 100_000)).orderBy("id").limit(50).select("id", "document_id")


@query("s2_3_6_free_text_search", "select doc_id from documents where contains(text, 'the of') or source = 'src3' or doc_id = 17 order by doc_id desc limit 50")
def _(t):
    return t.documents.where(F.col("text").contains("the of") | (F.col("source") == "src3") | (F.col("doc_id") == 17)).orderBy(F.desc("doc_id")).limit(50).select("doc_id")


@query("s2_3_7_material_search", _R + "select source_id, (select count(*) from registry where contains(lower(source_title), 'a') or contains(lower(source_id), '77')) as total from registry where contains(lower(source_title), 'a') or contains(lower(source_id), '77') order by source_id limit 50")
def _(t):
    from factloom.operators.measures import page

    hit = (F.instr(F.lower("source_title"), "a") > 0) | (F.instr(F.lower("source_id"), "77") > 0)
    return page(t.registry.where(hit).select("source_id"), ["source_id"])


@query("s2_3_8_json_projection", "select event_id, cast(props->>'$.k' as int) as k from events")
def _(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("s2_3_9_record_overlay", "select p_partkey, coalesce(case when p_partkey % 5 = 0 then 'edited' end, case when p_partkey % 3 = 0 then p_type end, p_name) as title, case when p_partkey % 5 = 0 then 'edit' when p_partkey % 3 = 0 then 'row' else 'original' end as origin from part")
def _(t):
    original = F.create_map(F.lit("title"), F.col("p_name"), F.lit("origin"), F.lit("original"))
    empty = F.create_map().cast("map<string,string>")
    row = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("title"), F.col("p_type"), F.lit("origin"), F.lit("row"))).otherwise(empty)
    edit = F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("title"), F.lit("edited"), F.lit("origin"), F.lit("edit"))).otherwise(empty)
    layers = F.map_from_entries(F.array_distinct(F.concat(F.map_entries(edit), F.filter(F.map_entries(row), lambda e: ~F.map_contains_key(edit, e["key"])), F.filter(F.map_entries(original), lambda e: ~F.map_contains_key(edit, e["key"]) & ~F.map_contains_key(row, e["key"])))))
    return t.part.select("p_partkey", layers.alias("m")).select("p_partkey", F.col("m")["title"].alias("title"), F.col("m")["origin"].alias("origin"))


_RES = """, s as (select id, case when id % 11 = 0 then '' else text end as a, case when id % 13 = 0 then '' when id % 7 = 0 then replace(text, 'kg', 'g') when id % 5 = 0 then replace(text, 'least', 'most') else text end as b, (id % 10) / 10.0 as ca, 0.55 as cb from blocks)
 select id, case when a = b then 'both' when b = '' then 'native' when a = '' then 'ocr' when list_sort(regexp_extract_all(a, '\\d+|kg|g ')) <> list_sort(regexp_extract_all(b, '\\d+|kg|g ')) then 'ambiguous' when cb > ca then 'ocr' else 'native' end as source from s"""


@query("s2_3_10_text_resolution", _B + _RES)
def _(t):
    a = F.when(F.col("id") % 11 == 0, "").otherwise(F.col("text"))
    b = F.when(F.col("id") % 13 == 0, "").when(F.col("id") % 7 == 0, F.replace("text", F.lit("kg"), F.lit("g"))).when(F.col("id") % 5 == 0, F.replace("text", F.lit("least"), F.lit("most"))).otherwise(F.col("text"))
    s = t.blocks.select("id", a.alias("a"), b.alias("b"), ((F.col("id") % 10) / 10.0).alias("ca"), F.lit(0.55).alias("cb"))
    critical = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\d+|kg|g "), 0))
    source = F.when(F.col("a") == F.col("b"), "both").when(F.col("b") == "", "native").when(F.col("a") == "", "ocr").when(critical("a") != critical("b"), "ambiguous").when(F.col("cb") > F.col("ca"), "ocr").otherwise("native")
    return s.select("id", source.alias("source"))


@query("s2_3_11_text_layer_routing", "select doc_id, case when len(string_split(trim(text), ' ')) >= 8 and n_chars >= 40 and len(regexp_replace(text, '[^#$%&*|]', '', 'g')) / greatest(n_chars, 1) <= 0.02 then case when lang = 'de' then 'native_with_visual_fallback' else 'native' end else 'ocr' end as route from documents")
def _(t):
    odd = F.length(F.regexp_replace("text", "[^#$%&*|]", "")) / F.greatest("n_chars", F.lit(1))
    usable = (F.size(F.split(F.trim("text"), " ")) >= 8) & (F.col("n_chars") >= 40) & (odd <= 0.02)
    return t.documents.select("doc_id", F.when(usable, F.when(F.col("lang") == "de", "native_with_visual_fallback").otherwise("native")).otherwise("ocr").alias("route"))


@query("s2_3_13_review_routing", _J + "select doc_id, case when toxic = 1 then 'strong' when score < case lang when 'en' then 0.8 when 'de' then 0.6 else 0.7 end then 'independent' else 'source' end as depth from judged")
def _(t):
    threshold = F.coalesce(F.element_at(F.create_map(F.lit("en"), F.lit(0.8), F.lit("de"), F.lit(0.6)), F.col("lang")), F.lit(0.7))
    return t.judged.select("doc_id", F.when(F.col("toxic") == 1, "strong").when(F.col("score") < threshold, "independent").otherwise("source").alias("depth"))


@query("s2_3_14_acceptance", _B + "select document_id, min(level / 3.0)::double as score, count(*) filter (where level = 3) as strong, coalesce(string_agg(distinct case when level < 2 then kind end, ',' order by case when level < 2 then kind end), '') as reasons, count(distinct kind) = 4 and min(level) >= 2 as accepted from blocks group by 1")
def _(t):
    weak = F.collect_set(F.when(F.col("level") < 2, F.col("kind")))
    return t.blocks.groupBy("document_id").agg(F.min(F.col("level") / 3.0).alias("score"), F.count_if(F.col("level") == 3).alias("strong"), F.array_join(F.array_sort(weak), ",").alias("reasons"), ((F.countDistinct("kind") == 4) & (F.min("level") >= 2)).alias("accepted"))


@query("s2_3_19_row_text_fields", _B + "select id, regexp_extract(text, '^(\\w+) (.*)$', 1) as head, regexp_extract(text, '^(\\w+) (.*)$', 2) as body from blocks where kind = 'list'")
def _(t):
    return t.blocks.where("kind = 'list'").select("id", F.regexp_extract("text", r"^(\w+) (.*)$", 1).alias("head"), F.regexp_extract("text", r"^(\w+) (.*)$", 2).alias("body"))


@query("s2_3_20_machine_assessment", _R + "select r.source_id from registry r where upper(authority_quality) = 'HIGH' and upper(scope_relevance) = 'HIGH' and source_status = 'CURRENT' and operator_selection_decision = '' and n not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(t):
    r = t.registry.where("upper(authority_quality) = 'HIGH' and upper(scope_relevance) = 'HIGH' and source_status = 'CURRENT' and operator_selection_decision = ''")
    return r.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("n")), "n", "left_anti").select("source_id")


@query("s2_3_21_task_row", _U + "select id, substr(chapter || ' / ' || kind || ' / ' || cast(document_id as varchar), 1, 20) as title, status = 'pending' and content_ok = 1 as actionable, case when content_ok = 0 then 'content' when requirement_ok = 0 then 'requirement' else 'done' end as stage from units")
def _(t):
    return t.units.select("id", F.substring(F.concat_ws(" / ", "chapter", "kind", F.col("document_id").cast("string")), 1, 20).alias("title"), ((F.col("status") == "pending") & (F.col("content_ok") == 1)).alias("actionable"), F.when(F.col("content_ok") == 0, "content").when(F.col("requirement_ok") == 0, "requirement").otherwise("done").alias("stage"))


@query("s2_3_23_note_roles", "with n as (select p_partkey, unnest(string_split('owner: ' || p_brand || '; see ' || p_type, ';')) as note, generate_subscripts(string_split('owner: ' || p_brand || '; see ' || p_type, ';'), 1) - 1 as pos from part) select p_partkey, pos, trim(note) as note, case when trim(note) like 'owner:%' then 'owner' else 'note' end as role, case when trim(note) like 'owner:%' then 1.0::double else 0.6::double end as confidence from n")
def _(t):
    n = t.part.select("p_partkey", F.posexplode(F.split(F.concat(F.lit("owner: "), "p_brand", F.lit("; see "), "p_type"), ";")).alias("pos", "note")).withColumn("note", F.trim("note"))
    named = F.col("note").startswith("owner:")
    return n.select("p_partkey", "pos", "note", F.when(named, "owner").otherwise("note").alias("role"), F.when(named, 1.0).otherwise(0.6).alias("confidence"))


@query("s2_3_24_page_set", "with u as (select o_orderkey, 'PDF pages ' || (o_custkey % 9) || ', ' || (o_custkey % 4) as locator, o_custkey % 9 as page from orders) select o_orderkey, array_to_string(list_sort(list_distinct(list_append(list_transform(string_split(regexp_extract(locator, 'PDF pages ([0-9, ]+)', 1), ', '), lambda x: cast(x as bigint)), page))), ',') as pages from u")
def _(t):
    locator = F.concat(F.lit("PDF pages "), (F.col("o_custkey") % 9).cast("string"), F.lit(", "), (F.col("o_custkey") % 4).cast("string"))
    named = F.transform(F.split(F.regexp_extract(locator, "PDF pages ([0-9, ]+)", 1), ", "), lambda x: x.cast("long"))
    pages = F.array_sort(F.array_union(named, F.array(F.col("o_custkey") % 9)))
    return t.orders.select("o_orderkey", F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"))


@query("s2_3_25_region_labels", _B + "select id, case kind when 'heading' then 'Title' when 'table' then 'Table' when 'list' then 'ListItem' else 'Text' end || '-' || seq as label from blocks")
def _(t):
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("heading", "Title", "table", "Table", "list", "ListItem")]), F.col("kind")), F.lit("Text"))
    return t.blocks.select("id", F.concat_ws("-", name, F.col("seq").cast("string")).alias("label"))


# ---- feeds and ledgers


@query("s2_10_1_change_feed", _L + "select seq, kind, (select count(*) from log where seq > 4000) > 1000 as has_more, (select max(seq) from (select seq from log where seq > 4000 order by seq limit 1000)) as next_cursor from log where seq > 4000 order by seq limit 1000")
def _(t):
    return l.feed_page(t.log.select("seq", "kind"), 4000, 1000)


@query("s2_10_2_publish_diff", """with p as (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 3 <> 0), c as (select o_orderkey as k, case when o_orderkey % 10 = 1 then 'X' else o_orderstatus end as v, o_orderkey % 17 <> 4 as alive from orders where o_orderkey % 4 <> 0)
 select k, kind, old, new from (select coalesce(p.k, c.k) as k, p.v as old, c.v as new, case when alive is null then 'withdraw' when not alive then 'suspend' when p.v is null then 'add' when p.v <> c.v then 'replace' end as kind from p full join c on p.k = c.k) where kind is not null""")  # fmt: skip
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    c = o.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 10 == 1, "X").otherwise(F.col("v")))
    return l.changes(o.where("k % 3 <> 0"), c, "k", "v", F.col("k") % 17 != 4)


@query("s2_10_3_policy_recompute", _J + "select doc_id, score >= 0.5 as before, score >= case lang when 'en' then 0.6 else 0.4 end as after from judged where (score >= 0.5) <> (score >= case lang when 'en' then 0.6 else 0.4 end)")
def _(t):
    before, after = F.col("score") >= 0.5, F.col("score") >= F.when(F.col("lang") == "en", 0.6).otherwise(0.4)
    return t.judged.select("doc_id", before.alias("before"), after.alias("after")).where("before <> after")


_REQ = "r as (select user_id as id, event_type as digest, event_id as seq from events)"


@query("s2_10_4_receipts", f"with {_REQ}, f as (select *, row_number() over w as n, first_value(digest) over w as d from r window w as (partition by id order by seq)) select seq, case when n = 1 then 'applied' when digest = d then 'replay' else 'conflict' end as outcome from f")
def _(t):
    r = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("digest"), F.col("event_id").alias("seq"))
    return l.receipts(r, ["seq"]).select("seq", "outcome")


@query("s2_10_5_revision_guard", _L + """, u as (select item, seq, value, row_number() over w as k, count(*) filter (where seq % 3 <> 0) over (w rows between unbounded preceding and 1 preceding) as expected from log window w as (partition by item order by seq)),
 r as (with recursive r as (select item, seq, value, k, expected = 0 as accepted, (expected = 0)::int as revision from u where k = 1 union all select u.item, u.seq, u.value, u.k, u.expected = r.revision, r.revision + (u.expected = r.revision)::int from r join u on u.item = r.item and u.k = r.k + 1) select * from r)
 select seq, accepted, revision::bigint as revision, case when not accepted then value end as conflict from r""")  # fmt: skip
def _(t):
    """Updates that expect as many as two thirds of those before them would make: each that is refused keeps its value, and the ones after it are held against what was accepted."""
    before = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    asked = t.log.select("item", "seq", "value", F.coalesce(F.count_if(F.col("seq") % 3 != 0).over(before), F.lit(0)).alias("expected"))
    return l.guarded(asked, "item", ["seq"], "expected").select("seq", "accepted", "revision", F.when(~F.col("accepted"), F.col("value")).alias("conflict"))


@query("s2_10_6_ledger_heads", _L + "select item, max(seq) as seq, arg_max(kind, seq) as kind, arg_max(value, seq) as value from log group by 1")
def _(t):
    return l.heads(t.log.select("item", "seq", "kind", "value"), "item", ["seq"])


@query("s2_10_7_candidate_reconcile", _R + "select source_id, case when snapshot_status = 'MISSING' then 'keep' when source_status <> 'CURRENT' then 'stale' when content_change = 'CHANGED' and current_origin = 'MANUAL' then 'merge' when content_change = 'CHANGED' then 'adopt' else 'keep' end as choice from registry")
def _(t):
    c = F.when(F.col("snapshot_status") == "MISSING", "keep").when(F.col("source_status") != "CURRENT", "stale").when((F.col("content_change") == "CHANGED") & (F.col("current_origin") == "MANUAL"), "merge").when(F.col("content_change") == "CHANGED", "adopt").otherwise("keep")
    return t.registry.select("source_id", c.alias("choice"))


_MOVES = "case f.state when '' then wanted = 'queued' when 'queued' then wanted = 'running' when 'running' then wanted in ('done', 'failed') when 'failed' then wanted = 'queued' and f.retries < 3 else wanted = 'queued' end"


@query("s2_10_8_job_machine", _L + f""", e as (select item, state as wanted, row_number() over (partition by item order by seq) as n from log), j as (
 with recursive f as (select distinct item, 0::bigint as n, '' as state, 0::bigint as retries, 0::bigint as refused from e union all
  select f.item, e.n, case when {_MOVES} then wanted else f.state end, f.retries + case when {_MOVES} and f.state = 'failed' then 1 else 0 end, f.refused + case when {_MOVES} then 0 else 1 end
  from f join e on e.item = f.item and e.n = f.n + 1) select * from f)
 select item, arg_max(state, n) as state, max(retries) as retries, max(refused) as refused from j group by 1""")  # fmt: skip
def _(t):
    """The state of each job after its events in order, kept by a stateful stream."""
    path = f"{t.sf_dir}/events.parquet"
    events = t.spark.readStream.schema(t.events.schema).parquet(path if _is_folder(t, path) else f"{t.sf_dir}/event[s].parquet")
    state = F.when(F.col("event_id") % 4 == 0, "queued").when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "done").otherwise("failed")
    stream = feeds.job_states(events.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), state.alias("wanted")))
    states = feeds.run_once(stream, fresh(t.spark))
    return states.groupBy("item").agg(F.max_by(F.struct("state", "retries", "refused"), "batch").alias("s")).select("item", "s.*")


def _is_folder(t, path: str) -> bool:
    hadoop = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@query("s2_10_9_read_projection", _L + "select kind, state, count(*) as n, max(seq) as last, sum(value) as total from log group by 1, 2")
def _(t):
    return t.log.groupBy("kind", "state").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.sum("value").alias("total"))


@query("s2_10_10_content_change", _L + "select seq, case when lag(kind) over w is null then 'INITIAL' when lag(kind) over w <> kind then 'CHANGED' else 'UNCHANGED' end as change from log window w as (partition by item order by seq)")
def _(t):
    return l.content_changes(t.log, "item", ["seq"], "kind").select("seq", "change")


@query("s2_10_12_citation_impact", _R + "select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when r.source_id is null then 'removed' when r.snapshot_status = 'MISSING' then 'unavailable' when r.content_change = 'CHANGED' then 'changed' end as impact from lineitem left join registry r on r.n = l_partkey where r.source_id is null or r.snapshot_status = 'MISSING' or r.content_change = 'CHANGED'")
def _(t):
    impact = F.when(F.col("source_id").isNull(), "removed").when(F.col("snapshot_status") == "MISSING", "unavailable").when(F.col("content_change") == "CHANGED", "changed")
    return t.lineitem.join(t.registry, F.col("l_partkey") == F.col("n"), "left").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", impact.alias("impact")).where("impact is not null")


@query("s2_10_13_lineage", "select o_orderkey as origin, 'part' as kind, count(distinct l_partkey) as n from orders join lineitem on l_orderkey = o_orderkey group by 1 union all select o_orderkey, 'supplier', count(distinct l_suppkey) from orders join lineitem on l_orderkey = o_orderkey group by 1")
def _(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = rows.select(F.col("o_orderkey").alias("origin"), F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("v")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("v")))).alias("p"))
    return pairs.groupBy("origin", "p.kind").agg(F.countDistinct("p.v").alias("n"))


@query("s2_10_18_failure_retention", _L + "select item, list_sort(list_distinct(list(kind) filter (where state = 'failed')))::varchar as failed from log group by 1 having count(*) filter (where state = 'failed') > 0")
def _(t):
    rows = t.log.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "failed", F.col("kind")))), ", ").alias("f")).where("f <> ''")
    return rows.select("item", F.concat(F.lit("["), "f", F.lit("]")).alias("failed"))


@query("s2_10_19_issue_handoff", _L + ", open_tasks as (select item, string_agg(distinct kind, ',' order by kind) as codes from log where state = 'queued' group by 1), reports as (select item, count(*) as reports from log where state = 'failed' group by 1) select item, codes is not null as known, coalesce(codes, '') as codes, reports from reports left join open_tasks using (item)")
def _(t):
    tasks = t.log.where("state = 'queued'").groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("codes"))
    reports = t.log.where("state = 'failed'").groupBy("item").agg(F.count("*").alias("reports"))
    return reports.join(tasks, "item", "left").select("item", F.col("codes").isNotNull().alias("known"), F.coalesce("codes", F.lit("")).alias("codes"), "reports")


@query("s2_10_20_delivery_capture", "select o_custkey, count(*) as orders, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ';' order by o_orderkey)) as digest from orders group by 1")
def _(t):
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: F.concat_ws(":", s["o_orderkey"].cast("string"), s["o_orderstatus"]))
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sha2(F.array_join(items, ";"), 256).alias("digest"))


@query("s2_10_22_decision_processing", _R + ", d as (select l_partkey as n, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as decision from lineitem group by 1) select source_id, case decision when 'R' then 'EXCLUDE' when 'A' then 'INCLUDE' else 'PENDING' end as decided, download_status = 'SUCCESS' and decision <> 'N' as archived from registry join d using (n)")
def _(t):
    d = t.lineitem.groupBy(F.col("l_partkey").alias("n")).agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("decision"))
    x = F.col("decision")
    return t.registry.join(d, "n").select("source_id", F.when(x == "R", "EXCLUDE").when(x == "A", "INCLUDE").otherwise("PENDING").alias("decided"), ((F.col("download_status") == "SUCCESS") & (x != "N")).alias("archived"))


@query("s2_10_24_update_check", _R + "select source_id, case when download_status = 'FAIL' then 'failed' when source_status <> 'CURRENT' then 'skipped' when content_change = 'CHANGED' then 'changed' else 'unchanged' end as outcome from registry")
def _(t):
    c = F.when(F.col("download_status") == "FAIL", "failed").when(F.col("source_status") != "CURRENT", "skipped").when(F.col("content_change") == "CHANGED", "changed").otherwise("unchanged")
    return t.registry.select("source_id", c.alias("outcome"))


