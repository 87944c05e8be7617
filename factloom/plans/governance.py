"""Queries over the register of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import governance as g
from factloom.plans.catalog import query
from factloom.sources.derived import prefix


def today():
    return F.to_date(F.lit("2024-12-01"))


_S = ("authority_quality", "scope_relevance", "version_currency", "traceability", "access_permission")
_LOW = " or ".join(f"upper(trim({s})) = 'LOW'" for s in _S)
_HIGH = " and ".join(f"upper(trim({s})) = 'HIGH'" for s in _S)
_GEAR = "(document_type = 'Equipment manual / OEM instruction' or requirement_role = 'Asset-specific normative')"
SELECTION = f"""case when upper(operator_selection_decision) = 'EXCLUDE' or {_LOW} then 'EXCLUDE'
 when trim(issuer) = '' or acquisition_channel = '' or upper(provenance_status) in ('', 'UNVERIFIED') then 'PENDING'
 when acquisition_channel = 'OFFICIAL_WEBSITE' and official_url = '' then 'PENDING'
 when {_GEAR} and (source_family <> 'Manufacturer / supplier' or applicability_reference = '' or inclusion_rationale = '') then 'PENDING'
 when upper(operator_selection_decision) <> 'INCLUDE' or download_status <> 'SUCCESS' or snapshot_status <> 'STORED' then 'PENDING'
 when {_HIGH} then 'INCLUDE' else 'PENDING' end"""
_HAND = "coalesce(manual_update_date >= last_attempt_at and snapshot_status = 'STORED' and current_origin = 'MANUAL' and manual_updated_by <> '', false)"
_IMPACT = "coalesce(manual_update_date >= coalesce(last_success_at, last_attempt_at) and manual_updated_by <> '', false)"
_SILENT = f"(source_status <> 'CURRENT' or upper(operator_selection_decision) = 'EXCLUDE' or (operator_selection_decision = '' and {SELECTION} = 'EXCLUDE'))"
_CASES = [
    ("snapshot_status = 'MISSING'", "MISSING_FILE", "coalesce(last_attempt_at, current_snapshot_date)"),
    (f"download_status = 'FAIL' and not {_HAND}", "DOWNLOAD_FAILURE", "last_attempt_at"),
    (f"download_status = 'PAYWALL_BLOCKED' and not {_HAND}", "PAYWALL_BLOCKED", "last_attempt_at"),
    ("official_url = ''", "MISSING_OFFICIAL_URL", "current_snapshot_date"),
    ("retrieval_url = ''", "MISSING_RETRIEVAL_URL", "current_snapshot_date"),
    (f"update_model = 'ROLLING' and content_change = 'CHANGED' and not {_IMPACT}", "ROLLING_CONTENT_CHANGED", "last_success_at"),
    ("provenance_status = 'UNVERIFIED'", "PROVENANCE_UNVERIFIED", "current_snapshot_date"),
    (f"{_GEAR} and applicability_reference = ''", "APPLICABILITY_UNCONFIRMED", "current_snapshot_date"),
]
_CODE = f"case when {_SILENT} then null " + " ".join(f"when {c} then '{n}'" for c, n, _ in _CASES) + " end"
_SINCE = f"case when {_SILENT} then null " + " ".join(f"when {c} then {d}" for c, _, d in _CASES) + " end"
_ELIGIBLE = "(source_status = 'CURRENT' and (download_status <> 'PAYWALL_BLOCKED' or (retrieval_url <> '' and access_permission = 'HIGH')))"
_R = prefix("registry")
_QUEUE = f"""technical as (select source_id, {_CODE} as code, {_SINCE} as since from registry),
 live as (select * from registry where official_url <> '' and upper(operator_selection_decision) <> 'EXCLUDE'),
 doubled as (select source_id, 'DUPLICATE_OFFICIAL_URL' as code, current_snapshot_date as since from live
   where official_url in (select official_url from live where source_status = 'CURRENT' group by 1 having count(*) > 1)),
 queue as (select *, greatest(datediff('day', since, date '2024-12-01'), 0) as days_raw from
   (select * from technical where code is not null union all select * from doubled)),
 q as (select source_id, code, since, case when since is null then 0 else days_raw end as days_open from queue)"""
_SEVERITY = "case when days_open > 30 then 'OVERDUE' else 'OPEN' end"
_GATES = f"""concat_ws(',', case when {SELECTION} <> 'INCLUDE' then 'effective' end, case when upper(operator_selection_decision) <> 'INCLUDE' then 'operator_selection_decision' end,
 case when snapshot_status <> 'STORED' then 'snapshot_status' end, case when source_status <> 'CURRENT' then 'source_status' end, case when download_status <> 'SUCCESS' then 'download_status' end)"""


@query("s2_3_1_effective_selection", _R + f"select {SELECTION} as selection, count(*) as n from registry group by 1")
def _(t):
    return t.registry.groupBy(g.effective_selection().alias("selection")).agg(F.count("*").alias("n"))


@query("s2_3_2_update_eligibility", _R + f"select source_id from registry where {_ELIGIBLE}")
def _(t):
    return t.registry.where(g.eligible()).select("source_id")


@query("s2_3_3_review_trigger", _R + f"select source_id, {_CODE} as code, {_SINCE} as since from registry where {_CODE} is not null")
def _(t):
    return t.registry.select("source_id", g.review_trigger().alias("t")).where("t is not null").select("source_id", "t.code", "t.since")


_FINGER = "substr(sha256(concat_ws('|', official_url, retrieval_url, trim(issuer), " + ", ".join(_S) + ", operator_selection_decision)), 1, 16)"


@query("s2_3_4_selection_trigger", _R + f""", f as (select *, {_FINGER} as fp, case when operator_selection_decision = '' then 'PENDING' else upper(operator_selection_decision) end as decision,
 concat_ws(', ', {', '.join(f"case when upper({s}) <> 'HIGH' then '{s}' end" for s in _S)}) as unresolved from registry where source_status = 'CURRENT'),
 h as (select source_id, case when n % 4 = 0 then fp else 'old' end as seen, date '2024-10-15' + cast(n % 40 as int) as completed_at from f where n % 2 = 0),
 j as (select f.*, h.completed_at, coalesce(h.seen = f.fp, false) and h.completed_at is not null as same from f left join h using (source_id) where decision <> 'EXCLUDE' and (decision <> 'INCLUDE' or unresolved <> ''))
 select source_id, decision, unresolved, case when same then completed_at else coalesce(current_snapshot_date, last_success_at) end as since from j
 where not (same and datediff('day', completed_at, date '2024-12-01') <= 30)""")  # fmt: skip
def _(t):
    r = t.registry
    history = r.where("n % 2 = 0").select("source_id", F.when(F.col("n") % 4 == 0, g.state_fingerprint()).otherwise("old").alias("fingerprint"), F.expr("date '2024-10-15' + cast(n % 40 as int)").alias("completed_at"))
    return g.selection_trigger(r, history, today())


@query("s2_3_15_required_gates", _R + f"select source_id, {_GATES} as failed, {_GATES} = '' as accepted from registry")
def _(t):
    return g.gate_failures(t.registry)


@query("s2_1_3_gated_manifest", _R + f""", wanted as (select source_id from registry where n % 3 = 0 union all select 'ZZ000001')
 select w.source_id, case when r.source_id is null then 'missing_or_duplicate_source_id' when {_GATES} <> '' then 'gates:' || {_GATES} else '' end as reason,
 r.source_id is not null and {_GATES} = '' as accepted from wanted w left join registry r using (source_id)""")  # fmt: skip
def _(t):
    wanted = t.registry.where("n % 3 = 0").select("source_id").unionByName(t.spark.sql("select 'ZZ000001' as source_id"))
    return g.manifest(t.registry, wanted)


@query("s2_3_16_identity_validation", _R + """select source_id, case when not regexp_matches(source_id, '^AB\\d{6}$') then 'id'
 when retrieval_url <> '' and not ends_with(retrieval_url, 'doc' || cast(n as varchar) || '.html') then 'url' else 'ok' end as verdict from registry""")  # fmt: skip
def _(t):
    return g.identity_issues(t.registry)


@query("s2_5_6_discovery_stage", _R + """select 'duplicate_url' as finding, official_url as subject, count(*) as n from registry where official_url <> '' group by 2 having count(*) > 1
 union all select 'missing_url', source_id, 1 from registry where official_url = '' union all select 'provenance_gap', source_id, 1 from registry where trim(issuer) = '' or provenance_status = ''""")  # fmt: skip
def _(t):
    return g.discovery(t.registry)


@query("s2_5_7_monitoring_stage", _R + f"""select update_model, acquisition_channel, count(*) as sources, count(*) filter (where {_ELIGIBLE}) as eligible,
 count(*) filter (where {_ELIGIBLE} and retrieval_url <> '') as downloadable from registry group by 1, 2""")  # fmt: skip
def _(t):
    return g.monitoring(t.registry)


_ISSUES = " union all ".join(f"select source_id, '{s}' as field, 'missing_or_invalid' as issue from registry where upper({s}) not in ('HIGH', 'MEDIUM', 'LOW')" for s in _S)


@query("s2_5_8_assessment_stage", _R + f"""{_ISSUES} union all select source_id, 'inclusion_rationale', 'missing' from registry where inclusion_rationale = ''
 union all select source_id, 'source_family', 'equipment_source_not_manufacturer' from registry where {_GEAR} and source_family <> 'Manufacturer / supplier'
 union all select source_id, 'applicability_reference', 'equipment_applicability_missing' from registry where {_GEAR} and applicability_reference = ''""")  # fmt: skip
def _(t):
    return g.rating_issues(t.registry)


@query("s2_5_9_metadata_stage", _R + "select download_status, count(*) as n, count(*) filter (where snapshot_status = 'STORED') as stored, count(distinct content_hash) as contents from registry group by 1")
def _(t):
    return t.registry.groupBy("download_status").agg(F.count("*").alias("n"), F.count_if(F.col("snapshot_status") == "STORED").alias("stored"), F.countDistinct("content_hash").alias("contents"))


@query("s2_5_11_review_queue", _R + f", {_QUEUE} select source_id, code, since, case when since is null then null else days_open end as days_open, case when since is not null and days_open > 30 then 'OVERDUE' else 'OPEN' end as severity from q")
def _(t):
    q = g.review_queue(t.registry, today())
    return q.withColumn("days_open", F.when(F.col("since").isNotNull(), F.col("days_open")))


@query("s2_5_11_consolidation", _R + f""", {_QUEUE} select source_id, string_agg(distinct code, ',' order by code) as codes, min(since) as since, max(days_open) as days_open,
 case when bool_or({_SEVERITY} = 'OVERDUE') then 'OVERDUE' else 'OPEN' end as severity, count(*) as n from q group by 1""")  # fmt: skip
def _(t):
    return g.consolidated(g.review_queue(t.registry, today()))


@query("s2_5_10_dashboard", _R + f""", {_QUEUE}, c as (select source_id, max(days_open) as d from q group by 1)
 select 'selection' as section, {SELECTION} as label, count(*) as n from registry group by 2 union all select 'channel', acquisition_channel, count(*) from registry group by 2
 union all (select 'priority', source_id, d from c order by d desc, source_id limit 5)""")  # fmt: skip
def _(t):
    return g.dashboard(t.registry, today())


@query("s2_7_7_ranked_url", _R + """, urls as (select p_size_key as issuer, url from (select trim(issuer) as p_size_key, unnest([official_url, retrieval_url, official_url || '.pdf']) as url from registry) where url <> ''),
 k as (select *, case lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) when 'html' then 0 when 'xlsx' then 1 when 'pdf' then 2 else 3 end as r from urls)
 select issuer, arg_min(url, (r, length(url), url)) as url, min(r) as rank from k group by 1""")  # fmt: skip
def _(t):
    urls = t.registry.select(F.trim("issuer").alias("issuer"), F.explode(F.array("official_url", "retrieval_url", F.concat("official_url", F.lit(".pdf")))).alias("url")).where("url <> ''")
    return g.preferred_url(urls, "issuer", {"html": 0, "xlsx": 1, "pdf": 2})


@query("s2_8_2_content_hash_dedup", _R + """, known as (select content_hash from registry where n % 5 = 0)
 select content_hash, min(source_id) as source_id, count(*) as copies from registry where content_hash not in (select content_hash from known) group by 1""")  # fmt: skip
def _(t):
    r = t.registry
    known = r.where("n % 5 = 0").select("content_hash")
    return r.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("source_id").alias("source_id"), F.count("*").alias("copies"))


@query("s2_10_14_interval_scheduling", _R + """select issuer, max(last_success_at) as last_success, max(last_success_at) is null or datediff('day', max(last_success_at), date '2024-12-01') > 60 as due from registry group by 1""")
def _(t):
    last = F.max("last_success_at")
    return t.registry.groupBy("issuer").agg(last.alias("last_success"), (last.isNull() | (F.datediff(today(), last) > 60)).alias("due"))


@query("s2_6_24_latest_check_time", _R + """select source_id, greatest(last_attempt_at, last_success_at, manual_update_date) as checked from registry""")
def _(t):
    return t.registry.select("source_id", F.greatest("last_attempt_at", "last_success_at", "manual_update_date").alias("checked"))


@query("s2_9_21_title_classifier", _R + """select source_id, case when lower(document_type) like '%manual%' then 'instruction' when lower(document_type) like '%regulation%' then 'law' when lower(document_type) like '%standard%' then 'norm' else 'other' end as family from registry""")
def _(t):
    d = F.lower("document_type")
    return t.registry.select("source_id", F.when(d.contains("manual"), "instruction").when(d.contains("regulation"), "law").when(d.contains("standard"), "norm").otherwise("other").alias("family"))


@query("s2_9_26_record_fingerprint", _R + "select source_id, substr(sha256(concat_ws('|', trim(issuer), trim(official_url), trim(source_title))), 1, 20) as fingerprint from registry")
def _(t):
    return t.registry.select("source_id", F.substring(F.sha2(F.concat_ws("|", F.trim("issuer"), F.trim("official_url"), F.trim("source_title")), 256), 1, 20).alias("fingerprint"))
