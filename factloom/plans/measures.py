"""Queries of evaluation, sampling and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as x
from factloom.operators import measures as m
from factloom.plans.catalog import query
from factloom.sources.derived import prefix

_U, _B, _J, _R = prefix("units"), prefix("blocks"), prefix("judged"), prefix("registry")
_WS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("s2_5_1_status_counts", _U + "select status, count(*) as n from units group by 1")
def _(t):
    return t.units.groupBy("status").agg(F.count("*").alias("n"))


@query("s2_5_2_chapter_coverage", _U + "select chapter, count(*) as units, sum(content_ok) as content_ok, sum(requirement_ok) as requirement_ok, min(ordinal) as first from units group by 1", whole=("content_ok", "requirement_ok",))
def _(t):
    return t.units.groupBy("chapter").agg(F.count("*").alias("units"), F.sum("content_ok").alias("content_ok"), F.sum("requirement_ok").alias("requirement_ok"), F.min("ordinal").alias("first"))


@query("s2_5_3_conditional_sum", "select o_custkey as document_id, sum(case when n > 1 then n else 1 end) as published from (select o_orderkey, any_value(o_custkey) as o_custkey, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by 1) group by 1", whole=("published",))
def _(t):
    items = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(F.col("o_custkey").alias("document_id")).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(1)).alias("published"))


_BUCKET = "case when units.\"at\" < timestamp '1996-01-01' then 'historical' when status = 'rejected' then 'needs_followup' when status = 'accepted' then 'reviewed' else 'in_progress' end"


@query("s2_5_4_exclusive_buckets", _U + f"select {_BUCKET} as bucket, count(*) as n from units group by 1")
def _(t):
    b = F.when(F.col("at") < F.lit("1996-01-01").cast("timestamp"), "historical").when(F.col("status") == "rejected", "needs_followup").when(F.col("status") == "accepted", "reviewed").otherwise("in_progress")
    return t.units.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("s2_5_5_page_distinct_units", _B + "select document_id, page_index, count(distinct id) as units from blocks group by 1, 2")
def _(t):
    return t.blocks.groupBy("document_id", "page_index").agg(F.countDistinct("id").alias("units"))


@query("s2_5_12_weekly_accuracy", """with weeks as (select unnest(generate_series(date_trunc('week', (select min(ts) from events)), date_trunc('week', (select max(ts) from events)), interval 7 day))::date as week),
 e as (select date_trunc('week', ts)::date as week, count(*) as sampled, count(*) filter (where value > 50) as good, count(*) filter (where event_type = 'error') as findings from events group by 1)
 select weeks.week, coalesce(sampled, 0) as sampled, case when coalesce(sampled, 0) >= 5 and findings = 0 then good / sampled end as accuracy from weeks left join e using (week)""")  # fmt: skip
def _(t):
    e = t.events.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("sampled"), F.count_if(F.col("value") > 50).alias("good"), F.count_if(F.col("event_type") == "error").alias("findings"))
    axis = e.agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days"))).alias("week"))
    return axis.join(e, "week", "left").select("week", F.coalesce("sampled", F.lit(0)).alias("sampled"), F.when((F.coalesce("sampled", F.lit(0)) >= 5) & (F.col("findings") == 0), F.col("good") / F.col("sampled")).alias("accuracy"))


_TOK = "select doc_id as k, unnest(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) as w from documents"
_MULTI = f"""with tok as ({_TOK}), e as (select k, w, count(*) as e from tok group by 1, 2),
 a as (select k - k % 2 as k, w, count(*) as a from tok where k % 2 = 1 group by 1, 2), ee as (select * from e where k % 2 = 0),
 f as (select coalesce(ee.k, a.k) as k, coalesce(ee.w, a.w) as w, coalesce(e, 0) as e, coalesce(a, 0) as a from ee full join a on ee.k = a.k and ee.w = a.w) """


def _sides(t):
    tok = t.documents.select(F.col("doc_id").alias("k"), F.explode(F.split(x.squeezed(F.lower("text")), " ")).alias("w"))
    return tok.where("k % 2 = 0"), tok.where("k % 2 = 1").withColumn("k", F.col("k") - F.col("k") % 2)


@query("s2_5_13_multiset_f1", _MULTI + """, s as (select k, sum(e) as expected, sum(a) as actual, sum(least(e, a)) as common from f group by 1)
 select k, expected, actual, common, case when expected = 0 and actual = 0 then 1.0 when common = 0 then 0.0 else 2.0 * common / (expected + actual) end as f1 from s""", whole=("expected", "actual", "common",))  # fmt: skip
def _(t):
    s = m.multiset(*_sides(t), "k", "w")
    return s.withColumn("f1", m.f1(F.col("common"), F.col("expected"), F.col("actual")))


@query("s2_5_14_multiset_exact", _MULTI + "select k, case when sum(e) = 0 then case when sum(a) = 0 then 1.0 else 0.0 end else sum(least(e, a)) / sum(e) end as exact from f group by 1")
def _(t):
    s = m.multiset(*_sides(t), "k", "w")
    return s.select("k", F.when(F.col("expected") == 0, F.when(F.col("actual") == 0, 1.0).otherwise(0.0)).otherwise(F.col("common") / F.col("expected")).alias("exact"))


@query("s2_8_3_multiset_difference", _MULTI + "select k, w, greatest(e - a, 0) as missing, greatest(a - e, 0) as extra from f where e <> a")
def _(t):
    return m.multiset_difference(*_sides(t), "k", "w")


@query("s2_5_15_cer", """select p_partkey, case when length(p_name) = 0 then case when length(p_type) = 0 then 0.0 else 1.0 end else levenshtein(p_name, p_type) / length(p_name) end as cer from part""")
def _(t):
    return t.part.select("p_partkey", m.char_error_rate(F.col("p_name"), F.col("p_type")).alias("cer"))


@query("s2_5_15_wer")
def _(t):
    """Word error rate of neighbouring benchmark items; a dynamic program over words, so an Arrow function and no SQL."""

    @F.pandas_udf(T.DoubleType())
    def wer(expected: pd.Series, actual: pd.Series) -> pd.Series:
        return pd.Series([word_error_rate(a, b) for a, b in zip(expected, actual, strict=True)])

    b = t.benchmark
    pairs = b.alias("a").join(b.alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id"))
    return pairs.select(F.col("a.item_id"), wer(F.col("a.text"), F.col("b.text")).alias("wer"))


def word_error_rate(expected: str | None, actual: str | None) -> float:
    e, a = (expected or "").split(), (actual or "").split()
    if not e:
        return float(bool(a))
    row = list(range(len(a) + 1))
    for i, w in enumerate(e, 1):
        diagonal, row[0] = row[0], i
        for j, v in enumerate(a, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (w != v))
    return row[-1] / len(e)


@query("s2_5_16_manifest_evaluation", _J + """select coalesce(lang, 'all') as lang, coalesce(cast(toxic as varchar), 'all') as error_type, count(*) as n, avg(score) as mean_score, avg(quality) as mean_quality
 from judged group by grouping sets ((), (lang), (toxic))""")  # fmt: skip
def _(t):
    g = t.judged.groupingSets([[], [F.col("lang")], [F.col("toxic")]], F.col("lang"), F.col("toxic")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("quality").alias("mean_quality"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce(F.col("toxic").cast("string"), F.lit("all")).alias("error_type"), "n", "mean_score", "mean_quality")


_GATES = {"quality": 0.7, "max_toxic": 0.2, "score": 0.4, "coverage": 0.99}


@query("s2_5_17_threshold_gate", _J + """, v as (select 'quality' as metric, avg(quality) as value from judged union all select 'toxic', avg(toxic) from judged union all select 'score', avg(score) from judged),
 w as (select * from (values ('quality', 'quality', 0.7), ('max_toxic', 'toxic', 0.2), ('score', 'score', 0.4), ('coverage', 'coverage', 0.99)) s(name, metric, threshold))
 select name, value, threshold::double as threshold, coalesce(case when name like 'max_%' then value <= threshold else value >= threshold end, false) as passed from w left join v using (metric)""")  # fmt: skip
def _(t):
    v = t.judged.agg(F.avg("quality").alias("quality"), F.avg(F.col("toxic").cast("double")).alias("toxic"), F.avg("score").alias("score"))
    return m.gated(v.select(F.expr("stack(3, 'quality', quality, 'toxic', toxic, 'score', score) as (metric, value)")), _GATES)


@query("s2_5_18_micro_aggregate", _J + "select lang, sum(quality) as hits, count(*) as n, sum(quality) / nullif(sum(quality + toxic), 0) as precision from judged group by 1", whole=("hits",))
def _(t):
    return t.judged.groupBy("lang").agg(F.sum("quality").alias("hits"), F.count("*").alias("n"), F.try_divide(F.sum("quality"), F.sum(F.col("quality") + F.col("toxic"))).alias("precision"))


@query("s2_5_19_macro_average", _J + """, d as (select lang, case when doc_id % 5 = 0 then 'holdout' else 'active' end as split, case when count(*) > 3 then avg(quality) end as v from judged group by 1, 2)
 select split, avg(v) as macro, count(v) as groups from d group by 1""")  # fmt: skip
def _(t):
    d = t.judged.groupBy("lang", F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("active").alias("split")).agg(F.when(F.count("*") > 3, F.avg("quality")).alias("v"))
    return d.groupBy("split").agg(F.avg("v").alias("macro"), F.count("v").alias("groups"))


@query("s2_5_20_finding_precision", _J + """, k as (select *, score > 0.5 as found, row_number() over (partition by score > 0.5, lang, n_chars order by doc_id) > 1 as again from judged)
 select lang, count(*) filter (where found and quality = 1 and not again) as matched, count(*) filter (where found and again) as duplicate, count(*) filter (where found and quality = 0 and not again) as false_positive,
 count(*) filter (where found and quality = 1 and not again) / nullif(count(*) filter (where found), 0) as precision, count(*) filter (where found and quality = 1 and not again) / nullif(count(*) filter (where quality = 1), 0) as recall from k group by 1""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    found = F.col("score") > 0.5
    k = t.judged.withColumn("found", found).withColumn("again", F.row_number().over(Window.partitionBy("found", "lang", "n_chars").orderBy("doc_id")) > 1)
    hit = F.col("found") & (F.col("quality") == 1) & ~F.col("again")
    return k.groupBy("lang").agg(
        F.count_if(hit).alias("matched"), F.count_if(F.col("found") & F.col("again")).alias("duplicate"), F.count_if(F.col("found") & (F.col("quality") == 0) & ~F.col("again")).alias("false_positive"),
        F.try_divide(F.count_if(hit), F.count_if("found")).alias("precision"), F.try_divide(F.count_if(hit), F.count_if(F.col("quality") == 1)).alias("recall"))


@query("s2_5_21_wilson_calibration", _J + """, b as (select least(19, floor(score * 20))::int as bin, count(*) as n, count(*) filter (where quality = 1) as correct from judged group by 1),
 p as (select *, correct / n as p, 1.96 as z from b) select bin, n, correct, greatest(0, ((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)))::double as confidence from p""")  # fmt: skip
def _(t):
    return m.wilson(t.judged, "score", F.col("quality") == 1)


@query("s2_5_22_quality_report", _B + "select page_index, kind, level, count(*) as n, count(distinct document_id) as documents from blocks group by 1, 2, 3")
def _(t):
    return t.blocks.groupBy("page_index", "kind", "level").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query("s2_5_23_release_gate", _U + """select document_id, bool_and(content_ok = 1) and bool_and(status <> 'rejected') and count(*) >= 2 as released,
 concat_ws(',', case when not bool_and(content_ok = 1) then 'content' end, case when not bool_and(status <> 'rejected') then 'rejected' end, case when count(*) < 2 then 'size' end) as failures from units group by 1""")  # fmt: skip
def _(t):
    checks = {"content": F.bool_and(F.col("content_ok") == 1), "rejected": F.bool_and(F.col("status") != "rejected"), "size": F.count("*") >= 2}
    rows = t.units.groupBy("document_id").agg(*[c.alias(k) for k, c in checks.items()])
    bad = F.concat_ws(",", *[F.when(~F.col(k), F.lit(k)) for k in checks])
    return rows.select("document_id", (F.col("content") & F.col("rejected") & F.col("size")).alias("released"), bad.alias("failures"))


@query("s2_5_25_document_profile", _B + """, md as (select page_index, median(x0) as left_edge, median(x1) as right_edge from blocks group by 1)
 select page_index, left_edge, right_edge, count(*) filter (where abs(x0 - left_edge) / 600 <= 0.07) as near, avg(case when text like '%.' then 1.0 else 0.0 end) as punctuated from blocks join md using (page_index) group by 1, 2, 3""")  # fmt: skip
def _(t):
    md = t.blocks.groupBy("page_index").agg(F.median("x0").alias("left_edge"), F.median("x1").alias("right_edge"))
    return t.blocks.join(md, "page_index").groupBy("page_index", "left_edge", "right_edge").agg(F.count_if(F.abs(F.col("x0") - F.col("left_edge")) / 600 <= 0.07).alias("near"), F.avg(F.when(F.col("text").endswith("."), 1.0).otherwise(0.0)).alias("punctuated"))


@query("s2_5_26_template_trust", _B + "select kind, level, count(*) as support, min(x0) as x_min, max(x1) as x_max, median(x0) as x_mid, count(distinct page_index) = 3 as everywhere from blocks group by 1, 2")
def _(t):
    return t.blocks.groupBy("kind", "level").agg(F.count("*").alias("support"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.median("x0").alias("x_mid"), (F.countDistinct("page_index") == 3).alias("everywhere"))


@query("s2_5_27_spreadsheet_aggregates", """select p_brand, sum(p_size) as sum_size, max(p_retailprice) as max_price, count(nullif(p_name, '')) as counta, count(*) filter (where lower(p_type) like '%small%') as countif,
 count(*) filter (where p_size > 25 and lower(p_type) like '%brass') as countifs, coalesce(max(p_retailprice) filter (where p_size < 10), 0) as maxifs from part group by 1""", whole=("sum_size",))  # fmt: skip
def _(t):
    like = lambda c, pattern: F.lower(c).rlike("^" + pattern.replace("*", ".*").replace("?", ".") + "$")
    return t.part.groupBy("p_brand").agg(
        F.sum("p_size").alias("sum_size"), F.max("p_retailprice").alias("max_price"), F.count(F.nullif("p_name", F.lit(""))).alias("counta"), F.count_if(like("p_type", "*small*")).alias("countif"),
        F.count_if((F.col("p_size") > 25) & like("p_type", "*brass")).alias("countifs"), F.coalesce(F.max(F.when(F.col("p_size") < 10, F.col("p_retailprice"))), F.lit(0.0)).alias("maxifs"))


@query("s2_5_28_numbering_gaps", """with g as (select l_orderkey as parent, min(l_partkey % 50) as a, max(l_partkey % 50) as b, list(distinct l_partkey % 50) as seen from lineitem group by 1 having count(distinct l_partkey % 50) > 1),
 e as (select parent, unnest(range(a, b + 1)) as missing, seen from g) select parent, missing from e where not list_contains(seen, missing)""")  # fmt: skip
def _(t):
    kids = t.lineitem.select(F.col("l_orderkey").alias("parent"), (F.col("l_partkey") % 50).alias("n")).distinct()
    spans = kids.groupBy("parent").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("k")).where("k > 1")
    return spans.select("parent", F.explode(F.sequence("a", "b")).alias("n")).join(kids, ["parent", "n"], "left_anti").select("parent", F.col("n").alias("missing"))


@query("s2_5_31_signatures", "select l_orderkey, list(l_returnflag || ':' || l_linestatus order by l_linenumber) = list(o_orderstatus || ':' || l_linestatus order by l_linenumber) as same, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("v")))), lambda s: s["v"])
    left, right = F.concat_ws(":", "l_returnflag", "l_linestatus"), F.concat_ws(":", "o_orderstatus", "l_linestatus")
    return rows.groupBy("l_orderkey").agg((ordered(left) == ordered(right)).alias("same"), F.count("*").alias("n"))


@query("s2_7_1_offset_page", _U + "select id, chapter, (select count(*) from units where kind = 'requirement') as total from units where kind = 'requirement' order by ordinal, id limit 50 offset 100")
def _(t):
    return m.page(t.units.where("kind = 'requirement'"), ["ordinal", "id"], 50, 100).select("id", "chapter", "total")


@query("s2_7_2_hash_order_sample", "select doc_id, sha256('s:' || cast(doc_id as varchar)) as lot from documents order by lot limit 20")
def _(t):
    return m.hash_sample(t.documents.select("doc_id"), F.col("doc_id"), "s", 20)


@query("s2_7_3_stratified_fill", """with d as (select doc_id, quality = 0 as positive, sha256('w:' || cast(doc_id as varchar)) as lot from labels), n as (select *, row_number() over (partition by positive order by lot) as n from d)
 select doc_id, positive, lot, (positive and n > 3) or (not positive and n > 2) as filling from n order by filling, lot limit 5""")  # fmt: skip
def _(t):
    return m.stratified_with_fill(t.labels.select("doc_id", "quality"), F.col("quality") == 0, F.col("doc_id"), "w").select("doc_id", "positive", "lot", "filling")


@query("s2_7_4_weekly_sample", _U + "select id, sha256('[\"2024-01-08\",\"' || cast(document_id as varchar) || '\",\"' || cast(id as varchar) || '\"]') as lot from units where status = 'accepted' order by lot limit 5")
def _(t):
    return t.units.where("status = 'accepted'").withColumn("lot", x.digest(F.lit("2024-01-08"), F.col("document_id"), F.col("id"))).orderBy("lot").limit(5).select("id", "lot")


@query("s2_7_5_qa_sample", _R + "select source_id from registry where source_status = 'CURRENT' and upper(operator_selection_decision) = 'INCLUDE' and n not in (select o_custkey from orders where o_orderstatus = 'P') order by sha256('qa:' || source_id) limit 5")
def _(t):
    pool = t.registry.where((F.col("source_status") == "CURRENT") & (F.upper("operator_selection_decision") == "INCLUDE"))
    tasks = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("n"))
    return m.hash_sample(pool.join(tasks, "n", "left_anti"), F.col("source_id"), "qa", 5).select("source_id")


@query("s2_7_6_fifo_claim", prefix("log") + 'select item, arg_min(seq, (log."at", seq)) as claimed from log where state = \'queued\' group by 1')
def _(t):
    return t.log.where("state = 'queued'").groupBy("item").agg(F.min_by("seq", F.struct("at", "seq")).alias("claimed"))


@query("s2_7_8_pin_first", _U + "select id, row_number() over (order by case when id % 1000 = 7 then id else 9e15::bigint end, ordinal) as place from units where kind = 'table'")
def _(t):
    rows = t.units.where("kind = 'table'").select("id", "ordinal", F.when(F.col("id") % 1000 == 7, F.col("id")).alias("pin"))
    from factloom.operators.ordered import ranked

    return ranked(rows, [F.coalesce("pin", F.lit(9_000_000_000_000_000)), F.col("ordinal")], "place").select("id", "place")


@query("s2_7_9_inspection_sample", "select doc_id from documents order by sha256('batch7:' || cast(doc_id as varchar)) limit 10")
def _(t):
    return m.hash_sample(t.documents.select("doc_id"), F.col("doc_id"), "batch7", 10).select("doc_id")


@query("s2_9_1_squeeze", f"select doc_id, md5({_WS}) as squeezed from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(x.squeezed(F.col("text")).cast("binary")).alias("squeezed"))


_ASCII = "***" + '"' * 5 + "''" * 3 + "---"
_PLAIN = rf"""trim(regexp_replace(regexp_replace(regexp_replace(translate('“a” – b>=c • ' || text, '•◦▪“”„«»‘’‚–—−', '{_ASCII}'),
 '(\w)-\n(\w)', '\1\2', 'g'), '\s*(<=|>=|=|<|>)\s*', ' \1 ', 'g'), '\s+', ' ', 'g'))"""


@query("s2_9_2_typography", f"select doc_id, md5({_PLAIN}) as plain from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(x.plain_typography(F.concat(F.lit("“a” – b>=c • "), "text")).cast("binary")).alias("plain"))


_TOKENS = _B + ", t as (select id, generate_subscripts(string_split(text, ' '), 1) - 1 as pos, unnest(string_split(text, ' ')) as raw from blocks), k as (select id, pos, lower(regexp_replace(raw, '[.,]$', '')) as token from t)"


@query("s2_9_4_critical_tokens", _TOKENS + """, c as (select *, case when regexp_matches(token, '^\\d{4}-\\d{2}-\\d{2}$') then 'date' when token in ('<=', '>=', '<', '>', '=') then 'operator' when token in ('not', 'no', 'never', 'without') then 'negation'
 when token in ('shall', 'must', 'may', 'should', 'will') then 'modality' when regexp_matches(token, '^\\d+(\\.\\d+)+$') then 'section' when regexp_matches(token, '^\\d+([.,]\\d+)?$') then 'numeric' when regexp_matches(token, '^(kg|g|m|mm|cm|km|days?|hours?|%)$') then 'unit' end as class from k)
 select class, token, count(*) as n from c where class is not null group by 1, 2""")  # fmt: skip
def _(t):
    k = t.blocks.select("id", F.posexplode(F.split("text", " ")).alias("pos", "raw")).select("id", "pos", F.lower(F.regexp_replace("raw", "[.,]$", "")).alias("token"))
    return k.withColumn("class", x.critical_class(F.col("token"))).where("class is not null").groupBy("class", "token").agg(F.count("*").alias("n"))


@query("s2_9_5_conflict_typing", """select p_partkey, case when a = b then null when a = '' or b = '' then 'missing' when regexp_matches(a || b, '\\d') then 'numeric_conflict' else 'text_conflict' end as conflict
 from (select p_partkey, case when p_partkey % 7 = 0 then '' else lower(trim(p_name)) end as a, case when p_partkey % 3 = 0 then lower(p_name) else lower(p_brand) end as b from part)""")  # fmt: skip
def _(t):
    a = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.lower(F.trim("p_name")))
    b = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_name")).otherwise(F.lower("p_brand"))
    kind = F.when(a == b, None).when((a == "") | (b == ""), "missing").when(F.concat(a, b).rlike(r"\d"), "numeric_conflict").otherwise("text_conflict")
    return t.part.select("p_partkey", kind.alias("conflict"))


@query("s2_9_11_comparators", _B + ", m as (select id, lower(regexp_extract(text, '(at least|no more than|within) (\\d+)', 1)) as phrase, regexp_extract(text, '(at least|no more than|within) (\\d+)', 2) as num from blocks) select id, case phrase when 'at least' then 'gte' else 'lte' end as comparator, cast(num as double) as value from m where phrase <> ''")
def _(t):
    pattern = r"(at least|no more than|within) (\d+)"
    rows = t.blocks.select("id", F.regexp_extract("text", pattern, 1).alias("phrase"), F.regexp_extract("text", pattern, 2).alias("num")).where("phrase <> ''")
    return rows.select("id", x.comparator(F.col("phrase")).alias("comparator"), x.number(F.col("num")).alias("value"))


@query("s2_9_20_url_parts", "select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, rtrim(url, '.,;)') as url, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) as suffix from pages")
def _(t):
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.rtrim("url", F.lit(".,;)")).alias("url"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))


@query("s2_9_24_canonical_digest", "select p_partkey, sha256('{\"brand\": \"' || p_brand || '\", \"size\": ' || cast(p_size as varchar) || '}') as spaced, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || cast(p_size as varchar) || '}') as compact from part")
def _(t):
    spaced = F.format_string('{"brand": "%s", "size": %d}', "p_brand", "p_size")
    return t.part.select("p_partkey", F.sha2(spaced, 256).alias("spaced"), F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))), 256).alias("compact"))


@query("s2_9_25_structural_fingerprint", "select p_partkey, sha256('{\"name\":\"' || p_name || '\",\"type\":\"' || p_type || '\"}') as fingerprint from part")
def _(t):
    record = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("volatile"))
    return t.part.select("p_partkey", F.sha2(F.to_json(record.dropFields("volatile")), 256).alias("fingerprint"))


@query("s2_9_27_week_keys", "select date_trunc('week', timezone('Europe/Oslo', timezone('UTC', ts)))::date as week, count(*) as n from events group by 1")
def _(t):
    return t.events.groupBy(x.week_of(F.col("ts").cast("timestamp"), "Europe/Oslo").alias("week")).agg(F.count("*").alias("n"))


@query("s2_9_28_date_coercion", "select o_orderkey, try_cast(case when o_orderkey % 3 = 0 then 'soon' when o_orderkey % 3 = 1 then '' else strftime(o_orderdate, '%Y-%m-%d') end as date) as day from orders")
def _(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "soon").when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", raw.try_cast("date").alias("day"))


@query("s2_9_30_safe_ratio", "select c_nationkey, coalesce(sum(case when c_acctbal > 0 then 1 else 0 end) / nullif(count(*) filter (where c_mktsegment = 'BUILDING'), 0), 1.0) as ratio from customer group by 1")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(x.safe_ratio(F.count_if(F.col("c_acctbal") > 0), F.count_if(F.col("c_mktsegment") == "BUILDING")).alias("ratio"))


@query("s2_9_31_quantity_labels", "select o_orderkey, case when lo = n and hi = n then 'all' when lo = 1 and hi = n then 'any' when lo = 1 and hi = 1 then 'one' when hi = n - 1 then 'not all' else lo || '-' || hi end as label from (select o_orderkey, 1 + o_orderkey % 3 as lo, 1 + o_orderkey % 4 as hi, 3 as n from orders where 1 + o_orderkey % 3 <= 1 + o_orderkey % 4)")
def _(t):
    rows = t.orders.select("o_orderkey", (1 + F.col("o_orderkey") % 3).alias("lo"), (1 + F.col("o_orderkey") % 4).alias("hi"), F.lit(3).alias("n")).where("lo <= hi")
    label = F.when((F.col("lo") == F.col("n")) & (F.col("hi") == F.col("n")), "all").when((F.col("lo") == 1) & (F.col("hi") == F.col("n")), "any").when((F.col("lo") == 1) & (F.col("hi") == 1), "one").when(F.col("hi") == F.col("n") - 1, "not all")
    return rows.select("o_orderkey", label.otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))).alias("label"))


@query("s2_8_1_ordered_distinct", "select l_orderkey, (select string_agg(f, ',' order by p) from (select f, min(p) as p from (select unnest(fs) as f, generate_subscripts(fs, 1) as p) group by f)) as flags from (select l_orderkey, list(l_returnflag || l_linestatus order by l_linenumber, l_partkey, l_suppkey) as fs from lineitem group by 1)")
def _(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("f")))), lambda s: s["f"])
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_distinct(ordered), ",").alias("flags"))
