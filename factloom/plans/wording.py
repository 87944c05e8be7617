"""Queries of what kind of text a unit is."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import wording as w
from factloom.plans.catalog import query
from factloom.sources.derived import prefix

_S, _C = prefix("sentences"), prefix("codes")

_SCOPED = "regexp_matches(text, '(?i)\\b(?:requirements?|standards?|criteria|criterion|provisions?|rules?)\\s+(?:do(?:es)?\\s+not\\s+apply|appl(?:y|ies))\\s+to\\b') and not regexp_matches(text, '[?\"]')"
_GENRE = "case when regexp_matches({0}, '^For questions about [^.]+, please contact [a-z.@]+$') then 'support_contact' when regexp_matches({0}, '^[A-Z][a-z]+, (?:[A-Z]\\. ?)+[0-9]{{4}}\\. .+ [0-9]+ \\([0-9]+\\), [0-9]+-[0-9]+\\. https://\\S+$') then 'bibliographic_reference' end"


@query("s2_3_12_classification", _S + f""", d as (select *, body = '"Shall" denotes an obligation.' as defined from sentences), x as (select *, concat_ws(chr(10), nullif(trim(title), ''), case when not defined then body end) as text from d),
 m as (select *, regexp_extract_all(text, '(?i)\\b(?:shall|must|required|prohibited|should|may not)\\b') as found, kind = 'standard_indicator' as standard, starts_with(body, 'Rationale:') or title = 'Rationale' as labelled, starts_with(body, 'Indicator:') as pair from x),
 r as (select *, case when kind = 'source_table_assembly' then 1 when kind = 'coverage' then 2 when labelled and (regexp_matches(body, '\\n1\\.2\\.3 ') or standard or pair) then 3 when labelled then 4 when pair then 5 when len(found) > 0 then 6
  when {_SCOPED} then 7 when standard then 8 when defined and text = '' then 9 when kind = 'source_heading' then 10 when {_GENRE.format('text')} is not null then 11 else 12 end as rule from m)
 select id, case when rule in (1, 2, 4, 9, 10, 11) then 'context' when rule in (3, 12) then 'undetermined' else 'requirement' end as class, rule, len(found) as matches, cast(strpos(text, found[1]) - 1 as int) as start, found[1] as word from r""")  # fmt: skip
def _(t):
    """Proposals by the first of twelve rules, with the normative words found."""
    named, rule, _, found = w.classification(F.col("kind"), F.col("title"), F.col("body"))
    first = F.get("found", F.lit(0))
    rows = t.sentences.select("id", named.alias("class"), rule.alias("rule"), found.alias("found"))
    return rows.select("id", "class", "rule", F.size("found").cast("long").alias("matches"), first["start"].alias("start"), first["text"].alias("word"))


@query("s2_9_12_date_windows", _S + """, k as (select id, body, unnest(case id % 12 when 8 then [('every', 'every ' || regexp_extract(body, 'every (\\d+)', 1) || ' months'), ('first', 'first 2 years')]
  when 9 then [('annual', 'per year'), ('rolling', 'any ' || regexp_extract(body, 'any (\\d+)', 1) || ' month period'), ('annual', 'annually')] else [] end) as w from sentences)
 select id, w[1] as kind, w[2] as text, cast(strpos(body, w[2]) - 1 as int) as start, cast(strpos(body, w[2]) - 1 + length(w[2]) as int) as "end" from k""")  # fmt: skip
def _(t):
    return t.sentences.select("id", F.explode(w.window_spans(F.col("body"))).alias("w")).select("id", "w.kind", "w.text", "w.start", "w.end")


@query("s2_9_15_statements", _S + """, m as (select id, body, regexp_extract(body, '(?i)\\b(shall not|must not|may not|shall|must|should|may)\\b', 1) as word from sentences), p as (select *, strpos(body, word) - 1 as start from m where word <> ''),
 b as (select *, trim(left(body, cast(start as int)), ' ,:;' || chr(10)) as before, trim(regexp_replace(substr(body, cast(start + length(word) + 1 as int)), '^\\s*be ', ''), ' ,:;' || chr(10)) as after from p),
 a as (select *, nullif(regexp_extract(after, '^([A-Za-z][A-Za-z0-9_-]*)', 1), '') as action from b)
 select id, cast(start as int) as start, nullif(trim(regexp_extract(before, '([^.]*)$', 1)), '') as entity, lower(word) as modality, action, case when action is null then after else nullif(trim(substr(after, length(action) + 1), ' ,:;'), '') end as object,
  nullif(trim(regexp_extract(body, '(?i)\\bif\\b([^.;\\n]+)', 1)), '') as condition, nullif(trim(regexp_extract(body, '(?i)\\bunless\\b([^.;\\n]+)', 1)), '') as exception,
  nullif(regexp_extract(body, '(?i)(\\d+(?:[.,]\\d+)?\\s*(?:bar|days?|years?)\\b)', 1), '') as threshold, nullif(regexp_extract(body, '(\\d{1,2} March \\d{4})', 1), '') as date, array_to_string(regexp_extract_all(body, '\\bsection [A-Z0-9][\\w.-]*'), ';') as refs,
  sha256(start || ':' || body) as digest from a""")  # fmt: skip
def _(t):
    rows = t.sentences.select("id", F.explode(w.statement_rows(F.col("body"))).alias("s")).select("id", "s.*")
    return rows.withColumn("refs", F.array_join("refs", ";"))


@query("s2_9_18_applicability_signals", _S + f""", x as (select id, body as text from sentences) select id, case when {_SCOPED} then 1 else 0 end as scopes, case when {_SCOPED} then cast(strpos(text, 'requirements') - 1 as int) end as start, {_GENRE.format('text')} as genre from x""")
def _(t):
    rows = t.sentences.select("id", w.scope_spans(F.col("body")).alias("s"), w.genre(F.col("body")).alias("genre"))
    return rows.select("id", F.size("s").alias("scopes"), F.get("s", F.lit(0))["start"].alias("start"), "genre")


@query("s2_9_22_code_language", _C + """select id, case id % 7 when 0 then 'python' when 1 then 'json' when 2 then 'shell' when 3 then 'sql' when 4 then 'javascript' when 5 then 'shell' end as language,
 case id % 5 when 0 then replace(trim(formula), '\\operatorname{s i n}', '\\sin') when 1 then replace(regexp_replace(formula, '_\\{_\\{([0-9]+)\\}\\}', '_{\\1}'), '\\operatorname*{l i m}', '\\lim') when 2 then '\\mathop{\\sup}\\limits_{n} a_n'
  when 3 then replace(replace(formula, '[', '\\left\\lbrack '), ']', ' \\right\\rbrack') else formula end as formula from codes""")  # fmt: skip
def _(t):
    return t.codes.select("id", w.code_language(F.col("code")).alias("language"), w.plain_formula(F.col("formula")).alias("formula"))


@query("s2_9_13_bundle", _S + """select id, len(regexp_extract_all(body, '\\bsection \\d')) as refs, case id % 12 when 8 then 2 when 9 then 3 else 0 end as windows, case when id % 12 < 2 then 1 else 0 end as conditions,
 case id % 12 when 0 then 'prohibition' when 1 then 'obligation' when 8 then 'recommendation' when 10 then 'permission' when 11 then 'obligation' end as kind from sentences""")  # fmt: skip
def _(t):
    """What each sentence says in one reading: references, windows, conditions and exceptions, and its first modality but for quoted words."""
    got = t.sentences.select("id", w.bundle_of(F.col("body")).alias("b"))
    kind = F.when(F.col("id") % 12 != 5, F.get("b.modalities", F.lit(0))["kind"])
    return got.select("id", F.size("b.references").cast("long").alias("refs"), F.size("b.windows").alias("windows"), F.size("b.contexts").alias("conditions"), kind.alias("kind"))
