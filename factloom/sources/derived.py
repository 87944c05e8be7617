"""Tables of the document-evidence model, projected from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    # a register of sources, one per part
    "registry": """
select concat('AB', lpad(cast(p_partkey as string), 6, '0')) as source_id, p_partkey as n, p_name as source_title,
  case when p_partkey % 11 = 0 then ' ' else concat('Issuer ', cast(p_size as string)) end as issuer,
  case p_partkey % 3 when 0 then 'OFFICIAL_WEBSITE' when 1 then 'MANUAL' else 'LICENSED' end as acquisition_channel,
  case p_partkey % 13 when 0 then 'UNVERIFIED' when 1 then '' else 'Verified' end as provenance_status,
  case when p_partkey % 17 = 0 then '' else concat('https://n', cast(p_size as string), '.example/doc', cast(p_partkey % 400 as string)) end as official_url,
  case when p_partkey % 19 = 0 then '' else concat('https://n', cast(p_size as string), '.example/doc', cast(p_partkey as string), '.html') end as retrieval_url,
  case p_partkey % 12 when 0 then 'Equipment manual / OEM instruction' when 1 then 'Regulation' when 2 then 'Standard' else 'Guidance' end as document_type,
  case p_partkey % 15 when 0 then 'Asset-specific normative' else 'Normative' end as requirement_role,
  case when p_partkey % 4 = 0 then 'Manufacturer / supplier' else 'Authority' end as source_family,
  case when p_partkey % 5 = 0 then '' else 'unit 7' end as applicability_reference,
  case when p_partkey % 8 = 0 then '' else 'in scope' end as inclusion_rationale,
  case p_partkey % 10 when 0 then 'EXCLUDE' when 1 then '' else 'include' end as operator_selection_decision,
  case p_partkey % 7 when 0 then 'FAIL' when 1 then 'PAYWALL_BLOCKED' else 'SUCCESS' end as download_status,
  case p_partkey % 23 when 0 then 'MISSING' else 'STORED' end as snapshot_status,
  case p_partkey % 29 when 0 then 'SUPERSEDED' else 'CURRENT' end as source_status,
  case p_partkey % 2 when 0 then 'ROLLING' else 'FIXED' end as update_model,
  case p_partkey % 5 when 1 then 'CHANGED' else 'UNCHANGED' end as content_change,
  case p_partkey % 6 when 1 then 'MANUAL' else 'AUTOMATIC' end as current_origin,
  case when p_partkey % 9 < 4 then 'ann' else '' end as manual_updated_by,
  case p_partkey % 31 when 0 then 'LOW' when 1 then 'MEDIUM' else 'HIGH' end as authority_quality,
  case p_partkey % 37 when 0 then 'LOW' when 1 then '' else 'HIGH' end as scope_relevance,
  case p_partkey % 41 when 0 then 'MEDIUM' else 'high' end as version_currency,
  case p_partkey % 43 when 0 then 'unknown' else 'HIGH' end as traceability,
  case p_partkey % 5 when 0 then 'MEDIUM' else 'HIGH' end as access_permission,
  date '2024-01-01' + cast(p_partkey % 300 as int) as last_attempt_at,
  case when p_partkey % 4 <> 1 then date '2023-12-01' + cast(p_partkey % 320 as int) end as last_success_at,
  case when p_partkey % 6 <> 2 then date '2023-11-01' + cast(p_partkey % 310 as int) end as current_snapshot_date,
  case when p_partkey % 3 <> 0 then date '2024-03-01' + cast(p_partkey % 200 as int) end as manual_update_date,
  sha256(cast(p_partkey % 700 as string)) as content_hash
from {part}""",
    # review units of documents: an order is a unit, a customer its document
    "units": """
select o_orderkey as id, o_custkey as document_id, o_orderkey as ordinal, o_orderpriority as chapter,
  case o_orderkey % 5 when 0 then 'context' when 1 then 'requirement' when 2 then 'table' when 3 then 'coverage' else 'requirement' end as kind,
  case when o_totalprice > 60000 then 1 else 0 end as content_ok, case when o_totalprice > 150000 then 1 else 0 end as requirement_ok,
  case o_orderstatus when 'F' then 'accepted' when 'O' then 'pending' else 'rejected' end as status,
  cast(o_custkey % 40 as int) as page_index, o_totalprice as price, o_orderdate as at
from {orders}""",
    # a unit depends on the unit of half its number, but for the roots, one in seven; some depend on one another
    "edges": """
select o_orderkey as unit_id, cast(floor(o_orderkey / 2) as bigint) as dependency_id from {orders} where o_orderkey > 1 and o_orderkey % 7 < 6
union all select o_orderkey, o_orderkey + 1 from {orders} where o_orderkey % 97 = 0
union all select o_orderkey + 1, o_orderkey from {orders} where o_orderkey % 97 = 0""",
    # text blocks with boxes on pages: a line of an order is a block, the order its document
    "blocks": """
select l_orderkey as document_id, l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as seq, cast(l_partkey % 3 as int) as page_index,
  cast(l_partkey % 100 as double) * 5 as x0, cast(l_suppkey % 90 as double) * 8 as y0,
  cast(l_partkey % 100 as double) * 5 + 20 + l_quantity * 4 as x1, cast(l_suppkey % 90 as double) * 8 + 12 as y1,
  case l_linenumber % 4 when 1 then 'heading' when 2 then 'paragraph' when 3 then 'list' else 'table' end as kind,
  cast(1 + l_partkey % 3 as int) as level,
  concat('Carrier ', case l_partkey % 5 when 0 then 'must' when 1 then 'shall not' when 2 then 'may' when 3 then 'should' else 'will' end,
    ' ship at least ', cast(cast(l_quantity as int) as string), ' kg within ', cast(l_linenumber * 10 as string), ' days.') as text
from {lineitem}""",
    # clauses of long documents in sections of six: heading, caption, text, figure, text, footnote
    "clauses": """
select document_id, document_id * 100000 + ordinal as id, ordinal, scope,
  case slot when 0 then 'heading' when 1 then 'table' when 3 then 'figure' when 5 then 'footnote' else 'paragraph' end as kind,
  case slot when 0 then concat('Section ', cast(scope + 1 as string), ' On rates') when 1 then concat('Table ', cast(scope % 3 + 1 as string), ' Rates of ', flag)
    when 2 then concat('See Table ', cast(quantity % 4 + 1 as string), ' and Fig. ', cast(scope % 2 + 1 as string), '; sections ', cast(line as string), ' and ', cast(line + 1 as string), ' apply.') when 3 then concat('Figure ', cast(scope % 2 + 1 as string), ' Flow')
    when 4 then concat('The table ', case when scope % 2 = 0 then 'above' else 'below' end, ' and annex B hold notes [^', cast(line as string), '].') else concat(cast(line as string), ' Note on ', flag) end as text
from (select l_partkey as document_id, ordinal, cast(floor((ordinal - 1) / 6) as bigint) as scope, (ordinal - 1) % 6 as slot, l_returnflag as flag, cast(l_quantity as int) as quantity, cast(l_linenumber as int) as line
  from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as ordinal from {lineitem}) o) s""",
    # pages of statutes in the chapter template, of registers and of articles: one for each part
    "statutes": """
select p_partkey as page_id, concat('<html><head><title>', p_name, '</title></head><body>',
  case when p_partkey % 5 <> 4 then concat('<table class="meta"><tr><th>Title</th><td>', p_name, '</td></tr><tr><th>Size</th><td>', cast(p_size as string), '</td></tr></table>') else '' end,
  case when p_partkey % 5 < 2 then concat('<div class="chapter wide"><h2>Chapter ', cast(p_size as string), '</h2><p class="paragraph">Keep ', p_type, ' as <a data-id="law-', cast(p_partkey as string),
    '" href="/l">law</a> and <a data-id="reg-', cast(p_size as string), '">rule</a> say.</p><ol><li>one<ol><li>', p_type, '</li></ol></li><li>two</li></ol></div>') else '' end,
  case when p_partkey % 5 = 2 or p_partkey % 25 = 1 then concat('<article><h1>', p_brand, '</h1></article>') else '' end,
  case when p_partkey % 4 = 0 then concat('<p>loose ', p_type, '</p>') else '' end,
  '<script>var a = 1;</script><div class="footnote" id="fn', cast(p_size as string), '">Note ', p_brand, '</div></body></html>') as html
from {part}""",
    # sentences of sources, with the kind and title of the unit that holds each
    "sentences": """
select p_partkey as id,
  case when p_partkey % 13 = 0 then 'coverage' when p_partkey % 17 = 0 then 'source_table_assembly' when p_partkey % 11 = 0 then 'standard_indicator' when p_partkey % 7 = 0 then 'source_heading' else 'paragraph' end as kind,
  case when p_partkey % 19 = 0 then 'Rationale' when p_partkey % 24 = 5 then '' else p_name end as title,
  case p_partkey % 12
    when 0 then concat('The ', p_name, ' operator shall not release water unless the pressure exceeds ', cast(p_size as string), ' bar by 12 March 2024, see section 4.2.')
    when 1 then concat('Operators must inspect each ', lower(p_type), ' unit within ', cast(p_size as string), ' days if the alarm sounds.')
    when 2 then concat('These requirements do not apply to farms of less than ', cast(p_size as string), ' tonnes.')
    when 3 then concat('Rationale: ', p_name, ' feed keeps the water clean.')
    when 4 then 'For questions about feed, please contact help@example.org.'
    when 5 then '"Shall" denotes an obligation.'
    when 6 then concat('Smith, J. A. 2019. On ', p_name, ' feed. Journal of Feed ', cast(p_size as string), ' (3), 45-67. https://doi.example/', cast(p_partkey as string))
    when 7 then concat('Indicator: ', p_name, chr(10), 'Requirement: ', cast(p_size as string), ' percent')
    when 8 then concat('Samples should be taken every ', cast(p_size as string), ' months and during the first 2 years.')
    when 9 then concat('The limit is 5 mg per year in any ', cast(p_size as string), ' month period and is read annually.')
    when 10 then concat('Staff may use the ', lower(p_type), ' line.')
    else concat('Rationale: ', p_name, chr(10), '1.2.3 The operator must act.') end as body
from {part}""",
    # snippets of code and formulas
    "codes": """
select p_partkey as id, case p_partkey % 7
    when 0 then concat('def f():', chr(10), '  return "', p_brand, '"') when 1 then concat(chr(123), '"name": "', p_name, '"', chr(125)) when 2 then concat('cd /srv', chr(10), 'grep ', p_type, ' log')
    when 3 then concat('SELECT * FROM ', p_type) when 4 then concat('const x = "', p_name, '";') when 5 then concat('#!/bin/bash', chr(10), 'run ', p_type) else p_name end as code,
  case p_partkey % 5
    when 0 then concat(' ', chr(92), 'operatorname', chr(123), 's i n', chr(125), ' x + ', cast(p_size as string)) when 1 then concat('x_', chr(123), '_', chr(123), cast(p_size as string), chr(125), chr(125), ' + ', chr(92), 'operatorname*', chr(123), 'l i m', chr(125))
    when 2 then concat(chr(92), 'sup_', chr(123), 'n', chr(125), ' a_n') when 3 then concat('a [', cast(p_size as string), ', ', chr(92), 'ldots] b') else concat(chr(92), 'operatorname', chr(123), 'f o o', chr(125), ' y') end as formula
from {part}""",
    # the words of documents, each with its place
    "judged": """
select d.doc_id, d.lang, d.text, d.n_chars, l.quality, l.toxic,
  cast((d.doc_id * 37) % 1000 as double) / 1000 as score
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    # a log of events with a sequence, an item and its state
    "log": """
select event_id as seq, user_id as item, event_type as kind, value, ts as at,
  case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'done' else 'failed' end as state,
  cast(event_id % 3 as int) as revision
from {events}""",
}


def needed(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", FIXTURES[name])


def sql(name: str) -> str:
    """A fixture's text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name])


def prefix(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({sql(n)})" for n in names) + " "


class Tables:
    """The given tables, and those projected from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            text = FIXTURES[name].replace("sha256(cast(p_partkey % 700 as string))", "sha2(cast(p_partkey % 700 as string), 256)")
            return self.spark.sql(text, **{n: getattr(self, n) for n in set(needed(name))})
        raise AttributeError(name)
