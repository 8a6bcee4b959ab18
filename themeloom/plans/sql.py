"""Common table expressions shared by the oracle SQL (DuckDB dialect)."""

from __future__ import annotations


def idno(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '^\\s*[Qq](\\d+)\\s*$', 1), '') as bigint)"


def _texts(column: str) -> str:
    return f"""select rec, '{column}' as field, k as item_key, pos - 1 as item_pos, case json_type(e) when 'VARCHAR' then e ->> '$' when 'OBJECT' then
coalesce(case when json_type(e, '$.value') = 'VARCHAR' then e ->> '$.value' end, case when json_type(e, '$.id') = 'VARCHAR' then e ->> '$.id' end, case when json_type(e, '$.mainsnak.datavalue.value.id') = 'VARCHAR' then e ->> '$.mainsnak.datavalue.value.id' end) end as t
from (select rec, k, unnest(list) as e, generate_subscripts(list, 1) as pos from (select rec, k, case when json_type(v) = 'ARRAY' then from_json(v, '["json"]') else [v] end as list
from (select rec, unnest(json_keys(j)) as k, j, json_extract(j, '$."' || replace(unnest(json_keys(j)), '"', '\\"') || '"') as v from (select rec, {column}::json as j from recs where json_valid({column}) and json_type({column}) = 'OBJECT')))) where e is not null"""


def items(columns: list[str]) -> str:
    """CTE `items`(rec, field, item_key, item_pos, item) from a CTE `recs`(rec, *columns)."""
    parts = " union all ".join(_texts(c) for c in columns)
    return f"items as (select rec, field, item_key, item_pos, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as item from ({parts}) where regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '')"


ALL_RECORDS = "recs as (select rec_no as rec, labels, descriptions, aliases, properties from wikidata_summary)"
RECORDS = f"""recs as (select * from (select {idno("id")} as rec, rec_no, labels, descriptions, aliases, properties, enwiki, row_number() over (partition by {idno("id")} order by seen_at desc nulls last, rec_no) as r
from wikidata_summary where {idno("id")} is not null) where r = 1)"""
PAGES = f"""curp as (select * from (select {idno("id")} as num, page_no, enwiki, site, anchors, text_entities, embedding, text, page, row_number() over (partition by {idno("id")} order by scraped_at desc nulls last, page_no) as r
from wiki_page where {idno("id")} is not null) where r = 1)"""
KB = f"""{RECORDS}, {items(["labels", "descriptions", "aliases", "properties"])},
labels_ as (select rec as num, item_key as lang, min_by(item, item_pos) as label from items where field = 'labels' group by all),
descriptions_ as (select rec as num, item_key as lang, min_by(item, item_pos) as description from items where field = 'descriptions' group by all),
aliases_ as (select rec as num, item_key as lang, item_pos as pos, item as alias from items where field = 'aliases'),
props_ as (select rec as num, item_key as property, item_pos as pos, {idno("item")} as value from items where field = 'properties' and {idno("item")} is not null)"""
ENTITY_VECTORS = f"""{PAGES}, vecs as (select num, list_transform(embedding, lambda x: x::double / norm) as vec from (select num, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm
from curp where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0) where norm > 0)"""
TOKENS = f"""toks as (select doc, tok, pos from (select page_no as doc, unnest(l) as tok, generate_subscripts(l, 1) as pos from (select page_no, list_filter(list_transform(text_entities, lambda x: {idno("x")}), lambda x: x is not null) as l from curp)))"""

P1 = f"with {ALL_RECORDS}, {items(['labels', 'aliases', 'properties'])} select rec as rec_no, field, item_key, item_pos, item from items"

_P7 = f"""with recursive {RECORDS}, {items(["properties"])}, given as (select item_key as link, rec as node, min({idno("item")}) as parent from items where item_key in ('subclass_of', 'located_in') and {idno("item")} is not null group by all),
linked as (select link, node, case when parent in (select rec from recs) then parent end as parent from given),
nodes as (select * from linked union all select distinct link, parent, null::bigint from linked l where parent is not null and not exists (select 1 from linked x where x.link = l.link and x.node = l.parent)),
walk as (select link, node, node as up, 0 as d from nodes union all select w.link, w.node, n.parent, d + 1 from walk w join nodes n on n.link = w.link and n.node = w.up where n.parent is not null and d < 200 and (n.parent <> w.node or d = 0)),
ends as (select link, node, max_by(up, d) as up, max(d) as d from walk group by all),
cyc as (select distinct w.link, w.node from walk w join nodes n on n.link = w.link and n.node = w.up where n.parent = w.node)"""
P7 = f"""{_P7} select e.link, e.node as node_no, case when n.parent is null then 'tree' when c.node is not null then 'on_cycle' else 'below_cycle' end as kind, case when n.parent is null then e.up else 0 end as root_no, case when n.parent is null then e.d else -1 end::bigint as depth
from ends e join nodes n on n.link = e.link and n.node = e.up left join cyc c on c.link = e.link and c.node = e.node"""
P7_PATHS = f"""{_P7}, trees as (select e.link, e.node from ends e join nodes n on n.link = e.link and n.node = e.up where n.parent is null)
select t.link, t.node as node_no, string_agg(w.up, '/' order by w.d desc) as path, (select count(*) from walk x where x.link = t.link and x.up = t.node and x.d > 0) as n_descendants from trees t join walk w on w.link = t.link and w.node = t.node group by t.link, t.node"""
P7_DESCENDANTS = f"""{_P7}, trees as (select e.link, e.node from ends e join nodes n on n.link = e.link and n.node = e.up where n.parent is null)
select t.link, w.up as node_no, t.node as descendant_no, w.d::bigint as distance from trees t join walk w on w.link = t.link and w.node = t.node where w.d > 0"""
P7_CYCLES = f"""{_P7}, low as (select link, node, min(up) as low from walk group by all)
select e.link, e.node as node_no, case when c.node is not null then 'on_cycle' else 'below_cycle' end as kind, c.node is not null and low.low = e.node as back_edge
from ends e join nodes n on n.link = e.link and n.node = e.up left join cyc c on c.link = e.link and c.node = e.node join low on low.link = e.link and low.node = e.node where n.parent is not null"""
_FIELDS = " union all ".join(f"select rec, '{c}' as field, {c} as t from recs" for c in ("labels", "aliases", "properties"))
_AT = "json_extract(j, '$.\"' || replace(k, '\"', '\\\"') || '\"')"
_TREE = f"""with recursive {ALL_RECORDS}, docs as (select rec, field, t::json as j from ({_FIELDS}) where json_valid(t) and json_type(t) = 'OBJECT'),
tree as (select rec, field, [i - 1] as label, '*' as path, case when json_type(v) = 'ARRAY' then v else json_array(v) end as j from (select rec, field, i, {_AT} as v from (select rec, field, j, unnest(json_keys(j)) as k, generate_subscripts(json_keys(j), 1) as i from docs))
union all select rec, field, list_append(label, i - 1), path || step, v from (
select rec, field, label, path, '.' || k as step, i, {_AT} as v from (select *, unnest(json_keys(j)) as k, generate_subscripts(json_keys(j), 1) as i from tree where json_type(j) = 'OBJECT')
union all select rec, field, label, path, '[]', generate_subscripts(e, 1), unnest(e) from (select *, from_json(j, '["json"]') as e from tree where json_type(j) = 'ARRAY'))),
kinds as (select *, case coalesce(json_type(j), 'NULL') when 'OBJECT' then 'object' when 'ARRAY' then 'list' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind from tree)"""
P1_NODES = f"""{_TREE} select rec as rec_no, field, path as schema_path, array_to_string(label, '.') as label, array_to_string(label[: len(label) - 1], '.') as parent, kind, case when kind = 'string' then j ->> '$' when kind in ('number', 'boolean') then j::varchar end as text from kinds"""
P1_TABLES = f"{_TREE} select field, path as schema_path, kind, count(*) as nodes from kinds group by all"
