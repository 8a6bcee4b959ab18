"""Oracle SQL of the training-data queries that SQL can express over whole tables."""

_ID = "try_cast(nullif(regexp_extract({}, '^\\s*[Qq](\\d+)\\s*$', 1), '') as bigint)"

_PAGES = f"""
w as (select {_ID.format("id")} as key, page_no, scraped_at, text_entities from wiki_page),
cur as (select * from (select *, row_number() over (partition by key order by scraped_at desc nulls last, page_no) as r from w where key is not null) where r = 1),
pages as (select key, page_no, items from (select key, page_no, list_filter(list_transform(text_entities, lambda x: {_ID.format("x")}), lambda x: x is not null) as items from cur) where len(items) > 0),
total as (select count(*) as pages_n, avg(len(items)) as mean_length from pages),
listed as (select page_no, key, entity_no, len, count(*) as n from (select page_no, key, len(items) as len, unnest(items) as entity_no from pages) group by all),
known as (select entity_no, count(*) as m, sum(n)::bigint as occurrences from listed group by 1)
"""

_NEAR = f"""w as (select {_ID.format("id")} as key, page_no, scraped_at, embedding from wiki_page),
cur as (select * from (select *, row_number() over (partition by key order by scraped_at desc nulls last, page_no) as r from w where key is not null) where r = 1),
v as (select page_no, list_transform(embedding, lambda x: x::double / norm) as vec from (select page_no, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from cur
where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0) where norm > 0),
near as (select a.page_no as a, b.page_no as b from v a join v b on a.page_no <> b.page_no where list_inner_product(a.vec, b.vec) >= 0.8)"""
_CLUSTERS = f"""with recursive {_NEAR}, reach as (select a, b from near union select r.a, n.b from reach r join near n on n.a = r.b),
grouped as (select a as page_no, least(a, min(b)) as cluster_first from reach group by a)"""

ORACLES = {
    "p3_found": f"{_CLUSTERS} select cluster_first, page_no from grouped",
    "p3_typical": f"""{_CLUSTERS}, rho as (select a as page_no, count(*) + 1 as n from near group by a), placed as (select cluster_first, count(*) over (partition by cluster_first) as cluster_size, page_no, row_number() over (partition by cluster_first order by n desc, page_no)::integer as place from grouped join rho using (page_no))
select * from placed where place <= 3""",
    "p2_found": f"""with {_PAGES}, scored as (select page_no, l.entity_no, round(n * ln(pages_n::double / m), 6) as score from listed l join known using (entity_no), total where m > 1 and l.entity_no <> key)
select page_no, entity_no from (select *, row_number() over (partition by page_no order by score desc, entity_no) as r from scored) where r = 1""",
    "p2_weights": f"""with {_PAGES} select page_no, l.entity_no, n, m, round(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / mean_length)) * ln(1 + (pages_n - m + 0.5) / (m + 0.5)), 6) as weight from listed l join known using (entity_no), total""",
    "p5_found": f"""with {_PAGES} select entity_no, case when occurrences < 4 then 'rare' else 'common' end as mark from known, total where occurrences < 4 or m > 0.2 * pages_n""",
    "p5_ngrams": f"""with {_PAGES}, grams as (select page_no, length::integer as length, array_to_string(items[i : i + length - 1], ' ') as ngram from (select page_no, items, unnest(range(1, len(items) + 1)) as i from pages), (select unnest([1, 2, 3]) as length) where i + length - 1 <= len(items))
select ngram, length, count(*) as occurrences, count(distinct page_no) as records from grams group by ngram, length""",
    "p6_found": f"""with {_PAGES}, d as (select page_no, entity_no from listed) select entity_a, entity_b from (select a.entity_no as entity_a, b.entity_no as entity_b, count(*) as c from d a join d b on a.page_no = b.page_no and a.entity_no < b.entity_no group by all) p
join known x on x.entity_no = entity_a join known y on y.entity_no = entity_b, total where c >= 5 and c * pages_n >= 6 * x.m * y.m""",
    "p6_lift": f"""with {_PAGES}, d as (select page_no, entity_no from listed) select entity_a, entity_b, c as shared, round(c * pages_n / (x.m * y.m), 6) as lift, round(ln(c * pages_n / (x.m * y.m)) / -ln(c / pages_n), 6) as npmi
from (select a.entity_no as entity_a, b.entity_no as entity_b, count(*) as c from d a join d b on a.page_no = b.page_no and a.entity_no < b.entity_no group by all) p
join known x on x.entity_no = entity_a join known y on y.entity_no = entity_b, total where c >= 5 and c * pages_n >= 6 * x.m * y.m""",
    "p6_pairs": f"""with {_PAGES}, d as (select page_no, entity_no from listed) select entity_a, entity_b, c as shared, round(c * pages_n / (x.m * y.m), 6) as lift, round(ln(c * pages_n / (x.m * y.m)) / nullif(-ln(c / pages_n), 0), 6) as npmi
from (select a.entity_no as entity_a, b.entity_no as entity_b, count(*) as c from d a join d b on a.page_no = b.page_no and a.entity_no < b.entity_no group by all) p
join known x on x.entity_no = entity_a join known y on y.entity_no = entity_b, total""",
    "p8_sums": "select doc_id, coalesce(strlen(text), 0)::bigint as tokens, true as joined, true as whole, true as within from documents",
    "p10_cover": "select doc_id, strlen(text)::bigint as tokens, true as covered, true as within, true as shared from documents where strlen(text) > 2048",
    "p10_found": """select doc_id, case when list_max(list_transform(regexp_split_to_array(text, '[\\r\\n]'), lambda s: strlen(s))) <= 2048 then 'line'
when list_max(list_transform(regexp_split_to_array(text, '[\\r\\n\\t ]'), lambda s: strlen(s))) <= 2048 then 'space' else 'hard' end as cut_kind from documents where strlen(text) > 2048""",
}
