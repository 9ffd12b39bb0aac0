"""SQL for DuckDB that must give the rows of the queries of the same name. p3, p8, p9 and the sequences of p5 have no SQL form."""

from palimpsest.plans.sqltext import CURRENT, squeeze, word_list

_PAIRS = f"""
with {CURRENT},
w as (select sub_collection, docid, {word_list("text")} as w from current_row),
g as (
  select sub_collection, docid, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s
  from w where len(w) >= 3
),
n as (select sub_collection, docid, count(*) as n from g group by all),
c as (
  select a.sub_collection, a.docid as docid_a, b.docid as docid_b, count(*) as c
  from g a join g b on a.sub_collection = b.sub_collection and a.s = b.s and a.docid < b.docid group by all
)
select c.sub_collection, docid_a, docid_b
from c join n x on x.sub_collection = c.sub_collection and x.docid = docid_a join n y on y.sub_collection = c.sub_collection and y.docid = docid_b
where c.c >= 0.6 * (x.n + y.n - c.c)
"""

_REPEATED = f"""
with {CURRENT},
l as (
  select sub_collection, docid, host, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from current_row where host is not null and text is not null
),
n as (select sub_collection, docid, host, cast(line_no as int) as line_no, {squeeze("lower(nfc_normalize(raw))")} as line from l),
f as (select host, line from n where line <> '' group by all having count(distinct docid) >= 8)
select sub_collection, docid, line_no from n semi join f on n.host = f.host and n.line = f.line
"""

_GRAMS = """
d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as w from heldout_item),
dg as (select doc_id, unnest(range(0, len(w) - 11)) as p, unnest(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' '))) as g from d where len(w) >= 12),
ig as (select item_id, unnest(range(0, len(w) - 11)) as q, unnest(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' '))) as g from i where len(w) >= 12)"""

ORACLE = {
    "p1_found": _PAIRS,
    "p4_found": f"""
with {CURRENT},
t as (select docid, text from current_row where {squeeze("coalesce(text, '')")} <> ''),
terms as (select docid, unnest(regexp_extract_all(lower(nfc_normalize(text)), '\\p{{L}}+')) as term from t),
c as (select term, count(*) as n_total, count(distinct docid) as n_docs from terms group by term)
select term, n_total, n_docs,
       case when n_docs <= 2 then 'rare' when n_docs > 0.5 * (select count(distinct docid) from t) then 'common' else 'kept' end as mark
from c
""",
    "p5_found": _REPEATED,
    "p6_found": """
with r as (
  select name, trim(qid) as qid, try_cast(regexp_replace(docno, '[^0-9]', '', 'g') as bigint) as docid, score
  from run_result where score is not null and not isnan(score)
),
m as (select name, qid, docid, max(score) as score from r where name is not null and qid is not null and docid is not null group by all)
select name, qid, docid, cast(row_number() over (partition by name, qid order by score desc, docid) as int) as pos
from m qualify row_number() over (partition by name, qid order by score desc, docid) <= 10
""",
    "p7_found": """
with d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') as w from heldout_item),
dg as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' ')))) as g from d where len(w) >= 12),
ig as (select item_id, unnest(list_distinct(list_transform(range(1, len(w) - 10), lambda k: list_aggregate(w[k:k + 11], 'string_agg', ' ')))) as g from i where len(w) >= 12)
select distinct doc_id, item_id from dg join ig using (g)
""",
    "p1_groups": f"""
with recursive p as ({_PAIRS}),
e as (select sub_collection, docid_a as a, docid_b as b from p union all select sub_collection, docid_b, docid_a from p),
{CURRENT},
page as (select sub_collection, docid from current_row where len({word_list("text")}) >= 3),
reach as (select sub_collection, docid, docid as other from page union select r.sub_collection, r.docid, e.b from reach r join e on e.sub_collection = r.sub_collection and e.a = r.other),
root as (select sub_collection, docid, min(other) as group_id from reach group by all),
deg as (select sub_collection, a as docid, count(*) as links from e group by all)
select sub_collection, docid, group_id, coalesce(links, 0) as links from root left join deg using (sub_collection, docid)
""",
    "p5_clean": f"""
with f as ({_REPEATED}), gone as (select sub_collection, docid, list(line_no) as gone from f group by all), {CURRENT}
select sub_collection, docid, coalesce(len(gone), 0)::int as removed,
       case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: not list_contains(gone, k)), chr(10)) end as text
from current_row left join gone using (sub_collection, docid)
""",
    "p7_matches": f"""
with {_GRAMS},
m as (select doc_id, item_id, p, q, p - row_number() over (partition by doc_id, item_id, p - q order by p) as island from dg join ig using (g)),
runs as (select doc_id, item_id, min(p) as doc_word, min(q) as item_word, count(*) + 11 as words from m group by doc_id, item_id, p - q, island)
select doc_id, item_id, words, doc_word, item_word from runs qualify row_number() over (partition by doc_id, item_id order by words desc, doc_word, item_word) = 1
""",
    "p7_clean": f"""
with {_GRAMS}
select doc_id, source from documents where doc_id not in (select doc_id from dg semi join ig using (g))
""",
}
