"""Queries on full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.snapshots import page_changes
from palimpsest.plans.sqltext import CURRENT, squeeze
from palimpsest.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return page_changes(table(spark, root, "document_snapshot")).select("sub_collection", "docid", "change")


def p2_changes(spark: SparkSession, root: str) -> DataFrame:
    out = page_changes(table(spark, root, "document_snapshot"))
    return out.selectExpr("sub_collection", "docid", "change", "array_join(fields, ',') as fields")


_CHANGES = f"""
with {CURRENT},
r as (select docid, sub_collection, {squeeze("nfc_normalize(coalesce(text, ''))")} as t from current_row),
o as (select sub_collection, lag(sub_collection) over (order by sub_collection) as before from (select distinct sub_collection from r)),
p as (select o.sub_collection, r.docid, r.t from o join r on r.sub_collection = o.before),
n as (select r.* from r join o using (sub_collection) where o.before is not null)
select coalesce(n.sub_collection, p.sub_collection) as sub_collection, coalesce(n.docid, p.docid) as docid,
       case when p.docid is null then 'added' when n.docid is null then 'removed' else 'changed' end as change
from n full join p on n.docid = p.docid and n.sub_collection = p.sub_collection
where p.docid is null or n.docid is null or p.t <> n.t
"""

QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes}
ORACLE = {
    "p2_found": _CHANGES,
    "p2_changes": f"select *, case when change = 'changed' then 'text_fr' end as fields from ({_CHANGES})",
}
