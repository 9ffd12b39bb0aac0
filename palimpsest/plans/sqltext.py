"""Pieces of DuckDB SQL that state the same expressions as ``palimpsest.functions``."""

SPACE = "[ \\t\\r\\n\\x{00A0}]"
BARE = "try_cast(regexp_replace(docid, '[^0-9]', '', 'g') as bigint)"
HOST = "nullif(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^https?://', ''), '^([^/?:]*)', 1), '^(?:www\\.|m\\.)', ''), '')"

#: Current rows of document_snapshot: docid, sub_collection, text, host.
CURRENT = f"""
current_row as (
  select docid, sub_collection, text, host from (
    select {BARE} as docid, sub_collection, text_fr as text, {HOST} as host,
           row_number() over (partition by {BARE}, sub_collection order by delivered_at desc nulls last, text_fr, url) as rn
    from document_snapshot
  ) where rn = 1 and docid is not null and sub_collection is not null
)"""


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def word_list(c: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"
