"""DuckDB SQL of this subpackage's queries, where SQL can express them."""

_P9 = """
with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
ew as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from eval_item where text is not null),
eg as (select item_id, array_to_string(w[i:i+11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from ew)),
dg as (select doc_id, array_to_string(w[i:i+11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw))
"""
P9_SQL = {"p9_found": _P9 + "select distinct doc_id, item_id from dg join eg using (g)"}
