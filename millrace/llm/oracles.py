"""DuckDB texts of what the queries must give, for those that SQL can express."""

from __future__ import annotations

#: The digest in base32: five hexadecimal digits are four letters.
OP1 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
q as (select *, max(page_id) over (partition by h, payload_bytes) as newest from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(h, cast(5 * (k // 4) + 1 as bigint), 5) as bigint) >> (15 - 5 * (k % 4))) & 31) as bigint), 1)), '') as payload_digest,
  case when page_id = newest then 'response' else 'revisit' end as record_type,
  case when page_id <> newest then newest end as refers_to
from q
"""

#: A kind's matches and the pieces between them alternate; running sums of lengths are positions.
_FOUND = """select rid, '{name}' as kind, {rank} as rank, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint), 'size': length(m[i]), 'text': m[i], 'value': v[i]}})) as x
  from (select rid, string_split_regex(text, '{pattern}') as g, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as v from d)"""
_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_KINDS = [
    ("assign", _KEYS + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]+", 0),
    ("hex", "[0-9a-f]{16,}", 0),
    ("live", "[A-Za-z0-9_+/-]{24,}", 0),
]
OP2 = (
    "with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as owner, concat_ws('/', source, lang) as repo from documents),\nfound as (\n"
    + "\nunion all\n".join(_FOUND.format(name=name, rank=k, pattern=pattern, group=group) for k, (name, pattern, group) in enumerate(_KINDS))
    + """),
kept as (select rid, kind, rank, x.start as start, x.start + x.size as stop, x.value as value from found
  where length(x.value) >= case kind when 'assign' then 12 when 'access' then 18 when 'hex' then 16 else 24 end
    and (kind <> 'live' or (regexp_matches(x.value, '[a-z]') and regexp_matches(x.value, '[A-Z]') and regexp_matches(x.value, '[0-9]')))),
owned as (select value, count(distinct owner) as owners, count(distinct (owner, repo)) as repos from kept join d using (rid) group by value),
marked as (select * from kept join owned using (value) where kind <> 'live' or (owners = 1 and repos <= 2)),
per as (select rid, count(*) filter (where kind = 'assign') as a, count(*) filter (where kind = 'access') as c, count(*) filter (where kind = 'hex') as x,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (where kind <> 'live') as base,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
  count(*) filter (where owners = 1 and repos <= 2) as live, count(*) filter (where owners >= 3 or repos >= 6) as example, max(owners) as most, max(repos) as wide from marked group by rid)
select doc_id, coalesce(a, 0) as n_assign, coalesce(c, 0) as n_access, coalesce(x, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(live, 0) as n_live, coalesce(example, 0) as n_example, coalesce(most, 0) as most_owners, coalesce(wide, 0) as most_repos
from d left join per using (rid)
"""
)

#: The checksum takes half a byte at a time, the low half first, from a table of sixteen that its rule makes.
OP3 = """
with t as (select list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), '.'), lambda x: cast('0x' || x as bigint))), lambda c, x: xor(c >> 4, t[cast(1 + (xor(c, x) & 15) as bigint)])), 4294967295) as text_crc32
  from documents, t),
o as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) as rn from d),
s as (select *, 2 * sum(size) over (order by rn) - size as middle, sum(size) over () as total from o),
p as (select *, cast(least(15, middle * 16 // (2 * total)) as int) as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard, rn - min(rn) over (partition by shard) as slot, cast(null as int) as grown_shard from p
"""

#: Documents of equal sets are one class; classes that share a shingle, with the size of what they share; then all that links reach.
OP5 = """
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (select doc_id, case when len(w) = 0 then cast([] as varchar[]) when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
c as (select min(doc_id) as c, k from (select doc_id, md5(array_to_string(list_sort(s), chr(10))) as k, s from s where len(s) > 0) group by k),
m as materialized (select doc_id, c from s join c on k = md5(array_to_string(list_sort(s), chr(10))) where len(s) > 0),
e as materialized (select doc_id, len(s) as n, unnest(s) as x from s where doc_id in (select c from c)),
links as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(least(m.c, r.b), m.c, s.doc_id) as component_id
from s left join m on m.doc_id = s.doc_id left join (select a, min(b) as b from reach group by a) r on r.a = m.c
"""

ORACLE = {"op1_warc": OP1, "op2_secrets": OP2, "op3_sharding": OP3, "op5_jaccard": OP5}
