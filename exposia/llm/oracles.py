"""SQL counterparts of the numbered queries, for DuckDB on the same tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    """List of the runs of digits, letters and characters beyond ASCII of a text, A-Z lower-cased."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')"


def _feature_rows(table: str, name: str) -> str:
    return f"""
      select {name} as id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f
      from (select {name}, {_terms('text')} as w from {table})"""


# crc32 byte by byte: the table holds what eight steps do to each byte.
_CRC_TABLE = """
  select list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from (select unnest(range(256)) as b)"""
_CRC = """
  xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

IMPORTANCE = f"""
with crc as ({_CRC_TABLE}),
doc_features as ({_feature_rows('documents', 'doc_id')}),
target_features as ({_feature_rows('benchmark', 'item_id')}),
spelled as (select f, hex(f) as h from (select f from doc_features union select f from target_features)),
bucketed as (select f, {_CRC} % 10000 as bucket from spelled, crc),
corpus as (select bucket, count(*) as s from doc_features join bucketed using (f) group by bucket),
target as (select bucket, count(*) as t from target_features join bucketed using (f) group by bucket),
totals as (select (select count(*) from doc_features) as s_all, (select count(*) from target_features) as t_all),
gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::double / ((coalesce(s, 0) + 1) * (t_all + 10000))::double))::bigint as gain
  from (select unnest(range(10000)) as bucket) left join corpus using (bucket) left join target using (bucket), totals),
sums as (
  select id as doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
  from doc_features join bucketed using (f) join gains using (bucket) group by id),
scored as (
  select d.doc_id, len({_terms('d.text')}) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents d left join sums using (doc_id)),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, 25 * count(*) over () // 100 as wanted
  from scored where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight, score, (case when place <= wanted then place end)::bigint as rank
from scored left join drawn using (doc_id)"""


SEARCH = f"""
with doc_terms as (select doc_id, unnest({_terms('text')}) as term from documents),
item_terms as (select item_id, unnest({_terms('text')}) as term from benchmark),
counts as (select doc_id, term, count(*) as tf from doc_terms group by doc_id, term),
lengths as (select doc_id, count(*) as n from doc_terms group by doc_id),
totals as (select count(*) as n_all, sum(n)::bigint as l_all from lengths),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_all) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counts, totals group by term),
scores as (
  select item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))))::bigint as score
  from item_terms join counts using (term) join weights using (term) join lengths using (doc_id), totals
  group by item_id, doc_id)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 20"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"


# Documents with equal sets are one class; only classes that share a shingle are compared.
JACCARD = f"""
with recursive words as (select doc_id, {_words('text')} as w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as s from words),
classes as (select s, min(doc_id) as id, len(s) as n from sets where len(s) > 0 group by s),
rows as (select id, n, unnest(s) as x from classes),
pairs as (
  select a.id as a, b.id as b from rows a join rows b on a.x = b.x and a.id < b.id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select id as a, id as b from classes union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a as id, min(b) as component from reach group by a)
select doc_id, len(sets.s)::bigint as n_shingles, coalesce(component, doc_id) as component_id
from sets left join classes on sets.s = classes.s and len(sets.s) > 0 left join least using (id)"""


# Windows of 100 bytes as hex; all but the first occurrence of a window are removed, in runs that touch.
REPEATS = """
with docs as (select doc_id, hex(coalesce(text, '')) as h from documents),
windows as (
  select doc_id, unnest(range(length(h) // 2 - 99)) as i, h from docs where length(h) >= 200),
named as (select doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) as w from windows),
later as (
  select doc_id, i, row_number() over (partition by w order by doc_id, i) as nth from named qualify nth > 1),
marked as (
  select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as fresh from later),
numbered as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from marked),
runs as (select doc_id, min(i) as s, max(i) + 100 as e from numbered group by doc_id, run),
edges as (
  select doc_id, s, coalesce(lag(e) over (partition by doc_id order by s), 0) as before from runs
  union all
  select doc_id, length(h) // 2, coalesce((select max(e) from runs r where r.doc_id = docs.doc_id), 0) from docs),
kept as (
  select doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s, before) as k
  from edges join docs using (doc_id) group by doc_id),
removed as (select doc_id, sum(e - s) as n, count(*) as spans from runs group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed,
  coalesce(spans, 0)::bigint as n_spans, sha256(unhex(k)) as kept_sha256
from docs join kept using (doc_id) left join removed using (doc_id)"""


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, {5 * group + 1}, 5))::int >> {shift}) & 31) + 1, 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)
CAPTURES = f"""
with payloads as (select page_id, coalesce(html, '') as p, max(page_id) over (partition by coalesce(html, '')) as last from pages),
digests as (select *, sha1(p) as d from payloads)
select page_id, strlen(p)::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to
from digests"""
