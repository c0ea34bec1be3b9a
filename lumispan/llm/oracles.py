"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import chat, licenses, mixing

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

EXACT_DEDUP = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
k as (select *, regexp_replace(t, '{SPACE}', '', 'g') k from d),
g as (select doc_id, k, first_value(doc_id) over (partition by k order by length(t) desc, doc_id) keep_id,
  count(*) over (partition by k) group_size from k)
select doc_id, keep_id, cast(group_size as bigint) group_size, doc_id = keep_id kept, sha256(k) text_sha256 from g
"""


def url_filter(rules: list[tuple[str, str]]) -> str:
    """Without dot segments and rare character references, which the tables' links don't have; a test holds those against a parser."""
    fits, allow = [], ", ".join(f"'{r}'" for a, r in rules if a == "allow")
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, rest = rule.partition("/")
        fits.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{rest}') then '{rule}'")
    host = lambda u: f"case when contains({u}, '://') then translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), {AZ}) else '' end"
    path = lambda u: f"case when contains({u}, '://') then regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end"
    # a node is scheme, host without a default port, path (a slash at least) and query
    key = lambda u: rf"""case when contains({u}, '://') then regexp_replace(regexp_replace(
      translate(regexp_extract({u}, '^(.*?://[^/?#]*)', 1, 's'), {AZ}), '^(http://.*):80$', '\1', 's'), '^(https://.*):443$', '\1', 's')
      || case when regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') = '' then '/' else regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's') end
      || regexp_extract({u}, '^[^?#]*(\?[^#]*)?', 1, 's') end"""  # noqa: E731
    value = lambda name: rf"""regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)"""
    return rf"""
with recursive o as (select page_id, url, html, {key("url")} k, {host("url")} host, {path("url")} path from pages),
q as (select *, case {" ".join(fits)} end rule from o),
v as (select url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)', ' ', 'g'), '(?i)<(link|meta)\b[^<>]*>', 0)) tag
  from pages where contains(url, '://') and (html ilike '%canonical%' or html ilike '%refresh%')),
t as (select url, trim(replace(case when starts_with(lower(tag), '<link') then case when list_contains(regexp_split_to_array(lower({value("rel")}), '\s+'), 'canonical') then {value("href")} end
  when lower(trim({value("http-equiv")})) = 'refresh' then regexp_extract({value("content")}, '(?i)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?["'']?\s*([^"''\s]+)', 1) end, '&amp;', '&')) x from v),
z as (select url, case when x = '' or starts_with(x, '#') then null when contains(x, '://') then x when regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
  when starts_with(x, '//') then regexp_extract(url, '^(.*?:)//', 1, 's') || x when starts_with(x, '/') then regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || x
  when starts_with(x, '?') then regexp_extract(url, '^(.*?://[^?#]*)', 1, 's') || x
  else regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || regexp_extract({path("url")} || case when {path("url")} = '' then '/' else '' end, '^(.*/)', 1, 's') || x end target from t where x is not null),
e as (select {key("url")} a, {key("target")} b, target, {host("target")} host, {path("target")} path from z where target is not null),
s as (select a, b from e where a <> b union select b, a from e where a <> b),
r(node, c) as (select a, a from s union select s.b, r.c from r join s on r.node = s.a),
g as (select node, min(c) c from r group by node),
d as (select g.c, rule from q join g on q.k = g.node union all select g.c, case {" ".join(fits)} end rule from e join g on e.b = g.node),
f as (select c, bool_or(rule in ({allow})) ok from d where rule is not null group by c)
select page_id, host, path, rule, case when rule in ({allow}) then 'allow' when rule is not null then 'block' when coalesce(ok, true) then 'allow' else 'block' end verdict
from q left join g on q.k = g.node left join f on f.c = g.c
"""


CHAT = rf"""
with c as (select distinct conv_id, turn, replace(coalesce(role, 'unknown'), '<|im_', '<| im_') role, replace(coalesce(text, ''), '<|im_', '<| im_') text
  from conversations where conv_id is not null),
t as (select conv_id, row_number() over w pos, count(*) over (partition by conv_id) n, '{chat.OPEN}' || role || chr(10) || text || '{chat.CLOSE}' || chr(10) chunk
  from c window w as (partition by conv_id order by turn nulls first, role, sha256(role || chr(10) || text))),
p as (select *, string_agg(chunk, '') over (partition by conv_id order by pos) prefix from t),
whole as (select prefix, min(conv_id) conv_id from p where pos = n group by prefix),
kept as (select conv_id from whole where prefix not in (select prefix from p where pos < n))
select conv_id, cast((pos - 1) // {chat.PART} as bigint) part, cast(count(*) as bigint) n_turns, string_agg(chunk, '' order by pos) rendered
from t where conv_id in (select conv_id from kept) group by all
"""

MIXING = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [{", ".join(f"{x:.1f}::double" for x in mixing.WEIGHTS)}][1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}] w, 2 * source_size cap from s),
r as (select *, cap::double / w ratio, sum(w) over () all_w, (sum(source_size) over ())::bigint all_size from w),
l as (select *, (all_size::double * 1.5::double - coalesce(sum(cap) over b, 0)::double) / (all_w - coalesce(sum(w) over b, 0)) level
  from r window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
p as (select source, source_size, least(cap::double, (max(level) over ()) * w) target from l),
j as (select d.doc_id, d.size, p.source_size, p.target, case when p.source_size > 0 then p.target / p.source_size else 0.0::double end rate
  from d join p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint
  + case when cast('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint)::double / 4294967296.0::double < rate - floor(rate) then 1 else 0 end) taken from j
"""


def license_scan() -> str:
    number = {name: i for i, name in enumerate(licenses.SENTENCES)}
    cases = " ".join(f"when '{text}' then {i}" for text, i in licenses.known().items())
    find = lambda units: rf"list_filter(list_transform({units}, lambda u: case trim(regexp_replace(translate(u, {AZ}), '[^a-z0-9]+', ' ', 'g')) {cases} end), lambda x: x is not null)"
    fired = []
    for name in sorted({r[0] for r in licenses.RULES}):
        hits = []
        for _, ids in (r for r in licenses.RULES if r[0] == name):
            pattern = "," + r"([0-9]+,)*".join(f"{number[i]}," for i in ids)
            hits += [f"regexp_matches({c}, '{pattern}')" for c in ("a", "b")]
        fired.append(f"case when {' or '.join(hits)} then '{name}' end")
    return rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
u as (select doc_id, {find("string_split(t, chr(10))")} a, {find(r"string_split(regexp_replace(t, '([.;:!?])[\x20\x09-\x0D]+|\n[ \t]*\n', '\1' || chr(1), 'g'), chr(1))")} b from d),
s as (select doc_id, len(list_distinct(list_concat(a, b)))::bigint n_sentences, ',' || array_to_string(a, ',') || ',' a, ',' || array_to_string(b, ',') || ',' b from u)
select doc_id, n_sentences, concat_ws(',', {", ".join(fired)}) licenses from s
"""


MINHASH = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD}') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
x as (select doc_id, len(s) n, unnest(s) g from s),
i as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c from x a join x b on a.g = b.g and a.doc_id < b.doc_id
  and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from i where 100 * c >= 75 * (na + nb - c)),
e as (select a, b from l union all select b, a from l),
r(node, c) as (select doc_id, doc_id from s union select e.b, r.c from r join e on r.node = e.a),
g as (select node, min(c) c from r group by node)
select doc_id, len(s)::bigint n_shingles, c component_id, doc_id = c kept from s join g on g.node = doc_id
"""
