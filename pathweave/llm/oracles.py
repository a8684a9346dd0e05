"""DuckDB SQL for the operators of this subpackage that SQL can express."""

HOST_RULES = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
win as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from w, unnest(range(1, len(ws) - 1)) as r(i)),
dup as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as n from win) where n > 1),
cov as (select doc_id, count(distinct i + k) as n from dup, unnest([0, 1, 2]) as s(k) group by doc_id),
ln as (select doc_id, count(*) as n, count(distinct l) as u from d, unnest(string_split(t, chr(10))) as s(l) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
f as (select w.doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
 coalesce(ln.n, 0) as n_lines, coalesce(ln.n - ln.u, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words from w left join ln using (doc_id) left join cov using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
a as (select *, base_failed or word_chars < 3 * n_words or word_chars > 10 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines as failed from b),
h as (select source, count(*)::double as n, sum(failed::int)::double as f from a where source is not null group by source),
s as (select count(*) as h, avg(f / n) as mean, avg(f / n * f / n) as square, avg(1 / n) as inverse from h),
v as (select mean, greatest(0, square - mean * mean) as between_hosts, mean * (1 - mean) * inverse as by_chance, h from s),
p as (select mean, case when between_hosts > by_chance then least(1e6, greatest(2, mean * (1 - mean) / (between_hosts - by_chance) - 1)) when mean in (0, 1) or h > 1 then 1e6 else 2 end as weight from v)
select a.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and not coalesce((h.f + mean * weight) / (h.n + weight) > 0.5, false) as kept from a left join h using (source) cross join p
"""

NEAR_DUPLICATES = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from w, unnest(range(1, greatest(len(ws) - 3, 2))) as r(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from documents d join m using (doc_id) left join n using (doc_id)
"""
