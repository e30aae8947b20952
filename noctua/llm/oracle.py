"""DuckDB SQL of the operators' queries."""

OP1 = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                  cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as h from documents),
s as (select source, sum(size)::hugeint as size, 3 * sum(size)::hugeint as cap,
             ((row_number() over (order by source nulls last) - 1) % 3 + 1)::hugeint as w from d group by source),
o as (select *, coalesce(sum(cap) over p, 0) as cb, coalesce(sum(w) over p, 0) as wb, sum(size) over () as t, sum(w) over () as wt,
             row_number() over (order by cap::double / w, source nulls last) as k
      from s window p as (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
stop as (select * from o where (t - cb) * w <= cap * (wt - wb) order by k limit 1),
g as (select o.source, o.size, case when stop.k is null or o.k < stop.k then o.cap::double
                               else o.w::double * (stop.t - stop.cb)::double / (stop.wt - stop.wb)::double end as target
      from o left join stop on true),
n as (select *, case when size > 0 then floor(target / size::double)::bigint else 0 end as whole from g),
c as (select d.*, n.size::bigint as source_size, n.target, n.whole, n.target - n.whole * n.size::double as need,
             coalesce(sum(d.size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as had
      from d join n on d.source is not distinct from n.source)
select doc_id, size, source_size, target,
       (size * (whole + case when had + size / 2.0 < need then 1 else 0 end))::bigint as taken from c
"""

RULES4 = "(values ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'block'), ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')) r(rh, rp, rule, verdict)"
OP4 = rf"""
with a as (select page_id, row_number() over () as k, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
m as (select page_id, k, host, path, max_by(struct_pack(rule := rule, verdict := r.verdict), length(rule) * 1000 + length(rh)) as best
      from b left join {RULES4} on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, best.rule as rule,
       coalesce(best.verdict, case when regexp_matches(host, '(^|\.)(cheap-pills|spam-farm|casino-win|free-bets)\.example\.(com|net|org)$') then 'block' else 'allow' end) as verdict from m
"""

OP10 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

ORACLE = {"op1_mixing": OP1, "op4_url_filter": OP4, "op10_topk_search": OP10}

OP5 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
             else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
rare as (select x from e group by x having count(*) > 1),
m as (select e.* from e semi join rare using (x)),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from m a join m b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * shared >= 85 * (na + nb - shared)),
u as (select a, b from l union select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from s union select u.b, r.c from r join u on u.a = r.doc_id)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(r.c) as component_id, s.doc_id = min(r.c) as kept from s join r using (doc_id) group by s.doc_id, s.sh
"""
ORACLE["op5_near_dedup"] = OP5

OP11 = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
n as (select *, len(u)::bigint as n, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(4)] as k from t),
c as (select *, least(k[1] % (n + 1), k[2] % (n + 1)) as low, greatest(k[1] % (n + 1), k[2] % (n + 1)) as high,
             case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or k[3] % 100 >= 50 then 'plain'
                  when k[4] % 100 < 80 then 'spm' else 'psm' end as form from n),
p as (select doc_id, text, n, form, array_to_string(u[1:low], '') as prefix, array_to_string(u[low + 1:high], '') as middle, array_to_string(u[high + 1:], '') as suffix from c),
o as (select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from p),
a as (select *, strpos(output, '<P>') as ap, strpos(output, '<S>') as s, strpos(output, '<M>') as m from o)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(output) as output_sha256,
       sha256(case form when 'plain' then output
              when 'psm' then substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
              else substr(output, ap + 3, m - ap - 3) || substr(output, m + 3) || substr(output, 4, ap - 4) end) as restored_sha256 from a
"""
ORACLE["op11_fill_middle"] = OP11

#: CRC-32 of distinct features, a byte a step, by the table of the polynomial 0xEDB88320.
OP12 = r"""
with recursive step(k, c, b) as (select i, i, 0 from range(256) r(i) union all
             select k, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b + 1 from step where b < 8),
crc as materialized (select list(c order by k) as t from step where b = 8),
both_tables as (select doc_id, false as target, text from documents union all select null, true, text from benchmark),
w as materialized (select row_number() over () as row, doc_id, target,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from both_tables),
words as (select row, unnest(ws) as a, unnest(range(len(ws))) as i from w),
runs as (select row, a, lead(a) over p as b, lead(a, 2) over p as c from words window p as (partition by row order by i)),
f as (select row, a as f from runs union all select row, a || ' ' || b from runs where b is not null
      union all select row, a || ' ' || b || ' ' || c from runs where c is not null),
counted as materialized (select row, f, count(*)::bigint as n from f group by all),
bytes as (select f, hex(encode(f)) as x from (select distinct f from counted)),
buckets as materialized (select f, xor(list_reduce([4294967295::bigint] || [cast('0x' || substr(x, 2 * i + 1, 2) as bigint) for i in range(length(x) // 2)],
                  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from bytes, crc),
sums as (select bucket, coalesce(sum(n) filter (target), 0)::double as t, coalesce(sum(n) filter (not target), 0)::double as s from counted join w using (row) join buckets using (f) group by 1),
totals as (select coalesce(sum(t), 0) as tt, coalesce(sum(s), 0) as ss from sums),
gains as (select bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as gain from sums, totals),
weights as (select row, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join buckets using (f) join gains using (bucket) group by row),
scores as (select doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double)))::bigint as score
           from w left join weights using (row) where not target),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features) as r, count(*) filter (n_words >= 20) over () as able from scores)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * able // 100 then r end as rank from ranked
"""
ORACLE["op12_resampling"] = OP12
