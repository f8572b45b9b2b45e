"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = f"""
with sized as (select doc_id, source, len({_WORDS})::bigint size from documents),
s as (select source, sum(size)::bigint source_size from sized group by source),
n as (select *, row_number() over (order by source asc nulls last) n from s),
w as (select *, ((n - 1) % 3 + 1)::double weight, 3.0::double * source_size cap from n),
l as (select *, cap / weight cap_level, sum(source_size::double) over () total,
        coalesce(sum(cap) over b, 0.0::double) spent,
        sum(weight) over () - coalesce(sum(weight) over b, 0.0::double) weight_left
      from w window b as (order by cap / weight, n rows between unbounded preceding and 1 preceding)),
v as (select *, (total - spent) / weight_left lev from l),
k as (select min(cap_level) first_cap, min_by(lev, n) filter (cap_level = (select min(cap_level) from v where lev <= cap_level)) water
      from v where lev <= cap_level),
t as (select v.*, k.water from v, k),
plan as (select source, source_size, case when water is null then cap else least(cap, water * weight) end target from t),
r as (select *, case when source_size > 0 then target / source_size else 0.0::double end rate from plan),
p as (select *, floor(rate) whole, rate - floor(rate) p, target - floor(rate) * source_size due from r),
d as (select sized.doc_id, sized.size, sized.source, p.* exclude (source),
        (('0x' || substr(md5('mix:' || coalesce(sized.doc_id::varchar, 'null')), 1, 13))::ubigint::double + 0.5)
          / 4503599627370496.0::double u
      from sized join p on sized.source is not distinct from p.source),
q as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end q from d),
c as (select *, coalesce(sum(size) over (partition by source order by q, doc_id, size
        rows between unbounded preceding and 1 preceding), 0) before from q),
x as (select *, whole::int + case when p > 0 and before + size / 2 <= due then 1 else 0 end copies from c)
select doc_id, size, source_size, target, (size * copies)::bigint taken, source, copies::int copies from x
"""

OP7 = r"""
with r(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from a),
u as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from b),
m as (select page_id, arg_max(r.h || r.p, length(r.h || r.p)) rule, arg_max(r.verdict, length(r.h || r.p)) verdict
      from u join r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p) group by page_id)
select u.page_id, host, path, rule, coalesce(verdict, 'allow') verdict from u left join m using (page_id)
"""

OP9 = f"""
with a as (select doc_id, coalesce(text, '') t, {_WORDS} ws from documents),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from a)),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) c from tri),
cov as (select doc_id, count(distinct i + k) n from rep, (select unnest([0, 1, 2]) k) where c >= 2 group by doc_id),
m as (select a.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines,
        coalesce(cov.n, 0)::bigint n_repeat_words,
        length(regexp_replace(t, '\\P{{L}}', '', 'g')) n_letters,
        length(regexp_replace(t, '[^!]', '', 'g')) n_shouts
      from a left join cov on cov.doc_id = a.doc_id),
n as (select *, len(lines) n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines from m),
f as (select *, ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
        + 4 * (100 * n_symbols > 30 * n_words)::bigint + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint
        + 16 * (100 * n_shouts > 50 * n_words)::bigint
        + 32 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint
        + 64 * (100 * n_letters < 40 * word_chars)::bigint)::bigint failures from n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, failures = 0 kept, failures from f
"""

#: Crc-32 of a decimal id, one bit at a time.
_CRC = """xor(4294967295::bigint, list_reduce(
    list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
    lambda c, x: list_reduce(range(8), lambda r, i: case when r % 2 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end,
                             xor(c, x)), 4294967295::bigint))"""

OP11 = f"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
c as (select conv_id, list({{'k': md5(r) || md5(x), 'n': length(x)::bigint}} order by turn nulls first) ts from t group by 1),
h as (select *, {_CRC} % 6 h from c),
m as (select h.conv_id, coalesce(b.ts[1:h.h], []) || h.ts[h.h + 1:] ts
      from h left join c b on b.conv_id = h.conv_id - (h.conv_id % 100 + 100) % 100),
p as (select conv_id, ts, unnest(range(len(ts) + 1)) d from m),
q as (select conv_id, d, d = len(ts) ends, case when d > 0 then ts[d].n else 0 end n,
        md5(list_aggregate(list_transform(ts[1:d], lambda z: z.k), 'string_agg', ',')) k,
        case when d > 0 then md5(list_aggregate(list_transform(ts[1:d - 1], lambda z: z.k), 'string_agg', ',')) end pk from p),
v as (select d, coalesce(k, '') k, case when d > 1 then pk when d = 1 then '' end pk, any_value(n) n, min(conv_id) conv_id,
        count(*) n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) ends_sha256
      from q group by all),
f as (select pk k, count(*) n_children from v where pk is not null group by 1),
w as (select v.*, coalesce(f.n_children, 0) n_children from v left join f using (k)),
u as (select distinct q.k, q.d, coalesce(a.k, '') up from q join q a on a.conv_id = q.conv_id and a.d <= q.d),
s as (select up k, count(*) filter (w.n_children = 0) n_leaves, sum((w.n_convs - 1) * w.n)::bigint saved_tokens
      from u join w on w.k = coalesce(u.k, '') group by 1)
select w.conv_id, w.d::bigint depth, pa.conv_id parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
from w join s using (k) left join v pa on pa.k = w.pk
"""

ORACLE_SQL = {"op4_pareto_mix": OP4, "op7_url_rules": OP7, "op9_rule_ledger": OP9, "op11_prefix_trie": OP11}
