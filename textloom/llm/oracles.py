"""DuckDB SQL for the queries that SQL can express: URL filter and quality rules by the same method; chat formatting and
near-dedup by what their results must be (near-dedup compares all pairs that share a shingle, for small tables)."""

from __future__ import annotations

from textloom.llm import quality_rules as qr
from textloom.llm import url_filter as uf

_SPACE = r"[\x20\x09-\x0D]+"
_CLASS = ", ".join(f"len(regexp_extract_all(rest, '{p}'))" for p in qr.CLASSES.values())

QUALITY_RULES = rf"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') w, regexp_replace(text, '[a-z\x20\x09-\x0D]+', '', 'g') rest, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
df as (select lang, x, count(*) n from (select lang, unnest(list_distinct(w)) x from w where lang is not null) where length(x) <= {qr.LONGEST} group by all),
kw as (select lang, list(x order by x) known from (select *, row_number() over (partition by lang order by n desc, x) p from df) where p <= {qr.COMMON} group by lang),
vote as (select rid, arg_min(lang, (-n, lang)) lang from (select v.rid, k.lang, count(*) n from (select rid, unnest(list_distinct(w)) x from w where lang is null) v join (select lang, unnest(known) x from kw) k using (x) group by all) group by rid),
lg as (select rid, coalesce(w.lang, vote.lang) ref, w.lang from w left join vote using (rid)),
g as (select rid, i, array_to_string(w[i:i+{qr.WINDOW - 1}], ' ') g from (select rid, w, unnest(range(1, len(w) - {qr.WINDOW - 2})) i from w)),
r as (select rid, count(distinct i + k) n from (select rid, i, count(*) over (partition by rid, g) c from g), range({qr.WINDOW}) t(k) where c > 1 group by rid),
b as (select w.rid, doc_id, w.lang, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(rest)::bigint rest_chars, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words,
  [{_CLASS}] k, list_transform(known, lambda c: len(list_filter(w, lambda x: x = c))) f, ref from w join lg using (rid) left join kw on kw.lang = lg.ref left join r using (rid)),
c as (select rid, doc_id, lang, ref, n_words, word_chars, k[{list(qr.CLASSES).index("symbol") + 1}]::bigint n_symbols, n_dup_lines, n_repeat_words, (n_words < {qr.LEAST_WORDS} or 100 * n_repeat_words > {qr.REPEAT_SHARE} * n_words) base_failed,
  list_concat([word_chars - rest_chars], list_concat(k, [rest_chars - list_sum(k)])) classes, case when f is not null then list_append(f, n_words - coalesce(list_sum(f), 0)) end common from b),
ck as (select ref, i, sum(v)::double v from (select ref, unnest(classes) v, generate_subscripts(classes, 1) i from c where not base_failed and lang is not null) group by all),
cw as (select ref, i, sum(v)::double v from (select ref, unnest(common) v, generate_subscripts(common, 1) i from c where not base_failed and lang is not null) group by all),
rk as (select ref, list(v / t order by i) q from (select *, sum(v) over (partition by ref) t from ck) group by ref), rw as (select ref, list(v / t order by i) q from (select *, sum(v) over (partition by ref) t from cw) group by ref),
js as (select c.rid, case when n_words > 0 then sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform(common, lambda x: x / n_words::double), rw.q), lambda z: case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end)) / 2)) else 1 end a,
  case when word_chars > 0 then sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform(classes, lambda x: x / word_chars::double), rk.q), lambda z: case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end)) / 2)) else 1 end b from c join rk using (ref) join rw using (ref))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce((word_chars >= {qr.LEAST_CHARS} and b > {qr.CHAR_LIMIT}::double + {qr.CHAR_NOISE}::double / sqrt(word_chars)) or (n_words >= {qr.LEAST_COMMON} and a > {qr.COMMON_LIMIT}::double + {qr.COMMON_NOISE}::double / sqrt(n_words)), false) kept,
  round(b, 6) char_distance, round(a, 6) common_distance from c left join js using (rid)
"""


def url_filter(allow: list[str], block: list[str]) -> str:
    """The SQL of the URL filter for a list of rules."""
    rules = sorted([*allow, *block], key=lambda r: (len(r), r), reverse=True)
    fits = " ".join(f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'" for r in rules)
    good = "rule in (" + ", ".join(f"'{r}'" for r in allow) + ")"
    return rf"""
with u as (select row_number() over () rid, page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select rid, page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) raw from u),
p as (select rid, page_id, translate(raw, '{uf.UPPER}', '{uf.LOWER}') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) path from h),
q as (select *, case {fits} end as rule, '^^' || regexp_replace(regexp_replace(translate(host || path, '{uf.UPPER}', '{uf.LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./\-_]', '*', 'g') || '$' s from p),
g as (select rid, rule, {good} ok, substr(s, i, 3) g from (select *, unnest(range(1, length(s) - 1)) i from q)),
tri as (select ok, g, count(*) n from g where rule is not null group by all),
ab as (select ok, left(g, 2) k, sum(n) n, count(*) t from tri group by all), bc as (select ok, right(g, 2) k, sum(n) n from tri group by all), b as (select ok, left(k, 1) k, sum(n) n, count(*) t from bc group by all),
c as (select ok, right(k, 1) k, sum(n) n from bc group by all), z as (select ok, sum(n) n, count(*) t from c group by ok),
x as (select ok, g, ln(case when ab.n > 0 then (coalesce(tri.n, 0) + ab.t * p2) / (ab.n + ab.t) else p2 end) lp from (
  select z.ok, d.g, case when b.n > 0 then (coalesce(bc.n, 0) + b.t * (coalesce(c.n, 0) + z.t / {uf.A}::double) / (z.n + z.t)) / (b.n + b.t) else (coalesce(c.n, 0) + z.t / {uf.A}::double) / (z.n + z.t) end p2
  from (select distinct g from g) d cross join z left join bc on bc.ok = z.ok and bc.k = right(d.g, 2) left join b on b.ok = z.ok and b.k = substr(d.g, 2, 1) left join c on c.ok = z.ok and c.k = right(d.g, 1)) y
  left join tri using (ok, g) left join ab on ab.ok = y.ok and ab.k = left(y.g, 2)),
r as (select g, sum(case when ok then lp else -lp end) r from x group by g having count(*) = 2),
s as (select rid, sum(coalesce(r.r, 0)) / count(*) score from g left join r using (g) group by rid),
e as (select floor(score * {uf.BINS}) k, count(*) filter ({good})::double pos, count(*) filter (not ({good}))::double neg from q join s using (rid) where rule is not null group by 1),
t as (select k, sum(pos) over w / nullif(sum(pos) over (), 0) - sum(neg) over w / nullif(sum(neg) over (), 0) gain from e window w as (order by k desc rows unbounded preceding)),
edge as (select k / {uf.BINS}::double edge from t where gain is not null order by gain desc, abs(k), k desc limit 1)
select page_id, host, path, rule, case when case when rule is not null then {good} else coalesce(score >= (select edge from edge), true) end then 'allow' else 'block' end verdict, round(score, 6) score from q join s using (rid)
"""


CHAT_FORMAT = r"""
with t as (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (select conv_id, turn, role, text, coalesce(role, '') r, coalesce(text, '') b from t)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || b || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) turns_sha256, coalesce(sum(length(b)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(b, '' order by turn nulls first, role nulls first, text nulls first) filter (r = 'assistant'), '')) loss_sha256, sum(24 + length(r) + length(b) + len(regexp_extract_all(r || b, '[<\\[\\\\]')))::bigint formatted_chars from x group by conv_id
"""

NEAR_DEDUP = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
n as (select doc_id, count(*) n from s group by doc_id), c as (select a.doc_id u, b.doc_id v, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select u, v from c join n a on a.doc_id = u join n b on b.doc_id = v where 100 * k >= 75 * (a.n + b.n - k)), f as (select u, v from e union all select v, u from e),
r(node, root) as (select doc_id, doc_id from d union select f.v, r.root from r join f on f.u = r.node)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, min(r.root)::bigint component_id, d.doc_id = min(r.root) kept from d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id, n.n
"""
