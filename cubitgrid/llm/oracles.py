"""Equivalent SQL of the operators that SQL can express, for the comparing engine."""

from __future__ import annotations

from cubitgrid.llm import chat

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) both_have from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_have >= 75 * (x.n + y.n - both_have)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.id),
c as (select id, min(root) component_id from r group by id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, c.component_id, d.doc_id = c.component_id kept from documents d join c on c.id = d.doc_id left join n on n.doc_id = d.doc_id"""

EMBEDDINGS = """with recursive v as (select vec_id, label, embedding::double[] x from embeddings where label is not null and embedding is not null),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.93),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select vec_id, vec_id from embeddings union select e.b, r.root from r join e on e.a = r.id),
c as (select id, min(root) component_id from r group by id), d as (select a, count(*) n from e group by a)
select vec_id, cast(coalesce(d.n, 0) as bigint) n_links, component_id, vec_id = component_id kept from embeddings join c on c.id = vec_id left join d on d.a = vec_id"""

_CONTROL = chat.CONTROL.replace("'", "''")


def chat_windows(budget: int = 1024, history: int = 256) -> str:
    """Windows are not written out: what they hold is counted from the turns and their prefix sums."""
    return f"""with t0 as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t1 as (select *, len(regexp_extract_all(text, '{chat.PIECE}')) + {chat.MARKS} as cost, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 9 else 26 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) end as size,
  row_number() over w n from t0 window w as (partition by conv_id order by turn, role, text)),
t2 as (select *, sum(cost) over (partition by conv_id order by n) as e, max(case when role = 'system' then -n end) over (partition by conv_id) as sysn from t1),
t3 as (select *, greatest({budget} - coalesce(max(case when n = -sysn then cost end) over (partition by conv_id), 0), {budget // 2}) as room, max(case when n = -sysn then size end) over (partition by conv_id) as syss from t2),
th as (select *, floor((e - cost) / floor(room / 2)) as span, cost > floor(room / 2) as alone from t3),
tn as (select *, coalesce(span <> lag(span) over w or alone or lag(alone) over w, true) as fresh from th window w as (partition by conv_id order by n)),
t4 as (select *, count(*) filter (fresh) over (partition by conv_id order by n) as win from tn),
t5 as (select *, max(e) over (partition by conv_id, win) as span_end, max(win) over (partition by conv_id) as last_win from t4),
ws as (select conv_id, win, sum(cost) c from t5 group by all),
t6 as (select t5.*, win < last_win and span_end - (e - cost) <= least({history}, room - coalesce(ws.c, 0)) as again from t5 left join (select conv_id, win - 1 as win, c from ws) ws using (conv_id, win)),
fw as (select conv_id, win, min(n) first_n from (select conv_id, win, n from t6 union all select conv_id, win + 1, n from t6 where again) group by all),
sx as (select fw.conv_id, sum(case when sysn is not null and -sysn < first_n then syss else 0 end) extra from fw join (select distinct conv_id, sysn, syss from t6) using (conv_id) group by 1),
g as (select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0) loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) loss_sha256, sum(size * case when again then 2 else 1 end) own from t6 group by conv_id)
select conv_id, n_turns, turns_sha256, cast(loss_chars as bigint) loss_chars, loss_sha256, cast(own + extra as bigint) formatted_chars from g join sx using (conv_id)"""


DIVERGENCE = f"""with d as (select row_number() over () doc, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents),
t as (select doc, lang, source, unnest(w) term from d),
kept as (select lang, term, count(*) in_lang from t group by all having count(distinct doc) >= 3),
v as (select lang, count(*) v, sum(in_lang) n from kept group by lang),
c as (select t.lang, t.source, t.term, count(*) n from t join kept using (lang, term) group by all),
g as (select d.lang, d.source, coalesce(any_value(v.v), 0) v from d left join v using (lang) group by all),
s as (select lang, source, sum(n) n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + g.v)::hugeint p
  from g join kept k on k.lang = g.lang left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, 1 + 1000000000::hugeint * (in_lang + 1) // (n + v)::hugeint q from kept join v using (lang)),
x as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(x.f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::bigint from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p > q)
select * from (select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from r) where part = 'pair' or rank <= 200"""

FILL_IN_MIDDLE = """with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u from documents),
n as (select doc_id, t, u, len(u) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b from n),
f as (select doc_id, n, t, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form,
  array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars, case when form <> 'plain' then length(m) end::bigint middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from f"""
