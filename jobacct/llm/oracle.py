"""DuckDB SQL of the operators that SQL can express.

Decoded layers (1), learnt scores (3, 7, 8), containment joins over lines and
paragraphs (4), token paths (5) and page texts (10) are held against
brute-force versions, the public library or held-out labels in the tests."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
BLACK = r"'[^\x20\x09-\x0D]+'"

OP2 = f"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all({LOWER}, {ALNUM}) words from documents),
b as (select item_id::varchar item, regexp_extract_all({LOWER}, {ALNUM}) words from benchmark),
bn as (select item, words, least(len(words), 10) n from b where len(words) > 0),
bw as (select distinct item, n, array_to_string(words[i : i + n - 1], ' ') w
       from (select *, unnest(range(1, len(words) - n + 2)) i from bn)),
lens as (select distinct n from bw),
dw as (select rid, n, i, array_to_string(words[i : i + n - 1], ' ') w
       from (select rid, words, n, unnest(range(1, len(words) - n + 2)) i from d, lens where len(words) >= n)),
hit as (select dw.rid, dw.i, dw.n, bw.item from dw join bw on dw.w = bw.w and dw.n = bw.n),
places as (select rid, count(distinct p) n_hit from (select distinct rid, unnest(range(i, i + n)) p from (select distinct rid, i, n from hit)) group by rid),
items as (select rid, count(*) n_items, string_agg(item, ',' order by item) l from (select distinct rid, item from hit) group by rid)
select doc_id, len(words)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join places using (rid) left join items using (rid)
"""

OP6 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, {BLACK}) words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
        else list_distinct([array_to_string(words[i : i + 3], ' ') for i in range(1, len(words) - 2)]) end sh from d),
n as (select doc_id, len(sh)::bigint n_shingles from s),
e as (select doc_id, unnest(sh) h from s),
common as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id a, doc_id b from n union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select n.doc_id, n_shingles, m component_id, n.doc_id = m kept
from n join (select a, min(b) m from reach group by a) c on c.a = n.doc_id
"""

_RULES = [("symbols_pm", 60, False), ("dup_lines_pm", 450, False), ("repeats_pm", 400, False), ("upper_pm", 250, False), ("mean_chars", 250, True)]
_BOUNDS = """
select {keys}, rule, max(total) n, min(case when 4 * upto >= total then value end) q1, min(case when 4 * upto >= 3 * total then value end) q3
from (select *, sum(n) over (partition by {keys}, rule order by value) upto, sum(n) over (partition by {keys}, rule) total from {sketch})
group by {keys}, rule
"""
OP9 = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
b as (select *, regexp_extract_all(t, {BLACK}) words,
        [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] lines from d),
wins as (select rid, i, array_to_string(words[i : i + 2], ' ') w from (select rid, words, unnest(range(1, len(words) - 1)) i from b)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, w) c from wins) where c > 1),
rep as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from dup) group by rid),
m as (select rid, doc_id, lang, source, len(words)::bigint n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
        coalesce(rep.n, 0)::bigint n_repeat_words, len(lines) n_lines,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) upper
      from b left join rep using (rid)),
r as (select *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) symbols_pm, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) dup_lines_pm,
        coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) repeats_pm, coalesce(1000 * upper // nullif(word_chars, 0), 0) upper_pm,
        coalesce(100 * word_chars // nullif(n_words, 0), 0)::bigint mean, greatest(length(bin(mean)) - 10, 0)::bigint off, (mean >> off) << off mean_chars,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
sk as (select lang, source, rule, value, count(*) n from (
        {" union all ".join(f"select lang, source, '{m}' as rule, {m} as value from r where not base_failed" for m, _, _ in _RULES)})
       group by all),
up as (select lang, rule, value, sum(n) n from sk group by all),
slack(rule, s) as (values {", ".join(f"('{m}', {s})" for m, s, _ in _RULES)}),
own as ({_BOUNDS.format(keys="lang, source", sketch="sk")}),
par as ({_BOUNDS.format(keys="lang", sketch="up")}),
lim as (select own.lang, own.source, rule,
          floor((own.n * (own.q1 - greatest(3 * (own.q3 - own.q1), s, case when rule = 'mean_chars' then own.q3 // 4 else 0 end)) + 50 * (par.q1 - greatest(3 * (par.q3 - par.q1), s, case when rule = 'mean_chars' then par.q3 // 4 else 0 end))) / (own.n + 50)) low,
          floor((own.n * (own.q3 + greatest(3 * (own.q3 - own.q1), s, case when rule = 'mean_chars' then own.q3 // 4 else 0 end)) + 50 * (par.q3 + greatest(3 * (par.q3 - par.q1), s, case when rule = 'mean_chars' then par.q3 // 4 else 0 end))) / (own.n + 50)) high
        from own join par using (lang, rule) join slack using (rule)),
wide as (select lang, source, {", ".join(f"max(case when rule = '{m}' then high end) {m}_high, max(case when rule = '{m}' then low end) {m}_low" for m, _, _ in _RULES)}
         from lim group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce({" or ".join(f"{m} > {m}_high" + (f" or {m} < {m}_low" if low else "") for m, _, low in _RULES)}, false) kept
from r left join wide using (lang, source)
"""

CRC32 = """list_reduce(list_prepend(4294967295, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))"""
OP11 = f"""
with t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) pos
      from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 base, xor({CRC32}, 4294967295) % 6 h from (select distinct conv_id from t)),
own as (select conv_id, list({{'r': r, 'x': x}} order by pos) l from t group by conv_id),
built as (select c.conv_id, list_concat(coalesce(b.l, [])[1 : h::bigint], o.l[h::bigint + 1 :]) l
          from c join own o using (conv_id) left join own b on b.conv_id = c.base),
p as (select conv_id, d, len(l) n, l[1 : d]::varchar || '#' || d k, l[1 : d + 1]::varchar || '#' || (d + 1) k_on,
        case when d > 0 then l[1 : d - 1]::varchar || '#' || (d - 1) end k_up, length(l[d].x) chars
      from (select *, unnest(range(0, len(l) + 1)) d from built)),
v as (select k, any_value(d) d, any_value(k_up) k_up, min(conv_id) conv_id, count(*) n_convs, coalesce(any_value(chars), 0) chars,
        count(distinct case when d < n then k_on end) n_children,
        coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = n), '') ends
      from p group by k),
below as (select a.k, v.n_children = 0 leaf, (v.n_convs - 1) * v.chars saved from v join p a on a.conv_id = v.conv_id and a.d <= v.d),
sums as (select k, count_if(leaf)::bigint n_leaves, sum(saved)::bigint saved_tokens from below group by k)
select v.conv_id, v.d::bigint as depth, up.conv_id parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) ends_sha256
from v join sums using (k) left join v up on up.k = v.k_up
"""

_GROUP = lambda k: f"('0x' || substr(sha256('1:' || coalesce(doc_id::varchar, '')), {8 * k + 1}, 8))::bigint"
OP12 = f"""
with t as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') w,
             {_GROUP(0)} h1, {_GROUP(1)} h2, {_GROUP(2)} h3, {_GROUP(3)} h4 from documents),
c as (select *, len(w)::bigint n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end form from t),
p as (select *, array_to_string(w[1 : a], '') pre, array_to_string(w[a + 1 : b], '') mid, array_to_string(w[b + 1 :], '') suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint prefix_chars, case when form <> 'plain' then length(mid) end::bigint middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
       sha256(t) restored_sha256
from p
"""

SQL: dict[str, str] = {"op2_decontamination": OP2, "op6_near_duplicates": OP6, "op9_quality_rules": OP9, "op11_prefix_trie": OP11, "op12_fill_in_middle": OP12}
