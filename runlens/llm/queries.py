"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import re

from .bpe import op7_bpe
from .chat import op10_chat_format
from .licences import op1_license_scan
from .lines import LINE_DEDUP_SQL, op5_line_dedup
from .media import op3_media_columns
from .minhash import op8_minhash_dedup
from .ordinal import op6_quality_classifier
from .packing import op9_best_fit_packing
from .resample import op11_importance_resampling
from .rules import op2_quality_rules
from .secrets import BASE, RULES, Rule, op13_secret_scan
from .spelling import op12_spelling_variants
from .substring import op4_substring_dedup

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_media_columns": op3_media_columns,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe": op7_bpe,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_chat_format": op10_chat_format,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_secret_scan": op13_secret_scan,
}
WORDS_SQL = r"""words as (
  select doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents)"""

SUBSTRING_SQL = f"""
with {WORDS_SQL.format(text="coalesce(text, '')")},
windows as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from words, unnest(range(1, len(ws) - 11)) t(i)),
firsts as (select k, min(doc_id) as m from windows group by k),
covered as (select distinct doc_id, j from windows join firsts using (k), unnest(range(i, i + 13)) t(j) where doc_id > m),
placed as (select doc_id, j, ws[j] as word from words, unnest(range(1, len(ws) + 1)) t(j)),
kept as (select doc_id, string_agg(word, ' ' order by j) as text from placed p anti join covered c using (doc_id, j) group by doc_id),
removed as (select doc_id, count(*) as n from covered group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(r.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from words w left join kept k using (doc_id) left join removed r using (doc_id)
"""

MINHASH_SQL = f"""
with recursive {WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
shingles as (
  select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as k from words, unnest(range(1, len(ws) - 1)) t(i) where len(ws) >= 3
  union all select doc_id, array_to_string(ws, ' ') from words where len(ws) in (1, 2)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from words union select r.doc_id, l.b from reach r join edges l on l.a = r.other)
select r.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.other) as component_id, r.doc_id = min(r.other) as kept
from reach r left join sizes s using (doc_id) group by r.doc_id
"""

CHAT_SQL = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k, coalesce(role, '') as role, coalesce(text, '') as text
  from (select conv_id, turn, role, text from conversations
        union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       sum(15 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::bigint as formatted_chars
from turns group by conv_id
"""



def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 of a SQL expression, byte by byte."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1 for c in table]
    values = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), lambda c, b: xor(c >> 8, ({table}::bigint[])[1 + (xor(c, b) & 255)])), 4294967295)"


RESAMPLE_SQL = rf"""
with texts as (
  select 'own' as side, doc_id, text from documents union all select 'target', null, text from benchmark
), words as (
  select side, row_number() over () as own, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from texts
), runs as (
  select side, own, array_to_string(ws[i:i + n - 1], ' ') as f
  from words, unnest(range(1, 4)) a(n), unnest(range(1, len(ws) - n + 2)) b(i)
), hashed as (
  select f, {crc32_sql("f")} % 10000 as bucket from (select distinct f from runs)
), counted as (
  select side, bucket, count(*) as n from runs join hashed using (f) group by all
), sums as (
  select coalesce(sum(n) filter (side = 'own'), 0)::double as s_all, coalesce(sum(n) filter (side = 'target'), 0)::double as t_all from counted
), gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * (s_all + 10000) / ((coalesce(s.n, 0)::double + 1) * (t_all + 10000))))::bigint as gain
  from sums cross join range(10000) b(bucket) left join (from counted where side = 'own') s using (bucket) left join (from counted where side = 'target') t using (bucket)
), weights as (
  select own, sum(gain)::bigint as weight from runs join hashed using (f) join gains using (bucket) where side = 'own' group by own
), scored as (
  select doc_id, len(ws) as n_words, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5)::double / 4294967296))))::bigint as score
  from words left join weights using (own) where side = 'own'
), able as (
  select *, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n from scored where n_words >= 20
)
select doc_id, n_features, weight, score, n_words, case when place <= 5 * n // 100 then place end as rank from able
union all select doc_id, n_features, weight, score, n_words, null from scored where n_words < 20
"""

SPELLING_SQL = rf"""
with recursive runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) t(run)
), hashed as (
  select *, {crc32_sql("(coalesce(doc_id::varchar, '') || ':' || run)")} as h from (select doc_id, run, count(*) as n from runs group by all)
), words as (
  select word, sum(n)::bigint as n
  from (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5
), shorter as (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from words, unnest(range(1, length(word) + 1)) t(i)
), pairs as (
  select a.word, b.word as near from shorter a join shorter b using (s, i) where a.word <> b.word
  union select a.word, b.word from shorter a join words b on a.s = b.word
  union select b.word, a.word from shorter a join words b on a.s = b.word
), best as (
  select p.word, w.n, p.near, v.n as near_n, row_number() over (partition by p.word order by v.n desc, p.near) as k, count(*) over (partition by p.word) as n_near
  from pairs p join words w on w.word = p.word join words v on v.word = p.near
), forms as (
  select word, near as form, near_n as form_n from best where k = 1 and near_n >= 5 * n
), chain as (
  select word, word as here, 0 as step from words union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.here
), roots as (
  select word, arg_max(here, step) as root from chain group by word
)
select word, f.form, r.root, w.n, coalesce(b.n_near, 0)::bigint as n_near, f.form_n
from words w join roots r using (word) left join forms f using (word) left join (from best where k = 1) b using (word)
"""


def secrets_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """Every rule in every text, without an index: each match with what stands before it, from which lengths give its place."""

    def pattern(r: Rule) -> str:
        p = r.pattern
        if r.any_case:  # ASCII letters only; outside of classes these patterns have no other letters than their own words and \\x20
            p = re.sub(r"\\x20|\[[^]]*\]|[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]" if len(m[0]) == 1 else m[0], p)
        return p.replace("'", "''")

    rows = " union all ".join(
        f"select doc_id, own, {i} as rank, '{r.kind}' as kind, {r.least} as least, regexp_extract_all(t, '((?s:.)*?)({pattern(r)})', 0) as w, regexp_extract_all(t, '((?s:.)*?)({pattern(r)})', 1) as p, regexp_extract_all(t, '((?s:.)*?)({pattern(r)})', {3 if '(' in pattern(r).replace('(?:', '') else 2}) as g from texts"
        for i, r in enumerate(rules)
    )
    return f"""
with texts as (select doc_id, row_number() over () as own, coalesce(text, '') as t from documents),
found as ({rows}),
placed as (
  select own, rank, kind, least, length(g[k]) as size, list_sum(list_transform(w[1:k], lambda x: length(x)))::bigint as stop, length(w[k]) - length(p[k]) as long
  from found, unnest(range(1, len(w) + 1)) t(k)
), spans as (select own, rank, kind, (stop - long)::bigint as start, kind || ':' || (stop - long)::bigint || ':' || stop as span from placed where size >= least),
grouped as (
  select own, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
         string_agg(span, ',' order by start, rank) filter (rank < {BASE}) as base, string_agg(span, ',' order by start, rank) as spans
  from spans group by own
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join grouped using (own)
"""


ORACLES: dict[str, str] = {
    "op4_substring_dedup": SUBSTRING_SQL,
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op8_minhash_dedup": MINHASH_SQL,
    "op10_chat_format": CHAT_SQL,
    "op11_importance_resampling": RESAMPLE_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_secret_scan": secrets_sql(),
}
