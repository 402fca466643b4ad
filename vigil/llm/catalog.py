"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import secrets as S
from vigil.llm.bpe import op8_byte_bpe
from vigil.llm.decontaminate import ENOUGH, SHARE, SHORTEST, UNITS, WINDOW, op9_decontamination
from vigil.llm.exact_dedup import exact_groups
from vigil.llm.hard_negatives import op13_hard_negatives
from vigil.llm.html_text import op6_html_extraction
from vigil.llm.language_id import op1_language_id
from vigil.llm.near_dedup import near_groups
from vigil.llm.quality import op2_quality
from vigil.llm.resampling import BUCKETS, MIN_WORDS, PERCENT, SEED, op11_importance_resampling
from vigil.llm.secrets import op3_secret_scan
from vigil.llm.sharding import op4_virtual_slot_sharding
from vigil.llm.toxicity import op7_toxicity
from vigil.llm.vantage import NEAREST, op12_nearest_neighbours


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_docs(spark, sf_dir))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_docs(spark, sf_dir), 2).drop("fp")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_secret_scan": op3_secret_scan,
    "op4_virtual_slot_sharding": op4_virtual_slot_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_hard_negatives": op13_hard_negatives,
}


def _template_sql(values: bool) -> str:
    """The template of ``text`` in an engine without lookaround: a name after a
    name is found in a second pass over the first one's result."""
    ws, (name, number, unit) = r"[\x20\x09-\x0D]", (rf"\x{{{c}}}" for c in ("E000", "E001", "E002"))
    mark = [f"chr({c})" for c in (0xE000, 0xE001, 0xE002)]
    keep = [f" || '\\{g}'" if values else "" for g in (1, 2)]
    t = f"regexp_replace(coalesce(text, ''), '[{name}-{unit}]', ' ', 'g')"
    for _ in range(2):
        t = (f"regexp_replace({t}, '([\\p{{L}}\\p{{N}},;{name}]{ws})(\\p{{Lu}}\\p{{Ll}}[\\p{{L}}\\p{{M}}]*)', "
             f"'\\1' || {mark[0]}{keep[1]}, 'g')")
    t = f"lower(regexp_replace({t}, '([0-9][0-9.,:/]*)', {mark[1]}{keep[0]}, 'g'))"
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    t = (f"regexp_replace({t}, '({number}[0-9.,:/]*{ws}?)({units})([^\\p{{L}}\\p{{N}}]|$)', "
         f"'\\1' || {mark[2]}{keep[1]} || '\\3', 'g')")
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}{name}-{unit}\\x20\\x09-\\x0D]+', '', 'g')"
    return f"string_split(trim(regexp_replace({t}, '{ws}+', ' ', 'g')), ' ')"


def _decontamination_sql() -> str:
    name, unit = "\\x{E000}", "\\x{E002}"
    return rf"""
with docs as (
  select distinct doc_id, text, {_template_sql(False)} as words, {_template_sql(True)} as vals from documents),
items as (
  select distinct item_id, text, {_template_sql(False)} as words, {_template_sql(True)} as vals from benchmark),
usable as (
  select *, least({WINDOW}, len(words)) as width, len(words) - least({WINDOW}, len(words)) + 1 as n_item
  from items where len(words) >= {SHORTEST} and words[1] <> ''),
iw as (
  select item_id, text as itext, width, ipos, words[ipos:ipos + width - 1] as win,
         least({ENOUGH}, ceil(n_item * {SHARE}::double)) as need
  from (select *, unnest(range(1, n_item + 1)) as ipos from usable)),
iw2 as (
  select * from iw
  where 2 * len([w for w in win if not regexp_matches(w, '[{name}-{unit}]')]) >= width),
dw as (
  select doc_id, text, width, dpos, words[dpos:dpos + width - 1] as win
  from (select d.*, w.width, unnest(range(1, len(words) - w.width + 2)) as dpos
        from docs d, (select distinct width from usable) w where len(words) >= w.width)),
hits as (
  select distinct doc_id, dw.text, item_id, itext, iw2.width, need, ipos, dpos - ipos as diagonal
  from dw join iw2 using (win)),
found as (
  select doc_id, text, item_id, itext, width, diagonal, count(*) as n_windows, min(ipos) as lo, max(ipos) as hi
  from hits group by all having count(*) >= any_value(need)),
slots as (
  select f.*, [{{'a': p[1], 'b': p[2]}} for p in list_zip(
             i.vals[lo:hi + f.width - 1], d.vals[lo + diagonal:hi + diagonal + f.width - 1])
           if regexp_matches(p[1], '[{name}-{unit}]') and regexp_matches(p[2], '[{name}-{unit}]')] as s
  from found f join docs d on d.doc_id is not distinct from f.doc_id and d.text = f.text
  join usable i on i.item_id is not distinct from f.item_id and i.text = f.itext),
kinds as (
  select *, [x for x in s if regexp_matches(x.a, '[{name}{unit}]')] as named,
         [x for x in s if not regexp_matches(x.a, '[{name}{unit}]')] as numbers from slots),
consistent as (
  select *, len([x for x in s if x.a <> x.b]) as n_changed from kinds
  where 2 * len(list_distinct(named)) = len(list_distinct([x.a for x in named])) + len(list_distinct([x.b for x in named]))
    and 2 * (2 * len(list_distinct(numbers)) - len(list_distinct([x.a for x in numbers]))
             - len(list_distinct([x.b for x in numbers]))) <= len(numbers)),
best as (
  select doc_id, text, item_id, itext, max(struct_pack(n := n_windows, d := -diagonal, k := len(s), c := n_changed)) as m
  from consistent group by all)
select doc_id, item_id, (-m.d)::bigint as start, m.n::bigint as n_windows, m.k::int as n_slots, m.c::int as n_changed
from best"""


def _secret_sql() -> str:
    """Base spans, the two models' counts and the tokens that they add; a match's
    place is the length of what stands before it, split off and matched."""
    rules = [(S.ASSIGN, 1), (S.ACCESS, 0), (S.HEX, 0), (S.TOKEN, 0)]
    quote = lambda p: p.replace("'", "''")
    cut = ", ".join(
        f"string_split_regex(t, '{quote(p)}') as p{k}, regexp_extract_all(t, '{quote(p)}', 0) as m{k}, "
        f"regexp_extract_all(t, '{quote(p)}', {g}) as v{k}" for k, (p, g) in enumerate(rules))
    length = lambda x: f"coalesce(list_sum([length(x) for x in {x}]), 0)"
    spans = ", ".join(
        f"[{{'s': {length(f'p{k}[1:i]')} + {length(f'm{k}[1:i - 1]')}, 'kind': {k}, "
        f"'e': {length(f'p{k}[1:i]')} + {length(f'm{k}[1:i]')}, 'v': v{k}[i]}} for i in range(1, len(m{k}) + 1)] as x{k}"
        for k in range(4))
    chars = "".join(chr(c) for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-")
    pairs = "[substr({0}, i, 2) for i in range(1, length({0}))]"
    names = "['assign', 'access', 'hex', 'markov']"
    text = f"array_to_string([{names}[y.kind + 1] || ':' || y.s || ':' || y.e for y in {{0}}], ',')"
    odds = f"((coalesce({{0}}c.n, 0) + {S.SMOOTH}::double) / (coalesce({{0}}a.n, 0) + {S.SMOOTH}::double * {S.ALPHABET}))"
    rule = quote(S.ANY_RULE)
    return rf"""
with texts as (
  select doc_id, coalesce(text, '') as t,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double as u
  from documents),
cut as (select *, {cut} from texts),
found as (select *, {spans} from cut),
base as (
  select doc_id, t, u, x3, list_sort([y for y in x0 if length(y.v) >= {S.ASSIGN_CHARS}] || x1 || x2) as x from found),
size as (select count(*) as n, count(*) filter (regexp_matches(t, '{rule}')) as m from texts),
random as (
  select unnest({pairs.format('w')}) as pair from (
    select regexp_extract(y.v, '({S.WORD})', 1) as w
    from (select unnest(x) as y from base, size where u * m < {S.SAMPLE})) where length(w) > 1),
plain as (
  select unnest({pairs.format('w')}) as pair from (
    select unnest(regexp_extract_all(regexp_replace(t, '{rule}', ' ', 'g'), '({S.WORD})', 1)) as w
    from texts, size where u * n < {S.SAMPLE} and m > 0)),
rc as (select pair, count(*) as n from random group by 1),
pc as (select pair, count(*) as n from plain group by 1),
ra as (select substr(pair, 1, 1) as c, sum(n) as n from rc group by 1),
pa as (select substr(pair, 1, 1) as c, sum(n) as n from pc group by 1),
letter as (select unnest(string_split('{chars}', '')) as c),
ratio as (
  select x.c || y.c as pair, floor(1000 * ln({odds.format('r')} / {odds.format('p')}) + 0.5)::int as r
  from letter x cross join letter y left join rc on rc.pair = x.c || y.c left join pc on pc.pair = x.c || y.c
  left join ra on ra.c = x.c left join pa on pa.c = x.c),
model as (
  select map_from_entries(list((pair, r))) as r from ratio
  where (select count(*) from rc) > 0 and (select count(*) from pc) > 0),
added as (
  select doc_id, x, [y for y in x3 if len([z for z in x if z.s < y.e and y.s < z.e]) = 0
                     and list_sum([r[q] for q in {pairs.format('y.v')}]) > {S.CUT}] as more
  from base left join model on true)
select doc_id, len([y for y in x if y.kind = 0]) as n_assign, len([y for y in x if y.kind = 1]) as n_access,
  len([y for y in x if y.kind = 2]) as n_hex, sha256({text.format('x')}) as base_sha256,
  {text.format("list_sort(x || more)")} as spans
from added"""


def _resampling_sql() -> str:
    """The crc32 of a word byte by byte, by a table made from its polynomial."""
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return rf"""
with recursive step as (
  select i as b, i as c, 0 as k from range(256) r(i)
  union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
tab as (select list(c order by b) as t from step where k = 8),
docs as (select row_number() over () as r, doc_id, {words} as words from documents),
goal as (select unnest({words}) as w from benchmark),
dw as (select r, unnest(words) as w from docs),
bucket as (
  select w, xor(list_reduce([4294967295::bigint] || [('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::bigint
                            for i in range(1, octet_length(encode(w)) + 1)],
                            lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} as b
  from (select distinct w from (select w from dw union all select w from goal)), tab),
s as (select b, count(*) as n from dw join bucket using (w) group by b),
t as (select b, count(*) as n from goal join bucket using (w) group by b),
total as (select (select coalesce(sum(n), 0) from s)::double as s, (select coalesce(sum(n), 0) from t)::double as t),
gain as (
  select s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (total.s + {BUCKETS})
                              / ((s.n + 1)::double * (total.t + {BUCKETS}))))::bigint as g
  from s left join t using (b), total),
mean as (
  select r, floor(sum(g)::double / count(*))::bigint as weight
  from dw join bucket using (w) join gain using (b) group by r),
scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint
                                              + 0.5::double) / 4294967296::double))))::bigint as score
  from docs left join mean using (r)),
placed as (
  select *, row_number() over (partition by n_features >= {MIN_WORDS} order by score desc, doc_id nulls last) as place,
    {PERCENT} * count(*) filter (n_features >= {MIN_WORDS}) over () // 100 as drawn
  from scored)
select doc_id, n_features, weight, score,
  case when n_features >= {MIN_WORDS} and place <= drawn then place end as rank
from placed"""


# Rows whose vector is there and of finite numbers only.
_FINITE = ("embedding is not null and len(embedding) > 0 "
           "and len([x for x in embedding if x is null or not isfinite(x)]) = 0")

SQL = {
    "op3_secret_scan": _secret_sql(),
    "op5_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
from n join g using (norm)""",
    "op9_decontamination": _decontamination_sql(),
    # All pairs that share a shingle, so for small tables only.
    "op10_minhash_near_dedup": r"""
with recursive w as (
  select doc_id, [x for x in regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+') if x <> ''] as words
  from documents),
s as (
  select distinct doc_id, unnest(case
      when len(words) = 0 then []
      when len(words) = 1 then [words[1]]
      else [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] end) as sh
  from w),
size as (select doc_id, count(*) as n from s group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
link as (
  select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b
  where 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select reach.doc_id, edge.b from reach join edge on edge.a = reach.r)
select d.doc_id, coalesce(size.n, 0)::bigint as n_shingles, min(r.r) as component_id,
       d.doc_id = min(r.r) as kept
from documents d left join size using (doc_id) join reach r on r.doc_id = d.doc_id
group by d.doc_id, size.n""",
    "op11_importance_resampling": _resampling_sql(),
    # Every query against every row, so for small tables only.
    "op12_nearest_neighbours": rf"""
with v as (
  select distinct vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and {_FINITE} and len([x for x in embedding if x <> 0]) > 0),
near as (
  select q.vec_id as query_id, q.e as qe, c.vec_id, list_distance(q.e, c.e) as score
  from v q join v c on len(q.e) = len(c.e) and (q.vec_id, q.e) <> (c.vec_id, c.e)
  where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id, qe order by score, vec_id))::int as rank, vec_id, score
from near qualify rank <= {NEAREST}""",
    "op13_hard_negatives": rf"""
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double)::bigint for x in embedding] as q
  from embeddings where vec_id is not null and label is not null and {_FINITE}),
scored as (
  select a.vec_id as anchor_id, a.q as aq, r.vec_id, r.label = a.label as same,
    list_sum([p[1] * p[2] for p in list_zip(a.q, r.q)])::bigint as score
  from v a join v r on len(a.q) = len(r.q) and (a.vec_id, a.label, a.q) <> (r.vec_id, r.label, r.q)
  where a.vec_id % 50 = 0),
positive as (
  select anchor_id, aq, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id, aq order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, aq, positive_id, positive_score order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id, aq)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3""",
}
